import datetime as dt

from pyspark.sql import functions as F

from tempolith.functions.timex import mentions, normalise, normalise_one, span_texts, tag, temporal_expressions

REF = dt.date(2025, 12, 10)


def values(text):
    return [s["value"] for s in tag(text, REF)]


def test_own_texts():
    assert values("The vote of March 3, 2021 began at 09:45 and was repeated last Friday.") == ["2021-03-03", "09:45", "2025-12-05"]
    assert values("Every Thursday they rest around midnight for 2 weeks; next year they stop on 2027-01-02 or once a month.") == ["every-thursday", "00:00", "P2W", "2026-12-10", "2027-01-02", "once-a-month"]
    assert values("The run took 2 hours 5 minutes, the way back 4h30m.") == ["PT2H5M", "PT4H30M"]
    assert values("They open tomorrow at 8am. The fair runs June 2-9, 2024.") == ["2025-12-11T08:00", "2024-06-02/2024-06-09"]


def test_ends_of_months_and_spans():
    assert [s["value"] for s in tag("in 1 month", dt.date(2024, 1, 31))] == ["2024-02-29"]
    for s in tag("three weeks ago, at 9am", REF):
        assert "three weeks ago, at 9am"[s["start"] : s["end"]] == s["text"]


def test_frame(spark):
    df = spark.createDataFrame([(1, "yesterday", REF), (2, None, REF)], "id long, text string, reference date")
    assert [(r.id, r.value) for r in temporal_expressions(df).collect()] == [(1, "2025-12-09")]


def test_normalise(spark):
    assert normalise_one("last monday", REF) == ("2025-12-08", "DATE", []) and normalise_one("evening", REF) == ("EV", "TIME", [])
    assert normalise_one("nothing", REF) == (None, "UNKNOWN", ["unhandled_expression"]) and normalise_one("nothing", REF, "SET")[1] == "SET"
    df = spark.createDataFrame([(1, "2 days", "DURATION", REF), (2, None, None, REF)], "id long, text string, type string, reference date")
    assert [(r.value, r.errors) for r in normalise(df).orderBy("id").collect()] == [("P2D", []), (None, ["unhandled_expression"])]


def test_mentions_and_spans(spark):
    df = spark.createDataFrame([(1, "From 2020-01-01 to 2020-01-04, 3 days in 2020; today again.", REF), (2, "nothing", REF), (3, None, REF)], "id long, text string, reference date")
    got = {r.id: r for r in mentions(df).collect()}
    assert got[1].ranges == ["2020-01-01/2020-01-04"] and got[1].durations == ["P3D"] and got[1].dates == ["2025-12-10"] and got[1].years == [2020, 2020, 2020]
    assert got[2].dates == [] == got[3].years
    s = spark.createDataFrame([("on friday", [(3, 9, None)])], "t string, s array<struct<start:int,end:int,type:string>>")
    assert s.select(span_texts(F.col("t"), F.col("s"))[0].alias("x")).first().x[:] == (3, 9, "DATE", "friday")
