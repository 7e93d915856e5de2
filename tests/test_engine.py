import json

import pytest
from pyspark.sql import functions as F

from tempolith import __main__ as cli
from tempolith import hooks, programs
from tempolith.engine import BELIEF, CLAIM, OPERATIONS, TRACE, Engine, fact_type
from tempolith.plans.nlg import with_fields

EDGE = "edge_uid string, source_uid string, target_uid string, relation string, start_year long, end_year long, edge_type string, support_count long"


@pytest.fixture(scope="module")
def eng(spark):
    names = {"a": "Old Mill", "b": "Great Fire", "c": "New Town"}
    nodes = spark.createDataFrame([(k, v, "event") for k, v in names.items()], "node_uid string, label string, category string")
    edges = spark.createDataFrame([("e", "a", "b", "caused", 1999, 2001, "base", 2), ("f", "b", "c", "led_to", 2001, None, "base", 1)], EDGE)
    return Engine(spark, nodes, edges)


def test_all_operations():
    assert len(OPERATIONS) == 31


def test_truth(spark, eng):
    eng.reset()
    assert OPERATIONS["tms-start-trace"](eng, "q") == "q"
    eng.record_rules(spark.createDataFrame([(None, "r1", "f", "c", "1", 1, 1)], TRACE))
    eng.record_rules(spark.createDataFrame([("q", "r2", "c", "d", "2", 2, 2), ("q", "r3", "f", "c", "2", 3, 3)], TRACE))
    assert OPERATIONS["tms-rules-fired"](eng).first().rules == "r1,r2,r3"
    assert [(r.fact_id, r.n_values) for r in eng.contradictions().collect()] == [("c", 2)]
    asked = spark.createDataFrame([("q", "d"), ("q", "x")], "query_id string, fact_id string")
    assert {r.fact_id: r.text for r in eng.explain_trace(asked).collect()} == {"d": "r2 | r1 || r2 | r3", "x": "no rule concludes this fact"}
    eng.add_beliefs(spark.createDataFrame([("x", None, None), ("y", "x", None)], BELIEF))
    eng.add_supports(spark.createDataFrame([("y", "x"), ("y", "w")], "belief_id string, support_id string"))
    told = {r.belief_id: r.text for r in eng.explain_belief(spark.createDataFrame([("y",), ("z",)], "belief_id string")).collect()}
    assert told == {"y": "Belief y is supported by w, x. Evidence: no direct evidence.", "z": "Belief not found."}
    eng.retract(spark.createDataFrame([("x",)], "belief_id string"))
    assert [r.belief_id for r in eng.dirty_beliefs().collect()] == ["y"] and eng.active_beliefs().isEmpty()
    moved = eng.counterfactual_shift(spark.createDataFrame([("y", {"a": "b"})], "belief_id string, payload map<string,string>"), "+1 year")
    assert moved.first().payload == {"a": "b", "counterfactual_time_shift": "+1 year"} and [r.belief_id for r in eng.active_beliefs().collect()] == ["cf_y"]
    eng.tell_claims(spark.createDataFrame([("c", "old", 2.0, 1, None), ("c", "new", 0.5, 2, [("s", "t", 1.0, None)])], CLAIM))
    assert eng.justify_claims().first().text == "Claim 'new' (conf 0.50): [s] t (w=1.0)" and eng.top_claims().count() == 1
    eng.reset()
    assert eng.firings.isEmpty()


def test_graph(spark, eng):
    asked = spark.createDataFrame([(1, "What caused 'Great Fire' around 2000?"), (2, "Was the Old Mill sold?")], "q_id long, text string")
    got = {r.q_id: r for r in eng.answer(asked).collect()}
    assert got[1].question_type == "reason_of" and "Old Mill" in got[1].answer and got[1].confidence > 0.5
    assert eng.evidence().where("q_id = 1 and rank = 1").first().sentence.startswith("Old Mill [event] caused")
    assert eng.mermaid().where("q_id = 1").first().diagram.startswith("graph TD")
    assert eng.confidence().where("q_id = 1").first().confidence == pytest.approx(0.5)
    assert eng.evidence_atoms().where("q_id = 1 and rank = 1").first().time == "1999"
    pairs = spark.createDataFrame([(1, "a", "c"), (2, "c", "a")], "q_id long, start_uid string, end_uid string")
    told = {r.q_id: r for r in eng.explain_path(pairs).collect()}
    assert told[1].path == "Old Mill -[caused @1999]-> Great Fire | Great Fire -[led_to @2001]-> New Town" and told[2].error == "no path found"
    assert eng.explain_path_styled(pairs, "novice").first().narrative.startswith("Here is the timeline in plain terms. Step by step: Old Mill")
    held = eng.explain_path_as_belief(pairs, ["s1"]).first()
    assert held.justification.startswith("Belief path_1 is supported by s1. Evidence: [graph_path] Old Mill caused Great Fire at 1999")
    assert eng.beliefs.where("belief_id = 'path_1' and support_id = 's1'").count() == 1


def test_texts(spark, eng, tmp_path):
    facts = with_fields(spark.createDataFrame([(1, "point_in_time", "The Mill", "was sold", "1901"), (2, "interval", None, "war", None)], "id long, fact_type string, entity string, event string, date string"))
    got = {r.id: r for r in eng.render(facts).collect()}
    assert got[1].text == "The Mill was sold in 1901." and got[2].error == "missing start_date,end_date"
    assert eng.render_by(facts, "polished").where("id = 1").first().strategy == "template"
    told = spark.createDataFrame([(1, "interval", "The Mill", "sold 1901", "The Mill ran from 1901 to 1905")], "id long, kind string, entity string, fact string, text string")
    assert eng.evaluate(told).first().hallucinated and eng.evaluate_and_save(told, str(tmp_path / "out")).first().hallucination_rate == 1.0
    f = spark.createDataFrame([(1, "a", "b", "c", None, "a", "x", "c", "now")], "id long, subject string, predicate string, object string, timeframe string, alt_subject string, alt_predicate string, alt_object string, alt_timeframe string")
    assert eng.counterfactual(f).first().delta == "predicate changed from 'b' to 'x'; timeframe changed from 'None' to 'now'"
    assert fact_type(" Point ") == "point_in_time"
    with pytest.raises(ValueError):
        fact_type("odd")


def test_programs(spark, eng):
    r = programs.Runner(eng)
    out = r.run("""
      ; atoms
      (edge e1 line caused drop 1913) (edge e2 Ford introduced line 1913) (edge e3 drop "reduced much" prices 1914)
      (match &self (edge $u $s caused $t $y) (because $t $s $y))
      (match (edge $a introduced $b $t1) (edge $b caused $c $t2) ($a $c))
      (transform (, (edge $u $a introduced $b $t)) (, (edge $b introduced_by $a $t)))
      ! (tms-start-trace q9)
    """)
    assert out == [["(because drop line 1913)"], ["(Ford drop)"], ["4"], ["q9"]]
    assert r.space.explore("line").count() == 3 and r.space.copy().count() == 4
    r.space.clear()
    assert r.space.count() == 0
    for bad in ("(a", "a)", "! (nothing)"):
        with pytest.raises(ValueError):
            r.run(bad)
    r.table("asked", spark.createDataFrame([(1, "What caused 'Great Fire' around 2000?")], "q_id long, text string"))
    assert "Old Mill" in r.run("! (temporal-QA asked)")[0][0]


def test_sql_functions(spark):
    programs.register(spark)
    rows = spark.sql("""SELECT e.* FROM VALUES ('[["a","r","b"],{"src":"c","rel":"s","tgt":"d","year":5},7]') AS t(j), LATERAL edges_from_json(t.j) AS e""").collect()
    assert sorted(map(tuple, rows)) == [("a", "r", "b", ""), ("c", "s", "d", "5")]
    assert spark.sql("SELECT overlaps_year(2000, 1990, 1995), overlaps_year(1994, NULL, 1995), parse_year('-0044'), parse_year('690-10-16')").first()[:] == (True, False, -44, 690)


def test_command_line(spark, tmp_path, capsys):
    trace = {"query_id": "q", "rule_traces": [{"rule_id": "r1", "inputs": [{"fact_id": "a", "value": "1"}], "conclusion": {"fact_id": "b", "value": "x"}, "fired_at": 1.0}, {"rule_id": "r2", "inputs": [{"fact_id": "b", "value": "x"}], "conclusion": {"fact_id": "b", "value": "y"}, "fired_at": 2.0}]}
    path = tmp_path / "t.jsonl"
    path.write_text(json.dumps(trace) + "\n")
    assert cli.run(spark, str(path), "list-rules").first().rules == "r1,r2"
    assert cli.run(spark, str(path), "contradictions").first().n_values == 2
    assert cli.run(spark, str(path), "influential", top_k=1).first().fact_id == "a"
    assert {r.rule_id: r.status for r in cli.run(spark, str(path), "why-not", rule=["r1", "r9"]).collect()} == {"r1": "fired", "r9": "absent in trace"}
    assert "r1" in cli.run(spark, str(path), "explain-fact", fact="b").first().text
    (tmp_path / "one.json").write_text(json.dumps(trace, indent=1))
    assert cli.run(spark, str(tmp_path / "one.json"), "list-rules").first().rules == "r1,r2"


def test_hooks(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string")
    assert {r.id: r.answer for r in hooks.ask(rows, lambda ts: [t.upper() for t in ts]).collect()} == {1: "A", 2: "B"}
    assert hooks.ask(rows, None).where("answer is not null").isEmpty()

    def fails(texts):
        raise OSError("down")

    assert {r.error for r in hooks.ask(rows, fails, times=1).collect()} == {"OSError: down"}
    assert hooks.judged(rows, lambda ts: ['{"clarity": 5, "depth": 0.5}' if t == "a" else "?" for t in ts]).orderBy("id").first().scores == {"clarity": 1.0, "depth": 0.5}
    assert {r.error for r in hooks.ask(rows, lambda ts: []).collect()} == {"ValueError: 0 answers to 1 texts"}
    v = hooks.embed(rows.select("id", F.col("prompt").alias("text")), lambda ts: [[[3.0, 0.0], [3.0, 8.0]] for _ in ts]).first().embedding
    assert v == pytest.approx([0.6, 0.8])
    c = spark.createDataFrame([("q", f"e{i}", float(i)) for i in range(9)] + [("p", "x", 1.0)], "q_id string, edge_uid string, score double")
    assert hooks.filtered(c).count() == 6 and hooks.filtered(c, spark.createDataFrame([("q", "e0")], "q_id string, edge_uid string")).count() == 2
    with pytest.raises(Exception, match="do not match"):
        hooks.evaluated_batch(rows, rows.where("id = 1").withColumnRenamed("prompt", "text")).collect()
