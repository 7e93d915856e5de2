"""The pipeline, stage by stage, against what each stage must do to its own input."""

import random

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402


def test_stages(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"v{rng.randrange(3000)}" for _ in range(n))
    clean = [text(80) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)]
    rows += [(100, "too short", "en", "s0", 9), (101, clean[0], "en", "s1", 0), (102, clean[1] + " tail", "en", "s2", 0), (103, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        seen.append(sorted({r.doc_id for r in docs.select("doc_id").collect()}))
        out = stage(spark, docs, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "source_mixing", "best_fit_packing"]
    assert seen[1] == [*range(30), 101, 102] and seen[2] == [*range(30), 102] and seen[3] == [*range(30)]
    assert {r.doc_id for r in docs.collect()} <= set(seen[4])


#: Names that the operators use inside, as columns of the table.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row long, whole string, size long, q_host string, q_rules string, id long, th long, place long, uid long, pid int, rank long, digest string, taken long, spans string, lo long, k_id long"


def test_edges(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(f"u{rng.randrange(5000)}" for _ in range(n))
    long = text(60_000)
    rest = (7, "w", 7, "h", "r", 7, 7, 7, 7, 7, 7, "d", 7, "s", 7, 7)
    rows = [(i, text(60), "en", "a" if i % 2 else None, 1, *rest) for i in range(20)]
    rows += [rows[3], (None, text(50), None, None, None, *rest), (None, None, None, None, None, *rest), (50, " ", "en", "a", 1, *rest), (51, long, "en", "b", 1, *rest), (3, text(40), "en", "b", 1, *rest)]
    docs = spark.createDataFrame(rows, CLASHING).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert docs.columns == [x.split(" ")[0] for x in CLASHING.split(", ")], name
        assert docs.where("row = 7 and whole = 'w' and digest = 'd'").count() == docs.count()
        if name != "source_mixing":
            ids = sorted((r.doc_id for r in docs.select("doc_id").collect()), key=repr)
            assert ids == sorted([*range(20), None, 51, 3], key=repr) if name != "quality_rules" else ids.count(3) == 3
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sum(r.length for r in out if r.doc_id == 51) > 2048 and {r.doc_id for r in out} <= {*range(20), None, 51}
    fill = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048


def test_empty(spark):
    docs = spark.createDataFrame([], CLASHING)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        if name != "best_fit_packing":
            assert out.columns == docs.columns
