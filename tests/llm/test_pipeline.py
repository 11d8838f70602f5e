from __future__ import annotations

import hashlib

import numpy as np
from odd_rows import nothing, tricky  # noqa: F401
from oracle_check import connect, difference
from test_exact_and_bpe import brute_dedup
from test_pairs import brute_components, norm

import __spark_entry__ as contract
import corpus_pipeline
from wayfreight.llm import bpe, catalogue, quality

DATA = "/root/testdata/sf0.001"


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_queries_equal_sql(spark):
    con = connect(DATA)
    for name, sql in catalogue.LLM_ORACLES.items():
        assert difference(contract.queries()[name](spark, DATA), con, sql) is None, name


def test_all_are_registered():
    names = contract.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES][0] == "quality"


def test_stages_keep_and_drop_what_brute_force_does(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, DATA).cache()
    assert 0 < good.count() < docs.count() and good.columns == docs.columns
    first = stages["exact_dedup"](spark, good, DATA).cache()
    assert {i for i, _ in pairs_of(first)} == {i for i, keep, *_ in brute_dedup(pairs_of(good)) if i == keep}
    single = stages["near_dedup"](spark, first, DATA).cache()
    assert {i for i, _ in pairs_of(single)} == {i for i, _, c in brute_components(pairs_of(first), 5, 80) if i == c}
    clean = stages["decontaminate"](spark, single, DATA).cache()
    items = [" " + " ".join(norm(r.text)) + " " for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    holding = {i for i, t in pairs_of(single) if any(x in " " + " ".join(norm(t)) + " " for x in items)}
    assert {i for i, _ in pairs_of(clean)} == {i for i, _ in pairs_of(single)} - holding
    enc = bpe.encoder()
    expected = {}
    for i, t in pairs_of(clean):
        ids = enc.encode_ordinary(t)
        expected[i] = (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, DATA).collect()} == expected


def test_stages_take_odd_rows(spark, tricky, nothing):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, tricky, DATA)
        if name != "tokens":
            assert out.columns == tricky.columns
        assert out.count() <= tricky.count()
        assert stage(spark, nothing, DATA).count() == 0


def test_stages_decide_row_by_row(spark):
    """Rows without an id, ids that repeat with other texts, and equal rows."""
    schema = "doc_id long, text string, lang string"
    table = lambda rows: spark.createDataFrame([(i, t, "en") for i, t in rows], schema).repartition(3)
    left = lambda name, rows: sorted(pairs_of(stages[name](spark, table(rows), DATA)), key=str)
    stages = dict(corpus_pipeline.STAGES)

    docs = pairs_of(spark.read.parquet(f"{DATA}/documents.parquet"))
    scores = quality.score_quality(table(docs), spark.read.parquet(f"{DATA}/labels.parquet")).collect()
    poor = {r.doc_id for r in scores if not r.predicted}
    bad, good = (next(t for i, t in docs if (i in poor) == which) for which in (True, False))
    held = next(r.doc_id for r in scores if r.held_out and r.predicted)
    odd = docs + [(None, bad), (None, good), (held, bad)]
    assert left("quality", odd) == sorted([(i, t) for i, t in docs if i not in poor] + [(None, good)], key=str)

    rows = [(1, "a b"), (2, "A b"), (2, "A b"), (2, "c"), (None, "a B"), (None, "d"), (None, "D"), (3, "c")]
    assert [(i, t.lower()) for i, t in left("exact_dedup", rows)] == [(2, "a b"), (3, "c"), (None, "d")]

    words = [f"w{k}" for k in range(60)]
    near, other = " ".join(words), " ".join(f"v{k}" for k in range(60))
    rows = [(5, near), (5, near), (4, near + " x"), (4, other), (None, near + " y"), (None, other + " z"), (6, other + " q"), (None, "alone"), (None, "alone")]
    assert left("near_dedup", rows) == sorted([(4, near + " x"), (4, other), (None, "alone")], key=str)

    passage = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    assert left("decontaminate", [(1, passage), (1, near), (None, passage), (None, near), (2, other)]) == sorted([(1, near), (None, near), (2, other)], key=str)
