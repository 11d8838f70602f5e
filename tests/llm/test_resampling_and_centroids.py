from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import documents, nothing, tricky  # noqa: F401
from oracle_check import connect, difference

from wayfreight.llm import centroids, importance
from wayfreight.llm.catalogue import LLM_ORACLES, LLM_QUERIES
from wayfreight.llm.common import UPPER

LOWERED = str.maketrans(UPPER, UPPER.lower())
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_importance", "op12_centroids"])
def test_query_equals_sql(spark, name):
    assert difference(LLM_QUERIES[name](spark, SMALL), connect(SMALL), LLM_ORACLES[name]) is None


# --- importance resampling -------------------------------------------------------------------------


def grams(text, least, most):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWERED))
    runs = [" ".join(words[k : k + n]) for n in range(least, most + 1) for k in range(len(words) - n + 1)]
    return len(words), runs


def brute_resample(pairs, target, least=1, most=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    def counted(texts):
        return Counter(crc32(g.encode()) % buckets for t in texts for g in grams(t, least, most)[1])

    corpus, wanted = counted(t for _, t in pairs), counted(target)
    s_all, t_all = float(sum(corpus.values())), float(sum(wanted.values()))

    def gain(b):
        return math.floor(1000 * math.log((wanted[b] + 1.0) * (s_all + buckets) / ((corpus[b] + 1.0) * (t_all + buckets))))

    out = []
    for i, t in pairs:
        n_words, features = grams(t, least, most)
        weight = sum(gain(crc32(g.encode()) % buckets) for g in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n_words, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    eligible = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = Counter()
    places = {}
    for place, r in enumerate(eligible[: percent * len(eligible) // 100], 1):
        places.setdefault((r[0], r[4]), []).append(place)
    result = []
    for i, n_words, n, weight, score in out:
        at = drawn[i, score]
        free = places.get((i, score), []) if n_words >= min_words else []
        result.append((i, n, weight, score, free[at] if at < len(free) else None))
        drawn[i, score] += n_words >= min_words
    return sorted(result, key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB1 .é\U0001f600\x00-"), max_size=40), min_size=1, max_size=5), st.integers(1, 4))
def test_run_crcs_are_those_of_their_texts(texts, n):
    found = [importance.prefix_crcs(t.encode()) for t in texts]
    ends, lengths = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    offsets = np.concatenate(([0], np.cumsum([len(f[0]) for f in found])))
    crcs, made = importance.run_crcs(ends, lengths, offsets, n)
    expected = [[crc32(g.encode()) for g in grams(t, n, n)[1]] for t in texts]
    assert made.tolist() == [len(e) for e in expected]
    assert crcs.tolist() == [c for e in expected for c in e]


def test_shifts_over_long_runs_and_pieces(monkeypatch):
    monkeypatch.setattr(importance, "PIECE_BYTES", 64)
    text = " ".join(random.Random(2).choice(["a", "word", "x" * 70, "y" * 5000]) for _ in range(300))
    ends, lengths = importance.prefix_crcs(text.encode())
    for n in (1, 2, 9):
        crcs, _ = importance.run_crcs(ends, lengths, np.array([0, len(ends)]), n)
        assert crcs.tolist() == [crc32(g.encode()) for g in grams(text, n, n)[1]]


@pytest.mark.parametrize("how", [{}, {"least": 1, "most": 3, "buckets": 97, "percent": 50, "min_words": 3, "seed": 7}])
def test_resampling_equals_brute_force(spark, tricky, documents, how):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    target = [r.text for r in benchmark.collect()]
    for docs in (tricky, documents):
        pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        found = importance.importance_resample(docs, benchmark, **how)
        assert rows(found, "doc_id", "n_features", "weight", "score", "rank") == brute_resample(pairs, target, **how)


def test_ties_go_to_the_smaller_id_and_places_have_no_gaps(spark):
    rng = random.Random(5)
    score = [rng.randrange(4) for _ in range(500)]
    frame = spark.createDataFrame(list(enumerate(score)), "doc_id bigint, score bigint").repartition(7)
    found = {r.doc_id: r["rank"] for r in importance.ranked(spark, frame, 300).collect()}
    order = sorted(range(500), key=lambda i: (-score[i], i))
    assert found == {i: k + 1 if k < 300 else None for k, i in enumerate(order)}


def test_resampling_of_and_towards_nothing(nothing, documents):
    assert rows(importance.importance_resample(nothing, documents)) == []
    pairs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert rows(importance.importance_resample(documents, nothing)) == brute_resample(pairs, [])


def test_only_scores_shuffle(spark, documents):
    plan = importance.importance_resample(documents, documents)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "Window" not in plan


# --- centroid clustering ---------------------------------------------------------------------------


def brute_clusters(pairs, dims, k, rounds, scale, seed):
    kept = []
    for i, v in pairs:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            sha = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
            kept.append((i, [math.floor(scale * x) for x in v], sha))
    middle = [v for _, v, _ in sorted(kept, key=lambda r: (r[2], np.array(r[1], "<i4").tobytes()))[:k]]
    for left in range(rounds, -1, -1):
        distances = [[sum((x - y) ** 2 for x, y in zip(v, c)) for c in middle] for _, v, _ in kept]
        nearest = [d.index(min(d)) for d in distances]
        if left:
            for c in range(len(middle)):
                mine = [v for (_, v, _), n in zip(kept, nearest) if n == c]
                if mine:
                    middle[c] = [sum(x) // len(mine) for x in zip(*mine)]
    inertia = Counter()
    for d, n in zip(distances if kept else [], nearest if kept else []):
        inertia[n] += d[n]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(
        ((i, n, d[n], inertia[n], sum(inertia.values()), names[n]) for (i, _, _), d, n in zip(kept, distances, nearest)), key=str
    ) if kept else []


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
ODD_VECTORS = [
    (1, [0.5, -0.25, 3.0]), (1, [0.5, -0.25, 3.0]), (2, [0.1, 0.2]), (3, None), (4, [None, 1.0, 2.0]), (5, [float("nan"), 1.0, 2.0]),
    (6, [float("inf"), 1.0, 2.0]), (7, []), (None, [9.0, 9.0, 9.0]), (8, [-0.0001, 0.0001, -7.5]), (9, [1e5, -1e5, 0.0]), (10, [0.0, 0.0, 0.0]),
]


def vectors_of(spark, pairs):
    extra = [(i, v, 1, [1], 2.5, b"x") for i, v in pairs]
    return spark.createDataFrame(extra, "vec_id bigint, embedding array<double>, cluster int, v array<int>, n double, dots binary")


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_clusters_of_odd_vectors_equal_brute_force(spark, rounds):
    rng = random.Random(3)
    pairs = ODD_VECTORS + [(100 + k, [rng.gauss(rng.choice((-2, 2)), 1) for _ in range(3)]) for k in range(60)]
    found = centroids.cluster_vectors(vectors_of(spark, pairs).repartition(4), dims=3, k=4, rounds=rounds, scale=16, seed=1)
    assert rows(found, *COLUMNS) == brute_clusters(pairs, 3, 4, rounds, 16, 1)


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    pairs = [(k, [float(k % 2), 0.0]) for k in range(40)]  # two places, five centroids on them
    found = centroids.cluster_vectors(vectors_of(spark, pairs), dims=2, k=5, rounds=3, scale=4, seed=0)
    assert rows(found, *COLUMNS) == brute_clusters(pairs, 2, 5, 3, 4, 0)
    assert len({r.cluster for r in found.collect()}) == 2


def test_fewer_vectors_than_clusters_and_none(spark):
    few = vectors_of(spark, ODD_VECTORS[:3])
    assert rows(centroids.cluster_vectors(few, dims=3), *COLUMNS) == brute_clusters(ODD_VECTORS[:3], 3, 8, 10, 1024, 3)
    none = centroids.cluster_vectors(vectors_of(spark, ODD_VECTORS[2:8]), dims=3)
    assert rows(none) == [] and none.columns == list(COLUMNS)


def test_vectors_too_large_for_exact_distances_are_refused(spark):
    with pytest.raises(Exception, match="no exact squared distance"):
        centroids.cluster_vectors(vectors_of(spark, [(1, [1e30, 0.0])]), dims=2)


@pytest.mark.parametrize("size", [1 << 10, 1 << 26])
def test_updated_products_equal_fresh_ones(size):
    """Whatever components moved, the products that follow them are those computed from scratch."""
    import pyarrow as pa

    rng = np.random.default_rng(size)
    x = rng.integers(-size, size, (50, 6))
    before = rng.integers(-size, size, (3, 6))
    now = np.where(rng.random((3, 6)) < 0.3, before + rng.integers(-9, 9, (3, 6)), before)
    now[1] = before[1]  # one that stays

    def batch(**columns):
        return iter([pa.RecordBatch.from_pydict({"vec_id": list(range(50)), "x": centroids._packed(x.astype("<i4")), **columns})])

    old = next(centroids._assign_batches(6, before, None)(batch()))
    fresh = list(centroids._assign_batches(6, now, None)(batch()))
    followed = list(centroids._assign_batches(6, now, before)(batch(dots=old.column("dots"))))
    assert [b.to_pydict() for b in fresh] == [b.to_pydict() for b in followed]
    dots = centroids._unpacked(fresh[0].column("dots"), "<i8", 3)
    assert dots.tolist() == [[sum(int(p) * int(q) for p, q in zip(v, c)) for c in now] for v in x]


def test_tables_of_earlier_rounds_are_dropped(spark, monkeypatch, tmp_path):
    made = []

    def named(_, purpose):
        made.append(tmp_path / f"{purpose}-{len(made)}")
        assert sum(p.exists() for p in made) <= 1  # that which the next one is made from
        return f"file://{made[-1]}"

    monkeypatch.setattr(centroids, "shared_dir", named)
    pairs = [(k, [random.Random(k).gauss(0, 1) for _ in range(4)]) for k in range(80)]
    centroids.cluster_vectors(vectors_of(spark, pairs), dims=4, k=4).collect()
    assert len(made) > 3 and [p.exists() for p in made] == [False] * (len(made) - 1) + [True]
