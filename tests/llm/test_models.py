from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from odd_rows import documents, nothing, tricky  # noqa: F401

from wayfreight.llm import langid, lm, quality, sampling, toxicity
from wayfreight.llm.common import UPPER, sliced

LOWERED = str.maketrans(UPPER, UPPER.lower())


def remainder(doc_id, modulus):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


# --- language model ---------------------------------------------------------------------------------


def brute_scores(pairs):
    tokens = [re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWERED)) + [None] for _, t in pairs]
    held = [remainder(i, 7) == 2 for i, _ in pairs]
    one, two = Counter(), Counter()
    for h, ts in zip(held, tokens):
        if not h:
            one.update(ts)
            two.update(zip(["begin", *ts[:-1]], ts))
    n, v, begins = sum(one.values()), len(one), held.count(False)
    unigrams = lm.Unigrams(n, v, sum(c == 1 for c in one.values()), sum(c == 2 for c in one.values()))
    p = lambda w: float(unigrams.probability(np.array([one[w]]))[0])
    out = []
    for (i, _), h, ts in zip(pairs, held, tokens):
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ts)
        score = 0.0
        for k, w in enumerate(ts):  # the automaton step by step: an arc, or the failure arc and the root's
            history = (begins if k == 0 else one[ts[k - 1]], two["begin" if k == 0 else ts[k - 1], w])
            if history[1]:
                score += math.log10((history[1] + lm.STRENGTH * p(w)) / (history[0] + lm.STRENGTH))
            else:
                score += math.log10(lm.STRENGTH / (history[0] + lm.STRENGTH)) + math.log10(p(w))
        out.append((i, h, len(ts), sum(one[w] > 0 for w in ts), n, base, score))
    return out


@pytest.mark.parametrize("block_bytes", [4 << 20, 3000])
def test_scores_equal_brute_force(tricky, documents, monkeypatch, block_bytes):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(lm, "RANGE_ENTRIES", 1 << 10)
    for docs in (tricky, documents):
        pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        found = sorted((tuple(r) for r in lm.score_texts(docs).collect()), key=str)
        expected = sorted(brute_scores(pairs), key=str)
        assert [f[:5] for f in found] == [e[:5] for e in expected]
        assert np.allclose([f[5:] for f in found], [e[5:] for e in expected])


def test_each_history_adds_up_to_one():
    counts = np.array([5.0, 3.0, 1.0, 1.0])
    unigrams = lm.Unigrams(10, 4, 2, 0)
    pair = np.array([2.0, 0.0, 1.0, 0.0])  # followers of word 0, which stands twice before the end of nothing else
    p = np.append(unigrams.probability(counts), unigrams.probability(np.zeros(1)))
    assert p.sum() == pytest.approx(1)
    total = (np.append(pair, 0) + lm.STRENGTH * p) / (pair.sum() + lm.STRENGTH)
    assert total.sum() == pytest.approx(1)


def test_nothing_to_learn_from(spark, nothing):
    assert lm.score_texts(nothing).count() == 0
    held = next(i for i in range(100) if remainder(i, 7) == 2)
    only = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    assert rows(lm.score_texts(only)) == [(held, True, 3, 0, 0, 0.0, 0.0)]


def test_held_out_texts_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in lm.score_texts(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_packing_gives_back():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000, dtype=np.uint64))
    assert (lm._unpack_sorted(lm._pack_sorted(keys)) == keys).all()
    assert len(lm._unpack(lm._pack(np.zeros(0, np.uint32)), np.uint32)) == 0


# --- classifiers ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")


def held_accuracy(scored, truth, column):
    found = [r for r in scored.join(truth, "doc_id").collect() if r.held_out]
    return sum(r[column] == r["truth"] for r in found) / len(found)


def test_quality_of_held_out_rows(table):
    scored = quality.score_quality(table("documents"), table("labels"))
    assert held_accuracy(scored, table("labels").withColumnRenamed("quality", "truth").select("doc_id", "truth"), "predicted") > 0.95


def test_toxicity_learns_within_its_bytes(spark):
    """Very long texts and an id that repeats take no more than their share, and no class loses its texts to them."""
    rows_ = [(i, ("good " if i % 2 else "vile ") * (200_000 if i % 50 == 0 else 20)) for i in range(400)] + [(7, "zzz" + "x" * k) for k in range(3000)]
    docs = spark.createDataFrame(rows_, "id long, text string").repartition(8)
    sample = spark.createDataFrame([(i, i % 2) for i in range(400)], "label_id long, label int")
    for most in (1 << 20, 20_000):
        taken = toxicity.learned_texts(docs, sample, most).collect()
        assert max(len(r.text) for r in taken) <= most // 32
        for label in (0, 1):
            assert 0 < sum(len(r.text) for r in taken if r.label == label) <= most // 2
    assert sum(len(r.text) == 100 for r in toxicity.learned_texts(docs, sample, 1 << 20).collect()) == 400 - 8 - 1
    whole = toxicity.learned_texts(docs, sample, 1 << 28).collect()
    assert len(whole) == 400 and [r.text for r in whole if r.text.startswith("z")] == ["zzz" + "x" * 2999]


def test_log_count_ratios_and_weights_equal_a_plain_fit():
    rng = np.random.default_rng(5)
    texts = [[int(f) for f in rng.choice(12, 4, replace=False)] for _ in range(60)]
    examples = [(int(3 in t or (7 in t and rng.random() < 0.7)), np.array(sorted(t), "<i4")) for t in texts]
    having = np.zeros((2, 12), int)
    for y, found in examples:
        having[y, found] += 1
    positives = sum(y for y, _ in examples)
    ratio, used = toxicity.log_count_ratios(having[1], having[0], positives, len(examples) - positives)
    for f in range(12):
        a, b = having[1, f] + 1, having[0, f] + 1
        assert math.isclose(ratio[f], math.log(a / (positives + 2)) - math.log(b / (len(examples) - positives + 2)))
        assert used[f] == (abs(ratio[f]) >= toxicity.LEAST_ERRORS * math.sqrt(1 / a + 1 / b))
    used[:] = True
    wide, mark = np.zeros(toxicity.FEATURES), np.zeros(toxicity.FEATURES, bool)
    wide[:12], mark[:12] = ratio, used
    model = toxicity.weigh(examples, wide, mark, 0.25)
    # The same descent on dense rows, one example at a time.
    w, b, sw, sb = [0.0] * 12, 0.0, [1e-8] * 12, 1e-8
    for _ in range(toxicity.STEPS):
        gw, gb = [1e-5 * x for x in w], 0.0
        for y, found in examples:
            z = b + sum(w[f] * float(np.float32(ratio[f])) for f in found)
            e = (1 / (1 + math.exp(-z)) - y) * (0.5 / positives if y else 0.5 / (len(examples) - positives))
            gb += e
            for f in found:
                gw[f] += e * float(np.float32(ratio[f]))
        sb += gb * gb
        b -= 0.1 * gb / math.sqrt(sb)
        for f in range(12):
            sw[f] += gw[f] ** 2
            w[f] -= 0.1 * gw[f] / math.sqrt(sw[f])
    assert np.allclose(model["weights"][:12], [w[f] * ratio[f] for f in range(12)], rtol=1e-4, atol=1e-6)
    assert math.isclose(model["bias"], b + math.log(0.25 / 0.75), rel_tol=1e-6)


def test_a_sample_gives_no_key_more_than_one_row(spark):
    hot = [(7, "a", str(k)) for k in range(5000)] + [(i, "ab"[i % 2], "t") for i in range(300)]
    frame = spark.createDataFrame(hot, "id long, lang string, text string").repartition(8)
    found, counts = sampling.sample_by_class(frame, "lang", frame.id, 10_000)
    assert counts == {"a": 5150, "b": 150}
    assert sorted((r.id, r.lang) for r in found.collect()) == sorted({(i, lang) for i, lang, _ in hot})


def test_toxicity_of_held_out_rows(table):
    scored = toxicity.score_toxicity(table("documents"), table("labels"))
    assert held_accuracy(scored, table("labels").withColumnRenamed("toxic", "truth").select("doc_id", "truth"), "predicted") > 0.9


def test_language_of_held_out_rows(table):
    docs = table("documents")
    scored = langid.identify_language(docs)
    assert held_accuracy(scored, docs.withColumnRenamed("lang", "truth").select("doc_id", "truth"), "lang_pred") > 0.97


@pytest.mark.parametrize(("score", "modulus", "out", "least"), [
    (quality.score_quality, 5, 0, quality.THRESHOLD),
    (toxicity.score_toxicity, 5, 0, 0.5),
])
def test_odd_rows_are_scored(spark, tricky, nothing, score, modulus, out, least):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 1, 1), (4, 0, 0), (6, 0, 1), (9, 1, 0), (9, 0, 1), (None, 1, 1), (11, None, None), (99, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    for known in (labels, labels.limit(0)):
        found = score(tricky, known).collect()
        assert len(found) == tricky.count()
        for r in found:
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
            assert r.held_out == (remainder(r.doc_id, modulus) == out)
    assert score(nothing, labels).count() == 0


def test_labels_do_not_leak(spark, documents):
    """Held-out labels can be anything."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.selectExpr("doc_id", "IF(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) AS quality",
                               "IF(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    for score in (quality.score_quality, toxicity.score_toxicity):
        a, b = (np.array([r.score for r in score(documents, x).orderBy("doc_id").collect()]) for x in (labels, turned))
        assert np.allclose(a, b)


def test_poor_documents_go(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    left = quality.drop_poor(documents, labels)
    assert left.columns == documents.columns
    poor = {r.doc_id for r in quality.score_quality(documents, labels).filter("predicted = 0").collect()}
    assert {r.doc_id for r in documents.select("doc_id").collect()} - poor == {r.doc_id for r in left.select("doc_id").collect()}


def test_language_of_odd_rows(tricky, nothing):
    found = langid.identify_language(tricky).collect()
    assert len(found) == tricky.count()
    for r in found:
        assert r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1
    by_id = {r.doc_id: r.lang_pred for r in found}
    assert by_id[3] == by_id[4] == by_id[5] == "und" and by_id[1] == "en"
    assert langid.identify_language(nothing).count() == 0


def test_isotonic_never_falls():
    rng = np.random.default_rng(0)
    every = rng.integers(0, 5, 200)
    positive = rng.binomial(every, np.linspace(0.1, 0.9, 200))
    shares = quality.isotonic(positive.astype(float), every.astype(float))
    assert (np.diff(shares) >= 0).all() and shares.min() >= 0 and shares.max() <= 1
    assert (shares[np.flatnonzero(every)] * every[every > 0]).sum() == pytest.approx(positive.sum())


def test_features_approximate_a_gaussian_kernel():
    x = np.random.default_rng(1).normal(size=(40, len(quality.STATISTICS)))
    f = quality.FourierMap(np.zeros(x.shape[1]), np.ones(x.shape[1]))(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 2 / x.shape[1])
    assert np.abs(f @ f.T - exact).max() < 0.35


def test_counted_ngrams_equal_a_dictionary():
    texts = ["Abcdefg abcdefg", "", "xyz", "ääää ääää"]
    raw = [t.encode() for t in texts]
    ends = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    text, feature = toxicity._present(np.frombuffer(b"".join(raw), np.uint8), ends)
    for k, r in enumerate(raw):
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in r)
        grams = Counter(low[a : a + n] for n in toxicity.ORDERS for a in range(len(low) - n + 1))
        assert (text == k).sum() == sum(c >= least for c in grams.values() for least in toxicity.LEVELS)


def test_convolution_gradient():
    """Training lowers the loss on bytes that a filter can tell apart."""
    rng = np.random.default_rng(0)
    windows = np.zeros((200, langid.WINDOW + 3), np.uint8)
    windows[:, : langid.WINDOW] = rng.integers(97, 110, (200, langid.WINDOW))
    labels = np.arange(200) % 2
    windows[labels == 1, 50:53] = (120, 121, 122)
    model = langid.train(windows, labels, 2, epochs=15)
    assert (langid.forward(model, windows).argmax(axis=1) == labels).mean() > 0.95


def test_slices_hold_all_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (0, 5, 100, 1, 0, 0, 30)], "k": list(range(7))})
    for most in (1, 10, 1000):
        assert [k for b in sliced(iter([batch]), "text", most) for k in b["k"].to_pylist()] == list(range(7))
