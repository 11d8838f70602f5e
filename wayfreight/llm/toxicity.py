"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfreight.llm.common import LOWER, in_fold, narrow, sliced, stored, text_bytes
from wayfreight.llm.sampling import sample_by_class

ORDERS = (4, 5, 6)
BINS = 1 << 19
#: A feature is an n-gram that a text holds at least so many times; each n-gram has one for each level.
LEVELS = (1, 2, 4)
FEATURES = BINS * len(LEVELS)
PARTS = 12  # in which counts of features travel
#: The model is fitted on a bounded sample of labelled documents.
DOCUMENTS_PER_CLASS = 2000
#: Texts it learns from are so many bytes together, half of them for each class; none is longer than a 32nd of that.
MOST_SAMPLE_BYTES = 24 << 20
#: Log-count ratios within so many standard errors of zero are chance; their n-grams are left out.
LEAST_ERRORS = 3.0
STEPS = 120

_TABLES = np.random.default_rng(11).integers(0, 2**32, (max(ORDERS), 256), dtype=np.uint32)[:, LOWER]


def ngram_bins(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the bin of the n-gram that starts at each byte, and whether it stays inside its text."""
    if not len(data):
        return
    left = np.repeat(ends[1:], np.diff(ends)) - np.arange(len(data))
    h = np.zeros(len(data), np.uint32)
    for n in range(max(ORDERS)):
        h[: len(data) - n] ^= _TABLES[n][data[n:]]
        if n + 1 in ORDERS:
            salted = (h ^ np.uint32((n + 1) * 0x9E3779B1 % 2**32)) * np.uint32(0x85EBCA6B)
            yield (salted >> np.uint32(32 - 19)).astype(np.int32), left > n


def _present(data: np.ndarray, ends: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every n-gram a text holds often enough, once each; only bins that ``wanted`` marks, if given."""
    keys = [np.zeros(0, np.int64)]
    for bins, inside in ngram_bins(data, ends):
        at = np.flatnonzero(inside if wanted is None else inside & wanted[bins])
        text = np.searchsorted(ends, at, side="right") - 1
        keys.append(text.astype(np.int64) * BINS + bins[at])
    unique, times = np.unique(np.concatenate(keys), return_counts=True)
    levels = [unique[times >= least] for least in LEVELS]
    text = np.concatenate([u // BINS for u in levels])
    feature = np.concatenate([u % BINS + k * BINS for k, u in enumerate(levels)])
    order = np.argsort(text, kind="stable")
    return text[order], feature[order]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", 4 << 20):
        data, ends = text_bytes(batch.column("text"))
        text, found = _present(data, ends)
        cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
        held = [found[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(held, pa.binary())], names=["label", "features"])


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of each label have each feature, in PARTS rows of fixed size for each label."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for label, raw in zip(batch.column("label").to_pylist(), batch.column("features")):
            counts = total.setdefault(label, np.zeros(FEATURES, np.int32))
            counts[np.frombuffer(raw.as_buffer(), "<i4")] += 1
    for label, counts in total.items():
        for part, some in enumerate(np.split(counts, PARTS)):
            yield _part_row(label, part, some)


def _part_row(label: int, part: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([label], pa.int32()), pa.array([part], pa.int32()), pa.array([counts.tobytes()], pa.binary())],
        names=["label", "part", "counts"],
    )


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for label, part, raw in zip(*(batch.column(c).to_pylist() for c in ("label", "part", "counts"))):
            total.setdefault((label, part), np.zeros(FEATURES // PARTS, np.int32))
            total[label, part] += np.frombuffer(raw, np.int32)
    for (label, part), counts in total.items():
        yield _part_row(label, part, counts)


def _only(used: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (np.frombuffer(raw.as_buffer(), "<i4") for raw in batch.column("features"))
            kept = [f[used[f]].tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(kept, pa.binary())], names=["label", "features"])

    return run


def log_count_ratios(positive: np.ndarray, negative: np.ndarray, positives: int, negatives: int) -> tuple[np.ndarray, np.ndarray]:
    """The ratio of each feature, smoothed by one, and whether it is beyond chance."""
    ratio = np.log((positive + 1) / (positives + 2)) - np.log((negative + 1) / (negatives + 2))
    return ratio, np.abs(ratio) >= LEAST_ERRORS * np.sqrt(1 / (positive + 1) + 1 / (negative + 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def weigh(examples: list[tuple[int, np.ndarray]], ratio: np.ndarray, used: np.ndarray, share: float) -> dict:
    """Weights by feature and a bias, by logistic regression with a ridge.

    Where a document has a feature, its value is the feature's ratio. Both labels weigh the same in
    the fit; the bias then moves to ``share`` of label 1.
    """
    labels = np.array([y for y, _ in examples], float)
    place = np.cumsum(used) - 1  # of a used feature among the used ones
    features = place[np.concatenate([f for _, f in examples])].astype(np.int32)
    owner = np.repeat(np.arange(len(examples), dtype=np.int32), [len(f) for _, f in examples])
    value = ratio[used][features].astype(np.float32)
    n = int(used.sum())
    weight, bias = np.zeros(n), 0.0
    balance = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    squares_w, squares_b = np.full(n, 1e-8), 1e-8
    for _ in range(STEPS):
        margin = np.bincount(owner, weights=weight[features] * value, minlength=len(labels)) + bias
        error = (_sigmoid(margin) - labels) * balance
        grad = np.bincount(features, weights=error[owner] * value, minlength=n) + 1e-5 * weight
        squares_w += grad * grad
        squares_b += error.sum() ** 2
        weight -= 0.1 * grad / np.sqrt(squares_w)
        bias -= 0.1 * error.sum() / np.sqrt(squares_b)
    weights = np.zeros(FEATURES, np.float32)
    weights[used] = weight * ratio[used]
    return {"weights": weights, "bias": float(bias + np.log(share / (1 - share)))}


def learned_texts(rows: DataFrame, sample: DataFrame, most_bytes: int = MOST_SAMPLE_BYTES) -> DataFrame:
    """(label, text) of the sample's documents, one text for each id, at most ``most_bytes`` together.

    Repeated ids combine map-side, the greatest text stays. Which texts are within the bound goes by a hash
    of the id; that order is made over ids and sizes of the bounded sample only.
    """
    chosen = rows.join(F.broadcast(sample), F.col("id") == F.col("label_id"))
    kept = stored(chosen.groupBy("label_id", "label").agg(F.max("text").alias("text")), "toxicity-sample")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    sizes = kept.select("label_id", "label", size.alias("size")).filter(F.col("size") <= most_bytes // 32)
    order = Window.partitionBy("label").orderBy(F.xxhash64("label_id", F.lit("order")), "label_id")
    within = sizes.withColumn("upto", F.sum("size").over(order)).filter(F.col("upto") <= most_bytes // 2)
    fitting = within.select(F.col("label_id").alias("fitting_id"))
    return kept.join(F.broadcast(fitting), F.col("label_id") == F.col("fitting_id"), "left_semi").select("label", "text").repartition(16)


def fit(chosen: DataFrame, counts: dict) -> dict:
    """A model from rows of label and text; ``counts`` has the rows there are by label.

    Features are stored and counted in Spark, so that only counts of fixed size and the features
    beyond chance come to the driver.
    """
    share = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))
    stored_rows = stored(chosen.mapInArrow(_features, "label int, features binary"), "toxicity-features")
    by_label = dict(stored_rows.groupBy("label").count().collect())
    if not by_label.get(0) or not by_label.get(1):
        odds = np.log(max(share, 1e-4) / max(1 - share, 1e-4))
        return {"weights": np.zeros(FEATURES, np.float32), "bias": float(odds)}
    schema = "label int, part int, counts binary"
    sums = stored_rows.mapInArrow(_count_features, schema).repartition("label", "part").mapInArrow(_add_counts, schema)
    having = np.zeros((2, FEATURES), np.int64)
    for label, part, raw in sums.toLocalIterator():
        having[label, part * (FEATURES // PARTS) : (part + 1) * (FEATURES // PARTS)] = np.frombuffer(raw, np.int32)
    ratio, used = log_count_ratios(having[1], having[0], by_label[1], by_label[0])
    taken = stored_rows.mapInArrow(_only(used), "label int, features binary").toArrow()
    examples = [(y, np.frombuffer(b, "<i4")) for y, b in zip(taken.column(0).to_pylist(), taken.column(1).to_pylist())]
    return weigh(examples, ratio, used, share)


def score_texts(model: dict, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The chance of label 1 for each text, from every n-gram it holds anywhere."""
    wanted = (model["weights"].reshape(len(LEVELS), BINS) != 0).any(axis=0)
    text, bins = _present(data, ends, wanted)
    margin = np.bincount(text, weights=model["weights"][bins], minlength=len(ends) - 1) + model["bias"]
    return _sigmoid(margin)


def _score_batches(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 4 << 20):
            score = score_texts(model, *text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    modulus: int = 5,
    remainder: int = 0,
) -> DataFrame:
    """doc_id, held_out, score and predicted (score of 0.5 or more) of every whole text.

    Labels are learned only from rows whose crc32 of the id does not leave ``remainder``. The sample of
    labels is bounded by ``DOCUMENTS_PER_CLASS`` a class and goes to the documents by broadcast; whole
    texts of the sample are learned from, within ``MOST_SAMPLE_BYTES``, which also bounds the driver's memory.

    Defined cases: null and empty texts get the score of a text without n-grams; a null label is no
    label, of several labels of one id the largest counts, of several texts of one id the greatest is
    learned from; without labels of both classes every text
    gets the share of label 1; a null id is not held out; repeated rows repeat; an empty table stays
    empty; other columns are not looked at.
    """
    rows = narrow(docs, id_col, text_col).withColumn("held_out", in_fold("id", modulus, remainder))
    known = labels.select(labels[id_col].cast("bigint").alias("label_id"), labels[label_col].cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~in_fold("label_id", modulus, remainder))
    known = known.groupBy("label_id").agg(F.max("label").alias("label"))
    sample, counts = sample_by_class(known, "label", F.col("label_id"), DOCUMENTS_PER_CLASS)
    model = fit(learned_texts(rows, sample), counts)
    return rows.mapInArrow(_score_batches(model), "doc_id bigint, held_out boolean, score double, predicted int")
