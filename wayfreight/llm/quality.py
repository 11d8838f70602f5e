"""Quality: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfreight.llm.common import by_row, in_fold, narrow, sliced, stored, text_bytes, without, word_hashes, words_of

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "longest_word", "letters", "capitals", "digits", "blanks",
    "stops", "commas", "exclamations", "bars", "other_signs", "signs_per_word", "repeats_last", "repeats_second", "distinct_in_chunk",
    "words_per_line", "byte_entropy",
)
FEATURES = 256
RIDGE = 0.5
BINS = 4096
LOW, HIGH = -0.5, 1.5  # range of ridge scores that the bins of the calibration cover
CHUNK = 64  # words among which distinct ones are counted
THRESHOLD = 0.3

_CLASS = np.full(256, 7, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_CLASS[48:58] = 1
_CLASS[[0x20, *range(0x09, 0x0E)]] = 2
_CLASS[ord(".")] = 3
_CLASS[ord(",")] = 4
_CLASS[ord("!")] = 5
_CLASS[ord("|")] = 6


def statistics(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(text, statistic) over whole texts; all are zero for an empty text."""
    n = len(ends) - 1
    size = np.diff(ends).astype(float)
    at_least = np.maximum(size, 1)
    owner = np.repeat(np.arange(n), np.diff(ends))
    histogram = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    share = np.stack([histogram[:, _CLASS == k].sum(axis=1) for k in range(8)]) / at_least
    capitals = histogram[:, 65:91].sum(axis=1) / at_least
    p = histogram / at_least[:, None]
    entropy = -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(axis=1)

    starts, stops, offsets = words_of(data, ends)
    words = np.diff(offsets).astype(float)
    some = np.maximum(words, 1)
    of = np.repeat(np.arange(n), np.diff(offsets))
    length = (stops - starts).astype(float)
    mean = np.bincount(of, weights=length, minlength=n) / some
    spread = np.sqrt(np.maximum(np.bincount(of, weights=length**2, minlength=n) / some - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    hashes = word_hashes(data, starts, stops)

    def repeats(k):
        same = (hashes[k:] == hashes[:-k]) & (of[k:] == of[:-k]) if len(hashes) > k else np.zeros(0, bool)
        return np.bincount(of[k:][same], minlength=n) / some

    chunk = (np.arange(len(of)) - offsets[:-1][of]) // CHUNK
    order = np.lexsort((hashes, chunk, of))
    fresh = np.ones(len(of), bool)
    if len(of):
        a, b = order[1:], order[:-1]
        fresh[1:] = (hashes[a] != hashes[b]) | (chunk[a] != chunk[b]) | (of[a] != of[b])
    distinct = np.bincount(of[order][fresh], minlength=n) / some
    lines = histogram[:, 10] + (size > 0)
    signs = (share[3:].sum(axis=0) * at_least) / some
    table = np.stack([
        np.log1p(size), np.log1p(words), mean, spread, np.log1p(longest), share[0], capitals, share[1], share[2],
        share[3], share[4], share[5], share[6], share[7], np.log1p(signs), repeats(1), repeats(2), distinct,
        np.log1p(words / np.maximum(lines, 1)), entropy,
    ], axis=1)
    return np.where(size[:, None] > 0, table, 0.0)


def _statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", 4 << 20):
        table = statistics(*text_bytes(batch.column("text")))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(table.reshape(-1)), len(STATISTICS)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), flat], names=["doc_id", "held_out", "stats"])


def document_statistics(docs: DataFrame, id_col: str, text_col: str, modulus: int, remainder: int) -> DataFrame:
    """doc_id, held_out and the statistics, in the order of STATISTICS, of every whole text."""
    rows = narrow(docs, id_col, text_col).withColumn("held_out", in_fold("id", modulus, remainder))
    return rows.mapInArrow(_statistics_batches, "doc_id bigint, held_out boolean, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


class FourierMap:
    """cos(w x + b) of standardised statistics: products approximate a Gaussian kernel of width sqrt(dimensions)."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.directions = rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), FEATURES))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -8, 8)
        made = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / FEATURES)
        return np.concatenate([made, np.ones((len(x), 1))], axis=1)


def _sum_batches(features: FourierMap):
    """Per partition the sums of the normal equations: row i holds sum f_i f_j for all j, then sum f_i y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            f = features(_matrix(batch.column("stats")))
            y = batch.column("label").to_numpy().astype(float)
            total[:, :-1] += f.T @ f
            total[:, -1] += f.T @ y
        i, j = np.nonzero(total)
        if len(i):
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"]
            )

    return run


def isotonic(positive: np.ndarray, every: np.ndarray) -> np.ndarray:
    """The non-decreasing shares nearest to positive / every by bin (pool adjacent violators); gaps take the share below."""
    blocks: list[list[float]] = []
    for k in np.flatnonzero(every):
        blocks.append([positive[k], every[k], k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, n, _ = blocks.pop()
            blocks[-1][0] += p
            blocks[-1][1] += n
    out = np.full(len(every), blocks[0][0] / blocks[0][1] if blocks else 0.5)
    for p, n, k in blocks:
        out[int(k) :] = p / n
    return out


def _bin(score: np.ndarray) -> np.ndarray:
    return np.clip((score - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)


def _bin_batches(features: FourierMap, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = features(_matrix(batch.column("stats"))) @ weights
            yield pa.RecordBatch.from_arrays([pa.array(_bin(score)), batch.column("label")], names=["bin", "label"])

    return run


def _score_batches(features: FourierMap, weights: np.ndarray, shares: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shares[_bin(features(_matrix(batch.column("stats"))) @ weights)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    modulus: int = 5,
    remainder: int = 0,
) -> DataFrame:
    """doc_id, held_out, score and predicted (score of 0.3 or more) of every whole text.

    One pass over the texts stores their statistics; everything after works on those narrow rows.
    Every labelled row whose crc32 of the id does not leave ``remainder`` is learned from: each
    partition sums its part of the normal equations, Spark adds the sums by cell, and the driver
    solves a system of fixed size. The same rows, binned by ridge score, are calibrated so that the
    final score is a share between 0 and 1 that never falls as the ridge score rises.

    Defined cases: null and empty texts have statistics of zero and are scored like others; a null
    label is no label, of several labels of one id the largest counts; without labels every score is
    0.5; a null id is not held out; repeated rows repeat; an empty table stays empty; other columns are
    not looked at.
    """
    stats = stored(document_statistics(docs, id_col, text_col, modulus, remainder), "quality-statistics")
    known = labels.select(labels[id_col].cast("bigint").alias("label_id"), labels[label_col].cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~in_fold("label_id", modulus, remainder))
    known = known.groupBy("label_id").agg(F.max("label").alias("label"))
    learned = stored(stats.join(known, F.col("doc_id") == F.col("label_id")).select("stats", "label"), "quality-labelled")

    moments = [f(F.col("stats")[k]) for k in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]
    found = np.array([np.nan if v is None else v for v in learned.agg(*moments).first()], float).reshape(-1, 2)
    if np.isnan(found).any():
        return stats.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    features = FourierMap(found[:, 0], found[:, 1])
    cells = learned.mapInArrow(_sum_batches(features), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((FEATURES + 1, FEATURES + 2))
    for i, j, v in cells.collect():  # as many cells as the feature map has, whatever the input
        total[i, j] = v
    ridge = RIDGE * np.eye(FEATURES + 1)
    ridge[-1, -1] = 0
    weights = np.linalg.solve(total[:, :-1] + ridge, total[:, -1])

    binned = learned.mapInArrow(_bin_batches(features, weights), "bin int, label int").groupBy("bin")
    positive, every = np.zeros(BINS), np.zeros(BINS)
    for k, p, n in binned.agg(F.sum("label"), F.count(F.lit(1))).collect():
        positive[k], every[k] = p, n
    shares = isotonic(positive, every)
    return stats.mapInArrow(
        _score_batches(features, weights, shares), "doc_id bigint, held_out boolean, score double, predicted int"
    )


def drop_poor(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", each_row: bool = False
) -> DataFrame:
    """The documents that the classifier accepts, all columns as they are. Only rejected ids meet the texts again.

    With ``each_row`` rows whose id is null or repeats go or stay by their own texts; what is learned is the same.
    """

    def by_number(rows: DataFrame, row: str) -> DataFrame:
        if row == id_col:
            return drop_poor(rows, labels, id_col, text_col)
        known = labels.select(labels[id_col].cast("bigint").alias("known_id"), labels["quality"])
        known = known.filter(~in_fold("known_id", 5, 0))
        of_rows = rows.select(rows[row], rows[id_col].cast("bigint").alias("id")).join(known, F.col("id") == F.col("known_id"))
        # The fold is left out above, by the ids; by row numbers nothing is held out.
        return _drop_scored(rows, score_quality(rows, of_rows, row, text_col, modulus=1, remainder=1), row)

    if each_row:
        return by_row(docs, id_col, by_number)
    return _drop_scored(docs, score_quality(docs, labels, id_col, text_col), id_col)


def _drop_scored(docs: DataFrame, scores: DataFrame, id_col: str) -> DataFrame:
    poor = stored(scores.filter("predicted = 0").select(F.col("doc_id").alias(id_col)), "quality-rejected")
    return without(docs, poor, id_col)
