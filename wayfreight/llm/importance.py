"""Importance resampling: documents are drawn in favour of those whose n-grams are frequent in a target corpus.

A feature is a run of consecutive words, hashed by CRC-32 into one of a fixed number of buckets. Its
text is never built. Each document is scanned once in its normal form (lower case, words joined by one
space), which gives the running CRC at the end of every word. The CRC of any run follows from two of
these: the state before the run is shifted over the bytes of the run, which is a linear map over
GF(2), and cancels out of the state at its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfreight.llm.common import narrow, sliced, stored

#: Digits, ASCII letters and every byte of a character beyond ASCII are word bytes, upper case becomes lower, the rest blank.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
PIECE_BYTES = 1 << 20  # a longer text is split into words piece by piece; the running CRC goes on
SHORT = 64  # runs below so many bytes have a shift table of their own
POLYNOMIAL = 0xEDB88320  # of CRC-32, bits reversed


# --- CRC arithmetic --------------------------------------------------------------------------------


@lru_cache(1)
def _byte_table() -> np.ndarray:
    """What one byte of the register becomes when it has been shifted out."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


def _zero_byte(state: np.ndarray) -> np.ndarray:
    """The linear map that appends one zero byte."""
    return _byte_table()[state & np.uint32(255)] ^ (state >> np.uint32(8))


def _four_tables(columns: np.ndarray) -> np.ndarray:
    """A linear map, given what it makes of each of the 32 bits, as a table for each byte of its argument."""
    byte = np.arange(256)
    tables = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            tables[k] ^= np.where(byte >> bit & 1, columns[8 * k + bit], 0).astype(np.uint32)
    return tables


def _apply(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    out = tables[0][state & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ tables[k][state >> np.uint32(8 * k) & np.uint32(255)]
    return out


@lru_cache(1)
def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables of the shifts over 0 ... SHORT - 1 bytes, and over 1, 2, 4, ... 2**40 bytes."""
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    short = []
    for _ in range(SHORT):
        short.append(_four_tables(columns))
        columns = _zero_byte(columns)
    powers = [short[1]]
    for _ in range(40):
        basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
        powers.append(_four_tables(_apply(powers[-1], _apply(powers[-1], basis))))
    return np.stack(short), powers


def shifted(state: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each CRC contributes to the CRC of its text followed by so many further bytes."""
    short, powers = _shifts()
    few = n_bytes < SHORT
    row = np.where(few, n_bytes, 0)
    out = short[row, 0, state & np.uint32(255)]
    for k in range(1, 4):
        out ^= short[row, k, state >> np.uint32(8 * k) & np.uint32(255)]
    at = np.flatnonzero(~few)
    far, left, bit = state[at], n_bytes[at], 0
    while left.any():
        odd = (left & 1).astype(bool)
        far[odd] = _apply(powers[bit], far[odd])
        left, bit = left >> 1, bit + 1
    out[at] = far
    return out


def _after_blank(state: np.ndarray) -> np.ndarray:
    """Running CRCs after one more blank."""
    inner = ~state
    return ~(_byte_table()[(inner ^ np.uint32(32)) & np.uint32(255)] ^ (inner >> np.uint32(8)))


# --- features of one text --------------------------------------------------------------------------


def _pieces(normal: bytes) -> Iterator[bytes]:
    start = 0
    while len(normal) - start > PIECE_BYTES:
        cut = normal.find(b" ", start + PIECE_BYTES)
        if cut < 0:
            break
        yield normal[start:cut]
        start = cut
    yield normal[start:]


def prefix_crcs(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The running CRC at the end of each word of the normal form, and how many bytes the words have."""
    crcs, lengths, state, first = [], [], 0, True
    for piece in _pieces(text.translate(NORMAL)):
        words = piece.split()
        ends = []
        for word in words:
            state = crc32(word, state if first else crc32(b" ", state))
            first = False
            ends.append(state)
        crcs.append(np.array(ends, np.uint32))
        lengths.append(np.fromiter(map(len, words), np.int64, len(words)))
    return np.concatenate(crcs), np.concatenate(lengths)


def run_crcs(ends: np.ndarray, lengths: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The CRCs of all runs of ``n`` words inside each text, from running CRCs; and their number by text.

    ``offsets`` says where each text's words start.
    """
    counts = np.diff(offsets)
    made = np.maximum(counts - n + 1, 0)
    total = int(made.sum())
    if not total:
        return np.zeros(0, np.uint32), made
    first = np.arange(total) - np.repeat(np.cumsum(made) - made - offsets[:-1], made)
    before = np.zeros(len(ends), np.uint32)
    before[1:] = _after_blank(ends[:-1])
    before[offsets[:-1][counts > 0]] = 0  # nothing stands before a text's first word
    reach = np.concatenate(([0], np.cumsum(lengths)))
    n_bytes = reach[first + n] - reach[first] + n - 1
    return ends[first + n - 1] ^ shifted(before[first], n_bytes), made


def _feature_batches(least: int, most: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 4 << 20):
            texts = [prefix_crcs((t.as_py() or "").encode()) for t in batch.column("text")]
            ends = np.concatenate([t[0] for t in texts])
            lengths = np.concatenate([t[1] for t in texts])
            words = np.array([len(t[0]) for t in texts], np.int64)
            offsets = np.concatenate(([0], np.cumsum(words)))
            owners, found = [], []
            for n in range(least, most + 1):
                crcs, made = run_crcs(ends, lengths, offsets, n)
                owners.append(np.repeat(np.arange(len(texts)), made))
                found.append((crcs % np.uint32(buckets)).astype(np.int32))
            owner, bucket = np.concatenate(owners), np.concatenate(found)
            if most > least:
                bucket = bucket[np.argsort(owner, kind="stable")]
            at = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(words), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bucket))],
                names=["id", "words", "features"],
            )

    return run


def bucketed(docs: DataFrame, id_col: str, text_col: str, least: int, most: int, buckets: int) -> DataFrame:
    """id, number of words, and the bucket of every feature of every text. No shuffle."""
    rows = narrow(docs, id_col, text_col)
    return rows.mapInArrow(_feature_batches(least, most, buckets), "id bigint, words bigint, features array<int>")


# --- weights ---------------------------------------------------------------------------------------


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket has. A task sends at most one row for each bucket; their sums are all that comes here."""
    counts = np.zeros(buckets, np.int64)
    found = features.select(F.explode("features").alias("bucket")).groupBy("bucket").count()
    for bucket, n in found.collect():  # at most ``buckets`` rows
        counts[bucket] = n
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed bucket frequencies, target over corpus, rounded down."""
    buckets = len(corpus)
    ratio = (target + 1.0) * (corpus.sum() + float(buckets)) / ((corpus + 1.0) * (target.sum() + float(buckets)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weight_batches(gains: np.ndarray):
    """The mean gain of each document's features, rounded down; 0 without features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            at = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy()[at[0] : at[-1]]
            sums = np.concatenate(([0], np.cumsum(gains[values])))
            total, n = np.diff(sums[at - at[0]]), np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("words"), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))],
                names=["doc_id", "words", "n_features", "weight"],
            )

    return run


def gumbel(seed: int) -> Column:
    """Standard Gumbel noise in thousandths, rounded down, from the digest of seed and doc_id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


# --- the draw --------------------------------------------------------------------------------------


def lowest_drawn(eligible: DataFrame, k: int) -> int | None:
    """The largest score that at least ``k`` rows reach; None if none is to be drawn.

    Scores are whole thousandths within a range that the logarithms bound, some 100,000 values at most,
    so their counts may come to the driver however many rows there are.
    """
    if not k:
        return None
    reached = 0
    for score, n in sorted(eligible.groupBy("score").count().collect(), reverse=True):
        reached += n
        if reached >= k:
            return score
    return None


def ranked(spark: SparkSession, candidates: DataFrame, k: int) -> DataFrame:
    """The k best rows by (score, smaller doc_id) with their places from 1, in ``rank``; the others have none.

    One sort of narrow rows; a place is a row's number in its partition plus the rows of the partitions
    before, of which there is one figure each.
    """
    order = candidates.orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    placed = stored(
        order.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "importance-placed"
    )
    parts = placed.groupBy("part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    starts, before = [], 0
    for part, first, n in sorted(parts):
        starts.append((part, before - first))
        before += n
    starts = spark.createDataFrame(starts, "start_part int, shift bigint")
    # One row for each partition of the sort.
    met = placed.join(F.broadcast(starts), F.col("part") == F.col("start_part"))
    rank = F.col("at") + F.col("shift") + 1
    return met.withColumn("rank", F.when(rank <= k, rank)).drop("part", "at", "start_part", "shift")


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    least: int = 1,
    most: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    min_words: int = 20,
    seed: int = 2024,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; ``percent`` of the eligible ones are drawn.

    Words are runs of digits, letters and characters beyond ASCII, with A-Z lower-cased; features are all
    runs of ``least`` to ``most`` words. A bucket's gain is the log ratio of its smoothed frequencies in
    the target and in the corpus; a document's weight is the mean of its gains, and its score adds
    Gumbel noise, so that the highest scores are a draw without replacement by weight. Of the documents
    with at least ``min_words`` words that share is drawn, ties to the smaller doc_id; ``rank`` is the
    place among them and null for the others. Gains, weights and noise are thousandths, rounded down.

    The texts are read once; their buckets are stored and give counts first and weights then. The
    corpus counts cover all documents. Only scores shuffle: counted by value, and sorted from the
    lowest drawn score up.

    Defined cases: null texts and texts without words have no features and weight 0. A null id takes
    its noise from the empty text and comes last among ties; rows that repeat an id share its noise, and
    rows equal in id and score take the places in question in any order. An empty target has gains that
    fall with frequency in the corpus; an empty table gives an empty result. Other columns are not
    looked at.
    """
    spark = docs.sparkSession
    features = stored(bucketed(docs, id_col, text_col, least, most, buckets), "importance-features")
    wanted = bucketed(target.withColumn("__none", F.lit(0)), "__none", target_text_col, least, most, buckets)
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets))
    weights = features.mapInArrow(_weight_batches(gains), "doc_id bigint, words bigint, n_features bigint, weight bigint")
    scored = stored(weights.withColumn("score", F.col("weight") + gumbel(seed)), "importance-scores")

    eligible = scored.filter(F.col("words") >= min_words)
    k = percent * eligible.count() // 100
    lowest = lowest_drawn(eligible, k)
    columns = ["doc_id", "n_features", "weight", "score"]
    unranked = scored.withColumn("rank", F.lit(None).cast("bigint"))
    if lowest is None:
        return unranked.select(*columns, "rank")
    candidate = (F.col("words") >= min_words) & (F.col("score") >= lowest)
    drawn = ranked(spark, scored.filter(candidate), k)
    return drawn.select(*columns, "rank").unionByName(unranked.filter(~candidate).select(*columns, "rank"))
