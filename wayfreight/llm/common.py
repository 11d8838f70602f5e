"""What the operators of this subpackage share: tables, splits, cut lineage, byte-level tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfreight.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder: later jobs read it, whatever happens to executors."""
    at = shared_dir(df.sparkSession, purpose)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def in_fold(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false where the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


#: So many ids may go to every task as they are; of more, a filter goes there and tells which rows may be meant.
MOST_BROADCAST_IDS = 1 << 18


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs, all their columns as they are, whose id is not among ``ids``.

    Rows without an id cannot be named and stay. Few ids are broadcast, and no row moves. Where there are more, a filter of them is, and
    docs are read twice: rows whose id cannot be among them stay where they are, only the others shuffle.
    """
    gone = ids.select(F.col(id_col).alias("__gone_id")).distinct()
    if gone.count() <= MOST_BROADCAST_IDS:
        return docs.join(F.broadcast(gone), docs[id_col] == gone["__gone_id"], "left_anti")
    unsure, certain = split_among(docs, id_col, gone, "__gone_id")
    return certain.unionByName(unsure.join(gone.hint("merge"), unsure[id_col] == gone["__gone_id"], "left_anti"))


def by_row(
    docs: DataFrame, id_col: str, drop: Callable[[DataFrame, str], DataFrame], nulls_last: bool = False
) -> DataFrame:
    """What ``drop(rows, id_col)`` keeps of docs, with each row decided by itself, whatever its id.

    Operators name rows by id. Where every row has an id of its own, nothing is added to that but one
    pass over the ids. Otherwise the rows are stored with a number of their own in the order of the
    ids, rows without an id first (or last), and ``drop`` goes by that; this shuffles the texts once.
    """
    ids = docs.select(docs[id_col].cast("bigint").alias("id")).groupBy("id").count()
    if not ids.filter("id IS NULL OR count > 1").count():
        return drop(docs, id_col)
    return drop(numbered(docs, id_col, nulls_last), "__row").select(*docs.columns)


def numbered(docs: DataFrame, id_col: str, nulls_last: bool) -> DataFrame:
    """The rows, stored, with a number of their own in ``__row``, in the order of the ids."""
    # Numbered before the sort as well: equal ids, and equal rows, spread over tasks and never tie.
    kept = stored(docs.withColumn("__place", F.monotonically_increasing_id()), "rows-placed")
    order = F.col(id_col).cast("bigint")
    placed = kept.sort(order.asc_nulls_last() if nulls_last else order.asc_nulls_first(), "__place")
    return stored(placed.withColumn("__row", F.monotonically_increasing_id()), "rows-numbered")


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text under fixed names, so that no other column can clash."""
    return docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))


def sliced(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of text; one longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + most_bytes, side="right")) - 1
            stop = max(start + 1, min(stop, batch.num_rows))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and n + 1 offsets. A null text is empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


#: Bytes that separate words: blank, and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RADIX = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits (a bijection)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    filled, step = 1, base
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(step)
        filled += more
        step = step * step % 2**64
    return out[:n]


_CACHE: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    """A table of powers that grows by doubling and is kept while it is small."""
    if name not in _CACHE or len(_CACHE[name]) < n:
        table = _powers(base, 1 << max(16, int(n - 1).bit_length()))
        if n > 1 << 24:
            return table
        _CACHE[name] = table
    return _CACHE[name]


def words_of(data: np.ndarray, ends: np.ndarray, word_byte: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of ``word_byte`` inside one text), and n + 1 word offsets per text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    inside = word_byte[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = ends[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, ends)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, lower-cased, wherever it stands: a polynomial of byte codes, mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    inverse = pow(_RADIX, -1, 2**64)
    codes = _BYTE[LOWER]
    at = 0
    while at < len(starts):  # in pieces of some MB of text, so that prefix sums stay small
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(stops, low + (1 << 20), side="right")))
        high = stops[to - 1]
        sums = np.empty(high - low + 1, np.uint64)
        sums[0] = 0
        np.cumsum(codes[data[low:high]] * _power_table("up", _RADIX, high - low)[: high - low], out=sums[1:])
        first, last = starts[at:to] - low, stops[at:to] - low
        out[at:to] = (sums[last] - sums[first]) * _power_table("down", inverse, high - low)[first]
        out[at:to] += (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        at = to
    return mix(out)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside each text, and n + 1 offsets.

    A text with fewer words, but some, has one shingle: all of them.
    """
    counts = np.diff(offsets)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(made)))
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        rolled += words[j : j + len(rolled)] * _STEPS[j % len(_STEPS)]
    out = np.empty(at[-1], np.uint64)
    long = counts >= size
    reach = np.where(long, counts - size + 1, 0)
    first = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach - offsets[:-1], reach)
    place = np.ones(at[-1], bool)
    short = np.flatnonzero((counts > 0) & ~long)
    place[at[short]] = False
    out[place] = mix(rolled[first] + np.uint64(size))
    if len(short):
        sums = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            there = counts[short] > j
            sums[there] += words[offsets[short][there] + j] * _STEPS[j % len(_STEPS)]
        out[at[short]] = mix(sums + counts[short].astype(np.uint64))
    return out, at


#: Odd factors for the places of a word in a shingle; their order counts.
_STEPS = np.random.default_rng(77).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def pack_integers(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed."""
    import zstandard

    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_integers(raw: bytes, kind) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def sets_of(data: np.ndarray, ends: np.ndarray, size: int, word_byte: np.ndarray = ~SPACE) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``size`` words, as sorted 64-bit hashes."""
    starts, stops, offsets = words_of(data, ends, word_byte)
    shingles, at = shingle_hashes(word_hashes(data, starts, stops), offsets, size)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        one = np.sort(shingles[a:b])
        if len(one) > 1:
            one = one[np.concatenate(([True], one[1:] != one[:-1]))]
        yield one


#: A membership filter has 16 bits a key, but no more than this; broadcast, it has at most a 64th of it in rows.
MOST_FILTER_BITS = 1 << 27


def _slot(key: Column, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits))


def _filter_of(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A Bloom filter of the keys as (word, set_bits) rows, stored, and its bits; ``MOST_FILTER_BITS`` bounds its size."""
    bits = 1 << max(12, min(MOST_FILTER_BITS, 16 * keys.count()).bit_length() - 1)
    slots = keys.select(F.explode(F.array(*[_slot(F.col(key), k, bits) for k in range(2)])).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("set_bits")
    )
    return stored(words, "membership-filter"), bits


def perhaps_among(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose value may be among the keys (all that are, and few others), without a shuffle.

    A Bloom filter of the keys is broadcast as (word, bits) rows; ``MOST_FILTER_BITS`` bounds its size.
    """
    words, bits = _filter_of(keys, key)
    for k in range(2):
        part = words.select(F.col("word").alias(f"__word{k}"), F.col("set_bits").alias(f"__bits{k}"))
        tested = df.withColumn("__slot", _slot(df[column], k, bits))
        hit = F.expr(f"shiftright(__slot, 6) = __word{k} AND (shiftright(__bits{k}, cast(__slot % 64 as int)) & 1L) = 1L")
        df = tested.join(F.broadcast(part), hit, "left_semi").drop("__slot")
    return df


def split_among(df: DataFrame, column: str, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(Rows whose value may be among the keys, rows whose value is not or is null): each row is in one of the two.

    As ``perhaps_among`` without a shuffle; both read df.
    """
    words, bits = _filter_of(keys, key)
    marked, maybe = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[column].alias("value")), F.col("value").isNotNull()
    for k in range(2):
        part = words.select(F.col("word").alias(f"word{k}"), F.col("set_bits").alias(f"bits{k}"))
        slotted = marked.withColumn(f"slot{k}", _slot(F.col("value"), k, bits))
        marked = slotted.join(F.broadcast(part), F.shiftright(f"slot{k}", 6) == F.col(f"word{k}"), "left")
        maybe = maybe & F.coalesce(F.expr(f"(shiftright(bits{k}, cast(slot{k} % 64 as int)) & 1L) = 1L"), F.lit(False))
    return marked.filter(maybe).select("row.*"), marked.filter(~maybe).select("row.*")
