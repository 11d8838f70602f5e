"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, weighted shingles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfreight.llm.common import by_row, mix, narrow, sets_of, shingle_hashes, sliced, stored, text_bytes, without, word_hashes, words_of

SHINGLE = 5  # words
LEAST_SIMILARITY = 0.8
BITS = 256  # of a fingerprint
RADIUS = 63  # Hamming distance within which all fingerprints are found
BLOCKS = 16  # of a fingerprint; each has its own table
#: The benchmark goes to every task. One with more text than this is gone through in parts of about this size.
MOST_BENCHMARK_BYTES = 16 << 20
#: With each part go the counts of all shingles that several items of the benchmark have. More of them stop the job.
MOST_SHARED = 1 << 22

#: Words are runs of ASCII letters and digits and of all bytes beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BLOCK_BITS = BITS // BLOCKS
_WITHIN = RADIUS // BLOCKS  # a fingerprint within RADIUS has a block within this distance


def _masks() -> np.ndarray:
    """All differences of one block that count as near, none first."""
    return np.array([sum(1 << b for b in c) for k in range(_WITHIN + 1) for c in combinations(range(_BLOCK_BITS), k)], np.uint32)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """A row of BITS signs, +1 or -1, for each shingle hash."""
    words = np.stack([mix(shingles + np.uint64(k * 0x632BE59BD9B4E019 % 2**64)) for k in range(BITS // 64)], axis=1)
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(shingles), -1), axis=1)
    return bits.astype(np.float32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of BLOCKS 16-bit blocks: the sign of each sum."""
    return np.packbits(sums > 0, axis=1).view(">u2").astype(np.uint32)


_ONES = np.array([bin(x).count("1") for x in range(1 << 16)], np.uint8)


class Benchmark:
    """The items as weighted shingles and fingerprints, with tables of their fingerprint blocks.

    A shingle weighs the more, the fewer items have it: log(1 + items / items with it). Nothing here
    depends on the documents. For a part of a benchmark, ``whole`` has the number of items with shingles in all of it,
    the shingles that several of them have, and how many have each. Fingerprints take square roots of weights: the angle between them then follows
    the weighted Jaccard similarity, also where a few shingles outweigh all others.
    """

    def __init__(self, ids: list[int], texts: list[str], whole: tuple[int, np.ndarray, np.ndarray] | None = None):
        raw = [t.encode() for t in texts]
        ends = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts, stops, offsets = words_of(data, ends, _WORD)
        shingles, at = shingle_hashes(word_hashes(data, starts, stops), offsets, SHINGLE)
        used = [k for k in range(len(ids)) if at[k + 1] > at[k]]
        self.ids = [ids[k] for k in used]
        self.words = np.diff(offsets)[used] if used else np.zeros(0, np.int64)
        sets = [np.unique(shingles[at[k] : at[k + 1]], return_counts=True) for k in used]
        if not sets:
            self.vocabulary = np.zeros(0, np.uint64)
            return
        self.vocabulary, having = np.unique(np.concatenate([s for s, _ in sets]), return_counts=True)
        n_items = len(sets)
        if whole:
            n_items, shared, times = whole
            self.vocabulary = np.union1d(self.vocabulary, shared)
            having = np.ones(len(self.vocabulary), np.int64)
            having[np.searchsorted(self.vocabulary, shared)] = times
        self.weight = np.log1p(n_items / having)
        self.cells = np.zeros(1 << 20, bool)  # of hashes, to pass over most other shingles
        self.cells[self.vocabulary.astype(np.int64) & (len(self.cells) - 1)] = True
        #: What any shingle outside the benchmark weighs: as one that a single item has.
        self.other_weight = float(np.log1p(n_items))
        self.items = [(np.searchsorted(self.vocabulary, s), c) for s, c in sets]
        self.total = np.array([(self.weight[v] * c).sum() for v, c in self.items])
        place = np.concatenate([v for v, _ in self.items])
        item = np.repeat(np.arange(len(self.items)), [len(v) for v, _ in self.items])
        order = np.lexsort((item, place))
        self.holders = item[order]
        self.holder_times = np.concatenate([c for _, c in self.items])[order]
        self.holder_at = np.searchsorted(place[order], np.arange(len(self.vocabulary) + 1))
        self.prints = np.stack([
            _pack(((np.sqrt(self.weight[v]) * c)[None, :].astype(np.float32) @ _signs(self.vocabulary[v])))[0] for v, c in self.items
        ])

    def near(self, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, rows of ``prints`` within RADIUS of it), complete by the pigeonhole principle.

        Each block of the side with fewer values is looked up on the other side with all differences
        of up to RADIUS // BLOCKS bits; what any block finds is measured in full.
        """
        masks = _masks()
        found: list[np.ndarray] = []
        for b in range(BLOCKS):
            ours, theirs = self.prints[:, b], prints[:, b]
            swap = len(np.unique(ours)) > len(np.unique(theirs))
            asked, table = (theirs, ours) if swap else (ours, theirs)
            order = np.argsort(table, kind="stable")
            cuts = np.searchsorted(table[order], np.arange((1 << _BLOCK_BITS) + 1))
            for value in np.unique(asked):
                hit = value ^ masks
                hit = hit[cuts[hit + 1] > cuts[hit]]
                if len(hit):
                    rows = np.concatenate([order[cuts[h] : cuts[h + 1]] for h in hit])
                    for k in np.flatnonzero(asked == value):
                        found.append(rows * len(prints) + k if swap else k * len(prints) + rows)
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        for low in range(0, len(pairs), 1 << 16):
            part = pairs[low : low + (1 << 16)]
            item, row = part // len(prints), part % len(prints)
            close = _ONES[prints[row] ^ self.prints[item]].sum(axis=1, dtype=np.int32) <= RADIUS
            item, row = item[close], row[close]
            for k in np.unique(item):
                yield int(k), row[item == k]


class _Texts:
    """The shingles of a batch of texts: their places in the benchmark's vocabulary (or -1) and their weights."""

    def __init__(self, bench: Benchmark, data: np.ndarray, ends: np.ndarray):
        starts, stops, offsets = words_of(data, ends, _WORD)
        self.words = np.diff(offsets)
        self.shingles, self.at = shingle_hashes(word_hashes(data, starts, stops), offsets, SHINGLE)
        perhaps = np.flatnonzero(bench.cells[self.shingles.astype(np.int64) & (len(bench.cells) - 1)])
        place = np.minimum(np.searchsorted(bench.vocabulary, self.shingles[perhaps]), len(bench.vocabulary) - 1)
        self.known = np.full(len(self.shingles), -1, np.int64)
        self.known[perhaps] = np.where(bench.vocabulary[place] == self.shingles[perhaps], place, -1)
        self.hits = np.flatnonzero(self.known >= 0)

    def stretches(self, reach: int) -> Iterator[tuple[int, int, int]]:
        """(text, first, end) of shingles around those of the benchmark. All other windows have no similarity."""
        if not len(self.hits):
            return
        text = np.searchsorted(self.at, self.hits, side="right") - 1
        breaks = np.flatnonzero((text[1:] != text[:-1]) | (self.hits[1:] - self.hits[:-1] > 2 * reach)) + 1
        for group in np.split(np.arange(len(self.hits)), breaks):
            t = int(text[group[0]])
            first = max(int(self.at[t]), int(self.hits[group[0]]) - reach)
            end = min(int(self.at[t + 1]), int(self.hits[group[-1]]) + reach + 1)
            for a in range(first, end, 8192):  # long stretches in overlapping pieces
                yield t, a, min(end, a + 8192 + reach)


def _windows(bench: Benchmark, texts: _Texts, t: int, a: int, b: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, first shingles, fingerprints) of all windows in a stretch that can hold an item of that length."""
    known = texts.known[a:b]
    held = np.unique(known[known >= 0])
    if not len(held):
        return
    holders = np.concatenate([bench.holders[bench.holder_at[v] : bench.holder_at[v + 1]] for v in held])
    weight = np.where(known < 0, bench.other_weight, bench.weight[np.maximum(known, 0)])
    sums = np.zeros((b - a + 1, BITS))
    np.cumsum(_signs(texts.shingles[a:b]) * np.sqrt(weight)[:, None], axis=0, out=sums[1:])
    among = np.concatenate(([0], np.cumsum(known >= 0)))
    for words in np.unique(bench.words[holders]).tolist():
        span = max(1, words - SHINGLE + 1)
        if span > b - a or (words < SHINGLE and words != texts.words[t]):
            continue
        first = np.arange(b - a - span + 1)
        first = first[among[first + span] > among[first]]
        if len(first):
            yield words, a + first, _pack(sums[first + span] - sums[first])


def _enough(bench: Benchmark, known: np.ndarray) -> np.ndarray:
    """Items of whose weight a text holds enough, wherever it stands; no other item can be similar to a window of it."""
    held, times = np.unique(known[known >= 0], return_counts=True)
    at = [slice(bench.holder_at[v], bench.holder_at[v + 1]) for v in held]
    item = np.concatenate([bench.holders[a] for a in at])
    shared = np.concatenate([bench.weight[v] * np.minimum(bench.holder_times[a], n) for v, n, a in zip(held, times, at)])
    items, place = np.unique(item, return_inverse=True)
    return items[np.bincount(place, shared) >= (LEAST_SIMILARITY - 1e-9) * bench.total[items]]


def _best_window(bench: Benchmark, item: int, known: np.ndarray, every_length: bool) -> tuple[float, int, int] | None:
    """(similarity, first, end) of the window that is most similar to an item, if similar enough.

    Windows of the item's own length are tried first, others only if asked and none of those will do. Of the others
    only those count that begin and end with a shingle of the item: without other ends they are more similar.
    """
    places, counts = bench.items[item]
    span, total = int(counts.sum()), float(bench.total[item])
    least = LEAST_SIMILARITY - 1e-9
    weight = np.where(known < 0, bench.other_weight, bench.weight[np.maximum(known, 0)])
    local = np.minimum(np.searchsorted(places, known), len(places) - 1)
    its = places[local] == known
    sums = np.concatenate(([0.0], np.cumsum(weight)))
    ours = np.concatenate(([0.0], np.cumsum(np.where(its, weight, 0.0))))
    best = None
    for f in np.flatnonzero(ours[span:] - ours[:-span] >= least * total - 1e-6).tolist():
        found = _similarity(bench, item, known[f : f + span])
        if found >= least and (best is None or found > best[0]):
            best = found, f, f + span
    if best or not every_length:
        return best
    hits = np.flatnonzero(its)
    # No similar window outweighs the item by more than 1 / LEAST_SIMILARITY.
    ends = np.searchsorted(sums, sums[hits] + total / least + 1e-6, side="right") - 1
    may = ours[ends] - ours[hits] >= least * total - 1e-6
    for k in np.flatnonzero(may).tolist():
        first, both, left = int(hits[k]), 0.0, counts.copy()
        for h in hits[k : np.searchsorted(hits, ends[k])].tolist():
            if left[local[h]] > 0:
                left[local[h]] -= 1
                both += weight[h]
                found = float(both / (sums[h + 1] - sums[first] + total - both))
                if found >= least and (best is None or found > best[0]):
                    best = found, first, h + 1
    return best


def _similarity(bench: Benchmark, item: int, window: np.ndarray) -> float:
    """Weighted Jaccard of an item and a window, given as places in the vocabulary or -1."""
    places, counts = bench.items[item]
    total = np.where(window < 0, bench.other_weight, bench.weight[np.maximum(window, 0)]).sum()
    held, times = np.unique(window[window >= 0], return_counts=True)
    common, mine, its = np.intersect1d(held, places, assume_unique=True, return_indices=True)
    both = (bench.weight[common] * np.minimum(times[mine], counts[its])).sum()
    return float(both / (total + bench.total[item] - both))


def find_matches(bench: Benchmark, data: np.ndarray, ends: np.ndarray, every_length: bool = False) -> list[tuple[int, int, float, int, int]]:
    """(text, item, similarity, first word, words) of the best window for each text and item."""
    if not len(bench.vocabulary):
        return []
    texts = _Texts(bench, data, ends)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}

    def search(waiting):
        owner = np.concatenate([np.full(len(f), t) for t, _, f, _ in waiting])
        words = np.concatenate([np.full(len(f), w) for _, w, f, _ in waiting])
        first = np.concatenate([f for _, _, f, _ in waiting])
        for item, rows in bench.near(np.concatenate([p for _, _, _, p in waiting])):
            span = max(1, int(bench.words[item]) - SHINGLE + 1)
            for r in rows[words[rows] == bench.words[item]].tolist():
                t, f = int(owner[r]), int(first[r])
                similarity = _similarity(bench, item, texts.known[f : f + span])
                if similarity >= LEAST_SIMILARITY - 1e-9 and similarity > best.get((t, item), (0.0,))[0]:
                    best[t, item] = (min(similarity, 1.0), f - int(texts.at[t]), int(bench.words[item]))

    waiting, many = [], 0
    for t, a, b in texts.stretches(int(bench.words.max())):
        for words, first, prints in _windows(bench, texts, t, a, b):
            waiting.append((t, words, first, prints))
            many += len(first)
            if many >= 1 << 17:
                search(waiting)
                waiting, many = [], 0
    if waiting:
        search(waiting)
    for t in np.unique(np.searchsorted(texts.at, texts.hits, side="right") - 1).tolist():
        known = texts.known[texts.at[t] : texts.at[t + 1]]
        for item in _enough(bench, known).tolist():
            if (t, item) in best:
                continue
            if found := _best_window(bench, item, known, every_length or bool(texts.words[t] < bench.words[item])):
                similarity, first, end = found
                best[t, item] = (min(similarity, 1.0), first, min(end - first + SHINGLE - 1, int(texts.words[t])))
    return [(t, item, s, f, w) for (t, item), (s, f, w) in sorted(best.items())]


def _match_batches(bench: Benchmark, every_length: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 4 << 20):
            found = find_matches(bench, *text_bytes(batch.column("text")), every_length)
            ids = batch.column("id")
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([f[0] for f in found], pa.int64())),
                    pa.array([bench.ids[f[1]] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.float64()),
                    pa.array([f[3] for f in found], pa.int64()),
                    pa.array([f[4] for f in found], pa.int64()),
                ],
                names=["doc_id", "item_id", "similarity", "first_word", "n_words"],
            )

    return run


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct shingles of each item; the first of each is marked, so that items are counted with them."""
    for batch in sliced(batches, "text", 4 << 20):
        sets = list(sets_of(*text_bytes(batch.column("text")), SHINGLE, _WORD))
        sizes = [len(s) for s in sets]
        first = np.zeros(sum(sizes), bool)
        first[np.cumsum([0, *sizes])[:-1][np.array(sizes) > 0]] = True
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)),
                pa.array(first),
            ],
            names=["shingle", "first"],
        )


def benchmark_parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Benchmark]:
    """The items, in one part if they have at most MOST_BENCHMARK_BYTES, else in several of about so many or one longer item.

    A part is made when it is asked for. Weights are those of the whole benchmark, whose shingles Spark counts: what a
    part does not have of it and several items share comes with its count, and all else weighs as what one item has.
    So matches do not hang on the parts.
    """
    items = benchmark.select(benchmark[id_col].cast("bigint").alias("id"), benchmark[text_col].cast("string").alias("text"))
    items = items.filter("id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if size <= MOST_BENCHMARK_BYTES:
        rows = sorted(items.collect())
        yield Benchmark([r[0] for r in rows], [r[1] for r in rows])
        return
    parts = size // MOST_BENCHMARK_BYTES + 1
    dealt = stored(items.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int")), "benchmark-items")
    shingles = stored(dealt.select("text").mapInArrow(_shingle_batches, "shingle bigint, first boolean"), "benchmark-shingles")
    n_items = shingles.filter("first").count()
    shared = stored(shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("items")).filter("items > 1"), "benchmark-shared")
    if (many := shared.count()) > MOST_SHARED:
        raise ValueError(f"{many} shingles are in several items of the benchmark; at most {MOST_SHARED} go to every task")
    counts = shared.toArrow()
    hashes = counts["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    whole = n_items, hashes[order], counts["items"].to_numpy()[order]
    for part in range(parts):
        rows = sorted(dealt.filter(F.col("part") == part).select("id", "text").collect())
        yield Benchmark([r[0] for r in rows], [r[1] for r in rows], whole)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    every_length: bool = False,
) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of each document for each item it holds.

    Words are runs of letters and digits, A-Z lower-cased; shingles are five words long. Windows of
    every item's length at every word of the whole text, if they hold any shingle of the benchmark, get
    a weighted SimHash. Hamming blocks find every item within RADIUS bits of it. The weighted Jaccard
    similarity of those (sum of smaller over sum of larger weights, repeated shingles counted) is then
    computed exactly, and from 0.8 on it is a match. At a similarity of 0.8 fingerprints of shingles that
    do not repeat are expected at most 39 bits apart, give or take 6, so RADIUS is four deviations away.
    Where they find no match for an item of whose weight the text holds 0.8 or more (no other can match),
    its windows are compared exactly without fingerprints, so that no match hangs on RADIUS.

    A text shorter than an item has no window of its length; there, windows of all lengths are compared.
    ``every_length`` asks for the same in any text where no window of the item's length matches: a
    passage may have lost or gained words. ``n_words`` is the window's own length.

    A benchmark above MOST_BENCHMARK_BYTES is gone through in parts, one pass over the texts for each, with the
    same matches.

    Defined cases: null and empty texts match nothing; items without text or id are not looked for; an
    item of fewer than five words matches only a text that consists of exactly its words; repeated
    items and rows each give their own row; an empty table gives an empty result; other columns are
    not looked at.
    """
    schema = "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint"
    texts = narrow(docs, id_col, text_col)
    found, parts = None, benchmark_parts(benchmark, item_col, item_text_col)
    bench, following = next(parts), next(parts, None)
    while following is not None:  # each part has its own pass over the texts; its matches are stored
        part = stored(texts.mapInArrow(_match_batches(bench, every_length), schema), "benchmark-matches")
        found = part if found is None else found.unionByName(part)
        bench, following = following, next(parts, None)
    last = texts.mapInArrow(_match_batches(bench, every_length), schema)
    return last if found is None else found.unionByName(last)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    every_length: bool = False, each_row: bool = False,
) -> DataFrame:
    """The documents without a benchmark passage, all columns as they are.

    With ``each_row`` rows whose id is null or repeats go or stay by their own texts.
    """
    if each_row:
        return by_row(docs, id_col, lambda rows, row: drop_contaminated(rows, benchmark, row, text_col, every_length))
    found = find_contamination(docs, benchmark, id_col, text_col, every_length=every_length)
    gone = stored(found.select(F.col("doc_id").alias(id_col)).distinct(), "contaminated")
    return without(docs, gone, id_col)
