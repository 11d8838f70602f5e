"""Language-model scores from a weighted backoff automaton over the n-grams of the corpus.

States are histories, arcs are seen n-grams, and a failure arc leads from each history to the shorter
one at a price. The model is as large as the corpus, so no task holds it whole. Documents are cut into
blocks; a block asks, once for each distinct n-gram in it, how often the whole training part has it,
and tells how often its own training documents do. Requests travel packed by ranges of n-gram hashes;
each range adds up what the blocks told and answers them; each block then has the part of the
automaton that its texts can reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfreight.llm.common import in_fold, mix, narrow, sliced, stored, text_bytes, word_hashes, words_of
from wayfreight.llm.common import pack_integers as _pack
from wayfreight.llm.common import unpack_integers as _unpack

BLOCK_BYTES = 4 << 20  # of text in a block, or one longer text
RANGE_ENTRIES = 1 << 20  # n-gram entries that a range gets, about
#: Of a pair's hash below its range; words keep all 64 bits. About one pair in a million shares its key, at any size.
PAIR_KEY_BITS = 40
#: Strength of the shorter history in a longer one: p(w|h) = (c(hw) + STRENGTH p(w)) / (c(h) + STRENGTH).
STRENGTH = 4.0
END, BEGIN = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
DOCS, WORDS, PAIRS, TOTALS, KEYS = 0, 1, 2, 3, 4


class Unigrams:
    """Probabilities of single tokens by absolute discounting; what is discounted goes to the unknown token.

    The outcomes are the known tokens and one unknown token. The discount is n1 / (n1 + 2 n2), of the
    numbers of tokens seen once and twice.
    """

    def __init__(self, tokens: int, types: int, once: int, twice: int):
        self.tokens, self.types = tokens, types
        self.discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5

    def probability(self, counts: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(counts))
        unknown = self.discount * self.types / self.tokens
        return np.where(counts > 0, (counts - self.discount) / self.tokens, unknown)


class Automaton:
    """The part of the model that a block reaches.

    State 0 is the root, state k + 1 the history of word k, the last state the begin of a text. Every
    word has an arc from the root. Pair arcs are in the order of the pairs; those of pairs that were
    never seen do not exist. The failure arc of every other state leads to the root.
    """

    def __init__(self, unigrams: Unigrams, word_counts: np.ndarray, begins: int):
        history = np.concatenate(([0.0], word_counts, [begins]))
        self.root_arc = unigrams.probability(word_counts)
        self.history = history
        self.failure = np.where(history > 0, np.log10(STRENGTH / (history + STRENGTH)), 0.0)
        self.begin = len(history) - 1

    def traverse(self, tokens: np.ndarray, firsts: np.ndarray, pair_counts: np.ndarray) -> np.ndarray:
        """log10 probability of each token, for texts laid end to end that start at ``firsts``.

        One pass from left to right: after any token, found by an arc or behind a failure arc, the state
        is that token's history, so the states of all steps are known at once. ``pair_counts`` has, for
        each step, the count of the arc that leaves its state by its token, 0 where there is none.
        """
        state = np.empty(len(tokens), np.int64)
        state[1:] = tokens[:-1] + 1
        state[firsts] = self.begin
        shorter = self.root_arc[tokens]
        arc = np.log10((pair_counts + STRENGTH * shorter) / (self.history[state] + STRENGTH))
        return np.where(pair_counts > 0, arc, self.failure[state] + np.log10(shorter))


# --- packing ---------------------------------------------------------------------------------------


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, np.uint64), dtype=np.uint64)


def _pair_keys(previous: np.ndarray, tokens: np.ndarray, range_bits: int) -> np.ndarray:
    """Hashes of pairs, cut to the bits that name their range and PAIR_KEY_BITS more."""
    whole = mix(previous * np.uint64(0xA0761D6478BD642F) + tokens)
    return whole >> np.uint64(max(0, 64 - range_bits - PAIR_KEY_BITS))


# --- blocks ----------------------------------------------------------------------------------------

_BLOCK_SCHEMA = "block bigint, kind int, bucket bigint, n bigint, keys binary, counts binary, ids array<bigint>, held array<boolean>, sizes array<bigint>"
_ARROW_BLOCK = pa.schema([
    ("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()),
    ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())),
])


def _ranged(keys: np.ndarray, key_bits: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted keys: their range is what stands above key_bits."""
    if not len(keys):
        return []
    bucket = keys >> np.uint64(key_bits) if key_bits < 64 else np.zeros(len(keys), np.uint64)
    cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(keys)]))
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]


def _block_rows(batches: list[pa.RecordBatch], range_bits: int) -> Iterator[pa.RecordBatch]:
    """The documents of a block as word numbers, and its requests by range."""
    import os

    block = int.from_bytes(os.urandom(8), "little") >> 1
    texts = pa.Table.from_batches(batches).combine_chunks()
    column = texts.column("text").chunk(0)
    data, ends = text_bytes(column)
    starts, stops, offsets = words_of(data, ends)
    n = len(ends) - 1
    tokens = np.empty(len(starts) + n, np.uint64)
    tokens[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(offsets))] = word_hashes(data, starts, stops)
    tokens[offsets[1:] + np.arange(n)] = END
    sizes = np.diff(offsets) + 1
    held = texts.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
    train = np.repeat(~held, sizes)
    words, number = np.unique(tokens, return_inverse=True)
    word_counts = np.bincount(number[train], minlength=len(words)).astype(np.uint32)

    previous = np.empty(len(tokens), np.uint64)
    previous[1:] = tokens[:-1]
    previous[np.cumsum(sizes) - sizes] = BEGIN
    keys = _pair_keys(previous, tokens, range_bits)
    order = np.sort((keys << np.uint64(1)) | train.astype(np.uint64)) if range_bits + PAIR_KEY_BITS < 64 else None
    if order is None:
        pairs, inverse = np.unique(keys, return_inverse=True)
        pair_counts = np.bincount(inverse[train], minlength=len(pairs)).astype(np.uint32)
    else:
        sorted_keys = order >> np.uint64(1)
        at = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
        pairs = sorted_keys[at]
        pair_counts = np.add.reduceat((order & np.uint64(1)).astype(np.uint32), at, dtype=np.uint32)

    def rows(kind, found, keys, counts):
        k = len(found)
        return pa.RecordBatch.from_arrays([
            pa.array([block] * k, pa.int64()), pa.array([kind] * k, pa.int32()), pa.array([f[0] for f in found], pa.int64()),
            pa.array([b - a for _, a, b in found], pa.int64()), pa.array([_pack_sorted(keys[a:b]) for _, a, b in found], pa.binary()),
            pa.array([_pack(counts[a:b]) for _, a, b in found], pa.binary()),
            pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.bool_())), pa.nulls(k, pa.list_(pa.int64())),
        ], schema=_ARROW_BLOCK)

    yield pa.RecordBatch.from_arrays([
        pa.array([block], pa.int64()), pa.array([DOCS], pa.int32()), pa.array([0], pa.int64()), pa.array([len(tokens)], pa.int64()),
        pa.nulls(1, pa.binary()), pa.array([_pack(number.astype(np.uint32))], pa.binary()),
        pa.array([texts.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([held.tolist()], pa.list_(pa.bool_())),
        pa.array([sizes.tolist()], pa.list_(pa.int64())),
    ], schema=_ARROW_BLOCK)
    yield rows(WORDS, _ranged(words, 64 - range_bits), words, word_counts)
    yield rows(PAIRS, _ranged(pairs, min(PAIR_KEY_BITS, 64 - range_bits)), pairs, pair_counts)


def _cut_blocks(range_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in sliced(batches, "text", BLOCK_BYTES // 4):
            held.append(batch)
            size += len(text_bytes(batch.column("text"))[0]) + batch.num_rows
            if size >= BLOCK_BYTES:
                yield from _block_rows(held, range_bits)
                held, size = [], 0
        if held:
            yield from _block_rows(held, range_bits)

    return run


# --- ranges ----------------------------------------------------------------------------------------


def _answer_range(rows: list[tuple[int, int, int, int, bytes, bytes]]) -> pa.RecordBatch:
    """Totals for the keys that each block asked for, and a row of totals of the range."""
    kind, bucket = rows[0][0], rows[0][1]
    keys = np.concatenate([_unpack_sorted(r[4]) for r in rows])
    counts = np.concatenate([_unpack(r[5], np.uint32) for r in rows])
    found, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, weights=counts, minlength=len(found)).astype(np.int64)
    out, at = [], 0
    for r in rows:
        n = r[3]
        out.append((r[2], kind, bucket, _pack(total[inverse[at : at + n]].astype(np.uint64)), None))
        at += n
    if kind == WORDS:
        end = int(total[found == END].sum())
        sums = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum()), end]
        out.append((None, TOTALS, bucket, None, sums))
    kinds = pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=["block", "kind", "bucket", "counts", "sums"])


def _answer_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kind, range)."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "block", "n", "keys", "counts"))):
            if held and held[0][:2] != row[:2]:
                yield _answer_range(held)
                held = []
            held.append(row)
    if held:
        yield _answer_range(held)


# --- scores ----------------------------------------------------------------------------------------


def _score_block(docs: dict, told: dict[int, list[bytes]], totals: dict, range_bits: int) -> pa.RecordBatch:
    words = np.concatenate([_unpack_sorted(k) for k in told[KEYS]])
    number = _unpack(docs["counts"], np.uint32).astype(np.int64)
    sizes = np.array(docs["sizes"], np.int64)
    firsts = np.cumsum(sizes) - sizes
    known = np.concatenate([_unpack(c, np.uint64) for c in told[WORDS]]).astype(np.int64)
    pair_totals = np.concatenate([_unpack(c, np.uint64) for c in told[PAIRS]]).astype(np.int64)
    tokens = words[number]
    previous = np.empty(len(tokens), np.uint64)
    previous[1:] = tokens[:-1]
    previous[firsts] = BEGIN
    _, which = np.unique(_pair_keys(previous, tokens, range_bits), return_inverse=True)

    unigrams = Unigrams(totals["tokens"], totals["types"], totals["once"], totals["twice"])
    automaton = Automaton(unigrams, known.astype(float), totals["begins"])
    steps = automaton.traverse(number, firsts, pair_totals[which].astype(float))
    count = known[number]
    base = np.log10((count + 1) / (totals["tokens"] + totals["types"] + 1))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(docs["ids"], pa.int64()),
            pa.array(docs["held"], pa.bool_()),
            pa.array(sizes),
            pa.array(np.add.reduceat((count > 0).astype(np.int64), firsts)),
            pa.array(np.full(len(sizes), totals["tokens"], np.int64)),
            pa.array(np.add.reduceat(base, firsts)),
            pa.array(np.add.reduceat(steps, firsts)),
        ],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def _score_batches(totals: dict, range_bits: int):
    """Rows sorted by (block, kind, range): the documents, then the answers and the words in the order of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, told = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                kind = batch.column("kind")[k].as_py()
                if kind == DOCS:
                    if docs is not None:
                        yield _score_block(docs, told, totals, range_bits)
                    docs = {c: batch.column(c)[k].as_py() for c in ("counts", "ids", "held", "sizes")}
                    told = {WORDS: [], PAIRS: [], KEYS: []}
                else:
                    told[kind].append(batch.column("keys" if kind == KEYS else "counts")[k].as_py())
        if docs is not None:
            yield _score_block(docs, told, totals, range_bits)

    return run


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    Rows whose crc32 of the id leaves ``remainder`` are held out; the model is learned from all others.
    Tokens are words between white space, A-Z lower-cased, and an end after the last; words are told
    apart by 64-bit hashes. The base adds one to the counts of single tokens. The model is a bigram
    automaton: an arc's weight is the logarithm of (c(hw) + STRENGTH p(w)) / (c(h) + STRENGTH), a
    failure arc's that of STRENGTH / (c(h) + STRENGTH), and p(w) is absolute discounting of single
    tokens. Each history's probabilities add up to one.

    A block holds ``BLOCK_BYTES`` of text, a range about ``RANGE_ENTRIES`` entries, however large the
    corpus; frequent n-grams count once for each block. What is shuffled are packed distinct n-grams
    and word numbers, stored between the jobs.

    Defined cases: a null text is empty and has the end as its only token; with nothing to learn from,
    all scores are 0 and nothing is known; a null id is not held out; repeated rows are learned and
    scored each; an empty table gives an empty result; other columns are not looked at.
    """
    rows = narrow(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    range_bits = max(1, min(40, int(size // 5 // RANGE_ENTRIES).bit_length()))
    rows = rows.withColumn("held_out", in_fold("id", modulus, remainder))
    blocks = stored(rows.mapInArrow(_cut_blocks(range_bits), _BLOCK_SCHEMA), "lm-blocks")

    requests = blocks.filter(F.col("kind") != DOCS).select("kind", "bucket", "block", "n", "keys", "counts")
    dealt = requests.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")
    schema = "block bigint, kind int, bucket bigint, counts binary, sums array<bigint>"
    answers = stored(dealt.mapInArrow(_answer_batches, schema), "lm-answers")
    sums = [F.sum(F.col("sums")[k]) for k in range(5)]
    found = [x or 0 for x in answers.filter(F.col("kind") == TOTALS).agg(*sums).first()]
    totals = dict(zip(("tokens", "types", "once", "twice", "begins"), found))

    parts = blocks.filter(F.col("kind") == DOCS).select("block", "kind", "bucket", "keys", "counts", "ids", "held", "sizes")
    keys = blocks.filter(F.col("kind") == WORDS).select("block", F.lit(KEYS).alias("kind"), "bucket", "keys")
    replies = answers.filter(F.col("kind") != TOTALS).select("block", "kind", "bucket", "counts")
    together = parts.unionByName(replies, allowMissingColumns=True).unionByName(keys, allowMissingColumns=True)
    together = together.repartition("block").sortWithinPartitions("block", "kind", "bucket")
    out = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return together.mapInArrow(_score_batches(totals, range_bits), out)
