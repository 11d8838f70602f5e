"""Documents linked by the Jaccard similarity of their word shingles, exactly, and the groups they form.

Most of what resembles anything is a copy with small changes, so answers are derived from sets that
are already known to be highly similar instead of being found anew:

1. Equal sets are one class; from here on its smallest document stands for it.
2. A class may get a pivot, a class that agrees with it in several of a few minimum hashes. It is
   compared with the pivot once, which leaves the difference between the two sets.
3. Similarities among the sets around one pivot follow from those differences alone, so their lists in
   the index need not be walked.
4. Everything else meets in a prefix index: shingles are ordered from rare to frequent, and sets that
   are similar enough share one of the first. Lists whose entries all belong to one component by now are skipped
   whole, sets that are too small or too large are skipped as blocks, and position in the order and the parities of
   two sets skip pairs before any set is read.
5. Long lists are those of families of near copies. They are gone through in rounds: each set first meets the
   one that its parities show to be closest, then some more, then all that are left; after each round the components
   that have grown together have nothing to ask each other any more.

Pivots and the order of the rounds only save work; steps 3 to 5 together cover every pair of classes that are not joined already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfreight.llm.common import by_row, narrow, numbered, pack_integers, perhaps_among, sets_of, sliced, stored, text_bytes, unpack_integers, without

MINIMA = 6  # minimum hashes of a set
VOTES = 2  # of them that a class must share with its pivot
CLUSTER_PERCENT = 50  # a set less similar to its pivot than this is not derived from it
#: Frequencies are counted in so many cells. They only order the shingles: any order gives the same links.
CELLS = 1 << 22
PARITIES = 1024  # bits of a set: each counts, modulo 2, the shingles that fall to it
CHUNK = 1024  # rows of one hot group that a task works on at a time, against as many others
SHORT_LIST = 32  # entries of a list that are all compared in the first round
#: Partners that a set of a longer list is compared with, the closest first, round by round; in the last round all others.
ROUNDS = (1, 8, None)

_FACTORS = np.random.default_rng(5).integers(1, 2**63, MINIMA, dtype=np.uint64) | np.uint64(1)


def overlap_needed(a, b, percent: int):
    """Whether an overlap suffices is decided in whole numbers: (100 + percent) * overlap >= percent * (a + b)."""
    return -(-percent * (a + b) // (100 + percent))


# --- sets of every document ------------------------------------------------------------------------


def _fingerprint(one: np.ndarray) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(one.tobytes(), digest_size=8).digest(), "little", signed=True)


def _describe_batches(size: int):
    """Per document its set's size, fingerprint and minima; at the end the task's frequency cells, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("minima", pa.list_(pa.int64())),
             ("parity", pa.binary()), ("part", pa.int32()), ("cells", pa.binary())]
        )
        cells = np.zeros(CELLS, np.int32)
        for batch in sliced(batches, "text", 4 << 20):
            n, cls, minima, parity = [], [], [], []
            for one in sets_of(*text_bytes(batch.column("text")), size):
                n.append(len(one))
                if not len(one):
                    cls.append(None)
                    minima.append(None)
                    parity.append(None)
                    continue
                cls.append(_fingerprint(one))
                minima.append([int((one * f).min().astype(np.int64)) for f in _FACTORS])
                odd = np.bincount((one >> np.uint64(54)).astype(np.int64), minlength=PARITIES) & 1
                parity.append(np.packbits(odd.astype(np.uint8)).tobytes())
                cells[one.astype(np.int64) & (CELLS - 1)] += 1  # once a set
            rows = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(minima, pa.list_(pa.int64())),
                 pa.array(parity, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                schema=schema,
            )
        parts = np.split(cells, 16)
        used = [k for k in range(16) if parts[k].any()]
        if used:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.int64()),
                 pa.nulls(len(used), pa.list_(pa.int64())), pa.nulls(len(used), pa.binary()), pa.array(used, pa.int32()), pa.array([pack_integers(parts[k]) for k in used], pa.binary())],
                schema=schema,
            )

    return run


def _add_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("cells")):
            total.setdefault(part, np.zeros(CELLS // 16, np.int64))
            total[part] += unpack_integers(raw.as_py(), np.int32)
    for part, cells in total.items():
        often = np.minimum(cells, (1 << 24) - 1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack_integers(often)], pa.binary())], names=["part", "cells"])


def _frequencies(described: DataFrame) -> dict[int, bytes]:
    """The cells of all tasks added up, packed, by part. Their number is fixed, so they may come to the driver."""
    parts = described.filter("part IS NOT NULL").select("part", "cells")
    return {part: bytes(raw) for part, raw in parts.repartition("part").mapInArrow(_add_cells, "part int, cells binary").collect()}


# --- pivots and differences ------------------------------------------------------------------------


def _pivots(classes: DataFrame) -> DataFrame:
    """(x, p): the earlier class that most of a class's minima point to, if at least VOTES do."""
    entries = classes.select("rep", F.posexplode("minima").alias("r", "m"))
    first = entries.groupBy("r", "m").agg(F.min("rep").alias("p"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    first = stored(first.select(F.col("r").alias("pr"), F.col("m").alias("pm"), "p"), "jaccard-minima")
    met = entries.join(first.hint("merge"), (F.col("r") == F.col("pr")) & (F.col("m") == F.col("pm"))).filter("p < rep")
    votes = met.groupBy("rep", "p").agg(F.count(F.lit(1)).alias("votes")).filter(F.col("votes") >= VOTES)
    best = votes.groupBy("rep").agg(F.max(F.struct("votes", (-F.col("p")).alias("less"))).alias("best"))
    return best.select(F.col("rep").alias("x"), (-F.col("best.less")).alias("p"))


def _compare_batches(size: int, percent: int):
    """Rows sorted by (p, chunk, kind), the pivot of a chunk first -> the difference of each other row from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["x", "p", "chunk", "n_x", "n_p", "missing", "added", "difference", "linked"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
        pivot = None
        for batch in sliced(batches, "text", 4 << 20):
            ids, ps, chunks = (batch.column(c).to_pylist() for c in ("id", "p", "chunk"))
            is_pivot = batch.column("kind").to_pylist()
            rows = []
            for k, one in enumerate(sets_of(*text_bytes(batch.column("text")), size)):
                if is_pivot[k] == 0:
                    pivot = one
                    continue
                difference = np.setxor1d(one, pivot, assume_unique=True)
                added = (len(difference) + len(one) - len(pivot)) // 2
                missing = len(difference) - added
                both = len(one) - added
                linked = (100 + percent) * both >= percent * (len(one) + len(pivot))
                close = 100 * both >= CLUSTER_PERCENT * (len(one) + missing)
                raw = difference.tobytes() if close else b""
                rows.append((ids[k], ps[k], chunks[k], len(one), len(pivot), missing, added, raw, linked))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=names)

    return run


def compare(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """For each pair (x, p) the sizes of both sets, what x misses and adds, the difference, and whether they link.

    ``docs`` has id and text, ``pairs`` is stored. Only texts that a filter of the ids lets through are
    shuffled. A p with many partners is sent once to each chunk of them.
    """
    sizes = pairs.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(sizes.withColumnRenamed("p", "sp"), F.col("p") == F.col("sp")).select(
        F.col("x").alias("who"), "p", F.pmod(F.xxhash64("x"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("kind")
    )
    heads = sizes.select(
        F.col("p").alias("who"), "p", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("kind")
    )
    wanted = stored(dealt.unionByName(heads), "jaccard-wanted")
    texts = perhaps_among(docs, "id", wanted, "who")
    met = texts.join(wanted.hint("merge"), F.col("id") == F.col("who")).select("p", "chunk", "kind", "id", "text")
    sorted_rows = met.repartition("p", "chunk").sortWithinPartitions("p", "chunk", "kind")
    schema = (
        "x bigint, p bigint, chunk int, n_x bigint, n_p bigint, missing bigint, added bigint, difference binary, linked boolean"
    )
    return sorted_rows.mapInArrow(_compare_batches(size, percent), schema)


# --- groups of sorted rows -------------------------------------------------------------------------


def _dealt(df: DataFrame, name: str) -> DataFrame:
    """The rows of each group, dealt out so that each meets each ``minor`` row of its group in one part (i, j).

    Group columns aside, df says how many ``chunks`` the group's rows fill and how many its minor rows (``minor_chunks``).
    Each row goes with side 0 to the parts of its chunk, one for each chunk of minor rows; minor rows also go with side 1 to all
    chunks. A group with few minor rows is hardly copied, whatever its size.
    """
    own = F.pmod(F.xxhash64(name), F.col("chunks")).cast("int")
    as_minor = F.pmod(F.xxhash64(name, F.lit(1)), F.col("minor_chunks")).cast("int")

    def part(i, j, side: int):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))

    met = F.transform(F.sequence(F.lit(0), F.col("minor_chunks") - 1), lambda j: part(own, j, 0))
    asks = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: part(i, as_minor, 1))
    places = F.when(F.col("minor"), F.concat(met, asks)).otherwise(met)
    return df.withColumn("place", F.explode(places)).select("*", "place.i", "place.j", "place.side").drop("place")


def _chunks(n) -> "F.Column":
    return F.ceil(n / CHUNK).cast("int")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys; one group at a time is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(v[a] for v in values)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=_EDGES)


def _shared_differences(raw: list[bytes], rows: np.ndarray) -> np.ndarray:
    """How many elements the differences of ``rows`` share with those of all, by column slices."""
    sizes = [len(r) // 8 for r in raw]
    _, element = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)
    owner = np.repeat(np.arange(len(raw)), sizes)
    times = np.bincount(element) if len(element) else np.zeros(0, int)
    numbered = np.cumsum(times > 1) - 1
    keep = times[element] > 1 if len(element) else np.zeros(0, bool)
    element, owner = numbered[element[keep]], owner[keep]
    shared = np.zeros((len(rows), len(raw)), np.float32)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    for low in range(0, int(element[-1]) + 1 if len(element) else 0, 1024):
        a, b = np.searchsorted(element, (low, low + 1024))
        table = np.zeros((len(raw), 1024), np.float32)
        table[owner[a:b], element[a:b] - low] = 1
        shared += table[rows] @ table.T
    return shared


def _derive_batches(percent: int):
    """Links among the sets around one pivot, from their differences; only links that join something new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["p", "i", "j"]):
            ids, side, n, missing, n_p = (group.column(c).to_numpy() for c in ("x", "side", "n_x", "missing", "n_p"))
            loose = np.flatnonzero(side == 1)  # those that link with the pivot are joined already
            if not len(loose) or len(loose) == len(ids):
                continue
            shared = _shared_differences([r.as_py() for r in group.column("difference")], loose)
            overlap = n_p[0] - missing[loose][:, None] - missing[None, :] + shared
            met = (100 + percent) * overlap >= percent * (n[loose][:, None] + n[None, :])
            met &= (side == 0) & (ids[loose][:, None] != ids[None, :])
            found = []
            _, label = np.unique(ids, return_inverse=True)  # a loose set is there on both sides
            for a, row in zip(loose.tolist(), met):
                near = np.flatnonzero(row)
                others, at = np.unique(label[near], return_index=True)
                fresh = others != label[a]
                if fresh.any():
                    found += [(int(ids[a]), int(ids[b])) for b in near[at[fresh]]]
                    joined = np.append(others[fresh], label[a])
                    label[np.isin(label, joined)] = joined.min()
            if found:
                yield _edges(found)

    return run


# --- the index -------------------------------------------------------------------------------------


def _prefix_batches(size: int, percent: int, frequencies: dict[int, bytes]):
    """The first shingles, from rare to frequent, of each set that the task has not met before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int32)
        for part, raw in frequencies.items():
            cells[part * (CELLS // 16) : (part + 1) * (CELLS // 16)] = unpack_integers(raw, np.int32)
        seen: set[int] = set()
        for batch in sliced(batches, "text", 4 << 20):
            keys, cls, sizes = [], [], []
            for one in sets_of(*text_bytes(batch.column("text")), size):
                if not len(one) or (c := _fingerprint(one)) in seen:
                    continue
                seen.add(c)
                often = cells[one.astype(np.int64) & (CELLS - 1)].astype(np.uint64)
                # Frequency first, then the hash: the same order in every set, and a key of its own.
                ordered = np.sort((often << np.uint64(40)) | (one >> np.uint64(24)))
                keys.append(ordered[: len(one) + (-percent * len(one) // 100) + 1])
                cls.append(c)
                sizes.append(len(one))
            if not keys:
                continue
            lengths = [len(k) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys).view(np.int64)),
                    pa.array(np.repeat(np.array(cls, np.int64), lengths)),
                    pa.array(np.repeat(np.array(sizes, np.int64), lengths)),
                    pa.array(np.concatenate([np.arange(k) for k in lengths]).astype(np.int64)),
                ],
                names=["key", "cls", "n", "pos"],
            )

    return run


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, cls): those whose key two classes have, each class once. Streams."""
    waiting = None  # the first row of the current key, until a second class follows
    last = (None, None)
    for batch in batches:
        if not batch.num_rows:
            continue
        key, cls = batch.column("key").to_numpy(), batch.column("cls").to_numpy()
        new_key = np.concatenate(([key[0] != last[0]], key[1:] != key[:-1]))
        new_cls = new_key | np.concatenate(([cls[0] != last[1]], cls[1:] != cls[:-1]))
        firsts = np.flatnonzero(new_cls)  # one row for each (key, cls) that starts here
        follows = ~new_key[firsts]  # a class that is not the first of its key
        out = follows.copy()
        out[:-1] |= follows[1:]  # the one before a follower is kept too
        if waiting is not None and len(firsts) and follows[0]:
            yield waiting
            waiting = None
        if len(firsts):
            if out.any():
                yield batch.take(pa.array(firsts[out]))
            waiting = batch.slice(int(firsts[-1]), 1) if not out[-1] else None
        last = (key[-1], cls[-1])


def reach(n: np.ndarray, asked: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted sizes, where those begin and end that a set of each asked size can link with."""
    return np.searchsorted(n, -(-asked * percent // 100)), np.searchsorted(n, asked * 100 // percent, side="right")


def _pair_batches(percent: int, most: int | None):
    """Pairs of sets from different pivots and components that share a key, as far as sizes, positions and parities allow a link.

    Rows of side 0 are met, those of side 1 ask, those of side 2 do both.
    The sets of a part are sorted by size, and each one that asks meets only the block that is neither too small nor
    too large. Two sets differ in at least as many shingles as their parities differ in bits. In a list that is not
    short, a set is paired with the ``most`` closest only, by their parities.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["key", "i", "j"]):
            rep, cluster, home, side, n, pos = (group.column(c).to_numpy() for c in ("rep", "cluster", "home", "side", "n", "pos"))
            few = None if group.column("many")[0].as_py() <= SHORT_LIST else most
            parity = np.frombuffer(b"".join(group.column("parity").to_pylist()), np.uint64).reshape(len(rep), -1)
            met = np.flatnonzero(side != 1)
            met = met[np.lexsort((pos[met], n[met]))]
            asks = np.flatnonzero(side != 0)
            if not len(met) or not len(asks):
                continue
            place = np.full(len(rep), -1)  # of those that ask and are met, among the sets that are met
            place[met] = np.arange(len(met))
            m_rep, m_cluster, m_home, m_side, m_n, m_pos, m_parity = (c[met] for c in (rep, cluster, home, side, n, pos, parity))
            starts, ends = reach(m_n, n[asks], percent)
            found = set()
            for a, start, end in zip(asks.tolist(), starts.tolist(), ends.tolist()):
                b = slice(start, end)
                fits = (m_cluster[b] != cluster[a]) & (m_home[b] != home[a])
                if few is None and side[a] == 2:  # those before it that ask have asked it
                    fits &= (m_side[b] == 0) | (np.arange(start, end) > place[a])
                others = np.flatnonzero(fits) + start
                least = overlap_needed(n[a], m_n[others], percent)
                reached = np.minimum(pos[a], m_pos[others]) + 1 + np.minimum(n[a] - pos[a] - 1, m_n[others] - m_pos[others] - 1)
                others, least = others[reached >= least], least[reached >= least]
                if not len(others):
                    continue
                apart = np.bitwise_count(parity[a] ^ m_parity[others]).sum(axis=1, dtype=np.int64)
                near = apart <= n[a] + m_n[others] - 2 * least
                others, apart = others[near], apart[near]
                if few is not None and len(others) > few:
                    others = others[np.lexsort((m_rep[others], apart))[:few]]
                found.update((int(min(rep[a], y)), int(max(rep[a], y))) for y in m_rep[others])
            if found:
                yield _edges(sorted(found))

    return run


# --- components ------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    In each round a node takes the smallest label around it, then that label's own label. Rounds are
    stored tables; a node with very many edges is combined before the shuffle and its join is split.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = stored(both, "jaccard-edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "jaccard-labels")
    total = None
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total or now is None:
            return labels.select("node", F.col("label").alias("component"))
        total = now
        around = both.join(labels.hint("merge"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("label"))
        nearer = stored(nearer, "jaccard-labels")
        jump = nearer.select(F.col("node").alias("at"), F.col("label").alias("further"))
        labels = stored(
            nearer.join(jump.hint("merge"), F.col("label") == F.col("at"), "left").select(
                "node", F.least("label", F.coalesce("further", "label")).alias("label")
            ),
            "jaccard-labels",
        )


def merged_homes(homes: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, home) after some more links: homes that they join are named by the smallest of them.

    Only the homes at the ends of links that join different ones are gone through.
    """
    ends = []
    for end in ("a", "b"):
        ends.append(homes.select(F.col("rep").alias(f"{end}_rep"), F.col("home").alias(f"{end}_home")).hint("merge"))
    apart = links.join(ends[0], F.col("a") == F.col("a_rep")).join(ends[1], F.col("b") == F.col("b_rep")).filter("a_home <> b_home")
    apart = stored(apart.select(F.col("a_home").alias("a"), F.col("b_home").alias("b")), "jaccard-joins")
    if apart.isEmpty():
        return homes
    found = components(apart)
    joined = homes.join(found.hint("merge"), F.col("home") == F.col("node"), "left")
    return stored(joined.select("rep", F.coalesce("component", "home").alias("home")), "jaccard-homes")


def _proposals(placed: DataFrame, parities: DataFrame, percent: int, most: int | None) -> DataFrame:
    """(x, p): pairs of a round, each once. Short lists propose all their pairs at once.

    Until the last round a long list is only looked at within its chunks. Then every set still outside the list's
    largest component meets all of the list; those inside it have nothing to ask each other.
    """
    shares = placed.groupBy("key", "home").agg(F.count(F.lit(1)).alias("n_home"))
    lists = shares.groupBy("key").agg(
        F.sum("n_home").alias("many"), F.count(F.lit(1)).alias("homes"), F.max(F.struct("n_home", "home")).alias("largest")
    )
    lists = lists.filter("homes > 1")
    outside = F.col("many") - F.col("largest.n_home")
    lists = stored(
        lists.select(
            F.col("key").alias("lkey"), "many", F.col("largest.home").alias("main"), _chunks(F.col("many")).alias("chunks"), _chunks(outside).alias("minor_chunks")
        ),
        "jaccard-lists",
    )
    mixed = placed.join(lists, F.col("key") == F.col("lkey")).join(parities, F.col("rep") == F.col("prep"))
    mixed = mixed.withColumn("minor", F.col("home") != F.col("main"))
    if most is not None:
        # One part for each chunk: everything in it is met, and what is outside the largest component asks as well.
        own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
        mixed = mixed.withColumns({"i": own, "j": F.lit(0), "side": F.when(F.col("minor"), 2).otherwise(0)})
    else:
        mixed = _dealt(mixed, "rep")
    mixed = mixed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    columns = mixed.select("key", "i", "j", "side", "many", "rep", "cluster", "home", "n", "pos", "parity")
    pairs = columns.mapInArrow(_pair_batches(percent, most), "a bigint, b bigint")
    return pairs.distinct().select(F.col("b").alias("x"), F.col("a").alias("p"))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Lower-cased (A-Z) words between white space; a document's set holds its distinct shingles of
    ``size`` words, or all its words as one if it has fewer. Two documents link when 100 * intersection
    is at least ``percent`` * union; component_id is the smallest doc_id reachable by links. Shingles
    and sets are told apart by 64-bit hashes; no pair is left out.

    Defined cases: null texts and texts without words have no shingles and link with nothing. A row
    without an id belongs to the component of the documents with its set, if there are any, and does
    not extend it otherwise. Rows that share an id are each judged by their own text. An empty table gives an empty
    result; other columns are not looked at.
    """
    rows = narrow(docs, id_col, text_col)
    described = stored(rows.mapInArrow(_describe_batches(size), "id bigint, n bigint, cls bigint, minima array<bigint>, parity binary, part int, cells binary"), "jaccard-sets")
    members = described.filter("part IS NULL").select("id", "n", "cls", "minima", "parity")
    classes = stored(
        members.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("rep"), F.first("minima").alias("minima"), F.first("parity").alias("parity")),
        "jaccard-classes",
    )
    named = classes.filter("rep IS NOT NULL")
    if named.groupBy("rep").count().filter("count > 1").count():
        return _of_rows(rows, size, percent)
    texts = rows.filter("id IS NOT NULL")

    pivots = stored(_pivots(named), "jaccard-pivots")
    derived = stored(compare(texts, pivots, size, percent), "jaccard-derived")
    clustered = derived.filter("difference <> X''")
    edges = [derived.filter("linked").select(F.col("x").alias("a"), F.col("p").alias("b"))]

    # Only pivots around which something is loose have anything to derive, and only what is loose asks.
    around = clustered.groupBy("p").agg(F.count_if(~F.col("linked")).alias("loose"), F.count(F.lit(1)).alias("many"))
    around = around.filter("loose > 0 AND many > 1").select(F.col("p").alias("ap"), _chunks(F.col("many")).alias("chunks"), _chunks(F.col("loose")).alias("minor_chunks"))
    around = stored(around, "jaccard-around")
    dealt = clustered.join(around, F.col("p") == F.col("ap")).withColumn("minor", ~F.col("linked")).drop("chunk")
    dealt = _dealt(dealt, "x").repartition("p", "i", "j").sortWithinPartitions("p", "i", "j")
    edges.append(dealt.select("p", "i", "j", "side", "x", "n_x", "missing", "n_p", "difference").mapInArrow(_derive_batches(percent), "a bigint, b bigint"))
    known = stored(edges[0].unionByName(edges[1]), "jaccard-links")
    homes = merged_homes(stored(named.select("rep", F.col("rep").alias("home")), "jaccard-homes"), known)

    cells = _frequencies(described)
    index = rows.mapInArrow(_prefix_batches(size, percent, cells), "key bigint, cls bigint, n bigint, pos bigint")
    shared = index.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(_shared_keys, "key bigint, cls bigint, n bigint, pos bigint")
    shared = stored(shared, "jaccard-index")
    cluster = named.join(clustered.select("x", "p"), F.col("rep") == F.col("x"), "left")
    cluster = cluster.join(homes.withColumnRenamed("rep", "hrep"), F.col("rep") == F.col("hrep")).select(
        F.col("cls").alias("ccls"), "rep", F.coalesce("p", "rep").alias("cluster"), "home"
    )
    entries = stored(shared.join(cluster, F.col("cls") == F.col("ccls")).select("key", "rep", "cluster", "home", "n", "pos"), "jaccard-entries")
    parities = named.select(F.col("rep").alias("prep"), "parity")
    compared = None
    for most in ROUNDS:
        if compared is None:  # short lists are done with after this round
            pairs = _proposals(entries, parities, percent, most)
            long = entries.groupBy("key").count().filter(F.col("count") > SHORT_LIST).select(F.col("key").alias("lkey"))
            entries = stored(entries.join(long, F.col("key") == F.col("lkey"), "left_semi").drop("home"), "jaccard-entries")
        else:
            now = homes.withColumnRenamed("rep", "hrep").hint("merge")
            pairs = _proposals(entries.join(now, F.col("rep") == F.col("hrep")).drop("hrep"), parities, percent, most)
            done = compared.select(F.col("x").alias("dx"), F.col("p").alias("dp"))
            pairs = pairs.join(done, (F.col("x") == F.col("dx")) & (F.col("p") == F.col("dp")), "left_anti")
        pairs = stored(pairs, "jaccard-candidates")
        compared = pairs if compared is None else compared.unionByName(pairs)
        across = compare(texts, pairs, size, percent)
        homes = merged_homes(homes, stored(across.filter("linked").select(F.col("x").alias("a"), F.col("p").alias("b")), "jaccard-links"))
    home_of = homes.withColumnRenamed("rep", "hrep")
    homes = stored(
        classes.join(home_of, F.col("rep") == F.col("hrep"), "left").select(F.col("cls").alias("hcls"), "home"),
        "jaccard-homes",
    )
    return members.join(homes.hint("merge"), F.col("cls") == F.col("hcls"), "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("home", "id").alias("component_id")
    )


def _of_rows(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The same where one id would stand for several sets: found by numbers in the order of the ids, then named by ids.

    Stores the texts twice more and shuffles them once.
    """
    own = numbered(rows, "id", nulls_last=True).withColumn("__row", F.expr("IF(id IS NULL, NULL, __row)"))
    found = stored(jaccard_components(own, "__row", "text", size, percent), "jaccard-of-rows")
    names = own.filter("id IS NOT NULL").select("__row", "id")
    for column in ("doc_id", "component_id"):
        name = names.select(F.col("__row").alias("__of"), F.col("id").alias("__name")).hint("merge")
        found = found.join(name, F.col(column) == F.col("__of"), "left").withColumn(column, F.col("__name")).drop("__of", "__name")
    return found.select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, each_row: bool = False
) -> DataFrame:
    """Of each component the document with the smallest id stays, all columns as they are.

    With ``each_row`` just one row of a component stays, also where ids are null (these count as
    largest) or repeat.
    """
    if each_row:
        return by_row(docs, id_col, lambda rows, row: keep_one_of_each(rows, row, text_col, size, percent), nulls_last=True)
    found = jaccard_components(docs, id_col, text_col, size, percent)
    more = stored(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)), "jaccard-dropped")
    return without(docs, more, id_col)
