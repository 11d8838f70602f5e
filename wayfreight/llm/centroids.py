"""Clustering of integer vectors around centroids, exact, with dot products that are kept up to date.

A vector's squared distance from a centroid is |x|^2 - 2 x.c + |c|^2, so only the products x.c have to
follow the centroids. They are whole numbers and stay exact: when a centroid moves, each product
changes by the sum over those components that moved. In late rounds few do. Products, vectors and
clusters are one table, written anew each round by a pass without a shuffle; the sums of the clusters are a
few extra rows that each task appends to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfreight.session import drop_dir, shared_dir

#: Components beyond this after scaling are refused: squared distances would not fit a long.
LARGEST = 1 << 27

_STATE = "vec_id bigint, x binary, dots binary, cluster int, distance bigint, part int, n bigint, sums array<bigint>, inertia bigint"


def _integer_batches(dims: int, scale: int):
    """Kept vectors as little-endian 32-bit integers; those with other lengths, nulls, NaN or infinities go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            values, at = lists.values, lists.offsets.to_numpy().astype(np.int64)
            bad = np.zeros(len(values) + 1, np.int64)
            numbers = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            np.cumsum(~np.isfinite(numbers), out=bad[1:])
            good = (np.diff(at) == dims) & (bad[at[1:]] == bad[at[:-1]])
            if lists.null_count:
                good &= ~np.asarray(lists.is_null())
            rows = np.flatnonzero(good)
            if not len(rows):
                continue
            x = np.floor(scale * numbers[at[rows][:, None] + np.arange(dims)])
            if np.abs(x).max(initial=0) > LARGEST:
                raise ValueError(f"vector components beyond {LARGEST} after scaling have no exact squared distance in 64 bits")
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows)), _packed(x.astype("<i4"))], names=["vec_id", "x"]
            )

    return run


def _packed(table: np.ndarray) -> pa.Array:
    """Each row of a table of integers as bytes."""
    width = table.shape[1] * table.itemsize
    ends = np.arange(len(table) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(table).tobytes())])


def _unpacked(column: pa.Array, kind: str, width: int) -> np.ndarray:
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), width)


def exact_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x @ c in whole numbers; by floating point where every partial sum is a whole number it can hold."""
    if x.shape[1] * float(np.abs(x).max(initial=0)) * float(np.abs(c).max(initial=0)) < 2**53:
        return (x.astype(np.float64) @ c.astype(np.float64)).astype(np.int64)
    return x.astype(np.int64) @ c.astype(np.int64)


def _assign_batches(dims: int, now: np.ndarray, before: np.ndarray | None):
    """Products brought from the centroids ``before`` to those of ``now``, and the nearest of them.

    At the end the task's sums by cluster, one row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(now)
        squares = (now * now).sum(axis=1)
        sums, counts, inertia = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        moved = None if before is None else now - before
        schema = pa.schema(
            [("vec_id", pa.int64()), ("x", pa.binary()), ("dots", pa.binary()), ("cluster", pa.int32()), ("distance", pa.int64()),
             ("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("inertia", pa.int64())]
        )
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unpacked(batch.column("x"), "<i4", dims)
            if moved is None:
                dots = exact_products(x, now.T)
            else:
                dots = _unpacked(batch.column("dots"), "<i8", k).copy()
                for c in np.flatnonzero(moved.any(axis=1)):
                    changed = np.flatnonzero(moved[c])
                    dots[:, c] += exact_products(x[:, changed], moved[c][changed])
            beyond = squares - 2 * dots  # the distance but for |x|^2
            cluster = beyond.argmin(axis=1)  # the first of equals
            wide = x.astype(np.int64)
            distance = beyond[np.arange(len(x)), cluster] + (wide * wide).sum(axis=1)
            for c in np.unique(cluster):
                mine = cluster == c
                sums[c] += wide[mine].sum(axis=0)
                counts[c] += mine.sum()
                inertia[c] += distance[mine].sum()
            none = pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), _packed(dots.astype("<i8")), pa.array(cluster.astype(np.int32)), pa.array(distance),
                 pa.nulls(len(x), pa.int32()), none, pa.nulls(len(x), pa.list_(pa.int64())), none],
                schema=schema,
            )
        held = np.flatnonzero(counts)
        if len(held):
            none = pa.nulls(len(held), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, pa.nulls(len(held), pa.binary()), pa.nulls(len(held), pa.binary()), pa.nulls(len(held), pa.int32()), none,
                 pa.array(held.astype(np.int32)), pa.array(counts[held]), pa.array(sums[held].tolist(), pa.list_(pa.int64())), pa.array(inertia[held])],
                schema=schema,
            )

    return run


def _sums(state: DataFrame, k: int, dims: int) -> tuple[list[int], list[list[int]], list[int]]:
    """Vectors, component sums and inertia by cluster: the tasks' rows added up, at most k * dims of them."""
    parts = state.filter("part IS NOT NULL").select("part", "n", "sums", "inertia")
    wide = F.lit(0).cast("decimal(38,0)")
    totals = parts.groupBy("part").agg(
        F.sum("n"), F.sum(wide + F.col("inertia")), *[F.sum(wide + F.get("sums", F.lit(j))) for j in range(dims)]
    )
    counts, sums, inertia = [0] * k, [[0] * dims for _ in range(k)], [0] * k
    for part, n, spread, *total in totals.collect():
        counts[part], inertia[part], sums[part] = n, int(spread), [int(t) for t in total]
    return counts, sums, inertia


def first_centroids(vectors: DataFrame, k: int, dims: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest digests of seed and id, in the order of these."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    chosen = vectors.select(F.sha2(key.cast("binary"), 256).alias("sha"), "x").orderBy("sha", "x").limit(k).collect()
    return np.array([np.frombuffer(bytes(x), "<i4") for _, x in chosen], np.int64).reshape(len(chosen), dims)


def _write(spark: SparkSession, df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    at = shared_dir(spark, purpose)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at), at


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = 64,
    k: int = 8,
    rounds: int = 10,
    scale: int = 1024,
    seed: int = 3,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Vectors of exactly ``dims`` components, none null or not finite, are kept; a component x becomes
    floor(scale * x). Centroids start as the k vectors whose ids hash lowest. Each round assigns every
    vector to its nearest centroid (of equals the smaller number) and moves every centroid that has
    vectors to their mean, rounded down by component; after the last round vectors are assigned once
    more. All of it is exact in whole numbers, so results hang neither on order nor on partitions. When no
    centroid moves, the rounds that are left would repeat themselves and are skipped.

    A round reads one table and writes the next in the shared folder, then drops the one before: two
    exist at a time, and a lost executor costs tasks of one round. To the driver come k rows of sums.

    Defined cases: fewer than k kept vectors make fewer clusters, none an empty result. A null id hashes as
    the empty text; rows that repeat an id are vectors of their own. Components beyond ``LARGEST`` after
    scaling stop the job, as their distances would not fit a long. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    kept, at = _write(spark, rows.mapInArrow(_integer_batches(dims, scale), "vec_id bigint, x binary"), "centroids-vectors")
    now = first_centroids(kept, k, dims, seed)
    k = len(now)
    if not k:
        return spark.createDataFrame(
            [], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        )
    before, state = None, kept.select("vec_id", "x")
    for left in range(rounds, -1, -1):
        done, after = _write(spark, state.mapInArrow(_assign_batches(dims, now, before), _STATE), "centroids-state")
        drop_dir(spark, at)
        at = after
        counts, sums, inertia = _sums(done, k, dims)
        if not left:
            break
        moved = np.array([[t // n for t in total] if n else list(c) for n, total, c in zip(counts, sums, now.tolist())], np.int64)
        if (moved == now).all():
            break
        before, now = now, moved
        state = done.filter("part IS NULL").select("vec_id", "x", "dots")
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    by_cluster = F.col("cluster") + 1
    return done.filter("part IS NULL").select(
        "vec_id",
        "cluster",
        "distance",
        F.element_at(F.array(*[F.lit(i).cast("bigint") for i in inertia]), by_cluster).alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("bigint").alias("inertia"),
        F.element_at(F.array(*[F.lit(n) for n in names]), by_cluster).alias("centroid_sha256"),
    )
