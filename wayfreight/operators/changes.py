"""What changed in an estate between two scans, without comparing what stayed the same.

A snapshot keeps, beside the files, two digests of every folder: of the files in it, and of everything below it.
The digest of a folder is the exclusive or of hashes of its files' names and digests, so it combines
before a shuffle whatever the folder's size, and it does not depend on where the folder lies. Two snapshots are
compared from the applications down: a folder whose digests agree is left alone with all that is below it, and only
the files of folders whose own files differ are compared one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfreight.session import shared_dir

FILES = "app_id string, folder string, path string, size bigint, digest string"
FOLDERS = "app_id string, folder string, parent string, below1 bigint, below2 bigint, own1 bigint, own2 bigint, files bigint, depth int"
DIGESTS = ("below1", "below2", "own1", "own2", "files")


@dataclass(frozen=True)
class Snapshot:
    """A stored snapshot: ``files`` and, by depth, ``folders`` below one address."""

    at: str

    def files(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(FILES).parquet(f"{self.at}/files")

    def folders(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(FOLDERS).option("basePath", f"{self.at}/folders").parquet(f"{self.at}/folders")


def scanned(raw: DataFrame) -> DataFrame:
    """``app_id, path, size, digest`` of files whose bytes are there."""
    return raw.select("app_id", "path", F.octet_length("content").cast("bigint").alias("size"), F.md5("content").alias("digest"))


def listed(listing: DataFrame) -> DataFrame:
    """The same from a listing alone: size and time stand for the content, as they do for synchronising tools."""
    stamp = F.concat_ws("@", F.col("size").cast("string"), F.col("mtime").cast("string"))
    return listing.filter("NOT is_dir").select("app_id", "path", "size", stamp.alias("digest"))


def folder_of(path: Column) -> Column:
    """What stands before the last slash; empty for files of the application's own folder."""
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise("")


def ancestors(path: Column) -> Column:
    """Every folder above a file, the application's own (empty) first."""
    parts = F.split(path, "/")
    inner = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(path.contains("/"), inner).otherwise(F.array(F.lit("")))


def folder_digests(files: DataFrame) -> DataFrame:
    """One row for each folder that has files below it: digests of all of them and of its own.

    A file counts for each folder above it, by its path from there. Counting combines map-side, so a task sends one row for each
    folder that it met, and a folder with a third of all files is no hot key.
    """
    above = files.select("app_id", "path", "digest", F.explode(ancestors(F.col("path"))).alias("folder"))
    inner = F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, char_length(folder) + 2)"))
    named = above.withColumns({"inner": inner, "own": folder_of(F.col("path")) == F.col("folder")})

    def hashed(seed: int) -> Column:
        return F.xxhash64(F.lit(seed), "inner", "digest")

    def own(seed: int) -> Column:
        return F.coalesce(F.bit_xor(F.when(F.col("own"), hashed(seed))), F.lit(0).cast("bigint"))

    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    return (
        named.groupBy("app_id", "folder")
        .agg(
            F.bit_xor(hashed(1)).alias("below1"),
            F.bit_xor(hashed(2)).alias("below2"),
            own(1).alias("own1"),
            own(2).alias("own2"),
            F.count(F.lit(1)).alias("files"),
        )
        .select("app_id", "folder", F.when(F.col("folder") != "", folder_of(F.col("folder"))).alias("parent"), *DIGESTS, depth.cast("int").alias("depth"))
    )


def take_snapshot(files: DataFrame, at: str) -> Snapshot:
    """Store ``app_id, path, size, digest`` rows with the digests of their folders."""
    kept = files.select("app_id", folder_of(F.col("path")).alias("folder"), "path", "size", "digest")
    kept.write.parquet(f"{at}/files")
    stored = files.sparkSession.read.schema(FILES).parquet(f"{at}/files")
    folder_digests(stored).write.partitionBy("depth").parquet(f"{at}/folders")
    return Snapshot(at)


def _kept(df: DataFrame, purpose: str) -> DataFrame:
    at = shared_dir(df.sparkSession, purpose)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def changed_folders(spark: SparkSession, old: Snapshot, new: Snapshot) -> DataFrame:
    """(app_id, folder, own_changed) of folders with a difference in or below them, from the top down.

    Each depth is compared only within the folders that were found to differ one depth higher up, and is
    read from its own part of the snapshots; the walk ends with the deepest difference. ``own_changed`` says whether the folder's own
    files differ, or only some further down.
    """
    found: list[DataFrame] = []
    depth = 0
    while True:
        sides = []
        for snapshot in (old, new):
            side = snapshot.folders(spark).filter(F.col("depth") == depth)
            if found:
                around = found[-1].select(F.col("app_id").alias("in_app"), F.col("folder").alias("in_folder"))
                side = side.join(around, (F.col("app_id") == F.col("in_app")) & (F.col("parent") == F.col("in_folder")), "left_semi")
            sides.append(side.select("app_id", "folder", *DIGESTS))
        before, after = (F.struct(*[F.col(f"{s}.{c}") for c in DIGESTS]) for s in ("old", "new"))
        none = F.lit(0).cast("bigint")  # of a folder that is not there, or has no files of its own
        own = [F.struct(*[F.coalesce(f"{s}.{c}", none) for c in ("own1", "own2")]) for s in ("old", "new")]
        met = sides[0].alias("old").join(sides[1].alias("new"), ["app_id", "folder"], "full")
        there = F.col("old.files").isNotNull() & F.col("new.files").isNotNull()
        differ = met.filter(~there | (before != after)).select("app_id", "folder", (own[0] != own[1]).alias("own_changed"))
        level = _kept(differ, "changed-folders")
        if level.isEmpty():
            break
        found.append(level)
        depth += 1
    if not found:
        return level
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows


def estate_changes(spark: SparkSession, old: Snapshot, new: Snapshot, folders: DataFrame | None = None) -> DataFrame:
    """One row for each difference: app_id, path, change, from_app_id, from_path.

    ``change`` is added, removed, changed, or moved. A file has moved where a single removed and a single
    added file of the estate share size and digest; it is one row then, with where it came from. Where several share
    them, which went where cannot be known, and they stay added and removed. Contents are counted, not gathered, so copies of
    one file by the million are no hot key. ``folders`` are those of :func:`changed_folders`, if they are at hand.
    """
    folders = changed_folders(spark, old, new) if folders is None else folders
    wanted = folders.filter("own_changed").select(F.col("app_id").alias("in_app"), F.col("folder").alias("in_folder"))
    within = (F.col("app_id") == F.col("in_app")) & (F.col("folder") == F.col("in_folder"))
    before, after = (
        s.files(spark).join(wanted, within, "left_semi").select("app_id", "path", F.col("size").alias(f"{n}_size"), F.col("digest").alias(f"{n}_digest"))
        for s, n in ((old, "old"), (new, "new"))
    )
    was, now = F.struct("old_size", "old_digest"), F.struct("new_size", "new_digest")
    met = before.withColumn("in_old", F.lit(True)).join(after.withColumn("in_new", F.lit(True)), ["app_id", "path"], "full")
    change = (
        F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~was.eqNullSafe(now), "changed")
    )
    differences = _kept(
        met.select(
            "app_id", "path", change.alias("change"), F.coalesce("new_size", "old_size").alias("size"), F.coalesce("new_digest", "old_digest").alias("digest")
        ).filter("change IS NOT NULL"),
        "changed-files",
    )
    place = F.struct("app_id", "path")

    def only(what: str) -> Column:
        return F.max(F.when(F.col("change") == what, place)).alias(what)

    once = differences.filter("change <> 'changed' AND digest IS NOT NULL").groupBy("size", "digest")
    moves = (
        once.agg(F.count_if(F.col("change") == "removed").alias("gone"), F.count_if(F.col("change") == "added").alias("come"), only("removed"), only("added"))
        .filter("gone = 1 AND come = 1")
        .select(
            F.col("added.app_id").alias("app_id"), F.col("added.path").alias("path"), F.lit("moved").alias("change"),
            F.col("removed.app_id").alias("from_app_id"), F.col("removed.path").alias("from_path"),
        )
    )
    moves = _kept(moves, "moved-files")
    ends = moves.select(F.col("app_id").alias("m_app"), F.col("path").alias("m_path")).unionByName(
        moves.select(F.col("from_app_id").alias("m_app"), F.col("from_path").alias("m_path"))
    )
    none = F.lit(None).cast("string")
    rest = differences.join(ends, (F.col("app_id") == F.col("m_app")) & (F.col("path") == F.col("m_path")), "left_anti")
    # A path that was given up and taken again by another file is changed, and so is no end of a move.
    return rest.select("app_id", "path", "change", none.alias("from_app_id"), none.alias("from_path")).unionByName(moves)
