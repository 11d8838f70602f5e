"""File trees: list, read and write application folders on executors.

Spark's own file sources skip empty files and every name that starts with ``_`` or ``.``
(``__init__.py`` among them), so trees are walked here instead. The walk is breadth first and
distributed: the folders of one depth are one DataFrame, listed in parallel, and what they hold is the
next depth. The unit of work is a folder, not an application, so an application that owns a third of
the estate is spread over as many tasks as it has folders; reading is spread again by bytes.

The root may be any path that all executors can reach: a mounted folder, or a URI that
``pyarrow.fs`` understands (``hdfs://``, ``s3://``, ``gs://``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfreight.schemas import LISTING, RAW_FILES
from wayfreight.session import shared_dir
from wayfreight.sources.files import select_sources
from wayfreight.sources.source_tree import plain_root as _plain_root

READ_TASK_BYTES = 128 << 20
READ_BATCH_BYTES = 16 << 20
READ_TASK_FILES = 10_000
LISTING_TASK_FOLDERS = 1_000
LISTING_TASKS_PER_CORE = 4


def _list_folders(root: str):
    """Batch function: (app_id, path) of folders -> one row per child. Links to folders are not followed."""

    def run(batches):
        import os

        import pyarrow as pa
        from pyarrow import fs

        schema = pa.schema(
            [("app_id", pa.string()), ("path", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("mtime", pa.float64()), ("error", pa.string())]
        )

        def local(folder):
            with os.scandir(folder) as found:
                for e in found:
                    if e.is_dir():
                        # A linked application is one; links further down could lead in a circle.
                        if folder == root or not e.is_symlink():
                            yield e.name, True, None, None
                        continue
                    try:
                        stat = e.stat()
                        yield e.name, False, stat.st_size, stat.st_mtime
                    except OSError:
                        yield e.name, False, None, None

        def remote(folder):
            for info in where.get_file_info(fs.FileSelector(folder)):
                is_dir = info.type == fs.FileType.Directory
                mtime = None if info.mtime is None else info.mtime.timestamp()
                yield info.base_name, is_dir, None if is_dir else info.size, mtime

        base, children = root, local
        if "://" in root:
            where, base = fs.FileSystem.from_uri(root)
            children = remote

        def rows(batch):
            for app_id, path in zip(batch["app_id"].to_pylist(), batch["path"].to_pylist()):
                folder = "/".join(p for p in (base, app_id, path) if p)
                try:
                    found = list(children(folder))
                except OSError as problem:
                    if not app_id:
                        raise  # the root itself
                    yield {"app_id": app_id, "path": path, "is_dir": None, "size": None, "mtime": None, "error": type(problem).__name__}
                    continue
                for name, is_dir, size, mtime in found:
                    if not app_id:
                        # Children of the root are the applications; loose files there belong to none.
                        if is_dir:
                            yield {"app_id": name, "path": "", "is_dir": True, "size": None, "mtime": None}
                        continue
                    yield {
                        "app_id": app_id,
                        "path": f"{path}/{name}" if path else name,
                        "is_dir": is_dir,
                        "size": size,
                        "mtime": mtime,
                    }

        for batch in batches:
            pending = []
            for row in rows(batch):
                pending.append(row)
                if len(pending) == 10_000:
                    yield pa.RecordBatch.from_pylist(pending, schema=schema)
                    pending = []
            yield pa.RecordBatch.from_pylist(pending, schema=schema)

    return run


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file and folder below ``root/<app_id>/``: the listing only, no file is opened.

    Each depth is written to the shared folder before the next one starts, so a lost executor costs
    at most the depth in progress and the result is a plain table. The loop runs once per depth.
    """
    root = _plain_root(root)
    work = shared_dir(spark, "tree")
    folders = spark.range(1).select(F.lit("").alias("app_id"), F.lit("").alias("path"))
    count, depth = 1, 0
    while count:
        tasks = min(count, max(LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism, -(-count // LISTING_TASK_FOLDERS)))
        at = f"{work}/depth={depth}"
        folders.repartition(tasks).mapInArrow(_list_folders(root), LISTING).write.parquet(at)
        folders = spark.read.schema(LISTING).parquet(at).filter("is_dir").select("app_id", "path")
        count = folders.count()
        depth += 1
    return spark.read.schema(LISTING).parquet(*[f"{work}/depth={d}" for d in range(depth)])


def save_listing(listing: DataFrame, at: str, rows_per_task: int = READ_TASK_FILES) -> None:
    """Write a listing for the ``listing`` option of the ``source_tree`` source; a file of it is a task's share."""
    listing.write.option("maxRecordsPerFile", rows_per_task).parquet(at)


def apps_of(listing: DataFrame) -> DataFrame:
    """All application folders, empty ones included."""
    return listing.filter((F.col("path") == "") & F.col("is_dir")).select("app_id")


def unlisted(listing: DataFrame) -> DataFrame:
    """Folders that could not be listed, as warnings: what they hold is not part of the estate."""
    return listing.filter("error IS NOT NULL").select("app_id", F.lit("folder_unreadable").alias("code"), "path", F.col("error").alias("detail"))


def files_of(listing: DataFrame) -> DataFrame:
    return listing.filter(~F.col("is_dir"))


def estate_scan(listing: DataFrame) -> DataFrame:
    """The files the estate reads (Python, SQL, requirements, root manifests), before opening any."""
    return select_sources(files_of(listing)).select("app_id", "path", "kind", "size")


def stage_listing(listing: DataFrame) -> DataFrame:
    """Files and bytes per application, from the listing alone."""
    return files_of(listing).groupBy("app_id").agg(
        F.count("*").alias("files"), F.sum("size").alias("total_bytes")
    )


def _read_files(root: str, batch_bytes: int = READ_BATCH_BYTES):
    """Batch function: (app_id, path) -> (app_id, path, content), in batches of bounded bytes."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        schema = pa.schema([("app_id", pa.string()), ("path", pa.string()), ("content", pa.binary())])
        if "://" in root:
            where, base = fs.FileSystem.from_uri(root)
        else:
            where, base = fs.LocalFileSystem(), root

        def content(app_id, path):
            try:
                with where.open_input_stream(f"{base}/{app_id}/{path}", compression=None) as source:
                    return source.read()
            except OSError:
                return None  # becomes an unreadable row downstream

        for batch in batches:
            rows, held = [], 0
            for app_id, path in zip(batch["app_id"].to_pylist(), batch["path"].to_pylist()):
                data = content(app_id, path)
                rows.append({"app_id": app_id, "path": path, "content": data})
                held += len(data or b"")
                if held >= batch_bytes:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_tree(spark: SparkSession, root: str, listing: DataFrame | None = None) -> DataFrame:
    """``app_id, path, content binary`` of the files worth reading.

    Rows are dealt out evenly over enough tasks for their number and total size, whatever application
    they belong to. Write the result to a table once and run everything else from that.
    """
    listing = list_tree(spark, root) if listing is None else listing
    chosen = estate_scan(listing)
    total, many = chosen.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // READ_TASK_BYTES), -(-many // READ_TASK_FILES))
    return chosen.select("app_id", "path").repartition(tasks).mapInArrow(_read_files(_plain_root(root)), RAW_FILES)


def _write_files(root: str):
    """Batch function: (app_id, path, content) -> files on disk; yields how many were written.

    A file appears under its name only when complete, so a task that is retried or run twice does no
    harm.
    """

    def run(batches):
        import os
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        local = "://" not in root
        where, base = (fs.LocalFileSystem(), root) if local else fs.FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            n = 0
            for app_id, path, content in zip(*(batch[c].to_pylist() for c in ("app_id", "path", "content"))):
                target = f"{base}/{app_id}/{path}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    where.create_dir(folder, recursive=True)
                    made.add(folder)
                draft = f"{target}.{uuid.uuid4().hex}.part" if local else target
                with where.open_output_stream(draft, compression=None) as sink:
                    sink.write(content)
                if local:
                    os.replace(draft, target)
                n += 1
            yield pa.RecordBatch.from_pydict({"written": pa.array([n], pa.int64())})

    return run


def write_tree(files: DataFrame, root: str) -> int:
    """Write ``app_id, path, content`` rows as files below ``root``; returns how many."""
    rows = files.select("app_id", "path", F.col("content").cast("binary").alias("content"))
    written = rows.mapInArrow(_write_files(_plain_root(root)), "written bigint")
    return written.agg(F.coalesce(F.sum("written"), F.lit(0)).alias("n")).first()["n"]
