"""Incremental load of new files into a table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType


def _as_pattern(spark: SparkSession, source: str) -> str:
    """A single file as a pattern that only it fits: the streaming source takes patterns and folders, no files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if found and len(found) == 1 and found[0].isFile() and not any(c in source for c in "*?[{"):
        return f"{source[:-1]}[{source[-1]}]"
    return source


def copy_into(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema: StructType | str,
    file_format: str = "parquet",
    name_pattern: str | None = None,
    files_per_batch: int = 1000,
    **options: str,
) -> None:
    """Load the files of ``source`` that ``target`` has not seen yet, and return when all are in.

    A file is loaded once: the checkpoint remembers it, so a rerun adds nothing and a run after a
    crash picks up where it stopped. Append only and stateless. ``checkpoint`` and ``target`` must be
    on shared storage. Each micro-batch is bounded by ``files_per_batch``, so a large backlog becomes
    several jobs instead of one.

    ``source`` is a file, a folder, or a pattern of either. A source without any file that fits is an
    error and not an empty load.
    """
    there = spark.read.format(file_format).schema(schema)
    if name_pattern:
        there = there.option("pathGlobFilter", name_pattern)
    if there.options(**options).load(source).isEmpty() and not there.options(**options).load(source).inputFiles():
        raise FileNotFoundError(f"no file to load in {source}")
    reader = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if name_pattern:
        reader = reader.option("pathGlobFilter", name_pattern)
    for key, value in options.items():
        reader = reader.option(key, value)
    query = (
        reader.load(_as_pattern(spark, source))
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
