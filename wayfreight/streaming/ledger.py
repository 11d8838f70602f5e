"""Incremental load with a ledger: each file once, corrupt rows set apart, batches that can be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfreight.streaming.load import _as_pattern

CORRUPT = "_corrupt"
#: Formats whose reader can set a row apart that does not fit the schema.
TOLERANT = ("json", "csv")
LEDGER = "batch bigint, file string, bytes bigint, modified timestamp, loaded bigint, corrupt bigint"


def copy_with_ledger(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema: StructType | str,
    file_format: str = "json",
    files_per_batch: int = 1000,
    **options: str,
) -> None:
    """Load the files of ``source`` that were not loaded before; return when all are in.

    Below ``target`` a batch writes its rows to ``rows/batch=N/fits=...`` and, once they are complete, one row
    for each of its files to ``ledger/batch=N``. Both replace what an earlier try of the same batch left, and
    Spark repeats a batch that did not end with the same files under the same number: after a crash
    anywhere no row is twice or missing. A batch counts only once the ledger names it; :func:`loaded_rows` and
    :func:`quarantine` read no other.

    Each file is read once and its counts are taken from what was written. A row that does not fit the
    schema is kept whole with ``fits=false``, for JSON and CSV; other formats stop the load. A file
    without rows has no ledger row. A file that is replaced under its name is not loaded again:
    :func:`replaced_files` names it, and it comes in under a new name. ``source`` without any file loads nothing.
    All folders must be on shared storage.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    clash = {f.name.lower() for f in fields} & {"file", "bytes", "modified", "fits", "batch", CORRUPT}
    if clash:
        raise ValueError(f"the load adds columns of its own that the schema has too: {sorted(clash)}")
    reader = spark.readStream.format(file_format).option("maxFilesPerTrigger", files_per_batch).options(**options)
    if file_format in TOLERANT:
        kept = StructType([*fields, *StructType.fromDDL(f"{CORRUPT} string")])
        reader = reader.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        rows = reader.load(_as_pattern(spark, source)).withColumn("fits", F.col(CORRUPT).isNull())
    else:
        rows = reader.schema(fields).load(_as_pattern(spark, source)).withColumns({CORRUPT: F.lit(None).cast("string"), "fits": F.lit(True)})
    rows = rows.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )
    query = rows.writeStream.foreachBatch(_load_batch(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _load_batch(target: str) -> Callable[[DataFrame, int], None]:
    def load(rows: DataFrame, number: int) -> None:
        at = f"{target}/rows/batch={number}"
        rows.write.mode("overwrite").partitionBy("fits").parquet(at)
        written = rows.sparkSession.read.schema(rows.schema).parquet(at)
        _enter(count_files(written), f"{target}/ledger/batch={number}")

    return load


def count_files(written: DataFrame) -> DataFrame:
    """One row a file; counts combine before the shuffle, so a file of any size is one row a task."""
    return written.groupBy("file").agg(
        F.max("bytes").alias("bytes"), F.max("modified").alias("modified"), F.count_if("fits").alias("loaded"), F.count_if(~F.col("fits")).alias("corrupt")
    )


def _enter(entries: DataFrame, at: str) -> None:
    entries.write.mode("overwrite").parquet(at)


def ledger(spark: SparkSession, target: str) -> DataFrame:
    """One row for each file that was loaded: batch, file, bytes, modified, loaded, corrupt. Empty before any load."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/ledger")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{target}/ledger").select("batch", "file", "bytes", "modified", "loaded", "corrupt")


def _entered(spark: SparkSession, target: str, schema: StructType | str) -> DataFrame:
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    stored = StructType([*fields, *StructType.fromDDL(f"{CORRUPT} string, file string, fits boolean, batch bigint")])
    batches = ledger(spark, target).select("batch").distinct()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/rows")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stored)
    return spark.read.schema(stored).parquet(f"{target}/rows").join(batches, "batch", "left_semi")


def loaded_rows(spark: SparkSession, target: str, schema: StructType | str) -> DataFrame:
    """The rows that fit, of all batches that the ledger names."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return _entered(spark, target, fields).filter("fits").select(*fields.names)


def quarantine(spark: SparkSession, target: str, schema: StructType | str) -> DataFrame:
    """The rows that did not fit, as they stood, with their file and batch."""
    return _entered(spark, target, schema).filter("NOT fits").select("batch", "file", F.col(CORRUPT).alias("row"))


def replaced_files(spark: SparkSession, source: str, target: str, **options: str) -> DataFrame:
    """Files that were loaded and since then have another size or time: (file, bytes, modified). No file is opened."""
    now = spark.read.format("binaryFile").options(**options).load(source)
    now = now.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    then = ledger(spark, target).select("file", F.col("bytes").alias("old_bytes"), F.col("modified").alias("old_modified"))
    return now.join(then, "file").filter("bytes <> old_bytes OR modified <> old_modified").select("file", "bytes", "modified")
