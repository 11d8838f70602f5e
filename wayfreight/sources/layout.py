"""The two fact tables stored for their join: buckets by order, partitions by year.

Lines and orders are dealt into the same number of buckets by the same key and sorted in them, so the join reads bucket
beside bucket and no line is shuffled again, whichever query comes. The year of an order is stored with its lines too, so
that a range of years prunes both sides. Orders carry the region of their customer; a customer who moves
calls for a new load of orders. Customers are no bucket key: one of them may own a third of all lines,
and a bucket is one task.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfreight.session import shared_dir
from wayfreight.sources.tables import net_revenue, table

#: Bytes of the stored tables' sources, and rows of both, that make one bucket, over all years. What a task sorts goes by
#: rows: files of values that repeat hold ten times as many in a byte.
BUCKET_BYTES = 256 << 20
BUCKET_ROWS = 2_000_000
LINES = ["l_orderkey", "l_partkey", "l_extendedprice", "l_discount"]


class Layout(NamedTuple):
    lines: str
    orders: str
    buckets: int


def _bytes(spark: SparkSession, path: str) -> int:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()


def _buckets(spark: SparkSession, data_dir: str) -> int:
    names = ("orders", "lineitem")
    size = sum(_bytes(spark, f"{data_dir}/{name}.parquet") for name in names)
    many = sum(table(spark, data_dir, name).count() for name in names)  # from the footers, no column is read
    return max(1, -(-size // BUCKET_BYTES), -(-many // BUCKET_ROWS))


def write_layout(spark: SparkSession, data_dir: str, buckets: int | None = None) -> Layout:
    """Store lines and orders as two tables with names of their own in the catalog, files in the shared folder.

    Each bucket is written by one task, so a table has one file for each bucket and year. Lines without a known order have
    no year and are left out, as every query over the fact leaves them out.
    """
    buckets = buckets or _buckets(spark, data_dir)
    name = uuid.uuid4().hex
    layout = Layout(f"lines_{name}", f"orders_{name}", buckets)

    orders = table(spark, data_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.year("o_orderdate").alias("year"))
    homes = (
        table(spark, data_dir, "customer")
        .join(table(spark, data_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(table(spark, data_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("c_custkey", F.col("r_name").alias("region"))
    )
    _save(orders.join(homes, F.col("o_custkey") == F.col("c_custkey"), "left").drop("c_custkey"), layout.orders, "o_orderkey", buckets)

    years = orders.select("o_orderkey", "year").repartition(buckets, "o_orderkey")
    lines = table(spark, data_dir, "lineitem").select(*LINES).repartition(buckets, "l_orderkey")
    _save(lines.hint("merge").join(years, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey"), layout.lines, "l_orderkey", buckets)
    return layout


def _save(rows: DataFrame, name: str, key: str, buckets: int) -> None:
    dealt = rows.repartition(buckets, key)
    at = shared_dir(rows.sparkSession, "layout")
    dealt.write.partitionBy("year").bucketBy(buckets, key).sortBy(key).option("path", at).format("parquet").saveAsTable(name)


def stored_sales(spark: SparkSession, layout: Layout, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """The sales fact but for the product's name, from the stored tables; a range of years leaves other partitions unread."""
    lines, orders = spark.table(layout.lines), spark.table(layout.orders)
    if first_year is not None:
        lines, orders = (t.filter(F.col("year") >= first_year) for t in (lines, orders))
    if last_year is not None:
        lines, orders = (t.filter(F.col("year") <= last_year) for t in (lines, orders))
    fact = lines.drop("year").hint("merge").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return fact.select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        "region",
        "year",
        F.month("o_orderdate").alias("month"),
        net_revenue().alias("revenue"),
        F.lit(1).alias("order_count"),
        F.col("o_orderdate").alias("order_date"),
    )


def drop_layout(spark: SparkSession, layout: Layout) -> None:
    """Forget both tables; their files stay until the shared folder is cleared."""
    for name in (layout.lines, layout.orders):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
