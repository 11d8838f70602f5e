"""The sales rollup as a stored, mergeable cube whose distinct customers stay exact at every level.

Sums can be added up again, distinct counts cannot. So the cube keeps who the customers are, as bitmaps: one row
for each year, month, region and block of 32,768 customer numbers, with the sums and the customers of that block.
Coarser levels come from sums of sums and from bitmaps laid over each other, and the fact is not read again.
New sales are new rows of the same form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfreight.session import shared_dir

LEVELS = ("year", "month", "region")
CUBE = "year int, month int, region string, block bigint, total_revenue decimal(28,2), total_orders bigint, lines bigint, customers binary"


def customer_numbers(sales: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(customer_id, customer_no): a number for each customer, those of ``known`` kept and new ones after them.

    For ids that are no numbers, or sparse ones: bitmaps are small when numbers are dense. All ids are sorted
    once; a number is the place in its sorted partition plus the ids in partitions before.
    """
    spark = sales.sparkSession
    ids = sales.select("customer_id").filter("customer_id IS NOT NULL").distinct()
    first = 0
    if known is not None:
        ids = ids.join(known, "customer_id", "left_anti")
        first = known.agg(F.coalesce(F.max("customer_no") + 1, F.lit(0))).first()[0]
    at = shared_dir(spark, "customers")
    placed = ids.orderBy("customer_id").select("customer_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    placed.write.parquet(at)
    placed = spark.read.schema(placed.schema).parquet(at)
    starts = []
    for part, low, n in sorted(placed.groupBy("part").agg(F.min("place"), F.count(F.lit(1))).collect()):
        starts.append((part, first - low))
        first += n
    shifts = spark.createDataFrame(starts, "part int, shift bigint")  # one row for each sorted partition
    fresh = placed.join(F.broadcast(shifts), "part").select("customer_id", (F.col("place") + F.col("shift")).alias("customer_no"))
    return fresh if known is None else known.select("customer_id", "customer_no").unionByName(fresh)


def sales_cube(sales: DataFrame, number: Column | str | None = None) -> DataFrame:
    """The cube of some sales. ``number`` is a customer's number, from 0; by default the customer_id read as one.

    Lines are first added up by customer, which spreads a region with a third of all rows over its customers; then
    each task lays the customers of a block into one bitmap, so few rows of some KB reach the second exchange.
    NULL years, months and regions are groups like others; a NULL customer belongs to no bitmap, and an id that is no number
    is an error, not a customer left out.
    """
    own = F.col("customer_id").try_cast("bigint") if number is None else F.col(number) if isinstance(number, str) else number
    checked = F.when(own >= 0, own).otherwise(F.when(F.col("customer_id").isNotNull(), F.raise_error(F.lit("a customer without a number from 0"))).cast("bigint"))
    by_customer = (
        sales.select(*LEVELS, checked.alias("customer_no"), "revenue", "order_count")
        .groupBy(*LEVELS, "customer_no")
        .agg(F.sum("revenue").alias("revenue"), F.sum("order_count").alias("orders"), F.count(F.lit(1)).alias("lines"))
    )
    numbered = by_customer.withColumns(
        {"block": F.bitmap_bucket_number("customer_no"), "bit": F.bitmap_bit_position("customer_no")}
    )
    return numbered.groupBy(*LEVELS, "block").agg(
        F.sum("revenue").cast("decimal(28,2)").alias("total_revenue"),
        F.sum("orders").alias("total_orders"),
        F.sum("lines").alias("lines"),
        F.when(F.col("block").isNotNull(), F.bitmap_construct_agg("bit")).alias("customers"),
    )


def merge_cubes(cubes: Sequence[DataFrame]) -> DataFrame:
    """One cube of sales that were counted apart: sums added, bitmaps of the same block laid over each other."""
    rows = cubes[0]
    for more in cubes[1:]:
        rows = rows.unionByName(more)
    return _added(rows, LEVELS)


def _added(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by, "block").agg(
        F.sum("total_revenue").cast("decimal(28,2)").alias("total_revenue"),
        F.sum("total_orders").alias("total_orders"),
        F.sum("lines").alias("lines"),
        F.when(F.col("block").isNotNull(), F.bitmap_or_agg("customers")).alias("customers"),
    )


def roll_up(cube: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Revenue, orders and exact distinct customers by any of year, month and region; one row for all without them.

    Bitmaps are laid over each other block by block, and only their counts go on to be added.
    """
    blocks = _added(cube, by).withColumn("customers", F.bitmap_count("customers"))
    return blocks.groupBy(*by).agg(
        F.sum("total_revenue").cast("decimal(28,2)").alias("total_revenue"),
        F.sum("total_orders").alias("total_orders"),
        F.coalesce(F.sum("customers"), F.lit(0)).alias("unique_customers"),
    )


def append_to_cube(cube: DataFrame, at: str, load: str) -> None:
    """Add the cube of one load of sales to a stored one. The same load again replaces itself and counts once."""
    if not load or not all(c.isalnum() or c in "-_." for c in load) or load.startswith((".", "_")):
        raise ValueError("a load is named by letters, digits, dots and dashes")
    cube.write.mode("overwrite").parquet(f"{at}/load={load}")


def stored_cube(spark: SparkSession, at: str) -> DataFrame:
    """All loads of a stored cube, their rows side by side: every level of them is a roll-up."""
    return spark.read.schema(CUBE).option("basePath", at).parquet(at).drop("load")
