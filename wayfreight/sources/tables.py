"""The star-schema tables and the sales fact conformed from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfreight.schemas import SALES_DATA, TABLES


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """A sample table under its declared schema; no footer is read to infer one."""
    return spark.read.schema(TABLES[name]).parquet(f"{data_dir}/{name}.parquet")


def net_revenue() -> F.Column:
    """Line revenue. The inputs become decimals first: engines round a double-to-decimal cast differently."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    return (price * (F.lit(1) - discount)).cast("decimal(18,2)")


def sales_data(
    spark: SparkSession,
    data_dir: str,
    columns: Iterable[str] | None = None,
    first_year: int | None = None,
    last_year: int | None = None,
) -> DataFrame:
    """One row per order line in the sales fact schema.

    Every line of a known order is a row, whichever columns are asked for: a customer, nation, region
    or part that is not known leaves its column empty.

    Only the dimensions that the asked columns need are joined, and a year range becomes a range on
    ``o_orderdate`` so that it reaches the Parquet scan (``year(ts) = 2000`` would not).
    """
    wanted = list(columns) if columns is not None else SALES_DATA.fieldNames()
    orders = table(spark, data_dir, "orders")
    if first_year is not None:
        orders = orders.filter(F.col("o_orderdate") >= F.lit(f"{first_year}-01-01").cast("timestamp_ntz"))
    if last_year is not None:
        orders = orders.filter(F.col("o_orderdate") < F.lit(f"{last_year + 1}-01-01").cast("timestamp_ntz"))
    # Orders meet their dimensions before the lines do: the lines, four to an order, are then
    # shuffled once, by order, and not a second time by customer.
    if "region" in wanted:
        customer = table(spark, data_dir, "customer")
        nation = table(spark, data_dir, "nation")
        region = table(spark, data_dir, "region")
        homes = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").join(
            region, nation.n_regionkey == region.r_regionkey, "left"
        )
        orders = orders.join(homes, orders.o_custkey == homes.c_custkey, "left")
    lines = table(spark, data_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    # Both sides are facts. The hint keeps the planner from broadcasting one of them because its
    # compressed, pruned size looks small.
    fact = lines.hint("merge").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if "product_name" in wanted:
        part = table(spark, data_dir, "part")
        fact = fact.join(part, fact.l_partkey == part.p_partkey, "left")

    conformed = {
        "order_id": F.col("o_orderkey").cast("string"),
        "customer_id": F.col("o_custkey").cast("string"),
        "product_name": F.col("p_name"),
        "region": F.col("r_name"),
        "year": F.year("o_orderdate"),
        "month": F.month("o_orderdate"),
        "revenue": net_revenue(),
        "order_count": F.lit(1),
        "order_date": F.col("o_orderdate"),
    }
    return fact.select(*[conformed[c].cast(SALES_DATA[c].dataType).alias(c) for c in wanted])
