"""The analytical workload: rollups, filtered indicators, growth, forecast and categories."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfreight.functions.revenue import categorize_revenue
from wayfreight.session import shared_dir


def monthly_sales(sales: DataFrame) -> DataFrame:
    """Revenue, orders and distinct customers per year, month and region; NULL keys are kept.

    Spark plans the single distinct count as two levels: it first shuffles on the group keys plus
    customer, so a region that owns a third of all rows is spread over its customers.
    """
    return sales.groupBy("year", "month", "region").agg(
        F.sum("revenue").cast("decimal(28,2)").alias("total_revenue"),
        F.sum("order_count").alias("total_orders"),
        F.count_distinct("customer_id").alias("unique_customers"),
    )


def sales_filter(sales: DataFrame, year: int, regions: Sequence[str]) -> DataFrame:
    return sales.filter((F.col("year") == year) & F.col("region").isin(list(regions)))


def year_range_filter(sales: DataFrame, forecast_year: int) -> DataFrame:
    """Rows in the growth window (no upper bound), marked by the windows they belong to."""
    year = F.col("year")
    return sales.filter(year >= forecast_year - 4).withColumns(
        {"in_current": year >= forecast_year - 3, "is_base": year == forecast_year - 1}
    )


def sales_kpis(filtered: DataFrame) -> DataFrame:
    """Totals, revenue per order as a ratio of sums, and distinct customers. Zeros on empty input."""
    revenue = F.sum("revenue")
    orders = F.sum("order_count")
    return filtered.agg(
        F.coalesce(revenue.cast("decimal(28,2)"), F.lit(0).cast("decimal(28,2)")).alias("total_sales"),
        F.coalesce(orders, F.lit(0)).alias("orders"),
        F.round(F.try_divide(revenue.cast("double"), orders.cast("double")), 6).alias("avg_order_value"),
        F.count_distinct("customer_id").alias("customers"),
    )


def sales_trend(filtered: DataFrame) -> DataFrame:
    """Revenue by month, ascending; rows without a month do not count."""
    return (
        filtered.filter(F.col("month").isNotNull())
        .groupBy("month")
        .agg(_zero_if_null(F.sum("revenue")).alias("revenue"))
        .orderBy("month")
    )


def product_sales(filtered: DataFrame, top_n: int | None = None) -> DataFrame:
    """Revenue and orders by product, best first, product name breaking ties."""
    ranked = (
        filtered.filter(F.col("product_name").isNotNull())
        .groupBy("product_name")
        .agg(_zero_if_null(F.sum("revenue")).alias("revenue"), F.sum("order_count").alias("order_count"))
        .orderBy(F.desc("revenue"), "product_name")
    )
    return ranked if top_n is None else ranked.limit(top_n)


def _zero_if_null(total: Column) -> Column:
    return F.coalesce(total.cast("decimal(28,2)"), F.lit(0).cast("decimal(28,2)"))


def yearly_pairs(yearly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each year beside the year before it, for years whose predecessor exists.

    Equal to the self-join ``cur.year = prior.year + 1`` (gap years drop out, unlike ``lag``), but the
    fact is aggregated once: every yearly row is sent to its own year and to the next, and the two
    meet in a second, tiny aggregation. A self-join would scan and shuffle the fact twice, because
    its two sides have different lower bounds and so cannot share an exchange.
    """
    keys = list(keys)
    halves = F.array(
        F.struct(
            F.col("year").alias("y"),
            F.lit(True).alias("is_current"),
            F.col("revenue").alias("revenue"),
            F.lit(None).cast("double").alias("prior"),
        ),
        F.struct(
            (F.col("year") + 1).alias("y"),
            F.lit(False).alias("is_current"),
            F.lit(None).cast("double").alias("revenue"),
            F.col("revenue").alias("prior"),
        ),
    )
    paired = (
        yearly.select(*keys, F.inline(halves))
        .groupBy(*keys, "y")
        .agg(
            F.bool_or("is_current").alias("has_current"),
            F.bool_or(~F.col("is_current")).alias("has_prior"),
            F.max("revenue").alias("revenue"),
            F.max("prior").alias("prior_revenue"),
        )
        .filter("has_current AND has_prior")
    )
    growth = F.try_divide(F.col("revenue") - F.col("prior_revenue"), F.col("prior_revenue"))
    return paired.select(*keys, F.col("y").alias("year"), "revenue", "prior_revenue", growth.alias("growth"))


def yearly_revenue(sales: DataFrame, first_year: int | None = None) -> DataFrame:
    kept = sales if first_year is None else sales.filter(F.col("year") >= first_year)
    return kept.groupBy("year").agg(F.sum("revenue").cast("double").alias("revenue"))


def yoy_growth(sales: DataFrame, forecast_year: int) -> DataFrame:
    """Growth over the year before, for every year from ``forecast_year - 3`` on."""
    pairs = yearly_pairs(yearly_revenue(sales, forecast_year - 4))
    return pairs.filter(F.col("year") >= forecast_year - 3)


def avg_growth(growth: DataFrame) -> DataFrame:
    return growth.agg(F.avg("growth").alias("avg_growth"))


def split_to_table(df: DataFrame, text: str, separator: str, keep: Sequence[str] = ()) -> DataFrame:
    """Split text on a literal separator into rows (1-based index, value); nothing is trimmed."""
    pattern = re.escape(separator)  # Spark splits on a pattern; the separator is literal
    return df.select(*keep, F.posexplode(F.split(text, pattern)).alias("pos", "value")).select(
        *keep, (F.col("pos") + 1).alias("index"), "value"
    )


def region_semi_join(sales: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose region is among ``wanted.value``; duplicates there do not multiply rows."""
    return sales.join(wanted.select(F.col("value").alias("region")), "region", "left_semi")


def last_year_sales(sales: DataFrame, forecast_year: int, regions: str) -> DataFrame:
    """Revenue of the year before the forecast in the listed regions; NULL when there is none."""
    return sales.filter(
        (F.col("year") == forecast_year - 1) & F.col("region").isin(regions.split(","))
    ).agg(F.sum("revenue").cast("decimal(28,2)").alias("last_year_sales"))


def sales_forecast(sales: DataFrame, forecast_year: int, regions: str) -> DataFrame:
    """``last_year_sales * (1 + avg_growth)``; NULL when either part is.

    One scan of the fact and one aggregation by year give both parts: growth ignores the regions,
    the base year honours them. No join and no cross product of the two scalars.
    """
    in_regions = F.col("region").isin(regions.split(","))
    yearly = (
        sales.filter(F.col("year") >= forecast_year - 4)
        .groupBy("year")
        .agg(
            F.sum("revenue").cast("double").alias("revenue"),
            F.sum(F.when(in_regions, F.col("revenue"))).cast("double").alias("picked"),
        )
    )
    no_value = F.lit(None).cast("double")
    halves = F.array(
        F.struct(F.col("year").alias("y"), F.col("revenue").alias("revenue"), no_value.alias("prior"), F.col("picked").alias("picked")),
        F.struct((F.col("year") + 1).alias("y"), no_value.alias("revenue"), F.col("revenue").alias("prior"), no_value.alias("picked")),
    )
    paired = (
        yearly.select(F.inline(halves))
        .groupBy("y")
        .agg(F.max("revenue").alias("revenue"), F.max("prior").alias("prior"), F.max("picked").alias("picked"))
    )
    growth = F.when(
        F.col("y") >= forecast_year - 3, F.try_divide(F.col("revenue") - F.col("prior"), F.col("prior"))
    )
    return paired.agg(
        F.avg(growth).alias("avg_growth"),
        F.max(F.when(F.col("y") == forecast_year - 1, F.col("picked"))).alias("last_year_sales"),
    ).select(
        "avg_growth",
        "last_year_sales",
        (F.col("last_year_sales") * (1 + F.col("avg_growth"))).alias("forecast"),
    )


#: A table of at most so many yearly rows may go to every task.
MOST_BROADCAST_ROWS = 100_000


def sales_forecast_batch(sales: DataFrame, requests: DataFrame) -> DataFrame:
    """The forecast for many requests ``(request_id, forecast_year, regions)`` at once.

    The fact is read once, into one row per (year, region), which is stored. Requests meet those rows
    by equality on year and region, and the growth averages by equality on forecast year. Few years
    and regions are asked for by very many requests, so such a join must not be dealt out by them: the
    yearly side goes to every task once its rows are counted and few. With more of them than
    ``MOST_BROADCAST_ROWS`` the keys are many and the joins are left to adaptive execution.
    """
    by_region = _kept(
        sales.filter(F.col("year").isNotNull()).groupBy("year", "region").agg(F.sum("revenue").alias("revenue")), "yearly"
    )
    few = by_region.count() <= MOST_BROADCAST_ROWS
    averages = growth_by_forecast_year(
        by_region.groupBy("year").agg(F.sum("revenue").cast("double").alias("revenue")),
        requests.select("forecast_year").distinct(),
    )
    wanted = requests.select(
        "request_id",
        (F.col("forecast_year") - 1).alias("base_year"),
        F.explode(F.array_distinct(F.split("regions", ","))).alias("base_region"),
    )
    bases = (
        wanted.join(
            F.broadcast(by_region) if few else by_region,
            (F.col("base_year") == F.col("year")) & (F.col("base_region") == F.col("region")),
        )
        .groupBy("request_id")
        .agg(F.sum("revenue").cast("double").alias("last_year_sales"))
    )
    return (
        requests.join(F.broadcast(averages) if few else averages, "forecast_year", "left")
        .join(bases, "request_id", "left")
        .select(
            "request_id",
            "forecast_year",
            "regions",
            "avg_growth",
            "last_year_sales",
            (F.col("last_year_sales") * (1 + F.col("avg_growth"))).alias("forecast"),
        )
    )


def _kept(df: DataFrame, name: str) -> DataFrame:
    at = shared_dir(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def growth_by_forecast_year(yearly: DataFrame, forecast_years: DataFrame) -> DataFrame:
    """Average growth over all years from ``forecast_year - 3`` on, per forecast year that has any.

    Each year's growth is sent to the forecast years between the earliest one asked for and three
    years on, and averaged there; all of it is calendar years.
    """
    first = forecast_years.agg(F.min("forecast_year").alias("y")).first()["y"]
    growth = yearly_pairs(yearly).select("year", "growth")
    asked = F.sequence(F.lit(first).cast("int"), (F.col("year") + 3).cast("int"))
    return (
        growth.filter(F.col("year") + 3 >= F.lit(first))  # nothing is asked for: no row
        .select(F.explode(asked).alias("forecast_year"), "growth")
        .join(forecast_years.filter("forecast_year IS NOT NULL"), "forecast_year", "left_semi")
        .groupBy("forecast_year")
        .agg(F.avg("growth").alias("avg_growth"))
    )


def categorized(sales: DataFrame) -> DataFrame:
    return sales.withColumn("category", categorize_revenue(F.col("revenue")))
