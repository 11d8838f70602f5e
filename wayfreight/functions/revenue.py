"""Revenue category and forecast, as a column function and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HIGH_ABOVE = 100000
MEDIUM_ABOVE = 50000


def categorize_revenue(revenue: Column) -> Column:
    """High above 100000, Medium above 50000, everything else (NULL too) Low."""
    return (
        F.when(revenue > HIGH_ABOVE, "High").when(revenue > MEDIUM_ABOVE, "Medium").otherwise("Low")
    )


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``categorize_revenue(x)`` and ``split_to_table(text, separator)`` callable in SQL: Catalyst inlines both.

    ``split_to_table`` is a table function (index from 1, value), for a subquery or a lateral join. The separator is
    literal and nothing is trimmed; a null text gives no row, an empty separator the whole text.
    """
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION categorize_revenue(revenue DOUBLE) RETURNS STRING
        RETURN CASE WHEN revenue > {HIGH_ABOVE} THEN 'High'
                    WHEN revenue > {MEDIUM_ABOVE} THEN 'Medium'
                    ELSE 'Low' END
        """
    )
    spark.sql(
        r"""
        CREATE OR REPLACE TEMPORARY FUNCTION split_to_table(text STRING, separator STRING)
        RETURNS TABLE (index INT, value STRING)
        RETURN SELECT pos + 1, col
               FROM posexplode(CASE WHEN separator = '' THEN array(text) WHEN text IS NOT NULL
                                    THEN split(text, concat('\\Q', replace(separator, '\\E', '\\E\\\\E\\Q'), '\\E')) END)
        """
    )


# Each year and the year before meet in the second aggregation, see operators.sales.yearly_pairs.
FORECAST_SQL = """
    WITH yearly AS (
        SELECT year,
               CAST(SUM(revenue) AS DOUBLE) AS revenue,
               CAST(SUM(revenue) FILTER (WHERE array_contains(split(:regions, ','), region)) AS DOUBLE) AS picked
        FROM IDENTIFIER(:sales)
        WHERE year >= :forecast_year - 4
        GROUP BY year
    ), paired AS (
        SELECT y, MAX(current) AS revenue, MAX(before) AS prior, MAX(base) AS picked
        FROM (
            SELECT year AS y, revenue AS current, CAST(NULL AS DOUBLE) AS before, picked AS base FROM yearly
            UNION ALL
            SELECT year + 1, NULL, revenue, NULL FROM yearly
        )
        GROUP BY y
    )
    SELECT MAX(picked) FILTER (WHERE y = :forecast_year - 1)
           * (1 + AVG(try_divide(revenue - prior, prior)) FILTER (WHERE y >= :forecast_year - 3)) AS forecast
    FROM paired
"""


def call_sales_forecast(spark: SparkSession, forecast_year: int, regions: str, sales: str = "sales_data") -> DataFrame:
    """The forecast procedure over a view, with bound parameters; one row, NULL when a part is missing."""
    return spark.sql(FORECAST_SQL, args={"forecast_year": forecast_year, "regions": regions, "sales": sales})
