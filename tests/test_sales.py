from __future__ import annotations

import random
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wayfreight.functions.revenue import call_sales_forecast, register_sql_functions
from wayfreight.operators import sales
from wayfreight.schemas import SALES_DATA


@pytest.fixture
def make_sales(spark):
    def make(*entries):
        """(region, year, month, revenue, orders, customer, product) tuples."""
        return spark.createDataFrame(
            [
                (str(n), c, p, r, y, m, None if v is None else Decimal(str(v)), o, None)
                for n, (r, y, m, v, o, c, p) in enumerate(entries)
            ],
            SALES_DATA,
        )

    return make


def line(region="N", year=2000, month=1, revenue=10, orders=1, customer="c", product="p"):
    return (region, year, month, revenue, orders, customer, product)


def test_monthly_sales_keeps_null_keys_and_skips_null_customers(make_sales):
    fact = make_sales(line(region=None), line(customer=None), line(), line(customer="d"))
    assert rows(sales.monthly_sales(fact), "region", "total_revenue", "total_orders", "unique_customers") == [
        ("N", Decimal("30.00"), 3, 2),
        (None, Decimal("10.00"), 1, 1),
    ]


def test_kpis_are_ratio_of_sums_and_zero_on_nothing(make_sales):
    fact = make_sales(line(revenue=10, orders=1), line(revenue=90, orders=9, customer="d"), line(region="S"))
    got = sales.sales_kpis(sales.sales_filter(fact, 2000, ["N"])).first()
    assert tuple(got) == (Decimal("100.00"), 10, 10.0, 2)
    nothing = sales.sales_kpis(sales.sales_filter(fact, 2000, [])).first()
    assert tuple(nothing) == (Decimal("0.00"), 0, None, 0)


def test_trend_and_products_drop_null_keys_and_break_ties_by_name(make_sales):
    fact = make_sales(line(month=None), line(month=2), line(month=1, product="b"), line(month=1, product=None))
    assert [r.month for r in sales.sales_trend(fact).collect()] == [1, 2]
    assert [r.product_name for r in sales.product_sales(fact).collect()] == ["p", "b"]
    tied = make_sales(line(product="z"), line(product="a"))
    assert [r.product_name for r in sales.product_sales(tied).collect()] == ["a", "z"]
    assert [r.product_name for r in sales.product_sales(tied, top_n=1).collect()] == ["a"]


def test_growth_drops_gap_years_and_has_no_upper_bound(make_sales):
    fact = make_sales(
        line(year=1996, revenue=5), line(year=1997, revenue=10), line(year=1998, revenue=20),
        line(year=2000, revenue=30), line(year=2001, revenue=60), line(year=2002, revenue=30), line(year=None),
    )
    got = [(r[0], round(r[1], 6)) for r in rows(sales.yoy_growth(fact, 2001), "year", "growth")]
    assert got == [(1998, 1.0), (2001, 1.0), (2002, -0.5)]
    assert sales.avg_growth(sales.yoy_growth(fact, 2001)).first()[0] == pytest.approx(0.5)
    # lag() would have paired 1998 with 2000; 1997 is below the window and 1996 out of reach.


def test_zero_prior_revenue_gives_no_growth(make_sales):
    fact = make_sales(line(year=1999, revenue=0), line(year=2000, revenue=5), line(year=2001, revenue=10))
    assert rows(sales.yoy_growth(fact, 2001), "year", "growth") == [(2000, None), (2001, 1.0)]


def test_forecast_honours_regions_in_the_base_year_only(make_sales):
    fact = make_sales(
        line(year=1999, revenue=100), line(year=2000, revenue=50), line(year=2000, region="S", revenue=150),
        line(year=2000, region=None, revenue=0),
    )
    got = sales.sales_forecast(fact, 2001, "N, S").first()  # " S" is not trimmed
    assert (got.avg_growth, got.last_year_sales, got.forecast) == (1.0, 50.0, 100.0)
    assert sales.sales_forecast(fact, 2001, "N,S,S").first().forecast == 400.0
    assert sales.sales_forecast(fact, 2001, "").first().forecast is None
    assert sales.sales_forecast(fact, 1999, "N").first().forecast is None


def test_single_batch_and_sql_forecasts_agree(spark, make_sales):
    rng = random.Random(5)
    fact = make_sales(
        *[line(rng.choice(["N", "S", "E", None]), rng.choice([1995, 1996, 1997, 1999, 2000, 2001]), 1, rng.randrange(1, 99)) for _ in range(300)]
    )
    requests = [(n, year, regions) for n, (year, regions) in enumerate(
        (y, r) for y in range(1993, 2006) for r in ("N", "N,S", "S,S", "N, S", "", "X"))]
    frame = spark.createDataFrame(requests, "request_id bigint, forecast_year int, regions string")
    batch = {r.request_id: r for r in sales.sales_forecast_batch(fact, frame).collect()}
    assert len(batch) == len(requests)
    fact.createOrReplaceTempView("some_sales")
    for n, year, regions in requests[::7]:
        single = sales.sales_forecast(fact, year, regions).first()
        assert batch[n].avg_growth == pytest.approx(single.avg_growth)
        assert batch[n].last_year_sales == single.last_year_sales
        assert batch[n].forecast == pytest.approx(single.forecast)
        sql = call_sales_forecast(spark, year, regions, "some_sales").first().forecast
        assert sql == pytest.approx(single.forecast)


def test_categories_at_their_bounds(spark):
    register = spark.createDataFrame([(v,) for v in (None, 0.0, 50000.0, 50000.01, 100000.0, 100000.01)], "revenue double")
    got = [r.category for r in sales.categorized(register).collect()]
    assert got == ["Low", "Low", "Low", "Medium", "Medium", "High"]
    register_sql_functions(spark)
    in_sql = register.select(F.call_function("categorize_revenue", "revenue"))
    assert [r[0] for r in in_sql.collect()] == got


def test_split_is_literal_and_keeps_empty_parts(spark):
    frame = spark.createDataFrame([("a.b..c",), ("",), (None,)], "s string")
    assert rows(sales.split_to_table(frame, "s", "."), "index", "value") == [
        (1, ""), (1, "a"), (2, "b"), (3, ""), (4, "c"),
    ]
    assert rows(sales.split_to_table(frame, "s", "b."), "value") == [("",), (".c",), ("a.",)]


def test_semi_join_does_not_multiply_or_match_null(spark, make_sales):
    fact = make_sales(line(), line(region=None), line(region="S"))
    wanted = spark.createDataFrame([("N",), ("N",), (None,), (" S",)], "value string")
    assert rows(sales.region_semi_join(fact, wanted), "region") == [("N",)]


def test_unknown_dimensions_keep_their_lines(spark, tmp_path):
    """Rows do not depend on the columns asked for."""
    from wayfreight.sources.tables import sales_data, table

    source = "/root/testdata/sf0.001"
    for name in ("orders", "lineitem", "nation", "region"):
        table(spark, source, name).write.parquet(f"{tmp_path}/{name}.parquet")
    table(spark, source, "customer").filter("c_custkey % 2 = 0").write.parquet(f"{tmp_path}/customer.parquet")
    table(spark, source, "part").filter("p_partkey % 3 = 0").write.parquet(f"{tmp_path}/part.parquet")
    counts = {sales_data(spark, str(tmp_path), c).count() for c in (["revenue"], ["region", "revenue"], ["product_name"], None)}
    assert len(counts) == 1
    assert sales_data(spark, str(tmp_path)).filter("region IS NULL AND product_name IS NULL").count() > 0
