"""Schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

SALES_DATA = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("revenue", T.DecimalType(18, 2)),
        T.StructField("order_count", T.IntegerType()),
        T.StructField("order_date", T.TimestampNTZType()),
    ]
)

# A corpus as it comes off disk: one row per file, bytes untouched.
RAW_FILES = T.StructType(
    [
        T.StructField("app_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("content", T.BinaryType()),
    ]
)

# A directory listing; ``dir`` and ``path`` are relative to the application folder.
LISTING = T.StructType(
    [
        T.StructField("app_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)

# The sample tables the queries read, as DDL.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}
