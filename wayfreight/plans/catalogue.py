"""Named queries over the sample tables, one per operator. All of them read whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfreight import rules
from wayfreight.functions import revenue
from wayfreight.functions.text import contains_any
from wayfreight.operators import appfacts, changes, classify, cube, deps, grants, manifest, places, rewrite, sales, semi, upkeep, variants, versions
from wayfreight.plans import estate as plans
from wayfreight.plans.migration import with_saved_facts
from wayfreight.schemas import TABLES
from wayfreight.session import shared_dir
from wayfreight.sources import files, layout, sample_corpus, source_tree, tree
from wayfreight.sources.tables import sales_data, table
from wayfreight.streaming import ledger
from wayfreight.streaming.load import copy_into

FORECAST_YEAR = 2001
DASHBOARD_YEAR = 2000
REGIONS = "ASIA,EUROPE"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def sample_estate(spark: SparkSession, data_dir: str) -> plans.Estate:
    return plans.Estate(
        files=lambda: sample_corpus.src_files(spark, data_dir),
        manifest_files=lambda: sample_corpus.manifest_files(spark, data_dir),
        apps=lambda: sample_corpus.apps(spark, data_dir),
    )


# --- sources and sinks -----------------------------------------------------------------------------


def _materialised(spark: SparkSession, data_dir: str) -> str:
    root = shared_dir(spark, "estate")
    raw = sample_corpus.raw_files(spark, data_dir).unionByName(sample_corpus.raw_manifests(spark, data_dir))
    tree.write_tree(raw, root)
    return root


@query
def estate_scan(spark, data_dir):
    raw = tree.read_tree(spark, _materialised(spark, data_dir))
    return files.decode_files(raw).select(
        "app_id", "path", "kind", "readable", F.md5(F.col("content").cast("binary")).alias("text_md5")
    )


@query
def stage_listing(spark, data_dir):
    return tree.stage_listing(tree.list_tree(spark, _materialised(spark, data_dir)))


@query
def tree_source(spark, data_dir):
    """The estate through the data source: Python and SQL files outside the pages, chosen before any is opened.

    Tasks list the folders first: the source's own walk would go through all of them where the query is planned.
    """
    chosen = F.col("kind").isin("python", "sql") & ~F.col("path").startswith("pages/")
    root, at = _materialised(spark, data_dir), shared_dir(spark, "listing")
    tree.save_listing(tree.list_tree(spark, root), at)
    found = source_tree.source_tree(spark, root, chosen, listing=at)
    return files.decode_files(found).select(
        "app_id", "path", "kind", "readable", F.md5(F.col("content").cast("binary")).alias("text_md5")
    )


@query
def tree_source_listing(spark, data_dir):
    """Files and bytes by application and kind from a saved listing: no walk and no file is opened."""
    root, at = _materialised(spark, data_dir), shared_dir(spark, "listing")
    tree.save_listing(tree.list_tree(spark, root), at)
    found = source_tree.source_tree(spark, root, content=False, all="true", listing=at)
    return found.groupBy("app_id", "kind").agg(F.count("*").alias("files"), F.sum("size").alias("total_bytes"))


def _scans(spark, data_dir):
    """The sample estate as it was scanned, and as it is scanned later."""
    raw = sample_corpus.raw_files(spark, data_dir)
    return raw, sample_corpus.later_files(raw)


def _snapshots(spark, data_dir):
    return [changes.take_snapshot(changes.scanned(raw), shared_dir(spark, "snapshot")) for raw in _scans(spark, data_dir)]


@query
def estate_changes(spark, data_dir):
    return changes.estate_changes(spark, *_snapshots(spark, data_dir))


@query
def changed_folders(spark, data_dir):
    return changes.changed_folders(spark, *_snapshots(spark, data_dir))


@query
def read_errors(spark, data_dir):
    return files.read_errors(sample_corpus.src_files(spark, data_dir))


@query
def manifest_catalog(spark, data_dir):
    return sample_estate(spark, data_dir).catalog


@query
def version_ranges(spark, data_dir):
    return versions.version_ranges(sample_corpus.pinned_files(spark, data_dir))


@query
def requirements_parse(spark, data_dir):
    return deps.requirements_parse(sample_corpus.src_files(spark, data_dir))


@query
def line_filter(spark, data_dir):
    return deps.line_filter(sample_corpus.src_files(spark, data_dir))


@query
def sales_fact(spark, data_dir):
    return sales_data(spark, data_dir)


@query
def analysis_report(spark, data_dir):
    return plans.report_as_text(plans.analysis_report(sample_estate(spark, data_dir)))


def _converted(e: plans.Estate):
    return rewrite.converted_files(e.facts, e.files)


@query
def converted_files(spark, data_dir):
    at = shared_dir(spark, "converted")
    rewrite.write_converted(_converted(sample_estate(spark, data_dir)), at)
    return spark.read.parquet(at).select(
        "app_id", "target_path", "path", "type", F.md5(F.col("content").cast("binary")).alias("text_md5")
    )


@query
def file_preview(spark, data_dir):
    return rewrite.file_preview(_converted(sample_estate(spark, data_dir)))


@query
def copy_into_events(spark, data_dir):
    target, checkpoint = shared_dir(spark, "events"), shared_dir(spark, "events-checkpoint")
    for _ in range(2):  # the second run finds nothing new
        copy_into(spark, f"{data_dir}/events.parquet", target, checkpoint, TABLES["events"])
    return spark.read.schema(TABLES["events"]).parquet(target)


EVENT_LINES = "event_id bigint, user_id bigint, event_type string, value double"


def _ledgered(spark, data_dir):
    """Events as JSON lines in one folder for each type, some lines broken off, loaded twice."""
    lines, target, checkpoint = (shared_dir(spark, name) for name in ("event-lines", "events-loaded", "events-ledger-checkpoint"))
    whole = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    broken = F.col("event_id") % 23 == 4
    events = table(spark, data_dir, "events").select(F.col("event_type").alias("type"), F.when(broken, F.concat(F.lit("{"), whole)).otherwise(whole).alias("line"))
    events.write.partitionBy("type").text(lines)
    for _ in range(2):  # the second run finds nothing new
        ledger.copy_with_ledger(spark, lines, target, checkpoint, EVENT_LINES, recursiveFileLookup="true", files_per_batch=100)
    return target


@query
def load_ledger(spark, data_dir):
    """What the ledger says of each folder of files."""
    kind = F.regexp_extract("file", "/type=([^/]*)/", 1).alias("event_type")
    entered = ledger.ledger(spark, _ledgered(spark, data_dir))
    return entered.groupBy(kind).agg(
        F.sum("loaded").alias("loaded"), F.sum("corrupt").alias("corrupt"), (F.count("*") == F.count_distinct("file")).alias("each_file_once")
    )


@query
def loaded_rows(spark, data_dir):
    return ledger.loaded_rows(spark, _ledgered(spark, data_dir), EVENT_LINES)


@query
def create_frame(spark, data_dir):
    """Rows given in code as a frame: a desk for some regions, looked up for the whole fact."""
    desks = spark.createDataFrame([("ASIA", "east desk"), ("EUROPE", "west desk")], "region string, desk string")
    fact = sales_data(spark, data_dir, ["year", "region", "revenue"])
    return (
        fact.groupBy("year", "region")
        .agg(F.sum("revenue").cast("decimal(28,2)").alias("revenue"))
        .join(F.broadcast(desks), "region", "left")  # two rows, whatever the fact
        .select("year", "region", "desk", "revenue")
    )


# --- per-file facts --------------------------------------------------------------------------------


@query
def classify_python(spark, data_dir):
    python = sample_corpus.src_files(spark, data_dir).filter("kind = 'python' AND readable")
    return classify.with_python_flags(classify.with_gates(python)).select(
        "app_id", "path", classify.python_type().alias("type"), "is_ui", "is_api", "py_udf", "py_procedure"
    )


@query
def classify_python_strict(spark, data_dir):
    python = sample_corpus.src_files(spark, data_dir).filter("kind = 'python' AND readable")
    return classify.with_python_flags(classify.with_gates(python), strict=True).select(
        "app_id", "path", classify.python_type().alias("type"), "is_ui"
    )


@query
def classify_sql(spark, data_dir):
    sql = sample_corpus.src_files(spark, data_dir).filter("kind = 'sql' AND readable")
    return classify.with_sql_flags(sql).select(
        "app_id",
        "path",
        classify.sql_type().alias("type"),
        classify.sql_complexity().alias("complexity"),
        "sql_procedure",
        "sql_udf",
        "is_view",
    )


@query
def sql_feature_flags(spark, data_dir):
    return classify.sql_feature_flags(sample_corpus.src_files(spark, data_dir))


@query
def component_complexity(spark, data_dir):
    return sample_estate(spark, data_dir).facts.filter("is_component").select("app_id", "path", "type", "complexity")


@query
def component_notes(spark, data_dir):
    components = classify.components(sample_estate(spark, data_dir).facts)
    return components.select(
        "app_id", "path", "name", "type", "complexity", "has_api_usage", F.array_join("notes", "; ").alias("notes")
    )


@query
def udf_inventory(spark, data_dir):
    return classify.udf_inventory(sample_corpus.src_files(spark, data_dir))


# --- application facts -----------------------------------------------------------------------------


@query
def app_summary(spark, data_dir):
    e = sample_estate(spark, data_dir)
    return appfacts.app_summary(e.app_facts, e.dependencies)


@query
def app_type(spark, data_dir):
    return sample_estate(spark, data_dir).app_facts.select("app_id", "app_type")


@query
def app_names(spark, data_dir):
    return appfacts.app_names(sample_corpus.apps(spark, data_dir))


@query
def api_usage(spark, data_dir):
    return appfacts.api_usage(sample_estate(spark, data_dir).active_app_facts)


@query
def usage_total(spark, data_dir):
    return appfacts.usage_total(sample_estate(spark, data_dir).active_app_facts)


@query
def complexity_score(spark, data_dir):
    return appfacts.complexity_score(sample_estate(spark, data_dir).app_facts)


@query
def estate_rollup(spark, data_dir):
    return appfacts.estate_rollup(sample_estate(spark, data_dir).app_facts)


def _kept_up(spark, data_dir):
    """Facts of the earlier scan, stored, and brought to the later one by the files that differ."""
    old, new = _snapshots(spark, data_dir)
    found = changes.estate_changes(spark, old, new)
    before, after = _scans(spark, data_dir)
    come = found.filter("change <> 'removed'").select("app_id", "path")
    gone = found.filter("change IN ('removed', 'changed')").select("app_id", "path").unionByName(
        found.filter("change = 'moved'").select(F.col("from_app_id").alias("app_id"), F.col("from_path").alias("path"))
    )
    at = shared_dir(spark, "upkeep")
    upkeep.start_upkeep(classify.file_facts(files.decode_files(before)), at)
    come, gone = (
        classify.file_facts(files.decode_files(side.join(which, ["app_id", "path"], "left_semi")))
        for side, which in ((after, come), (before, gone))
    )
    upkeep.keep_up(at, 1, come, gone)
    return at


FACT_COLUMNS = (
    "app_id", "python_files", "sql_files", "components", "ui_pages", "unreadable_files", "unreadable_requirements", "has_streamlit", "has_api",
    "has_stored_procedures", "has_udfs", "api_usage_total", "features", "score", "migration_complexity", "app_type",
)


@query
def upkeep_facts(spark, data_dir):
    """All application facts after the changes, equal to those of a full run over the later files."""
    return upkeep.facts_of_totals(upkeep.totals(spark, _kept_up(spark, data_dir))).select(*FACT_COLUMNS)


@query
def upkeep_changed(spark, data_dir):
    """The facts of just the applications that the changes touched."""
    return upkeep.changed_facts(spark, _kept_up(spark, data_dir), 1).select(*FACT_COLUMNS)


@query
def warnings(spark, data_dir):
    e = with_saved_facts(sample_estate(spark, data_dir), "facts")
    return e.warnings


@query
def recommendations(spark, data_dir):
    e = sample_estate(spark, data_dir)
    return appfacts.recommendations(e.app_facts, e.catalog)


@query
def dependency_set(spark, data_dir):
    return sample_estate(spark, data_dir).dependencies


@query
def dependency_drop(spark, data_dir):
    return deps.dependency_drop(sample_estate(spark, data_dir).dependencies)


def _requirements(spark, data_dir):
    e = with_saved_facts(sample_estate(spark, data_dir), "facts")
    return deps.target_requirements(e.app_facts, e.dependencies)


@query
def target_requirements(spark, data_dir):
    return _requirements(spark, data_dir)


@query
def ordered_requirements(spark, data_dir):
    return deps.ordered_requirements(_requirements(spark, data_dir))


# --- manifests and provisioning --------------------------------------------------------------------


@query
def manifest_privileges(spark, data_dir):
    return sample_estate(spark, data_dir).privileges


@query
def manifest_configuration(spark, data_dir):
    return manifest.manifest_configuration(sample_estate(spark, data_dir).manifests)


@query
def manifest_permissions(spark, data_dir):
    return manifest.manifest_permissions(sample_estate(spark, data_dir).privileges)


@query
def manifest_artifacts(spark, data_dir):
    return manifest.manifest_artifacts(sample_estate(spark, data_dir).manifests)


@query
def privilege_map(spark, data_dir):
    return manifest.privilege_map(sample_estate(spark, data_dir).privileges)


@query
def provisioning_plan(spark, data_dir):
    e = sample_estate(spark, data_dir)
    return manifest.provisioning_plan(e.apps, e.privileges)


def _grants(spark, data_dir):
    """The grants of the sample estate, stored, and its chains of roles."""
    at = shared_dir(spark, "grants")
    grants.grant_statements(sample_corpus.granting_files(spark, data_dir)).write.parquet(at)
    found = spark.read.parquet(at)
    return found, grants.role_chains(found)


@query
def grant_statements(spark, data_dir):
    return grants.grant_statements(sample_corpus.granting_files(spark, data_dir))


@query
def role_chains(spark, data_dir):
    return _grants(spark, data_dir)[1]


@query
def effective_grants(spark, data_dir):
    return grants.effective_grants(*_grants(spark, data_dir))


@query
def role_plan(spark, data_dir):
    return grants.role_plan(*_grants(spark, data_dir))


# --- rewriting -------------------------------------------------------------------------------------


@query
def rewrite_ui(spark, data_dir):
    each = rewrite.convert_each(sample_estate(spark, data_dir).facts_with_content)
    return each.filter("type = 'streamlit'").select("app_id", "path", "content")


@query
def rewrite_py(spark, data_dir):
    each = rewrite.convert_each(sample_estate(spark, data_dir).facts_with_content)
    return each.filter("type IN ('python', 'api')").select("app_id", "path", "content")


@query
def stamp_sql(spark, data_dir):
    each = rewrite.convert_each(sample_estate(spark, data_dir).facts_with_content)
    return each.filter("type = 'sql'").select("app_id", "path", "content")


@query
def skip_empty(spark, data_dir):
    return rewrite.skip_empty(sample_estate(spark, data_dir).facts)


@query
def target_paths(spark, data_dir):
    return sample_estate(spark, data_dir).targets


@query
def target_collisions(spark, data_dir):
    return rewrite.target_collisions(sample_estate(spark, data_dir).facts)


@query
def conversion_coverage(spark, data_dir):
    return rewrite.conversion_coverage(sample_estate(spark, data_dir).targets)


@query
def coverage_by_complexity(spark, data_dir):
    return rewrite.conversion_coverage(sample_estate(spark, data_dir).targets, by="complexity")


@query
def rewrite_hits(spark, data_dir):
    return rewrite.rewrite_hits(sample_estate(spark, data_dir).files)


@query
def rewrite_places(spark, data_dir):
    """Hits by file, rule and line of the source, with the first and last column of those lines that one rule alone touches."""
    found = places.rewrite_places(sample_estate(spark, data_dir).files)
    lines = found.groupBy("app_id", "path", "line").agg(
        F.count_distinct("rule").alias("n_rules"), F.max("rule").alias("rule"), F.count("*").alias("hits"),
        F.min("column").alias("first_column"), F.max("column").alias("last_column"),
    )
    alone = F.col("n_rules") == 1
    return lines.select(
        "app_id", "path", "line", "n_rules", "hits", *[F.when(alone, F.col(c)).alias(c) for c in ("rule", "first_column", "last_column")]
    )


# --- sales -----------------------------------------------------------------------------------------


@query
def monthly_sales(spark, data_dir):
    fact = sales_data(spark, data_dir, ["year", "month", "region", "customer_id", "revenue", "order_count"])
    return sales.monthly_sales(fact)


def _cube(spark, data_dir):
    """The cube of the fact, stored as two loads that were counted apart, each with customers of the other."""
    at = shared_dir(spark, "cube")
    fact = sales_data(spark, data_dir, ["year", "month", "region", "customer_id", "revenue", "order_count", "order_id"])
    for load in (0, 1):
        part = fact.filter(F.pmod(F.col("order_id").cast("bigint"), F.lit(2)) == load)
        cube.append_to_cube(cube.sales_cube(part), at, f"part-{load}")
    return cube.stored_cube(spark, at)


@query
def cube_monthly(spark, data_dir):
    return cube.roll_up(_cube(spark, data_dir), ["year", "month", "region"])


@query
def cube_by_year(spark, data_dir):
    return cube.roll_up(_cube(spark, data_dir), ["year"])


@query
def cube_by_region(spark, data_dir):
    return cube.roll_up(_cube(spark, data_dir), ["region"])


@query
def cube_total(spark, data_dir):
    return cube.roll_up(_cube(spark, data_dir))


def _dashboard(spark, data_dir, *columns):
    fact = sales_data(spark, data_dir, ["year", "region", *columns], DASHBOARD_YEAR, DASHBOARD_YEAR)
    return sales.sales_filter(fact, DASHBOARD_YEAR, REGIONS.split(","))


@query
def stored_sales(spark, data_dir):
    """The fact from tables stored by order and year."""
    return layout.stored_sales(spark, layout.write_layout(spark, data_dir))


@query
def stored_monthly_sales(spark, data_dir):
    """The rollup of the years before the forecast, from tables stored by order and year."""
    stored = layout.write_layout(spark, data_dir)
    return sales.monthly_sales(layout.stored_sales(spark, stored, FORECAST_YEAR - 4, FORECAST_YEAR - 1))


@query
def sales_filter(spark, data_dir):
    return _dashboard(spark, data_dir, "order_id", "customer_id", "product_name", "month", "revenue")


@query
def sales_kpis(spark, data_dir):
    return sales.sales_kpis(_dashboard(spark, data_dir, "customer_id", "revenue", "order_count"))


@query
def sales_trend(spark, data_dir):
    return sales.sales_trend(_dashboard(spark, data_dir, "month", "revenue"))


@query
def product_sales(spark, data_dir):
    fact = sales_data(spark, data_dir, ["product_name", "revenue", "order_count"])
    return sales.product_sales(fact)


@query
def top_products(spark, data_dir):
    return sales.product_sales(_dashboard(spark, data_dir, "product_name", "revenue", "order_count"), top_n=10)


@query
def year_range_filter(spark, data_dir):
    fact = sales_data(spark, data_dir, ["year", "revenue"], FORECAST_YEAR - 4)
    return (
        sales.year_range_filter(fact, FORECAST_YEAR)
        .groupBy("year", "in_current", "is_base")
        .agg(F.count("*").alias("lines"), F.sum("revenue").cast("decimal(28,2)").alias("revenue"))
    )


@query
def yoy_growth(spark, data_dir):
    fact = sales_data(spark, data_dir, ["year", "revenue"], FORECAST_YEAR - 4)
    return sales.yoy_growth(fact, FORECAST_YEAR).select(
        "year",
        F.round("revenue", 2).alias("revenue"),
        F.round("prior_revenue", 2).alias("prior_revenue"),
        F.round("growth", 6).alias("growth"),
    )


@query
def avg_growth(spark, data_dir):
    fact = sales_data(spark, data_dir, ["year", "revenue"], FORECAST_YEAR - 4)
    return sales.avg_growth(sales.yoy_growth(fact, FORECAST_YEAR)).select(
        F.round("avg_growth", 6).alias("avg_growth")
    )


@query
def region_semi_join(spark, data_dir):
    """Totals of the regions named in a comma-separated list that comes from the data itself."""
    names = (
        table(spark, data_dir, "region")
        .filter(contains_any(F.col("r_name"), ("ASIA", "EUROPE")))
        .select(F.concat("r_name", F.lit(","), "r_name", F.lit(", AFRICA")).alias("regions"))
    )
    wanted = sales.split_to_table(names, "regions", ",")
    fact = sales_data(spark, data_dir, ["region", "year", "revenue"])
    return (
        sales.region_semi_join(fact, wanted)
        .groupBy("region", "year")
        .agg(F.count("*").alias("lines"), F.sum("revenue").cast("decimal(28,2)").alias("revenue"))
    )


@query
def last_year_sales(spark, data_dir):
    base = FORECAST_YEAR - 1
    fact = sales_data(spark, data_dir, ["year", "region", "revenue"], base, base)
    return sales.last_year_sales(fact, FORECAST_YEAR, REGIONS)


def _rounded_forecast(df, *keys):
    return df.select(
        *keys,
        F.round("avg_growth", 6).alias("avg_growth"),
        F.round("last_year_sales", 2).alias("last_year_sales"),
        F.round("forecast", 2).alias("forecast"),
    )


@query
def sales_forecast(spark, data_dir):
    fact = sales_data(spark, data_dir, ["year", "region", "revenue"], FORECAST_YEAR - 4)
    return _rounded_forecast(sales.sales_forecast(fact, FORECAST_YEAR, REGIONS))


@query
def sales_forecast_batch(spark, data_dir):
    """One request per customer: a forecast year and a list around the customer's own region."""
    customer = table(spark, data_dir, "customer")
    nation = table(spark, data_dir, "nation")
    region = table(spark, data_dir, "region")
    key = F.col("c_custkey")
    extra = F.when(key % 3 == 0, ",ASIA").when(key % 3 == 1, ", EUROPE").otherwise("")
    requests = (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            key.alias("request_id"),
            (1996 + key % 7).cast("int").alias("forecast_year"),
            F.concat("r_name", extra).alias("regions"),
        )
    )
    fact = sales_data(spark, data_dir, ["year", "region", "revenue"])
    return _rounded_forecast(
        sales.sales_forecast_batch(fact, requests), "request_id", "forecast_year", "regions"
    )


@query
def categorize_revenue(spark, data_dir):
    fact = sales_data(spark, data_dir, ["revenue"])
    return (
        sales.categorized(fact)
        .groupBy("category")
        .agg(
            F.count("*").alias("lines"),
            F.sum("revenue").cast("decimal(28,2)").alias("revenue"),
            F.min("revenue").alias("lowest"),
            F.max("revenue").alias("highest"),
        )
    )


@query
def split_to_table(spark, data_dir):
    return sales.split_to_table(table(spark, data_dir, "documents"), "text", ",", keep=["doc_id"])


@query
def categorize_revenue_sql(spark, data_dir):
    """The category as a function in SQL."""
    revenue.register_sql_functions(spark)
    lines = sales_data(spark, data_dir, ["revenue"])
    return spark.sql(
        """
        SELECT categorize_revenue(revenue) AS category, count(*) AS lines, CAST(sum(revenue) AS DECIMAL(28,2)) AS revenue
        FROM {lines} GROUP BY ALL
        """,
        lines=lines,
    )


@query
def split_to_table_sql(spark, data_dir):
    """Last year's sales of a list of regions, and the sentences of every document, by a table function in SQL."""
    revenue.register_sql_functions(spark)
    fact = sales_data(spark, data_dir, ["year", "region", "revenue"])
    return spark.sql(
        """
        SELECT 'sales' AS what, CAST(NULL AS BIGINT) AS id, CAST(sum(revenue) AS DECIMAL(28,2)) AS amount FROM {fact}
        WHERE year = :year - 1 AND region IN (SELECT value FROM split_to_table(:regions, ','))
        UNION ALL
        SELECT 'parts', doc_id, CAST(count(*) AS DECIMAL(28,2)) FROM {documents} d, LATERAL split_to_table(d.text, '. ') GROUP BY doc_id
        """,
        args={"year": FORECAST_YEAR, "regions": REGIONS},
        fact=fact,
        documents=table(spark, data_dir, "documents"),
    )


@query
def sales_forecast_sql(spark, data_dir):
    """The forecast as a procedure over a view, with bound parameters."""
    sales_data(spark, data_dir, ["year", "region", "revenue"], FORECAST_YEAR - 4).createOrReplaceTempView("sales_data")
    found = revenue.call_sales_forecast(spark, FORECAST_YEAR, REGIONS)
    return found.select(F.round("forecast", 2).alias("forecast"))


@query
def monthly_sales_sql(spark, data_dir):
    """The rollup as a view that SQL reads."""
    columns = ["year", "month", "region", "customer_id", "revenue", "order_count"]
    sales.monthly_sales(sales_data(spark, data_dir, columns)).createOrReplaceTempView("monthly_sales")
    return spark.sql("SELECT year, region, sum(total_orders) AS orders, max(unique_customers) AS most_customers FROM monthly_sales GROUP BY ALL")


# --- semi-structured -------------------------------------------------------------------------------


def _order_objects(spark, data_dir):
    """One JSON object per order: scalars, an object, and for some orders nothing at all."""
    orders = table(spark, data_dir, "orders")
    inner = F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"))
    whole = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"), inner.alias("of")))
    empty, missing = F.col("o_orderkey") % 11 == 0, F.col("o_orderkey") % 13 == 0
    return orders.select("o_orderkey", F.when(empty, "{}").when(~missing, whole).alias("object"))


@query
def flatten_object(spark, data_dir):
    return semi.flatten(_order_objects(spark, data_dir), "object", ["o_orderkey"]).drop("position")


@query
def flatten_outer(spark, data_dir):
    return semi.flatten(_order_objects(spark, data_dir), "object", ["o_orderkey"], outer=True).drop("position")


@query
def flatten_array(spark, data_dir):
    """Positions and values of an array in JSON text, nested arrays left as they are."""
    arrays = table(spark, data_dir, "orders").select(
        "o_orderkey",
        F.to_json(F.array(F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority"))).alias("list"),
    )
    return semi.flatten(arrays, "list", ["o_orderkey"]).drop("key")


@query
def variant_extract(spark, data_dir):
    events = table(spark, data_dir, "events")
    return events.select("event_id", "event_type", semi.variant_extract(F.col("props"), "$.k", "int").alias("k"))


@query
def flatten(spark, data_dir):
    return semi.flatten(table(spark, data_dir, "events"), "props", ["event_id"])


@query
def lateral_flatten(spark, data_dir):
    return semi.lateral_flatten(table(spark, data_dir, "events"), "props", "event_type")


def _drifting_objects(spark, data_dir):
    """One JSON object per order, some with other types, paths of their own, or no JSON at all."""
    key, year = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    inner = F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"))
    whole = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"), inner.alias("of")))
    as_text = F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('","year":"'), year, F.lit('","of":{"customer":'), "o_custkey", F.lit(',"note":{"is late":true}}}'))
    text = (
        F.when(key % 13 == 0, F.lit(None))
        .when(key % 17 == 0, '{"status": ')
        .when(key % 11 == 0, "{}")
        .when(key % 7 == 0, as_text)
        .when(key % 5 == 0, '{"status":null,"year":"unknown","of":"none","extra":[1,2]}')
        .otherwise(whole)
    )
    return table(spark, data_dir, "orders").select("o_orderkey", text.alias("object"))


ORDER_FIELDS = {"status": ("$.status", "string"), "year": ("$.year", "int"), "customer": ("$.of.customer", "bigint")}


@query
def variant_schema(spark, data_dir):
    return variants.variant_schema(_order_objects(spark, data_dir), "object")


@query
def variant_paths(spark, data_dir):
    return variants.path_types(_drifting_objects(spark, data_dir), "object")


@query
def variant_typed(spark, data_dir):
    found = variants.typed(_drifting_objects(spark, data_dir), "object", ORDER_FIELDS, ["o_orderkey"])
    return found.withColumn("misfits", F.concat_ws(",", "misfits"))


@query
def variant_drift(spark, data_dir):
    return variants.drift(_drifting_objects(spark, data_dir), "object", ORDER_FIELDS)


@query
def array_flatten_agg(spark, data_dir):
    return semi.array_flatten_agg(table(spark, data_dir, "embeddings"), "embedding")


# Keys whose Python name had to differ from an imported one.
QUERIES["sales_data"] = QUERIES.pop("sales_fact")
QUERIES["copy_into"] = QUERIES.pop("copy_into_events")
