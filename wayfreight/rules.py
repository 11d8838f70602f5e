"""The literals that decide what a file is, what gets rewritten and what gets said.

Everything here is plain data. The detection and rewrite literals are fixed by the behaviour the
engine must reproduce; the wording of notes, warnings and advice is free and keyed by a stable code.
"""

from __future__ import annotations

# --- fixed values: text that marks a Python file -----------------------------------------------
UI_MARKERS = ("import streamlit", "from streamlit", "st.", "streamlit_app")
API_MARKERS = ("from flask", "from fastapi", "@app.route", "@app.get", "@app.post")
UI_BARE = "st."
UDF_MARKER = "@udf"
PROCEDURE_MARKER = "@sproc"

# --- fixed values: platform-API features, (label, literal, column) --------------------------------
API_FEATURES = (
    ("from snowflake.snowpark", "from snowflake.snowpark", "n_from_snowpark"),
    ("import snowflake.snowpark", "import snowflake.snowpark", "n_import_snowpark"),
    ("session.table", "session.table(", "n_session_table"),
    ("session.create_dataframe", "session.create_dataframe(", "n_session_create_dataframe"),
    ("session.sql", "session.sql(", "n_session_sql"),
    ("@udf", "@udf", "n_udf"),
    ("@sproc", "@sproc", "n_sproc"),
)

# Parts shared by the literals above. Every feature literal holds exactly one of the gates, by flag column.
GATES = {"has_at": "@", "has_session": "session.", "has_snowpark": "snowflake.snowpark"}
UI_PART = "streamlit"
API_IMPORT_PART = "from f"
SQL_CREATE_PART = "CREATE"

# --- fixed values: text that marks a SQL file, tested against the upper-cased text ----------------
SQL_PROCEDURE_MARKERS = ("CREATE OR REPLACE PROCEDURE",)
SQL_FUNCTION_MARKERS = ("CREATE OR REPLACE FUNCTION",)
SQL_VIEW_MARKERS = ("CREATE OR REPLACE VIEW", "CREATE VIEW")
SQL_CONSTRUCTS = (
    ("VARIANT type", "VARIANT"),
    ("FLATTEN function", "FLATTEN("),
    ("LATERAL FLATTEN", "LATERAL FLATTEN"),
    ("COPY INTO", "COPY INTO"),
)

# --- fixed values: file names ----------------------------------------------------------------------
PYTHON_SUFFIX = ".py"
SQL_SUFFIX = ".sql"
REQUIREMENTS_NAME = "requirements.txt"
MANIFEST_NAMES = ("manifest.yml", "manifest.yaml")  # in order of preference

# --- fixed values: scoring -------------------------------------------------------------------------
SCORE_UI = 2
SCORE_API = 3
SCORE_PROCEDURES = 5
SCORE_UDFS = 3
SCORE_FEATURE_CAP = 5
SCORE_SQL_CAP = 5
LOW_UP_TO = 5
MEDIUM_UP_TO = 12
HEAVY_USAGE_ABOVE = 20

# --- fixed values: ordered rewrites, (from, to) ----------------------------------------------------
UI_REWRITES = (
    ("import snowflake.connector", "from databricks import sql"),
    ("from snowflake import connector", "from databricks import sql"),
    ("snowflake.connector.connect(", "sql.connect("),
    ("from snowflake.snowpark import Session", "from pyspark.sql import SparkSession"),
    ("session.table(", "spark.table("),
    ("session.sql(", "spark.sql("),
)
PY_REWRITE_GUARD = "snowpark"
# The first Python rewrite eats the rest of its line, so it is a pattern; the others are literal.
PY_IMPORT_PATTERN = r"from snowflake\.snowpark import[^\n]*"
PY_IMPORT_TARGET = "from pyspark.sql import SparkSession, DataFrame"
PY_REWRITES = (
    ("snowpark.Session", "SparkSession"),
    ("session.", "spark."),
)
# Every rewrite literal holds one of these.
REWRITE_PARTS = ("snowflake", "snowpark", "session.")
HELPER_CALL = "sql.connect("
HELPER_NAME = "get_db_connection"

CONNECTION_HELPER = '''def get_db_connection(prefix="DATABRICKS_"):
    """One connection to the SQL warehouse that the environment names."""
    from os import environ

    import databricks.sql

    keys = {"server_hostname": "SERVER_HOSTNAME", "http_path": "HTTP_PATH", "access_token": "TOKEN"}
    return databricks.sql.connect(**{name: environ[prefix + key] for name, key in keys.items()})


'''

SQL_STAMP_TAIL = """-- Carried over as it was; nothing below this header has been translated.
-- Check warehouse-specific syntax by hand before running it.

"""

# --- fixed values: target layout -------------------------------------------------------------------
UI_TARGET = "src/streamlit_app.py"
PAGES_PART = "pages/"

# --- fixed values: target requirements -------------------------------------------------------------
REQ_ALWAYS = "databricks-sql-connector>=3.0.0"
REQ_UI = "streamlit>=1.30.0"
REQ_API = "flask>=3.0.0"
REQ_USAGE = "pyspark>=3.5.0"
DROP_CONTAINING = ("snowflake-connector", "snowflake-snowpark")
DROP_EXACT = ("streamlit", "flask", "pyspark")
CONNECTOR_PACKAGE = "snowflake-connector-python"
SNOWPARK_PACKAGE = "snowflake-snowpark-python"

# --- fixed values: privilege verb -> target --------------------------------------------------------
PRIVILEGE_TARGETS = (
    ("USAGE", "USE SCHEMA"),
    ("SELECT", "SELECT"),
    ("EXECUTE", "EXECUTE"),
    ("APPLICATION ROLE", "SERVICE PRINCIPAL"),
)
NEEDS_REVIEW = "needs_review"
PERMISSION_KEY = "privilege"
PERMISSION = "CAN_VIEW"

# --- advice: (code, guard column, text), in the order it is given -----------------------------------
ADVICE = (
    ("ui_runtime", "has_streamlit", "The app shows pages: host it where Streamlit apps run on the target"),
    ("ui_connector", "has_streamlit", "Its connections must be opened through the databricks SQL driver"),
    ("ui_table_calls", "has_streamlit", "Whatever it reads by table name goes through the Spark session"),
    ("api_runtime", "has_api", "The app answers requests: it needs a process that serves HTTP"),
    ("api_auth", "has_api", "Say in app.yaml who may call it"),
    ("procedures", "has_stored_procedures", "Stored procedures have no counterpart: make each a function or a notebook"),
    ("udfs", "has_udfs", "User-defined functions have to be declared again, in SQL or Python"),
    ("usage_convert", "has_api_usage", "Calls of the platform's DataFrame library become PySpark"),
    ("usage_key_calls", "has_api_usage", "Most of them are table and sql calls on the session; begin there"),
    ("swap_connector", "needs_connector", "Requirements: databricks-sql-connector in place of snowflake-connector-python"),
    ("swap_snowpark", "needs_snowpark", "Requirements: pyspark in place of snowflake-snowpark-python"),
    ("phased", "is_high", "The score is high: move in steps, each of which can be checked"),
    ("phase_data", "is_high", "Step 1: tables, views and other SQL"),
    ("phase_logic", "is_high", "Step 2: Python that works on data"),
    ("phase_ui", "is_high", "Step 3: what users see"),
    ("grants_review", "has_privileges", "The manifest asks for privileges: each needs a grant in the catalog"),
    ("grants_mapping", "has_privileges", "A schema's USAGE is called USE SCHEMA there; SELECT and EXECUTE keep their names"),
)
