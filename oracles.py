"""The SQL each query must agree with, written for DuckDB over the same tables.

Independent of the engine: nothing is imported from it, and counts, splits and classifications are
spelled out again in plain SQL.
"""

from __future__ import annotations

import re

# --- the derived estate ----------------------------------------------------------------------------

DOCS = """
d0 AS (
    SELECT doc_id, text, lang, doc_id // 20 AS g, doc_id % 20 AS i,
           CAST((doc_id % 20) % (1 + (doc_id // 20) % 13) AS INTEGER) AS k,
           doc_id % 17 <> 5 AS readable
    FROM documents
), d AS (
    SELECT *, CASE WHEN g % 2 = 0 THEN 'App ' || g ELSE 'App ' || g || '-' || (i // 4) END AS app_id
    FROM d0
), apps AS (
    SELECT DISTINCT app_id, g FROM d
)"""

FILES = DOCS + """, snippets AS (
    SELECT * FROM (VALUES
      (0, 'python', 'import pandas as pd|df = pd.DataFrame()|'),
      (1, 'sql', 'SELECT 1 AS one;|'),
      (2, 'python', 'import streamlit as st|st.title(1)|'),
      (3, 'requirements', '# core|pandas==2.0|  snowflake-connector-python>=3.0|streamlit||numpy<=1.26|Flask~=2.0|'),
      (4, 'python', 'import streamlit as st|import snowflake.connector|conn = snowflake.connector.connect(x)|session.sql(q)|'),
      (5, 'sql', 'CREATE OR REPLACE VIEW v AS SELECT 1;|'),
      (6, 'python', 'from snowflake.snowpark import Session|a = session.table(1)|b = session.table(2)|c = session.create_dataframe(z)|d = session.sql(a)|e = session.sql(b)|f = session.sql(c)|'),
      (7, 'sql', 'create or replace function f() returns int;|'),
      (8, 'python', 'from snowflake.snowpark.functions import udf|@udf|def f(x): pass|'),
      (9, 'sql', 'CREATE OR REPLACE PROCEDURE p() AS x; COPY INTO t FROM @s;|'),
      (10, 'python', 'from flask import Flask|@app.route(1)|'),
      (11, 'sql', 'SELECT f.value FROM t, LATERAL FLATTEN(input => t.v) f; -- VARIANT|'),
      (12, 'python', '@sproc|@udf|def p(session): return session.sql(q)|')
    ) AS s(k, kind, snippet)
), files AS (
    SELECT app_id, kind, readable,
           CASE WHEN kind = 'requirements' THEN 'd' || i || '/requirements.txt'
                WHEN kind = 'sql' THEN 'sql/d' || i || '/s' || (doc_id % 3) || '.sql'
                WHEN d.k = 2 AND doc_id % 2 = 0 THEN 'pages/p' || i || '.py'
                ELSE 'd' || i || '/m' || (doc_id % 3) || '.py' END AS path,
           CASE WHEN readable THEN replace(snippet, '|', chr(10)) ||
                CASE WHEN kind = 'requirements'
                     THEN lang || '-tools>=1.0' || chr(10) || '# ' || replace(text, chr(10), chr(10) || '# ') || chr(10)
                     ELSE text END END AS content
    FROM d JOIN snippets s ON d.k = s.k
    UNION ALL
    SELECT app_id, 'python', true, 'd' || i || '/__init__.py', '' FROM d WHERE d.k = 0
)"""

MANIFESTS = DOCS + """, manifests AS (
    SELECT app_id, g,
           CASE g % 5 WHEN 2 THEN 'manifest.yaml' ELSE 'manifest.yml' END AS file_name,
           CASE g % 5 WHEN 3 THEN 'invalid' ELSE 'ok' END AS status,
           CASE g % 5 WHEN 3 THEN 'version is not a mapping' END AS error,
           CASE WHEN g % 5 <> 3 THEN '1' END AS manifest_version,
           CASE g % 5 WHEN 2 THEN '1.0' WHEN 3 THEN NULL ELSE '1.' || g || '.0' END AS version,
           CASE WHEN g % 5 <> 3 THEN 'Dashboard ' || g END AS label,
           g % 5 <> 3 AS has_privileges
    FROM apps WHERE g % 5 <> 0
), catalog AS (
    SELECT a.app_id, m.file_name, coalesce(m.status, 'missing') AS status, m.error, m.manifest_version,
           m.version, m.label, coalesce(m.has_privileges, false) AS has_privileges
    FROM apps a LEFT JOIN manifests m ON a.app_id = m.app_id
), privileges AS (
    SELECT app_id, 1 AS entry_no, 'USAGE on SCHEMA' AS entry_key, 'USAGE' AS verb, 'SCHEMA' AS object_type,
           1 AS object_no, 'app_schema_' || g AS object FROM manifests WHERE status = 'ok'
    UNION ALL
    SELECT app_id, 2, 'SELECT on ALL TABLES IN SCHEMA', 'SELECT', 'ALL TABLES IN SCHEMA', n,
           CASE n WHEN 1 THEN 'app_schema_' || g ELSE 'ref_schema' END
    FROM manifests, (VALUES (1), (2)) AS t(n) WHERE status = 'ok'
    UNION ALL
    SELECT app_id, 3, 'EXECUTE on ALL FUNCTIONS IN SCHEMA', 'EXECUTE', 'ALL FUNCTIONS IN SCHEMA', 1, 'app_schema'
    FROM manifests WHERE status = 'ok'
    UNION ALL
    SELECT app_id, 4, 'privilege', 'PRIVILEGE', NULL, 1, 'CREATE DATABASE'
    FROM manifests WHERE status = 'ok' AND g % 2 = 0
    UNION ALL
    SELECT app_id, CASE WHEN g % 2 = 0 THEN 5 ELSE 4 END, 'APPLICATION ROLE on SCHEMA', 'APPLICATION ROLE',
           'SCHEMA', 1, 'app_schema'
    FROM manifests WHERE status = 'ok' AND g % 3 = 0
    UNION ALL
    SELECT app_id, 4 + CASE WHEN g % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN g % 3 = 0 THEN 1 ELSE 0 END, key, upper(key), NULL, 1, object
    FROM manifests, (VALUES ('privilege', 'MANAGE EVENTS'), ('remark', 'odd')) AS t(key, object) WHERE status = 'ok' AND g % 7 = 1
), keyed AS (
    SELECT *, CASE entry_key WHEN 'remark' THEN 2 ELSE 1 END AS key_no FROM privileges
), mapped AS (
    SELECT app_id, entry_no, key_no, entry_key, object_no, verb, object_type, object,
           CASE verb WHEN 'USAGE' THEN 'USE SCHEMA' WHEN 'SELECT' THEN 'SELECT' WHEN 'EXECUTE' THEN 'EXECUTE'
                     WHEN 'APPLICATION ROLE' THEN 'SERVICE PRINCIPAL' ELSE 'needs_review' END AS target
    FROM keyed
)"""


MANIFEST_TEXTS_TAIL = """, manifest_versions AS (
    SELECT app_id, 'manifest.yml' AS path, g, '  name: 1.' || g || '.0|' AS version_lines FROM apps WHERE g % 5 IN (1, 4)
    UNION ALL SELECT app_id, 'manifest.yaml', g, '' FROM apps WHERE g % 5 = 2
    UNION ALL SELECT app_id, 'manifest.yaml', g, '  name: 0.' || g || '.9|' FROM apps WHERE g % 5 = 4
    UNION ALL SELECT app_id, 'manifest.yml', g, NULL FROM apps WHERE g % 5 = 3
), manifest_texts AS (
    SELECT app_id, path, replace(CASE
        WHEN version_lines IS NULL THEN 'manifest_version: 1|version: abc|'
        ELSE 'manifest_version: 1|version:|' || version_lines || '  label: Dashboard ' || g ||
             '|artifacts:|  - src: streamlit_app.py|    dest: /|  - src: sql/setup_' || g ||
             '.sql|    dest: /|privileges:|  - USAGE on SCHEMA:|      - app_schema_' || g ||
             '|  - SELECT on ALL TABLES IN SCHEMA:|      - app_schema_' || g ||
             '|      - ref_schema|  - EXECUTE on ALL FUNCTIONS IN SCHEMA:|      - app_schema|' ||
             CASE WHEN g % 2 = 0 THEN '  - privilege: CREATE DATABASE|' ELSE '' END ||
             CASE WHEN g % 3 = 0 THEN '  - APPLICATION ROLE on SCHEMA: [app_schema]|' ELSE '' END ||
             CASE WHEN g % 7 = 1 THEN '  - privilege: MANAGE EVENTS|    remark: odd|' ELSE '' END ||
             'configuration:|  log_level: INFO|  enable_telemetry: true|' ||
             CASE WHEN g % 4 = 1 THEN '  limit: .nan|  2024-01-05: .inf|' ELSE '' END END, '|', chr(10)) AS body
    FROM manifest_versions
)"""


def _hits(text: str, literal: str) -> str:
    return f"coalesce(len(string_split({text}, '{literal}')) - 1, 0)"


_FEATURES = [
    ("from snowflake.snowpark", "from snowflake.snowpark"),
    ("import snowflake.snowpark", "import snowflake.snowpark"),
    ("session.table", "session.table("),
    ("session.create_dataframe", "session.create_dataframe("),
    ("session.sql", "session.sql("),
    ("@udf", "@udf"),
    ("@sproc", "@sproc"),
]
_USES = ", ".join(
    f"CASE WHEN kind = 'python' THEN {_hits('content', lit)} ELSE 0 END AS u{n}" for n, (_, lit) in enumerate(_FEATURES)
)

FACTS = FILES + f""", flagged AS (
    SELECT *, regexp_extract(path, '[^/]+$') AS name,
           readable AND kind IN ('python', 'sql') AS is_component,
           coalesce(length(content) = 0, false) AS is_empty,
           coalesce(kind = 'python' AND (contains(content, 'import streamlit') OR contains(content, 'from streamlit')
               OR contains(content, 'st.') OR contains(content, 'streamlit_app')), false) AS is_ui,
           coalesce(kind = 'python' AND (contains(content, 'from flask') OR contains(content, 'from fastapi')
               OR contains(content, '@app.route') OR contains(content, '@app.get')
               OR contains(content, '@app.post')), false) AS is_api,
           coalesce(kind = 'python' AND contains(content, '@udf'), false) AS py_udf,
           coalesce(kind = 'python' AND contains(content, '@sproc'), false) AS py_procedure,
           coalesce(kind = 'sql' AND contains(upper(content), 'CREATE OR REPLACE PROCEDURE'), false) AS sql_procedure,
           coalesce(kind = 'sql' AND contains(upper(content), 'CREATE OR REPLACE FUNCTION'), false) AS sql_udf,
           coalesce(kind = 'sql' AND (contains(upper(content), 'CREATE OR REPLACE VIEW')
               OR contains(upper(content), 'CREATE VIEW')), false) AS is_view,
           coalesce(kind = 'sql' AND contains(upper(content), 'VARIANT'), false) AS c1,
           coalesce(kind = 'sql' AND contains(upper(content), 'FLATTEN('), false) AS c2,
           coalesce(kind = 'sql' AND contains(upper(content), 'LATERAL FLATTEN'), false) AS c3,
           coalesce(kind = 'sql' AND contains(upper(content), 'COPY INTO'), false) AS c4,
           {_USES}
    FROM files
), facts AS (
    SELECT *, py_udf OR sql_udf AS is_udf, py_procedure OR sql_procedure AS is_procedure,
           CASE WHEN NOT is_component THEN NULL
                WHEN py_procedure THEN 'procedure' WHEN py_udf THEN 'udf' WHEN is_api THEN 'api'
                WHEN is_ui THEN 'streamlit' WHEN kind = 'python' THEN 'python'
                WHEN is_view THEN 'view' WHEN sql_udf THEN 'udf' WHEN sql_procedure THEN 'procedure'
                ELSE 'sql' END AS type,
           CASE WHEN NOT is_component THEN NULL
                WHEN kind = 'python' THEN CASE WHEN py_udf OR py_procedure THEN 'medium' ELSE 'low' END
                WHEN c1 OR c2 OR c3 OR c4 THEN 'high' WHEN is_view THEN 'low' WHEN sql_udf THEN 'medium'
                WHEN sql_procedure THEN 'high' ELSE 'low' END AS complexity
    FROM flagged
)"""

REQUIREMENTS = FILES + """, numbered AS (
    SELECT app_id, path, unnest(string_split(content, chr(10))) AS raw_line,
           generate_subscripts(string_split(content, chr(10)), 1) AS line_no
    FROM files WHERE kind = 'requirements' AND readable
), lines AS (
    SELECT app_id, path, CAST(line_no AS INTEGER) AS line_no, trim(raw_line) AS line
    FROM numbered WHERE trim(raw_line) <> '' AND NOT starts_with(trim(raw_line), '#')
), parsed AS (
    SELECT app_id, path, line_no,
           trim(split_part(split_part(split_part(line, '==', 1), '>=', 1), '<=', 1)) AS package
    FROM lines
), dependencies AS (
    SELECT DISTINCT app_id, package FROM parsed
)"""
REQUIREMENTS_TAIL = REQUIREMENTS[len(FILES):]
MANIFESTS_TAIL = MANIFESTS[len(DOCS):]

APPS_TAIL = """, sums AS (
    SELECT app_id, count(*) FILTER (WHERE kind = 'python') AS python_files,
           count(*) FILTER (WHERE kind = 'sql') AS sql_files,
           count(*) FILTER (WHERE is_component) AS components,
           count(*) FILTER (WHERE is_ui) AS ui_pages,
           count(*) FILTER (WHERE NOT readable AND kind <> 'requirements') AS unreadable_files,
           count(*) FILTER (WHERE NOT readable AND kind = 'requirements') AS unreadable_requirements,
           bool_or(is_ui) AS has_streamlit, bool_or(is_api) AS has_api,
           bool_or(is_procedure) AS has_stored_procedures, bool_or(is_udf) AS has_udfs,
           CAST(sum(u0) AS BIGINT) AS u0, CAST(sum(u1) AS BIGINT) AS u1, CAST(sum(u2) AS BIGINT) AS u2,
           CAST(sum(u3) AS BIGINT) AS u3, CAST(sum(u4) AS BIGINT) AS u4, CAST(sum(u5) AS BIGINT) AS u5,
           CAST(sum(u6) AS BIGINT) AS u6
    FROM facts GROUP BY app_id
), scored AS (
    SELECT *, u0 + u1 + u2 + u3 + u4 + u5 + u6 AS api_usage_total,
           CAST(u0 > 0 AS INTEGER) + CAST(u1 > 0 AS INTEGER) + CAST(u2 > 0 AS INTEGER) + CAST(u3 > 0 AS INTEGER)
           + CAST(u4 > 0 AS INTEGER) + CAST(u5 > 0 AS INTEGER) + CAST(u6 > 0 AS INTEGER) AS features
    FROM sums
), points AS (
    SELECT *, CAST(2 * CAST(has_streamlit AS INTEGER) + 3 * CAST(has_api AS INTEGER)
           + 5 * CAST(has_stored_procedures AS INTEGER) + 3 * CAST(has_udfs AS INTEGER)
           + least(features, 5) + least(sql_files, 5) AS INTEGER) AS score
    FROM scored
), app_facts AS (
    SELECT *, CASE WHEN score <= 5 THEN 'low' WHEN score <= 12 THEN 'medium' ELSE 'high' END AS migration_complexity,
           CASE WHEN has_streamlit THEN 'Streamlit' WHEN has_api THEN 'API' ELSE 'Generic' END AS app_type
    FROM points
)"""
APPS = FACTS + APPS_TAIL

_LONG_USAGE = " UNION ALL ".join(
    f"SELECT app_id, '{label}' AS feature, u{n} AS uses FROM app_facts WHERE u{n} > 0" for n, (label, _) in enumerate(_FEATURES)
)

VERSIONS_TAIL = r""", pins AS (
    SELECT app_id, doc_id % 12 AS t, doc_id % 9 AS p, doc_id % 4 AS a, doc_id % 11 AS b FROM d
), pin_lines AS (
    SELECT app_id, unnest(CASE t
        WHEN 0 THEN ['Lib_' || p || '>=' || a || '.' || b]
        WHEN 1 THEN ['lib.' || p || ' < ' || a || '.' || b || '.0']
        WHEN 2 THEN ['lib-' || p || '[fast]~=' || a || '.' || b || '.1  # note']
        WHEN 3 THEN ['lib-' || p || '==' || a || '.' || b]
        WHEN 4 THEN ['lib-' || p || '!=' || a || '.*,<=3.' || b]
        WHEN 5 THEN ['lib-' || p || '>' || a || '.' || b || 'rc1,!=' || a || '.10']
        WHEN 6 THEN ['lib-' || p || '==' || a || '.*']
        WHEN 7 THEN ['lib-' || p || '>=' || b || '.0; python_version<''3.9''']
        WHEN 8 THEN ['lib-' || p || ' (>=' || a || '.1.0, <' || b || ')']
        WHEN 9 THEN ['lib-' || p || '==latest', 'lib-' || p || '~=' || b]
        WHEN 10 THEN ['lib-' || p || '==0.' || b || '.0']
        ELSE ['lib-' || p] END) AS line
    FROM pins
), bare AS (
    SELECT app_id, regexp_replace(line, '(^|\s)#.*$', '') AS line FROM lines
    UNION ALL SELECT app_id, regexp_replace(line, '(^|\s)#.*$', '') FROM pin_lines
), halves AS (
    SELECT app_id, trim(split_part(line, ';', 1)) AS named,
           CASE WHEN contains(line, ';') THEN trim(substr(line, strpos(line, ';') + 1)) ELSE '' END AS marker
    FROM bare
), named AS (
    SELECT app_id, marker, regexp_extract(named, '^[A-Za-z0-9]([A-Za-z0-9._-]*[A-Za-z0-9])?') AS name,
           trim(regexp_replace(named, '^[A-Za-z0-9]([A-Za-z0-9._-]*[A-Za-z0-9])?\s*(\[[^\]]*\])?', '')) AS rest
    FROM halves WHERE regexp_matches(named, '^[A-Za-z0-9]') AND NOT regexp_matches(named, '[@/\\]')
), listed AS (
    SELECT app_id, marker, regexp_replace(lower(name), '[-_.]+', '-', 'g') AS package,
           list_filter(list_transform(string_split(regexp_replace(rest, '^\((.*)\)$', '\1'), ','), lambda x: trim(x)), lambda x: x <> '') AS specifiers
    FROM named
), single AS (
    SELECT app_id, package, marker, unnest(CASE WHEN len(specifiers) = 0 THEN [NULL] ELSE specifiers END) AS specifier FROM listed
), signed AS (
    SELECT *, coalesce(regexp_extract(specifier, '^(===|==|~=|!=|<=|>=|<|>)'), '') AS sign,
           lower(trim(regexp_replace(specifier, '^(===|==|~=|!=|<=|>=|<|>)\s*v?', ''))) AS given FROM single
), versioned AS (
    SELECT *, coalesce(ends_with(given, '.*') AND sign IN ('==', '!='), false) AS whole,
           CASE WHEN ends_with(given, '.*') AND sign IN ('==', '!=') THEN given[:-3] ELSE given END AS version FROM signed
), parts AS (
    SELECT *, regexp_extract(version, '^([0-9]+!)?([0-9]+(\.[0-9]+)*)([-_.]?(alpha|beta|preview|dev|post|rev|pre|rc|a|b|c|r)[-_.]?([0-9]*))?$',
               ['epoch', 'release', 'x', 'suffix', 'word', 'number']) AS m
    FROM versioned
), keyed_versions AS (
    SELECT *, m.release <> '' AS is_version,
           [CASE WHEN m.epoch = '' THEN 0 ELSE TRY_CAST(m.epoch[:-2] AS BIGINT) END]
             || list_transform(string_split(regexp_replace(m.release, '(\.0+)+$', ''), '.'), lambda x: TRY_CAST(x AS BIGINT)) AS stem,
           CASE WHEN m.word = '' THEN -1 WHEN m.word = 'dev' THEN -5 WHEN m.word IN ('a', 'alpha') THEN -4 WHEN m.word IN ('b', 'beta') THEN -3
                WHEN m.word IN ('post', 'rev', 'r') THEN -1 ELSE -2 END AS phase,
           CASE WHEN m.word IN ('post', 'rev', 'r') THEN 1 ELSE 0 END + coalesce(TRY_CAST(m.number AS BIGINT), 0) AS nth,
           string_split(m.release, '.') AS numbers
    FROM parts
), stems AS (
    SELECT *, CASE WHEN whole THEN numbers WHEN sign = '~=' THEN numbers[:-2] END AS shared FROM keyed_versions
), bumped AS (
    SELECT *, m.epoch || array_to_string(shared[:-2] || [CAST(TRY_CAST(shared[-1] AS BIGINT) + 1 AS VARCHAR)], '.') AS upto,
           array_to_string(shared[:-2] || [CAST(TRY_CAST(shared[-1] AS BIGINT) + 1 AS VARCHAR)], '.') AS upto_release FROM stems
), bounded AS (
    SELECT app_id, package, marker, specifier, sign = '!=' AS excludes,
           coalesce(is_version AND sign <> '' AND (NOT whole OR m.suffix = '') AND (sign <> '~=' OR len(shared) > 0), false) AS fine,
           CASE WHEN whole THEN {'k': stem || [-5, 0], 'f': 0, 't': '>=' || version || '.dev0'}
                WHEN sign IN ('<', '<=') THEN NULL
                WHEN sign = '>' THEN {'k': stem || [phase, CASE WHEN phase = -1 AND nth = 0 THEN 9223372036854775807 ELSE nth END], 'f': 1, 't': '>' || version}
                ELSE {'k': stem || [phase, nth], 'f': 0, 't': '>=' || version} END AS lo,
           CASE WHEN whole OR sign = '~=' THEN {'k': [stem[1]] || list_transform(string_split(regexp_replace(upto_release, '(\.0+)+$', ''), '.'), lambda x: TRY_CAST(x AS BIGINT)) || [-5, 0], 'f': -1, 't': '<' || upto || '.dev0'}
                WHEN sign IN ('>', '>=') THEN NULL
                WHEN sign = '<' THEN {'k': stem || CASE WHEN phase = -1 THEN [-5, 0] ELSE [phase, nth] END, 'f': -1, 't': '<' || version}
                ELSE {'k': stem || [phase, nth], 'f': 0, 't': '<=' || version} END AS hi
    FROM bumped
), tightest AS (
    SELECT app_id, package, marker, max(lo) FILTER (fine AND NOT excludes AND lo IS NOT NULL) AS lo, min(hi) FILTER (fine AND NOT excludes AND hi IS NOT NULL) AS hi,
           count(specifier) AS specifiers, count(*) FILTER (specifier IS NOT NULL AND NOT fine) AS unreadable
    FROM bounded GROUP BY ALL
), holes AS (
    SELECT DISTINCT app_id, package, marker, specifier, lo, hi FROM bounded WHERE fine AND excludes
), met AS (
    SELECT t.app_id, t.package, t.marker, count(*) AS exclusions,
           bool_or(t.lo IS NOT NULL AND t.hi IS NOT NULL AND (h.lo.k, h.lo.f) <= (t.lo.k, t.lo.f) AND (t.hi.k, t.hi.f) <= (h.hi.k, h.hi.f)) AS covered
    FROM tightest t JOIN holes h USING (app_id, package, marker)
    WHERE (t.lo IS NULL OR (t.lo.k, t.lo.f) <= (h.hi.k, h.hi.f)) AND (t.hi IS NULL OR (h.lo.k, h.lo.f) <= (t.hi.k, t.hi.f)) GROUP BY ALL
), told AS (
    SELECT t.*, coalesce(exclusions, 0) AS exclusions,
           CASE WHEN coalesce(covered, false) OR (t.lo IS NOT NULL AND t.hi IS NOT NULL AND (t.lo.k, t.lo.f) > (t.hi.k, t.hi.f)) THEN 'conflict'
                WHEN t.lo.k = t.hi.k AND t.lo.f = 0 AND t.hi.f = 0 THEN 'pinned'
                WHEN t.lo IS NULL AND t.hi IS NULL THEN 'any' ELSE 'range' END AS status
    FROM tightest t LEFT JOIN met USING (app_id, package, marker)
)
SELECT app_id, package, marker, lo.t AS lower, hi.t AS upper, specifiers, unreadable, exclusions, status,
       CASE status WHEN 'conflict' THEN NULL
            ELSE package || CASE status WHEN 'pinned' THEN '==' || lo.t[3:] ELSE concat_ws(',', lo.t, hi.t) END || CASE WHEN marker <> '' THEN '; ' || marker ELSE '' END END AS requirement
FROM told"""

ADVICE_TAIL = REQUIREMENTS_TAIL + MANIFESTS_TAIL + """, guarded AS (
    SELECT f.*, c.status, c.has_privileges, f.api_usage_total > 0 AS has_api_usage,
           f.app_id IN (SELECT app_id FROM dependencies WHERE package = 'snowflake-connector-python') AS needs_connector,
           f.app_id IN (SELECT app_id FROM dependencies WHERE package = 'snowflake-snowpark-python') AS needs_snowpark
    FROM app_facts f JOIN catalog c ON f.app_id = c.app_id
), advice AS (
    SELECT app_id, seq, code, text FROM guarded, (VALUES
      (1, 'ui_runtime', 'ui', 'The app shows pages: host it where Streamlit apps run on the target'),
      (2, 'ui_connector', 'ui', 'Its connections must be opened through the databricks SQL driver'),
      (3, 'ui_table_calls', 'ui', 'Whatever it reads by table name goes through the Spark session'),
      (4, 'api_runtime', 'api', 'The app answers requests: it needs a process that serves HTTP'),
      (5, 'api_auth', 'api', 'Say in app.yaml who may call it'),
      (6, 'procedures', 'proc', 'Stored procedures have no counterpart: make each a function or a notebook'),
      (7, 'udfs', 'udf', 'User-defined functions have to be declared again, in SQL or Python'),
      (8, 'usage_convert', 'use', 'Calls of the platform''s DataFrame library become PySpark'),
      (9, 'usage_key_calls', 'use', 'Most of them are table and sql calls on the session; begin there'),
      (10, 'swap_connector', 'conn', 'Requirements: databricks-sql-connector in place of snowflake-connector-python'),
      (11, 'swap_snowpark', 'snow', 'Requirements: pyspark in place of snowflake-snowpark-python'),
      (12, 'phased', 'high', 'The score is high: move in steps, each of which can be checked'),
      (13, 'phase_data', 'high', 'Step 1: tables, views and other SQL'),
      (14, 'phase_logic', 'high', 'Step 2: Python that works on data'),
      (15, 'phase_ui', 'high', 'Step 3: what users see'),
      (16, 'grants_review', 'priv', 'The manifest asks for privileges: each needs a grant in the catalog'),
      (17, 'grants_mapping', 'priv', 'A schema''s USAGE is called USE SCHEMA there; SELECT and EXECUTE keep their names')
    ) AS r(seq, code, guard, text)
    WHERE CASE guard WHEN 'ui' THEN has_streamlit WHEN 'api' THEN has_api WHEN 'proc' THEN has_stored_procedures
               WHEN 'udf' THEN has_udfs WHEN 'use' THEN has_api_usage WHEN 'conn' THEN needs_connector
               WHEN 'snow' THEN needs_snowpark WHEN 'high' THEN migration_complexity = 'high'
               ELSE has_privileges END
)"""

WARNINGS_TAIL = """, warned AS (
    SELECT app_id, 'manifest_' || status AS code, file_name AS path, error AS detail FROM catalog WHERE status <> 'ok'
    UNION ALL
    SELECT app_id, CASE kind WHEN 'requirements' THEN 'requirements_unreadable' ELSE 'file_unreadable' END, path, 'not UTF-8'
    FROM facts WHERE NOT readable
    UNION ALL
    SELECT app_id, 'heavy_usage', NULL, CAST(api_usage_total AS VARCHAR) FROM app_facts WHERE api_usage_total > 20
)"""

TARGETS_TAIL = """, placed AS (
    SELECT app_id, path, name, type, complexity, is_empty, content,
           CASE WHEN is_empty THEN NULL
                WHEN type = 'streamlit' AND contains(path, 'pages/') THEN 'src/' || path
                WHEN type = 'streamlit' THEN 'src/streamlit_app.py'
                WHEN type IN ('python', 'api') THEN 'src/' || name
                WHEN type = 'sql' THEN 'databricks/' || name END AS target_path
    FROM facts WHERE is_component
), winners AS (
    SELECT app_id, target_path, max(path) AS path, count(*) AS sources
    FROM placed WHERE target_path IS NOT NULL GROUP BY app_id, target_path
), targets AS (
    SELECT p.app_id, p.path, p.type, p.complexity, p.target_path,
           CASE WHEN p.type IN ('udf', 'procedure', 'view') THEN 'skipped_type'
                WHEN p.is_empty THEN 'skipped_empty'
                WHEN w.path IS NULL THEN 'lost_to_collision' ELSE 'written' END AS status,
           w.sources
    FROM placed p LEFT JOIN winners w ON p.app_id = w.app_id AND p.path = w.path
)"""

_UI_RULES = [
    ("import snowflake.connector", "from databricks import sql"),
    ("from snowflake import connector", "from databricks import sql"),
    ("snowflake.connector.connect(", "sql.connect("),
    ("from snowflake.snowpark import Session", "from pyspark.sql import SparkSession"),
    ("session.table(", "spark.table("),
    ("session.sql(", "spark.sql("),
]
_PY_IMPORT = r"from snowflake\.snowpark import[^\n]*"


def _ui_after(n: int) -> str:
    text = "content"
    for old, new in _UI_RULES[:n]:
        text = f"replace({text}, '{old}', '{new}')"
    return text


_PY_1 = f"regexp_replace(content, '{_PY_IMPORT}', 'from pyspark.sql import SparkSession, DataFrame', 'g')"
_PY_2 = f"replace({_PY_1}, 'snowpark.Session', 'SparkSession')"
_PY_3 = f"replace({_PY_2}, 'session.', 'spark.')"

_HELPER = '''def get_db_connection(prefix="DATABRICKS_"):
    """One connection to the SQL warehouse that the environment names."""
    from os import environ

    import databricks.sql

    keys = {"server_hostname": "SERVER_HOSTNAME", "http_path": "HTTP_PATH", "access_token": "TOKEN"}
    return databricks.sql.connect(**{name: environ[prefix + key] for name, key in keys.items()})


'''
_STAMP = """
-- Carried over as it was; nothing below this header has been translated.
-- Check warehouse-specific syntax by hand before running it.

"""

REWRITTEN_TAIL = f""", changed AS (
    SELECT *, CASE WHEN type = 'streamlit' THEN {_ui_after(6)}
                   WHEN type = 'sql' THEN '-- Source file: ' || path || '{_STAMP}' || content
                   WHEN contains(content, 'snowpark') THEN {_PY_3}
                   ELSE content END AS step
    FROM placed WHERE target_path IS NOT NULL
), rewritten AS (
    SELECT app_id, path, type, target_path,
           CASE WHEN type = 'streamlit' AND contains(step, 'sql.connect(') AND NOT contains(step, 'get_db_connection')
                THEN '{_HELPER}' || step ELSE step END AS new_content
    FROM changed
)"""
REWRITTEN = FACTS + TARGETS_TAIL + REWRITTEN_TAIL

_RULE_HITS = [
    (f"ui: {old}", "type = 'streamlit'", _hits(_ui_after(n), old)) for n, (old, _) in enumerate(_UI_RULES)
] + [
    (
        "py: from snowflake.snowpark import",
        "type IN ('python', 'api') AND contains(content, 'snowpark')",
        f"len(regexp_extract_all(content, '{_PY_IMPORT}'))",
    ),
    ("py: snowpark.Session", "type IN ('python', 'api') AND contains(content, 'snowpark')", _hits(_PY_1, "snowpark.Session")),
    ("py: session.", "type IN ('python', 'api') AND contains(content, 'snowpark')", _hits(_PY_2, "session.")),
]
_HITS_SQL = " UNION ALL ".join(
    f"SELECT app_id, '{label}' AS rule, {count} AS n FROM facts WHERE is_component AND {where}"
    for label, where, count in _RULE_HITS
)

_RULE_TEXTS = [(f"ui: {old}", "type = 'streamlit'", _ui_after(n), old) for n, (old, _) in enumerate(_UI_RULES)] + [
    (f"py: {old}", "type IN ('python', 'api') AND contains(content, 'snowpark')", text, old)
    for old, text in (("from snowflake.snowpark import", "content"), ("snowpark.Session", _PY_1), ("session.", _PY_2))
]
# No rule writes or crosses the end of a line, so a line has the same number in every step.
_PLACES_SQL = " UNION ALL ".join(
    f"""SELECT app_id, path, '{label}' AS rule, line, {_hits("l", old)} AS n, strpos(l, '{old}') AS first_at,
               length(l) - length('{old}') + 2 - strpos(reverse(l), reverse('{old}')) AS last_at
        FROM (SELECT app_id, path, unnest(string_split({text}, chr(10))) AS l, generate_subscripts(string_split({text}, chr(10)), 1) AS line
              FROM facts WHERE is_component AND {where}) WHERE contains(l, '{old}')"""
    for label, where, text, old in _RULE_TEXTS
)

# --- the sales fact --------------------------------------------------------------------------------

SALES = """
sales AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
           p_name AS product_name, r_name AS region,
           CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
           CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) AS revenue,
           1 AS order_count, o_orderdate AS order_date
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey
)"""
DASHBOARD = "year = 2000 AND region IN ('ASIA', 'EUROPE')"
GROWTH = SALES + """, yearly AS (
    SELECT year, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales GROUP BY year
), growth AS (
    SELECT c.year, c.revenue, p.revenue AS prior_revenue,
           (c.revenue - p.revenue) / nullif(p.revenue, 0) AS growth
    FROM yearly c JOIN yearly p ON c.year = p.year + 1
)"""
LAST_YEAR = f"(SELECT CAST(sum(revenue) AS DECIMAL(28,2)) FROM sales WHERE {DASHBOARD})"
ORDER_OBJECTS = """objects AS (
    SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '{}' WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(to_json({
        'status': o_orderstatus, 'year': year(o_orderdate), 'of': {'customer': o_custkey, 'priority': o_orderpriority}}) AS VARCHAR) END AS object
    FROM orders
)"""
_PLACE = "('0x' || substr(md5(app_id || '/' || path), 1, 4))::INTEGER % 29"
_LATER_LINES = "chr(10) || 'import streamlit as st' || chr(10) || 'result = session.sql(q)' || chr(10)"


def _later(name: str, columns: str, text: str) -> str:
    """The later scan of a table with app_id, path and a text."""
    moves = [("path", "n NOT IN (3, 4, 5, 7)"), ("'moved/' || path", "n = 5"), ("'copies/' || path", "n = 6"),
             ("'left/' || path", "n = 7"), ("'right/' || path", "n = 7")]
    parts = [f"SELECT app_id, {path} AS path, {columns}, {text} FROM placed_{name} WHERE {where}" for path, where in moves]
    parts.append(f"SELECT app_id, path, {columns}, {text} || {_LATER_LINES} FROM placed_{name} WHERE n = 4")
    return f"""placed_{name} AS (SELECT *, {_PLACE} AS n FROM {name}), later_{name} AS ({" UNION ALL ".join(parts)})"""


#: Every file of both scans with its bytes spelled as text; the byte that is no text is written out.
_BODY = """replace(snippet, '|', chr(10)) || CASE WHEN kind = 'requirements'
        THEN lang || '-tools>=1.0' || chr(10) || '# ' || replace(text, chr(10), chr(10) || '# ') || chr(10) ELSE text END"""
CHANGES = FILES + f""", raw AS (
    SELECT app_id, CASE WHEN kind = 'requirements' THEN 'd' || i || '/requirements.txt'
                WHEN kind = 'sql' THEN 'sql/d' || i || '/s' || (doc_id % 3) || '.sql'
                WHEN d.k = 2 AND doc_id % 2 = 0 THEN 'pages/p' || i || '.py'
                ELSE 'd' || i || '/m' || (doc_id % 3) || '.py' END AS path, false AS none,
           CASE WHEN doc_id % 7 = 3 THEN replace({_BODY}, chr(10), chr(13) || chr(10)) ELSE {_BODY} END
           || CASE WHEN doc_id % 17 = 5 THEN '<ff>' ELSE '' END AS bytes
    FROM d JOIN snippets s ON d.k = s.k
    UNION ALL SELECT app_id, 'd' || i || '/__init__.py', false, '' FROM d WHERE d.k = 0
    UNION ALL SELECT app_id, 'd' || i || '/notes.md', false, text FROM d WHERE d.k = 5
), {_later("raw", "none", "bytes")}, compared AS (
    SELECT app_id, path, coalesce(b.bytes, a.bytes) AS bytes,
           CASE WHEN a.bytes IS NULL THEN 'added' WHEN b.bytes IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM raw a FULL JOIN later_raw b USING (app_id, path) WHERE a.bytes IS DISTINCT FROM b.bytes
), once AS (
    SELECT bytes FROM compared WHERE change <> 'changed' GROUP BY bytes
    HAVING count(*) FILTER (WHERE change = 'removed') = 1 AND count(*) FILTER (WHERE change = 'added') = 1
)"""
UPKEEP = FILES + ", " + _later("files", "kind, readable", "content") + FACTS[len(FILES):].replace("FROM files", "FROM later_files")
_EARLIER = re.sub(r"\b(flagged|facts)\b", r"earlier_\1", FACTS[len(FILES) + 2:])
_COUNTED = (
    "1", *[f"({test})::INTEGER" for test in (
        "kind = 'python'", "kind = 'sql'", "is_component", "NOT readable", "is_ui", "is_api", "is_procedure", "is_udf",
        "kind = 'requirements' AND readable", "kind = 'requirements'")], *[f"u{n}" for n in range(7)],
)
_FACT_COLUMNS = """app_id, python_files, sql_files, components, ui_pages, unreadable_files, unreadable_requirements, has_streamlit, has_api,
           has_stored_procedures, has_udfs, api_usage_total, features, score, migration_complexity, app_type"""

REVENUE = "CAST(sum(revenue) AS DECIMAL(28,2)) AS revenue"
ORDERS = "CAST(sum(order_count) AS BIGINT) AS"

GRANTS = DOCS + """, grants AS (
    SELECT app_id, 'grants/' || doc_id || '.sql' AS path, 1 AS statement_no, 'ROLE' AS grantee_kind, 'R' || i AS grantee,
           CAST(NULL AS VARCHAR) AS role, unnest(['SELECT', 'INSERT']) AS privilege, 'TABLE' AS object_type, 'APP_SCHEMA.T' || i AS object FROM d
    UNION ALL SELECT app_id, 'grants/' || doc_id || '.sql', 2, 'ROLE', 'R0', NULL, 'USAGE', 'ALL TABLES IN SCHEMA', '"App s"' FROM d
    UNION ALL SELECT app_id, 'grants/' || doc_id || '.sql', 3, 'ROLE', 'R' || (i // 2), 'R' || i, NULL, NULL, NULL FROM d WHERE i > 0
    UNION ALL SELECT app_id, 'grants/' || doc_id || '.sql', 3, 'ROLE', 'R5', 'R0', NULL, NULL, NULL FROM d WHERE i = 0 AND g % 3 = 0
    UNION ALL SELECT app_id, 'grants/' || doc_id || '.sql', 4, 'USER', 'U' || (i % 3), 'R' || i, NULL, NULL, NULL FROM d WHERE i % 4 = 1
), walked AS (
    SELECT DISTINCT app_id, grantee_kind, grantee, role, 1 AS hops FROM grants WHERE role IS NOT NULL
    UNION
    SELECT w.app_id, w.grantee_kind, w.grantee, e.role, w.hops + 1
    FROM walked w JOIN grants e ON e.app_id = w.app_id AND e.grantee_kind = 'ROLE' AND e.grantee = w.role AND e.role IS NOT NULL
    WHERE w.hops < 22
), chains AS (
    SELECT app_id, grantee_kind, grantee, role, CAST(min(hops) AS BIGINT) AS hops FROM walked GROUP BY ALL
), targets AS (
    SELECT * FROM (VALUES ('USAGE', 'USE SCHEMA'), ('SELECT', 'SELECT')) AS v(privilege, target)
), levels AS (
    SELECT app_id, name, CAST(1 + (SELECT count(*) FROM chains c WHERE c.app_id = n.app_id AND c.grantee_kind = 'ROLE'
           AND c.grantee = n.name AND c.role <> n.name) AS INTEGER) AS level
    FROM (SELECT app_id, grantee AS name FROM grants WHERE grantee_kind = 'ROLE' UNION SELECT app_id, role FROM grants WHERE role IS NOT NULL) n
)"""
DRIFTING = """kinds AS (
    SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN 'missing' WHEN o_orderkey % 17 = 0 THEN 'broken' WHEN o_orderkey % 11 = 0 THEN 'empty'
                   WHEN o_orderkey % 7 = 0 THEN 'text' WHEN o_orderkey % 5 = 0 THEN 'other' ELSE 'whole' END AS kind FROM orders
)"""

ORACLES: dict[str, str] = {
    # sources and sinks
    "estate_scan": f"""WITH {FILES}{MANIFEST_TEXTS_TAIL}
    SELECT app_id, path, kind, readable, md5(content) AS text_md5 FROM files
    UNION ALL SELECT app_id, path, 'manifest', true, md5(body) FROM manifest_texts""",
    "stage_listing": f"""WITH {FILES}{MANIFEST_TEXTS_TAIL}, bodies AS (
        SELECT app_id, replace(snippet, '|', chr(10)) || CASE WHEN kind = 'requirements'
                   THEN lang || '-tools>=1.0' || chr(10) || '# ' || replace(text, chr(10), chr(10) || '# ') || chr(10)
                   ELSE text END AS body, doc_id
        FROM d JOIN snippets s ON d.k = s.k
    ), sized AS (
        SELECT app_id, octet_length(encode(body))
               + CASE WHEN doc_id % 7 = 3 THEN len(string_split(body, chr(10))) - 1 ELSE 0 END
               + CASE WHEN doc_id % 17 = 5 THEN 1 ELSE 0 END AS size FROM bodies
        UNION ALL SELECT app_id, 0 FROM d WHERE k = 0
        UNION ALL SELECT app_id, octet_length(encode(text)) FROM d WHERE k = 5
        UNION ALL SELECT app_id, octet_length(encode(body)) FROM manifest_texts
    )
    SELECT app_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_bytes FROM sized GROUP BY app_id""",
    "tree_source": f"""WITH {FILES}
    SELECT app_id, path, kind, readable, md5(content) AS text_md5 FROM files
    WHERE kind IN ('python', 'sql') AND NOT starts_with(path, 'pages/')""",
    "tree_source_listing": f"""WITH {CHANGES}{MANIFEST_TEXTS_TAIL}, sized AS (
        SELECT app_id, CASE WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.sql') THEN 'sql'
                   WHEN ends_with(path, '/requirements.txt') THEN 'requirements' ELSE 'other' END AS kind,
               octet_length(encode(bytes)) - CASE WHEN ends_with(bytes, '<ff>') THEN 3 ELSE 0 END AS size
        FROM raw
        UNION ALL SELECT app_id, 'manifest', octet_length(encode(body)) FROM manifest_texts
    )
    SELECT app_id, kind, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_bytes FROM sized GROUP BY app_id, kind""",
    "estate_changes": f"""WITH {CHANGES}
    SELECT app_id, path, change, NULL::VARCHAR AS from_app_id, NULL::VARCHAR AS from_path FROM compared
    WHERE change = 'changed' OR bytes NOT IN (SELECT bytes FROM once)
    UNION ALL
    SELECT b.app_id, b.path, 'moved', a.app_id, a.path FROM compared a JOIN compared b USING (bytes)
    WHERE a.change = 'removed' AND b.change = 'added' AND bytes IN (SELECT bytes FROM once)""",
    "changed_folders": f"""WITH {CHANGES}, parts AS (
        SELECT app_id, path, string_split(path, '/') AS p FROM compared
    ), above AS (
        SELECT app_id, array_to_string(p[1:n], '/') AS folder, n = len(p) - 1 AS own
        FROM (SELECT *, unnest(range(0, len(p))) AS n FROM parts)
    )
    SELECT app_id, folder, bool_or(own) AS own_changed FROM above GROUP BY app_id, folder""",
    "upkeep_facts": f"WITH {UPKEEP}{APPS_TAIL} SELECT {_FACT_COLUMNS} FROM app_facts",
    "upkeep_changed": f"""WITH {UPKEEP}{APPS_TAIL}, {_EARLIER}, signed AS (
        SELECT 1 AS s, * FROM facts UNION ALL BY NAME SELECT -1 AS s, * FROM earlier_facts
    ), touched AS (
        SELECT app_id FROM signed GROUP BY app_id HAVING {" OR ".join(f"sum(s * ({c})) <> 0" for c in _COUNTED)}
    )
    SELECT {_FACT_COLUMNS} FROM app_facts WHERE app_id IN (SELECT app_id FROM touched)""",
    "read_errors": f"WITH {FILES} SELECT app_id, path, kind FROM files WHERE NOT readable",
    "manifest_catalog": f"WITH {MANIFESTS} SELECT * FROM catalog",
    "requirements_parse": f"WITH {REQUIREMENTS} SELECT app_id, path, line_no, package FROM parsed",
    "line_filter": f"WITH {REQUIREMENTS} SELECT app_id, path, line_no, line FROM lines",
    "sales_data": f"WITH {SALES} SELECT * FROM sales",
    "analysis_report": f"""WITH {APPS}{ADVICE_TAIL}, usage AS (
        SELECT app_id, string_agg(feature || '=' || uses, '; ' ORDER BY feature || '=' || uses) AS api_usage
        FROM ({_LONG_USAGE}) GROUP BY app_id
    ), warn_counts AS (
        SELECT app_id, 'manifest_' || status AS code, 1 AS n FROM catalog WHERE status <> 'ok'
        UNION ALL SELECT app_id, 'file_unreadable', unreadable_files FROM app_facts WHERE unreadable_files > 0
        UNION ALL SELECT app_id, 'requirements_unreadable', unreadable_requirements FROM app_facts WHERE unreadable_requirements > 0
        UNION ALL SELECT app_id, 'heavy_usage', 1 FROM app_facts WHERE api_usage_total > 20
    ), warns AS (
        SELECT app_id, string_agg(code || '=' || n, '; ' ORDER BY code || '=' || n) AS warnings FROM warn_counts GROUP BY app_id
    ), recs AS (
        SELECT app_id, string_agg(text, '; ' ORDER BY seq) AS recommendations FROM advice GROUP BY app_id
    )
    SELECT f.app_id AS app_name, migration_complexity, components, python_files, sql_files, has_streamlit, has_api,
           has_stored_procedures, has_udfs, coalesce(api_usage, '') AS api_usage, coalesce(warnings, '') AS warnings,
           coalesce(recommendations, '') AS recommendations
    FROM app_facts f LEFT JOIN usage u ON f.app_id = u.app_id LEFT JOIN warns w ON f.app_id = w.app_id
    LEFT JOIN recs r ON f.app_id = r.app_id""",
    "converted_files": f"""WITH {REWRITTEN}
    SELECT r.app_id, r.target_path, r.path, r.type, md5(new_content) AS text_md5
    FROM rewritten r JOIN winners w ON r.app_id = w.app_id AND r.path = w.path""",
    "file_preview": f"""WITH {REWRITTEN}
    SELECT r.app_id, r.target_path, array_to_string(string_split(new_content, chr(10))[1:10], chr(10)) AS preview
    FROM rewritten r JOIN winners w ON r.app_id = w.app_id AND r.path = w.path""",
    "copy_into": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "load_ledger": """SELECT event_type, CAST(count(*) FILTER (event_id % 23 <> 4) AS BIGINT) AS loaded,
           CAST(count(*) FILTER (event_id % 23 = 4) AS BIGINT) AS corrupt, true AS each_file_once FROM events GROUP BY event_type""",
    "loaded_rows": "SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 23 <> 4",
    "create_frame": f"""WITH {SALES} SELECT year, region, CASE region WHEN 'ASIA' THEN 'east desk' WHEN 'EUROPE' THEN 'west desk' END AS desk,
           {REVENUE} FROM sales GROUP BY year, region""",
    # per-file facts
    "classify_python": f"""WITH {FACTS} SELECT app_id, path, type, is_ui, is_api, py_udf, py_procedure
    FROM facts WHERE is_component AND kind = 'python'""",
    "classify_python_strict": f"""WITH {FACTS}, strict AS (
        SELECT *, contains(content, 'import streamlit') OR contains(content, 'from streamlit')
               OR contains(content, 'streamlit_app') OR regexp_matches(content, '(^|[^\\p{{L}}\\p{{N}}_])st\\.') AS strict_ui
        FROM facts WHERE is_component AND kind = 'python'
    )
    SELECT app_id, path, CASE WHEN type IN ('streamlit', 'python') THEN CASE WHEN strict_ui THEN 'streamlit' ELSE 'python' END
                              ELSE type END AS type, strict_ui AS is_ui
    FROM strict""",
    "classify_sql": f"""WITH {FACTS} SELECT app_id, path, type, complexity, sql_procedure, sql_udf, is_view
    FROM facts WHERE is_component AND kind = 'sql'""",
    "sql_feature_flags": f"""WITH {FACTS}
    SELECT app_id, path, 'VARIANT type' AS construct FROM facts WHERE c1
    UNION ALL SELECT app_id, path, 'FLATTEN function' FROM facts WHERE c2
    UNION ALL SELECT app_id, path, 'LATERAL FLATTEN' FROM facts WHERE c3
    UNION ALL SELECT app_id, path, 'COPY INTO' FROM facts WHERE c4""",
    "component_complexity": f"WITH {FACTS} SELECT app_id, path, type, complexity FROM facts WHERE is_component",
    "component_notes": f"""WITH {FACTS}
    SELECT app_id, path, name, type, complexity, u0 + u1 + u2 + u3 + u4 + u5 + u6 > 0 AS has_api_usage,
           concat_ws('; ', CASE WHEN is_ui THEN 'ui' END, CASE WHEN is_api THEN 'api' END,
               {", ".join(f"CASE WHEN u{n} > 0 THEN 'uses {label}' END" for n, (label, _) in enumerate(_FEATURES))},
               CASE WHEN py_udf OR py_procedure THEN 'python udf or procedure' END,
               CASE WHEN sql_procedure THEN 'sql procedure' END, CASE WHEN sql_udf THEN 'sql udf' END,
               CASE WHEN is_view THEN 'sql view' END,
               CASE WHEN c1 OR c2 OR c3 OR c4 THEN 'constructs ' || concat_ws(', ',
                   CASE WHEN c1 THEN 'VARIANT type' END, CASE WHEN c2 THEN 'FLATTEN function' END,
                   CASE WHEN c3 THEN 'LATERAL FLATTEN' END, CASE WHEN c4 THEN 'COPY INTO' END) END) AS notes
    FROM facts WHERE is_component""",
    "udf_inventory": f"""WITH {FACTS} SELECT app_id, path, kind AS language, is_udf, is_procedure,
           CAST(u5 AS BIGINT) AS udf_decorators, CAST(u6 AS BIGINT) AS procedure_decorators
    FROM facts WHERE is_udf OR is_procedure""",
    # application facts
    "app_summary": f"""WITH {APPS}{REQUIREMENTS_TAIL}
    SELECT f.app_id, python_files, sql_files, ui_pages, components, has_streamlit, has_api, has_stored_procedures, has_udfs,
           coalesce(n, 0) AS dependencies
    FROM app_facts f LEFT JOIN (SELECT app_id, count(*) AS n FROM dependencies GROUP BY app_id) c ON f.app_id = c.app_id""",
    "app_type": f"WITH {APPS} SELECT app_id, app_type FROM app_facts",
    "app_names": f"""WITH {DOCS} SELECT app_id, replace(lower(app_id), ' ', '_') AS slug, lower(app_id) || '_catalog' AS catalog
    FROM apps""",
    "api_usage": f"WITH {APPS} {_LONG_USAGE}",
    "usage_total": f"WITH {APPS} SELECT app_id, api_usage_total, api_usage_total > 20 AS heavy FROM app_facts WHERE api_usage_total > 0",
    "complexity_score": f"WITH {APPS} SELECT app_id, features, sql_files, score, migration_complexity FROM app_facts",
    "estate_rollup": f"""WITH {APPS} SELECT migration_complexity, app_type, count(*) AS apps,
           CAST(sum(components) AS BIGINT) AS components, round(avg(score), 6) AS avg_score
    FROM app_facts GROUP BY migration_complexity, app_type""",
    "warnings": f"WITH {APPS}{MANIFESTS_TAIL}{WARNINGS_TAIL} SELECT * FROM warned",
    "recommendations": f"WITH {APPS}{ADVICE_TAIL} SELECT app_id, seq, code, text FROM advice",
    "version_ranges": f"WITH {REQUIREMENTS}{VERSIONS_TAIL}",
    "dependency_set": f"WITH {REQUIREMENTS} SELECT app_id, package FROM dependencies",
    "dependency_drop": f"""WITH {REQUIREMENTS} SELECT app_id, package FROM dependencies
    WHERE NOT contains(package, 'snowflake-connector') AND NOT contains(package, 'snowflake-snowpark')
      AND package NOT IN ('streamlit', 'flask', 'pyspark')""",
    "target_requirements": f"""WITH {APPS}{REQUIREMENTS_TAIL}
    SELECT app_id, 'databricks-sql-connector>=3.0.0' AS requirement FROM app_facts
    UNION SELECT app_id, 'streamlit>=1.30.0' FROM app_facts WHERE has_streamlit
    UNION SELECT app_id, 'flask>=3.0.0' FROM app_facts WHERE has_api
    UNION SELECT app_id, 'pyspark>=3.5.0' FROM app_facts WHERE api_usage_total > 0
    UNION SELECT app_id, package FROM dependencies
    WHERE NOT contains(package, 'snowflake-connector') AND NOT contains(package, 'snowflake-snowpark')
      AND package NOT IN ('streamlit', 'flask', 'pyspark')""",
    "ordered_requirements": f"""WITH {APPS}{REQUIREMENTS_TAIL}, needed AS (
    SELECT app_id, 'databricks-sql-connector>=3.0.0' AS requirement FROM app_facts
    UNION SELECT app_id, 'streamlit>=1.30.0' FROM app_facts WHERE has_streamlit
    UNION SELECT app_id, 'flask>=3.0.0' FROM app_facts WHERE has_api
    UNION SELECT app_id, 'pyspark>=3.5.0' FROM app_facts WHERE api_usage_total > 0
    UNION SELECT app_id, package FROM dependencies
    WHERE NOT contains(package, 'snowflake-connector') AND NOT contains(package, 'snowflake-snowpark')
      AND package NOT IN ('streamlit', 'flask', 'pyspark')
    ) SELECT app_id, row_number() OVER (PARTITION BY app_id ORDER BY requirement) AS line_no, requirement FROM needed""",
    # manifests and provisioning
    "manifest_privileges": f"WITH {MANIFESTS} SELECT app_id, entry_no, CAST(key_no AS INTEGER) AS key_no, entry_key, verb, object_type, object_no, object FROM keyed",
    "manifest_permissions": f"""WITH {MANIFESTS} SELECT app_id, entry_no, 'CAN_VIEW' AS permission, object AS source
    FROM privileges WHERE entry_key = 'privilege'""",
    "manifest_artifacts": f"""WITH {MANIFESTS}
    SELECT app_id, 1 AS artifact_no, 'streamlit_app.py' AS src, '/' AS dest FROM manifests WHERE status = 'ok'
    UNION ALL SELECT app_id, 2, 'sql/setup_' || g || '.sql', '/' FROM manifests WHERE status = 'ok'""",
    "privilege_map": f"WITH {MANIFESTS} SELECT app_id, entry_no, CAST(key_no AS INTEGER) AS key_no, entry_key, object_no, verb, object_type, object, target FROM mapped",
    "manifest_configuration": f"""WITH {MANIFESTS}
    SELECT app_id, key, value FROM manifests, (VALUES ('log_level', 'INFO'), ('enable_telemetry', 'true')) AS t(key, value) WHERE status = 'ok'
    UNION ALL SELECT app_id, key, value FROM manifests, (VALUES ('limit', 'nan'), ('2024-01-05', 'inf')) AS t(key, value)
    WHERE status = 'ok' AND g % 4 = 1""",
    "provisioning_plan": f"""WITH {MANIFESTS}
    SELECT app_id, 1 AS step, 1 AS part, 'create_catalog' AS action, lower(app_id) || '_catalog' AS detail FROM apps
    UNION ALL SELECT app_id, 2, 1, 'create_schema', lower(app_id) || '_catalog.main' FROM apps
    UNION ALL SELECT app_id, entry_no + 2, object_no, CASE target WHEN 'needs_review' THEN target ELSE 'grant' END,
           target || ' on ' || coalesce(object_type, '?') || ' ' || coalesce(object, '?') FROM mapped WHERE entry_key <> 'remark'""",
    "grant_statements": f"WITH RECURSIVE {GRANTS} SELECT * FROM grants",
    "role_chains": f"WITH RECURSIVE {GRANTS} SELECT * FROM chains",
    "effective_grants": f"""WITH RECURSIVE {GRANTS}, given AS (
        SELECT app_id, grantee_kind, grantee, privilege, object_type, object, 0 AS hops FROM grants WHERE privilege IS NOT NULL
        UNION ALL SELECT c.app_id, c.grantee_kind, c.grantee, g.privilege, g.object_type, g.object, c.hops
        FROM chains c JOIN grants g ON g.app_id = c.app_id AND g.grantee_kind = 'ROLE' AND g.grantee = c.role AND g.privilege IS NOT NULL
    ) SELECT app_id, grantee_kind, grantee, privilege, object_type, object, CAST(min(hops) AS BIGINT) AS hops,
             coalesce(target, 'needs_review') AS target
    FROM given LEFT JOIN targets USING (privilege) GROUP BY ALL""",
    "role_plan": f"""WITH RECURSIVE {GRANTS}
    SELECT app_id, 1 AS phase, level, 'create_role' AS action, name AS detail FROM levels
    UNION ALL SELECT DISTINCT g.app_id, 2, level, CASE WHEN target IS NULL THEN 'needs_review' ELSE 'grant' END,
           coalesce(target, privilege) || ' on ' || object_type || ' ' || object || ' to ROLE ' || grantee
    FROM grants g LEFT JOIN targets USING (privilege) JOIN levels l ON l.app_id = g.app_id AND l.name = grantee WHERE privilege IS NOT NULL
    UNION ALL SELECT DISTINCT g.app_id, 3, l.level, CASE WHEN EXISTS (SELECT 1 FROM chains c WHERE c.app_id = g.app_id AND g.grantee_kind = 'ROLE'
               AND c.grantee_kind = 'ROLE' AND c.grantee = g.role AND c.role = g.grantee) THEN 'needs_review' ELSE 'grant_role' END,
           g.role || ' to ' || g.grantee_kind || ' ' || g.grantee
    FROM grants g JOIN levels l ON l.app_id = g.app_id AND l.name = g.role WHERE g.role IS NOT NULL""",
    # rewriting
    "rewrite_ui": f"WITH {REWRITTEN} SELECT app_id, path, new_content AS content FROM rewritten WHERE type = 'streamlit'",
    "rewrite_py": f"WITH {REWRITTEN} SELECT app_id, path, new_content AS content FROM rewritten WHERE type IN ('python', 'api')",
    "stamp_sql": f"WITH {REWRITTEN} SELECT app_id, path, new_content AS content FROM rewritten WHERE type = 'sql'",
    "skip_empty": f"""WITH {FACTS} SELECT app_id, path, type, CASE WHEN is_empty THEN 'skipped_empty' ELSE 'converted' END AS status
    FROM facts WHERE is_component AND type IN ('streamlit', 'python', 'api', 'sql')""",
    "target_paths": f"WITH {FACTS}{TARGETS_TAIL} SELECT * FROM targets",
    "target_collisions": f"WITH {FACTS}{TARGETS_TAIL} SELECT * FROM winners",
    **{
        key: f"""WITH {FACTS}{TARGETS_TAIL} SELECT {by}, count(*) AS components,
           count(*) FILTER (WHERE status = 'written') AS written,
           count(*) FILTER (WHERE status = 'skipped_type') AS skipped_type,
           count(*) FILTER (WHERE status = 'skipped_empty') AS skipped_empty,
           count(*) FILTER (WHERE status = 'lost_to_collision') AS lost_to_collision
    FROM targets GROUP BY {by}"""
        for key, by in (("conversion_coverage", "app_id"), ("coverage_by_complexity", "complexity"))
    },
    "rewrite_hits": f"""WITH {FACTS} SELECT app_id, rule, CAST(sum(n) AS BIGINT) AS hits FROM ({_HITS_SQL})
    GROUP BY app_id, rule HAVING sum(n) > 0""",
    "rewrite_places": f"""WITH {FACTS} SELECT app_id, path, CAST(line AS INTEGER) AS line, count(DISTINCT rule) AS n_rules, CAST(sum(n) AS BIGINT) AS hits,
           CASE WHEN count(DISTINCT rule) = 1 THEN max(rule) END AS rule,
           CAST(CASE WHEN count(DISTINCT rule) = 1 THEN min(first_at) END AS INTEGER) AS first_column,
           CAST(CASE WHEN count(DISTINCT rule) = 1 THEN max(last_at) END AS INTEGER) AS last_column
    FROM ({_PLACES_SQL}) GROUP BY app_id, path, line""",
    # sales
    **{
        name: f"""WITH {SALES} SELECT {"".join(f"{c}, " for c in by)}CAST(sum(revenue) AS DECIMAL(28,2)) AS total_revenue,
           {ORDERS} total_orders, count(DISTINCT customer_id) AS unique_customers FROM sales {"GROUP BY ALL" if by else ""}"""
        for name, by in (
            ("cube_monthly", ("year", "month", "region")), ("cube_by_year", ("year",)), ("cube_by_region", ("region",)), ("cube_total", ())
        )
    },
    "monthly_sales": f"""WITH {SALES} SELECT year, month, region, CAST(sum(revenue) AS DECIMAL(28,2)) AS total_revenue,
           {ORDERS} total_orders, count(DISTINCT customer_id) AS unique_customers
    FROM sales GROUP BY year, month, region""",
    "stored_sales": f"WITH {SALES} SELECT * EXCLUDE (product_name) FROM sales",
    "stored_monthly_sales": f"""WITH {SALES} SELECT year, month, region, CAST(sum(revenue) AS DECIMAL(28,2)) AS total_revenue,
           {ORDERS} total_orders, count(DISTINCT customer_id) AS unique_customers
    FROM sales WHERE year BETWEEN 1997 AND 2000 GROUP BY year, month, region""",
    "sales_filter": f"""WITH {SALES} SELECT year, region, order_id, customer_id, product_name, month, revenue
    FROM sales WHERE {DASHBOARD}""",
    "sales_kpis": f"""WITH {SALES} SELECT CAST(coalesce(sum(revenue), 0) AS DECIMAL(28,2)) AS total_sales,
           CAST(coalesce(sum(order_count), 0) AS BIGINT) AS orders,
           round(CAST(sum(revenue) AS DOUBLE) / nullif(CAST(sum(order_count) AS DOUBLE), 0), 6) AS avg_order_value,
           count(DISTINCT customer_id) AS customers
    FROM sales WHERE {DASHBOARD}""",
    "sales_trend": f"WITH {SALES} SELECT month, {REVENUE} FROM sales WHERE {DASHBOARD} GROUP BY month ORDER BY month",
    "product_sales": f"""WITH {SALES} SELECT product_name, {REVENUE}, {ORDERS} order_count
    FROM sales GROUP BY product_name ORDER BY 2 DESC, 1""",
    "top_products": f"""WITH {SALES} SELECT product_name, {REVENUE}, {ORDERS} order_count
    FROM sales WHERE {DASHBOARD} GROUP BY product_name ORDER BY 2 DESC, 1 LIMIT 10""",
    "year_range_filter": f"""WITH {SALES} SELECT year, year >= 1998 AS in_current, year = 2000 AS is_base, count(*) AS lines, {REVENUE}
    FROM sales WHERE year >= 1997 GROUP BY year""",
    "yoy_growth": f"""WITH {GROWTH} SELECT year, round(revenue, 2) AS revenue, round(prior_revenue, 2) AS prior_revenue,
           round(growth, 6) AS growth FROM growth WHERE year >= 1998""",
    "avg_growth": f"WITH {GROWTH} SELECT round(avg(growth), 6) AS avg_growth FROM growth WHERE year >= 1998",
    "region_semi_join": f"""WITH {SALES} SELECT region, year, count(*) AS lines, {REVENUE} FROM sales
    WHERE region IN (SELECT unnest(string_split(r_name || ',' || r_name || ', AFRICA', ',')) FROM region
                     WHERE contains(r_name, 'ASIA') OR contains(r_name, 'EUROPE'))
    GROUP BY region, year""",
    "last_year_sales": f"WITH {SALES} SELECT {LAST_YEAR} AS last_year_sales",
    "sales_forecast": f"""WITH {GROWTH}, parts AS (
        SELECT avg(growth) AS avg_growth, CAST({LAST_YEAR} AS DOUBLE) AS last_year_sales FROM growth WHERE year >= 1998
    )
    SELECT round(avg_growth, 6) AS avg_growth, round(last_year_sales, 2) AS last_year_sales,
           round(last_year_sales * (1 + avg_growth), 2) AS forecast FROM parts""",
    "sales_forecast_batch": f"""WITH {GROWTH}, requests AS (
        SELECT c_custkey AS request_id, CAST(1996 + c_custkey % 7 AS INTEGER) AS forecast_year,
               r_name || CASE c_custkey % 3 WHEN 0 THEN ',ASIA' WHEN 1 THEN ', EUROPE' ELSE '' END AS regions
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    ), by_region AS (
        SELECT year, region, sum(revenue) AS revenue FROM sales GROUP BY year, region
    ), averages AS (
        SELECT r.forecast_year, avg(growth) AS avg_growth
        FROM (SELECT DISTINCT forecast_year FROM requests) r LEFT JOIN growth g ON g.year >= r.forecast_year - 3
        GROUP BY r.forecast_year
    ), bases AS (
        SELECT request_id, CAST(sum(b.revenue) AS DOUBLE) AS last_year_sales
        FROM requests r JOIN by_region b ON b.year = r.forecast_year - 1
             AND list_contains(string_split(r.regions, ','), b.region)
        GROUP BY request_id
    )
    SELECT r.request_id, r.forecast_year, r.regions, round(avg_growth, 6) AS avg_growth,
           round(last_year_sales, 2) AS last_year_sales, round(last_year_sales * (1 + avg_growth), 2) AS forecast
    FROM requests r LEFT JOIN averages a ON r.forecast_year = a.forecast_year LEFT JOIN bases b ON r.request_id = b.request_id""",
    "categorize_revenue": f"""WITH {SALES} SELECT CASE WHEN revenue > 100000 THEN 'High' WHEN revenue > 50000 THEN 'Medium' ELSE 'Low' END AS category,
           count(*) AS lines, {REVENUE}, min(revenue) AS lowest, max(revenue) AS highest FROM sales GROUP BY 1""",
    "categorize_revenue_sql": f"""WITH {SALES} SELECT CASE WHEN revenue > 100000 THEN 'High' WHEN revenue > 50000 THEN 'Medium' ELSE 'Low' END AS category,
           count(*) AS lines, {REVENUE} FROM sales GROUP BY 1""",
    "sales_forecast_sql": f"""WITH {GROWTH} SELECT round(CAST({LAST_YEAR} AS DOUBLE) * (1 + avg(growth)), 2) AS forecast FROM growth WHERE year >= 1998""",
    "split_to_table_sql": f"""WITH {SALES} SELECT 'sales' AS what, CAST(NULL AS BIGINT) AS id, CAST({LAST_YEAR} AS DECIMAL(28,2)) AS amount
    UNION ALL SELECT 'parts', doc_id, CAST(len(string_split(text, '. ')) AS DECIMAL(28,2)) FROM documents WHERE text IS NOT NULL""",
    "monthly_sales_sql": f"""WITH {SALES}, monthly AS (
        SELECT year, month, region, sum(order_count) AS n, count(DISTINCT customer_id) AS c FROM sales GROUP BY ALL
    ) SELECT year, region, CAST(sum(n) AS BIGINT) AS orders, max(c) AS most_customers FROM monthly GROUP BY year, region""",
    "split_to_table": """SELECT doc_id, CAST(generate_subscripts(string_split(text, ','), 1) AS INTEGER) AS "index",
           unnest(string_split(text, ',')) AS value FROM documents""",
    # semi-structured
    "variant_extract": "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "flatten": """SELECT event_id, CAST(0 AS INTEGER) AS position, j.key, j.value->>'$' AS value
    FROM events, json_each(props) j""",
    "flatten_object": f"""WITH {ORDER_OBJECTS} SELECT o_orderkey, j.key, j.value->>'$' AS value FROM objects, json_each(object) j""",
    "flatten_outer": f"""WITH {ORDER_OBJECTS} SELECT o_orderkey, j.key, j.value->>'$' AS value
    FROM objects LEFT JOIN json_each(object) j ON true""",
    "flatten_array": """SELECT o_orderkey, CAST(unnest([0, 1, 2]) AS INTEGER) AS position,
           unnest([CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority]) AS value FROM orders""",
    "lateral_flatten": """SELECT event_type, j.key, count(*) AS n, CAST(sum(TRY_CAST(j.value->>'$' AS BIGINT)) AS BIGINT) AS total
    FROM events, json_each(props) j GROUP BY ALL""",
    "variant_schema": f"""WITH {ORDER_OBJECTS} SELECT count(object) AS texts,
           'OBJECT<of: OBJECT<customer: BIGINT, priority: STRING>, status: STRING, year: BIGINT>' AS schema FROM objects""",
    "variant_paths": f"""WITH {DRIFTING}, types AS (
        SELECT * FROM (VALUES ('missing', '$', 'MISSING'), ('broken', '$', 'UNREADABLE'), ('empty', '$', 'OBJECT'),
            ('text', '$', 'OBJECT'), ('text', '$.status', 'STRING'), ('text', '$.year', 'STRING'), ('text', '$.of', 'OBJECT'),
            ('text', '$.of.customer', 'BIGINT'), ('text', '$.of.note', 'OBJECT'), ('text', '$.of.note[''is late'']', 'BOOLEAN'),
            ('other', '$', 'OBJECT'), ('other', '$.status', 'VOID'), ('other', '$.year', 'STRING'), ('other', '$.of', 'STRING'),
            ('other', '$.extra', 'ARRAY<BIGINT>'),
            ('whole', '$', 'OBJECT'), ('whole', '$.status', 'STRING'), ('whole', '$.year', 'BIGINT'), ('whole', '$.of', 'OBJECT'),
            ('whole', '$.of.customer', 'BIGINT'), ('whole', '$.of.priority', 'STRING')) AS v(kind, path, type)
    ) SELECT path, type, count(*) AS rows FROM kinds JOIN types USING (kind) GROUP BY ALL""",
    "variant_typed": f"""WITH {DRIFTING} SELECT o_orderkey, CASE WHEN kind IN ('text', 'whole') THEN o_orderstatus END AS status,
           CASE WHEN kind IN ('text', 'whole') THEN CAST(year(o_orderdate) AS INTEGER) END AS year,
           CASE WHEN kind IN ('text', 'whole') THEN o_custkey END AS customer,
           CASE kind WHEN 'broken' THEN '$' WHEN 'other' THEN 'year' ELSE '' END AS misfits FROM kinds""",
    "variant_drift": f"""WITH {DRIFTING}
    SELECT '$.status' AS path, count(*) FILTER (kind IN ('text', 'whole')) AS present, CAST(0 AS BIGINT) AS misfits, true AS declared FROM kinds
    UNION ALL SELECT '$.year', count(*) FILTER (kind IN ('text', 'whole', 'other')), count(*) FILTER (kind = 'other'), true FROM kinds
    UNION ALL SELECT '$.of.customer', count(*) FILTER (kind IN ('text', 'whole')), 0, true FROM kinds
    UNION ALL SELECT path, n, NULL, false FROM (
        SELECT '$.of' AS path, count(*) FILTER (kind = 'other') AS n FROM kinds
        UNION ALL SELECT '$.extra', count(*) FILTER (kind = 'other') FROM kinds
        UNION ALL SELECT '$.of.note[''is late'']', count(*) FILTER (kind = 'text') FROM kinds
        UNION ALL SELECT '$.of.priority', count(*) FILTER (kind = 'whole') FROM kinds
    ) WHERE n > 0""",
    "array_flatten_agg": """SELECT position, count(*) AS n, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high FROM (
        SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS position, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings
    ) GROUP BY position""",
}
