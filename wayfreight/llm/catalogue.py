"""The queries of this subpackage and, where SQL can express them, the SQL they agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfreight.llm import (
    bpe,
    centroids,
    decontaminate,
    exact_dedup,
    importance,
    jaccard,
    langid,
    lm,
    pii,
    quality,
    tokenfiles,
    toxicity,
    warc,
)
from wayfreight.llm.common import source

Query = Callable[[SparkSession, str], DataFrame]
LLM_QUERIES: dict[str, Query] = {}
LLM_ORACLES: dict[str, str] = {}


def query(run: Query) -> Query:
    LLM_QUERIES[run.__name__] = run
    return run


@query
def op1_lm_scores(spark, sf_dir):
    return lm.score_texts(source(spark, sf_dir, "documents"))


@query
def op2_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(source(spark, sf_dir, "documents"), size=3, percent=90)


@query
def op3_byte_bpe(spark, sf_dir):
    return bpe.bpe_round_trip(source(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(source(spark, sf_dir, "documents"), source(spark, sf_dir, "labels"))


@query
def op5_quality(spark, sf_dir):
    return quality.score_quality(source(spark, sf_dir, "documents"), source(spark, sf_dir, "labels"))


@query
def op6_pii(spark, sf_dir):
    return pii.find_pii(source(spark, sf_dir, "documents"))


@query
def op7_warc(spark, sf_dir):
    return warc.write_and_read(spark, source(spark, sf_dir, "pages"))


# Base32 of a digest: each of its 32 letters is five bits out of two neighbouring hex digits.
LLM_ORACLES["op7_warc"] = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
    SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex,
           min(page_id) OVER (PARTITION BY payload) AS first FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, 1 + (5 * i) // 4, 2))::INTEGER >> (3 - (5 * i) % 4)) & 31)::INTEGER, 1)), '')
           AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""


@query
def op8_decontaminate(spark, sf_dir):
    documents, benchmark = source(spark, sf_dir, "documents"), source(spark, sf_dir, "benchmark")
    return decontaminate.find_contamination(documents, benchmark, every_length=True)


@query
def op9_langid(spark, sf_dir):
    return langid.identify_language(source(spark, sf_dir, "documents"))


@query
def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(source(spark, sf_dir, "documents"))


LLM_ORACLES["op10_exact_dedup"] = """
WITH d AS (
    SELECT doc_id,
           sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents
), g AS (
    SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


@query
def op11_importance(spark, sf_dir):
    return importance.importance_resample(source(spark, sf_dir, "documents"), source(spark, sf_dir, "benchmark"))


# The CRC of each distinct word, byte by byte with a table of 256; the table from eight steps a byte.
LLM_ORACLES["op11_importance"] = r"""
WITH crc_table AS (
    SELECT list(v ORDER BY b) AS t FROM (
        SELECT b, list_reduce(list_prepend(b, range(8)),
                              lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM range(256) AS r(b))
), found AS (
    SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
    UNION ALL
    SELECT 'b', NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), word AS (
    SELECT side, doc_id, unnest(words) AS w FROM found
), hashed AS (
    SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(w))),
               lambda i: ('0x' || substr(hex(encode(w)), 1 + 2 * i, 2))::BIGINT)),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT w FROM word), crc_table
), totals AS (
    SELECT count(*) FILTER (WHERE side = 'd')::DOUBLE AS s_all, count(*) FILTER (WHERE side = 'b')::DOUBLE AS t_all FROM word
), gains AS (
    SELECT bucket, floor(1000 * ln((count(*) FILTER (WHERE side = 'b') + 1)::DOUBLE * (any_value(s_all) + 10000)
           / ((count(*) FILTER (WHERE side = 'd') + 1)::DOUBLE * (any_value(t_all) + 10000)))) AS gain
    FROM word JOIN hashed USING (w), totals GROUP BY bucket
), weighed AS (
    SELECT doc_id, count(w) AS n_features, coalesce(floor(sum(gain) / count(w)), 0)::BIGINT AS weight
    FROM (SELECT doc_id FROM documents) LEFT JOIN (SELECT * FROM word WHERE side = 'd') USING (doc_id)
         LEFT JOIN hashed USING (w) LEFT JOIN gains USING (bucket)
    GROUP BY doc_id
), scored AS (
    SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE
              / 4294967296)))::BIGINT AS score FROM weighed
), ranks AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranks USING (doc_id)
"""


@query
def op12_centroids(spark, sf_dir):
    return centroids.cluster_vectors(source(spark, sf_dir, "embeddings"))


def _centroids_sql(rounds: int = 10) -> str:
    """Long tables of (vector, component) and (centroid, component); one pair of them for each round."""
    parts = [
        """
        kept AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64
        )""",
        """
        x AS MATERIALIZED (SELECT vec_id, unnest(range(1, 65)) AS j, unnest(v) AS x FROM kept)""",
        """
        start AS (
            SELECT v, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM kept
            QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= 8
        )""",
        """
        c0 AS MATERIALIZED (SELECT c, unnest(range(1, 65)) AS j, unnest(v) AS y FROM start)""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""
        a{r} AS MATERIALIZED (
            SELECT vec_id, (arg_min(c, (d, c)))::INTEGER AS cluster, min(d)::BIGINT AS distance FROM (
                SELECT vec_id, c, sum((x - y) * (x - y)) AS d FROM x JOIN c{r} USING (j) GROUP BY vec_id, c)
            GROUP BY vec_id
        )"""
        )
        if r < rounds:
            parts.append(
                f"""
        c{r + 1} AS MATERIALIZED (
            SELECT c, j, coalesce(m, y) AS y FROM c{r} LEFT JOIN (
                SELECT cluster AS c, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM a{r} JOIN x USING (vec_id) GROUP BY cluster, j)
            USING (c, j)
        )"""
            )
    return f"""
        WITH {", ".join(parts)},
        names AS (SELECT c AS cluster, sha256(string_agg(y::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
        SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
               (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a{rounds} JOIN names USING (cluster)
    """


LLM_ORACLES["op12_centroids"] = _centroids_sql()


@query
def op13_token_files(spark, sf_dir):
    return tokenfiles.write_and_read(spark, source(spark, sf_dir, "documents"))
