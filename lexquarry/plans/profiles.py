"""Queries of the profiling operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.operators import profiling as P

FIELDS = ["chunk_id", "doc", "doc_type", "level", "section_no", "section_title", "part", "chapter", "parent_id", "is_parent", "tokens", "text"]
KINDS = ["doc_type", "level", "part", "chapter"]


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/chunks.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/extracted_docs.parquet")


def profile_fields(spark, sf_dir):
    return P.profile_fields(_chunks(spark, sf_dir), FIELDS, "ord").drop("example")


def field_examples(spark, sf_dir):
    return P.profile_fields(_chunks(spark, sf_dir), ["level", "section_no", "part", "chapter"], "ord").select("field", "example")


def categorical_counts(spark, sf_dir):
    return P.categorical_counts(_chunks(spark, sf_dir), KINDS, "ord")


def per_doc_counts(spark, sf_dir):
    return P.counts_per(_chunks(spark, sf_dir), "doc")


def meta_keys(spark, sf_dir):
    return P.meta_keys(_chunks(spark, sf_dir), "meta", "ord")


def token_percentiles(spark, sf_dir):
    return P.nearest_rank(_chunks(spark, sf_dir), F.col("tokens").cast("bigint"))


def record_types(spark, sf_dir):
    """The fields of the events' JSON records, with the types of their values."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.try_parse_json("props").alias("r"))
    return P.profile_records(e, "r", "event_id").select("field", "majority", F.to_json("types").alias("types"), "n_rows", "coverage", "nulls", "n_distinct", "example")


def structure_counts(spark, sf_dir):
    return P.structure_counts(_chunks(spark, sf_dir))


def sequence_mismatch(spark, sf_dir):
    return P.sequence_mismatch(_chunks(spark, sf_dir))


def duplicate_keys(spark, sf_dir):
    return P.duplicate_keys(_chunks(spark, sf_dir), ["doc", "section_no"])


def amendment_coverage(spark, sf_dir):
    return P.amendment_coverage(_chunks(spark, sf_dir))


def header_coverage(spark, sf_dir):
    return P.header_coverage(_chunks(spark, sf_dir))


def broken_parents(spark, sf_dir):
    return P.broken_parents(_chunks(spark, sf_dir))


def doc_summary(spark, sf_dir):
    return P.doc_summary(_docs(spark, sf_dir), _chunks(spark, sf_dir))


def running_footers(spark, sf_dir):
    return P.running_footers(_docs(spark, sf_dir), "ord")


QUERIES = {f.__name__: f for f in (profile_fields, field_examples, categorical_counts, per_doc_counts, meta_keys, token_percentiles, record_types, structure_counts, sequence_mismatch, duplicate_keys, amendment_coverage, header_coverage, broken_parents, doc_summary, running_footers)}

_TYPES = {"is_parent": "boolean", "tokens": "int"}
_ONE = """
    SELECT '{f}' AS field, '{t}' AS type, count(*) AS n_rows, count(*) FILTER ({f} IS NULL) AS nulls, count(*) FILTER (NOT ({e})) AS non_empty,
        round(count(*) FILTER (NOT ({e})) / count(*), 4) AS coverage, count(DISTINCT CASE WHEN NOT ({e}) THEN {f} END) AS n_distinct FROM chunks"""
_EMPTY = lambda f: f"{f} IS NULL" if f in _TYPES else f"{f} IS NULL OR {f} = ''"
SQL = {
    "profile_fields": " UNION ALL ".join(_ONE.format(f=f, t=_TYPES.get(f, "string"), e=_EMPTY(f)) for f in FIELDS),
    "field_examples": " UNION ALL ".join(f"SELECT '{f}' AS field, arg_min({f}, ord) FILTER ({f} <> '') AS example FROM chunks" for f in ("level", "section_no", "part", "chapter")),
    "categorical_counts": " UNION ALL ".join(
        f"""SELECT '{f}' AS field, value, n, (row_number() OVER (ORDER BY n DESC, first_at))::INT AS rank, count(*) OVER () AS n_distinct
        FROM (SELECT {f} AS value, count(*) AS n, min(ord) AS first_at FROM chunks WHERE {f} <> '' GROUP BY {f}) QUALIFY rank <= 60"""
        for f in KINDS
    ),
    "per_doc_counts": "SELECT doc, count(*) AS n FROM chunks GROUP BY doc",
    "meta_keys": "SELECT k AS key, count(*) AS n, arg_min(v, ord) AS sample FROM (SELECT ord, unnest(map_keys(meta)) AS k, unnest(map_values(meta)) AS v FROM chunks) GROUP BY k",
    "record_types": """
        WITH v AS (SELECT event_id, j.key AS field, j.value::VARCHAR AS value, CASE j.type WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'bool' WHEN 'BIGINT' THEN 'int' WHEN 'UBIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'str' WHEN 'ARRAY' THEN 'list' ELSE 'dict' END AS type
            FROM events, json_each(props) j),
        k AS (SELECT field, type, count(*) AS n, count(*) FILTER (type <> 'null' AND value NOT IN ('""', '[]', '{}')) AS f, count(DISTINCT value) FILTER (type <> 'null' AND value NOT IN ('""', '[]', '{}')) AS d, arg_min(value, event_id) FILTER (type <> 'null' AND value NOT IN ('""', '[]', '{}')) AS x, min(event_id) AS seen FROM v GROUP BY ALL)
        SELECT field, coalesce(arg_min(type, (-n, type)) FILTER (type <> 'null'), 'null') AS majority, '{' || string_agg('"' || type || '":' || n, ',' ORDER BY type) || '}' AS types, sum(n)::BIGINT AS n_rows, round(sum(f) / (SELECT count(*) FROM events), 4) AS coverage,
            coalesce(sum(n) FILTER (type = 'null'), 0)::BIGINT AS nulls, sum(d)::BIGINT AS n_distinct, arg_min(x, seen) AS example FROM k GROUP BY field""",
    "token_percentiles": "SELECT count(tokens) AS n, min(tokens)::BIGINT AS least, percentile_disc(0.5) WITHIN GROUP (ORDER BY tokens)::BIGINT AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY tokens)::BIGINT AS p95, max(tokens)::BIGINT AS largest FROM chunks",
    "structure_counts": "SELECT count(*) AS n, count(DISTINCT nullif(parent_id, '')) AS parents, count(*) FILTER (parent_id <> '') AS with_parent, count(*) FILTER (is_parent) AS parent_rows, count(*) FILTER (NOT is_parent) AS other_rows FROM chunks",
    "sequence_mismatch": r"""
        WITH b AS (SELECT try_cast(regexp_extract(chunk_id, ':(\d+)$', 1) AS INT) AS s, try_cast(regexp_extract(section_no, '^(\d+)', 1) AS INT) AS n FROM chunks WHERE level = 'section')
        SELECT count(*) AS compared, count(*) FILTER (s <> n) AS mismatched, round(count(*) FILTER (s <> n) / count(*), 4) AS ratio FROM b WHERE s IS NOT NULL AND n IS NOT NULL""",
    "duplicate_keys": "SELECT doc, section_no, count(*) AS n, min(ord) AS first_ord, max(ord) AS last_ord FROM chunks WHERE doc <> '' AND section_no <> '' GROUP BY ALL HAVING count(*) > 1",
    "amendment_coverage": r"""
        SELECT count(*) AS n, count(*) FILTER (coalesce(meta['amends_section'], '') <> '') AS in_meta,
            count(*) FILTER (regexp_extract(text, '(?i)Amendment of section\s+([\dA-Za-z\-]+)', 1) <> '') AS in_text FROM chunks WHERE lower(doc_type) = 'amendment'""",
    "header_coverage": "SELECT count(*) AS n, count(*) FILTER (contains(coalesce(meta['context'], ''), 'Case:')) AS with_header, count(*) FILTER (contains(coalesce(meta['context'], ''), '|')) AS with_parts FROM chunks WHERE lower(doc_type) IN ('judgement', 'judgment')",
    "broken_parents": "SELECT ord, chunk_id, parent_id FROM chunks c WHERE parent_id <> '' AND NOT EXISTS (SELECT 1 FROM chunks p WHERE p.chunk_id = c.parent_id)",
    "doc_summary": "SELECT name, count(chunk_id) AS n_chunks, coalesce(max(tokens), 0) AS max_tokens FROM (SELECT DISTINCT name FROM extracted_docs) d LEFT JOIN chunks ON doc = name GROUP BY name",
    "running_footers": """
        SELECT ord, line, count(*) AS n FROM (SELECT ord, trim(unnest(string_split(array_to_string(pages, chr(10)), chr(10)))) AS line FROM extracted_docs)
        WHERE line <> '' AND length(line) <= 90 GROUP BY ALL HAVING count(*) >= 3""",
}
