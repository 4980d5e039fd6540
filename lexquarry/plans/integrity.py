"""Queries on references between records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexquarry.operators import references as R


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("chunks", "nodes", "edges")]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references of chunks and edges."""
    return R.corpus_orphans(*_tables(spark, sf_dir)).select("tab", "field", "row_key").distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and orphans per table, field and month."""
    chunks, nodes, edges = _tables(spark, sf_dir)
    return R.orphan_report(R.corpus_references(chunks, edges), R.corpus_orphans(chunks, nodes, edges))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report}

_REFS = """
    WITH refs AS (
        SELECT 'chunks' AS tab, 'parent_id' AS field, ord AS row_key, parent_id AS key, ingested_at FROM chunks
        UNION ALL SELECT 'edges', 'from_id', edge_id, from_id, ingested_at FROM edges
        UNION ALL SELECT 'edges', 'to_id', edge_id, to_id, ingested_at FROM edges),
    due AS (
        SELECT tab, field, row_key, key, strftime(ingested_at AT TIME ZONE 'UTC', '%Y-%m') AS month,
            (date_trunc('month', ingested_at AT TIME ZONE 'UTC') + INTERVAL 1 MONTH) AT TIME ZONE 'UTC' AS e
        FROM refs WHERE key <> ''),
    targets AS (
        SELECT chunk_id AS key, ingested_at, deleted_at FROM chunks
        UNION ALL SELECT id, ingested_at, deleted_at FROM nodes),
    lost AS (
        SELECT * FROM due d WHERE NOT EXISTS (
            SELECT 1 FROM targets t WHERE t.key = d.key AND t.ingested_at < d.e
                AND (t.deleted_at IS NULL OR t.deleted_at >= d.e)))
"""
SQL = {
    "p3_found": _REFS + "SELECT DISTINCT tab, field, row_key FROM lost",
    "p3_report": _REFS + """
        SELECT tab, field, month, count(*) AS n_references, coalesce(any_value(n), 0) AS n_orphans
        FROM due LEFT JOIN (SELECT tab, field, month, count(*) AS n FROM lost GROUP BY ALL) USING (tab, field, month)
        GROUP BY tab, field, month""",
}
