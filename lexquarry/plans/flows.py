"""Queries that run a whole flow: searches for a question and the ingestion of a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexquarry.operators import enrich as E
from lexquarry.operators import graph as G
from lexquarry.plans import evidence, graphs
from lexquarry.plans.graphs import _with_belongs
from lexquarry.sources import tables
from lexquarry.sources.tables import Settings
from lexquarry.storage import shared_dir
from lexquarry.streaming import ingest


QUESTION = "which court may refuse to release the storage licence of the notary"


def _store(spark, sf_dir) -> evidence.HybridStore:
    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet")
    cases = F.coalesce(G.is_judgment(), F.lit(False))
    return evidence.HybridStore({"statutes": chunks.where(~cases), "judgements": chunks.where(cases)})


def _graph(spark, sf_dir) -> evidence.KnowledgeGraph:
    return evidence.KnowledgeGraph(spark.read.parquet(f"{sf_dir}/nodes.parquet"), _with_belongs(spark, sf_dir))


def question_search(spark, sf_dir):
    """One question's words searched in both collections."""
    return _store(spark, sf_dir).search(QUESTION, {"level": ["section", "para", "paragraph"]}).select("id", "collection", "score", "place", "doc")


def hop_search(spark, sf_dir):
    """Evidence for one question, with expansion along parents, children and the graph."""
    state = evidence.HopSearch(_store(spark, sf_dir), Settings(max_hops=2, threshold=0.2), graph=_graph(spark, sf_dir)).run(QUESTION, {"level": "section"})
    return evidence.shown_evidence(state.pool)


def hop_graph(spark, sf_dir):
    """What the graph adds to that evidence."""
    state = evidence.HopSearch(_store(spark, sf_dir), Settings(max_hops=2, threshold=0.2), graph=_graph(spark, sf_dir)).run(QUESTION, {"level": "section"})
    return evidence.shown_graph(state.graph)


def fast_answer(spark, sf_dir):
    """The evidence of one search, reranked."""
    return evidence.answer(QUESTION, _store(spark, sf_dir), deep=False)["evidence"]


def judgment_texts(spark, sf_dir):
    """The text of every judgment that an extractor would be given."""
    return E.judgment_texts(spark.read.parquet(f"{sf_dir}/chunks.parquet"))


def evidence_texts(spark, sf_dir):
    """Of every document the first eight chunks as a model would be given them."""
    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet")
    w = W.partitionBy("doc").orderBy("ord")
    pool = chunks.where("doc is not null").withColumn("place", F.row_number().over(w)).where("place <= 8")
    return E.evidence_text(pool, by=["doc"])


def cited_texts(spark, sf_dir):
    """Of every section the first five judgments that cite it, as a model would be given them."""
    cites = G.citing_judgments(spark.read.parquet(f"{sf_dir}/edges.parquet"))
    case = G.load_nodes(spark.read.parquet(f"{sf_dir}/nodes.parquet").where("label = 'Judgment'"))
    prop = lambda k: F.element_at("props", k).alias(k)
    named = case.select(F.col("id").alias("judgment_id"), F.get("key", F.lit(0)).alias("case_no"), prop("court"), prop("outcome"))
    return E.cited_text(cites.join(named, "judgment_id").select("section_id", F.col("judgment_id").alias("id"), F.lit("CITES").alias("source"), "case_no", "court", "outcome"), by=["section_id"])


def streamed_chunks(spark, sf_dir):
    """Chunks taken in as a stream, each id once."""
    target = f"{shared_dir(spark)}/streamed-{uuid.uuid4().hex}"
    cols = ["chunk_id", "ord", "doc"]
    one = spark.read.parquet(f"{sf_dir}/chunks.parquet").inputFiles()[0]
    folder, glob = (f"{sf_dir}/chunks.parquet", "*.parquet") if not one.endswith("chunks.parquet") else (sf_dir, "chunks.parquet")
    return ingest.ingest(spark, folder, glob, target, "chunk_id", "ord", cols).select("chunk_id", "doc")


def graph_counts(spark, sf_dir):
    return tables.graph_counts(spark.read.parquet(f"{sf_dir}/nodes.parquet"), spark.read.parquet(f"{sf_dir}/edges.parquet"))


def reset_graph(spark, sf_dir):
    """What stays when courts and parties are removed."""
    n, e = tables.without_labels(spark.read.parquet(f"{sf_dir}/nodes.parquet"), spark.read.parquet(f"{sf_dir}/edges.parquet"), ["Court", "Party"])
    return n.select(F.lit("node").alias("kind"), "label").unionByName(e.select(F.lit("edge").alias("kind"), F.col("type").alias("label"))).groupBy("kind", "label").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (question_search, hop_search, hop_graph, fast_answer, judgment_texts, evidence_texts, cited_texts, streamed_chunks, graph_counts, reset_graph)}
_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"
_ASKED = ", ".join(f"'{w}'" for w in QUESTION.split())


_CASE = "coalesce(lower(doc_type) IN ('judgement', 'judgment'), false)"
_LEVELS = "level IN ('section', 'para', 'paragraph')"


def _searched(where: str, n: int, levels: str = _LEVELS) -> str:
    """The best 20 of one collection by the words of the question; only the sparse ranking exists."""
    return f"""SELECT id, {n} AS priority, round(1.0 / (60 + row_number() OVER (ORDER BY s DESC, id)), 6) AS score FROM (
        SELECT chunk_id AS id, arg_min((SELECT coalesce(sum(k), 0) FROM (SELECT len(list_filter({_WORDS}, lambda w: w = a)) * c AS k FROM asked)), ord) AS s FROM chunks
        WHERE chunk_id IS NOT NULL AND {levels} AND {where} GROUP BY chunk_id) WHERE s > 0 QUALIFY row_number() OVER (ORDER BY s DESC, id) <= 20"""


_MERGED = """
        r{0} AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY score DESC, id) AS k FROM f{0}),
        o{0} AS (SELECT * FROM r{0} QUALIFY row_number() OVER (PARTITION BY id ORDER BY priority, k) = 1),
        m{0} AS (SELECT id, row_number() OVER (ORDER BY score DESC, priority, k, id) AS pos FROM o{0})"""
#: The loop as it goes on tables where the first search is good enough: search, expansion, search, graph; ends in ``final`` and ``kg``.
_LOOP = f"""
        WITH asked AS (SELECT a, count(*) AS c FROM (SELECT unnest([{_ASKED}]) AS a) GROUP BY a),
        t AS (SELECT *, round((SELECT count(*) FROM asked WHERE list_contains({_WORDS}, a)) / (SELECT count(*) FROM asked), 6) AS said FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY CASE WHEN {_CASE} THEN 1 ELSE 0 END, ord) = 1),
        f1 AS ({_searched(f"NOT {_CASE}", 0, "level = 'section'")} UNION ALL {_searched(_CASE, 1, "level = 'section'")}), {_MERGED.format(1)},
        kid AS (SELECT c.chunk_id AS id, m1.pos, CASE WHEN {_CASE.replace("doc_type", "c.doc_type")} THEN 1 ELSE 0 END AS n, c.ord FROM chunks c JOIN m1 ON c.parent_id = m1.id JOIN t ON t.chunk_id = m1.id AND t.is_parent WHERE c.chunk_id IS NOT NULL),
        kids AS (SELECT id, pos, n, row_number() OVER (PARTITION BY pos, n ORDER BY ord) AS r FROM kid QUALIFY r <= 20),
        w AS (SELECT parent_id AS id, pos, 0 AS k, 0 AS n FROM m1 JOIN t ON chunk_id = m1.id WHERE parent_id <> '' UNION ALL SELECT id, pos, 1, n * 1000 + r FROM kids),
        e AS (SELECT id, row_number() OVER (ORDER BY w) AS pos FROM (SELECT id, min((pos, k, n)) AS w FROM w GROUP BY id) WHERE id IN (SELECT chunk_id FROM t)),
        f2 AS ({_searched(f"NOT {_CASE}", 0, "true")} UNION ALL {_searched(_CASE, 1, "true")}), {_MERGED.format(2)},
        p3 AS (SELECT id, arg_min(pos, step) AS pos, min(step) AS step FROM (SELECT id, pos, 1 AS step FROM m1 UNION ALL SELECT id, pos, 2 FROM e UNION ALL SELECT id, pos, 3 FROM m2) GROUP BY id),
        best AS (SELECT id, row_number() OVER (ORDER BY said DESC, pos, id) AS place FROM m2 JOIN t ON chunk_id = id QUALIFY place <= 10),
        seed AS (SELECT p3.id FROM p3 LEFT JOIN best ON best.id = p3.id ORDER BY place NULLS LAST, step, pos LIMIT 24),
        {graphs._BEL}, {graphs._BOTH},
        pair AS (SELECT DISTINCT to_id, from_id FROM bel WHERE from_id IN (SELECT id FROM seed) ORDER BY to_id, from_id LIMIT 12),
        near AS (SELECT DISTINCT b AS id FROM both_ WHERE a IN (SELECT to_id FROM pair) AND b NOT IN (SELECT to_id FROM pair) ORDER BY id LIMIT 12),
        sec AS (SELECT id, seed, any_value(key) AS key, any_value(coalesce(props['chunk_id'], (SELECT min(from_id) FROM pair WHERE to_id = nodes.id))) AS chunk
            FROM nodes JOIN (SELECT DISTINCT to_id AS id, true AS seed FROM pair UNION ALL SELECT id, false FROM near) USING (id) WHERE label = 'Section' GROUP BY id, seed),
        sat AS (SELECT *, row_number() OVER (ORDER BY seed DESC, id) AS pos FROM sec),
        p4 AS (SELECT id, pos, step, false AS from_graph FROM p3 UNION ALL SELECT chunk, min(pos), 4, true FROM sat WHERE chunk IN (SELECT chunk_id FROM t) AND chunk NOT IN (SELECT id FROM p3) GROUP BY chunk),
        final AS (SELECT row_number() OVER (ORDER BY said DESC, rank, chunk_id) AS place, t.*, from_graph FROM (SELECT *, row_number() OVER (ORDER BY step, pos, id) AS rank FROM p4) JOIN t ON chunk_id = id QUALIFY place <= 20),
        cite AS (SELECT from_id AS id FROM (SELECT DISTINCT to_id, from_id FROM edges WHERE type = 'CITES' AND to_id IS NOT NULL AND from_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY to_id ORDER BY from_id) <= 20 AND to_id IN (SELECT to_id FROM pair)),
        kg AS (SELECT id, 'REFERENCES' AS source, key[1] AS act, key[2] AS section_no, NULL AS case_no, NULL AS court, NULL AS outcome, NULL AS date FROM sat WHERE coalesce(chunk NOT IN (SELECT chunk_id FROM t), true)
            UNION ALL SELECT id, 'CITES', NULL, NULL, any_value(key[1]), any_value(props['court']), any_value(props['outcome']), any_value(props['date']) FROM nodes WHERE label = 'Judgment' AND id IN (SELECT id FROM cite) GROUP BY id)"""
SQL = {
    "hop_search": _LOOP + " SELECT place::INT AS place, chunk_id, doc, section_no, section_title, doc_type, round_even(said, 4) AS score, from_graph, left(text, 300) AS text FROM final WHERE place <= 12",
    "hop_graph": _LOOP + " SELECT (row_number() OVER (ORDER BY source DESC, id))::INT AS place, source, act, section_no, case_no, court, outcome, date FROM kg QUALIFY place <= 12",
    "question_search": f"""
        WITH asked AS (SELECT a, count(*) AS c FROM (SELECT unnest([{_ASKED}]) AS a) GROUP BY a),
        f AS ({_searched("NOT coalesce(lower(doc_type) IN ('judgement', 'judgment'), false)", 0)} UNION ALL {_searched("coalesce(lower(doc_type) IN ('judgement', 'judgment'), false)", 1)}),
        r AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY score DESC, id) AS k FROM f),
        o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY priority, k) = 1),
        d AS (SELECT chunk_id AS id, arg_min(doc, (CASE WHEN coalesce(lower(doc_type) IN ('judgement', 'judgment'), false) THEN 1 ELSE 0 END, ord)) AS doc FROM chunks GROUP BY chunk_id)
        SELECT id, CASE priority WHEN 0 THEN 'statutes' ELSE 'judgements' END AS collection, score, (row_number() OVER (ORDER BY score DESC, priority, k, id))::INT AS place, doc FROM o JOIN d USING (id)""",
    "fast_answer": f"""
        WITH asked AS (SELECT a, count(*) AS c FROM (SELECT unnest([{_ASKED}]) AS a) GROUP BY a),
        f AS ({_searched(f"NOT {_CASE}", 0, "true")} UNION ALL {_searched(_CASE, 1, "true")}),
        r AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY score DESC, id) AS k FROM f),
        o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY priority, k) = 1),
        m AS (SELECT id, row_number() OVER (ORDER BY score DESC, priority, k, id) AS place FROM o),
        t AS (SELECT * FROM chunks WHERE chunk_id IN (SELECT id FROM m) QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY CASE WHEN {_CASE} THEN 1 ELSE 0 END, ord) = 1),
        s AS (SELECT m.place AS found, t.*, round((SELECT count(*) FROM asked WHERE list_contains({_WORDS}, a)) / (SELECT count(*) FROM asked), 6) AS said FROM m JOIN t ON chunk_id = id)
        SELECT (row_number() OVER (ORDER BY said DESC, found, chunk_id))::INT AS place, chunk_id, doc, section_no, section_title, doc_type, round_even(said, 4) AS score, false AS from_graph, left(text, 300) AS text FROM s QUALIFY place <= 6""",
    "judgment_texts": """
        SELECT doc, left(string_agg(coalesce(text, ''), chr(10) ORDER BY ord), 8000) AS text FROM (SELECT * FROM chunks WHERE lower(doc_type) IN ('judgement', 'judgment') AND doc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc ORDER BY ord) <= 6) GROUP BY doc""",
    "evidence_texts": """
        WITH p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ord) AS n FROM chunks WHERE doc IS NOT NULL QUALIFY n <= 8)
        SELECT doc, string_agg('[' || n || '] ' || coalesce(nullif(doc, ''), 'None') || ' — Section ' || coalesce(nullif(section_no, ''), 'None') || ' (' || coalesce(nullif(section_title, ''), 'n/a') || ') [' || coalesce(nullif(doc_type, ''), 'None') || ']' || chr(10)
            || left(coalesce(text, ''), 1200), chr(10) || chr(10) ORDER BY n) AS text FROM p GROUP BY doc""",
    "cited_texts": """
        WITH c AS (SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY from_id) AS k FROM (SELECT DISTINCT to_id, from_id FROM edges WHERE type = 'CITES' AND to_id IS NOT NULL AND from_id IS NOT NULL) QUALIFY k <= 20),
        jn AS (SELECT id, any_value(key[1]) AS case_no, any_value(props['court']) AS court, any_value(props['outcome']) AS outcome FROM nodes WHERE label = 'Judgment' AND id IS NOT NULL GROUP BY id),
        r AS (SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY from_id) AS n FROM c JOIN jn ON id = from_id QUALIFY n <= 5)
        SELECT to_id AS section_id, string_agg('[C' || n || '] ' || coalesce(case_no, 'None') || ' — ' || coalesce(nullif(court, ''), 'court n/a') || ' (outcome: ' || coalesce(nullif(outcome, ''), 'n/a') || ')', chr(10) ORDER BY n) AS text FROM r GROUP BY to_id""",
    "streamed_chunks": "SELECT chunk_id, arg_max(doc, ord) AS doc FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id",
    "graph_counts": "SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type",
    "reset_graph": """
        SELECT 'node' AS kind, label, count(*) AS n FROM nodes WHERE coalesce(label NOT IN ('Court', 'Party'), true) GROUP BY label
        UNION ALL SELECT 'edge', type, count(*) FROM edges WHERE coalesce(from_label NOT IN ('Court', 'Party'), true) AND coalesce(to_label NOT IN ('Court', 'Party'), true) GROUP BY type""",
}
