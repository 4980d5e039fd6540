"""Queries of the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.functions import text as X
from lexquarry.operators import graph as G
from lexquarry.plans import texts
from lexquarry.storage import cut


def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _graph(spark, sf_dir, *parts: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return G.corpus_graph(_t(spark, sf_dir, "chunks"), _t(spark, sf_dir, "act_catalog"), parts or G.PARTS)


CASES = ["Judgment", "Court", "Party"]


def graph_nodes(spark, sf_dir):
    """The nodes of the statutes and of chunks, with their titles and how many chunks name them."""
    nodes = G.merge_nodes(_graph(spark, sf_dir, "statutes", "judgments")[0].where(~F.col("label").isin(CASES)))
    return nodes.select("label", F.array_join("key", ":").alias("k"), F.element_at("props", "title").alias("title"), "n_chunks", "source_file")


def judgment_nodes(spark, sf_dir):
    """Judgments, courts and parties that case headers give."""
    nodes = G.merge_nodes(_graph(spark, sf_dir, "judgments")[0].where(F.col("label").isin(CASES)))
    return nodes.select("label", F.array_join("key", ":").alias("k"), F.element_at("props", "outcome").alias("outcome"), "n_chunks")


def _shown(edges: DataFrame) -> DataFrame:
    return edges.select("type", F.array_join("from_key", ":").alias("a"), F.array_join("to_key", ":").alias("b"), "to_label", "source", "n_chunks")


def graph_edges(spark, sf_dir):
    """The edges of hierarchies and case headers, with how many chunks give them."""
    return _shown(G.merge_edges(_graph(spark, sf_dir, "statutes", "judgments")[1]))


def graph_references(spark, sf_dir):
    """Every reference between sections, else from a section to an act."""
    return _shown(G.merge_edges(_graph(spark, sf_dir, "references")[1]))


def graph_amendments(spark, sf_dir):
    """Every amended section with the act that amends it."""
    return _shown(G.merge_edges(_graph(spark, sf_dir, "amendments")[1]))


def graph_reasons(spark, sf_dir):
    """Why links were left out."""
    return _graph(spark, sf_dir)[2].groupBy("reason").agg(F.count("*").alias("n"))


def assembled_graph(spark, sf_dir):
    """The whole graph with ids and checked ends, counted by label and type."""
    nodes, edges, _ = _graph(spark, sf_dir)
    nodes, edges, _ = G.assemble(cut(G.merge_nodes(nodes)), cut(G.merge_edges(edges)))
    n = nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n"), F.count("point_id").alias("n_points")).withColumn("kind", F.lit("node"))
    e = edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("n_points")).withColumn("kind", F.lit("edge"))
    return n.unionByName(e)


def section_records(spark, sf_dir):
    """Section nodes as evidence, each once, with the smallest of the chunks that belong to it where the node states none."""
    nodes = G.load_nodes(_t(spark, sf_dir, "nodes"))
    via = _t(spark, sf_dir, "edges").where("type = 'BELONGS_TO'").select(F.col("to_id").alias("id"), F.col("from_id").alias("via_chunk"))
    return G.section_records(nodes, via).select("id", "act", "section_no", "title", "chunk_id")


def canonical_acts(spark, sf_dir):
    return G.canonical_acts(_t(spark, sf_dir, "nodes"))


def loaded_nodes(spark, sf_dir):
    n = G.load_nodes(_t(spark, sf_dir, "nodes"))
    return n.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


def loaded_edges(spark, sf_dir):
    return G.load_edges(_t(spark, sf_dir, "nodes"), _t(spark, sf_dir, "edges"))


def dangling_edges(spark, sf_dir):
    return G.dangling(_t(spark, sf_dir, "nodes"), _t(spark, sf_dir, "edges")).select("edge_id", "type").distinct()


def assembly_summary(spark, sf_dir):
    return G.assembly_summary(_t(spark, sf_dir, "nodes"), _t(spark, sf_dir, "edges"))


def verified_counts(spark, sf_dir):
    """Loaded nodes against the rows that were delivered; labels with redelivered rows are not ok."""
    nodes = _t(spark, sf_dir, "nodes")
    return G.verify_counts(G.load_nodes(nodes), "label", nodes.groupBy("label").agg(F.count("*").alias("expected")))


def repeated_keys(spark, sf_dir):
    return G.repeated_keys(_t(spark, sf_dir, "nodes"))


def label_counts(spark, sf_dir):
    return _t(spark, sf_dir, "nodes").groupBy("label").agg(F.count("*").alias("n"))


def _with_belongs(spark, sf_dir) -> DataFrame:
    """The edges with those that the chunk ids of section nodes stand for."""
    own = _t(spark, sf_dir, "nodes").where("label = 'Section'").select(F.explode("chunk_ids").alias("from_id"), F.col("id").alias("to_id"))
    belongs = own.select(F.lit("BELONGS_TO").alias("type"), F.lit("Chunk").alias("from_label"), "from_id", F.lit("Section").alias("to_label"), "to_id")
    return belongs.unionByName(_t(spark, sf_dir, "edges").select(*belongs.columns))


def citing_judgments(spark, sf_dir):
    return G.citing_judgments(_t(spark, sf_dir, "edges"))


def bounded_bfs(spark, sf_dir):
    """Sections within two hops of every section that refers to another, 1,000 for each at most."""
    edges = _t(spark, sf_dir, "edges")
    seeds = edges.where("type = 'REFERENCES' and from_label = 'Section' and to_label = 'Section' and from_id is not null and to_id is not null").select(F.col("from_id").alias("query"), F.col("from_id").alias("id"))
    return G.expand_sections_each(edges, seeds, 2, 1000)


def _each_chunk(edges) -> DataFrame:
    return edges.where("type = 'BELONGS_TO' and from_id is not null").select(F.col("from_id").alias("query"), F.col("from_id").alias("id"))


def chunk_sections(spark, sf_dir):
    """The sections of every chunk, 25 for each at most."""
    edges = _with_belongs(spark, sf_dir)
    return G.sections_of_chunks_each(edges, _each_chunk(edges), 25)


def expanded_evidence(spark, sf_dir):
    """Sections, neighbours and citing judgments of every chunk."""
    edges = _with_belongs(spark, sf_dir)
    return G.expand_evidence_each(edges, _each_chunk(edges), 1, 1000)


def enrichment_coverage(spark, sf_dir):
    return G.coverage(_t(spark, sf_dir, "nodes"), _t(spark, sf_dir, "edges"))


def key_resolvability(spark, sf_dir):
    return G.resolvable(_t(spark, sf_dir, "nodes"))


QUERIES = {
    f.__name__: f
    for f in (graph_nodes, judgment_nodes, graph_edges, graph_reasons, graph_references, graph_amendments, assembled_graph, section_records, canonical_acts, loaded_nodes, loaded_edges, dangling_edges, assembly_summary, verified_counts, repeated_keys, label_counts, bounded_bfs, chunk_sections, citing_judgments, expanded_evidence, enrichment_coverage, key_resolvability)
}

_STEM = r"nullif(trim(regexp_replace(doc, '\.[^.]*$', '')), '')"
_LAW = "lower(doc_type) IN ('statute', 'rules', 'amendment', 'order')"
_SEC = f"coalesce(level = 'section' AND {_LAW} AND section_no <> '', false)"


def _plain(c: str) -> str:
    s = f"lower({c})"
    for pattern, new in X.PLAIN_STEPS:
        s = f"regexp_replace({s}, '{pattern}', '{new}', 'g')"
    return f"trim({s})"


_OF_ACT = G.OF_ACT.replace("'", "''")
_FIRST = "arg_min({0}, (CASE WHEN level = 'preamble' THEN 0 ELSE 1 END, ord))"
_MORE = f"regexp_extract_all(left(tail, 80), '{G.CONTINUED}', 1)"
_BASE = rf"""
    c AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ord) = 1),
    cat AS (SELECT {_plain("act_name")} AS plain, min(act_name) AS canonical FROM act_catalog WHERE act_name <> '' GROUP BY ALL),
    law AS (SELECT c.*, coalesce(canonical, {_STEM}) AS act FROM c LEFT JOIN cat ON plain = {_plain("doc")} WHERE {_LAW}),
    sec AS (SELECT * FROM law WHERE act <> '' AND {_SEC}),
    first_sec AS (SELECT act, section_no, min(ord) AS f FROM sec GROUP BY ALL),
    oth AS (SELECT law.*, coalesce(f < ord, false) AS ok FROM law LEFT JOIN first_sec USING (act, section_no) WHERE act <> '' AND NOT {_SEC} AND section_no <> ''),
    up AS (SELECT l.*, coalesce(p.ord < l.ord, false) AS ok FROM law l LEFT JOIN law p ON p.chunk_id = l.parent_id AND p.act <> '' WHERE l.act <> '' AND l.parent_id <> ''),
    jud AS (SELECT *, coalesce(meta['context'], '') AS ctx FROM c WHERE lower(doc_type) IN ('judgement', 'judgment')),
    jup AS (SELECT l.*, coalesce(p.ord < l.ord, false) AS ok FROM jud l LEFT JOIN jud p ON p.chunk_id = l.parent_id WHERE l.parent_id <> ''),
    jh AS (SELECT doc, {_FIRST.format("ctx")} AS ctx, {_FIRST.format("chunk_id")} AS head_chunk, arg_min(chunk_id, ord) AS first_chunk,
        arg_max(meta['disposition'], ord) FILTER (meta['disposition'] <> '') AS outcome, max(ord) FILTER (meta['disposition'] <> '') AS said_at FROM jud GROUP BY doc),
    js AS (SELECT *, list_filter(list_transform(string_split(regexp_extract(ctx, '\[Case:\s*(.*?)\]', 1), '|'), lambda x: trim(x)), lambda x: x <> '') AS s FROM jh),
    ja AS (SELECT *, {texts.HEADER_AT} FROM js),
    jx AS (SELECT doc, head_chunk, first_chunk, outcome, said_at, {texts.HEADER} FROM ja),
    j AS (SELECT * EXCLUDE (case_no), case_no AS own_no, coalesce(case_no, {_STEM}) AS case_no, {texts.SIDES.format("parties")} AS party FROM jx),
    pa AS (SELECT doc, first_chunk, case_no, unnest(party) AS party FROM j),
    al AS (SELECT DISTINCT act_name, lower(act_name) AS alias FROM act_catalog WHERE act_name <> ''),
    am AS (SELECT ord, chunk_id, act, coalesce(nullif(meta['amends_section'], ''), nullif(regexp_extract(text, '{X.AMENDED_SECTION}', 1), '')) AS said,
        (SELECT arg_min(act_name, (-length(alias), alias)) FROM al WHERE contains(lower(text), alias)) AS amended FROM law WHERE lower(doc_type) = 'amendment' AND act <> ''),
    amd AS (SELECT am.*, CASE WHEN said IS NULL THEN 'amendment_no_section' WHEN amended IS NULL THEN 'amendment_no_act' WHEN NOT coalesce(f < ord, false) THEN 'amendment_section_not_in_graph' END AS reason
        FROM am LEFT JOIN first_sec s ON s.act = amended AND s.section_no = said),
    rp AS (SELECT ord, chunk_id, act, section_no, string_split(regexp_replace(text, '(?i)(\b(?:sections|section|sec|s)\.?\s+\d+[A-Za-z]?)', '\1' || chr(1), 'g'), chr(1)) AS p FROM sec WHERE text IS NOT NULL),
    rh AS (SELECT *, unnest(range(1, len(p))) AS i FROM rp),
    rt AS (SELECT ord, chunk_id, act, section_no, regexp_extract(p[i], '(\d+[A-Za-z]?)$', 1) AS no, left(array_to_string(p[i + 1:], ''), 90) AS tail FROM rh),
    rm AS (SELECT DISTINCT regexp_extract(tail, '{_OF_ACT}', 1) AS said FROM rt),
    rn AS (SELECT said, (SELECT arg_min(act_name, (-length(alias), alias)) FROM al WHERE contains(lower(said), alias)) AS named FROM rm),
    rf AS (SELECT ord, chunk_id, act, section_no, coalesce(named, act) AS ref_act, unnest(([no] || {_MORE})[1:5]) AS ref_no FROM rt JOIN rn ON rn.said = regexp_extract(tail, '{_OF_ACT}', 1)),
    rx AS (SELECT rf.*, EXISTS (SELECT 1 FROM first_sec s WHERE s.act = ref_act AND s.section_no = ref_no) AS to_sec, ref_act <> rf.act AND ref_act IN (SELECT act FROM law WHERE act <> '') AS to_act FROM rf),
    e AS (
        SELECT 'CONTAINS' AS type, act AS a, act || ':' || section_no AS b, 'Section' AS to_label, 'hierarchy:act->section' AS source, chunk_id FROM sec
        UNION ALL SELECT 'CONTAINS', act, act || ':' || part, 'Part', 'hierarchy:act->part', chunk_id FROM sec WHERE part <> ''
        UNION ALL SELECT 'CONTAINS', act || ':' || part, act || ':' || section_no, 'Section', 'hierarchy:part->section', chunk_id FROM sec WHERE part <> ''
        UNION ALL SELECT 'CONTAINS', act, act || ':' || chapter, 'Chapter', 'hierarchy:act->chapter', chunk_id FROM sec WHERE chapter <> ''
        UNION ALL SELECT 'CONTAINS', act || ':' || chapter, act || ':' || section_no, 'Section', 'hierarchy:chapter->section', chunk_id FROM sec WHERE chapter <> ''
        UNION ALL SELECT 'BELONGS_TO', chunk_id, act || ':' || section_no, 'Section', 'chunk.section_no', chunk_id FROM sec
        UNION ALL SELECT 'BELONGS_TO', chunk_id, act || ':' || section_no, 'Section', 'chunk.section_no', chunk_id FROM oth WHERE ok
        UNION ALL SELECT 'PARENT_OF', parent_id, chunk_id, 'Chunk', 'parent_id', chunk_id FROM up WHERE ok
        UNION ALL SELECT 'PARENT_OF', parent_id, chunk_id, 'Chunk', 'parent_id', chunk_id FROM jup WHERE ok
        UNION ALL SELECT 'DECIDED_BY', case_no, court, 'Court', 'case header', first_chunk FROM j WHERE case_no <> '' AND court <> ''
        UNION ALL SELECT 'INVOLVES', case_no, party, 'Party', 'case header', first_chunk FROM pa WHERE case_no <> ''
        UNION ALL SELECT 'AMENDED_BY', amended || ':' || said, act, 'Act', 'amendment meta/text', chunk_id FROM amd WHERE reason IS NULL
        UNION ALL SELECT 'REFERENCES', act || ':' || section_no, ref_act || ':' || ref_no, 'Section', 'regex cross-ref', chunk_id FROM rx WHERE to_sec
        UNION ALL SELECT 'REFERENCES', act || ':' || section_no, ref_act, 'Act', 'regex cross-ref(act)', chunk_id FROM rx WHERE NOT to_sec AND to_act),
    ee AS (SELECT type, a, b, to_label, source, count(DISTINCT chunk_id) AS n_chunks FROM e GROUP BY type, a, b, to_label, source),
    m AS (
        SELECT 'Act' AS label, act AS k, doc, NULL AS title, NULL AS outcome, chunk_id, ord FROM law WHERE act <> ''
        UNION ALL SELECT 'Chunk', chunk_id, doc, NULL, NULL, chunk_id, ord FROM law WHERE act <> '' AND chunk_id <> ''
        UNION ALL SELECT 'Section', act || ':' || section_no, doc, nullif(section_title, ''), NULL, chunk_id, ord FROM sec
        UNION ALL SELECT 'Part', act || ':' || part, doc, NULL, NULL, chunk_id, ord FROM sec WHERE part <> ''
        UNION ALL SELECT 'Chapter', act || ':' || chapter, doc, NULL, NULL, chunk_id, ord FROM sec WHERE chapter <> ''
        UNION ALL SELECT 'Chunk', chunk_id, doc, NULL, NULL, chunk_id, ord FROM jud WHERE chunk_id <> ''
        UNION ALL SELECT 'Judgment', case_no, doc, NULL, NULL, head_chunk, 0 FROM j WHERE own_no <> ''
        UNION ALL SELECT 'Judgment', case_no, doc, NULL, NULL, chunk_id, ord FROM j JOIN jud USING (doc) WHERE own_no IS NULL AND case_no <> ''
        UNION ALL SELECT 'Court', court, doc, NULL, NULL, chunk_id, ord FROM j JOIN jud USING (doc) WHERE court <> ''
        UNION ALL SELECT 'Party', pa.party, doc, NULL, NULL, chunk_id, ord FROM pa JOIN jud USING (doc)),
    mm AS (SELECT label, k, arg_min(doc, ord) AS source_file, arg_min(title, ord) FILTER (title IS NOT NULL) AS title, count(DISTINCT chunk_id) AS n_chunks FROM m GROUP BY label, k)"""
_REF = "type = 'REFERENCES' AND from_label = 'Section' AND to_label = 'Section' AND from_id IS NOT NULL AND to_id IS NOT NULL"
_BOTH = f"both_ AS (SELECT from_id AS a, to_id AS b FROM edges WHERE {_REF} UNION SELECT to_id, from_id FROM edges WHERE {_REF})"
_BEL = "bel AS (SELECT unnest(chunk_ids) AS from_id, id AS to_id FROM nodes WHERE label = 'Section' UNION ALL SELECT from_id, to_id FROM edges WHERE type = 'BELONGS_TO' AND to_label = 'Section')"
SQL = {
    "graph_edges": f"WITH {_BASE} SELECT * FROM ee WHERE type NOT IN ('REFERENCES', 'AMENDED_BY')",
    "graph_references": f"WITH {_BASE} SELECT * FROM ee WHERE type = 'REFERENCES'",
    "graph_amendments": f"WITH {_BASE} SELECT * FROM ee WHERE type = 'AMENDED_BY'",
    "graph_nodes": f"WITH {_BASE} SELECT label, k, source_file, title, n_chunks FROM mm WHERE label NOT IN ('Judgment', 'Court', 'Party')",
    "judgment_nodes": f"""
        WITH {_BASE}, lo AS (SELECT case_no, arg_max(outcome, said_at) AS outcome FROM j GROUP BY case_no)
        SELECT label, k, CASE WHEN label = 'Judgment' THEN nullif(outcome, '') END AS outcome, n_chunks FROM mm LEFT JOIN lo ON case_no = k AND label = 'Judgment' WHERE label IN ('Judgment', 'Court', 'Party')""",
    "assembled_graph": f"""
        WITH {_BASE} SELECT 'node' AS kind, label AS name, count(*) AS n, count(*) FILTER (label = 'Chunk') AS n_points FROM mm GROUP BY label UNION ALL SELECT 'edge', type, count(*), 0 FROM ee GROUP BY type""",
    "section_records": """
        WITH n AS (SELECT id, any_value(key) AS key, any_value(props) AS props FROM nodes WHERE label = 'Section' AND id IS NOT NULL GROUP BY id),
        v AS (SELECT to_id AS id, min(from_id) AS via FROM edges WHERE type = 'BELONGS_TO' GROUP BY to_id)
        SELECT id, key[1] AS act, key[2] AS section_no, props['title'] AS title, coalesce(props['chunk_id'], via) AS chunk_id FROM n LEFT JOIN v USING (id)""",
    "canonical_acts": "SELECT DISTINCT key[1] AS act FROM nodes WHERE label = 'Act' AND key[1] <> ''",
    "graph_reasons": f"""
        WITH {_BASE},
        r AS (SELECT 'no_act_name' AS reason FROM law WHERE act IS NULL OR act = '' UNION ALL SELECT 'belongs_to_no_section_node' FROM oth WHERE NOT ok
            UNION ALL SELECT 'parent_not_in_graph' FROM up WHERE NOT ok UNION ALL SELECT 'judgment_parent_not_in_graph' FROM jup WHERE NOT ok
            UNION ALL SELECT reason FROM amd WHERE reason IS NOT NULL
            UNION ALL SELECT CASE WHEN ref_act <> act THEN 'ref_act_not_in_graph' ELSE 'ref_section_not_in_graph' END FROM rx WHERE NOT to_sec AND NOT to_act)
        SELECT reason, count(*) AS n FROM r GROUP BY reason""",
    "loaded_nodes": "SELECT label, count(DISTINCT id) AS n, count(DISTINCT id) AS n_ids FROM nodes WHERE id IS NOT NULL GROUP BY label",
    "loaded_edges": "SELECT type, from_id, to_id, min(from_label) AS from_label, min(to_label) AS to_label, count(*) AS n_sources FROM edges WHERE from_id IN (SELECT id FROM nodes) AND to_id IN (SELECT id FROM nodes) GROUP BY type, from_id, to_id",
    "dangling_edges": "SELECT edge_id, type FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE id = e.from_id) OR NOT EXISTS (SELECT 1 FROM nodes WHERE id = e.to_id)",
    "assembly_summary": """
        SELECT (SELECT count(*) FROM nodes) AS nodes_in, (SELECT count(DISTINCT id) FROM nodes) AS nodes_out, (SELECT count(*) FROM edges) AS edges_in,
            (SELECT count(*) FROM (SELECT DISTINCT type, from_id, to_id FROM edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL)) AS edges_out,
            (SELECT count(*) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE id = e.from_id) OR NOT EXISTS (SELECT 1 FROM nodes WHERE id = e.to_id)) AS dangling_edges,
            (SELECT count(*) - count(DISTINCT id) FROM nodes) AS repeated_nodes""",
    "verified_counts": "SELECT label, count(DISTINCT id) AS loaded, count(*) AS expected, count(DISTINCT id) = count(*) AS ok FROM nodes GROUP BY label",
    "repeated_keys": "SELECT label, id, count(*) AS n FROM nodes GROUP BY label, id HAVING count(*) > 1",
    "label_counts": "SELECT label, count(*) AS n FROM nodes GROUP BY label",
    "bounded_bfs": f"""
        WITH {_BOTH}, h0 AS (SELECT DISTINCT from_id AS query, from_id AS id FROM edges WHERE {_REF}),
        n1 AS (SELECT DISTINCT query, b AS id FROM h0 JOIN both_ ON a = h0.id WHERE b <> query),
        h1 AS (SELECT * FROM n1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY id) <= 1000),
        n2 AS (SELECT DISTINCT query, b AS id FROM h1 JOIN both_ ON a = h1.id WHERE b <> query AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.query = h1.query AND x.id = b)),
        h2 AS (SELECT n2.* FROM n2 LEFT JOIN (SELECT query, count(*) AS had FROM h1 GROUP BY query) USING (query) QUALIFY row_number() OVER (PARTITION BY query ORDER BY id) + coalesce(had, 0) <= 1000)
        SELECT query, id, 1 AS hop FROM h1 UNION ALL SELECT query, id, 2 FROM h2""",
    "chunk_sections": f"WITH {_BEL} SELECT query, section_id, via_chunk FROM (SELECT DISTINCT from_id AS query, to_id AS section_id, from_id AS via_chunk FROM bel WHERE from_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY query ORDER BY section_id, via_chunk) <= 25",
    "citing_judgments": "SELECT to_id AS section_id, from_id AS judgment_id, (row_number() OVER (PARTITION BY to_id ORDER BY from_id))::INT AS rank FROM (SELECT DISTINCT to_id, from_id FROM edges WHERE type = 'CITES' AND to_id IS NOT NULL AND from_id IS NOT NULL) QUALIFY rank <= 20",
    "expanded_evidence": f"""
        WITH {_BOTH}, {_BEL},
        s AS (SELECT DISTINCT from_id AS query, to_id AS id FROM bel WHERE from_id IS NOT NULL),
        n AS (SELECT DISTINCT query, b AS id FROM s JOIN both_ ON a = s.id WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.query = s.query AND x.id = b)),
        cj AS (SELECT * FROM (SELECT DISTINCT to_id, from_id FROM edges WHERE type = 'CITES' AND to_id IS NOT NULL AND from_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY to_id ORDER BY from_id) <= 20)
        SELECT query, id, 'section' AS role FROM s UNION ALL SELECT query, id, 'neighbour' FROM n UNION ALL SELECT DISTINCT query, from_id, 'judgment' FROM s JOIN cj ON to_id = s.id""",
    "enrichment_coverage": """
        WITH f AS (SELECT CASE WHEN from_label = 'Judgment' THEN from_id ELSE to_id END AS id, type FROM edges WHERE from_label = 'Judgment' OR to_label = 'Judgment'),
        j AS (SELECT DISTINCT id FROM nodes WHERE label = 'Judgment'),
        k AS (SELECT unnest(['DECIDED_BY', 'INVOLVES', 'CITES', 'CONCERNS']) AS flag),
        n AS (SELECT flag, (SELECT count(*) FROM j WHERE id IN (SELECT id FROM f WHERE type = flag)) AS n, (SELECT count(*) FROM j) AS total FROM k)
        SELECT flag, n, total, n || ' (' || coalesce(round_even(100.0 * n / nullif(total, 0), 0), 0)::INT || '%)' AS shown FROM n""",
    "key_resolvability": """
        WITH k AS (SELECT label, coalesce(len(key) > 0 AND len(list_filter(key, lambda x: x IS NULL OR x = '')) = 0, false) AS ok FROM nodes)
        SELECT label, count(*) AS n, count(*) FILTER (ok) AS n_resolvable, round(count(*) FILTER (ok) / count(*), 4) AS ratio FROM k GROUP BY label""",
}
