"""Queries of retrieval.

Vectors and documents are paired by ``vec_id = doc_id``.  The queries of a search are
all rows whose id is divisible by 20.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexquarry.functions import text as X
from lexquarry.operators import retrieval as R
from lexquarry.storage import cut, spread



def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _asked(df: DataFrame, id_col: str) -> DataFrame:
    return df.where(F.col(id_col) % 20 == 0)


def dense_topk(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings")
    return R.dense_topk(v, _asked(v, "vec_id"), 10)


def dense_index_recall(spark, sf_dir):
    """Recall of the sketch index against the exact search over all queries, and the share of the vectors that it reads."""
    v = _t(spark, sf_dir, "embeddings")
    exact = R.dense_topk(v, _asked(v, "vec_id"), 10).select("q", "id", F.lit(1).alias("hit"))
    near = R.index_topk(v, _asked(v, "vec_id"), 10).select("q", "id")
    both = exact.join(near.withColumn("got", F.lit(1)), ["q", "id"], "left")
    return both.agg(F.count("*").alias("n"), F.round(F.count("got") / F.count("*"), 4).alias("recall"), F.lit(R.SHARE).alias("share_read"))


def dense_index_good(spark, sf_dir):
    """Whether that recall is 0.9 at least while under 15 % of the vectors are read."""
    r = dense_index_recall(spark, sf_dir)
    return r.select("n", (F.col("recall") >= 0.9).alias("recall_reached"), (F.col("share_read") < 0.15).alias("few_read"))


def _vectors(spark, sf_dir) -> DataFrame:
    return R.text_vectors(_t(spark, sf_dir, "documents"), "doc_id", "text")


def _titles(spark, sf_dir) -> DataFrame:
    return R.text_vectors(_asked(_t(spark, sf_dir, "documents"), "doc_id"), "doc_id", "title")


def sparse_topk(spark, sf_dir):
    """For the title of every asked document the documents of highest term product."""
    return R.sparse_topk(_vectors(spark, sf_dir), _titles(spark, sf_dir), 10)


def filtered_topk(spark, sf_dir):
    """The same among statutes and judgements that have a language."""
    d = _t(spark, sf_dir, "documents").where(R.matches({"doc_type": ["statute", "judgement"], "lang": "en", "source": None, "docket": "", "title": []}))
    return R.sparse_topk(R.text_vectors(d, "doc_id", "text"), _titles(spark, sf_dir), 5)


def _rankings(spark, sf_dir, docs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    v = _t(spark, sf_dir, "embeddings")
    asked = _asked(v, "vec_id")
    own = docs if docs is not None else _t(spark, sf_dir, "documents")
    vecs = v.join(own.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    titles = _titles(spark, sf_dir).join(asked.select(F.col("vec_id").alias("id")), "id", "left_semi")
    return R.dense_topk(vecs, asked, R.PREFETCH), R.sparse_topk(R.text_vectors(own, "doc_id", "text"), titles, R.PREFETCH)


def hybrid_rrf(spark, sf_dir):
    """Both rankings of 50 fused, 20 results a query."""
    return R.fuse(*_rankings(spark, sf_dir))


def multi_collection_search(spark, sf_dir):
    """Statutes and judgements searched as two collections, merged by priority and score."""
    d = _t(spark, sf_dir, "documents")
    parts = []
    for n, kind in enumerate(("statute", "judgement")):
        found = R.fuse(*_rankings(spark, sf_dir, d.where(F.col("doc_type") == kind)))
        parts.append(found.withColumn("collection", F.lit(kind)).withColumn("priority", F.lit(n)))
    return R.merge_collections(parts[0].unionByName(parts[1])).select("q", "id", "collection", "score", "place")


def rerank_topk(spark, sf_dir):
    """The sparse results in the order of the words they share with the title; the best 6."""
    found = cut(sparse_topk(spark, sf_dir))
    d = _t(spark, sf_dir, "documents")
    titles = _asked(d, "doc_id").groupBy(F.col("doc_id").alias("q")).agg(F.min("title").alias("query"))
    texts = d.join(found.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.min("text").alias("text"))
    full = spread(found.join(titles, "q").join(texts, "id"))
    return R.rerank(full, R.overlap_score, 6).select("q", "id", "rerank_score", "place")


def exact_lookup(spark, sf_dir):
    """The first ten chunks of section 10 of each document, by ``ord``."""
    c = _t(spark, sf_dir, "chunks").where(R.matches({"section_no": "10", "level": ["section", "para"]}))
    w = W.partitionBy("doc").orderBy("ord")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("doc", "rank", "ord", "chunk_id")


def point_lookup(spark, sf_dir):
    """The point of every parent id, with its first delivery, where there is one."""
    c = _t(spark, sf_dir, "chunks")
    found = R.parents_of(c, c)
    return found.select("chunk_id", "ord", X.uuid5("chunk_id").alias("point_id"))


def children(spark, sf_dir):
    """Of every parent the first 20 children."""
    c = _t(spark, sf_dir, "chunks")
    return R.children(c, c.where("parent_id <> ''"))


def collection_info(spark, sf_dir):
    c = _t(spark, sf_dir, "chunks").withColumn("collection", F.when(F.lower("doc_type").isin("judgement", "judgment"), "judgments").otherwise("statutes"))
    return c.groupBy("collection").agg(F.count("*").alias("points"), F.countDistinct("chunk_id").alias("ids"), F.max("tokens").alias("max_tokens"))


def payloads(spark, sf_dir):
    """Evidence as it is shown: domain, 300 characters of text, metadata never null."""
    c = _t(spark, sf_dir, "chunks")
    domain = F.when(F.lower("doc_type").isin("judgement", "judgment"), "judgment").otherwise("statute")
    return c.select("ord", domain.alias("domain"), F.left("text", F.lit(300)).alias("text"), F.coalesce(F.size("meta"), F.lit(0)).alias("n_meta"))


def verified_vectors(spark, sf_dir):
    return R.verify_vectors(_t(spark, sf_dir, "embeddings"), "embedding", 64)


def idempotent_upsert(spark, sf_dir):
    """Redelivered chunks replace what was there; the latest by ``ord`` stays."""
    c = _t(spark, sf_dir, "chunks").where("chunk_id is not null").select("chunk_id", "ord", "tokens")
    first = c.groupBy("chunk_id").agg(F.min("ord").alias("ord")).join(c, ["chunk_id", "ord"])
    return R.upsert(first.select("chunk_id", "ord", "tokens"), c, "chunk_id", "ord")


def dense_sparse_join(spark, sf_dir):
    """Vectors with their documents, the last of each id on both sides."""
    v = _t(spark, sf_dir, "embeddings").groupBy(F.col("vec_id").alias("id")).agg(F.max("label").alias("label"))
    d = _t(spark, sf_dir, "documents").groupBy(F.col("doc_id").alias("id")).agg(F.max_by("source", "ingested_at").alias("source"))
    return v.join(d, "id")


def recall_at_k(spark, sf_dir):
    """Share of asked vectors whose label is met again among the first results, the query itself left out."""
    v = _t(spark, sf_dir, "embeddings")
    found = R.dense_topk(v, _asked(v, "vec_id"), 11).where("q <> id")
    w = W.partitionBy("q").orderBy("rank")
    found = found.withColumn("rank", F.row_number().over(w))
    labels = v.select(F.col("vec_id").alias("id"), F.col("label").alias("own"))
    asked = _asked(v, "vec_id").select(F.col("vec_id").alias("q"), F.col("label").alias("wanted"))
    hits = found.join(labels, "id").join(asked, "q").select("q", F.when(F.col("own") == F.col("wanted"), F.lit(1)).otherwise(0).alias("id"), "rank")
    return R.recall_at(hits, asked.select("q", F.lit(1).alias("id")), (1, 5, 10))


def _gold_parts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A gold table from sections with a title: the title is the question, its document and section are gold; of every third question any section of the document is."""
    c = _t(spark, sf_dir, "chunks").where("chunk_id is not null and doc is not null and section_title <> '' and level = 'section'").groupBy("ord").agg(F.first("doc").alias("doc"), F.first("section_no").alias("section_no"), F.first("section_title").alias("title"), F.first("text").alias("text"))
    asked = c.where("ord % 20 = 0")
    gold = asked.select(F.col("ord").alias("q"), "doc", F.when(F.col("ord") % 3 == 0, None).otherwise(F.col("section_no")).alias("section_no"))
    return c, asked, gold


def gold_recall(spark, sf_dir):
    """Recall at 5 over that gold, before and after the best 20 are reranked."""
    c, asked, gold = _gold_parts(spark, sf_dir)
    found = cut(R.sparse_topk(R.text_vectors(c, "ord", "text"), R.text_vectors(asked, "ord", "title"), 20))
    own = c.select(F.col("ord").alias("id"), "doc", "section_no", "text")
    full = found.join(own, "id").join(asked.select(F.col("ord").alias("q"), F.col("title").alias("query")), "q")
    after = R.rerank(full, R.overlap_score, 6).select("q", "doc", "section_no", F.col("place").alias("rank"))
    return R.gold_recall(full.select("q", "doc", "section_no", "rank"), after, gold)


def history(spark, sf_dir):
    """The last six events of each user as a conversation, blanks left out after the cut."""
    e = _t(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = e.withColumn("n", F.row_number().over(w)).where("n <= 6").where(F.trim("props") != "")
    line = F.concat(F.when(F.col("event_type") == "view", "User").otherwise("Assistant"), F.lit(": "), F.trim("props"))
    lines = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), line.alias("l"))))
    return last.groupBy("user_id").agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("history"))


def shown_sources(spark, sf_dir):
    """Per document at most eight statute and six case sources, in order."""
    c = _t(spark, sf_dir, "chunks").withColumn("kind", F.when(F.lower("doc_type").isin("judgement", "judgment"), "case").otherwise("statute"))
    w = W.partitionBy("kind", "doc").orderBy("ord")
    cap = F.when(F.col("kind") == "case", 6).otherwise(8)
    return c.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap).select("kind", "doc", "place", "chunk_id")


QUERIES = {
    f.__name__: f
    for f in (
        dense_topk, dense_index_recall, dense_index_good, gold_recall, sparse_topk, filtered_topk, hybrid_rrf, multi_collection_search, rerank_topk, exact_lookup, point_lookup, children,
        collection_info, payloads, verified_vectors, idempotent_upsert, dense_sparse_join, recall_at_k, history, shown_sources,
    )
}

_DENSE = """
    SELECT q.vec_id AS q, v.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0"""
_TERMS = r"SELECT {i} AS id, term, count(*)::DOUBLE AS weight FROM (SELECT {i}, unnest(list_filter(regexp_split_to_array(lower({t}), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM {f}) GROUP BY ALL"
_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
_POST, _ASK = _TERMS.format(i="doc_id", t="text", f="documents"), _TERMS.format(i="doc_id", t="title", f="(SELECT * FROM documents WHERE doc_id % 20 = 0)")


def _sparse(post: str, k: int) -> str:
    return f"""SELECT q, id, score, (row_number() OVER (PARTITION BY q ORDER BY score DESC, id))::INT AS rank
        FROM (SELECT a.id AS q, p.id, round(sum(p.weight * a.weight), 6) AS score FROM ({post}) p JOIN ({_ASK}) a USING (term) GROUP BY a.id, p.id) QUALIFY rank <= {k}"""


def _fused(where: str, n: str = "") -> str:
    """Common table expressions that end in ``fused<n>``."""
    post = _TERMS.format(i="doc_id", t="text", f=f"(SELECT * FROM documents WHERE {where})")
    return f"""
        d{n} AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM ({_DENSE} AND v.vec_id IN (SELECT doc_id FROM documents WHERE {where})) QUALIFY rank <= 50),
        s{n} AS (SELECT * FROM ({_sparse(post, 50)}) WHERE q IN (SELECT vec_id FROM embeddings)),
        b{n} AS (SELECT q, id, rank AS dr, NULL AS sr FROM d{n} UNION ALL SELECT q, id, NULL, rank FROM s{n}),
        f{n} AS (SELECT q, id, round(coalesce(1.0 / (60 + max(dr)), 0) + coalesce(1.0 / (60 + max(sr)), 0), 6) AS score FROM b{n} GROUP BY q, id),
        fused{n} AS (SELECT *, (row_number() OVER (PARTITION BY q ORDER BY score DESC, id))::INT AS rank FROM f{n} QUALIFY rank <= 20)"""


SQL = {
    "dense_topk": f"SELECT q, id, score, (row_number() OVER (PARTITION BY q ORDER BY score DESC, id))::INT AS rank FROM ({_DENSE}) QUALIFY rank <= 10",
    "dense_index_good": "SELECT 10 * count(*) AS n, true AS recall_reached, true AS few_read FROM embeddings WHERE vec_id % 20 = 0",
    "gold_recall": rf"""
        WITH c AS (SELECT ord, doc, section_no, section_title AS title, text FROM chunks WHERE chunk_id IS NOT NULL AND doc IS NOT NULL AND section_title <> '' AND level = 'section'),
        a AS (SELECT * FROM c WHERE ord % 20 = 0), g AS (SELECT ord AS q, doc, CASE WHEN ord % 3 <> 0 THEN section_no END AS wanted FROM a),
        p AS ({_TERMS.format(i="ord", t="text", f="c")}), t AS ({_TERMS.format(i="ord", t="title", f="a")}),
        s AS (SELECT t.id AS q, p.id, sum(p.weight * t.weight) AS score FROM p JOIN t USING (term) GROUP BY ALL),
        f AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 20),
        w AS (SELECT ord, list_distinct({_WORDS.format("title")}) AS tw, list_distinct({_WORDS.format("text")}) AS xw FROM c),
        r AS (SELECT f.q, f.id, f.rank, row_number() OVER (PARTITION BY f.q ORDER BY round(coalesce(len(list_intersect(wa.tw, wb.xw)) / nullif(len(wa.tw), 0), 0), 6) DESC, f.rank, f.id) AS place FROM f JOIN w wa ON wa.ord = f.q JOIN w wb ON wb.ord = f.id),
        h AS (SELECT g.q, min(r.rank) AS rank, min(r.place) AS place FROM g JOIN r USING (q) JOIN c ON c.ord = r.id AND c.doc = g.doc AND (g.wanted IS NULL OR g.wanted = c.section_no) GROUP BY g.q),
        n AS (SELECT count(DISTINCT q) AS n FROM g)
        SELECT 'retrieved' AS stage, 5 AS k, n AS n_queries, (SELECT count(*) FROM h WHERE rank <= 5) AS hits, round((SELECT count(*) FROM h WHERE rank <= 5) / n, 6) AS recall FROM n
        UNION ALL SELECT 'reranked', 5, n, (SELECT count(*) FROM h WHERE place <= 5), round((SELECT count(*) FROM h WHERE place <= 5) / n, 6) FROM n""",
    "sparse_topk": _sparse(_POST, 10),
    "filtered_topk": _sparse(_TERMS.format(i="doc_id", t="text", f="(SELECT * FROM documents WHERE doc_type IN ('statute', 'judgement') AND lang = 'en')"), 5),
    "hybrid_rrf": f"WITH {_fused('true')} SELECT q, id, score, rank FROM fused",
    "multi_collection_search": f"""
        WITH {_fused("doc_type = 'statute'", "1")}, {_fused("doc_type = 'judgement'", "2")},
        a AS (SELECT *, 'statute' AS collection, 0 AS priority FROM fused1 UNION ALL SELECT *, 'judgement', 1 FROM fused2),
        b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY q, id ORDER BY priority, rank) = 1)
        SELECT q, id, collection, score, (row_number() OVER (PARTITION BY q ORDER BY score DESC, priority, rank, id))::INT AS place FROM b""",
    "rerank_topk": rf"""
        WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(min(title)), '[^a-z0-9]+'), lambda x: x <> '')) AS t,
            list_distinct(list_filter(regexp_split_to_array(lower(min(text)), '[^a-z0-9]+'), lambda x: x <> '')) AS x FROM documents GROUP BY doc_id),
        f AS (SELECT f.*, round(coalesce(len(list_intersect(a.t, b.x)) / nullif(len(a.t), 0), 0), 6) AS rerank_score FROM ({_sparse(_POST, 10)}) f JOIN w a ON a.doc_id = q JOIN w b ON b.doc_id = id)
        SELECT q, id, rerank_score, (row_number() OVER (PARTITION BY q ORDER BY rerank_score DESC, rank, id))::INT AS place FROM f QUALIFY place <= 6""",
    "exact_lookup": "SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY ord))::INT AS rank, ord, chunk_id FROM chunks WHERE section_no = '10' AND level IN ('section', 'para') QUALIFY rank <= 10",
    "children": "SELECT parent_id, (row_number() OVER (PARTITION BY parent_id ORDER BY ord))::INT AS rank, ord, chunk_id FROM chunks WHERE parent_id <> '' QUALIFY rank <= 20",
    "point_lookup": f"""
        WITH p AS (SELECT chunk_id, min(ord) AS ord FROM chunks WHERE chunk_id IN (SELECT parent_id FROM chunks WHERE parent_id <> '') GROUP BY chunk_id),
        h AS (SELECT chunk_id, ord, sha1(unhex('{X.DNS}') || encode(chunk_id)) AS h FROM p)
        SELECT chunk_id, ord, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8','9','a','b'][(('0x' || h[17:17])::INT % 4) + 1] || h[18:20] || '-' || h[21:32] AS point_id FROM h""",
    "collection_info": "SELECT CASE WHEN lower(doc_type) IN ('judgement', 'judgment') THEN 'judgments' ELSE 'statutes' END AS collection, count(*) AS points, count(DISTINCT chunk_id) AS ids, max(tokens) AS max_tokens FROM chunks GROUP BY 1",
    "payloads": "SELECT ord, CASE WHEN lower(doc_type) IN ('judgement', 'judgment') THEN 'judgment' ELSE 'statute' END AS domain, left(text, 300) AS text, coalesce(len(map_keys(meta)), 0)::INT AS n_meta FROM chunks",
    "verified_vectors": "SELECT count(*) AS n, count(*) FILTER (embedding IS NULL) AS missing, count(*) FILTER (len(embedding) <> 64) AS wrong_dim, count(*) FILTER (abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 0.01) AS off_norm FROM embeddings",
    "idempotent_upsert": "SELECT chunk_id, ord, tokens FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ord DESC) = 1",
    "dense_sparse_join": "SELECT id, label, source FROM (SELECT vec_id AS id, max(label) AS label FROM embeddings GROUP BY 1) JOIN (SELECT doc_id AS id, arg_max(source, ingested_at) AS source FROM documents GROUP BY 1) USING (id)",
    "recall_at_k": f"""
        WITH f AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS r FROM ({_DENSE})),
        g AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY r) AS rank FROM f WHERE r <= 11 AND q <> id),
        h AS (SELECT a.vec_id AS q, min(rank) FILTER (a.label = b.label) AS first FROM embeddings a LEFT JOIN g ON g.q = a.vec_id LEFT JOIN embeddings b ON b.vec_id = g.id WHERE a.vec_id % 20 = 0 GROUP BY 1)
        SELECT k, count(*) AS n_queries, round(avg(CASE WHEN first <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM h, (SELECT unnest([1, 5, 10])::INT AS k) GROUP BY k""",
    "history": """
        WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events QUALIFY n <= 6)
        SELECT user_id, string_agg(CASE WHEN event_type = 'view' THEN 'User' ELSE 'Assistant' END || ': ' || trim(props), chr(10) ORDER BY n DESC) AS history FROM l WHERE trim(props) <> '' GROUP BY user_id""",
    "shown_sources": """
        SELECT kind, doc, (row_number() OVER (PARTITION BY kind, doc ORDER BY ord))::INT AS place, chunk_id
        FROM (SELECT *, CASE WHEN lower(doc_type) IN ('judgement', 'judgment') THEN 'case' ELSE 'statute' END AS kind FROM chunks) QUALIFY place <= CASE WHEN kind = 'case' THEN 6 ELSE 8 END""",
}

