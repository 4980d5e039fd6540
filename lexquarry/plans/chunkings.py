"""Queries of chunking."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lexquarry.functions import text as X
from lexquarry.operators import chunking as C
from lexquarry.operators import judgments as J

#: Most courts that are looked for in captions.
MOST_COURTS = 1000


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_corpus(spark, sf_dir):
    """The chunks of all extracted documents."""
    return C.chunk_documents(_t(spark, sf_dir, "extracted_docs"))


def chunk_sizes(spark, sf_dir):
    """Chunks, parents and words by kind of chunk."""
    c = C.chunk_documents(_t(spark, sf_dir, "extracted_docs"))
    return c.groupBy("level", "is_parent").agg(F.count("*").alias("n"), F.max("tokens").alias("largest"), F.countDistinct("ord").alias("n_docs"))


def best_sections(spark, sf_dir):
    """Of each document, level and section number the longest chunk, the later one of equals."""
    c = _t(spark, sf_dir, "chunks").where("section_no is not null and doc is not null")
    return C.best_blocks(c, ["doc", "level", "section_no"], X.n_words("text"), "ord").select("doc", "level", "section_no", "ord", "size")


def judgment_metadata(spark, sf_dir):
    """What judgments' texts state of themselves; the courts are those that the corpus names."""
    docs = _t(spark, sf_dir, "extracted_docs")
    named = _t(spark, sf_dir, "nodes").where("label = 'Court' and key[0] <> ''").select(F.get("key", F.lit(0)).alias("court")).distinct().orderBy(F.desc(F.length("court")), "court").limit(MOST_COURTS + 1).collect()
    if len(named) > MOST_COURTS:
        raise ValueError(f"more than {MOST_COURTS} courts")
    courts = {r.court: r"\s+".join(map(re.escape, r.court.split())) for r in named}
    return J.judgment_metadata(docs.where(F.lower("doc_type") == "judgement"), courts=J.COURTS | courts)


def statute_sections(spark, sf_dir):
    """The sections that statutes' headings give, with part and chapter."""
    return C.document_sections(_t(spark, sf_dir, "extracted_docs").where("lower(trim(doc_type)) = 'statute'"), "statute").drop("level")


def judgment_parts(spark, sf_dir):
    """Preambles, headnotes and numbered paragraphs of judgments."""
    return C.document_sections(_t(spark, sf_dir, "extracted_docs").where("lower(trim(doc_type)) in ('judgement', 'judgment')"), "judgement").groupBy("level").agg(F.count("*").alias("n"), F.sum("words").alias("words"))


def order_chunks(spark, sf_dir):
    """Orders, each one chunk."""
    return C.chunk_documents(_t(spark, sf_dir, "extracted_docs").where("lower(trim(doc_type)) = 'order'")).select("ord", "chunk_id", "level", "tokens", "text")


def cleaned_judgments(spark, sf_dir):
    """Lines and characters of judgments' pages without page numbers, marks of downloads and running footers."""
    return C.cleaned_judgments(_t(spark, sf_dir, "extracted_docs"))


def structure_coverage(spark, sf_dir):
    """Which documents are covered by the parts made of them."""
    d = _t(spark, sf_dir, "extracted_docs").select(F.col("name").alias("doc"), X.n_words("text").alias("total")).groupBy("doc").agg(F.max("total").alias("total"))
    c = _t(spark, sf_dir, "chunks").groupBy("doc").agg(F.sum(F.greatest("tokens", F.lit(0))).alias("covered"))
    return d.join(c, "doc", "left").select("doc", "total", F.coalesce("covered", F.lit(0)).alias("covered"), (F.coalesce("covered", F.lit(0)) >= 0.3 * F.col("total")).alias("ok"))


QUERIES = {f.__name__: f for f in (chunk_corpus, chunk_sizes, best_sections, judgment_metadata, statute_sections, judgment_parts, order_chunks, cleaned_judgments, structure_coverage)}
_W = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"
_BREAKS = r"'\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_N = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"
_PAGE = f"regexp_matches({{0}}, '{X.PAGE_LINE}') OR regexp_matches({{0}}, '{X.NUMBER_LINE}')"
_SECTION = r"^(?:\d+\s*\[)?\s*(\d{1,3}[A-Z]?)\s*\.\s+([A-Z][^\n]{2,150})$"
SQL = {
    "statute_sections": rf"""
        WITH d AS (SELECT ord, string_split(regexp_replace(text, {_BREAKS}, chr(10), 'g'), chr(10)) AS s FROM extracted_docs WHERE lower(trim(doc_type)) = 'statute' AND text <> ''),
        l AS (SELECT ord, unnest(range(len(s))) AS i, {_TRIM.format("unnest(s)")} AS t FROM d),
        k AS (SELECT ord, i, t, nullif(regexp_extract(t, '(?i)^PART\s+([IVXLC\d]+)$', 1), '') AS p, nullif(regexp_extract(t, '(?i)^CHAPTER\s+([IVXLC\d]+(?:-?[A-Z])?)$', 1), '') AS c,
            nullif(regexp_extract(t, '{_SECTION}', 1), '') AS num, regexp_extract(t, '{_SECTION}', 2) AS said FROM l WHERE NOT ({_PAGE.format("t")})),
        g AS (SELECT *, count(coalesce(p, c, num)) OVER w AS block, last_value(p IGNORE NULLS) OVER w AS part, last_value(CASE WHEN p IS NOT NULL THEN '' ELSE c END IGNORE NULLS) OVER w AS chapter FROM k WINDOW w AS (PARTITION BY ord ORDER BY i)),
        h AS (SELECT *, regexp_extract(said, '^(.*?)\s*\.\s*[—–-]\s*', 0) AS head FROM g),
        b AS (SELECT ord, block, min(i) AS i, any_value(num) AS num, any_value(CASE WHEN num IS NOT NULL THEN trim(regexp_extract(said, '^(.*?)(?:\s*\.\s*[—–-]\s*|$)', 1)) END) AS title, any_value(part) AS part, any_value(nullif(chapter, '')) AS chapter,
            sum(CASE WHEN coalesce(p, c, num) IS NULL THEN {_N.format("t")} WHEN head <> '' THEN {_N.format("substr(said, length(head) + 1)")} ELSE 0 END)::INT AS words FROM h WHERE block > 0 GROUP BY ord, block)
        SELECT ord, (row_number() OVER (PARTITION BY ord ORDER BY i))::INT AS block_no, num, title, part, chapter, words FROM b WHERE num IS NOT NULL""",
    "order_chunks": rf"""
        SELECT ord, regexp_replace(coalesce(name, 'document'), '\.[^.]*$', '') || ':document:1' AS chunk_id, 'document' AS level, {_N.format("t")}::INT AS tokens, {_TRIM.format("t")} AS text
        FROM (SELECT *, coalesce(nullif(text, ''), array_to_string(pages, chr(10)), '') AS t FROM extracted_docs WHERE lower(trim(doc_type)) = 'order') WHERE {_N.format("t")} > 0""",
    "cleaned_judgments": rf"""
        WITH d AS (SELECT ord, string_split(regexp_replace(array_to_string(pages, chr(10)), {_BREAKS}, chr(10), 'g'), chr(10)) AS s FROM extracted_docs WHERE lower(trim(doc_type)) IN ('judgement', 'judgment') AND pages IS NOT NULL),
        l AS (SELECT ord, {_TRIM.format("unnest(s)")} AS t FROM d),
        k AS (SELECT ord, t, count(*) OVER (PARTITION BY ord, t) AS n FROM l WHERE t <> '' AND lower(t) <> 'pdf' AND NOT ({_PAGE.format("t")}) AND NOT regexp_matches(t, '{C.BOILERPLATE.pattern}')),
        m AS (SELECT ord, count(*) AS n, sum(length(t) + 1) - 1 AS c FROM k WHERE length(t) > 90 OR n < 3 GROUP BY ord)
        SELECT d.ord, coalesce(m.n, 0)::INT AS n_lines, coalesce(m.c, 0)::INT AS n_chars FROM d LEFT JOIN m USING (ord)""",
    "best_sections": f"SELECT doc, level, section_no, ord, {_W} AS size FROM chunks WHERE section_no IS NOT NULL AND doc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc, level, section_no ORDER BY {_W} DESC, ord DESC) = 1",
    "structure_coverage": f"""
        WITH d AS (SELECT name AS doc, max({_W}) AS total FROM extracted_docs GROUP BY name),
        c AS (SELECT doc, sum(greatest(tokens, 0)) AS covered FROM chunks GROUP BY doc)
        SELECT doc, total, coalesce(covered, 0) AS covered, coalesce(covered, 0) >= 0.3 * total AS ok FROM d LEFT JOIN c USING (doc)""",
}
