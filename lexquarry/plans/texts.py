"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions import text as X
from lexquarry.operators import profiling as P

HEX = "6ba7b8109dad11d180b400c04fd430c8"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.text_statistics(_t(spark, sf_dir, "chunks"))


def file_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "chunks").select("doc").distinct()
    return d.select("doc", X.title_from_filename("doc").alias("title"), X.friendly_name("doc").alias("friendly"), X.file_stem("doc").alias("stem"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned lines and the garbled flag of extracted documents."""
    d = _t(spark, sf_dir, "extracted_docs")
    return d.select("ord", F.size(X.clean_lines("text")).alias("n_lines"), F.size(F.filter(X.clean_lines("text"), lambda x: x != "")).alias("n_full"), X.looks_garbled("text").alias("garbled"))


def doc_type_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "extracted_docs")
    return d.select("ord", X.gazette_score("text").alias("gazette"), X.judgment_score("text").alias("judgment"), X.doc_type_of("text", "name").alias("kind"), X.doc_type_of("text", "name", False).alias("statute_kind"))


def case_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "chunks").select("ord", F.element_at("meta", "context").alias("context")).where("context is not null")
    return c.select("ord", X.case_header("context").alias("x")).select("ord", "x.court", "x.case_no", "x.parties")


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "extracted_docs").select("ord", F.col("judgement_meta.parties").alias("p")).where("p is not null")
    return d.select("ord", F.posexplode(X.split_parties("p")).alias("n", "party"))


def case_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "extracted_docs").where("judgement_meta is not null")
    return d.select("ord", X.case_context(F.col("judgement_meta.parties"), F.col("judgement_meta.court"), F.col("judgement_meta.case_nos"), F.lit(None).cast("int")).alias("context"))


def node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nodes").where("label is not null and key is not null").select("label", "key").distinct()
    return n.select("label", F.array_join("key", ":").alias("k"), X.node_id(F.col("label"), F.col("key")).alias("id"))


def amended_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "chunks").where(F.lower("doc_type") == "amendment")
    said = F.nullif(F.regexp_extract("text", X.AMENDED_SECTION, 1), F.lit(""))
    return c.select("ord", F.element_at("meta", "amends_section").alias("in_meta"), said.alias("in_text"), X.amended_section("text", "meta").alias("section"), X.lenient_int("section_no").alias("number"))


QUERIES = {f.__name__: f for f in (text_statistics, file_titles, page_lines, doc_type_ladder, case_headers, parties, case_contexts, node_ids, amended_sections)}

_W = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
_SCORE = "CASE WHEN {0} THEN {1} ELSE 0 END"


def _sum(parts: list[tuple[str, int]]) -> str:
    return " + ".join(f"(CASE WHEN coalesce({p}, false) THEN {n} ELSE 0 END)" for p, n in parts)


def _m(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


_GAZETTE = _sum([(_m("left(t,2000)", X.GAZETTE_NO), 2), (_m("left(t,2000)", X.NOTIFICATION), 1), (_m("left(t,2000)", X.GAZETTE) + " AND " + _m("left(t,2000)", X.EXTRAORDINARY), 1), (_m("left(t,2000)", X.ISSUED_AT), 1)])
_JUDGMENT = _sum(
    [(_m("left(t,800)", X.MASTHEAD), 3), (_m("left(t,1500)", X.DECIDED_ON), 2), (_m("left(t,1500)", X.JUDGE_DASH), 3), (_m("left(t,1500)", X.VERSUS), 1), (_m("left(t,1500)", X.CASE_WORDS), 1), (_m("left(t,1500)", X.ROLES), 1), (_m("left(t,4000)", X.HEADNOTE_START), 3)]
)
_LADDER = f"""WHEN contains(low, 'order') OR contains(low, 'writ') THEN 'order' WHEN {_m("t", X.AMENDS)} THEN 'amendment'
    WHEN gazette >= 2 OR {_m("t", X.RULES_CALLED)} THEN 'rules'
    WHEN {_m("t", X.PART_LINE)} OR {_m("t", X.CHAPTER_LINE)} OR len(regexp_extract_all(t, '{X.HEADING_LINE}')) >= 5 THEN 'statute' ELSE 'paragraph' END"""
_PARTS = r"list_filter(list_transform(string_split(regexp_extract(meta['context'], '\[Case:\s*(.*?)\]', 1), '|'), lambda x: trim(x)), lambda x: x <> '')"
_COURT, _NO = f"regexp_matches(x, '{X.COURT_WORDS}')", f"regexp_matches(x, '{X.CASE_NO_WORDS}')"
#: Of the segments ``s`` of a case header the places of the first court and the first number, and what they make.
HEADER_AT = f"coalesce(list_position(list_transform(s, lambda x: {_COURT} AND NOT {_NO}), true), 0) AS c_at, coalesce(list_position(list_transform(s, lambda x: {_NO}), true), 0) AS n_at"
HEADER = "CASE WHEN len(s) > 1 AND c_at > 0 THEN s[c_at] END AS court, CASE WHEN len(s) = 1 THEN s[1] WHEN n_at > 0 THEN s[n_at] END AS case_no, CASE WHEN len(s) > 1 THEN nullif(array_to_string(list_filter(s, lambda x, i: i <> c_at AND i <> n_at), ' | '), '') END AS parties"
SIDES = r"list_filter(list_transform(regexp_split_to_array({0}, '(?i)\s+(?:vs|v)\.?\s+|\s+versus\s+'), lambda x: regexp_replace(regexp_replace(x, '(?i),?\s*(?:etc\.?|&?\s*others)\s*$', ''), '^[ ,;:]+|[ ,;:]+$', '', 'g')), lambda x: x <> '')"
_PARAS = r"list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_H = f"sha1(unhex('{HEX}') || encode(CASE WHEN label = 'Chunk' THEN key[1] ELSE 'graph:' || label || ':' || array_to_string(key, ':') END))"

SQL = {
    "text_statistics": rf"""
        SELECT ord, len({_W.format("text")}) AS n_words, concat_ws(' ', nullif(section_no, ''), nullif(section_title, '')) AS heading, len({_PARAS}) AS n_paragraphs,
            coalesce(regexp_matches({_PARAS}[1], '^\(\s*\d+[a-z]?\)'), false) AS is_subsection,
            CASE WHEN length(text) <= 60 THEN replace(text, chr(10), ' ') ELSE left(replace(text, chr(10), ' '), 57) || '...' END AS short,
            length(CASE WHEN len({_W.format("text")}) > 20 THEN array_to_string({_W.format("text")}[1:20], ' ') ELSE text END) AS first_words_length
        FROM chunks""",
    "file_titles": r"""
        SELECT doc, trim(regexp_replace(regexp_replace(regexp_replace(doc, '\.[^.]*$', ''), '\([^)]*\)', '', 'g'), '[_\s]+', ' ', 'g')) AS title,
            coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(doc, '(?i)\.pdf$', ''), '_\d{6,}$', ''), '^[ _]+|[ _]+$', '', 'g'), ''), 'Document') AS friendly,
            trim(regexp_replace(doc, '\.[^.]*$', '')) AS stem
        FROM (SELECT DISTINCT doc FROM chunks)""",
    "page_lines": rf"""
        WITH d AS (SELECT ord, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '{X.PAGE_LINE}') AND NOT regexp_matches(x, '{X.NUMBER_LINE}')) AS l,
            {_W.format("text")} AS w, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS f FROM extracted_docs)
        SELECT ord, len(l) AS n_lines, len(list_filter(l, lambda x: regexp_replace(x, '\s+$', '') <> '')) AS n_full,
            CASE WHEN len(w) = 0 THEN true ELSE len(list_filter(w, lambda x: length(x) = 1)) / len(w) > 0.25 OR len(w) / greatest(f, 1) < 3 END AS garbled FROM d""",
    "doc_type_ladder": f"""
        WITH d AS (SELECT ord, coalesce(text, '') AS t, lower(coalesce(name, '')) AS low FROM extracted_docs),
        s AS (SELECT *, {_GAZETTE} AS gazette, {_JUDGMENT} AS judgment FROM d)
        SELECT ord, gazette, judgment, CASE WHEN judgment >= 4 THEN 'judgement' {_LADDER} AS kind, CASE {_LADDER} AS statute_kind FROM s""",
    "case_headers": f"""
        WITH p AS (SELECT ord, {_PARTS} AS s FROM chunks WHERE meta['context'] IS NOT NULL),
        x AS (SELECT *, {HEADER_AT} FROM p)
        SELECT ord, {HEADER} FROM x""",
    "parties": rf"""
        WITH p AS (SELECT ord, {SIDES.format("judgement_meta.parties")} AS s FROM extracted_docs WHERE judgement_meta.parties IS NOT NULL)
        SELECT ord, (unnest(range(len(s))))::INT AS n, unnest(s) AS party FROM p""",
    "case_contexts": """
        WITH d AS (SELECT ord, concat_ws(' | ', nullif(judgement_meta.parties, ''), nullif(judgement_meta.court, ''), nullif(array_to_string(judgement_meta.case_nos[1:3], '; '), '')) AS i
            FROM extracted_docs WHERE judgement_meta IS NOT NULL)
        SELECT ord, left(CASE WHEN i <> '' THEN '[Case: ' || i || ']' ELSE '' END, 250) AS context FROM d""",
    "node_ids": f"""
        WITH h AS (SELECT label, array_to_string(key, ':') AS k, {_H} AS h FROM (SELECT DISTINCT label, key FROM nodes WHERE label IS NOT NULL AND key IS NOT NULL))
        SELECT label, k, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8','9','a','b'][(('0x' || h[17:17])::INT % 4) + 1] || h[18:20] || '-' || h[21:32] AS id FROM h""",
    "amended_sections": rf"""
        SELECT ord, meta['amends_section'] AS in_meta, nullif(regexp_extract(text, '{X.AMENDED_SECTION}', 1), '') AS in_text,
            coalesce(nullif(meta['amends_section'], ''), nullif(regexp_extract(text, '{X.AMENDED_SECTION}', 1), '')) AS section,
            try_cast(trunc(try_cast(section_no AS DOUBLE)) AS INT) AS number
        FROM chunks WHERE lower(doc_type) = 'amendment'""",
}
