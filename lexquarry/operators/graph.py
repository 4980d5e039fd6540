"""A property graph from chunk tables: extraction, assembly, loading and traversal.

Nodes are ``(id, label, key, props, tier, source_file, chunk_ids)``, edges
``(type, from_label, from_id, from_key, to_label, to_id, to_key, tier, source, chunk_ids)``.
Every step is a projection, join or aggregate over whole tables; what can't be
linked goes into a table of reasons.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from lexquarry.functions import text as X
from lexquarry.storage import cut

#: Kinds of nodes with their key columns, and kinds of edges with their ends.
NODE_KEYS = {
    "Act": ["name"], "Part": ["act", "name"], "Chapter": ["act", "name"], "Section": ["act", "section_no"], "Chunk": ["chunk_id"],
    "Judgment": ["case_no"], "Court": ["name"], "Party": ["name"], "Offence": ["name"],
}
EDGE_TYPES = ["CONTAINS", "PARENT_OF", "BELONGS_TO", "AMENDED_BY", "REFERENCES", "CITES", "DECIDED_BY", "INVOLVES", "CONCERNS"]
#: Properties of nodes beside their keys, and the kinds of the ends of edges.
NODE_PROPERTIES = {
    "Act": ["doc", "doc_type"], "Section": ["title", "chunk_id", "text"], "Chunk": ["doc", "level", "section_no", "parent_id", "collection", "point_id"], "Judgment": ["doc", "court", "parties", "outcome", "date"],
}
EDGE_ENDS = {
    "CONTAINS": [("Act", "Section"), ("Act", "Part"), ("Part", "Section"), ("Act", "Chapter"), ("Chapter", "Section")], "PARENT_OF": [("Chunk", "Chunk")], "BELONGS_TO": [("Chunk", "Section")], "AMENDED_BY": [("Section", "Act")],
    "REFERENCES": [("Section", "Section"), ("Section", "Act")], "CITES": [("Judgment", "Section")], "DECIDED_BY": [("Judgment", "Court")], "INVOLVES": [("Judgment", "Party")], "CONCERNS": [("Judgment", "Offence")],
}
#: Kinds of documents whose sections become nodes.
STATUTES = ("statute", "rules", "amendment", "order")
SOURCES = {
    "act_section": "hierarchy:act->section", "number": "chunk.section_no", "act_part": "hierarchy:act->part", "part_section": "hierarchy:part->section",
    "act_chapter": "hierarchy:act->chapter", "chapter_section": "hierarchy:chapter->section", "parent": "parent_id", "amendment": "amendment meta/text",
    "reference": "regex cross-ref", "reference_act": "regex cross-ref(act)", "header": "case header",
}


#: Most canonical names of acts: they are collected or sent to every executor.
MOST_ACTS = 20_000


def _props(**cols: Column) -> Column:
    """A map of the properties that are neither null nor empty."""
    m = F.create_map(*(x for k, v in cols.items() for x in (F.lit(k), v.cast("string"))))
    return F.map_filter(m, lambda _, v: v.isNotNull() & (v != ""))


def _key(*parts: Column) -> Column:
    """An array of the parts, null if one is null or empty."""
    return F.when(reduce(Column.__and__, [F.coalesce(p != "", F.lit(False)) for p in parts]), F.array(*parts))


def _node(label: str, key: Column, props: Column) -> Column:
    return F.when(key.isNotNull(), F.struct(F.lit(label).alias("label"), key.alias("key"), props.alias("props")))


def _nodes(rows: DataFrame, nodes: list[Column]) -> DataFrame:
    """Node rows of every row, in one pass; nodes without a whole key are left out."""
    each = rows.select(F.explode(F.array_compact(F.array(*nodes))).alias("n"), F.lit("0").alias("tier"), F.col("doc").alias("source_file"), "chunk_id", "ord")
    return each.select("n.label", "n.key", "n.props", "tier", "source_file", "chunk_id", "ord")


def _edge(kind: str, a: tuple[str, Column], b: tuple[str, Column], source: str) -> Column:
    ends = F.struct(F.lit(kind).alias("type"), F.lit(a[0]).alias("from_label"), a[1].alias("from_key"), F.lit(b[0]).alias("to_label"), b[1].alias("to_key"), F.lit(SOURCES[source]).alias("source"))
    return F.when(a[1].isNotNull() & b[1].isNotNull(), ends)


def _edges(rows: DataFrame, edges: list[Column], tier: str = "0") -> DataFrame:
    """Edge rows of every row, in one pass; edges of which an end has no whole key are left out."""
    each = rows.select(F.explode(F.array_compact(F.array(*edges))).alias("e"), F.lit(tier).alias("tier"), "chunk_id")
    return each.select("e.type", "e.from_label", "e.from_key", "e.to_label", "e.to_key", "tier", "e.source", "chunk_id")


def merge_nodes(rows: DataFrame) -> DataFrame:
    """One row per label and key: of each property the first value by ``ord``, of tier and source the first row's, and how many chunks name it.

    Properties are merged one by one with partial aggregates, so a node that a third
    of all rows mention is reduced in the map tasks.  The chunks themselves are the
    relation ``mentions``: as an array the chunks of a hot node would be one value.
    """
    key = ["label", "key"]
    rows = cut(rows)  # read three times
    heads = rows.groupBy(*key).agg(F.min_by(F.struct("tier", "source_file"), F.col("ord")).alias("h"))
    props = rows.select(*key, "ord", F.explode("props").alias("k", "v")).groupBy(*key, "k").agg(F.min_by("v", "ord").alias("v"))
    props = props.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    counts = rows.where("chunk_id is not null").groupBy(*key, "chunk_id").agg(F.lit(1).alias("one")).groupBy(*key).agg(F.count("*").alias("n_chunks"))
    nodes = heads.join(props, key, "left").join(counts, key, "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return nodes.select(X.node_id(F.col("label"), F.col("key")).alias("id"), "label", "key", F.coalesce("props", none).alias("props"), "h.tier", "h.source_file", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def mentions(rows: DataFrame) -> DataFrame:
    """``(id, chunk_id)``: the chunks that name each node of node rows."""
    return rows.where("chunk_id is not null").select(X.node_id(F.col("label"), F.col("key")).alias("id"), "chunk_id").distinct()


def chunk_ids(of: DataFrame, related: DataFrame) -> DataFrame:
    """``(id, chunk_ids)`` of the nodes ``of (id)``, a question's few, as sorted arrays."""
    return related.join(of.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))


def merge_edges(rows: DataFrame) -> DataFrame:
    """One row per type, ends and source, with the number of chunks that give it."""
    key = ["type", "from_label", "from_key", "to_label", "to_key", "source"]
    each = rows.groupBy(*key, "chunk_id").agg(F.min("tier").alias("tier"))
    return each.groupBy(*key).agg(F.min("tier").alias("tier"), F.count("chunk_id").alias("n_chunks")).select(
        "type", "from_label", X.node_id(F.col("from_label"), F.col("from_key")).alias("from_id"), "from_key", "to_label", X.node_id(F.col("to_label"), F.col("to_key")).alias("to_id"), "to_key", "tier", "source", "n_chunks"
    )


def first_deliveries(chunks: DataFrame) -> DataFrame:
    """One row per chunk id, the first by ``ord``; a null id is no chunk."""
    w = W.partitionBy("chunk_id").orderBy("ord")
    return chunks.where("chunk_id is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def with_act(chunks: DataFrame, catalog: DataFrame | None = None, name_col: str = "act_name") -> DataFrame:
    """``chunks`` with ``act``, the one key under which a file's act is known in the whole graph.

    It is the canonical name in ``catalog`` that the file's name says, both brought to
    plain words, else the file's stem.  The catalogue is broadcast; its size is checked.
    """
    if catalog is None:
        return chunks.withColumn("act", X.act_name("doc"))
    names = catalog.where(F.col(name_col) != "").groupBy(X.plain_title(name_col).alias("_plain")).agg(F.min(name_col).alias("_canonical"))
    if names.count() > MOST_ACTS:
        raise ValueError(f"more than {MOST_ACTS} canonical names")
    rows = chunks.withColumn("_plain", X.plain_title("doc")).join(F.broadcast(names), "_plain", "left")
    return rows.withColumn("act", F.coalesce("_canonical", X.act_name("doc"))).drop("_plain", "_canonical")


def act_aliases(catalog: DataFrame, name_col: str = "act_name") -> dict[str, str]:
    """Canonical names by their lower case, as they are looked for in texts."""
    names = [r[0] for r in catalog.where(F.col(name_col) != "").select(name_col).distinct().orderBy(name_col).limit(MOST_ACTS + 1).collect()]
    if len(names) > MOST_ACTS:
        raise ValueError(f"more than {MOST_ACTS} canonical names")
    return {n.lower(): n for n in names}


def is_section() -> Column:
    return F.coalesce((F.col("level") == "section") & F.lower("doc_type").isin(*STATUTES) & (F.col("section_no") != ""), F.lit(False))


def is_judgment() -> Column:
    return F.lower("doc_type").isin("judgement", "judgment")


def _chunk_node(collection: str) -> Column:
    c = F.col
    return _node("Chunk", _key(c("chunk_id")), _props(chunk_id=c("chunk_id"), doc=c("doc"), level=c("level"), section_no=c("section_no"), parent_id=c("parent_id"), collection=F.lit(collection)))


def _parents(rows: DataFrame) -> DataFrame:
    """Rows with a parent; ``_ok`` if it came before."""
    up = rows.select(F.col("chunk_id").alias("parent_id"), F.col("ord").alias("_pord"))
    return rows.where("parent_id <> ''").join(up, "parent_id", "left").withColumn("_ok", F.coalesce(F.col("_pord") < F.col("ord"), F.lit(False)))


def _parent_edges(up: DataFrame) -> DataFrame:
    return _edges(up.where("_ok"), [_edge("PARENT_OF", ("Chunk", _key(F.col("parent_id"))), ("Chunk", _key(F.col("chunk_id"))), "parent")])


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def statute_graph(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Node rows, edge rows and reasons of the statutes' hierarchy; ``chunks`` has one row per id and its ``act`` (``with_act``)."""
    c = F.col
    laws = chunks.where(F.lower("doc_type").isin(*STATUTES))
    named = laws.where("act <> ''")
    within = F.when(is_section(), c("act"))  # null outside sections, so that no key is whole
    act, section, part, chapter = _key(c("act")), _key(within, c("section_no")), _key(within, c("part")), _key(within, c("chapter"))
    text = {"text": c("text")} if "text" in chunks.columns else {}
    nodes = _nodes(named, [
        _node("Act", act, _props(name=c("act"), doc=c("doc"), doc_type=F.lower("doc_type"))), _chunk_node("statutes"),
        _node("Section", section, _props(act=c("act"), section_no=c("section_no"), title=c("section_title"), chunk_id=c("chunk_id"), **text)),
        _node("Part", part, _props(act=c("act"), name=c("part"))), _node("Chapter", chapter, _props(act=c("act"), name=c("chapter"))),
    ])
    one, sec, chunk = ("Act", act), ("Section", section), ("Chunk", _key(c("chunk_id")))
    edges = _edges(named, [
        _edge("CONTAINS", one, sec, "act_section"), _edge("BELONGS_TO", chunk, sec, "number"), _edge("CONTAINS", one, ("Part", part), "act_part"), _edge("CONTAINS", ("Part", part), sec, "part_section"),
        _edge("CONTAINS", one, ("Chapter", chapter), "act_chapter"), _edge("CONTAINS", ("Chapter", chapter), sec, "chapter_section"),
    ])
    # a later chunk belongs to a section that was seen before it
    first = first_sections(named)
    others = named.where(~is_section() & (c("section_no") != "")).join(first, ["act", "section_no"], "left").withColumn("_ok", F.coalesce(c("_first") < c("ord"), F.lit(False)))
    more = _edges(others.where("_ok"), [_edge("BELONGS_TO", chunk, ("Section", _key(c("act"), c("section_no"))), "number")])
    up = _parents(named)
    reasons = [
        laws.where("act is null or act = ''").select(F.lit("no_act_name").alias("reason"), "ord"),
        others.where("not _ok").select(F.lit("belongs_to_no_section_node").alias("reason"), "ord"),
        up.where("not _ok").select(F.lit("parent_not_in_graph").alias("reason"), "ord"),
    ]
    return nodes, _union([edges, more, _parent_edges(up)]), _union(reasons)


def first_sections(chunks: DataFrame) -> DataFrame:
    """``(act, section_no, _first)``: the sections of the graph and where each is first seen."""
    return chunks.where(is_section() & (F.col("act") != "")).groupBy("act", "section_no").agg(F.min("ord").alias("_first"))


def amendments(chunks: DataFrame, sections: DataFrame, aliases: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """``AMENDED_BY`` edges and reasons; ``chunks`` has its ``act`` and text, ``sections`` are those of ``first_sections``.

    The amended section is named by the chunk's metadata, else by its text; the
    amended act is the longest of ``aliases`` in the text.  The section must have been
    seen before.
    """
    c = F.col
    rows = chunks.where((F.lower("doc_type") == "amendment") & (c("act") != "")).select("ord", "chunk_id", "doc", "act", X.amended_section("text", "meta").alias("said"), alias_ladder(c("text"), aliases).alias("amended"))
    there = sections.select(c("act").alias("amended"), c("section_no").alias("said"), "_first")
    rows = rows.join(there, ["amended", "said"], "left")
    reason = F.when(c("said").isNull(), "amendment_no_section").when(c("amended").isNull(), "amendment_no_act").when(~F.coalesce(c("_first") < c("ord"), F.lit(False)), "amendment_section_not_in_graph")
    rows = rows.withColumn("reason", reason)
    edge = _edge("AMENDED_BY", ("Section", _key(c("amended"), c("said"))), ("Act", _key(c("act"))), "amendment")
    return _edges(rows.where("reason is null"), [edge]), rows.where("reason is not null").select("reason", "ord")


def judgment_graph(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Node rows, edge rows and reasons of judgments, their courts and parties.

    A document's header is that of its preamble, else of its first chunk; without a
    case number the file's stem stands in.  Documents of one case number are one
    judgment; the last disposition by ``ord`` is its outcome.  Courts, parties and
    judgments named by the file are named by all chunks of the document; the edges by
    its first.
    """
    c = F.col
    rows = chunks.where(is_judgment()).withColumn("context", F.coalesce(F.element_at("meta", "context"), F.lit("")))
    said = F.element_at("meta", "disposition")
    first = rows.groupBy("doc").agg(
        F.min_by(F.struct("context", "chunk_id", "ord"), F.struct(F.when(c("level") == "preamble", 0).otherwise(1), c("ord"))).alias("h"), F.min_by("chunk_id", "ord").alias("first_chunk"),
        F.max_by(said, F.when(said != "", c("ord"))).alias("outcome"), F.max(F.when(said != "", c("ord"))).alias("said_at"),
    )
    head = first.select("doc", "first_chunk", "h.chunk_id", "h.ord", "outcome", "said_at", X.case_header(c("h.context")).alias("x"))
    head = head.select("doc", "first_chunk", "chunk_id", "ord", "outcome", "said_at", "x.court", "x.parties", c("x.case_no").alias("own_no"), F.coalesce("x.case_no", F.nullif(X.file_stem("doc"), F.lit(""))).alias("case_no"))
    last = head.groupBy("case_no").agg(F.max_by("outcome", "said_at").alias("last"))
    head = cut(head.join(last, "case_no").withColumn("party", X.split_parties("parties")))
    judgment = ("Judgment", _key(c("case_no")))
    case = _node("Judgment", judgment[1], _props(case_no=c("case_no"), doc=c("doc"), court=c("court"), parties=c("parties"), outcome=c("last")))
    court = _node("Court", _key(c("court")), _props(name=c("court")))
    spoken = rows.select("doc", "chunk_id", "ord").join(head.select("doc", "own_no", "case_no", "court", "parties", "last", "party"), "doc")
    parties = spoken.select("doc", "chunk_id", "ord", F.explode("party").alias("name"))
    nodes = [
        _nodes(head.where("own_no is not null"), [case]), _nodes(spoken, [F.when(c("own_no").isNull(), case), court]),
        _nodes(parties, [_node("Party", _key(c("name")), _props(name=c("name")))]), _nodes(rows, [_chunk_node("judgements")]),
    ]
    at_first = head.drop("chunk_id").withColumnRenamed("first_chunk", "chunk_id")
    each = at_first.select("chunk_id", "case_no", F.explode("party").alias("name"))
    up = _parents(rows)
    edges = [
        _edges(at_first, [_edge("DECIDED_BY", judgment, ("Court", _key(c("court"))), "header")]), _edges(each, [_edge("INVOLVES", judgment, ("Party", _key(c("name"))), "header")]), _parent_edges(up),
    ]
    return _union(nodes), _union(edges), up.where("not _ok").select(F.lit("judgment_parent_not_in_graph").alias("reason"), "ord")


# A reference to a section, and the numbers that continue it.
REFERENCE = r"(?i)\b(?:sections|section|sec|s)\.?\s+(\d+[A-Za-z]?)(?=([\s\S]{0,90}))"
CONTINUED = r"(?i)[,\s]*(?:and\s*|,|&)\s*(\d+[A-Za-z]?)"
OF_ACT = r"(?i)\bof\s+(?:the\s+)?([A-Z][\w&'(),.\- ]{2,60})"


def alias_ladder(said: Column, aliases: dict[str, str]) -> Column:
    """The act whose longest alias (the first of equals) is contained in ``said``; ``aliases`` is a dictionary of settings, from alias to act."""
    if not aliases:
        return F.lit(None).cast("string")
    longest_first = sorted(aliases, key=lambda a: (-len(a), a))
    low = F.lower(said)
    found = F.get(F.filter(F.lit(longest_first), lambda a: F.contains(low, a)), F.lit(0))
    return F.element_at(F.map_from_arrays(F.lit(longest_first), F.lit([aliases[k] for k in longest_first])), found)


def references(sections: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """``(ord, chunk_id, act, section_no, ref_act, ref_no)``: every section that a section's text refers to.

    After each reference the next 90 characters may name an act (else it is the
    section's own) and the next 80 hold up to four further numbers.
    """
    hits = F.arrays_zip(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(1)).alias("no"), F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(2)).alias("tail"))
    rows = sections.select("ord", "chunk_id", "act", "section_no", F.explode(hits).alias("h"))
    numbers = F.slice(F.concat(F.array("h.no"), F.regexp_extract_all(F.left("h.tail", F.lit(80)), F.lit(CONTINUED), F.lit(1))), 1, 5)
    named = alias_ladder(F.regexp_extract("h.tail", OF_ACT, 1), aliases)
    return rows.select("ord", "chunk_id", "act", "section_no", F.coalesce(named, F.col("act")).alias("ref_act"), F.explode(numbers).alias("ref_no"))


def reference_edges(refs: DataFrame, sections: DataFrame, acts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References to sections of the graph, else to other acts of it; and reasons for the rest."""
    c = F.col
    there = sections.select(c("act").alias("ref_act"), c("section_no").alias("ref_no"), F.lit(True).alias("_sec")).distinct()
    known = acts.select(c("act").alias("ref_act"), F.lit(True).alias("_act")).distinct()
    rows = refs.join(there, ["ref_act", "ref_no"], "left").join(known, "ref_act", "left")
    a = ("Section", _key(c("act"), c("section_no")))
    other = (c("ref_act") != c("act")) & c("_act").isNotNull()
    to_section = _edge("REFERENCES", a, ("Section", _key(c("ref_act"), c("ref_no"))), "reference")
    to_act = _edge("REFERENCES", a, ("Act", _key(c("ref_act"))), "reference_act")
    edges = _edges(rows, [F.when(c("_sec"), to_section).when(other, to_act)], "1")
    reason = F.when(c("ref_act") != c("act"), "ref_act_not_in_graph").otherwise("ref_section_not_in_graph")
    return edges, rows.where(c("_sec").isNull() & ~other).select(reason.alias("reason"), "ord")


PARTS = ("statutes", "judgments", "amendments", "references")


def corpus_graph(chunks: DataFrame, catalog: DataFrame | None = None, parts: tuple[str, ...] = PARTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Node rows, edge rows and reasons of a whole corpus, or of those ``parts`` of it, under one key for each act.

    Texts, which only amendments and references need, are left out of the rows that
    all parts share and are fetched for amending chunks and sections by ``ord``.
    """
    c = F.col
    rows = cut(with_act(first_deliveries(chunks.drop("text")), catalog))
    aliases = {} if catalog is None or not {"amendments", "references"} & set(parts) else act_aliases(catalog)

    def with_text(some: Column) -> DataFrame:
        return rows.where(some & (c("act") != "")).join(chunks.where(some & c("text").isNotNull()).select("ord", "text"), "ord", "left")

    found: list[tuple[DataFrame | None, DataFrame, DataFrame]] = []
    if "statutes" in parts:
        found.append(statute_graph(rows))
    if "judgments" in parts:
        found.append(judgment_graph(rows))
    if "amendments" in parts:
        found.append((None, *amendments(with_text(F.lower("doc_type") == "amendment"), first_sections(rows), aliases)))
    if "references" in parts:
        sections = rows.where(is_section() & (c("act") != ""))
        laws = rows.where(F.lower("doc_type").isin(*STATUTES) & (c("act") != ""))
        found.append((None, *reference_edges(references(with_text(is_section()), aliases), sections.select("act", "section_no"), laws.select("act").distinct())))
    nodes = [n for n, _, _ in found if n is not None]
    return _union(nodes) if nodes else None, _union([e for _, e, _ in found]), _union([r for _, _, r in found])


def assemble(nodes: DataFrame, edges: DataFrame, drop_section_text: bool = False, allow_dangling: bool = False) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Merged nodes and edges with their ids, ready to load, and what was counted.

    An edge with an end that is no node is dangling: the assembly ends with an error
    unless that is allowed, and then leaves it out.
    """
    if drop_section_text:
        nodes = nodes.withColumn("props", F.when(F.col("label") == "Section", F.map_filter("props", lambda k, _: k != "text")).otherwise(F.col("props")))
    nodes = nodes.withColumn("point_id", F.when(F.col("label") == "Chunk", F.col("id")))
    kept = nodes.dropDuplicates(["id"])
    lost = cut(dangling(kept, edges))
    counts = nodes.agg(F.count("*").alias("nodes_in"), F.countDistinct("id").alias("nodes_out")).first().asDict()
    counts |= {"edges_in": edges.count(), "dangling_edges": lost.count()}
    counts["edges_out"] = counts["edges_in"] - counts["dangling_edges"]
    if counts["dangling_edges"] and not allow_dangling:
        some = [(r.type, r.from_id, r.to_id) for r in lost.limit(10).collect()]
        raise ValueError(f"{counts['dangling_edges']} edges have an end that is no node, such as {some}")
    ids = kept.select("id")
    whole = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*edges.columns)
    return kept, whole, counts


def section_record(nodes: DataFrame, act: str, section_no: str) -> DataFrame:
    """The one section node of an act and number, as evidence: no text, and the chunk that holds it."""
    found = nodes.where((F.col("label") == "Section") & (F.col("key") == F.array(F.lit(act), F.lit(str(section_no))))).orderBy("id").limit(1)
    return section_records(found)


def section_records(nodes: DataFrame, via: DataFrame | None = None) -> DataFrame:
    """``(id, act, section_no, title, chunk_id, text)`` of section nodes; where the node states no chunk, the one it was reached by, ``via (id, via_chunk)``, stands in."""
    rows = nodes.where("label = 'Section'")
    rows = rows.withColumn("via_chunk", F.lit(None).cast("string")) if via is None else rows.join(via.groupBy("id").agg(F.min("via_chunk").alias("via_chunk")), "id", "left")
    prop = lambda k: F.element_at("props", k)
    return rows.select("id", F.get("key", F.lit(0)).alias("act"), F.get("key", F.lit(1)).alias("section_no"), prop("title").alias("title"), F.coalesce(prop("chunk_id"), "via_chunk").alias("chunk_id"), F.lit(None).cast("string").alias("text"))


def canonical_acts(nodes: DataFrame) -> DataFrame:
    """The distinct names of acts."""
    return nodes.where((F.col("label") == "Act") & (F.get("key", F.lit(0)) != "")).select(F.get("key", F.lit(0)).alias("act")).distinct()


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which an end is not among the nodes."""
    ids = nodes.select("id").distinct()
    lost = lambda end: edges.join(ids.select(F.col("id").alias(end)), end, "left_anti")
    return lost("from_id").unionByName(edges.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(ids.select(F.col("id").alias("to_id")), "to_id", "left_anti").select(*edges.columns))


def assembly_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows in, distinct out, repeated and dangling, of both tables, in one row."""
    n = nodes.agg(F.count("*").alias("nodes_in"), F.countDistinct("id").alias("nodes_out"))
    key = F.struct("type", "from_id", "to_id")
    e = edges.agg(F.count("*").alias("edges_in"), F.countDistinct(F.when(F.col("from_id").isNotNull() & F.col("to_id").isNotNull(), key)).alias("edges_out"))
    d = dangling(nodes, edges).agg(F.count("*").alias("dangling_edges"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(n).join(one(e), "_one").join(one(d), "_one").drop("_one").withColumn("repeated_nodes", F.col("nodes_in") - F.col("nodes_out"))


def load_nodes(new: DataFrame, existing: DataFrame | None = None, order: str = "ingested_at") -> DataFrame:
    """First write wins: rows that exist stay, of the new ones the first by ``order`` is added; null ids are refused."""
    cols = [F.col(c) for c in new.columns]
    w = W.partitionBy("id").orderBy(order, F.xxhash64(*(F.to_json(c) if isinstance(new.schema[c].dataType, T.MapType) else F.col(c) for c in new.columns)))
    first = new.where("id is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*cols)
    if existing is None:
        return first
    return existing.unionByName(first.join(existing.select("id"), "id", "left_anti").select(*cols))


def load_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One edge per type and ends, both of which must be there."""
    ids = cut(nodes.select("id").distinct())
    distinct = edges.groupBy("type", "from_id", "to_id").agg(F.min("from_label").alias("from_label"), F.min("to_label").alias("to_label"), F.count("*").alias("n_sources"))
    return distinct.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi").select("type", "from_id", "to_id", "from_label", "to_label", "n_sources")


def verify_counts(df: DataFrame, by: str, expected: DataFrame) -> DataFrame:
    """Counts per ``by`` against ``expected (by, expected)``."""
    got = df.groupBy(by).agg(F.count("*").alias("loaded"))
    both = got.join(expected, by, "full")
    return both.select(by, F.coalesce("loaded", F.lit(0)).alias("loaded"), F.coalesce("expected", F.lit(0)).alias("expected")).withColumn("ok", F.col("loaded") == F.col("expected"))


def repeated_keys(nodes: DataFrame) -> DataFrame:
    """Labels and ids that break uniqueness."""
    return nodes.groupBy("label", "id").agg(F.count("*").alias("n")).where("n > 1")


def expand_sections(edges: DataFrame, seeds: DataFrame, hops: int = 1, max_nodes: int = 40) -> DataFrame:
    """``(id, hop)`` of sections reached over REFERENCES in either direction, nearest first, seeds left out.

    At most ``max_nodes`` are returned (the feature of a bounded expansion), ties by
    id.  ``seeds (id)`` is a question's small start set.
    """
    e = edges.where((F.col("type") == "REFERENCES") & (F.col("from_label") == "Section") & (F.col("to_label") == "Section"))
    both = e.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).unionByName(e.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))).where("a is not null and b is not null").distinct()
    seen = cut(seeds.select("id", F.lit(0).alias("hop")).distinct())
    for h in range(1, hops + 1):
        edge = seen.where(F.col("hop") == h - 1).select(F.col("id").alias("a"))
        new = both.join(edge, "a", "left_semi").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        room = max_nodes - (seen.count() - seen.where("hop = 0").count())
        if room <= 0:
            break
        seen = cut(seen.unionByName(new.orderBy("id").limit(room).withColumn("hop", F.lit(h))))
    return seen.where("hop > 0").orderBy("hop", "id").limit(max_nodes)


def sections_of_chunks(edges: DataFrame, chunk_nodes: DataFrame, limit: int = 25) -> DataFrame:
    """Distinct sections that the chunk nodes ``(id)`` belong to, at most ``limit`` (section, chunk) pairs."""
    e = edges.where((F.col("type") == "BELONGS_TO") & (F.col("to_label") == "Section")).select(F.col("from_id").alias("id"), F.col("to_id").alias("section_id")).distinct()
    return e.join(chunk_nodes.select("id"), "id", "left_semi").orderBy("section_id", "id").limit(limit).select("section_id", F.col("id").alias("via_chunk"))


def citing_judgments(edges: DataFrame, limit: int = 20) -> DataFrame:
    """Per section the judgments that cite it, at most ``limit`` each, by id."""
    e = edges.where((F.col("type") == "CITES") & F.col("from_id").isNotNull() & F.col("to_id").isNotNull()).select(F.col("to_id").alias("section_id"), F.col("from_id").alias("judgment_id")).distinct()
    w = W.partitionBy("section_id").orderBy("judgment_id")
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def expand_evidence(edges: DataFrame, chunk_nodes: DataFrame, hops: int = 1, max_nodes: int = 40) -> DataFrame:
    """Sections of the chunks, their neighbours, and the judgments that cite the former: ``(id, role)``."""
    seeds = cut(sections_of_chunks(edges, chunk_nodes, max_nodes).select(F.col("section_id").alias("id")).distinct())
    more = expand_sections(edges, seeds, hops, max_nodes).select("id")
    both = seeds.select("id", F.lit("section").alias("role")).unionByName(more.select("id", F.lit("neighbour").alias("role")))
    judged = citing_judgments(edges).join(F.broadcast(seeds.select(F.col("id").alias("section_id"))), "section_id", "left_semi").select(F.col("judgment_id").alias("id"), F.lit("judgment").alias("role")).distinct()
    return both.unionByName(judged)


def expand_sections_each(edges: DataFrame, seeds: DataFrame, hops: int = 1, max_nodes: int = 40) -> DataFrame:
    """``(query, id, hop)``: ``expand_sections`` for every query of ``seeds (query, id)``, ``max_nodes`` each."""
    e = edges.where((F.col("type") == "REFERENCES") & (F.col("from_label") == "Section") & (F.col("to_label") == "Section"))
    both = e.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).unionByName(e.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))).where("a is not null and b is not null").distinct()
    seen = cut(seeds.select("query", "id", F.lit(0).alias("hop")).distinct())
    w = W.partitionBy("query").orderBy("id")
    for h in range(1, hops + 1):
        edge = seen.where(F.col("hop") == h - 1).select("query", F.col("id").alias("a"))
        new = edge.join(both, "a").select("query", F.col("b").alias("id")).distinct().join(seen, ["query", "id"], "left_anti")
        had = seen.groupBy("query").agg(F.count_if(F.col("hop") > 0).alias("had"))
        kept = new.withColumn("rank", F.row_number().over(w)).join(had, "query").where(F.col("rank") + F.col("had") <= max_nodes)
        seen = cut(seen.unionByName(kept.select("query", "id", F.lit(h).alias("hop"))))
    return seen.where("hop > 0")


def sections_of_chunks_each(edges: DataFrame, chunk_nodes: DataFrame, limit: int = 25) -> DataFrame:
    """``(query, section_id, via_chunk)``: ``sections_of_chunks`` for every query of ``chunk_nodes (query, id)``, ``limit`` each."""
    e = edges.where((F.col("type") == "BELONGS_TO") & (F.col("to_label") == "Section")).select(F.col("from_id").alias("id"), F.col("to_id").alias("section_id")).distinct()
    w = W.partitionBy("query").orderBy("section_id", "id")
    pairs = chunk_nodes.select("query", "id").distinct().join(e, "id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return pairs.select("query", "section_id", F.col("id").alias("via_chunk"))


def expand_evidence_each(edges: DataFrame, chunk_nodes: DataFrame, hops: int = 1, max_nodes: int = 40) -> DataFrame:
    """``(query, id, role)``: ``expand_evidence`` for every query of ``chunk_nodes (query, id)``."""
    seeds = cut(sections_of_chunks_each(edges, chunk_nodes, max_nodes).select("query", F.col("section_id").alias("id")).distinct())
    more = expand_sections_each(edges, seeds, hops, max_nodes).select("query", "id")
    both = seeds.withColumn("role", F.lit("section")).unionByName(more.withColumn("role", F.lit("neighbour")))
    judged = seeds.select("query", F.col("id").alias("section_id")).join(citing_judgments(edges), "section_id").select("query", F.col("judgment_id").alias("id"), F.lit("judgment").alias("role")).distinct()
    return both.unionByName(judged)


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many judgments have a court, parties, citations and offences, as ``n (p%)`` too."""
    flags = edges.where("from_label = 'Judgment' or to_label = 'Judgment'")
    end = F.when(F.col("from_label") == "Judgment", F.col("from_id")).otherwise(F.col("to_id"))
    per = flags.select(end.alias("id"), "type").groupBy("id").agg(*(F.max(F.col("type") == t).alias(t) for t in ("DECIDED_BY", "INVOLVES", "CITES", "CONCERNS")))
    j = nodes.where("label = 'Judgment'").select("id").distinct().join(per, "id", "left")
    sums = j.agg(F.count("*").alias("total"), *(F.count_if(F.col(t)).alias(t) for t in ("DECIDED_BY", "INVOLVES", "CITES", "CONCERNS")))
    rows = sums.select("total", F.explode(F.array(*(F.struct(F.lit(t).alias("flag"), F.col(t).alias("n")) for t in ("DECIDED_BY", "INVOLVES", "CITES", "CONCERNS")))).alias("x"))
    return rows.select("x.flag", "x.n", "total", X.percent_text(F.col("x.n"), F.col("total")).alias("shown"))


def resolvable(nodes: DataFrame) -> DataFrame:
    """Per label the nodes with a whole key."""
    ok = (F.size("key") > 0) & ~F.exists("key", lambda x: x.isNull() | (x == ""))
    return nodes.groupBy("label").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_resolvable"), F.round(F.count_if(ok) / F.count("*"), 4).alias("ratio"))
