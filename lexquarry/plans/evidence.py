"""Evidence for a question: hybrid search over collections, a bounded loop of searches, the graph, and the answer.

The driver steps through states; what it holds are plans of tables whose size is
bounded by the limits of one question (hops, top-k, nodes), cut from their lineage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexquarry.functions import text as X
from lexquarry.operators import enrich as E
from lexquarry.operators import graph as G
from lexquarry.operators import retrieval as R
from lexquarry.sources.tables import Settings
from lexquarry.storage import cut

#: From a question to its vectors: ``{"dense": [...], "sparse": {term: weight}}``.
Encoder = Callable[[str], dict[str, Any]]
#: From the question, the pool and the hop to ``{"next_query", "filters", "note"}``.
Planner = Callable[[str, DataFrame, int], dict]
Scorer = Callable[[Column, Column], Column]

FIELDS = ["doc", "doc_type", "section_no", "section_title", "parent_id", "is_parent", "text"]
#: Pieces of evidence and of the graph that an answer shows, those that a model is given, and judgments named to it.
SHOWN, GIVEN, NAMED = 12, 8, 5
CHILDREN = 20


def term_counts(question: str) -> dict[str, Any]:
    """The default encoder: no dense vector, and the question's words with their counts."""
    words = [w for w in "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in question.lower()).split()]
    return {"dense": None, "sparse": {w: float(words.count(w)) for w in words}}


def usable(filters: dict | None) -> dict:
    return {k: v for k, v in (filters or {}).items() if v not in (None, "", [], (), set())}


class HybridStore:
    """Collections of chunks ``(chunk_id, ord, doc, doc_type, ..., text[, embedding])``, by name in the order of their priority.

    A redelivered chunk is its first delivery.  A search scores every chunk that passes
    the filters by narrow columns; texts are fetched for the few that are found.
    """

    def __init__(self, collections: dict[str, DataFrame] | DataFrame, encoder: Encoder = term_counts, vec_col: str = "embedding"):
        named = {"chunks": collections} if isinstance(collections, DataFrame) else collections
        self.collections = {n: df.where("chunk_id is not null") for n, df in named.items()}
        self.encoder, self.vec_col = encoder, vec_col

    def vectors(self, query: str | dict) -> tuple[list[float] | None, dict[str, float]]:
        """A text's vectors by the encoder, or those given."""
        if not isinstance(query, str | dict):
            raise TypeError(f"a query is a text or its vectors, not {type(query).__name__}")
        got = self.encoder(query) if isinstance(query, str) else query
        dense, sparse = got.get("dense"), got.get("sparse") or {}
        if isinstance(sparse, dict) and set(sparse) == {"indices", "values"}:
            sparse = dict(zip(map(str, sparse["indices"]), sparse["values"]))
        return (None if dense is None else [float(x) for x in dense]), {str(t): float(w) for t, w in sparse.items()}

    def search(self, query: str | dict, filters: dict | None = None, top_k: int = R.TOP_K, prefetch: int = R.PREFETCH) -> DataFrame:
        """``(id, collection, score, place, doc, ..., text)``: both rankings of each collection fused, an id once, by score."""
        dense, sparse = self.vectors(query)
        found = []
        for n, (name, rows) in enumerate(self.collections.items()):
            fused = self._ranked(rows.where(R.matches(usable(filters))), dense, sparse, prefetch, top_k)
            found.append(fused.withColumn("collection", F.lit(name)).withColumn("priority", F.lit(n)))
        merged = cut(R.merge_collections(reduce(DataFrame.unionByName, found)).select("id", "collection", "score", "place"))
        return merged.join(self.get(merged.select("id")).drop("collection"), "id")

    def _ranked(self, rows: DataFrame, dense: list[float] | None, sparse: dict[str, float], prefetch: int, top_k: int) -> DataFrame:
        words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
        weights = F.create_map(*(F.lit(x) for kv in (sparse or {"": 0.0}).items() for x in kv))
        count = F.aggregate(words, F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(weights, w), F.lit(0.0)))
        by_vector = X.dot(F.col(self.vec_col), F.lit(dense)) if dense and self.vec_col in rows.columns else F.lit(None).cast("double")
        scored = rows.select("chunk_id", "ord", F.round(by_vector, 6).alias("d"), (F.round(count, 6) if sparse else F.lit(None).cast("double")).alias("s"))
        each = scored.groupBy(F.col("chunk_id").alias("id")).agg(F.min_by(F.struct("d", "s"), F.col("ord")).alias("x")).select(F.lit(0).alias("q"), "id", "x.d", "x.s")
        best = lambda c, low: each.where(F.col(c) > low).orderBy(F.desc(c), "id").limit(prefetch).select("q", "id", F.row_number().over(W.partitionBy("q").orderBy(F.desc(c), "id")).alias("rank"))
        return R.fuse(best("d", float("-inf")), best("s", 0.0), top_k)

    def get(self, ids: DataFrame) -> DataFrame:
        """``(id, collection, doc, ..., text)``: the first delivery in the first collection that has each of the few ids."""
        few = F.broadcast(ids.select("id").distinct())
        parts = []
        for n, (name, rows) in enumerate(self.collections.items()):
            cols = [F.col(c) if c in rows.columns else F.lit(None).cast("boolean" if c == "is_parent" else "string").alias(c) for c in FIELDS]
            parts.append(rows.select(F.col("chunk_id").alias("id"), F.lit(name).alias("collection"), F.struct(F.lit(n), "ord").alias("at"), *cols).join(few, "id", "left_semi"))
        every = reduce(DataFrame.unionByName, parts)
        return every.groupBy("id").agg(F.min_by(F.struct("collection", *FIELDS), F.col("at")).alias("x")).select("id", "x.*")

    def exact_lookup(self, doc: str | None, section_no: str | None, top_k: int = 10) -> DataFrame:
        """Chunks of a document and section in the first collection, by ``ord``, ``top_k`` at most; a null or empty part is no condition."""
        rows = next(iter(self.collections.values()))
        return rows.where(R.matches({"doc": doc, "section_no": section_no})).orderBy("ord").limit(top_k)

    def info(self) -> DataFrame:
        """``(collection, points, ids, dense_size, fields)`` of every collection."""
        parts = []
        for name, rows in self.collections.items():
            size = F.max(F.size(self.vec_col)) if self.vec_col in rows.columns else F.lit(None).cast("int")
            parts.append(rows.agg(F.count("*").alias("points"), F.countDistinct("chunk_id").alias("ids"), size.alias("dense_size")).select(F.lit(name).alias("collection"), "*", F.lit(", ".join(f"{c} {t}" for c, t in rows.dtypes)).alias("fields")))
        return reduce(DataFrame.unionByName, parts)

    def children(self, parents: DataFrame, top_k: int = CHILDREN) -> DataFrame:
        """``(parent_id, id, at)``: of each of the few parents the first children by ``ord``, ``top_k`` a collection."""
        few = F.broadcast(parents.select(F.col("id").alias("parent_id")).distinct())
        w = W.partitionBy("parent_id").orderBy("ord")
        parts = []
        for n, rows in enumerate(self.collections.values()):
            kids = rows.select("parent_id", F.col("chunk_id").alias("id"), "ord").join(few, "parent_id", "left_semi").withColumn("r", F.row_number().over(w)).where(F.col("r") <= top_k)
            parts.append(kids.select("parent_id", "id", F.struct(F.lit(n).alias("n"), "r").alias("at")))
        return reduce(DataFrame.unionByName, parts)


class KnowledgeGraph:
    """Nodes and edges; ``BELONGS_TO`` edges begin at chunk ids."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def expand_evidence(self, chunks: DataFrame, hops: int = 1, max_nodes: int = 40) -> tuple[DataFrame, DataFrame]:
        """``(sections, judgments)`` of the chunks ``(id)``: seed sections first, then neighbours; judgments that cite a seed."""
        pairs = cut(G.sections_of_chunks(self.edges, chunks, max_nodes))
        found = cut(G.expand_evidence(self.edges, chunks, hops, max_nodes))
        ids = F.broadcast(found.select("id").distinct())
        own = cut(self.nodes.where("label in ('Section', 'Judgment')").join(ids, "id", "left_semi").dropDuplicates(["id"]))
        via = pairs.select(F.col("section_id").alias("id"), "via_chunk")
        sections = found.where("role <> 'judgment'").join(G.section_records(own, via), "id").withColumn("seed", F.col("role") == "section").drop("role")
        prop = lambda k: F.element_at("props", k).alias(k)
        judgments = own.where("label = 'Judgment'").select("id", F.get("key", F.lit(0)).alias("case_no"), prop("court"), prop("outcome"), prop("date"))
        return sections, judgments.join(found.where("role = 'judgment'").select("id").distinct(), "id", "left_semi")


GRAPH_FIELDS = ["id", "source", "act", "section_no", "case_no", "court", "outcome", "date"]


@dataclass
class State:
    question: str
    query: str
    filters: dict | None = None
    hop: int = 0
    step: int = 0
    pool: DataFrame | None = None
    found: DataFrame | None = None
    graph: DataFrame | None = None
    low: bool = False
    expanded: bool = False
    added: bool = False
    notes: list[str] = field(default_factory=list)


class HopSearch:
    """A bounded loop over one question; the hooks are a scorer, a planner and a graph."""

    POOLED = ["id", *FIELDS, "hop", "step", "at", "from_graph"]

    def __init__(self, store: HybridStore, settings: Settings = Settings(), scorer: Scorer = R.overlap_score, planner: Planner | None = None, graph: KnowledgeGraph | None = None):
        self.store, self.settings, self.scorer, self.planner, self.graph = store, settings, scorer, planner, graph

    def run(self, question: str, filters: dict | None = None) -> State:
        """Search, rerank, and widen until the evidence is good or the hops are used up; then the graph's texts, then the final order."""
        s = State(question, question, usable(filters))
        next_step = "search" if self.settings.max_hops > 0 else "end"
        while next_step == "search":
            self.search(s)
            self.rerank(s)
            quality = self.quality(s)
            if quality == "poor":
                s.query, s.filters = s.question, None
            elif quality == "expand":
                self.expand(s)
            else:
                next_step = "end"
        if self.graph is not None and s.pool is not None:
            self.expand_graph(s)
        self.finish(s)
        return s

    def quality(self, s: State) -> str:
        """``limit`` when the hops are used up, else ``poor``, ``expand`` (at least once, and as long as it finds something), or ``good``."""
        if s.hop >= self.settings.max_hops:
            return "limit"
        if s.low:
            return "poor"
        return "expand" if self.planner or not s.expanded or s.added else "good"

    def search(self, s: State) -> None:
        s.hop += 1
        found = self.store.search(s.query, s.filters, self.settings.top_k, self.settings.prefetch)
        s.found = cut(found.withColumn("at", F.col("place")))
        s.low = s.found.isEmpty()
        self._pool(s, s.found)

    def _pool(self, s: State, rows: DataFrame, from_graph: bool = False) -> None:
        """Take up rows whose id is not in the pool yet, in their order."""
        s.step += 1
        new = rows.where("id is not null").groupBy("id").agg(F.min_by(F.struct(*FIELDS, "at"), F.col("at")).alias("x")).select("id", "x.*")
        new = new.withColumn("hop", F.lit(s.hop)).withColumn("step", F.lit(s.step)).withColumn("at", F.col("at").cast("bigint")).withColumn("from_graph", F.lit(from_graph)).select(*self.POOLED)
        s.pool = cut(new if s.pool is None else s.pool.unionByName(new.join(s.pool.select("id"), "id", "left_anti").select(*self.POOLED)))

    def _scored(self, rows: DataFrame, query: str, top_k: int) -> DataFrame:
        return cut(R.rerank(rows.withColumn("q", F.lit(0)).withColumn("query", F.lit(query)), self.scorer, top_k).drop("q", "query"))

    def rerank(self, s: State) -> None:
        if s.low:
            return
        s.found = self._scored(s.found.withColumn("rank", F.col("at")).drop("place"), s.query, self.settings.rerank)
        best = s.found.agg(F.max("rerank_score")).first()[0]
        s.low = best is None or best < self.settings.threshold

    def expand(self, s: State) -> None:
        """The planner's next query; without one, or when it fails, the parents of pooled rows and the children of pooled parents."""
        s.expanded = True
        if self.planner:
            try:
                plan = self.planner(s.question, s.pool, s.hop)
                s.query, s.filters, s.added = str(plan.get("next_query") or s.question), usable(plan.get("filters")), True
                s.notes.append(str(plan.get("note", "")))
                return
            except Exception as e:  # noqa: BLE001 - a planner's failure falls through to the structure
                s.notes.append(f"planner failed: {e}")
        order = F.struct("step", "at")
        up = s.pool.where("parent_id <> ''").select(F.col("parent_id").alias("id"), order.alias("of"), F.lit(0).alias("k"), F.lit(0).alias("n"))
        kids = self.store.children(s.pool.where("is_parent").select("id"))
        down = kids.join(s.pool.select(F.col("id").alias("parent_id"), order.alias("of")), "parent_id").select("id", "of", F.lit(1).alias("k"), (F.col("at.n") * 1000 + F.col("at.r")).alias("n"))
        wanted = up.unionByName(down).groupBy("id").agg(F.min(F.struct("of", "k", "n")).alias("w"))
        rows = wanted.join(self.store.get(wanted), "id").withColumn("at", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("w")))
        rows = cut(rows)
        s.added = not rows.isEmpty()
        self._pool(s, rows)
        s.query, s.filters = s.question, None

    def expand_graph(self, s: State) -> None:
        """Texts of sections near the evidence go into the pool; sections without one and citing judgments are graph evidence."""
        seeds = s.pool.select("id", F.lit(1).alias("k"), F.struct("step", "at").alias("o"))
        if s.found is not None and not s.low | s.found.isEmpty():
            seeds = seeds.unionByName(s.found.select("id", F.lit(0).alias("k"), F.struct(F.lit(0).alias("step"), F.col("place").cast("bigint").alias("at")).alias("o")))
        seeds = cut(seeds.groupBy("id").agg(F.min(F.struct("k", "o")).alias("o")).orderBy("o").limit(self.settings.seeds).select("id"))
        try:
            sections, judgments = self.graph.expand_evidence(seeds, self.settings.kg_hops, self.settings.max_nodes)
            sections, judgments = cut(sections), cut(judgments)
        except Exception as e:  # noqa: BLE001 - without the graph the search goes on as before
            s.notes.append(f"graph failed: {e}")
            return
        texts = self.store.get(sections.where("chunk_id is not null").select(F.col("chunk_id").alias("id")))
        order = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("seed"), "id"))
        ranked = cut(sections.withColumn("at", order).withColumnRenamed("id", "kg_id").withColumnRenamed("chunk_id", "id"))
        self._pool(s, ranked.select("id", "at").join(texts, "id"), True)
        bare = ranked.join(texts.select("id"), "id", "left_anti").select(F.col("kg_id").alias("id"), "act", "section_no")
        none = lambda *cs: [F.lit(None).cast("string").alias(c) for c in cs]
        s.graph = cut(
            bare.select("id", F.lit("REFERENCES").alias("source"), "act", "section_no", *none("case_no", "court", "outcome", "date"))
            .unionByName(judgments.select("id", F.lit("CITES").alias("source"), *none("act", "section_no"), "case_no", "court", "outcome", "date"))
            .dropDuplicates(["id"])
        )

    def finish(self, s: State) -> None:
        if s.pool is not None:
            rows = s.pool.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("step", "at", "id")))
            s.pool = self._scored(rows, s.question, self.settings.final).drop("rank")


def shown_evidence(pool: DataFrame, most: int = SHOWN) -> DataFrame:
    """Evidence for display: scores of four decimals, texts of 300 characters, the first ``most``."""
    cols = ["doc", "section_no", "section_title", "doc_type"]
    return pool.where(F.col("place") <= most).select("place", F.col("id").alias("chunk_id"), *cols, F.bround("rerank_score", 4).alias("score"), "from_graph", F.left("text", F.lit(300)).alias("text"))


def shown_graph(graph: DataFrame, most: int = SHOWN) -> DataFrame:
    """What the graph found, sections first, the first ``most``."""
    w = W.partitionBy(F.lit(0)).orderBy(F.desc("source"), "id")
    return graph.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("place", *GRAPH_FIELDS[1:])


def caption(mode: str, hops: int, evidence: int, graph: int) -> str:
    return f"{mode}: {hops} {'hop' if hops == 1 else 'hops'}, {evidence} pieces of evidence, {graph} from the graph"


def answer(
    question: str, store: HybridStore, settings: Settings = Settings(), deep: bool = True, history: list[dict] | None = None, scorer: Scorer = R.overlap_score,
    planner: Planner | None = None, graph: KnowledgeGraph | None = None, contextualise: Callable[[str, str], str] | None = None, synthesise: Callable[[str, str], str] | None = None,
) -> dict[str, Any]:
    """A question with its evidence: ``deep`` runs the loop, else one search is reranked.

    ``contextualise(question, history)`` may make a follow-up stand by itself, and
    ``synthesise(question, evidence)`` may write an answer; if either fails the question
    stays, or the answer says so.
    """
    if not question.strip():
        raise ValueError("the question is empty")
    turns, asked = E.turns_text(history), question
    if contextualise and turns:
        try:
            asked = (contextualise(question, turns) or "").replace("\xa0", " ").strip().strip('"').strip() or question
        except Exception:  # noqa: BLE001 - a failing model leaves the question as it is
            asked = question
    if deep:
        state = HopSearch(store, settings, scorer, planner, graph).run(asked)
    else:
        state = State(asked, asked)
        loop = HopSearch(store, settings, scorer)
        loop.search(state)
        if not state.low:
            kept = loop._scored(state.found.withColumn("rank", F.col("at")).drop("place"), asked, settings.fast).select("id", "rerank_score", "place")
            state.pool = cut(state.pool.join(kept, "id"))
        else:
            state.pool = None
    n = 0 if state.pool is None else state.pool.count()
    n_graph = 0 if state.graph is None else state.graph.count()
    said = None
    if synthesise and n:
        try:
            said = synthesise(question, E.prompt_text(state.pool, state.graph, turns, GIVEN, NAMED))
        except Exception as e:  # noqa: BLE001
            said = f"(no answer: {e})"
    mode = "deep" if deep else "fast"
    return {
        "query": question, "searched": asked, "mode": mode, "hops": state.hop, "answer": said, "caption": caption(mode, state.hop, n, n_graph), "notes": state.notes, "evidence_count": n,
        "evidence": None if not n else shown_evidence(state.pool), "graph_evidence_count": n_graph, "graph_evidence": None if not n_graph else shown_graph(state.graph),
    }
