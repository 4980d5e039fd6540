from __future__ import annotations

import pytest

from lexquarry.plans import evidence as V
from lexquarry.sources.tables import Settings

CHUNKS = "chunk_id string, ord int, doc string, doc_type string, section_no string, section_title string, parent_id string, is_parent boolean, text string"


def chunk(i, cid, text, parent=None, is_parent=None, doc="d", kind="statute", no="1"):
    return (cid, i, doc, kind, no, None, parent, is_parent, text)


ROWS = [
    chunk(1, "p", "parent words", is_parent=True), chunk(2, "c", "salt tax levy", "p"), chunk(3, "s", "sibling text", "p"), chunk(4, "o", "other matter", doc="e"), chunk(5, "c", "salt salt tax again", "p"), chunk(6, None, "salt"),
    chunk(7, "k1", "kid one", "q"), chunk(8, "q", "tax of the question", is_parent=True), chunk(9, "k2", "kid two", "q"),
]


def store(spark, rows=ROWS, **more):
    return V.HybridStore(spark.createDataFrame(rows, CHUNKS), **more)


def ids(df):
    return [r.id for r in df.orderBy("place").collect()]


def test_store(spark):
    st = store(spark)
    assert ids(st.search("salt tax levy")) == ["c", "q"] and st.search("salt tax levy").orderBy("place").first().text == "salt tax levy"
    assert ids(st.search("tax", {"doc": "e", "section_no": None})) == [] and ids(st.search("matter", {"doc": ["e", "x"]})) == ["o"]
    assert ids(st.search({"dense": None, "sparse": {"other": 1.0}})) == ["o"]
    with pytest.raises(TypeError):
        st.search(7)
    assert {(r.id, r.text) for r in st.get(spark.createDataFrame([("c",), ("zz",)], "id string")).collect()} == {("c", "salt tax levy")}
    assert [(r.id, r["at"].r) for r in st.children(spark.createDataFrame([("q",)], "id string"), 1).collect()] == [("k1", 1)]


def test_store_of_vectors_and_collections(spark):
    rows = spark.createDataFrame([("a", 1, "x", [1.0, 0.0]), ("b", 2, "y", [0.0, 1.0]), ("n", 3, "z", None)], "chunk_id string, ord int, text string, embedding array<float>")
    st = V.HybridStore({"one": rows.where("ord < 3"), "two": rows}, encoder=lambda q: {"dense": [0.6, 0.8], "sparse": {"indices": [], "values": []}})
    got = st.search("anything").orderBy("place").collect()
    assert [(r.id, r.collection) for r in got] == [("b", "one"), ("a", "one")]
    assert got[0].score == round(1 / 61, 6)


def test_lookups_of_the_first_collection(spark):
    st = store(spark)
    assert [r.chunk_id for r in st.exact_lookup("d", "1", 2).collect()] == ["p", "c"] and st.exact_lookup("e", None).count() == 1
    info = st.info().first()
    assert (info.collection, info.points, info.ids, info.dense_size) == ("chunks", 8, 7, None) and "is_parent boolean" in info.fields


def run(spark, question, rows=ROWS, graph=None, planner=None, filters=None, **settings):
    return V.HopSearch(store(spark, rows), Settings(**settings), planner=planner, graph=graph).run(question, filters)


def test_the_loop_stops_at_its_hops(spark):
    assert run(spark, "salt tax", max_hops=1).hop == 1 and run(spark, "salt tax", max_hops=0).hop == 0
    poor = run(spark, "nothing here", max_hops=3, filters={"doc": "e"})
    assert poor.hop == 3 and poor.filters is None and not poor.expanded


def test_good_evidence_is_expanded_once_at_least(spark):
    s = run(spark, "salt tax levy", max_hops=2, threshold=0.1)
    assert s.hop == 2 and s.expanded and s.added
    got = {r.id: (r.hop, r.step) for r in s.pool.collect()}
    assert got == {"c": (1, 1), "q": (1, 1), "p": (1, 2), "k1": (1, 2), "k2": (1, 2)}  # parents of pooled rows, children of pooled parents, no siblings
    alone = run(spark, "other matter", max_hops=5, threshold=0.1)
    assert alone.hop == 2 and not alone.added  # nothing to expand, so the second hop is good


def test_poor_evidence_drops_the_filters(spark):
    s = run(spark, "salt tax levy", max_hops=3, threshold=0.99, filters={"doc": "e"})
    assert s.filters is None and {r.id for r in s.pool.collect()} >= {"c"}


def test_planner(spark):
    asked = []

    def plan(question, pool, hop):
        asked.append((question, pool.count(), hop))
        return {"next_query": "matter", "filters": {"doc": "e", "section_no": ""}, "note": "n"}

    s = run(spark, "salt tax", planner=plan, max_hops=2, threshold=0.0)
    assert asked == [("salt tax", 2, 1)] and s.filters == {"doc": "e"} and {r.id for r in s.pool.collect()} == {"c", "q", "o"} and s.notes == ["n"]
    s = run(spark, "salt tax", planner=lambda *_: 1 / 0, max_hops=2, threshold=0.0)
    assert "planner failed" in s.notes[0] and s.pool.count() == 5


def graph(spark):
    nodes = spark.createDataFrame(
        [("s1", "Section", ["A", "1"], {"chunk_id": "c"}), ("s2", "Section", ["A", "2"], {"chunk_id": "o"}), ("s3", "Section", ["A", "3"], {"chunk_id": "gone"}), ("j1", "Judgment", ["C 1/2020"], {"court": "High Court", "outcome": "dismissed"}), ("j2", "Judgment", ["C 2"], {})],
        "id string, label string, key array<string>, props map<string,string>",
    )
    links = [("BELONGS_TO", "Chunk", "c", "Section", "s1"), ("REFERENCES", "Section", "s1", "Section", "s2"), ("REFERENCES", "Section", "s3", "Section", "s1"), ("CITES", "Judgment", "j1", "Section", "s1"), ("CITES", "Judgment", "j2", "Section", "s2")]
    return V.KnowledgeGraph(nodes, spark.createDataFrame(links, "type string, from_label string, from_id string, to_label string, to_id string"))


def test_the_graph_brings_texts_and_evidence(spark):
    s = run(spark, "salt tax levy", graph=graph(spark), max_hops=1)
    assert {r.id: r.from_graph for r in s.pool.collect()} == {"c": False, "q": False, "o": True}
    assert {(r.id, r.source, r.act, r.section_no, r.case_no, r.court) for r in s.graph.collect()} == {("s3", "REFERENCES", "A", "3", None, None), ("j1", "CITES", None, None, "C 1/2020", "High Court")}
    broken = V.KnowledgeGraph(None, None)
    assert "graph failed" in run(spark, "salt tax levy", graph=broken).notes[0]


def test_answer(spark):
    seen = {}

    def write(question, given):
        seen["given"] = given
        return "answer"

    history = [{"role": "user", "content": f"turn {i}"} for i in range(7)] + [{"role": "assistant", "content": " "}]
    got = V.answer("and that levy?", store(spark), graph=graph(spark), history=history, contextualise=lambda q, t: ' "salt tax levy" ', synthesise=write)
    assert (got["searched"], got["mode"], got["hops"], got["answer"], got["evidence_count"], got["graph_evidence_count"]) == ("salt tax levy", "deep", 1, "answer", 3, 2)
    assert got["caption"] == "deep: 1 hop, 3 pieces of evidence, 2 from the graph"
    assert "[C1] C 1/2020 — High Court (outcome: dismissed)" in seen["given"] and "User: turn 6" in seen["given"] and "turn 1\n" not in seen["given"] and "[1] d — Section 1 (n/a) [statute]\nsalt tax levy" in seen["given"]
    assert [(r.chunk_id, r.score, r.from_graph) for r in got["evidence"].orderBy("place").collect()][0] == ("c", 1.0, False)
    fast = V.answer("salt tax levy", store(spark), deep=False, contextualise=lambda *_: 1 / 0, history=history, synthesise=lambda *_: 1 / 0)
    assert (fast["mode"], fast["searched"], fast["evidence_count"], fast["graph_evidence"]) == ("fast", "salt tax levy", 2, None) and fast["answer"].startswith("(no answer")
    none = V.answer("zzz", store(spark), deep=False)
    assert (none["evidence_count"], none["evidence"], none["answer"]) == (0, None, None)
    with pytest.raises(ValueError):
        V.answer("  ", store(spark))
