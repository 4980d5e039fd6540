from __future__ import annotations

import uuid

import pytest

from lexquarry.operators import graph as G

CHUNKS = "chunk_id string, doc string, doc_type string, level string, section_no string, section_title string, part string, chapter string, parent_id string, is_parent boolean, tokens int, text string, meta map<string,string>, ord bigint, label string"


def chunk(i, cid, doc="A.pdf", kind="statute", level="section", no=None, part=None, chapter=None, parent=None, text="", meta=None, title=None):
    return (cid, doc, kind, level, no, title, part, chapter, parent, None, 1, text, meta, i, "extra")


ROWS = [
    chunk(0, "A:paragraph:9", level="paragraph", no="1"),  # comes before its section
    chunk(1, "A:section:1", no="1", part="I", chapter="II", title=None), chunk(2, "A:section:2", no="1", title="Second"), chunk(3, "A:sub:3", level="subsection", no="1", parent="A:section:1"),
    chunk(4, "A:sub:4", level="subsection", no="7", parent="A:none:1"), chunk(5, "B:section:1", doc="B.pdf", kind="RULES", no="22A"), chunk(6, None), chunk(7, "A:section:1", no="1"),
    chunk(8, "j:preamble:1", doc="j1.pdf", kind="judgement", level="preamble", meta={"context": "[Case: High Court of Osk | A vs B etc. | C.R. No. 1/2010]"}),
    chunk(9, "j:para:2", doc="j1.pdf", kind="judgement", level="para", no="1", parent="j:preamble:1", meta={"context": "[Case: other]", "disposition": "first"}),
    chunk(10, "k:para:1", doc="k.pdf", kind="Judgement", level="para", meta={"context": "[Case: C.R. No. 1/2010]", "disposition": "last"}), chunk(11, "l:para:1", doc="l.pdf", kind="judgement", level="para", parent="nowhere"),
]


def table(spark, rows=ROWS):
    return G.with_act(G.first_deliveries(spark.createDataFrame(rows, CHUNKS)))


def test_statute_graph(spark):
    nodes, edges, reasons = G.statute_graph(table(spark))
    got = {(r.label, tuple(r.key)): r for r in G.merge_nodes(nodes).collect()}
    section = got["Section", ("A", "1")]
    assert section.n_chunks == 2 and section.props["title"] == "Second" and section.props["chunk_id"] == "A:section:1"
    of = spark.createDataFrame([(section.id,), (section.id,)], "id string")
    assert [tuple(r) for r in G.chunk_ids(of, G.mentions(nodes)).collect()] == [(section.id, ["A:section:1", "A:section:2"])]
    assert section.id == str(uuid.uuid5(uuid.NAMESPACE_DNS, "graph:Section:A:1"))
    assert got["Chunk", ("A:sub:3",)].id == str(uuid.uuid5(uuid.NAMESPACE_DNS, "A:sub:3"))
    assert ("Section", ("B", "22A")) in got and ("Part", ("A", "I")) in got
    e = {(r.type, tuple(r.from_key), tuple(r.to_key), r.source) for r in G.merge_edges(edges).collect()}
    assert ("BELONGS_TO", ("A:sub:3",), ("A", "1"), "chunk.section_no") in e and ("PARENT_OF", ("A:section:1",), ("A:sub:3",), "parent_id") in e
    assert not any(t == "BELONGS_TO" and a == ("A:paragraph:9",) for t, a, *_ in e)
    assert sorted((r.reason, r.ord) for r in reasons.collect()) == [("belongs_to_no_section_node", 0), ("belongs_to_no_section_node", 4), ("parent_not_in_graph", 4)]


def test_judgment_graph(spark):
    nodes, edges, reasons = G.judgment_graph(table(spark))
    got = {(r.label, tuple(r.key)): r for r in G.merge_nodes(nodes).collect()}
    assert got["Judgment", ("C.R. No. 1/2010",)].props["outcome"] == "last" and ("Judgment", ("l",)) in got
    assert got["Court", ("High Court of Osk",)].n_chunks == 2 and got["Judgment", ("C.R. No. 1/2010",)].n_chunks == 2
    assert {k for k in got if k[0] == "Party"} == {("Party", ("A",)), ("Party", ("B",))}
    assert {(r.type, r.to_key[0]) for r in edges.collect()} == {("DECIDED_BY", "High Court of Osk"), ("INVOLVES", "A"), ("INVOLVES", "B"), ("PARENT_OF", "j:para:2")}
    assert [(r.reason, r.ord) for r in reasons.collect()] == [("judgment_parent_not_in_graph", 11)]


def test_empty(spark):
    empty = table(spark, [])
    nodes, edges, reasons = G.statute_graph(empty)
    assert G.merge_nodes(nodes).count() == G.merge_edges(edges).count() == reasons.count() == 0


def test_references(spark):
    rows = spark.createDataFrame(
        [
            (1, "c1", "A", "1", "section 3, sections 20, 21 and 24; sec. 9 of the Penal Code; section 1 again"), (2, "c2", "A", "3", "section 99"), (3, "c3", "A", "4", "s. 7 of the Other Act"), (4, "c4", "A", "5", None), (5, "c5", "A", "6", ""),
        ],
        "ord bigint, chunk_id string, act string, section_no string, text string",
    )
    refs = G.references(rows, {"penal code": "Penal Code 1860", "other act": "Other Act"})
    got = {(r.chunk_id, r.ref_act, r.ref_no) for r in refs.collect()}
    assert {("c1", "Penal Code 1860", "9"), ("c1", "A", "1"), ("c2", "A", "99"), ("c3", "Other Act", "7")} <= got
    assert {n for c, _, n in got if c == "c1"} >= {"3", "20", "21", "24", "9", "1"}
    keys = rows.select("act", "section_no")
    acts = spark.createDataFrame([("A",), ("Other Act",)], "act string")
    edges, reasons = G.reference_edges(refs, keys, acts)
    assert {(r.from_key[1], r.to_label, tuple(r.to_key)) for r in edges.collect()} >= {("1", "Section", ("A", "1")), ("4", "Act", ("Other Act",))}
    assert {r.reason for r in reasons.collect()} == {"ref_act_not_in_graph", "ref_section_not_in_graph"}
    assert G.references(rows, {}).where("ref_act <> act").count() == 0


def test_amendments(spark):
    rows = [
        chunk(0, "s:1", doc="Stamp Act 1930.pdf", no="1"), chunk(1, "x:1", doc="X (Amendment).pdf", kind="amendment", level="amendment", meta={"amends_section": "1"}, text="in the Stamp Act 1930"),
        chunk(2, "x:2", doc="X (Amendment).pdf", kind="amendment", level="amendment", text="Amendment of section 9 of the STAMP ACT 1930"), chunk(3, "x:3", doc="X (Amendment).pdf", kind="amendment", level="amendment"),
        chunk(4, "y:1", doc="Y.pdf", kind="amendment", level="amendment", text="amendment of section 4"), chunk(5, "y:2", doc="Y.pdf", kind="amendment", level="amendment", text="amendment of sub-section 4"),
        chunk(6, "z:1", doc="Z.pdf", kind="amendment", level="amendment", meta={"amends_section": "2"}, text="the Stamp Act 1930"), chunk(7, "s:2", doc="Stamp Act 1930.pdf", no="2"),
    ]
    edges, reasons = G.amendments(table(spark, rows), G.first_sections(table(spark, rows)), {"stamp act 1930": "Stamp Act 1930", "stamp act": "other"})
    assert [(tuple(r.from_key), tuple(r.to_key)) for r in edges.collect()] == [(("Stamp Act 1930", "1"), ("X (Amendment)",))]
    assert sorted((r.ord, r.reason) for r in reasons.collect()) == [(2, "amendment_section_not_in_graph"), (3, "amendment_no_section"), (4, "amendment_no_act"), (5, "amendment_no_section"), (6, "amendment_section_not_in_graph")]


def test_one_key_for_an_act(spark):
    """A file of any spelling, a reference and an amendment meet at one node."""
    rows = [
        chunk(0, "a:1", doc="12345678 copy_of_The Stamp Act, 1930 (1)UPDATED.pdf", no="1"), chunk(1, "b:1", doc="Toll Rules of 1950 [7654321].pdf", kind="rules", no="4", text="section 1 of the Stamp Act 1930; section 9 of the Stamp Act 1930; section 3 of the Mint Act 1920; section 77"),
        chunk(2, "c:1", doc="Amending.pdf", kind="amendment", level="amendment", meta={"amends_section": "1"}, text="Amendment of the Stamp Act 1930"),
    ]
    catalog = spark.createDataFrame([("Stamp Act 1930",), ("Toll Rules 1950",), ("Mint Act 1920",), (None,), ("",)], "act_name string")
    nodes, edges, reasons = G.corpus_graph(spark.createDataFrame(rows, CHUNKS), catalog)
    nodes, edges, counts = G.assemble(G.merge_nodes(nodes), G.merge_edges(edges), drop_section_text=True)
    assert {tuple(r.key) for r in nodes.where("label = 'Act'").collect()} == {("Stamp Act 1930",), ("Toll Rules 1950",), ("Amending",)}
    got = {(r.type, tuple(r.from_key), tuple(r.to_key)) for r in edges.where("type in ('REFERENCES', 'AMENDED_BY')").collect()}
    assert got == {("REFERENCES", ("Toll Rules 1950", "4"), ("Stamp Act 1930", "1")), ("REFERENCES", ("Toll Rules 1950", "4"), ("Stamp Act 1930",)), ("AMENDED_BY", ("Stamp Act 1930", "1"), ("Amending",))}
    assert counts["dangling_edges"] == 0 and nodes.where("label = 'Section' and props['text'] is not null").count() == 0
    assert {r.reason for r in reasons.collect()} >= {"ref_act_not_in_graph", "ref_section_not_in_graph"}


def test_assembly_ends_on_dangling_edges(spark):
    nodes = spark.createDataFrame([("1", "Section", {"text": "t", "title": "x"}), ("2", "Chunk", {})], "id string, label string, props map<string,string>")
    edges = edges_of(spark, [("1", "2"), ("1", "9")])
    with pytest.raises(ValueError):
        G.assemble(nodes, edges)
    n, e, counts = G.assemble(nodes, edges, allow_dangling=True)
    assert (n.count(), e.count(), counts["dangling_edges"]) == (2, 1, 1)
    assert {r.id: r.point_id for r in n.collect()} == {"1": None, "2": "2"}


def test_section_records(spark):
    nodes = spark.createDataFrame([("1", "Section", ["A", "1"], {"title": "t", "chunk_id": "c1"}), ("2", "Section", ["A", "2"], {}), ("3", "Act", ["A"], {})], "id string, label string, key array<string>, props map<string,string>")
    via = spark.createDataFrame([("2", "c9"), ("2", "c8"), ("1", "c7")], "id string, via_chunk string")
    assert sorted((r.id, r.chunk_id, r.text) for r in G.section_records(nodes, via).collect()) == [("1", "c1", None), ("2", "c8", None)]
    assert [r.title for r in G.section_record(nodes, "A", "1").collect()] == ["t"] and G.section_record(nodes, "A", "9").count() == 0
    assert [r.act for r in G.canonical_acts(nodes).collect()] == ["A"]


def edges_of(spark, pairs, kind="REFERENCES", a="Section", b="Section"):
    return spark.createDataFrame([(kind, a, x, b, y) for x, y in pairs], "type string, from_label string, from_id string, to_label string, to_id string")


def test_bounded_expansion(spark):
    edges = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "d"), (None, "a"), ("x", "x")]).unionByName(edges_of(spark, [("a", "act")], b="Act"))
    seeds = spark.createDataFrame([("a",), ("a",)], "id string")
    assert sorted(map(tuple, G.expand_sections(edges, seeds, 1).collect())) == [("b", 1), ("c", 1)]
    assert sorted(map(tuple, G.expand_sections(edges, seeds, 3).collect())) == [("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert [tuple(r) for r in G.expand_sections(edges, seeds, 3, 1).collect()] == [("b", 1)]
    assert G.expand_sections(edges, seeds.limit(0), 2).count() == 0


def test_citing_limit_and_evidence(spark):
    cites = edges_of(spark, [(f"j{i:02}", "s1") for i in range(25)] + [("j01", "s2"), ("j01", "s2"), (None, "s1")], "CITES", "Judgment")
    assert G.citing_judgments(cites).groupBy("section_id").count().collect() and G.citing_judgments(cites).where("section_id = 's1'").count() == 20
    edges = cites.unionByName(edges_of(spark, [("c1", "s2")], "BELONGS_TO", "Chunk")).unionByName(edges_of(spark, [("s2", "s3")]))
    got = G.expand_evidence(edges, spark.createDataFrame([("c1",)], "id string"))
    assert sorted(map(tuple, got.collect())) == [("j01", "judgment"), ("s2", "section"), ("s3", "neighbour")]


def test_loading(spark):
    schema = "id string, label string, key array<string>, props map<string,string>, ingested_at int"
    new = spark.createDataFrame([("1", "Act", ["a"], {"v": "late"}, 2), ("1", "Act", ["a"], {"v": "first"}, 1), (None, "Act", ["n"], None, 1), ("2", "Court", [], None, 1)], schema)
    once = G.load_nodes(new)
    assert sorted((r.id, (r.props or {}).get("v")) for r in once.collect()) == [("1", "first"), ("2", None)]
    again = G.load_nodes(new, once)
    assert again.count() == 2
    edges = edges_of(spark, [("1", "2"), ("1", "2"), ("1", "9"), (None, "2")])
    assert [(r.from_id, r.to_id, r.n_sources) for r in G.load_edges(once, edges).collect()] == [("1", "2", 2)]
    assert G.dangling(once, edges).count() == 2
    s = G.assembly_summary(new, edges).first()
    assert (s.nodes_in, s.nodes_out, s.edges_in, s.edges_out, s.dangling_edges) == (4, 2, 4, 2, 2)
    assert G.repeated_keys(new).collect()[0].n == 2
    assert {r.label: (r.n, r.n_resolvable) for r in G.resolvable(new).collect()} == {"Act": (3, 3), "Court": (1, 0)}
    ok = G.verify_counts(once, "label", spark.createDataFrame([("Act", 1), ("Party", 3)], "label string, expected long"))
    assert {r.label: r.ok for r in ok.collect()} == {"Act": True, "Court": False, "Party": False}


def test_every_seed_is_expanded(spark, rows):
    links = [("REFERENCES", "Section", f"s{i}", "Section", f"s{(i * k + 1) % 12}") for i in range(12) for k in (2, 3)]
    links += [("BELONGS_TO", "Chunk", f"c{i}", "Section", f"s{i % 12}") for i in range(30)] + [("CITES", "Judgment", f"j{i}", "Section", f"s{i}") for i in range(5)]
    edges = spark.createDataFrame(links, "type string, from_label string, from_id string, to_label string, to_id string").cache()
    pick = lambda ids: spark.createDataFrame([(i, i) for i in ids], "query string, id string")
    for most in (3, 100):
        got = rows(G.expand_sections_each(edges, pick(f"s{i}" for i in range(12)), 2, most), "query", "id", "hop")
        for s in ("s0", "s7", "s11"):
            assert [x[1:] for x in got if x[0] == s] == rows(G.expand_sections(edges, pick([s]), 2, most), "id", "hop")
    assert len(rows(G.sections_of_chunks_each(edges, pick(f"c{i}" for i in range(30)), 1))) == 30
    got = rows(G.expand_evidence_each(edges, pick(f"c{i}" for i in range(30))), "query", "id", "role")
    assert {x[0] for x in got} == {f"c{i}" for i in range(30)}
    for c in ("c4", "c29"):
        assert [x[1:] for x in got if x[0] == c] == rows(G.expand_evidence(edges, pick([c])), "id", "role")
