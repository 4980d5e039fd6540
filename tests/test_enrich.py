from __future__ import annotations

from pyspark.sql import functions as F

from lexquarry.operators import enrich as E


def test_enrich(spark):
    rows = [("j.pdf", "judgement", i, f"text {i}") for i in range(9)] + [("k.pdf", "Judgement", 20, "fails"), ("l.pdf", "judgement", 30, None), ("s.pdf", "statute", 40, "x")]
    chunks = spark.createDataFrame(rows, "doc string, doc_type string, ord int, text string")

    def extract(text):
        if text == "fails":
            raise RuntimeError
        return {"offences": ["Theft", "section 4", ""], "cited_sections": [{"act": "A", "section": "1"}, {"act": "A", "section": "9"}, {"act": None, "section": "1"}]} if text else {}

    links, reasons = E.enrich_judgments(chunks, extract, spark.createDataFrame([("A", "1")], "act string, section_no string"))
    assert sorted(map(tuple, links.collect()), key=repr) == [("j.pdf", "CITES", "A", "1"), ("j.pdf", "CONCERNS", None, "Theft")]
    assert sorted(map(tuple, reasons.collect())) == [
        ("j.pdf", "tier2_cite_section_not_in_graph"), ("j.pdf", "tier2_cite_unresolved_act"), ("j.pdf", "tier2_offence_is_section_ref"), ("k.pdf", "tier2_empty_response"), ("l.pdf", "tier2_empty_response"),
    ]
    assert E.judgment_texts(chunks).where("doc = 'j.pdf'").first().text.count("text") == 6


def test_encode(spark):
    df = spark.createDataFrame([(1, "ab"), (2, " "), (3, None)], "i int, t string")
    got = E.encode_texts(df, "i", "t", lambda xs: [[float(len(x))] for x in xs])
    assert [tuple(r) for r in got.collect()] == [(1, [2.0])]


def test_texts(spark):
    pool = spark.createDataFrame([(2, None, "4", None, "rules", "b" * 9), (1, "d", None, "t", None, "a"), (9, "x", "x", "x", "x", "x")], "place int, doc string, section_no string, section_title string, doc_type string, text string")
    assert E.evidence_text(pool, 8, 3).first().text == "[1] d — Section None (t) [None]\na\n\n[2] None — Section 4 (n/a) [rules]\nbbb"
    turns = spark.createDataFrame([(1, i, "user" if i % 2 else "system", "" if i == 6 else f"t{i}") for i in range(8)], "c int, n int, role string, text string")
    got = E.history_text(turns, "c", "n", F.col("role"), F.col("text")).first().history
    assert got == "Assistant: t2\nUser: t3\nAssistant: t4\nUser: t5\nUser: t7"
    assert E.markdown(turns.select("c", "text").limit(1)) == "| c | text |\n|---|---|\n| 1 | t0 |"
    assert E.report({"turns": turns.select("c").limit(1)}) == {"turns": [{"c": 1}]}
    assert E.turns_text([{"role": "USER", "content": " a "}, {"role": None, "content": None}, {"content": "b"}]) == "User: a\nAssistant: b" and E.turns_text(None) == ""
    cites = spark.createDataFrame([("2", "CITES", None, None, "won"), ("1", "CITES", "C 1", "Court", None), ("0", "REFERENCES", "x", "x", "x")], "id string, source string, case_no string, court string, outcome string")
    assert E.cited_text(cites).first().text == "[C1] C 1 — Court (outcome: n/a)\n[C2] None — court n/a (outcome: won)"
