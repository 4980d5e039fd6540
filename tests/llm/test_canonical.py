from __future__ import annotations

import random

import pytest

from lexquarry.llm import canonical as C

ENTRIES = [
    (1, "Compulsory Pensions Act 2017"), (2, "Coastal Settlements Rules 1958"), (3, "Coastal Settlements Rules 1933"), (4, "Consolidated Pensions Act 1939"), (5, "Consolidated Pensions (Amendment) Act 1949"),
    (6, "Domestic Timber Transit Ordinance 1923"), (7, "Urban Co-operatives Ordinance 1955"), (8, "Coastal Quarries Regulations 1954"), (9, "Maritime Escrow Act 1984"),
]


@pytest.fixture(scope="module")
def canon():
    return C.Canon(ENTRIES)


@pytest.mark.parametrize(
    "said,entry",
    [
        ("Compulsory Pensions Act, 2017", 1), ("COMPULSORY PENSIONS ACT OF 2017", 1), ("Pensions (Compulsory) Act - 2017", 1), ("Cmopulsory Pension A. 2017", 1), ("CP Act, 2017", 1), ("C.P. Act No. IX of 2017", 1),
        ("Compulsory Pensions Act 2016", -1), ("Compulsory Pensions Rules 2017", -1), ("Coastal Settlements Rules", -1), ("Coas. Settl. Rls 1933", 3), ("Coastal Settlements R., 1958", 2),
        ("Consolidated Pensions (Amdt.) Act, 1949", 5), ("Consolidated Pensions Act", 4), ("Consolidated Pensions Act 1949", -1), ("Timber Transit (Domestic) Ord. 1923", 6), ("Domes. Tmiber Transit Ordce", 6),
        ("Urban Co-operative Ordinance", 7), ("Coastal Quarries Regns, 1954", 8), ("Marit. Escrow Act", 9), ("Maritime Falconry Act", -1), ("", -1), ("Act", -1), ("nothing at all", -1),
    ],
)
def test_values(canon, said, entry):
    assert canon.map(said) == entry


LONG = [
    (1, "Salt Tax Act 1990"), (2, "Storage Licence Act 1990"), (3, "Sale of Goods Act"), (4, "Prevention of Smuggling and Recovery of Stolen River Craft and Fishing Gear in Coastal Districts Act 1961"),
    (5, "Northern Harbour Dues Collection Rules 1970"), (6, "Northern Harbour Dues Collection Staff Pensions Rules 1971"), (7, "Tax Act 1980"),
]


@pytest.mark.parametrize(
    "said,entry",
    [
        ("schedule to the Salt Tax Act", 1), ("Provincial Storage Licence Act 1990", 2), ("the Provincial Storage Licence Act 1991", -1), ("Sale of Goods Act", 3), ("Goods Sale Act", 3), ("Tax Act", 7), ("Salt Tax Act 1980", -1),
        ("Prevention of Smuggling and Recovery of Stolen River Craft and Fishing Gear in Coastal Districts Act, 1961", 4),
        ("Prevention of Smugling and Recovery of Stolen River Crafts and Fishing Gear in Coastal Districts Act, 1961", 4),
        ("Dues Collection (Northern Harbour) Rules", 5), ("Collection Harbour Dues Northern Rules", 5), ("Pensions Staff Northern Collection Dues Harbour Rules 1971", 6), ("Northern Harbor Dues Rules", 5),
        ("Northern Harbour Dues Collection Extra Rules 1970", 5), ("Northern Rules", -1), ("annex B to the rules made under the Salt Tax Act 1990 as amended", 1),
    ],
)
def test_embedded_reordered_and_long_names(said, entry):
    assert C.Canon(LONG).map(said) == entry


def test_longest_mentions_win_over_a_whole_text():
    names = ["aaa bbb ccc", "bbb ccc", "ccc ddd eee fff", "ddd", "eee fff", "fff aaa"]
    canon = C.Canon([(i, f"{n} act") for i, n in enumerate(names)])
    patterns = sorted((p for p in canon.auto.keys()), key=len, reverse=True)
    rng = random.Random(2)
    for _ in range(200):
        text = C.plain(" ".join(rng.choice("abcdefg") * 3 for _ in range(30)))
        at, want = 0, []
        while at < len(text):
            hit = next((p for p in patterns if text.startswith(p, at)), None)
            if hit:
                want.append((at, at + len(hit) - 1))
            at += len(hit) - 1 if hit else 1
        assert [(b, e) for b, e, _ in canon.spans(text)] == want
    assert canon.spans(C.plain("nothing")) == []


def test_whole_texts():
    canon = C.Canon(ENTRIES + [(20, "Salt Tax Act 1990")])
    text = "x " * 5000 + "section 4 of the schedule to the Salt Tax Act 1990; section 5 of the Maritime Escrow Act 1984 and section 6 of the " + "very " * 40 + "long Urban Co-operatives Ordinance. section 7 of the tenancy which the Maritime Escrow Act governs"
    assert [e for _, e in canon.cited(text)] == [20, 9, 7]
    assert list(canon.cited("")) == [] and list(C.Canon([]).cited("section 1 of the Salt Tax Act")) == [("Salt Tax Act", -1)]


def test_edits():
    assert [C.edits(a, b, 2) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abc", "xyz"), ("", "ab"))] == [0, 1, 1, 3, 2]


@pytest.mark.parametrize(
    "name,title",
    [
        ("12461821 COASTAL RLS NO. IX OF 1958.pdf", "COASTAL RLS NO. IX OF 1958"), ("copy_of_The_Coastal_Act,_1930 (1)UPDATED [12345678].PDF", "Coastal_Act,_1930".replace("_", " ")),
        ("THE A.Q. Ordinance 1949-ocr-12027382.pdf", "A.Q. Ordinance 1949"), ("X (Amend) ACT, 2022 AMD (13330699).pdf", "X (Amend) ACT, 2022"),
    ],
)
def test_file_titles(name, title):
    assert C.file_title(name) == title


@pytest.mark.parametrize(
    "text,name",
    [
        ("Coastal Quarries Regulations, 1954 shall apply", "Coastal Quarries Regulations, 1954"), ("said Ordinance affects", None), ("Marit. Escrow Act, which the notary", "Marit. Escrow Act"),
        ("P.T.T. (Amend) Ordinance 2014, which", "P.T.T. (Amend) Ordinance 2014"), ("Consolidated\nPensions ACT NO. VII OF 1939; it", "Consolidated Pensions ACT NO. VII OF 1939"), ("tenant in the street", None),
    ],
)
def test_names_in_text(text, name):
    assert C.name_at(text) == name


def test_tables(spark):
    chunks = spark.createDataFrame(
        [
            ("c1", "The Compulsory Pension Act, 2017 (1)UPDATED.pdf", "STATUTE", "section 4 of the Maritime Escrow Act 1984 and sections 5 and 6 of the Maritime Falconry Act; section 9 of this Act or of the said Rules"),
            ("c2", "x.pdf", "judgement", "[Case: A vs B]\n(a) Coas. Settl. Rls 1933---S. 4---text. s. 4 of the CP Act, 2017"), ("c3", None, None, None), ("c3", "", "rules", ""), ("c4", "x.pdf", "judgement", "Section 12A of the Maritime Escrow Act"),
            ("c1", "The Compulsory Pension Act, 2017 (1)UPDATED.pdf", "statute", "no citation"),
        ],
        "chunk_id string, doc string, doc_type string, text string",
    )
    catalog = spark.createDataFrame([(i, n, "z") for i, n in ENTRIES] + [(None, "x", "z"), (99, None, "z")], "act_id bigint, act_name string, doc string")
    got = {(r.field, r.item, r.entry) for r in C.instruments(chunks, catalog).collect()}
    assert got == {("doc", "The Compulsory Pension Act, 2017 (1)UPDATED.pdf", 1), ("text", "c1", 9), ("text", "c1", -1), ("text", "c2", 3), ("text", "c2", 1), ("text", "c4", 9)}
    assert C.instruments(chunks.limit(0), catalog).count() == 0
    assert {r.entry for r in C.instruments(chunks, catalog.limit(0)).collect()} == {-1}


def test_the_list_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_ENTRIES", 2)
    with pytest.raises(ValueError):
        C.link_values(spark.createDataFrame([], "field string, item string, said string"), spark.createDataFrame(ENTRIES, "i bigint, n string"), "i", "n")
