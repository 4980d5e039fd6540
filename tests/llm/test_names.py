from __future__ import annotations

import random

import pytest

from lexquarry.llm import names as N
from lexquarry.llm.spelling import Trie, edits

GROUPS = [
    ["Gregory H. Sufistarar", "Sufistarar, Greg", "GREGORY H. SUFISTARAR", "Mr. Gregory H. Sufistrar", "G.H.Sufistarar", "Sufistarar Gregory H.", "Justice Gregory Sufistarar", "Gregory H. Sufistarar etc"],
    ["Isabella Sufistarar", "Bella Sufistarar"],
    ["Bostinulit Engineering Company (Private) Limited", "Engineering Company Ltd, Bostinulit", "M/s Bostinulit Engg. Co (Private) Limited", "Botsinulit Engineering Co. Pvt. Ltd.", "BOSTINULIT ENGINEERING"],
    ["Bostinulit Shipping and Sons", "Shipping & Sons Ltd, Bostinulit"],
    ["Nebrosovel, W. A.", "William A. Nebrosovel", "Bill Nebrosovel"],
    ["Nebrosovel, C.", "Charles Nebrosovel"],
    ["The State"], ["Patricia Popeleros"], ["Leonard M. Bofekalek"], ["Leonard T. Bofekalek"],
]


def pairs(groups):
    return {(min(a, b), max(a, b)) for g in groups for a in g for b in g if a != b}


def test_groups(spark):
    rows = [(n, "x", i) for g in GROUPS for i, n in enumerate(g)] * 2 + [(None, "x", 1), ("", "x", 1), ("  ", "x", 1)]
    df = spark.createDataFrame(rows, "name string, kind string, rare int")
    assert {tuple(r) for r in N.variant_pairs(df).collect()} == pairs(GROUPS)
    assert N.variant_pairs(df.limit(0)).count() == 0


def test_an_initial_alone_is_not_guessed(spark):
    df = spark.createDataFrame([("E. Falitokim",), ("Elizabeth Falitokim",), ("Edward Falitokim",)], "name string")
    assert N.variant_pairs(df).count() == 0
    df = spark.createDataFrame([("E. N. Falitokim",), ("Elizabeth N. Falitokim",), ("Edward Falitokim",)], "name string")
    assert {tuple(r) for r in N.variant_pairs(df).collect()} == {("E. N. Falitokim", "Elizabeth N. Falitokim")}


def test_words_in_any_order(spark):
    """No word, or every word, looks like a given name, so the order decides nothing."""
    groups = [["Wazir Kabilam", "Kabilam Wazir", "Wazir Kabilan", "KABILAM WAZEIR"], ["Thomas James", "James Thomas", "Jim Thomas"], ["Arbit Noxim Veloru", "Veloru Arbit Noxim", "Noxim Veloru Arbit"], ["Arbit Noxim Pelagu"], ["a b c d e f g h"]]
    df = spark.createDataFrame([(n,) for g in groups for n in g], "name string")
    assert {tuple(r) for r in N.variant_pairs(df).collect()} == pairs(groups)
    long = " ".join(f"{'abcdefghij'[i] * 4}" for i in range(10))
    assert len(N.readings(long)) == 20


def test_a_hot_surname(spark):
    """A surname of very many bearers: only spellings of one given name meet."""
    given = sorted({"".join(w) for w in zip("bdfgklmnprstvz" * 30, "aeiou" * 84, "lmnrst" * 70, "aeiou" * 84, "kmt" * 140)})
    rows = [f"{g.title()} {m}. Khanim" for g in given for m in "ABC"] + [f"KHANIM, {g.upper()} {m}." for g in given for m in "ABC"]
    got = {tuple(r) for r in N.variant_pairs(spark.createDataFrame([(r,) for r in rows], "name string")).collect()}
    assert got >= {tuple(sorted((f"{g.title()} {m}. Khanim", f"KHANIM, {g.upper()} {m}."))) for g in given for m in "ABC"}
    assert all(levenshtein(a.replace("KHANIM, ", "").split()[0].lower(), b.replace("KHANIM, ", "").split()[0].lower()) < 2 for a, b in got)


def words(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 11))) for _ in range(n)]
    return sorted({*base, *(w[:2] + rng.choice("abcde") + w[2:] for w in base[::2]), *(w[1:] for w in base[::3] if len(w) > 3)})


def test_automaton_walks_the_trie():
    w = words(1, 150)
    trie = Trie(w)
    plain = lambda a, b: edits(a, b, 2)
    for a in w[:60]:
        got = set(trie.near(a, 2))
        assert got >= {b for b in w if plain(a, b) <= 2 and abs(len(a) - len(b)) + 0 <= 2 and levenshtein(a, b) <= 2}
        assert all(levenshtein(a, b) <= 2 for b in got)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("trie", [5_000, 3])
def test_trie_join_against_brute_force(spark, monkeypatch, trie):
    monkeypatch.setattr(N, "TRIE", trie)
    w = words(7, 120)
    got = {tuple(r) for r in N.near_words(spark.createDataFrame([(x,) for x in w], "word string")).collect()}
    want = {(a, b) for a in w for b in w if a < b and levenshtein(a, b) <= 2 and edits(a, b, 2) <= N._limit(a, b)}
    assert got == want


def test_case_spellings(spark):
    docs = spark.sql("select named_struct('parties', 'A B vs C D', 'judges', array('J One', null, '')) judgement_meta union all select named_struct('parties', 'no sides', 'judges', cast(null as array<string>)) union all select null")
    chunks = spark.sql("select map('context', '[Case: E F vs G H | Court | No. 1/2010] [Para 2]') meta union all select map('context', '[Case: Court | No. 1/2010]') union all select cast(null as map<string,string>) union all select map('keep', 'true')")
    assert {r.name for r in N.case_spellings(docs, chunks).collect()} == {"A B", "C D", "J One", "E F", "G H"}
