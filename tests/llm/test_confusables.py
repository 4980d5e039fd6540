from __future__ import annotations

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from lexquarry.llm.confusables import PLAIN, Former, consistent_forms, display_alike, look_alikes

SAME = [
    ("ＡＢＣ １２", "ABC 12"), ("été", "été"), ("a​b­c﻿", "abc"), ("a b c", "a b c"), ("ﬁle ﬂow", "file flow"), ("non‑stop", "non-stop"),
    ("cоurt", "court"), ("Αct", "Act"), ("мoре", "море"), ("Суд сoр", "Суд сор"), ("a\r\nb\rc", "a\nb\nc"), ("τοu", "τοu"), ("zone а b", "zone a b"),
]


SAME += [
    ("caf\u0435\u0301", "café"), ("\u0133s \u0132", "ijs IJ"), ("p\u03b1ypal", "paypal"), ("\u04c0nland", "Inland"), ("c\u0585urt", "court"), ("\u054dnited", "United"), ("\U0001d41acourt", "acourt"), ("\U0001d670ct", "Act"),
    ("\uff23\u03bf\u057drt", "Court"), ("\u13aact", "Act"), ("\u04d3b", "äb"), ("\u03ccb", "ób"), ("\u0441\u0443\u0434 c\u0443\u0434\u0430", "\u0441\u0443\u0434 \u0441\u0443\u0434\u0430"),
]


@pytest.fixture(scope="module")
def one_form(spark):
    return Former(look_alikes(spark)).form


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(one_form, a, b):
    assert one_form(a) == one_form(b)


@pytest.mark.parametrize("a,b", [("prefet", "préfet"), ("a b", "a\nb"), ("Act", "act"), ("1", "l"), ("x2", "x²"), ("nº", "no"), ("море", "mope"), ("half ½", "half 1⁄2"), ("a b", "ab"), ("\u03c3", "o"), ("\u0131", "i"), ("שלום", "oy"), ("\u03bb\u03cc\u03b3\u03bf\u03c2", "logos")])
def test_other_look(one_form, a, b):
    assert one_form(a) != one_form(b)


def test_plain_stays(one_form):
    for t in ("", "plain ASCII\n", "Straße naïve — “x”", "море и суд", "του νόμου"):
        assert one_form(t) == t
    assert one_form(None) is None


def test_joiners_stay_where_they_shape(one_form):
    assert one_form("👨‍👩") == "👨‍👩"
    assert one_form("a‍b") == "ab"


def test_pairs(spark):
    texts = [(1, "court of appeal"), (2, "cоurt of appeal"), (3, "court of appeal"), (4, "court of appeal"), (5, None), (6, ""), (7, "​"), (8, " "), (9, "other"), (None, "court of appeal"), (2, "cоurt of appeal")]
    df = spark.createDataFrame([(i, t, "z", "c") for i, t in texts], "doc_id bigint, text string, form string, _id string")
    assert {tuple(r) for r in display_alike(df).collect()} == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)}
    forms = consistent_forms(df)
    assert forms.count() == len(texts) and {r.form for r in forms.collect()} == {"court of appeal", None, "", " ", "other"}
    assert display_alike(df.limit(0)).count() == 0


def test_long_text(spark):
    long = "a" * 300_000
    df = spark.createDataFrame([(1, long + " b"), (2, long + " b")], "doc_id bigint, text string")
    assert [tuple(r) for r in display_alike(df).collect()] == [(1, 2)]


MIXED = "aeiBC \r\nÄßĳĲŉſéαοеАӀօ\u0301\u0308\u200b\u200d\u00a0\u00adﬁＡ𝐚–“”‐‑µªºאה中"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(MIXED), st.characters(max_codepoint=0x2030, exclude_categories=["Cs"])), max_size=12))
def test_plain_texts_and_forms_are_fixed_points(one_form, text):
    """What the JVM takes for plain has that form in Python too, and a form is its own form."""
    import re

    form = one_form(text)
    if re.match(PLAIN.replace("\\x{", "\\U").replace("}", ""), text):
        assert form == re.sub("\r\n?", "\n", text)
    assert one_form(form) == form


def test_both_paths_give_one_form(spark, one_form):
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choice(MIXED) for _ in range(rng.randint(0, 8))) for _ in range(600)]
    texts += ["".join(chr(rng.choice([*range(0x20, 0x7F), *range(0xA0, 0x250), *range(0x2010, 0x2028)])) for _ in range(5)) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.form for r in consistent_forms(df).collect()} == {i: one_form(t) for i, t in enumerate(texts)}
