from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexquarry.llm import encoding as E
from lexquarry.llm.lexicon import Lexicon, compile_lexicon


def lexicon(tmp_path, words):
    p = tmp_path / "lexicon.bin"
    p.write_bytes(compile_lexicon(words))
    return Lexicon(str(p))


def test_lexicon_holds_its_words_only(tmp_path):
    words = {b"a": [1], b"ab": [2, 3], b"abc": [], b"cab": [4], b"dab": [4], b"\xc3\xa9": [9]}
    lex = lexicon(tmp_path, words)
    got = lex.lookup([*words, b"", b"b", b"abcd", b"ca", b"\xc3"])
    assert [None if x is None else np.frombuffer(x, np.int32).tolist() for x in got] == [*words.values(), None, None, None, None, None]
    assert len(lex.final) < sum(map(len, words)) + 1  # suffixes are shared


def test_empty_lexicon(tmp_path):
    assert lexicon(tmp_path, {}).lookup([b"a", b""]) == [None, None]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 50_000), max_size=3), max_size=40), st.lists(st.binary(max_size=7), max_size=20))
def test_lexicon_by_chance(tmp_path_factory, words, others):
    lex = lexicon(tmp_path_factory.mktemp("lex"), words)
    asked = [*words, *others]
    got = [None if x is None else np.frombuffer(x, np.int32).tolist() for x in lex.lookup(asked)]
    assert got == [words.get(w) if w else None for w in asked]


TEXTS = [
    None, "", " ", "a", "a b", "  a   b  ", "line\n\n  two\r\n\tthree ", "<|endoftext|> is text", "don't I'll we've", "naïve Ärger ünd ſ", "price 12,345.67 (net)", "日本語 テキスト", "⚖️ 📜",
    " x y​z", "\x1c a\x1d b", " a b ", "x" * 5000, " " * 3000 + "y", "the the the", "a b",
]


def test_ids_are_the_tokenizers(spark):
    df = spark.createDataFrame([(i, t, i, "c") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids int, _id string")
    got = {r.doc_id: r.ids for r in E.encode_corpus(df, words=5).collect()}
    want = {i: E.tokenizer().encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert got == want
    counts = {r.doc_id: r["size"] for r in E.token_counts(df, ["doc_id"]).collect()}
    assert counts == {i: len(w) for i, w in want.items()}


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id bigint, text string")
    assert E.encode_corpus(df).count() == 2
    assert E.encode_corpus(df.limit(0)).collect() == []
    assert E.encode_corpus(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).first().ids == []


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab \n\t\r  é1.!'s\x1c\x85　"), max_size=25))
def test_pieces_can_be_encoded_apart(text):
    exact = E.tokenizer().encode_ordinary
    first, *rest = E._cut.split(text)
    assert exact(first) + [i for p in rest for i in exact(" " + p)] == exact(text)


def test_frequent_pieces_count_all_rows(spark):
    df = spark.createDataFrame([("x a b",), ("y a",), (None,), ("z a b",)], "text string")
    assert E.frequent_pieces(df) == ["a", "b"]
    assert E.frequent_pieces(df, words=1) == ["a"]
    assert E.frequent_pieces(df, words=0) == []
