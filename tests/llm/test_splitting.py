from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lexquarry.llm import splitting as S


def check(text, most, overlap):
    got = S.pieces(text, most, overlap)
    words = text.split()
    if len(words) <= most:
        assert got == []
        return
    back = []
    for k, (no, piece, n, again) in enumerate(got):
        w = piece.split()
        assert no == k + 1 and len(w) == n <= most and again <= overlap and (k or not again)
        assert k == 0 or w[:again] == back[len(back) - again :]
        assert piece in text
        back += w[again:]
    assert back == words


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.integers(6, 30), st.integers(0, 2))
def test_pieces_cover_the_text(seed, most, overlap):
    rng = random.Random(seed)
    text = "".join(rng.choice(["w", "word", "end.", "No.", "5.", "A.", "x!"]) + rng.choice([" ", " ", " ", "\n", "\n\n", "  "]) for _ in range(rng.randint(0, 300)))
    check(text, most, overlap)


def greedy(sentence, paragraph, most, overlap):
    """The same cuts one after the other."""
    n, at, out = len(sentence) - 1, 0, []
    while at < n:
        start = next((i for i in range(max(at - overlap, 0), at) if sentence[i] or i == 0), at) if at else 0
        reach = min(start + most, n)
        ends = [i for i in range(at + 1, reach + 1) if paragraph[i] and i > start + most // 2]
        stops = [i for i in range(at + 1, reach + 1) if sentence[i]]
        end = n if reach == n else ends[-1] if ends else stops[-1] if stops else reach
        out.append((start, end))
        at = end
    return out


def test_doubling_equals_greedy():
    rng = random.Random(9)
    for _ in range(60):
        text = " ".join(rng.choice(["a", "b", "c.", "d?\n\n", "e\n"]) for _ in range(rng.randint(1, 400)))
        _, _, s, p = S.boundaries(text)
        a, b = S.cuts(s, p, 20, 5)
        assert list(zip(a.tolist(), b.tolist())) == greedy(s, p, 20, 5)


def test_boundaries():
    _, _, s, p = S.boundaries("1. Title here\nOne two. See No. 5 of A. B. Smith. Next\n\nnew par")
    words = "1. Title here One two. See No. 5 of A. B. Smith. Next new par".split()
    assert [words[i - 1] for i in range(1, len(words)) if s[i]] == ["two.", "Smith.", "Next"]
    assert [words[i - 1] for i in range(1, len(words)) if p[i]] == ["Next"]


def test_rows(spark):
    long = " ".join(["word."] * 1300)
    rows = [(1, long), (2, None), (3, ""), (4, " ".join(["w"] * 600)), (5, " ".join(["w"] * 601)), (6, "x" * 100_000), (1, long)]
    df = spark.createDataFrame([(o, t, "p", 3) for o, t in rows], "ord bigint, text string, piece string, words int")
    got = S.split_oversized(df, ["ord"])
    assert {r.ord for r in got.collect()} == {1, 5}
    assert sorted(r.piece for r in got.where("ord = 1").collect()) == [1, 1, 2, 2, 3, 3]
    assert S.split_oversized(df.limit(0), ["ord"]).count() == 0
