"""Splitting oversized texts at natural boundaries by pointer doubling (problem 6).

Within a text every word offset is a possible cut.  ``back[c]`` is where a piece
that follows a cut at ``c`` begins: the earliest sentence start that repeats at most
``overlap`` words, ``c`` itself where there is none.  ``next[c]`` is the farthest
legal cut after ``c``: the last paragraph end within ``most`` words of ``back[c]``
that still moves the piece at least half way, else the last sentence end in reach,
else the hard limit.  Squaring the table ``next`` again and again marks all cuts
of the greedy division in a logarithmic number of whole-array steps.

Words are maximal runs of characters other than white space.  Null texts, and texts
of at most ``most`` words, give no pieces (they are not oversized).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.storage import spread

_word = re.compile(r"\S+")
_end = re.compile(r"""[.!?。！？][)\]"'’”»]*$""")
# Abbreviations after which a full stop ends no sentence.
SHORT = frozenset("no. nos. s. ss. art. v. vs. mr. mrs. ms. dr. st. co. ltd. pvt. cl. sec. para. i.e. e.g. etc. viz. cf. vol. p. pp. r. j. c.j.".split())
_initial = re.compile(r"^[(\"']?(?:[A-Z]\.)+$")


_number = re.compile(r"^[(\[]?[0-9IVXivx]+[A-Za-z]?[.)\]]+$")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last character of each word, and for each word offset whether a sentence, a paragraph ends before it."""
    spans = [m.span() for m in _word.finditer(text)]
    n = len(spans)
    first = np.fromiter((a for a, _ in spans), np.int64, n)
    last = np.fromiter((b for _, b in spans), np.int64, n)
    sentence, paragraph = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    for i in range(1, n):
        gap = text[spans[i - 1][1] : spans[i][0]]
        paragraph[i] = gap.count("\n") > 1 or " " in gap
        w = text[spans[i - 1][0] : spans[i - 1][1]]
        head = i == 1 or "\n" in text[spans[i - 2][1] : spans[i - 1][0]]
        sentence[i] = paragraph[i] or bool(_end.search(w)) and w.lower() not in SHORT and not _initial.match(w) and not (head and _number.match(w))
    sentence[n:] = paragraph[n:] = True
    return first, last, sentence, paragraph


def cuts(sentence: np.ndarray, paragraph: np.ndarray, most: int = 600, overlap: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Start and end word offsets of the pieces."""
    n = len(sentence) - 1
    offsets = np.arange(n + 1)
    starts = np.flatnonzero(sentence)
    starts = np.concatenate(([0], starts)) if not len(starts) or starts[0] else starts
    at = np.searchsorted(starts, np.maximum(offsets - overlap, 0), "left")
    back = np.where(starts[np.minimum(at, len(starts) - 1)] < offsets, starts[np.minimum(at, len(starts) - 1)], offsets)
    back = np.where((offsets == 0) | (offsets == n), offsets, back)
    reach = np.minimum(back + most, n)

    def before(marks: np.ndarray) -> np.ndarray:
        """The last marked offset not beyond ``reach``, or -1."""
        return np.concatenate((marks, [-1]))[np.searchsorted(marks, reach, "right") - 1]

    p, s = before(np.flatnonzero(paragraph)), before(np.flatnonzero(sentence))
    nxt = np.where(p > np.maximum(offsets, back + most // 2), p, np.where(s > offsets, s, reach))
    nxt = np.where(reach == n, n, nxt)
    hit = np.zeros(n + 1, bool)
    hit[0] = True
    while not hit[n]:
        hit[nxt[hit]] = True
        nxt = nxt[nxt]
    ends = np.flatnonzero(hit)
    return back[ends[:-1]], ends[1:]


def pieces(text: str, most: int = 600, overlap: int = 60) -> list[tuple[int, str, int, int]]:
    """``(piece number from 1, text, words, words repeated)`` of one oversized text."""
    first, last, sentence, paragraph = boundaries(text)
    if len(first) <= most:
        return []
    a, b = cuts(sentence, paragraph, most, overlap)
    return [(k + 1, text[first[x] : last[y - 1]], int(y - x), int(b[k - 1] - x) if k else 0) for k, (x, y) in enumerate(zip(a, b))]


def split_oversized(df: DataFrame, keep: list[str], text_col: str = "text", most: int = 600, overlap: int = 60) -> DataFrame:
    """Numbered pieces ``(*keep, piece, piece_text, words, repeated)`` of the rows with more than ``most`` words."""
    if not 0 <= overlap < most // 2:
        raise ValueError("the overlap must be under half of the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if not (got := pieces(t, most, overlap)):
                    continue
                row = [b.column(k).take(pa.array([i] * len(got), pa.int64())) for k in range(b.num_columns - 1)]
                no, text, words, again = zip(*got)
                yield pa.RecordBatch.from_arrays([*row, pa.array(no, pa.int32()), pa.array(text, pa.string()), pa.array(words, pa.int32()), pa.array(again, pa.int32())], [*keep, "piece", "piece_text", "words", "repeated"])

    rows = df.where(F.length(text_col) > 2 * most).select(*(F.col(c) for c in keep), F.col(text_col).alias("_text"))
    types = dict(rows.dtypes)
    return spread(rows).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", piece int, piece_text string, words int, repeated int")
