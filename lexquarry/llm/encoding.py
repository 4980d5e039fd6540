"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 7).

The tokenizer's pattern always begins a new token at a space that precedes a
character which is no white space, so a text is cut there into *pieces* whose ids
are independent of each other.  One pass counts all pieces of the corpus; the most
frequent ones are compiled, with their ids, into a minimal acyclic transducer
(``lexicon``) that every worker memory-maps.  A second pass looks each batch's
distinct pieces up in it; pieces that it doesn't hold are merged exactly by the
tokenizer.  The lexicon's size changes the speed, never an id.

Null and empty texts have an empty list of ids.  Strings that look like special
tokens are ordinary text.  Rows are neither dropped nor merged.
"""

from __future__ import annotations

import base64
import importlib.util
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.lexicon import Lexicon, compile_lexicon
from lexquarry.skew import most_frequent
from lexquarry.storage import cut, ship, spread

#: Where the vocabulary files are; a worker uses the installed package if the folder isn't there.
TOKENIZERS = "/opt/tokenizers"
#: Most words of the lexicon: the bound of what the driver collects and ships (about 3 MB).
LEXICON_WORDS = 65_536
#: Longest piece that may enter the lexicon, in characters.
LEXICON_CHARS = 48
#: Pieces a worker remembers between batches.
REMEMBERED = 400_000

_cut = re.compile(r" (?=\S)")
# Fixed value: the pre-tokenization pattern of the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def tokenizer(name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """The exact tokenizer, without special tokens."""
    import tiktoken

    path = Path(folder, f"{name}.tiktoken")
    if not path.exists():
        path = Path(importlib.util.find_spec("public_tokenizers").origin).parent / f"{name}.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, path.read_bytes().splitlines())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        words = [w for w in seen if len(w) <= LEXICON_CHARS]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], ["piece", "n"])

    for b in batches:
        for t in b.column(0).to_pylist():
            if t:
                seen.update(_cut.split(t)[1:])
        if len(seen) > REMEMBERED:
            yield out()
            seen.clear()
    yield out()


def frequent_pieces(df: DataFrame, text_col: str = "text", words: int = LEXICON_WORDS) -> list[str]:
    """The most frequent pieces of all texts that occur twice or more, each without its leading space."""
    counted = spread(df.select(text_col)).mapInArrow(_count, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    return sorted(r.piece for r in most_frequent(cut(counted.where("n > 1")), words))


def build_lexicon(df: DataFrame, text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, words: int = LEXICON_WORDS) -> str:
    """Count, compile and ship the lexicon of ``df``'s texts; the name of the shipped file."""
    pieces = frequent_pieces(df, text_col, words)
    encode = tokenizer(name, folder).encode_ordinary
    payload = compile_lexicon({p.encode(): encode(" " + p) for p in pieces})
    return ship(df.sparkSession, payload, "lexicon")


def encoder(lexicon: str, name: str, folder: str) -> Callable[[list[str | None]], list[bytes]]:
    """A function from texts to their ids as int32 bytes, for one worker."""
    exact = tokenizer(name, folder).encode_ordinary
    known = Lexicon(SparkFiles.get(lexicon))
    memo: dict[str, bytes] = {}

    def merge(piece: str) -> bytes:
        return np.asarray(exact(piece), np.int32).tobytes()

    def encode(texts: list[str | None]) -> list[bytes]:
        split = [_cut.split(t) if t else None for t in texts]
        if len(memo) > REMEMBERED:
            memo.clear()
        new = list(set(chain.from_iterable(s[1:] for s in split if s)).difference(memo))
        for piece, ids in zip(new, known.lookup([p.encode() for p in new])):
            memo[piece] = merge(" " + piece) if ids is None else ids
        get = memo.__getitem__
        return [b"" if s is None else merge(s[0]) + b"".join(map(get, s[1:])) for s in split]

    return encode


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, words: int = LEXICON_WORDS) -> DataFrame:
    """``(id, ids array<int>)`` of every row."""
    lexicon = build_lexicon(df, text_col, name, folder, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(lexicon, name, folder)
        for b in batches:
            ids = encode(b.column(1).to_pylist())
            starts = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int64)
            for lo, hi in _spans(starts):
                values = pa.array(np.frombuffer(b"".join(ids[lo:hi]), np.int32))
                lists = pa.ListArray.from_arrays(pa.array((starts[lo : hi + 1] - starts[lo]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists], ["_id", "ids"])

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col))
    return spread(rows).mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, ids array<int>").withColumnRenamed("_id", id_col)


def _spans(starts: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``most`` ids each (a longer row by itself)."""
    lo, n = 0, len(starts) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def token_counts(df: DataFrame, keep: list[str], text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, words: int = LEXICON_WORDS) -> DataFrame:
    """The columns ``keep`` of every row and ``size``, the number of ids of its text."""
    lexicon = build_lexicon(df, text_col, name, folder, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(lexicon, name, folder)
        for b in batches:
            sizes = [len(x) // 4 for x in encode(b.column(b.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.int64())], [*keep, "size"])

    rows = df.select(*(F.col(c) for c in keep), F.col(text_col).alias("_text"))
    types = dict(rows.dtypes)
    return spread(rows).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", size bigint")
