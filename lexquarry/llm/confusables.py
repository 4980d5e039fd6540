"""Visually identical text with different characters (problem 9).

A text is brought to one form in which texts that display alike are equal:

1. characters without a picture of their own (zero-width characters, soft
   hyphens, byte-order marks, bidi controls) are dropped; joiners stay between
   letters of scripts that they shape, and in emoji sequences;
2. every space separator becomes a plain space, every line end ``\\n``;
3. full-width, half-width, ligature, styled (mathematical) and non-breaking forms are
   replaced by their ordinary characters, and the result is composed (NFC);
4. each token's letters have *script sets*: the scripts in which a letter of that
   look exists, by the Unicode table of confusables (of the ICU library that Spark
   brings), for all its scripts.  The sets are intersected over the token.  A token
   that resolves to one script is respelled in it (a mixed-script confusable); one
   that resolves to several (a whole-script confusable) is respelled in the script
   that most letters of the text's resolved tokens have, Latin if there are none; one
   that resolves to none keeps its letters.  Accents stay on their letters, and the
   result is composed again.

Visible differences (a digit, a letter, an accent, case, a line break) survive.
Null stays null, an empty text stays empty.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import md5

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.storage import cut, ship, spread

# Letters that the table calls confusable although they differ to the eye (a tail, a missing dot, a missing arm).
DIFFER = "σ г ᴦ ι ı ɩ ɪ ꙇ ӏ"
# Characters that show nothing (first and last code point, hexadecimal).
INVISIBLE = "AD-AD 34F-34F 61C-61C 180B-180E 200B-200B 200E-200F 202A-202E 2060-2064 2066-206F FE00-FE0F FEFF-FEFF FFF9-FFFB E0000-E007F"
JOINERS = "\u200c\u200d"
LATIN = "LATIN"
#: From a letter to the letters of its look, by script.
Looks = dict[str, dict[str, str]]

_fold = {i: None for a, b in (r.split("-") for r in INVISIBLE.split()) for i in range(int(a, 16), int(b, 16) + 1)}
_fold |= {i: " " for i in range(0x80, 0x3001) if unicodedata.category(chr(i)) == "Zs"} | {0x2028: "\n", 0x2029: "\n", 0x85: "\n"}


def _ordinary(c: str) -> str:
    """The ordinary form of a full-width, half-width, ligature, styled or non-breaking character."""
    kind, _, rest = unicodedata.decomposition(c).partition(" ")
    keep = kind not in ("<wide>", "<narrow>", "<noBreak>", "<font>") and not (kind == "<compat>" and "LIGATURE" in unicodedata.name(c, ""))
    out = c if keep else "".join(chr(int(x, 16)) for x in rest.split())
    return "-" if out in ("‐", "‑") else out


_fold |= {i: x for i in range(0x80, 0x20000) if i not in _fold and not 0xD800 <= i < 0xE000 and (x := _ordinary(chr(i))) != chr(i)}


def _class(codes: Iterable[int]) -> str:
    """A regular-expression class of the code points, as ranges."""
    runs: list[list[int]] = []
    for c in sorted(codes):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]"


_to_fold = re.compile(_class(_fold))
_join = re.compile(f"[{JOINERS}]+")
_token = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")
_shaped = re.compile(r"[\u0600-\u08ff\u0900-\u0dff\u1000-\u109f\u1780-\u17ff\u2600-\u27bf\u2b00-\u2bff\U0001f000-\U0001faff\ufe0f]")


@lru_cache(200_000)
def script(c: str) -> str | None:
    """A letter's script as its Unicode name begins; None for signs that are no letters of a script."""
    name = unicodedata.name(c, "")
    return name.split(" ")[0] if " LETTER " in name else None


def look_alikes(spark: SparkSession) -> Looks:
    """The table: letters of one skeleton and one case that exist in several scripts.

    Only plain letters take part (accents are taken off before); skeletons that are
    digits or signs do not, as those differ to the eye.  Of several letters of one
    script the first in Unicode is the one to spell with.
    """
    letters = [c for c in map(chr, (*range(0x41, 0xD800), *range(0xF900, 0x20000))) if unicodedata.category(c) in ("Lu", "Ll", "Lo") and script(c) and ord(c) not in _fold and unicodedata.normalize("NFD", c) == c and c not in DIFFER]
    skeletons = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
    groups: dict[tuple[str, bool], dict[str, list[str]]] = {}
    for c, s in zip(letters, skeletons):
        if s and (s[0].isalpha() or not s.isascii()):
            groups.setdefault((s, unicodedata.category(c) == "Lu"), {}).setdefault(script(c), []).append(c)
    return {c: {s: cs[0] for s, cs in g.items()} for g in groups.values() if len(g) > 1 for cs in g.values() for c in cs}


class Former:
    """Brings texts to one form by a table of look-alikes."""

    #: Tokens that are remembered.
    KNOWN = 200_000

    def __init__(self, looks: Looks):
        self.looks = looks
        scripts = {s for g in looks.values() for s in g} - {LATIN}
        self.marked = re.compile(_class(i for i in (*range(0x250, 0xD800), *range(0xF900, 0x20000)) if script(chr(i)) in scripts))
        self.scripts = lru_cache(self.KNOWN)(self._scripts)
        self.spell = lru_cache(self.KNOWN)(self._spell)

    def _scripts(self, token: str) -> frozenset[str]:
        """The scripts in which every letter of the token has a look-alike."""
        found: frozenset[str] | None = None
        for c in unicodedata.normalize("NFD", token):
            if s := script(c):
                own = frozenset(self.looks.get(c, ())) | {s}
                found = own if found is None else found & own
        return found or frozenset()

    def _spell(self, token: str, to: str) -> str:
        plain = unicodedata.normalize("NFD", token)
        return unicodedata.normalize("NFC", "".join(c if script(c) in (to, None) else self.looks[c][to] for c in plain))

    def form(self, text: str | None) -> str | None:
        """The consistent form of one text; see the module's text."""
        if text is None:
            return None
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        if text.isascii():
            return text
        if _join.search(text):
            text = _join.sub(lambda m: m.group() if m.start() and _shaped.match(text[m.start() - 1]) and _shaped.match(text[m.end() : m.end() + 1]) else "", text)
        if _to_fold.search(text):
            text = _to_fold.sub(lambda m: _fold.get(ord(m.group())) or "", text)
        text = unicodedata.normalize("NFC", text)
        if not self.marked.search(text):
            return text
        votes: Counter[str] = Counter()
        for t in _token.findall(text):
            if len(s := self.scripts(t)) == 1:
                votes[next(iter(s))] += len(t)
        main = min(votes, key=lambda s: (-votes[s], s != LATIN, s), default=LATIN)

        def respell(m: re.Match) -> str:
            scripts = self.scripts(m.group())
            return self.spell(m.group(), main if main in scripts else LATIN if LATIN in scripts else min(scripts)) if scripts else m.group()

        return _token.sub(respell, text)


#: Texts made of these characters alone are already in their form, line ends apart: Latin letters and signs that are not folded.
PLAIN = "^" + re.sub(r"\\U([0-9a-f]{8})", r"\\x{\1}", _class([*range(0x80), *(i for i in (*range(0xA0, 0x250), *range(0x2010, 0x2028)) if i not in _fold)])) + "*$"
_visible = re.compile(r"[^\s\u2800\u3164]")


def _former(shipped: str) -> Former:
    with open(SparkFiles.get(shipped), encoding="utf-8") as f:
        return Former(json.load(f))


def _forms(batches: Iterator[pa.RecordBatch], shipped: str) -> Iterator[pa.RecordBatch]:
    form = _former(shipped).form
    for b in batches:
        forms = pa.array([form(t) for t in b.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns, forms], ["_id", "text", "form"])


def _digests(batches: Iterator[pa.RecordBatch], shipped: str) -> Iterator[pa.RecordBatch]:
    form = _former(shipped).form
    digest = lambda xs: pa.array([md5(x.encode("utf-8", "surrogatepass")).digest() for x in xs], pa.binary())
    for b in batches:
        texts = b.column(1).to_pylist()
        forms = [form(t) for t in texts]
        seen = pa.array([bool(_visible.search(f)) for f in forms], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0), digest(forms), digest(texts)], ["_id", "_form", "_text"]).filter(seen)


def _table(spark: SparkSession) -> str:
    return ship(spark, json.dumps(look_alikes(spark), sort_keys=True).encode(), "looks")


def _split(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, str]:
    rows = spread(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")))
    plain = F.col("text").rlike(PLAIN)
    return rows.where(plain | F.col("text").isNull()), rows.where(~plain), dict(rows.dtypes)["_id"]


def consistent_forms(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, form)`` of every row: texts of plain characters stay inside the JVM, the rest goes through Arrow once.

    A null text has a null form; rows are neither dropped nor merged.
    """
    plain, rest, kind = _split(df, id_col, text_col)
    plain = plain.withColumn("form", F.regexp_replace("text", "\r\n?", "\n"))
    shipped = _table(df.sparkSession)
    rest = rest.mapInArrow(lambda it: _forms(it, shipped), f"_id {kind}, text string, form string")
    return plain.unionByName(rest).select(F.col("_id").alias(id_col), "text", "form")


def display_alike(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs ``(a, b)`` of rows whose texts display alike although their characters differ.

    Rows are grouped by a 128-bit digest of their form; texts of which nothing is
    visible take no part.  Each row is paired with the first row of every *other*
    spelling of its class, so exact copies cost one pair each and no spelling loses
    its link to another.  Repeated ids give one pair; null ids take no part.
    """
    plain, rest, kind = _split(df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()), id_col, text_col)
    form = F.regexp_replace("text", "\r\n?", "\n")
    plain = plain.where(F.col("text").rlike(r"[^\s]")).select("_id", F.unhex(F.md5(form)).alias("_form"), F.unhex(F.md5("text")).alias("_text"))
    shipped = _table(df.sparkSession)
    keys = cut(plain.unionByName(rest.mapInArrow(lambda it: _digests(it, shipped), f"_id {kind}, _form binary, _text binary")))
    spellings = keys.groupBy("_form", "_text").agg(F.min("_id").alias("_first"))
    classes = spellings.groupBy("_form").agg(F.count("*").alias("_k")).where("_k > 1")
    some = cut(spellings.join(classes, "_form", "left_semi"))
    rows = keys.join(some.select("_form").distinct(), "_form", "left_semi")
    other = some.select("_form", F.col("_text").alias("_other"), "_first")
    pairs = rows.join(other, "_form").where(F.col("_text") != F.col("_other"))
    a, b = F.least("_id", "_first"), F.greatest("_id", "_first")
    return pairs.select(a.alias("a"), b.alias("b")).where("a <> b").distinct()
