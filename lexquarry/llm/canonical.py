"""Mapping free-entered values to a canonical list (problem 2).

Canonical names of legal instruments and their aliases are the patterns of one
Aho-Corasick automaton.  Values, and whole texts, are brought to plain words and run
through it once; mentions may stand anywhere, the longest that don't reach into each
other win, and the kind and year said behind a mention must fit.  A value without a
mention that fits goes to token-set similarity: its words are matched, in any order,
with the words of the canonical names, allowing for typing errors, abbreviations and
missing plural endings, and for a missing or additional word in four.  An inverted
index finds the names to compare.  Neither names nor texts have a greatest length.

A stated year that differs, another kind of instrument, and an amending instrument
as against the one it amends are never the same.  A value that could be two entries
alike, or none, is reported with ``NONE``.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.spelling import Trie, edits
from lexquarry.storage import spread

#: What a value without an entry gets.
NONE = -1
#: Most rows of a canonical list: it is collected and sent to every worker.
MOST_ENTRIES = 200_000
#: Share of the words of a value, and of a name, that must be matched for the two to be similar: up to three words all, of four to seven all but one.
SHARE = 0.75
#: Stands in a plain text where a cited name begins.
MARK = "\x01"

# Kinds of instruments and the ways they are written.
KINDS = {
    "act": "act acts a",
    "ordinance": "ordinance ordinances ord ordce ordn ordnce ordin",
    "rules": "rules rule rls r",
    "regulations": "regulations regulation regs reg regns regn rgs r",
    "code": "code codes cd",
}
AMENDING = "amendment amendments amend amdt amd amending"
NOISE = "copy of the final updated ocr new old scan scanned draft version no pdf and"
_kinds = defaultdict(set)
for _k, _v in KINDS.items():
    for _w in _v.split():
        _kinds[_w].add(_k)
_amending, _noise, _small = frozenset(AMENDING.split()), frozenset(NOISE.split()), frozenset(("of", "the", "and"))
_year = re.compile(r"^(?:1[789]|20)\d\d$")
_token = re.compile(r"[^\W_]+(?:[-'][^\W\d_]+)*")
_dotted = re.compile(r"\b((?:[^\W\d_]\.){2,})(?=[\s,_(-]|$)|\b((?:[^\W\d_]\. ){2,})")
_gap = re.compile(rf"[^\w{MARK}]+")
_number = re.compile(r"\b(no\.?)[\s_]+[ivxlc\d]+\b")


class Value:
    """A value taken apart: words, kinds of instrument it may be, whether it amends, its year.

    ``full`` has the words of the name as they stand, ``words`` those that count: of a
    ``listed`` name all but articles and the like, of others not the remarks of typists.
    """

    def __init__(self, text: str, listed: bool = False):
        s = _dotted.sub(lambda m: m.group().replace(".", "").replace(" ", "") + " ", text.replace("_", " ").lower())
        s = _number.sub(" ", s)
        tokens = [t for t in _token.findall(s) if not (t.isdigit() and not _year.match(t))]
        years = [t for t in tokens if _year.match(t)]
        self.year = int(years[-1]) if years else None
        words = [t for t in tokens if not _year.match(t)]
        self.kinds: set[str] = set()
        at = next((i for i in range(len(words) - 1, -1, -1) if words[i] in _kinds and len(words[i]) > 1), None)
        if at is None:
            at = next((i for i in range(len(words) - 1, 0, -1) if words[i] in _kinds), None)
        if at is None:
            at = next((i for i in range(len(words) - 1, -1, -1) if len(words[i]) > 3 and any(edits(words[i], k, 1) < 2 for k in KINDS)), None)
            if at is not None:
                self.kinds = {k for k in KINDS if edits(words[at], k, 1) < 2}
        else:
            self.kinds = set(_kinds[words[at]])
        if at is not None:
            tail = [w for w in words[at + 1 :] if w in _amending]
            words = words[:at] + tail
        self.amends = any(amending(w) for w in words)
        self.full = [w for w in words if not amending(w)]
        self.words = [w for w in self.full if w not in (_small if listed else _noise)]


def amending(word: str) -> bool:
    return word in _amending or len(word) > 6 and edits(word, "amendment", 2) < 3


def plain(text: str) -> str:
    """Words in lower case with one space between and at both ends; ``MARK`` stays."""
    return " " + _gap.sub(" ", text.lower().replace("_", " ")).strip() + " "


@lru_cache(100_000)
def kinds_of(word: str) -> frozenset[str]:
    """The kinds of instrument that a word may say; a longer one may be mistyped."""
    if word in _kinds:
        return frozenset(_kinds[word])
    return frozenset(k for k in KINDS if edits(word, k, 1) < 2) if len(word) > 3 else frozenset()


def tail(words: list[str]) -> tuple[frozenset[str], bool, int | None]:
    """What stands behind the words of a name: the kinds it may be, whether it amends, its year."""
    at, amends = 0, False
    while at < len(words) and amending(words[at]):
        at, amends = at + 1, True
    kinds = kinds_of(words[at]) if at < len(words) else frozenset()
    at += 1
    while at < len(words) and words[at] in _amending:
        at, amends = at + 1, True
    if words[at : at + 1] == ["no"]:
        at += 2
    if words[at : at + 1] == ["of"]:
        at += 1
    return kinds, amends, int(words[at]) if at < len(words) and _year.match(words[at]) else None


class Canon:
    """The canonical list, ready to map values.

    The automaton's patterns are the names' words as they stand, turned round (all
    orders of up to three words, the rotations of more) and shortened to initials; kind
    and year are read behind a match, so their many spellings need no patterns.
    """

    def __init__(self, entries: list[tuple[int, str]]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        self.entries: list[tuple[int, tuple[str, ...], frozenset[str], bool, int | None]] = []
        aliases: dict[str, set[int]] = defaultdict(set)
        self.having: dict[str, list[int]] = defaultdict(list)
        for i, name in entries:
            v = Value(name, listed=True)
            if not v.words:
                continue
            n = len(self.entries)
            self.entries.append((i, tuple(v.words), frozenset(v.kinds), v.amends, v.year))
            forms = list(permutations(v.words)) if len(v.words) < 4 else [(*v.words[k:], *v.words[:k]) for k in range(len(v.words))]
            if len(v.words) > 1:
                initials = [w[0] for w in v.words]
                forms += [initials, ["".join(initials)]]
            for f in (*forms, v.full):
                aliases[plain(" ".join(f))].add(n)
            for w in set(v.words):
                self.having[w].append(n)
        for a, ids in aliases.items():
            self.auto.add_word(a, (len(a), tuple(sorted(ids))))
        self.auto.make_automaton()
        self.trie = Trie(self.having)
        self.near = lru_cache(500_000)(self._near)
        self.map = lru_cache(500_000)(self._map)

    def _near(self, word: str) -> dict[str, float]:
        """Canonical words that ``word`` may stand for, with the cost of taking it so."""
        out: dict[str, float] = {}
        if word in self.having:
            out[word] = 0.0
        if len(word) < 3:
            return out
        for w, n in self.trie.begun(word, 2 if len(word) > 4 else 1 if len(word) > 3 else 0):
            if w == word:
                continue
            if w.startswith(word):
                out[w] = 0.2 if len(w) - len(word) < 2 else 0.5
            elif (k := edits(word, w, 2)) <= (2 if len(w) > 6 else 1):
                out[w] = 1.0 * k
            elif n < 2 and len(word) > 4 and len(w) > len(word) and edits(word, w[: len(word)], 1) < 2:
                out[w] = 1.3
        return out

    def spans(self, text: str) -> list[tuple[int, int, tuple[int, ...]]]:
        """``(begin, end, entries)`` of the names found in a plain text: from left to right the longest, none reaching into another."""
        out: list[tuple[int, int, tuple[int, ...]]] = []
        hits = sorted((end - size + 1, -end, ids) for end, (size, ids) in self.auto.iter(text)) if len(self.auto) else []
        for begin, end, ids in hits:
            if not out or begin >= out[-1][1]:  # two names may share the space between them
                out.append((begin, -end, ids))
        return out

    def _fitting(self, ids: tuple[int, ...], kinds: frozenset[str], amends: bool, year: int | None) -> set[int]:
        return {e[0] for n in ids if (e := self.entries[n])[3] == amends and e[2] & kinds and not (year and e[4] and year != e[4])}

    def named(self, text: str, spans: list[tuple[int, int, tuple[int, ...]]]) -> set[int]:
        """Entries of the longest of the spans of a plain text behind which a kind of instrument stands that fits."""
        best, who = 0, set()
        for begin, end, ids in spans:
            got = self._fitting(ids, *tail(text[end + 1 : end + 200].split()[:10]))
            if got and end - begin > best:
                best, who = end - begin, got
        return who

    def similar(self, v: Value) -> set[int]:
        """Entries of the best token-set similarity.

        Each word is matched once, in any order; ``SHARE`` of the words of both sides
        must be.  Fewer unmatched words are better, then cheaper matches.  An inverted
        index from words to entries is asked for the value's rarest words only, as one
        of them must be matched.
        """
        need = math.ceil(SHARE * len(v.words))
        near = sorted(((self.near(w), w) for w in v.words), key=lambda x: sum(len(self.having[c]) for c in x[0]))
        found = {n for m, _ in near[: len(near) - need + 1] for c in m for n in self.having[c]}
        best, who = (len(v.words), 0.0), set()
        for n in found:
            i, words, kinds, amends, year = self.entries[n]
            if amends != v.amends or not kinds & v.kinds or v.year and year and v.year != year:
                continue
            left, cost = _matched([m for m, _ in near], words)
            if left > (1 - SHARE) * max(len(words), len(near)):
                continue
            score = (left, round(cost, 6))
            if score < best or score == best and not who:
                best, who = score, {i}
            elif score == best:
                who.add(i)
        return who

    def _map(self, text: str) -> int:
        """The entry of one value: a name in it, else the most similar."""
        said = plain(text)
        hits = self.named(said, self.spans(said))
        if not hits:
            v = Value(text)
            hits = self.similar(v) if v.words and v.kinds else set()
        return hits.pop() if len(hits) == 1 else NONE

    def cited(self, text: str) -> Iterator[tuple[str, int]]:
        """``(name, entry)`` of every instrument that a text cites: one run of the automaton over the whole text."""
        names = [(at, name) for at, name in citations(text) if name]
        if not names:
            return
        cuts = [0, *(at for at, _ in names), len(text)]
        said = plain(f" {MARK} ".join(text[a:b] for a, b in zip(cuts, cuts[1:])))
        spans = self.spans(said)
        at = k = 0
        for _, name in names:
            at = said.index(MARK, at) + 1
            stop = at + len(plain(name))
            while k < len(spans) and spans[k][0] < at:
                k += 1
            inside = []
            for s in spans[k:]:
                if s[0] >= stop:
                    break
                inside.append(s)
            hits = self.named(said, inside)
            yield name, (next(iter(hits)) if len(hits) == 1 else NONE) if hits else self.map(name)


def _matched(near: list[dict[str, float]], words: tuple[str, ...]) -> tuple[int, float]:
    """Words of the longer side left over by the cheapest matching, and its cost."""
    pairs = sorted((cost, i, j) for i, m in enumerate(near) for j, w in enumerate(words) if (cost := m.get(w)) is not None)
    mine, theirs, total = set(), set(), 0.0
    for cost, i, j in pairs:
        if i not in mine and j not in theirs:
            mine.add(i)
            theirs.add(j)
            total += cost
    return max(len(near), len(words)) - len(mine), total


# How a section is cited before the name of its instrument, and how a headnote begins.
CITED = re.compile(r"(?i)\b(?:sections?|ss?\.)\s*\d+[A-Za-z]{0,2}(?:\s*\(\w+\))*(?:\s*(?:,|and|or|to|&)\s*(?:and\s+)?\d+[A-Za-z]{0,2}(?:\s*\(\w+\))*)*\s*,?\s+of\s+the\s+")
HEADNOTE = re.compile(r"(?m)^[ \t]*\([a-z]\)[ \t]+(?=([^\n]+?)-{2,3}\s*(?i:ss?\.|sections?))")
_kind_word = r"(?:acts?|a\.|ordinances?|ord\.|ordce\.?|ordn\.|rules?|rls\.?|r\.|regulations?|regs\.?|reg\.|regns?\.?|codes?)"
_named = re.compile(rf"(?i)(?<=[\s)_]){_kind_word}(?!\w)(?:\s*\((?:amendment|amend|amdt)\.?\))?(?:[\s,]*no\.?\s*[ivxlc\d]+)?(?:[\s,–-]*(?:of\s+)?(?:1[789]|20)\d\d\b)?")
# Words that no instrument's name holds, but as its first word, where they may be initials; with marks of a clause, a blank line or the end of a sentence they end the place where a name may stand.
NO_NAME = "which who whom whose that shall may must will would can could should is are was were be been has have had does did if unless where when while because whether by from under this these those he she they it any every"
_clause = re.compile(rf"(?i)[;:!?]|\n\s*\n|(?<=\w{{8}})\.(?=\s+(?-i:[A-Z]))|\b(?:{'|'.join(NO_NAME.split())})\b")
_first = re.compile(r"\w*")
_said = re.compile(r"(?i)(?:said|same|aforesaid)\b")


def name_at(text: str, at: int = 0) -> str | None:
    """The instrument's name that ``text`` has at ``at``, up to its kind and year; None if the clause there names none."""
    if _said.match(text, at):
        return None
    end = _clause.search(text, _first.match(text, at).end())
    m = _named.search(text, at + 1, end.start() if end else len(text))
    return re.sub(r"\s+", " ", text[at : m.end()]).strip() if m and text[at : m.start()].strip() else None


def citations(text: str) -> list[tuple[int, str | None]]:
    """Where the names of cited instruments begin, and the names."""
    found = {m.end(): name_at(text, m.end()) for m in CITED.finditer(text)}
    found |= {m.end(): re.sub(r"\s+", " ", m.group(1)).strip() for m in HEADNOTE.finditer(text)}
    return sorted(found.items())


def file_title(name: str) -> str:
    """A typed file name without extension, numbers of copies, ids and remarks."""
    s = re.sub(r"(?i)\.(?:pdf|docx?|txt)$", "", name.replace("_", " ")).strip()
    s = re.sub(r"(?i)[\[(]?\b\d{6,}\b[\])]?", " ", s)
    s = re.sub(r"(?i)\(\d+\)\s*(?=updated|$)|\(\d+\)$", " ", s)
    s = re.sub(r"(?i)[\s-]+(?:final|updated|ocr|amd|scan(?:ned)?|draft|copy)\b", " ", s)
    s = re.sub(r"(?i)^\s*(?:copy of\s+|the\s+|new\s+)+", "", s.strip(" -"))
    return s.strip(" -")


def _link(batches: Iterator[pa.RecordBatch], entries: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
    canon = Canon(entries)
    for b in batches:
        rows = []
        for f, i, s in zip(*(b.column(k).to_pylist() for k in range(3))):
            if f == "text":
                rows += [(f, i, name, entry) for name, entry in canon.cited(s)]
            elif name := file_title(s) if f == "doc" else re.sub(r"\s+", " ", s).strip():
                rows.append((f, i, name, canon.map(name)))
        cols = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.int64())], ["field", "item", "value", "entry"])


def link_values(values: DataFrame, canon: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """``(field, item, value, entry)`` for values ``(field, item, said)``.

    ``field`` is ``doc`` (``said`` is a file name), ``text`` (a whole text, of which each
    cited instrument gives a row) or anything else (a plain value).  The canonical list
    is collected: its size is checked against ``MOST_ENTRIES``.  Null values give no
    row, and empty ones neither.
    """
    rows = canon.where(F.col(id_col).isNotNull() & F.col(name_col).isNotNull()).select(F.col(id_col).cast("bigint"), name_col).distinct().orderBy(id_col, name_col).limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} canonical names")
    entries = [tuple(r) for r in rows]
    kept = values.where("said is not null and item is not null").select("field", "item", "said")
    return kept.mapInArrow(lambda it: _link(it, entries), "field string, item string, value string, entry bigint")


#: Texts that may cite an instrument at all: the rest needs no Python.
MAY_CITE = r"(?i)\bs(?:s?\.|ections?)\s*\d|--\s*s"


def instruments(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every legislation file name and every instrument cited in a chunk's text, ``(field, item, value, entry)``."""
    law = F.lower("doc_type").isin("statute", "rules", "amendment")
    docs = chunks.where(law & F.col("doc").isNotNull()).select(F.lit("doc").alias("field"), F.col("doc").alias("item"), F.col("doc").alias("said")).distinct()
    texts = spread(chunks.select("chunk_id", "text")).where(F.col("text").rlike(MAY_CITE)).select(F.lit("text").alias("field"), F.col("chunk_id").alias("item"), F.col("text").alias("said"))
    return link_values(docs.unionByName(texts), catalog, "act_id", "act_name")
