"""Noise in text from scanned pages (problem 4).

One pass over all documents counts the corpus's words (the two halves of a word that a
line's end cuts are none) and the lines at page edges.  With the whole counted
vocabulary, looked up in memory-mapped tables of any size, each document is then read
by itself:

* *furniture*: lines are peeled off the top and bottom of each page as long as they
  are page numbers that fit the document's sequence, or headers: lines that repeat,
  up to a few misread characters, at the edges of other pages of the document, that
  carry its title, or that many documents have at their edges, and far oftener there
  than inside pages;
* *broken*: the last word of a line of running text is cut if, joined with the first
  word of the next such line (perhaps on the next page), it is a word of the corpus.
  A compound that is divided at its own hyphen is kept;
* *misread*: a rare word that becomes a far more frequent one by undoing confusions
  of the eye (``rn`` for ``m``, ``1`` for ``l``).

Running text is joined into paragraphs, with cut words rejoined and misread ones put
right.  ``needs_ocr`` is not relied on.  Null or empty pages give no lines; where a
document has no pages its text is taken as one page for the repaired paragraphs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.spelling import edits
from lexquarry.lookup import Shipped, Table, hash_of, hashed, ship_table
from lexquarry.storage import cut, spread

#: How often a corpus word must occur, and how much oftener than its misread form (a word of up to three letters).
KNOWN, OFTENER, OFTENER_SHORT = 5, 10, 40
#: Documents that must share an edge line, at least, for it to be furniture anywhere, and how many lines may be taken for such by chance in a whole corpus.
SHARED, BY_CHANCE = 4, 1.0
#: What counts as the edge of a page, in lines with text, and the longest line that may be a header.
EDGE, HEADER = 3, 160
#: Words of a line, the rarest, by which lines like it are looked up: two edits leave one of five words as it is.
PROBES = 5

# What is read for what (misread form, true form).
CONFUSED = """
cl d, d cl, ii u, u ii, rn m, m rn, c e, e c, @ a, 1 l, 1 i, l i, i l, l 1, + t, 5 s, s 5, 0 o, o 0, 6 b, b 6, 8 b, f t, t f,
u n, n u, h b, b h, o c, c o, vv w, w vv, li h, h li, ri n, nn m, 9 g, g 9, q g, 3 e, $ s, | l, ! l, ! i, fi h, tl d, in m, ni m
"""
_confused = [tuple(x.split()) for x in CONFUSED.split(",")]
_outer = ".,;:()[]{}\"'“”‘’?—–"
MARKS = "-‐­¬"
_digit = re.compile(r"\d")
_cut = re.compile(rf"^(.*?)([{MARKS}])\s*$", re.S)
_number = re.compile(r"(?i)^([\s\-–—\[\](){}|.]*(?:p\s*[ao]\s*g\s*[ec]|pg?\.?)?\s*)([0-9lioszb]{1,5}|[0-9](?: [0-9]){1,4}|[ivxlcdm]+)(\s*(?:of|/)\s*[0-9lioszb]+)?([\s\-–—\[\](){}|]*)$")
_edge_numbers = re.compile(r"(?i)^[\s\[({|–—-]*(?:\d{1,5}|[ivxlc]{1,8})[\s\])}|–—-]{2,}(?=\S)|[\s\[({|–—-]{2,}(?:\d{1,5}|[ivxlc]{1,8})[\s\])}|–—-]*$")
_roman = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def _value(said: str) -> int | None:
    """The number of a page, arabic (misread letters allowed) or roman."""
    s = said.lower().replace(" ", "")
    if any(ch.isdigit() for ch in s):
        s = s.translate(str.maketrans("lioszb", "110526"))
        return int(s) if s.isdigit() else None
    if not re.fullmatch(r"m*(?:c[md]|d?c{0,4})(?:x[cl]|l?x{0,4})(?:i[xv]|v?i{0,4})", s):
        return None
    n = [_roman[ch] for ch in s]
    return sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0]))


def header_key(line: str) -> str:
    """An edge line without numbers at its ends, spacing and case."""
    return re.sub(r"\s+", " ", _edge_numbers.sub(" ", line)).strip(" .-–—[]()|").lower()


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens: Counter[str] = Counter()
    places: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        words: Counter[str] = Counter()
        for t, n in tokens.items():
            if w := t.strip(_outer):
                words[w.lower()] += n
        return pa.RecordBatch.from_arrays(
            [pa.array(["word"] * len(words) + ["place"] * len(places)), pa.array([*words, *places], pa.string()), pa.array([*words.values(), *places.values()], pa.int64())], ["kind", "what", "n"]
        )

    for b in batches:
        for pages in b.column(0).to_pylist():
            cut_off = False  # the first word of a line is the second half of the last one's: neither half is a word
            for page in pages or ():
                lines = [x for x in (page or "").split("\n") if x.strip()]
                for x in lines:
                    words = x.split()
                    half = x.rstrip()[-1] in MARKS
                    tokens.update(words[cut_off : len(words) - half])
                    cut_off = half
                places["all"] += len(lines)
                places["edge"] += min(len(lines), 2 * EDGE)
        if len(tokens) > 400_000:
            yield out()
            tokens.clear()
            places.clear()
    yield out()


def _hash(*parts: str | None) -> int:
    return int.from_bytes(blake2b(repr(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), signed=True)


def _headings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line that could be a header, with its document's name and content and whether it stands at an edge or inside."""
    for b in batches:
        rows: list[tuple[str, int, int, bool]] = []
        for name, pages in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            body = _hash(*pages)
            doc = body if name is None else _hash(name)
            seen = set()
            for page in pages:
                lines = [x for x in (page or "").split("\n") if x.strip()]
                for i, x in enumerate(lines):
                    if _heads(x) and len(k := header_key(x)) > 5:
                        seen.add((k, i < EDGE or i >= len(lines) - EDGE))
            rows += [(k, doc, body, edge) for k, edge in seen]
        cols = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.bool_())], ["what", "doc", "body", "edge"])


def edge_lines(docs: DataFrame, share: float) -> DataFrame:
    """``(what, n)``: the lines that many documents have at their edges, and in how many.

    Rows of one name are one document, and so are names of one content.  A line is
    kept if ``SHARED`` documents at least have it at an edge, and if running text, of
    which the share ``share`` stands at edges, would hardly be there so often: the
    chance (by Chernoff's bound) times the lines that occur just as often is under
    ``BY_CHANCE``, less by a square for more frequent ones so that the sum stays under
    1.7 times that.  So the count asked for follows the corpus, and lines that stand
    inside pages as often as running text does are not kept.
    """
    name = F.col("name").cast("string") if "name" in docs.columns else F.lit(None).cast("string")
    rows = spread(docs.select(name.alias("name"), "pages").where("pages is not null")).mapInArrow(_headings, "what string, doc bigint, body bigint, edge boolean")
    named = rows.groupBy("what", "doc").agg(F.max("edge").alias("e"), F.max(~F.col("edge")).alias("i"), F.min("body").alias("body"))
    once = named.groupBy("what", "body").agg(F.max("e").alias("e"), F.max("i").alias("i"))
    counted = once.groupBy("what").agg(F.count_if("e").alias("n"), (F.count_if("e") + F.count_if("i")).alias("places"))
    often = cut(counted.where(F.col("places") >= SHARED).withColumn("about", F.least("places", F.lit(100))))
    often = often.join(F.broadcast(often.groupBy("about").agg(F.count("*").alias("lines"))), "about")
    a, p = F.col("n") / F.col("places"), min(max(share, 1e-9), 1 - 1e-9)
    inside = F.when(a < 1, (1 - a) * F.log((1 - a) / (1 - p))).otherwise(0.0)
    far = (a > p) & (F.col("places") * (a * F.log(a / p) + inside) > F.log(F.col("lines") * F.pow(F.col("about") - SHARED + 1, 2) / BY_CHANCE))
    return often.where((F.col("n") >= SHARED) & far).select("what", "n")


@dataclass(frozen=True)
class Learnt:
    """What was learnt of a corpus, on its way to the tasks: the counts of words, the edge lines, and these by their words."""

    words: Shipped
    lines: Shipped
    postings: Shipped


def learn(docs: DataFrame) -> Learnt:
    """Count words and edge lines over all documents and ship them: all words that occur twice at least, and all edge lines."""
    counted = spread(docs.select("pages").where("pages is not null")).mapInArrow(_gather, "kind string, what string, n bigint").groupBy("kind", "what").agg(F.sum("n").alias("n"))
    counted = cut(counted.where(F.col("n") >= 2))
    places = {r.what: r.n for r in counted.where("kind = 'place'").collect()}
    edges = cut(edge_lines(docs, places.get("edge", 0) / max(1, places.get("all", 0))).select("what"))
    words = ship_table(counted.where("kind = 'word'").select(hashed("what").alias("h"), F.col("n").alias("v")), "words")
    lines = ship_table(edges.select(hashed("what").alias("h"), F.col("what").alias("v")), "lines")
    by_word = edges.select(F.explode(F.array_distinct(F.filter(F.split("what", " "), lambda w: w != ""))).alias("w"), "what").select(hashed("w").alias("h"), hashed("what").alias("v"))
    return Learnt(words, lines, ship_table(cut(by_word), "postings"))


class Words:
    """Counts of words in memory."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts

    def first(self, words: Iterable[str]) -> list[int]:
        return [self.counts.get(w, 0) for w in words]


class Lines:
    """Edge lines in memory, and by their words."""

    def __init__(self, lines: Iterable[str]):
        self.lines = frozenset(lines)

    def has(self, line: str) -> bool:
        return line in self.lines

    def like(self, line: str) -> Iterator[str]:
        """Lines that share one of the line's rarest words."""
        words = line.split()
        by = {w: [x for x in self.lines if w in x.split()] for w in words}
        return (x for w in sorted(by, key=lambda w: len(by[w]))[:PROBES] for x in by[w])


class ShippedLines:
    """The same in shipped tables."""

    def __init__(self, learnt: Learnt):
        self.lines, self.postings = Table(learnt.lines), Table(learnt.postings)

    def has(self, line: str) -> bool:
        lo, hi = self.lines.span(_signed(hash_of(line)))
        return hi > lo

    def like(self, line: str) -> Iterator[str]:
        spans = sorted((self.postings.span(_signed(hash_of(w))) for w in set(line.split())), key=lambda s: s[1] - s[0])
        for lo, hi in spans[:PROBES]:
            for h in self.postings.v[lo:hi].tolist():
                yield self.lines.text(self.lines.span(h)[0])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class Reader:
    """Reads documents with the corpus's vocabulary."""

    def __init__(self, words: Words | Table, lines: Lines | ShippedLines):
        self.words, self.lines = words, lines
        self.right: dict[str, str | None] = {}
        self.tokens: dict[str, str] = {}

    def true_word(self, word: str) -> str | None:
        """The word that ``word`` misreads, None if it is right or nothing is known.

        Only the ratio of the two counts decides, as misread forms grow with the corpus
        like true ones.  A form found may itself misread a still more frequent word; one
        with a digit is a code (``p-6/71``), never what a word was meant to be.
        """
        if word not in self.right:
            if len(self.right) > 500_000:
                self.right.clear()
            self.right[word] = self._true_word(word)
        return self.right[word]

    def _true_word(self, word: str) -> str | None:
        once = list(self._undone(word))
        own, *counts = self.words.first([word, *once])
        most = max(KNOWN, (OFTENER if len(word) > 3 else OFTENER_SHORT) * max(1, own)) - 1
        best = self._most(once, counts, most)
        if best is None and 4 < len(word) < 30:
            twice = [w for x in once for w in self._undone(x) if w != word]
            best = self._most(twice, self.words.first(twice), max(most, 50))
        return best

    @staticmethod
    def _most(words: list[str], counts: list[int], most: int) -> str | None:
        best = None
        for w, n in zip(words, counts):
            if n > most and not _digit.search(w):
                best, most = w, n
        return best

    @staticmethod
    def _undone(word: str) -> Iterator[str]:
        for bad, good in _confused:
            at = word.find(bad)
            while at >= 0:
                yield word[:at] + good + word[at + len(bad) :]
                at = word.find(bad, at + 1)

    def shared(self, key: str) -> bool:
        """Many documents have this line, or one that differs by two characters at most, at a page's edge."""
        if self.lines.has(key) or any(_alike(key, k, 2) for k in dict.fromkeys(self.lines.like(key))):
            return True
        _, comma, rest = key.rpartition("., ")
        return bool(comma) and self.shared(rest)

    def token(self, t: str) -> str:
        """A token with its misread word put right."""
        if t not in self.tokens:
            if len(self.tokens) > 500_000:
                self.tokens.clear()
            start, w = _core(t)
            fix = self.true_word(w) if len(w) > 1 and any(ch.isalpha() for ch in w) else None
            self.tokens[t] = t if fix is None else t[:start] + _as(fix, t[start:]) + t[start + len(w) :]
        return self.tokens[t]


@dataclass
class Line:
    page: int
    no: int
    text: str
    kinds: set[str] = field(default_factory=set)
    fixed: str = ""


def _alike(a: str, b: str, most: int = 0) -> bool:
    """At most ``most`` edits apart (by default one for eight characters, between 2 and 4).

    With so few edits one of the ``most + 1`` parts of ``a`` must stand in ``b`` as it is.
    """
    if a == b:
        return True
    most = most or min(4, max(2, min(len(a), len(b)) // 8))
    if abs(len(a) - len(b)) > most:
        return False
    size = len(a) // (most + 1)
    if size and not any(a[i : i + size] in b[max(0, i - most) : i + size + most] for i in range(0, size * (most + 1), size)):
        return False
    return edits(a, b, most) <= most


def _heads(text: str) -> bool:
    """Whether a line at a page's edge could be a header or footer."""
    t = text.strip()
    return len(t) <= HEADER and (t[0].isupper() or not t[0].isalpha()) and not t.endswith((".", ",", ";", *MARKS))


def _ends(key: str) -> set[tuple[str, ...]]:
    """The first two and the last two words; a misread header keeps the ones or the others."""
    w = key.split()
    return {("", *w[:2]), (*w[-2:], "")}


def _furniture(pages: list[list[Line]], title: str, reader: Reader) -> None:
    full = [[x for x in p if x.text.strip()] for p in pages]
    numbers: Counter[int] = Counter()
    said: dict[int, tuple[int, bool]] = {}
    on: dict[str, set[int]] = {}
    for i, p in enumerate(full):
        here = set()
        for x in {id(x): x for x in (*p[:EDGE], *p[-EDGE:])}.values():
            if (m := _number.match(x.text)) and (v := _value(m.group(2))) is not None:
                sure = bool(m.group(1).strip() or m.group(3) or m.group(4).strip() or len(m.group(1)) > 8)
                said[id(x)] = (v - i, sure)
                here.add(v - i)
            elif _heads(x.text) and (k := header_key(x.text)):
                on.setdefault(k, set()).add(i)
        numbers.update(here)
    near: dict[tuple[str, ...], list[str]] = {}
    for k in on:
        for e in _ends(k):
            near.setdefault(e, []).append(k)
    name = header_key(title or "")
    memo: dict[str, bool] = {}

    def repeats(k: str) -> bool:
        return len(on.get(k, ())) > 1 or any(o != k and on[o] != on.get(k) and _alike(k, o) for e in _ends(k) for o in near.get(e, ()))

    def header(x: Line) -> bool:
        if not _heads(x.text):
            return False
        k = header_key(x.text)
        if len(k) < 4:
            return False
        if k not in memo:
            memo[k] = len(name) > 8 and (_alike(k, name) or k.endswith(name)) or reader.shared(k) or repeats(k)
        return memo[k]

    for p in full:
        for side in (p[:EDGE], p[::-1][:EDGE]):
            for x in side:
                if id(x) in said:
                    offset, sure = said[id(x)]
                    if not sure and numbers[offset] < 2 and len(numbers) > 1 and max(numbers.values()) > 1:
                        break
                elif not header(x):
                    break
                x.kinds.add("furniture")


def _core(token: str) -> tuple[int, str]:
    """Where the word inside a token begins, and the word in lower case."""
    left = token.lstrip(_outer)
    return len(token) - len(left), left.rstrip(_outer).lower()


def _as(word: str, pattern: str) -> str:
    return word.upper() if pattern.isupper() and len(pattern) > 1 else word[:1].upper() + word[1:] if pattern[:1].isupper() else word


def _broken(left: str, mark: str, right: str, reader: Reader) -> bool:
    """Whether ``left`` and ``right`` are one word that the line's end cut."""
    a, b = left.lower(), right.lower()
    joined, dashed, first, second = reader.words.first([a + b, f"{a}-{b}", a, b])
    if joined or dashed:
        return joined >= dashed if mark in "-‐" else joined >= dashed or not dashed
    if reader.true_word(a + b):
        return True
    if reader.true_word(f"{a}-{b}"):
        return False
    return not (mark in "-‐" and first >= KNOWN and second >= KNOWN)


def read(pages: list[str | None], title: str | None, reader: Reader) -> list[Line]:
    """All lines of a document, with what is wrong with each and its repaired text.

    A cut word is moved whole to the line that it began on.
    """
    split = [[Line(i + 1, j + 1, t) for j, t in enumerate((p or "").split("\n"))] for i, p in enumerate(pages)]
    _furniture(split, title or "", reader)
    lines = [x for p in split for x in p]
    running = [x for x in lines if x.text.strip() and not x.kinds]
    for x in running:
        x.fixed = x.text.rstrip()
    for x, y in zip(running, running[1:]):
        if x.fixed[-1:] not in MARKS:
            continue
        m = _cut.match(x.fixed)
        if not m or not m.group(1) or not m.group(1)[-1].isalnum() and m.group(1)[-1] not in "@+$":
            continue
        left = re.search(r"\S+$", m.group(1)).group()
        right = y.fixed.split(None, 1)
        if not right:
            continue
        start, a = _core(left)
        at, b = _core(right[0])
        if not a or not b or at or not (b[0].isalpha() or b[0] in "@+$015") or right[0][0].isupper() and not left.isupper():
            continue
        rest = right[1] if len(right) > 1 else ""
        if _broken(a, m.group(2), b, reader):
            x.kinds.add("broken")
            if fix := reader.true_word(a + b):
                same = 0
                while same < min(len(fix), len(a)) and fix[same] == a[same]:
                    same += 1
                (y if same == len(a) else x).kinds.add("misread")
                tail = right[0][len(b) :]
                x.fixed = m.group(1)[: len(m.group(1)) - len(left) + start] + _as(fix, left[start:]) + tail
            else:
                x.fixed = m.group(1) + right[0]
        else:
            x.fixed = m.group(1) + "-" + right[0]
        y.fixed = rest
    token, seen = reader.token, reader.tokens
    for x in running:
        tokens = x.fixed.split(" ")
        right = [seen[t] if t in seen else token(t) for t in tokens]
        if right != tokens:
            x.kinds.add("misread")
            x.fixed = " ".join(right)
    return lines


def paragraphs(lines: list[Line]) -> list[str]:
    """Running text in paragraphs: a blank line inside a page or an indented line begins a new one."""
    out: list[list[str]] = []
    fresh = True
    for x in lines:
        if "furniture" in x.kinds:
            continue
        if not x.text.strip():
            fresh = fresh or bool(out) and out[-1][-1].rstrip()[-1:] in ".!?:;)"
            continue
        if not x.fixed.strip():
            continue
        if fresh or not out or re.match(r"\s{3,}\S", x.text) and x.text.strip()[0].isupper():
            out.append([])
        out[-1].append(x.fixed.strip())
        fresh = False
    return [" ".join(p) for p in out]


def _reader(learnt: Learnt) -> Reader:
    return Reader(Table(learnt.words), ShippedLines(learnt))


def noisy_lines(docs: DataFrame, learnt: Learnt, id_col: str = "ord") -> DataFrame:
    """``(id, page_no, line_no, kind)`` of every affected line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(learnt)
        for b in batches:
            rows = [
                (i, x.page, x.no, k)
                for i, title, pages in zip(*(b.column(c).to_pylist() for c in range(3)))
                for x in read(pages or [], title, reader)
                for k in sorted(x.kinds)
            ]
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], ["_id", "page_no", "line_no", "kind"])

    rows = docs.select(F.col(id_col).alias("_id"), "title", "pages")
    return spread(rows).mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, page_no int, line_no int, kind string").withColumnRenamed("_id", id_col)


def readable(docs: DataFrame, learnt: Learnt, id_col: str = "ord") -> DataFrame:
    """``(id, paragraph_no, paragraph)``: the continuous readable paragraphs of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(learnt)
        for b in batches:
            rows = [(i, n, p) for i, title, pages, text in zip(*(b.column(c).to_pylist() for c in range(4))) for n, p in enumerate(paragraphs(read(pages or [text], title, reader)), 1)]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["_id", "paragraph_no", "paragraph"])

    rows = docs.select(F.col(id_col).alias("_id"), "title", "pages", "text")
    return spread(rows).mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, paragraph_no int, paragraph string").withColumnRenamed("_id", id_col)
