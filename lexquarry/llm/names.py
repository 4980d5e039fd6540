"""Variant spellings of names typed by people (problem 1).

Distinct spellings are taken apart once: titles, given name, middle initial and
surname of a person (in whatever order), or base name, line of business and legal
form of an organisation.  The rare words (surnames, base names) are joined with each
other within a bounded distance by *trie joins*: words that share one of three
segments are sharded together, each shard's words form a trie, and every word that
may match walks it with a Levenshtein automaton.  Spellings whose rare words are
neighbours are then compared part by part.  The order of a person's words is not
trusted: where it isn't certain which word is the surname and which the given name,
every order of the words is a *reading* of the spelling, and two spellings match if
one reading of each does.

Two spellings belong together if the rare word agrees (up to ``FAR`` edits), the
given names agree (nicknames and typing errors allowed, an initial with a full name),
and middle initials don't contradict; organisations need the same business, and the
same legal form if both state one.  A spelling with an initial only is not linked to
bearers of several given names between which it can't tell.  Null and empty names
take no part.

Spellings are joined by what was read from them, of which there is far less than of
spellings, and by surname and given name together, so that a surname of very many
bearers is no hot key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.spelling import Trie, edits
from lexquarry.storage import cut, tasks

#: Most edits between two forms of a rare word; one for words of up to ``SHORT`` letters.
FAR, SHORT = 2, 6
#: Words of one segment that one trie holds at most; larger segments are divided into several tries.
TRIE = 5_000

# Given names and what they are shortened to.
GIVEN = """
alexander alex sandy; benjamin ben benny; charles charlie chuck; deborah debbie deb; edward ned ed eddie; elizabeth liz beth betty eliza;
frederick fred freddie; gregory greg; harold harry hal; isabella bella izzy; jonathan jon jonny; joseph joe joey; katherine kate kathy katie;
leonard len lenny leo; margaret maggie meg peggy; michael mike mick; nicholas nick; olivia liv livvy; oswald oz ozzie; patricia pat patty tricia;
raymond ray; robert bob rob bobby; samantha sam; susanna sue susan susie; theodore ted theo teddy; thomas tom tommy; victoria vicky tori; vincent vince vin;
william bill will billy; zachary zach zack; david dave; daniel dan; andrew andy; matthew matt; anthony tony; christopher chris; james jim jimmy; john jack
"""
TITLES = "justice mr mrs ms mst miss dr prof sir mian messrs hon honble the chief judge etc and others another ors anr"
# Lines of business and legal forms, each with the ways they are written.
BUSINESS = """
agricultural agri agric agriculture; construction constr const; development dev devel devt; engineering engg engr eng; fisheries fish fishery; insurance ins insur;
shipping shpg ship; telecommunications telecom telecomm tele; textile tex text mills mill; trading trdg trade; transport transp trans; mining min; banking bank; energy; chemicals chem; motors
"""
FORMS = """
association assn assoc; authority auth authy; corporation corp corpn; department dept deptt; limited ltd; company co pvt private; sons son; board bd; commission comm
"""


def _table(text: str) -> dict[str, str]:
    return {w: ws[0] for g in text.split(";") if (ws := g.split()) for w in ws}


_given, _business, _form, _titles = _table(GIVEN), _table(BUSINESS), _table(FORMS), frozenset(TITLES.split())
_formal = sorted({*_given.values()})
_long_business = sorted({w for w in _business.values()})
_long_form = sorted({w for w in _form.values() if len(w) > 5})
_word = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


@lru_cache(200_000)
def _near(word: str, table: str) -> str | None:
    """The entry of a table that ``word`` is, or is a mistyped form of."""
    exact, full = {"given": (_given, _formal), "business": (_business, _long_business), "form": (_form, _long_form)}[table]
    if word in exact:
        return exact[word]
    if len(word) < 4:
        return None
    most = 1 if len(word) < 8 else 2
    best = min(((edits(word, f, most), f) for f in full if abs(len(f) - len(word)) <= most), default=(9, ""))
    return best[1] if best[0] <= most else None


class Reading(NamedTuple):
    """What a spelling says; ``anchor`` is the rare word by which it is found."""

    kind: str
    rare: str
    given: str
    initial: str
    middle: str
    form: str
    rest: str
    anchor: str


def readings(text: str) -> list[Reading]:
    """The ways to read a spelling: one for each rare word of an organisation, one for each possible order of a person's words."""
    s = re.sub(r"(?i)\bm/s\.?", " ", text)
    head, comma, tail = s.partition(",")
    tokens = [w.lower() for w in _word.findall(s)]
    tokens = [w for w in tokens if w not in _titles] or tokens
    business = {b for w in tokens if (b := _near(w, "business"))}
    forms = [f for w in tokens if (f := _near(w, "form"))]
    if business or len(forms) > 1 or forms and len(tokens) < 4 and not any(_near(w, "given") for w in tokens):
        rest = [w for w in tokens if len(w) > 1 and not _near(w, "business") and not _near(w, "form")]
        said = " ".join(sorted(business))
        order = ("sons", "company", "corporation", "authority", "department", "association", "board", "commission", "limited")
        form = next((f for f in order if f in forms), "")
        rare = "".join(sorted(rest)) if rest else "".join(tokens)
        return [Reading("o", rare, said, said, "", form, "", a) for a in dict.fromkeys(rest or tokens[:1])]
    words, letters = [w for w in tokens if len(w) > 1], [w for w in tokens if len(w) == 1]
    first, second = (letters + ["", ""])[:2]
    if not words:
        return [Reading("p", "".join(letters), "", "", "", "", "", "".join(letters))] if letters else []
    if len(words) == 1:
        return [Reading("p", words[0], "", first, second, "", "", words[0])]

    def read(surname: str, given: str) -> Reading:
        rest = list(words)
        rest.remove(surname)
        rest.remove(given)
        known = _near(given, "given") or given
        return Reading("p", surname, known, known[0], first, "", " ".join(sorted(rest)), surname)

    like = [bool(_near(w, "given")) for w in words]
    before = {w.lower() for w in _word.findall(head)} if comma and _word.search(tail) else set()
    if before and any(w in before for w in words) and not all(w in before for w in words):
        surname = next(w for w in words if w in before)
        return [read(surname, next(w for i, w in enumerate(words) if i != words.index(surname)))]
    if any(like) and not all(like):
        return [read([w for w, y in zip(words, like) if not y][-1], next(w for w, y in zip(words, like) if y))]
    n = len(words)
    orders = permutations(range(n), 2) if n < 7 else ((i, (i + k) % n) for i in range(n) for k in (1, n - 1))
    return list(dict.fromkeys(read(words[i], words[j]) for i, j in orders))


def _limit(a: str, b: str) -> int:
    return 1 if min(len(a), len(b)) <= SHORT else FAR


def _segments(n: int) -> list[tuple[int, int]]:
    size, more = divmod(n, FAR + 1)
    cuts = [0]
    for i in range(FAR + 1):
        cuts.append(cuts[-1] + size + (i >= FAR + 1 - more))
    return list(zip(cuts, cuts[1:]))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segment keys of each word: as a member of a trie, and as a word that walks it."""
    for b in batches:
        key, word, member = [], [], []
        for w in b.column(0).to_pylist():
            n = len(w)
            for i, (x, y) in enumerate(_segments(n)):
                key.append(f"{i}:{n}:{w[x:y]}")
                word.append(w)
                member.append(True)
            asked = set()
            for m in range(max(1, n - FAR), n + FAR + 1):
                for i, (x, y) in enumerate(_segments(m)):
                    for s in range(max(0, x - FAR), min(n - (y - x), x + FAR) + 1):
                        asked.add(f"{i}:{m}:{w[s : s + y - x]}")
            key += asked
            word += [w] * len(asked)
            member += [False] * len(asked)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(word, pa.string()), pa.array(member, pa.bool_())], ["key", "word", "member"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and shard, members first: build each trie and let the asking words walk it."""

    def out(pairs: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], ["a", "b"])

    now, members, trie, pairs = None, [], None, []
    for batch in batches:
        for key, shard, word, member in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (key, shard) != now:
                now, members, trie = (key, shard), [], None
            if member:
                members.append(word)
                continue
            if not members:
                continue
            trie = trie or Trie(members)
            pairs += [(word, x) for x in trie.near(word, FAR) if word < x and edits(word, x, FAR) <= _limit(word, x)]
            if len(pairs) > 20_000:
                yield out(pairs)
                pairs = []
    yield out(pairs)


def near_words(words: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of different words within the allowed distance; ``words`` has one column ``word`` of distinct words."""
    spark = words.sparkSession
    n = words.count()
    keys = cut(words.repartition(tasks(spark, n, 50_000)).mapInArrow(_keys, "key string, word string, member boolean"))
    sizes = keys.where("member").groupBy("key").agg(F.count("*").alias("n"))
    asked = keys.join(sizes, "key")
    shards = F.ceil(F.col("n") / TRIE).cast("int")
    shard = F.when(F.col("member"), F.array(F.pmod(F.xxhash64("word"), shards).cast("int"))).otherwise(F.sequence(F.lit(0), shards - 1))
    rows = asked.select("key", F.explode(shard).alias("shard"), "word", "member")
    rows = rows.repartition(tasks(spark, n, 50_000), "key", "shard").sortWithinPartitions("key", "shard", F.desc("member"))
    return rows.mapInArrow(_walk, "a string, b string").distinct()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(t, *r) for t in b.column(0).to_pylist() for r in readings(t)]
        cols = list(zip(*rows)) or [()] * (1 + len(Reading._fields))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["name", *Reading._fields])


def _both_ways(near: DataFrame) -> DataFrame:
    return near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _alike_readings(read: DataFrame) -> DataFrame:
    """Pairs of readings ``(r, r2, ...)`` that may be of one entity, each pair once, a reading with itself too.

    ``read`` has one row per reading ``r``.  A person's reading meets others of a near
    surname by the given name or one an edit away, or, where one side has initials
    only, by the initial; an organisation's by its business.
    """
    person = (F.col("kind") == "p") & (F.col("given") != "")
    words = cut(read.select(F.explode(F.array_distinct(F.array("anchor", F.when(person, F.col("given")).otherwise(F.col("anchor"))))).alias("word")).distinct())
    near = _both_ways(cut(near_words(words)))
    link = words.select(F.col("word").alias("a"), F.col("word").alias("b")).unionByName(near)
    typos = near.where(F.levenshtein("a", "b") == 1).groupBy(F.col("a").alias("given")).agg(F.collect_list("b").alias("also"))  # of one word's neighbours

    c, key = F.col, lambda sign, x: F.concat(F.lit(sign), x)
    full = F.concat(F.array(key("g", c("given")), key("v", c("initial"))), F.transform(F.coalesce("also", F.array().cast("array<string>")), lambda x: key("g", x)))
    asks = F.when(c("kind") == "o", F.array(key("o", c("given")))).when(c("given") != "", full).otherwise(F.array(key("v", c("initial")), key("i", c("initial"))))
    has = F.when(c("kind") == "o", F.array(key("o", c("given")))).when(c("given") != "", F.array(key("g", c("given")), key("i", c("initial")))).otherwise(F.array(key("v", c("initial"))))
    left = read.join(typos, "given", "left").withColumn("key", F.explode(asks)).drop("also")
    left = left.join(link, c("anchor") == c("a")).drop("anchor", "a")
    right = read.withColumn("key", F.explode(has))
    right = right.select(*(c(x).alias(x + "2") for x in right.columns))
    pairs = left.join(right, (c("b") == c("anchor2")) & (c("key") == c("key2")) & (c("kind") == c("kind2")) & (c("r") <= c("r2")))
    said = lambda x: (c(x) == c(x + "2")) | (c(x) == "") | (c(x + "2") == "")
    near = F.levenshtein("rare", "rare2") <= 2
    person = (said("given") | (F.levenshtein("given", "given2", 2) == 1)) & said("middle") & said("rest") & ((c("given") == c("given2")) | near)
    pairs = pairs.where(F.when(c("kind") == "p", person).otherwise(said("form") & near))
    return pairs.select("r", "r2", "kind", "given", "given2", "middle", "middle2").distinct()


def variant_pairs(spellings: DataFrame, col: str = "name") -> DataFrame:
    """Pairs ``(name_a, name_b)``, ``name_a < name_b``, of spellings of the same person or organisation."""
    distinct = cut(spellings.where(F.trim(col) != "").select(F.col(col).alias("name")).distinct())
    dealt = distinct.repartition(tasks(distinct.sparkSession, distinct.count(), 100_000))
    parsed = dealt.mapInArrow(_parse, "name string, " + ", ".join(f"{f} string" for f in Reading._fields))
    parsed = cut(parsed.withColumn("r", F.xxhash64(*Reading._fields)))
    pairs = cut(_alike_readings(cut(parsed.select("r", *Reading._fields).distinct())))
    names = parsed.select("r", "name")
    both = pairs.join(names, "r").join(names.select(F.col("r").alias("r2"), F.col("name").alias("name2")), "r2").where("name <> name2")
    turned = F.col("name") > F.col("name2")
    swap = lambda a, b: (F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a), F.when(turned, F.col(a)).otherwise(F.col(b)).alias(b))
    return _told_apart(cut(both.select("kind", *swap("name", "name2"), *swap("given", "given2"), *swap("middle", "middle2")).distinct()))


def _told_apart(pairs: DataFrame) -> DataFrame:
    """Without the links of initial-only spellings that fit bearers of several given names."""
    sides = pairs.where((F.col("kind") == "p") & ((F.col("given") == "") != (F.col("given2") == "")))
    vague = F.when(F.col("given") == "", F.col("name")).otherwise(F.col("name2"))
    other = F.when(F.col("given") == "", F.col("given2")).otherwise(F.col("given"))
    sure = ((F.col("middle") == F.col("middle2")) & (F.col("middle") != "")).cast("int")
    sides = sides.select("name", "name2", vague.alias("vague"), other.alias("full"), sure.alias("sure"))
    best = sides.groupBy("vague").agg(F.max("sure").alias("sure"))
    chosen = sides.join(best, ["vague", "sure"]).groupBy("vague").agg(F.countDistinct("full").alias("n"), F.min("full").alias("full")).where("n = 1")
    kept = sides.join(chosen.select("vague", "full"), ["vague", "full"], "left_semi").select("name", "name2")
    rest = pairs.where((F.col("kind") != "p") | ((F.col("given") == "") == (F.col("given2") == ""))).select("name", "name2")
    return rest.unionByName(kept).distinct().toDF("name_a", "name_b")


def case_spellings(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """All spellings of parties and judges, exactly as stored."""
    sides = lambda c: F.when(F.contains(c, F.lit(" vs ")), F.array(F.substring_index(c, " vs ", 1), F.expr("substring(s, instr(s, ' vs ') + 4)")))
    parties = docs.select(F.col("judgement_meta.parties").alias("s")).where("s is not null").distinct()
    judges = docs.select(F.explode("judgement_meta.judges").alias("name"))
    head = F.regexp_extract(F.element_at("meta", "context"), r"^\[Case: ([^\]]*)", 1)
    contexts = chunks.select(F.substring_index(head, " | ", 1).alias("s")).where("s <> ''").distinct()
    split = parties.unionByName(contexts).select(F.explode(sides(F.col("s"))).alias("name"))
    return split.unionByName(judges).where("name <> ''").distinct()
