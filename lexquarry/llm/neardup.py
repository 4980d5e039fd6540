"""Near-duplicate texts with small edits, by an LSH forest (problem 5).

Every text is a set of runs of ``SHINGLE`` consecutive words.  Minwise hashes of the
set give it a place in each of ``TREES`` orders: rows are sorted by their signature,
and texts with a long common prefix are neighbours.  Neighbours that share ``LEAST``
parts are candidates; where a region of an order is dense (about ``DENSE`` texts and
more, estimated on a hashed sample) it goes deeper, by one of ``SPARE`` further parts in
each way and then by two of them, and a region that is dense even then is cut into
blocks of which every two are compared.  A pair of similarity 0.6 is among the
candidates with a chance of 0.967, 0.966 and 0.958 at the three depths, whatever the
number of texts; of 0.7 with 0.995 and more.  A 128-bit sketch rejects most chance
neighbours in the scan of a region; the rest are compared exactly.

Texts with equal sets are represented once in the forest.  Identical texts are a class,
named by the smallest id.  No candidate is capped or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.skew import narrowed
from lexquarry.storage import cut, spread, tasks

SHINGLE, SIMILAR, LEAST_WORDS = 3, 0.6, 40
TREES, LEAST = 14, 3
#: Further parts of 8 bits by which dense regions are divided: by one of them, then by two.
SPARE = 8
DENSE = 1024
#: One set in so many is counted to find the dense regions.
SAMPLED = 16
#: Differing sketch bits (of 128) beyond which a pair can't be similar: for a similarity of 0.6 the mean is 26 with a deviation of 4.5, so 0.002 of such pairs are beyond; a chance pair has about 60.
APART = 38
#: A list of dense regions is broadcast up to this many rows (16 MB); there are at most ``TREES`` / ``DENSE`` of the texts, by depth.
BROADCAST_ROWS = 1_000_000

_plain = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
_rng = np.random.default_rng(20240601)
_mult = _rng.integers(1, 1 << 31, 64, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_mix = _rng.integers(1, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: str) -> list[bytes]:
    """The maximal runs of ``[a-z0-9]`` in the lower-cased text."""
    return text.lower().encode("ascii", "replace").translate(_plain).split()


class Hasher:
    """Hashes of words, remembered between batches."""

    def __init__(self, most: int = 500_000):
        self.seen: dict[bytes, int] = {}
        self.most = most

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        for w in set(tokens).difference(seen):
            seen[w] = int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
        return np.fromiter(map(seen.__getitem__, tokens), np.uint64, len(tokens))


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of all runs of three words in a row of hashed words."""
    x = h[:-2] * _mix[0] + (h[1:-1] ^ (h[1:-1] >> np.uint64(31))) * _mix[1] + (h[2:] ^ (h[2:] >> np.uint64(29))) * _mix[2]
    return (x ^ (x >> np.uint64(32))) * _mix[3]


def signature(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose hashed words follow each other in ``h``: a digest of each shingle set, the sketches (two words), the spare parts, the prefixes."""
    n = len(sizes)
    ends = np.cumsum(sizes)
    x = shingles(h)
    inside = np.ones(len(x), bool)
    for k in (1, 2):  # runs that reach into the next text
        at = ends[:-1] - k
        inside[at] = False
    x = x[inside]
    starts = np.concatenate(([0], np.cumsum(sizes - 2)[:-1]))
    low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
    least = np.empty((64, n), np.uint32)
    for p, m in enumerate(_mult):
        np.minimum.reduceat(low * m + high, starts, out=least[p])
    sums = np.empty(n, np.uint64)
    for i, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(x)])):
        u = np.unique(x[a:b])
        sums[i] = np.sum((u ^ (u >> np.uint64(30))) * _mix[0], dtype=np.uint64) ^ np.uint64(len(u))
    v = least.T.astype(np.uint64)
    v = (v ^ (v >> np.uint64(15)) ^ _mix[3]) * _mix[1]
    v ^= v >> np.uint64(32)
    bits = np.packbits(np.stack([(v >> np.uint64(7)) & np.uint64(1), (v >> np.uint64(19)) & np.uint64(1)], 2).reshape(n, 128).astype(np.uint8), axis=1).view(np.int64)
    prefix = np.zeros((n, TREES), np.uint64)
    for d in range(LEAST):
        prefix = (prefix ^ (prefix >> np.uint64(29))) * _mix[2] + v[:, d * TREES : (d + 1) * TREES]
    spare = np.zeros(n, np.uint64)
    for k in range(SPARE):
        spare |= (v[:, LEAST * TREES + k] >> np.uint64(40) & np.uint64(255)) << np.uint64(8 * k)
    return sums.view(np.int64), bits, spare.view(np.int64), (prefix >> np.uint64(32)).astype(np.uint32).view(np.int32)


#: Texts that are hashed together, so that their shingles stay in the processor's cache.
TOGETHER = 100


def _sign(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for b in batches:
        texts = b.column(2).to_pylist()
        for lo in range(0, len(texts), TOGETHER):
            split = [words(t) for t in texts[lo : lo + TOGETHER]]
            keep = [i for i, w in enumerate(split) if len(w) >= least]
            if not keep:
                continue
            sizes = np.fromiter((len(split[i]) for i in keep), np.int64, len(keep))
            sums, bits, spare, prefix = signature(hasher([w for i in keep for w in split[i]]), sizes)
            flat = pa.array(prefix.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, TREES, dtype=np.int32)), flat)
            rows = pa.array([lo + i for i in keep], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(sums), pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy()), pa.array(spare), lists], SIGNED)


SIGNED = ["_id", "_text_hash", "_set", "_s0", "_s1", "_spare", "_prefix"]


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a narrow list of keys, to be broadcast if its counted size allows it; cut it from its lineage before."""
    return F.broadcast(df) if df.count() <= most else df


def _part(t: Column) -> Column:
    return F.call_function("shiftrightunsigned", F.col("_spare"), t * 8).bitwiseAND(255)


def _level(rows: DataFrame, dense: DataFrame, k: int) -> DataFrame:
    """Rows with those in dense regions divided: by one of the spare parts in each way, by two, or into blocks of which every two meet."""
    place = lambda key, way: F.struct(key.alias("_key"), F.col("_base").alias("_base"), way.cast("int").alias("_way"))
    ways = F.sequence(F.lit(0), F.lit(SPARE - 1))
    if k == 1:
        deeper = F.transform(ways, lambda t: place(F.shiftleft(F.xxhash64("_base", t, _part(t)), 2), t))
    elif k == 2:
        pair = lambda a, b: F.shiftleft(F.xxhash64("_base", a, b, _part(a), _part(b)), 2)
        deeper = F.transform(F.filter(ways, lambda t: t != F.col("_way")), lambda t: place(pair(F.least(t, F.col("_way")), F.greatest(t, F.col("_way"))), F.lit(-1)))
    else:
        mine = F.pmod(F.xxhash64("_set", F.lit("block")), F.col("_blocks")).cast("int")
        side = lambda o: F.when(mine == o, 0).when(mine < o, 1).otherwise(2).cast("bigint")
        block = lambda o: F.shiftleft(F.xxhash64("_key", F.least(mine, o), F.greatest(mine, o)), 2).bitwiseOR(side(o))
        deeper = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: place(block(o), F.lit(-1)))
    places = F.when(F.col("_blocks").isNull(), F.array(place(F.col("_key"), F.col("_way")))).otherwise(deeper)
    return rows.join(dense, "_key", "left").withColumn("_place", F.explode(places)).drop("_key", "_base", "_way", "_blocks").select("*", "_place.*").drop("_place")


def regions(signed: DataFrame, reps: DataFrame) -> DataFrame:
    """``(_key, _set, _s0, _s1)``: every set in its region of each order, at the depth that the region's density asks for.

    The two lowest bits of a key are 0, but where a region is cut into blocks: there 1
    and 2 mark the two blocks of which one is to be compared with the other.
    """

    def top(df: DataFrame) -> DataFrame:
        placed = df.select("*", F.posexplode("_prefix").alias("_tree", "_p"))
        key = F.shiftleft(F.shiftleft(F.col("_tree").cast("bigint"), 32).bitwiseOR(F.col("_p").cast("bigint").bitwiseAND(0xFFFFFFFF)), 2)
        return placed.withColumn("_key", key).withColumn("_base", F.col("_key")).withColumn("_way", F.lit(-1)).drop("_prefix", "_tree", "_p")

    some = top(signed.where(F.pmod(F.xxhash64("_set"), F.lit(SAMPLED)) == 0).select("_set", "_spare", "_prefix").dropDuplicates(["_set"]))
    rows = top(reps.select("_set", "_s0", "_s1", "_spare", "_prefix"))
    for k in (1, 2, 0):
        counted = some.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") * SAMPLED > DENSE)
        dense = cut(counted.select("_key", (F.ceil(F.col("_n") * SAMPLED / DENSE) + 1).cast("int").alias("_blocks")))
        if dense.isEmpty():
            break
        dense = sized(dense)
        rows, some = _level(rows, dense, k), _level(some.join(dense.select("_key"), "_key", "left_semi"), dense, k)
    return rows.select("_key", "_set", "_s0", "_s1")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their keys the pairs of each region whose sketches are near."""

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, own, s0, s1 = (np.concatenate(c) for c in zip(*rows))
        region, side = key >> 2, key & 3
        at = np.flatnonzero(region[:-1] == region[1:])
        step, left, right, n = 1, [], [], 0
        while len(at):
            to = at + step
            near = np.bitwise_count(s0[at] ^ s0[to]).astype(np.int16) + np.bitwise_count(s1[at] ^ s1[to]) <= APART
            near &= (own[at] != own[to]) & ((side[at] == 0) | (side[at] != side[to]))
            a, b = own[at[near]], own[to[near]]
            left.append(np.minimum(a, b))
            right.append(np.maximum(a, b))
            n += len(a)
            if n > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["_a", "_b"])
                left, right, n = [], [], 0
            step += 1
            at = at[at + step < len(region)]
            at = at[region[at] == region[at + step]]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["_a", "_b"])

    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        cols = tuple(b.column(i).to_numpy() for i in range(2)) + tuple(b.column(i).to_numpy().view(np.uint64) for i in (2, 3))
        if not len(cols[0]):
            continue
        last = np.searchsorted(cols[0] >> 2, cols[0][-1] >> 2)  # where the last region begins, which may go on
        if not held or held[-1][0][-1] >> 2 != cols[0][-1] >> 2:
            yield from pairs([*held, tuple(c[:last] for c in cols)])
            held = [tuple(c[last:] for c in cols)]
        else:
            held.append(cols)
    if held:
        yield from pairs(held)


def candidates(signed: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """Pairs ``(_a, _b)`` of sets that are neighbours in an order and whose sketches are near; ``n`` is the number of texts."""
    rows = regions(signed, reps)
    rows = rows.repartition(tasks(rows.sparkSession, n * TREES, 1_000_000), F.shiftright("_key", 2)).sortWithinPartitions("_key")
    return rows.mapInArrow(_neighbours, "_a bigint, _b bigint").distinct()


def _verify(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own: dict[str, frozenset] = {}

        def of(t: str) -> frozenset:
            if t not in own:
                w = words(t)
                own[t] = frozenset(zip(w, w[1:], w[2:]))
            return own[t]

        j = []
        for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            x, y = of(s), of(t)
            both = len(x & y)
            j.append(both / (len(x) + len(y) - both))
        keep = pa.array([v >= similar for v in j], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(j, pa.float64())], ["_a", "_b", "similarity"]).filter(keep)


def near_duplicates(df: DataFrame, id_col: str, text_col: str = "text", least_words: int = LEAST_WORDS, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: members ``(id, class)`` of every text long enough, and pairs ``(class_a, class_b, similarity)``.

    A class holds the ids of one text and is named by the smallest of them.  Pairs are
    of different texts, be it that their sets of shingles are equal.  Null ids and null
    texts take no part; an id that is delivered again with the same text counts once.
    """
    texts = df.where(F.col(id_col).isNotNull() & (F.length(text_col) >= 2 * least_words - 1)).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text_hash"), F.col(text_col).alias("_text"))
    kind = dict(texts.dtypes)["_id"]
    signed = cut(spread(texts).mapInArrow(lambda it: _sign(it, least_words), f"_id {kind}, _text_hash bigint, _set bigint, _s0 bigint, _s1 bigint, _spare bigint, _prefix array<int>"))
    n = signed.count()
    reps = signed.groupBy("_set").agg(*(F.first(c).alias(c) for c in ("_s0", "_s1", "_spare", "_prefix")))
    found = cut(candidates(signed, reps, n))
    classes = cut(signed.groupBy("_set", "_text_hash").agg(F.min("_id").alias("class")))

    wanted = found.select(F.col("_a").alias("_set")).union(found.select("_b")).distinct()
    named = cut(classes.join(wanted, "_set", "left_semi").groupBy("_set").agg(F.min(F.struct("class", "_text_hash")).alias("x")).select("_set", F.col("x.class").alias("_id"), "x._text_hash"))
    own = narrowed(texts, named, "_id").join(named, ["_id", "_text_hash"]).groupBy("_set").agg(F.first("_text").alias("_text"))
    own = cut(own)
    a = own.select(F.col("_set").alias("_a"), F.col("_text").alias("_ta"))
    b = own.select(F.col("_set").alias("_b"), F.col("_text").alias("_tb")).repartition(tasks(df.sparkSession, n, 1_000_000), "_b")
    compared = found.join(a, "_a").join(b, "_b").select("_a", "_b", "_ta", "_tb")
    near = cut(compared.mapInArrow(lambda it: _verify(it, similar), "_a bigint, _b bigint, similarity double"))

    of = lambda end: classes.select(F.col("_set").alias("_" + end), F.col("class").alias("class_" + end))
    across = near.join(of("a"), "_a").join(of("b"), "_b").select("class_a", "class_b", "similarity")
    several = classes.groupBy("_set").agg(F.count("*").alias("_n")).where("_n > 1").select("_set")
    equal = cut(classes.join(several, "_set").select("_set", "class"))
    equal = equal.join(equal.select("_set", F.col("class").alias("class_b")), "_set").select(F.col("class").alias("class_a"), "class_b", F.lit(1.0).alias("similarity"))
    lower, upper = F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b")
    pairs = across.unionByName(equal).where("class_a <> class_b").select(lower, upper, "similarity").distinct()
    members = signed.select("_id", "_set", "_text_hash").distinct().join(classes, ["_set", "_text_hash"]).select(F.col("_id").alias(id_col), "class")
    return members, pairs


def linked_ids(members: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """Pairs ``(a, b)`` of ids: every member of a class with the class's name, and with the names of all classes near it."""
    copies = cut(members.where(F.col(id_col) != F.col("class")))
    some = cut(pairs.select("class_a", "class_b"))
    both = some.unionByName(some.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    more = copies.join(both, F.col("class") == F.col("class_a")).select(F.col(id_col).alias("a"), F.col("class_b").alias("b"))
    all_ = some.toDF("a", "b").unionByName(copies.select(F.col("class").alias("a"), F.col(id_col).alias("b"))).unionByName(more)
    return all_.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
