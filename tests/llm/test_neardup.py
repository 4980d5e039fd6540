from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexquarry.llm import neardup as N


def brute(rows):
    sets = {}
    for i, t in rows:
        if i is not None and t is not None and len(w := N.words(t)) >= 40:
            sets[i] = frozenset(zip(w, w[1:], w[2:]))
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.6:
            out.add((a, b))
    return out


def corpus(seed, n_base=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = []
    for k in range(n_base):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(45, 160))]
        rows.append((f"b{k}", " ".join(base)))
        for v in range(rng.randint(0, 3)):
            w = list(base)
            for _ in range(rng.randint(1, max(1, len(w) // 25))):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
            rows.append((f"b{k}v{v}", " ".join(w)))
    return rows


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "chunk_id string, text string, class string, similarity int").drop("class")
    members, pairs = N.near_duplicates(df, "chunk_id")
    return {tuple(r) for r in N.linked_ids(members, pairs, "chunk_id").collect()}, members


def test_against_brute_force(spark):
    rows = corpus(4)
    got, members = found(spark, rows)
    want = brute(rows)
    assert got <= want and len(got) >= 0.97 * len(want)
    assert members.count() == len(rows)


def densely(monkeypatch, dense):
    """Every set is counted, and regions of more than ``dense`` go deeper."""
    monkeypatch.setattr(N, "SAMPLED", 1)
    monkeypatch.setattr(N, "DENSE", dense)


@pytest.mark.parametrize("dense", [1, 3])
def test_dense_regions_go_deeper(spark, monkeypatch, dense):
    densely(monkeypatch, dense)
    rows = corpus(8, 25)
    rng = random.Random(1)
    base = [f"q{i}" for i in range(120)]
    for v in range(30):  # one crowded region
        w = list(base)
        w[rng.randrange(120)] = f"z{v}"
        rows.append((f"hot{v}", " ".join(w)))
    got, _ = found(spark, rows)
    want = brute(rows)
    assert got <= want and len(got) >= 0.97 * len(want)


def loose(families=6, each=40):
    """Families of which most pairs have a similarity of 0.6 to 0.7."""
    rng, rows = random.Random(5), []
    for f in range(families):
        for v in range(each):
            w = [f"f{f}w{i}" for i in range(120)]
            for at in rng.sample(range(1, 119), 4):
                w[at] = f"z{v}x{at}"
            rows.append((f"{f}-{v}", " ".join(w)))
    return rows


@pytest.mark.parametrize("dense", [2, 12, 25, 1024])
def test_recall_is_kept_in_dense_regions(spark, monkeypatch, dense):
    densely(monkeypatch, dense)
    rows = loose()
    got, _ = found(spark, rows)
    want = brute(rows)
    print(dense, len(got) / len(want))
    assert len(want) > 3000 and got <= want and len(got) >= 0.95 * len(want)


def test_copies_nulls_and_short_texts(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [("a", long), ("a", long), ("b", long.upper()), ("c", long + " extra"), ("d", None), (None, long), ("e", ""), ("f", "short text"), ("g", " ".join(["same"] * 50)), ("h", " ".join(["same"] * 70)), ("i", "x" * 200_000)]
    got, members = found(spark, rows)
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("g", "h")}
    assert {r.chunk_id: r["class"] for r in members.collect()} == {"a": "a", "b": "b", "c": "c", "g": "g", "h": "h"}
    got, members = found(spark, [("f", "short")])
    assert got == set() and members.count() == 0


def test_different_texts_of_equal_sets_are_paired(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [("a", long), ("b", long), ("c", long.upper()), ("d", long.replace(" ", ", ")), ("e", long.upper()), ("f", long + " more"), ("g", long + " More")]
    got, members = found(spark, rows)
    texts = dict(rows)
    rep = {i: min(j for j, t in rows if t == texts[i]) for i in texts}
    want = {tuple(sorted((i, r))) for i in texts for r in set(rep.values()) if i != r}  # every member with every other text's representative
    assert got == want and {r.chunk_id: r["class"] for r in members.collect()} == rep


def test_an_id_with_two_texts(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    got, _ = found(spark, [("x", a), ("x", b), ("y", a + " z"), ("u", b + " z")])
    assert got == {("x", "y"), ("u", "x")}


@pytest.mark.parametrize("rows,values,dense,deep", [(50_000, 256, 1024, 0.99), (4_000, 2, 500, 0.96)])
def test_one_region_of_many_texts(spark, monkeypatch, rows, values, dense, deep):
    """All texts share the first prefix; of planted pairs each further part agrees with a chance of 0.6."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(N, "DENSE", dense)
    rng = np.random.default_rng(3)
    spare, near = rng.integers(0, values, (rows, N.SPARE)), 2000
    again = rng.random((near, N.SPARE)) < 0.6
    spare[near : 2 * near] = np.where(again, spare[:near], (spare[:near] + 1) % values)
    sketch = rng.integers(-(1 << 62), 1 << 62, (rows, 2))
    sketch[near : 2 * near] = sketch[:near]
    prefix = rng.integers(-(1 << 31), (1 << 31) - 1, (rows, N.TREES)).astype(np.int32)
    prefix[:, 0] = 7
    packed = sum(spare[:, k].astype(np.uint64) << np.uint64(8 * k) for k in range(N.SPARE)).view(np.int64)
    signed = spark.createDataFrame(pa.table({"_set": np.arange(rows), "_s0": sketch[:, 0], "_s1": sketch[:, 1], "_spare": packed, "_prefix": prefix.tolist()})).withColumn("_prefix", F.col("_prefix").cast("array<int>"))
    got = {tuple(r) for r in N.candidates(signed, signed, rows).collect()}
    want = {(i, i + near) for i in range(near)}
    assert got >= {(i, i + near) for i in range(near) if again[i].sum() > 1} and len(got & want) >= deep * near
    assert len(got) < rows


def test_blocks_of_a_region_meet_once():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    key = np.sort(rng.integers(0, 40, 500) << 2 | rng.integers(0, 3, 500)).astype(np.int64)
    own = np.arange(500, dtype=np.int64)
    batch = lambda lo, hi: pa.RecordBatch.from_arrays([pa.array(key[lo:hi]), pa.array(own[lo:hi]), pa.array(np.zeros(hi - lo, np.int64)), pa.array(np.full(hi - lo, -1))], list("kots"))
    want = {(i, j) for i in range(500) for j in range(i + 1, 500) if key[i] >> 2 == key[j] >> 2 and (not key[i] & 3 or key[i] & 3 != key[j] & 3)}
    for cuts in ([0, 500], [0, 1, 3, 100, 101, 340, 500]):
        got = [p for b in N._neighbours(batch(lo, hi) for lo, hi in zip(cuts, cuts[1:])) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("text", ["Ünïcode ÀÉ 12x", "a-b_c", "İKelvinK", ""])
def test_words(text):
    import re

    assert [w.decode() for w in N.words(text)] == re.findall("[a-z0-9]+", text.lower())
