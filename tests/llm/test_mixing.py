from __future__ import annotations

import itertools
import random
import time

from lexquarry.llm.mixing import min_cost_flow, mix_sources

DOCS = "doc_id bigint, members array<string>, size bigint, source int, copies string"
TARGETS = "source string, weight double, max_repeats int"


def test_flow_is_largest_and_cheapest():
    rng = random.Random(3)
    for _ in range(40):
        arcs = [(a, b, rng.randint(0, 3), rng.randint(0, 4)) for a, b in itertools.permutations(range(4), 2) if a != 3 and b != 0 and a < b]
        flow = min_cost_flow(4, arcs, 0, 3)
        best = None
        for f in itertools.product(*(range(c + 1) for _, _, c, _ in arcs)):
            net = [0] * 4
            for (a, b, _, _), x in zip(arcs, f):
                net[a] -= x
                net[b] += x
            if net[1] == net[2] == 0:
                key = (-net[3], sum(x * w for x, (*_, w) in zip(f, arcs)))
                best = key if best is None or key < best else best
        assert (-sum(x for x, (_, b, *_) in zip(flow, arcs) if b == 3), sum(x * w for x, (*_, w) in zip(flow, arcs))) == best


def test_flow_of_very_many_patterns_ends():
    rng = random.Random(5)
    patterns, sources = 20_000, 15
    arcs = []
    for p in range(patterns):
        node, size = 2 + sources + p, rng.randint(1, 9999)
        arcs += [(0, node, size, k) for k in range(4)]
        arcs += [(node, 2 + s, 2 * size, 0) for s in rng.sample(range(sources), rng.randint(1, 4))]
    arcs += [(2 + s, 1, rng.randint(1, 60_000_000), 0) for s in range(sources)]
    began = time.perf_counter()
    flow = min_cost_flow(2 + sources + patterns, arcs, 0, 1)
    assert time.perf_counter() - began < 60
    net = [0] * (2 + sources + patterns)
    for (a, b, c, _), x in zip(arcs, flow):
        assert 0 <= x <= c
        net[a] -= x
        net[b] += x
    assert not any(net[2:]) and net[1] == -net[0] > 0


def test_weights_are_shares_of_their_sum(spark):
    _, shares = run(spark, [(i, ["a"], 10) for i in range(30)] + [(100 + i, ["b"], 10) for i in range(30)], [("a", 6.0, 1), ("b", 2.0, 1)], total=400)
    assert (shares["a"].target_tokens, shares["b"].target_tokens) == (300, 100)


def run(spark, docs, targets, total=None):
    df = spark.createDataFrame([(i, m, s, 1, "c") for i, m, s in docs], DOCS)
    got = mix_sources(df, spark.createDataFrame(targets, TARGETS), "doc_id", "members", "size", total)
    return got.documents.collect(), {r.source: r for r in got.shares.collect()}


def test_shares_caps_and_shortfall(spark):
    docs = [(i, ["a"], 10) for i in range(100)] + [(1000 + i, ["b"], 10) for i in range(10)] + [(2000, ["x"], 99), (2001, None, 5), (2002, ["a"], 0), (2003, ["a"], None), (2004, [None], 7)]
    rows, shares = run(spark, docs, [("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.1, 5), (None, 0.1, 1)])
    assert {r.doc_id for r in rows} <= set(range(100)) | set(range(1000, 1010))
    assert shares["a"].target_tokens == 550 and abs(shares["a"].mixed_tokens - 550) <= 10
    assert shares["b"].available_tokens == 100 and shares["b"].mixed_tokens == 300 and shares["b"].shortfall_tokens == 140
    assert shares["c"].mixed_tokens == 0 and shares["c"].shortfall_tokens == 110
    assert max(r.copies for r in rows if r.source == "b") == 3 and max(r.copies for r in rows if r.source == "a") == 1
    assert abs(sum(s.actual_share for s in shares.values()) - 1) < 1e-9
    assert sum(r["size"] * r.copies for r in rows if r.source == "a") == shares["a"].mixed_tokens


def test_copies_are_even(spark):
    rows, _ = run(spark, [(i, ["a"], 7) for i in range(50)], [("a", 1.0, 4)], total=7 * 125)
    assert {r.copies for r in rows} == {2, 3} and sum(r.copies for r in rows) == 125


def test_overlapping_sources_share_documents(spark):
    docs = [(i, ["a", "b"], 10) for i in range(20)] + [(100 + i, ["a"], 10) for i in range(20)]
    rows, shares = run(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)], total=400)
    assert abs(shares["a"].mixed_tokens - 200) <= 10 and abs(shares["b"].mixed_tokens - 200) <= 10
    used = {}
    for r in rows:
        used[r.doc_id] = used.get(r.doc_id, 0) + r.copies
    assert max(used.values()) == 1  # first uses are enough, so no document is repeated


def test_hot_source_uses_several_buckets(spark, monkeypatch):
    monkeypatch.setattr("lexquarry.llm.mixing.BUCKET", 10)
    rows, shares = run(spark, [(i, ["a"], 1 + i % 5) for i in range(300)], [("a", 1.0, 2)], total=700)
    assert abs(shares["a"].mixed_tokens - 700) <= 5 and sum(r["size"] * r.copies for r in rows) == shares["a"].mixed_tokens


def test_empty_and_repeated(spark):
    rows, shares = run(spark, [], [("a", 1.0, 2)])
    assert rows == [] and shares["a"].actual_share == 0.0
    rows, _ = run(spark, [(1, ["a"], 5), (1, ["a"], 5)], [("a", 1.0, 1)])
    assert len(rows) == 2
