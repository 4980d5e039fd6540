from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.operators import profiling as P
from lexquarry.operators import retrieval as R


def vectors(spark, n=200, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, [float(v) for v in r], 1, "x") for i, r in enumerate(x)], "vec_id bigint, embedding array<float>, id int, q string")


def test_dense_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_TILE", 3)
    monkeypatch.setattr(R, "ROW_TILE", 17)
    monkeypatch.setattr(R, "ROUND_BYTES", 200)
    x, df = vectors(spark)
    got = R.dense_topk(df.repartition(5), df.where("vec_id % 20 = 0"), 7)
    s = np.round(x[::20].astype(np.float64) @ x.astype(np.float64).T, 6)
    want = {(20 * q, int(i), r + 1) for q, row in enumerate(s) for r, i in enumerate(np.lexsort((np.arange(len(row)), -row))[:7])}
    assert {(r.q, r.id, r["rank"]) for r in got.collect()} == want


def test_best_takes_the_first_of_equals():
    assert R._best(np.array([1.0, 3.0, 3.0, 2.0, 3.0]), 2).tolist() == [1, 2] and R._best(np.array([1.0]), 5).tolist() == [0] and R._best(np.array([]), 2).tolist() == []


def test_dense_edge_cases(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    got = [(r.q, r.id, r["rank"]) for r in R.dense_topk(df, df.where("vec_id < 3"), 2).orderBy("rank").collect()]
    assert got == [(1, 1, 1), (1, 3, 2)]
    assert R.dense_topk(df, df.limit(0), 2).count() == 0
    assert R.dense_topk(df.limit(0), df, 2).count() == 0


def test_index_recall(spark):
    _, df = vectors(spark, 2000, 48, 2)
    asked = df.where("vec_id % 20 = 0")
    exact = {(r.q, r.id) for r in R.dense_topk(df, asked, 10).collect()}
    found = R.index_topk(df, asked, 10).collect()
    assert len(exact & {(r.q, r.id) for r in found}) / len(exact) >= 0.9 and len(found) == len(exact)
    assert {r.id for r in R.index_topk(df, asked.limit(1), 3, 1e-9).collect()} and R.index_topk(df.limit(0), asked, 3).count() == 0


def test_sparse_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "ROUND_BYTES", 500)
    rng = random.Random(3)
    words = ["of", "of", "of", "the"] + [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    v = R.text_vectors(df, "doc_id", "text")
    want = set()
    for q in range(0, 150, 20):
        scores = {i: sum(t.split().count(w) for w in texts[q].split()) for i, t in enumerate(texts)}
        best = sorted((i for i in scores if scores[i]), key=lambda i: (-scores[i], i))[:5]
        want |= {(q, i, float(scores[i]), r + 1) for r, i in enumerate(best)}
    assert {(r.q, r.id, r.score, r["rank"]) for r in R.sparse_topk(v, v.where("id % 20 = 0"), 5).collect()} == want
    given = spark.createDataFrame([(1, {"a": 0.5, "b": -2.0}), (2, {"b": 1.0}), (3, {}), (4, None), (5, {"c": 1.0})], "id int, m map<string,double>")
    g = R.given_vectors(given, "id", "m")
    assert sorted(tuple(r) for r in R.sparse_topk(g, g.where("id = 2"), 9).collect()) == [(2, 1, -2.0, 2), (2, 2, 1.0, 1)]


def test_gold_recall(spark):
    found = lambda *x: spark.createDataFrame(x, "q int, doc string, section_no string, rank int")
    gold = spark.createDataFrame([(1, "a", "302"), (2, "b", None), (2, "c", "9"), (3, "d", "1")], "q int, doc string, section_no string")
    before = found((1, "a", "302", 6), (2, "b", None, 5), (3, "d", "2", 1))
    after = found((1, "a", "302", 1), (1, "a", "302", 2), (2, "x", "9", 1))
    assert [tuple(r) for r in R.gold_recall(before, after, gold).collect()] == [("retrieved", 5, 3, 1, 0.333333), ("reranked", 5, 3, 1, 0.333333)]


def test_sparse_and_fusion(spark):
    docs = spark.createDataFrame([(1, "Tax court tax"), (2, "court of session"), (3, None), (4, "")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(9, {"tax": 2.0, "court": 1.0}), (8, {"none": 1.0})], "q bigint, m map<string,double>")
    found = R.sparse_topk(R.text_vectors(docs, "doc_id", "text"), R.given_vectors(asked, "q", "m"), 5)
    got = [(r.q, r.id, r.score, r["rank"]) for r in found.orderBy("rank").collect()]
    assert got == [(9, 1, 5.0, 1), (9, 2, 1.0, 2)]
    dense = spark.createDataFrame([(9, 2, 1), (9, 7, 2)], "q bigint, id bigint, rank int")
    sparse = spark.createDataFrame([(9, 1, 1), (9, 2, 2)], "q bigint, id bigint, rank int")
    fused = [(r.id, r.score) for r in R.fuse(dense, sparse).orderBy("rank").collect()]
    assert fused == [(2, round(1 / 61 + 1 / 62, 6)), (1, round(1 / 61, 6)), (7, round(1 / 62, 6))]


def test_filters(spark):
    df = spark.createDataFrame([(1, "x", True), (2, "y", False), (3, None, None)], "n int, s string, b boolean")
    rows = lambda f: sorted(r.n for r in df.where(R.matches(f)).collect())
    assert rows({}) == rows({"s": None, "n": "", "b": []}) == [1, 2, 3]
    assert rows({"s": "x"}) == [1] and rows({"s": ["x", "y"]}) == [1, 2] and rows({"n": [1, 3], "s": "x"}) == [1] and rows({"b": [True]}) == [1]


def test_merging_collections(spark):
    found = spark.createDataFrame([(1, 5, "b", 1, 0.9, 1), (1, 5, "a", 0, 0.1, 2), (1, 6, "b", 1, None, 2), (1, 7, "b", 1, 0.5, 3)], "q int, id int, collection string, priority int, score double, rank int")
    assert [(r.id, r.collection) for r in R.merge_collections(found).orderBy("place").collect()] == [(7, "b"), (5, "a"), (6, "b")]


def test_rerank_is_stable(spark):
    found = spark.createDataFrame([(1, 1, 1, "tax court", "the tax"), (1, 2, 2, "tax court", "tax court"), (1, 3, 3, "tax court", "court"), (1, 4, 4, "", None)], "q int, id int, rank int, query string, text string")
    assert [(r.id, r.rerank_score) for r in R.rerank(found, R.overlap_score).orderBy("place").collect()] == [(2, 1.0), (1, 0.5), (3, 0.5), (4, 0.0)]
    assert R.rerank(found, R.overlap_score, 2).count() == 2


def test_children_and_upsert(spark):
    chunks = spark.createDataFrame([(i, f"c{i}", "p" if i % 2 else None) for i in range(60)], "ord int, chunk_id string, parent_id string")
    got = R.children(chunks, chunks.where("parent_id is not null"))
    assert got.count() == 20 and got.agg(F.max("ord")).first()[0] == 39
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, ord int")
    new = spark.createDataFrame([("b", 5), ("b", 3), ("c", 2)], "k string, ord int")
    once = R.upsert(old, new, "k", "ord")
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 5), ("c", 2)]
    assert sorted(map(tuple, R.upsert(once, new, "k", "ord").collect())) == [("a", 1), ("b", 5), ("c", 2)]


def test_recall(spark):
    found = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (2, 20, 6)], "q int, id int, rank int")
    gold = spark.createDataFrame([(1, 11), (2, 20), (3, 1)], "q int, id int")
    assert {r.k: r.recall for r in R.recall_at(found, gold, (1, 5, 10)).collect()} == {1: 0.0, 5: round(1 / 3, 6), 10: round(2 / 3, 6)}


def test_nearest_rank(spark):
    rng = random.Random(2)
    for n in (1, 2, 10, 20):
        v = sorted(rng.randint(0, 9) for _ in range(n))
        got = P.nearest_rank(spark.createDataFrame([(x,) for x in v] + [(None,)], "v bigint"), F.col("v")).first()
        at = lambda p: v[max(0, -(-n * p // 100) - 1)]
        assert (got.n, got.least, got.p50, got.p95, got.largest) == (n, v[0], at(50), at(95), v[-1])
    empty = P.nearest_rank(spark.createDataFrame([], "v bigint"), F.col("v")).first()
    assert (empty.n, empty.p50) == (0, None)


def test_profile(spark):
    df = spark.createDataFrame([(1, "", [], 0, False), (2, None, None, None, None), (3, "x", ["a"], 5, True)], "ord int, s string, a array<string>, n int, b boolean")
    got = {r.field: r for r in P.profile_fields(df, ["s", "a", "n", "b"], "ord").collect()}
    assert (got["s"].nulls, got["s"].non_empty, got["s"].coverage, got["s"].example) == (1, 1, 0.3333, "x")
    assert got["a"].non_empty == 1 and got["n"].non_empty == 2 and got["b"].non_empty == 2 and got["n"].example == "0"
    assert P.profile_fields(df.limit(0), ["s"], "ord").count() == 0


def test_points_and_checks(spark):
    rows = spark.createDataFrame([("a", {"x": "1"}, [1.0, 0.0], {"t": 1.0}, "text"), ("b", None, [0.0, 1.0], {"u": 1.0}, "")], "chunk_id string, meta map<string,string>, v array<float>, s map<string,double>, text string")
    got = R.points(rows, "v", 2, "s").orderBy("payload.chunk_id").collect()
    assert [(r.payload.chunk_id, r.payload.meta, list(r.dense)) for r in got] == [("a", {"x": "1"}, [1.0, 0.0]), ("b", {}, [0.0, 1.0])]
    for bad in (R.points(rows, "v", 3, "s"), R.points(rows.withColumn("s", F.map_filter("s", lambda k, _: k == "t")), "v", 2, "s")):
        with pytest.raises(Exception, match="wrong dimension|empty sparse"):
            bad.collect()
    assert tuple(R.verify_vectors(rows.withColumn("s", F.lit(None).cast("map<string,double>")), "v", 2, "s", "text").first()) == (2, 0, 0, 0, 2, 1)
    assert R.verify_vectors(rows, "v", 2, sample=0).first().n == 1
