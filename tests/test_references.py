from __future__ import annotations

import itertools
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lexquarry.operators import references as R

REFS = "row int, a string, b string, extra string"
TARGETS = "a string, b string, extra int"


def brute(refs, targets, match):
    lost = []
    for row, a, b in refs:
        key = (a, b)
        null = [k is None for k in key]
        if match == "simple" and any(null) or all(null):
            continue
        if match == "full" and any(null):
            lost.append(row)
            continue
        if not any(all(n or x == y for n, x, y in zip(null, key, t)) for t in targets):
            lost.append(row)
    return sorted(lost)


@pytest.mark.parametrize("match", R.MATCHES)
def test_composite_keys_with_nulls(spark, match):
    rng = random.Random(5)
    values = [None, "x", "y", "z", ""]
    refs = [(i, rng.choice(values), rng.choice(values)) for i in range(120)]
    targets = [t for t in itertools.product(["x", "y", None], ["x", "", None]) if rng.random() < 0.6]
    df = spark.createDataFrame([(i, a, b, "e") for i, a, b in refs], REFS)
    got = R.orphan_references(df, spark.createDataFrame([(a, b, 1) for a, b in targets], TARGETS), ["a", "b"], match)
    assert got.columns == ["row", "a", "b", "extra"]
    assert sorted(r.row for r in got.collect()) == brute(refs, targets, match)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "x", "y", "e")], REFS)
    none = spark.createDataFrame([], TARGETS)
    assert R.orphan_references(df, none, ["a", "b"]).count() == 1
    assert R.orphan_references(df.limit(0), none, ["a", "b"]).count() == 0


def test_clashing_columns(spark):
    refs = spark.createDataFrame([(1, "x", 5, 6, 7)], "row int, key string, _n int, _at int, _mask int")
    targets = spark.createDataFrame([("x", 1, 2)], "key string, _n int, row int")
    assert R.orphan_references(refs, targets, ["key"]).count() == 0
    assert R.orphan_references(refs, targets.limit(0), ["key"]).columns == refs.columns


def test_bad_match(spark):
    with pytest.raises(ValueError):
        R.orphan_references(spark.createDataFrame([], REFS), spark.createDataFrame([], TARGETS), ["a"], "other")


def test_targets_live_for_a_time(spark):
    day = lambda m, d=1: datetime(2024, m, d)
    refs = spark.createDataFrame([(1, "k", day(2)), (2, "k", day(3)), (3, "k", day(4)), (4, "k", None), (5, "late", day(2)), (6, "k", day(2))], "row int, key string, at timestamp")
    targets = spark.createDataFrame([("k", day(2, 10), day(3, 15)), ("k", day(3, 20), day(3, 25)), ("late", day(2), None), (None, day(1), None), ("k", None, None)], "key string, s timestamp, e timestamp")
    got = R.orphan_references(refs, targets, ["key"], "simple", "at", "s", "e")
    # before the first start; lives; after its end; no target for ever; start not before the instant; every row by itself
    assert sorted(r.row for r in got.collect()) == [1, 3, 4, 5, 6]


def test_hot_key_keeps_all_rows(spark, monkeypatch):
    monkeypatch.setattr("lexquarry.skew.HOT_ROWS", 10)
    refs = spark.range(500).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    targets = spark.range(0, 500, 2).select(F.col("id").cast("string").alias("key"))
    got = R.orphan_references(refs, targets, ["key"])
    want = [i for i in range(500) if i % 3 == 0 or i % 2]
    assert sorted(r.row for r in got.collect()) == want


def test_month_end_is_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        df = spark.sql("select timestamp'2024-01-31 23:59:59.999999Z' t union all select timestamp'2024-12-31 12:00:00Z'")
        got = df.select(F.unix_seconds(R.month_end("t")).alias("s"), R.month_of("t").alias("m")).orderBy("m").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [(r.s, r.m) for r in got] == [(1706745600, "2024-01"), (1735689600, "2024-12")]
