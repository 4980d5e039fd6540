from __future__ import annotations

from pyspark.sql import functions as F

from lexquarry.skew import most_frequent, narrowed


def test_most_frequent_keeps_within_its_bound(spark):
    df = spark.createDataFrame([(f"w{i}", 1 + i) for i in range(1000)] + [("none", 0), ("null", None)], "w string, n bigint")
    got = most_frequent(df, 300)
    assert 260 <= len(got) <= 300 and {r.n for r in got} >= set(range(760, 1001))
    assert len(most_frequent(df, 5000)) == 1000
    assert most_frequent(df, 0) == most_frequent(df.limit(0), 10) == []
    even = spark.createDataFrame([(f"w{i}", 5) for i in range(1000)], "w string, n bigint")
    assert 200 < len(most_frequent(even, 300)) <= 300
    assert len(most_frequent(spark.createDataFrame([("a", 5)] * 4, "w string, n bigint"), 3)) <= 3


def test_narrowed_keeps_what_is_wanted(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(1).alias("_word"), "id").drop("_word")
    wanted = rows.where("id % 400 = 7").select("key").union(spark.createDataFrame([(None,)], "key string"))
    got = narrowed(rows.union(spark.createDataFrame([(None, 5)], "key string, id bigint")), wanted, "key")
    assert got.columns == ["key", "id"] and got.where("id % 400 = 7").count() == 50 and got.count() < 8000
    assert narrowed(rows, wanted.limit(0), "key").count() == 0
