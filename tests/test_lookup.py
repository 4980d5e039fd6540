from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexquarry import lookup as L


@pytest.mark.parametrize("part_rows", [3, 1000])
def test_counts_and_texts(spark, monkeypatch, part_rows):
    monkeypatch.setattr(L, "PART_ROWS", part_rows)
    words = [f"wörd{i}" for i in range(40)] + ["", "中", "a b"]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "what string, n bigint")
    counts = L.ship_table(df.select(L.hashed("what").alias("h"), F.col("n").alias("v")), "counts")
    lines = L.ship_table(df.select(L.hashed("what").alias("h"), F.col("what").alias("v")), "lines")
    many = L.ship_table(df.select(F.lit(7).cast("bigint").alias("h"), F.col("n").alias("v")), "many")
    assert len(counts.parts) > 1 or part_rows > 100

    def run(batches):
        c, t, m = L.Table(counts), L.Table(lines), L.Table(many)
        for b in batches:
            asked = b["what"].tolist()
            b["got"] = c.first(asked, -1)
            b["missing"] = c.first(["no " + w for w in asked], -1)
            spans = [t.span(h) for h in b["h"]]
            assert all(hi == lo + 1 for lo, hi in spans)
            b["text"] = [t.text(lo) for lo, _ in spans]
            b["several"] = m.span(7)[1] - m.span(7)[0]
            yield b

    got = df.withColumn("h", L.hashed("what")).mapInPandas(run, "what string, n bigint, h bigint, got bigint, missing bigint, text string, several bigint").collect()
    assert all((r.got, r.missing, r.text, r.several) == (r.n, -1, r.what, len(words)) for r in got) and len(got) == len(words)


def test_an_empty_table(spark):
    empty = L.ship_table(spark.createDataFrame([], "h bigint, v bigint"), "none")
    got = spark.range(1).mapInPandas(lambda it: (b.assign(id=L.Table(empty).first(["x"], 5)) for b in it), "id bigint").collect()
    assert [r.id for r in got] == [5]
