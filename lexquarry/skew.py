"""Joins whose keys may be hot: one key can hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows; so there are at most 1 / share of them.
HOT_SHARE = 1 / 500
#: and more rows than this, below which no key hurts.
HOT_ROWS = 20_000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n_col: str = "__lq_n") -> DataFrame:
    """Inner join of ``rows`` with ``counted``, which has one row per key and in ``n_col`` how many ``rows`` have it.

    The hot keys, at most ``1 / HOT_SHARE`` by their definition, are broadcast, so
    their rows stay where they are; all other keys are joined by a shuffle.
    ``counted`` should be cut from its lineage, as it is read three times.
    """
    total = counted.agg(F.sum(n_col)).first()[0] or 0
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    hot, rest = counted.where(F.col(n_col) > least).drop(n_col), counted.where(F.col(n_col) <= least).drop(n_col)
    if total <= HOT_ROWS:
        return rows.join(counted.drop(n_col), keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(cold.join(rest, keys))


#: Bits of the map by which ``narrowed`` drops rows, at most: it is broadcast as words of 64 bits, so in 2^20 rows (16 MB).
MOST_BITS = 26


def narrowed(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` may be among those of ``wanted``, before a join by it: what is dropped needs no shuffle.

    Eight bits are kept for each wanted key, one of them set by its hash, up to the
    bound, beyond which more rows pass; no row that is wanted is lost.  ``wanted`` is
    read twice, so it should be cut from its lineage.
    """
    bits = 1 << min(MOST_BITS, max(10, (8 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))
    words = wanted.select(F.call_function("div", place, F.lit(64)).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_set_bits"))
    on = rows.withColumn("_word", F.call_function("div", place, F.lit(64)))
    return on.join(F.broadcast(words), "_word").where(F.col("_set_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def most_frequent(counted: DataFrame, most: int, n_col: str = "n") -> list[Row]:
    """The rows of largest counts, ``most`` at most, for the driver.

    A histogram of the counts (1/16 of a doubling a bar, so about a thousand bars)
    gives the least count that keeps within the bound; only rows that reach it are
    A histogram of the counts (1/16 of a doubling a bar, so about a thousand bars)
    gives the least count that keeps within the bound; only rows that reach it are
    sent, whereas an ordered limit would send ``most`` rows of every partition.  Of a
    bar that would exceed the bound a hashed part is taken.  ``counted`` is read twice,
    so it should be cut from its lineage.
    """
    bar = F.floor(F.log2(F.col(n_col).cast("double")) * 16).cast("int")
    room, least, last = most, None, None
    for r in sorted(counted.where(F.col(n_col) > 0).groupBy(bar.alias("bar")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r.bar):
        if r.rows > room:
            last = r
            break
        room, least = room - r.rows, r.bar
    wanted = F.lit(False) if least is None else bar >= least
    if last is not None and room > 0:
        wanted |= (bar == last.bar) & (F.pmod(F.xxhash64(*counted.columns), F.lit(last.rows)) < room * 9 // 10)
    return counted.where((F.col(n_col) > 0) & wanted).limit(most).collect()
