"""References to records that do not exist (problem 3).

A reference is a composite key.  References are grouped by their *null mask*, the
set of key columns that are null; each group is anti-joined on its non-null columns,
under the declared match semantics:

``simple``  a reference with any null column is not checked;
``partial`` the non-null columns must be found together in one target;
``full``    a reference is all null (and not checked) or has no null at all; a
            partly null reference is an orphan.

Targets may live for a time, from ``start`` until before ``end`` (null: for ever); a
reference is then judged at its own instant ``at``.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.skew import join_counted
from lexquarry.storage import cut

MATCHES = ("simple", "partial", "full")
DAY = 86_400_000_000


def orphan_references(refs: DataFrame, targets: DataFrame, keys: list[str], match: str = "simple", at: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The rows of ``refs`` whose reference has no live target; every row counts by itself.

    ``keys`` are the key's columns, of the same names in both tables; other columns
    of equal names don't clash.  A target with a null in a key column is found only
    by references that leave that column null; one with a null ``start`` never lives.
    A null ``at`` asks for a target that lives for ever.  Empty strings are values;
    leave them out beforehand if they mean "no reference".

    References are reduced to distinct keys and instants before the join, so a hot
    key is looked up once; its rows are then picked up by broadcasting the hot ones.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    timed = at is not None
    own = [f"__lq_k{i}" for i in range(len(keys))] + (["__lq_at"] if timed else [])
    far = F.lit((1 << 63) - 1)
    keyed = refs.select("*", *(F.col(k).alias(o) for k, o in zip(keys, own)), *([F.coalesce(F.unix_micros(at), far).alias("__lq_at")] if timed else []))
    nulls = [F.col(o).isNull() for o in own[: len(keys)]]
    every, some = reduce(Column.__and__, nulls), reduce(Column.__or__, nulls)
    keyed = keyed.where({"simple": ~some, "partial": ~every, "full": ~every}[match])
    # one row per key and instant; nulls made comparable by a mask
    mask = reduce(Column.__add__, [F.when(n, F.lit(1 << i)).otherwise(F.lit(0)) for i, n in enumerate(nulls)])
    asked = keyed.withColumn("__lq_mask", mask).groupBy("__lq_mask", *own).agg(F.count("*").alias("__lq_n"))
    lives = [F.col(k).alias(f"__lq_t{i}") for i, k in enumerate(keys)]
    if timed:
        lives += [F.unix_micros(start).alias("__lq_start"), F.coalesce(F.unix_micros(end), far).alias("__lq_end")]
    there = targets.select(*lives).distinct()
    lost = []
    for empty in product((False, True), repeat=len(keys)):
        code = sum(1 << i for i, e in enumerate(empty) if e)
        if all(empty) or any(empty) and match == "simple":
            continue
        part = asked.where(F.col("__lq_mask") == code)
        if not (any(empty) and match == "full"):
            on = [F.col(f"__lq_k{i}") == F.col(f"__lq_t{i}") for i, e in enumerate(empty) if not e]
            if timed:
                on += [F.col("__lq_start") < F.col("__lq_at"), F.col("__lq_end") >= F.col("__lq_at")]
            part = part.join(there, reduce(Column.__and__, on), "left_anti")
        lost.append(part)
    orphans = cut(reduce(DataFrame.unionByName, lost))
    code = lambda o: F.coalesce(F.col(o).cast("string"), F.lit("\0"))
    if match == "simple":
        return join_counted(keyed, orphans.drop("__lq_mask"), own).select(*refs.columns)
    same = [o + "s" for o in own]
    orphans = orphans.select(*(code(o).alias(s) for o, s in zip(own, same)), "__lq_n")
    return join_counted(keyed.select("*", *(code(o).alias(s) for o, s in zip(own, same))), orphans, same).select(*refs.columns)


def month_end(ts: str) -> Column:
    """The first instant of the next UTC month, as a timestamp, whatever the session's time zone is."""
    day = F.date_from_unix_date(F.floor(F.unix_micros(ts) / F.lit(DAY)).cast("int"))
    return F.timestamp_micros(F.unix_date(F.add_months(F.trunc(day, "MM"), 1)).cast("bigint") * DAY)


def month_of(ts: str) -> Column:
    """The UTC month as ``yyyy-MM``."""
    day = F.date_from_unix_date(F.floor(F.unix_micros(ts) / F.lit(DAY)).cast("int"))
    return F.date_format(day, "yyyy-MM")


def corpus_references(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """All references of the corpus ``(tab, field, row_key, key, month, due)``; null and empty ones are none."""
    def of(df: DataFrame, tab: str, row_key: str, fields: list[str]) -> DataFrame:
        ends = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("key")) for f in fields))
        rows = df.select(F.lit(tab).alias("tab"), F.col(row_key).alias("row_key"), "ingested_at", F.inline(ends))
        return rows.where("key <> ''").select("tab", "field", "row_key", "key", month_of("ingested_at").alias("month"), month_end("ingested_at").alias("due"))

    return of(chunks, "chunks", "ord", ["parent_id"]).unionByName(of(edges, "edges", "edge_id", ["from_id", "to_id"]))


def corpus_targets(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """What references may name, ``(key, ingested_at, deleted_at)``."""
    cols = lambda df, key: df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), "ingested_at", "deleted_at")
    return cols(chunks, "chunk_id").unionByName(cols(nodes, "id"))


def corpus_orphans(chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The references without a live target at the end of their row's UTC month."""
    return orphan_references(corpus_references(chunks, edges), corpus_targets(chunks, nodes), ["key"], "simple", "due", "ingested_at", "deleted_at")


def orphan_report(references: DataFrame, orphans: DataFrame) -> DataFrame:
    """References and orphans per table, field and month."""
    by = ["tab", "field", "month"]
    n = references.groupBy(*by).agg(F.count("*").alias("n_references"))
    lost = orphans.groupBy(*by).agg(F.count("*").alias("n_orphans"))
    return n.join(lost, by, "left").withColumn("n_orphans", F.coalesce("n_orphans", F.lit(0)))
