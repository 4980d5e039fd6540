"""Mixing sources to target weights (problem 8).

Documents are aggregated by *membership pattern*, the set of listed sources they
belong to.  A minimum-cost flow routes the patterns' tokens to the sources' quotas;
the k-th use of a pattern's documents costs k-1, so copies are made only where the
first uses don't suffice, and a source never takes more than ``max_repeats`` times
a pattern's tokens.  Then documents are picked: those of a pattern lie on a circle
in seeded order, each as long as its size, and every source takes an arc as long as
its flow; a document is used as often as arcs of that source cover its middle.  So
each document's uses stay within the cap and a source's tokens are within one
document of its flow.

Defined results: a listed source without documents reaches 0 and its quota is its
shortfall; documents of unlisted or null sources and of size 0 or null are never
used; null or non-positive weights and caps count as 0, and weights are shares of their sum; repeated rows count by
themselves; an empty table gives an empty mix.  Shortfalls are reported, not handed
to other sources.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from lexquarry.storage import cut

#: Most membership patterns; with overlapping sources their number could explode.
MOST_PATTERNS = 20_000
#: Documents that one bucket of the seeded order holds, about.
BUCKET = 50_000


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], s: int, t: int) -> list[int]:
    """The flow on each arc ``(from, to, capacity, cost)`` of a cheapest largest flow from ``s`` to ``t``.

    Costs are small whole numbers, so there are few distances from ``s`` to ``t``; the
    flow of each distance is found at once by blocking flows.
    """
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to += [b, a]
        cap += [c, 0]
        cost += [w, -w]
    while True:
        far = [float("inf")] * n
        far[s], queue, waiting = 0, deque([s]), {s}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in out[a]:
                if cap[e] > 0 and far[a] + cost[e] < far[to[e]]:
                    far[to[e]] = far[a] + cost[e]
                    if to[e] not in waiting:
                        waiting.add(to[e])
                        queue.append(to[e])
        if far[t] == float("inf"):
            return [cap[2 * i + 1] for i in range(len(arcs))]
        # all that goes at this distance at once: a largest flow over the arcs of shortest ways
        while True:
            level, queue = {s: 0}, deque([s])
            while queue and t not in level:
                a = queue.popleft()
                for e in out[a]:
                    if cap[e] > 0 and to[e] not in level and far[a] + cost[e] == far[to[e]]:
                        level[to[e]] = level[a] + 1
                        queue.append(to[e])
            if t not in level:
                break
            nth, path = [0] * n, []
            while True:
                a = to[path[-1]] if path else s
                if a == t:
                    push = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    del path[next(i for i, e in enumerate(path) if not cap[e]) :]
                    continue
                while nth[a] < len(out[a]):
                    e = out[a][nth[a]]
                    if cap[e] > 0 and level.get(to[e]) == level[a] + 1 and far[a] + cost[e] == far[to[e]]:
                        path.append(e)
                        break
                    nth[a] += 1
                else:
                    if not path:
                        break
                    path.pop()
                    nth[to[path[-1]] if path else s] += 1


@dataclass
class Mix:
    """``documents``: (id, source, size, copies); ``shares``: one row per listed source."""

    documents: DataFrame
    shares: DataFrame


def mix_sources(df: DataFrame, targets: DataFrame, id_col: str, members_col: str, size_col: str, total: int | None = None, seed: int = 17) -> Mix:
    """Mix ``df`` (one row per document, ``members_col`` an array of sources) to ``targets`` (source, weight, max_repeats).

    ``total`` is the size of the whole mix; by default the size of all documents that
    belong to a listed source, each once.  ``targets`` is a table of settings of at most
    a few thousand rows and is read by the driver.
    """
    spark = df.sparkSession
    rows = targets.where("source is not null").groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats")).orderBy("source").limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} listed sources")
    listed = {r.source: (max(0.0, r.weight or 0.0), max(0, r.max_repeats or 0)) for r in rows}
    names = F.lit(sorted(listed)) if listed else F.array().cast("array<string>")
    docs = df.select(F.col(id_col).alias("_id"), F.array_sort(F.array_intersect(F.array_distinct(F.col(members_col)), names)).alias("_pattern"), F.col(size_col).cast("bigint").alias("_size"))
    docs = cut(docs.where((F.size("_pattern") > 0) & (F.col("_size") > 0)))
    sums = docs.groupBy("_pattern").agg(F.sum("_size").alias("tokens"), F.count("*").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    patterns = sorted((tuple(r["_pattern"]), r.tokens, r.n) for r in sums)
    whole = sum(t for _, t, _ in patterns) if total is None else total
    sum_w = sum(w for w, _ in listed.values())
    quota = {s: round(w / sum_w * whole) if sum_w else 0 for s, (w, _) in listed.items()}

    node = {s: 2 + i for i, s in enumerate(listed)}
    arcs, routes = [], []
    for i, (p, tokens, _) in enumerate(patterns):
        own = 2 + len(listed) + i
        arcs += [(0, own, tokens, k) for k in range(sum(listed[s][1] for s in p))]
        for s in p:
            routes.append((p, s, len(arcs)))
            arcs.append((own, node[s], tokens * listed[s][1], 0))
    arcs += [(node[s], 1, quota[s], 0) for s in listed]
    flow = min_cost_flow(2 + len(listed) + len(patterns), arcs, 0, 1)

    ranges, at = [], dict.fromkeys((p for p, _, _ in patterns), 0)
    for p, s, arc in routes:
        if flow[arc]:
            ranges.append((list(p), s, at[p], at[p] + flow[arc]))
            at[p] += flow[arc]
    circle = spark.createDataFrame([(list(p), t, max(1, n // BUCKET)) for p, t, n in patterns], "_pattern array<string>, _whole bigint, _buckets bigint")
    arcs_df = spark.createDataFrame(ranges, "_pattern array<string>, source string, _from bigint, _to bigint")

    key = F.xxhash64(F.lit(seed), "_id")
    placed = docs.join(F.broadcast(circle), "_pattern").withColumn("_key", key).withColumn("_bucket", F.pmod(F.shiftrightunsigned("_key", 8), "_buckets"))
    by = W.partitionBy("_pattern").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("_pattern", "_bucket").agg(F.sum("_size").alias("_in")).withColumn("_start", F.coalesce(F.sum("_in").over(by), F.lit(0))).drop("_in")
    inside = W.partitionBy("_pattern", "_bucket").orderBy("_key", "_id").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.join(starts, ["_pattern", "_bucket"]).withColumn("_middle", F.col("_start") + F.sum("_size").over(inside) - F.expr("_size div 2") - 1)
    turns = lambda c: F.ceil((F.col(c) - F.col("_middle")) / F.col("_whole"))
    used = placed.join(F.broadcast(arcs_df), "_pattern").withColumn("copies", (turns("_to") - turns("_from")).cast("int")).where("copies > 0")
    used = cut(used.select(F.col("_id").alias(id_col), "source", F.col("_size").alias("size"), "copies"))

    reached = used.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("mixed_tokens"), F.count("*").alias("documents"), F.max("copies").cast("int").alias("most_copies"))
    have: dict[str, int] = dict.fromkeys(listed, 0)
    for p, tokens, _ in patterns:
        for s in p:
            have[s] += tokens
    plan = spark.createDataFrame([(s, w, m, have[s], quota[s]) for s, (w, m) in listed.items()], T.StructType.fromDDL("source string, weight double, max_repeats int, available_tokens bigint, target_tokens bigint"))
    all_ = W.partitionBy(F.lit(1))
    shares = plan.join(F.broadcast(reached), "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    mixed = F.sum("mixed_tokens").over(all_)
    shares = shares.select(
        "source", "weight", "max_repeats", "available_tokens", "target_tokens", "mixed_tokens",
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.when(mixed > 0, F.col("mixed_tokens") / mixed).otherwise(0.0).alias("actual_share"),
        F.greatest(F.lit(0), F.col("target_tokens") - F.col("mixed_tokens")).alias("shortfall_tokens"),
    )
    return Mix(used, shares)
