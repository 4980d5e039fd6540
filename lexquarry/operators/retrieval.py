"""Hybrid retrieval: filters, dense and sparse top-k, rank fusion, merging, reranking, parent and child fetches, evaluation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexquarry.functions import text as X
from lexquarry.lookup import Shipped, Table, ship_table
from lexquarry.storage import cut, spread

PREFETCH, TOP_K, RRF_K = 50, 20, 60
#: Bytes of queries that are shipped to the executors at once, at most; more queries are scored in further rounds.
ROUND_BYTES = 256 << 20
#: Queries and rows that are multiplied at once.
QUERY_TILE, ROW_TILE = 256, 16_384
#: Bits of the sketches by which a search may choose the rows that it reads, and the share of the rows that it reads then.
SKETCH_BITS, SHARE = 256, 0.10


def matches(filters: dict[str, object]) -> Column:
    """Equality for scalars, membership for lists (compared as text, so flags and numbers match too); null, empty text and empty lists are ignored; nothing left is no filter."""
    parts = []
    for k, v in filters.items():
        if isinstance(v, list | tuple | set | frozenset):
            if v:
                parts.append(F.col(k).cast("string").isin(sorted(str(x).lower() if isinstance(x, bool) else str(x) for x in v)))
        elif v is not None and v != "":
            parts.append(F.col(k) == F.lit(v))
    return reduce(Column.__and__, parts) if parts else F.lit(True)


def _shipped(queries: DataFrame, kind: str) -> list[Shipped]:
    """``queries (h, v binary)`` in rounds of a bounded size; the executors write them, the driver holds none."""
    queries = cut(queries)
    size = queries.agg(F.sum(F.length("v") + 16)).first()[0] or 0
    rounds = -(-size // ROUND_BYTES)
    return [ship_table(queries.where(F.pmod(F.xxhash64("h"), F.lit(rounds)) == r), kind) for r in range(rounds)]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, the first of equals first."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("q").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


FOUND = "q bigint, id bigint, score double"


def _found(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    q = np.repeat(np.array([p[0] for p in parts], np.int64), [len(p[1]) for p in parts])
    join = lambda i, kind: np.concatenate([p[i] for p in parts]) if parts else np.empty(0, kind)
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(join(1, np.int64)), pa.array(join(2, np.float64))], ["q", "id", "score"])


def sketches(v: np.ndarray, bits: int = SKETCH_BITS, seed: int = 11) -> np.ndarray:
    """Signs of the rows after seeded rotations, in words of 64 bits."""
    rng, dim = np.random.default_rng(seed), v.shape[1]
    turns = np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-bits // dim))], 1)[:, :bits]
    return np.packbits(v @ turns > 0, axis=1).view(np.uint64)


def dense_topk(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", share: float | None = None) -> DataFrame:
    """``(q, id, score, rank)``: for every query the ``k`` rows of highest inner product, ties by id.

    One scan of the rows: a task holds the vectors of its split, multiplies them with
    tiles of the queries, which it maps from a shipped file, and keeps ``k`` rows a
    query; those are ranked at the end.  With a ``share`` (``index_topk``) only that
    share of the split, the nearest by their sketches, is multiplied.  A row equal to
    the query itself is a result as any other.  Null vectors take no part.
    """
    data = rows.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    asked = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("h"), F.col(vec_col).cast("array<float>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in _matrix(b.column(1))], pa.binary())], ["h", "v"])

    rounds = _shipped(asked.mapInArrow(pack, "h bigint, v binary"), "vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), _matrix(b.column(1))) for b in batches if b.num_rows]
        if not held:
            return
        ids, v = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        codes = sketches(v) if share else None
        for shipped in rounds:
            table = Table(shipped)
            asks = table.texts.view(np.float32).reshape(len(table.h), -1)
            for lo in range(0, len(asks), QUERY_TILE):
                tile = asks[lo : lo + QUERY_TILE].astype(np.float64)
                yield _found([(int(q), ids[at], s) for q, (at, s) in zip(table.h[lo : lo + QUERY_TILE], _near(tile, v, codes, k, share) if share else _exact(tile, v, k))])

    return _ranked(spread(data).mapInArrow(run, FOUND), k)


def _exact(tile: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and scores of the ``k`` best rows of each query of the tile."""
    at: list[list[np.ndarray]] = [[] for _ in tile]
    scores: list[list[np.ndarray]] = [[] for _ in tile]
    for lo in range(0, len(v), ROW_TILE):
        for i, s in enumerate(np.round(tile @ v[lo : lo + ROW_TILE].astype(np.float64).T, 6)):
            best = _best(s, k)
            at[i].append(best + lo)
            scores[i].append(s[best])
    for a, s in zip(map(np.concatenate, at), map(np.concatenate, scores)):
        best = _best(s, k)
        yield a[best], s[best]


def _near(tile: np.ndarray, v: np.ndarray, codes: np.ndarray, k: int, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same among the share of the rows whose sketches differ least from the query's."""
    most = min(len(v), max(k, math.ceil(share * len(v))))
    for q, code in zip(tile, sketches(tile)):
        apart = np.bitwise_count(codes ^ code).sum(1, dtype=np.int32)
        read = np.sort(np.argpartition(apart, most - 1)[:most])
        s = np.round(v[read].astype(np.float64) @ q, 6)
        best = _best(s, k)
        yield read[best], s[best]


def index_topk(rows: DataFrame, queries: DataFrame, k: int, share: float = SHARE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """As ``dense_topk``, reading a ``share`` of the vectors only, those of nearest sketches.

    Every row is indexed, by ``SKETCH_BITS`` signs; nothing is fitted.  The chance to
    miss a true neighbour doesn't grow with the rows, as the share read is the same.
    """
    return dense_topk(rows, queries, k, id_col, vec_col, share)


def text_vectors(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sparse vectors ``(id, terms, weights)``: lower-cased words of letters and digits by their hashes, each time a word occurs with a weight of 1; ids are unique."""
    terms = F.transform(F.filter(F.split(F.lower(text_col), "[^a-z0-9]+"), lambda x: x != ""), lambda x: F.xxhash64(x))
    return df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), terms.alias("terms")).withColumn("weights", F.transform("terms", lambda _: F.lit(1.0)))


def given_vectors(df: DataFrame, id_col: str, map_col: str) -> DataFrame:
    """Sparse vectors ``(id, terms, weights)`` of a column of maps from terms to weights."""
    return df.where(F.col(map_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.transform(F.map_keys(map_col), lambda x: F.xxhash64(x)).alias("terms"), F.map_values(map_col).cast("array<double>").alias("weights"))


def sparse_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(q, id, score, rank)`` by the inner product of sparse vectors ``(id, terms, weights)``, of those that share a term; ties by id.

    One scan of the rows: a task makes postings of its split for the terms that are
    asked, adds up one query after the other in an array of its rows, and keeps ``k``
    rows a query.  No pair of a query and a row is ever a row of a table, so terms that
    all rows have make neither hot keys nor a large shuffle.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [np.array(t, np.int64).tobytes() + np.array(w, np.float64).tobytes() for t, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["h", "v"])

    rounds = _shipped(queries.where(F.size("terms") > 0).select("id", "terms", "weights").mapInArrow(pack, "h bigint, v binary"), "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Table(r) for r in rounds]
        asks = [[(int(q), x[: len(x) // 2], x[len(x) // 2 :].view(np.float64)) for i, q in enumerate(t.h) for x in [np.frombuffer(t.data(i), np.int64)]] for t in tables]
        known = np.unique(np.concatenate([x for r in asks for _, x, _ in r])) if any(asks) else np.empty(0, np.int64)
        ids, term, row, weight, n = [], [], [], [], 0
        for b in batches if len(known) else ():
            ids.append(b.column(0).to_numpy())
            flat, value = b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
            owner = np.repeat(np.arange(n, n + b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
            at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            hit = known[at] == flat
            term.append(at[hit])
            row.append(owner[hit])
            weight.append(value[hit])
            n += b.num_rows
        if not n:
            return
        ids, term, row, weight = map(np.concatenate, (ids, term, row, weight))
        order = np.lexsort((row, term))
        term, row, weight = term[order], row[order], weight[order]
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])))) if len(term) else np.empty(0, np.int64)
        term, row, weight = term[first], row[first], np.add.reduceat(weight, first) if len(first) else weight
        begin = np.searchsorted(term, np.arange(len(known) + 1))
        by_id = np.argsort(ids, kind="stable")
        place = np.empty(n, np.int64)
        place[by_id] = np.arange(n)
        row, ids = place[row], ids[by_id]
        score, touched, parts = np.zeros(n), np.zeros(n, bool), []
        for q, terms, weights in (x for r in asks for x in r):
            spans = [(begin[t], begin[t + 1], w) for t, w in zip(np.searchsorted(known, terms), weights) if begin[t] < begin[t + 1]]
            for lo, hi, w in spans:
                score[row[lo:hi]] += weight[lo:hi] * w
                touched[row[lo:hi]] = True
            at = np.flatnonzero(touched)
            s = np.round(score[at], 6)
            best = _best(s, k)
            parts.append((q, ids[at[best]], s[best]))
            score[at], touched[at] = 0.0, False
            if len(parts) == 1000:
                yield _found(parts)
                parts = []
        yield _found(parts)

    return _ranked(spread(vectors.select("id", "terms", "weights")).mapInArrow(run, FOUND), k)


def fuse(dense: DataFrame, sparse: DataFrame, top_k: int = TOP_K, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings ``(q, id, rank)``."""
    both = dense.select("q", "id", F.col("rank").alias("dr")).join(sparse.select("q", "id", F.col("rank").alias("sr")), ["q", "id"], "full")
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    w = W.partitionBy("q").orderBy(F.desc("score"), "id")
    return both.select("q", "id", F.round(part("dr") + part("sr"), 6).alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def merge_collections(found: DataFrame, key: str = "id") -> DataFrame:
    """``found (q, id, collection, priority, score, rank)`` of several collections: the first of each id by priority, sorted by score (null as 0)."""
    first = W.partitionBy("q", key).orderBy("priority", "rank")
    one = found.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    order = W.partitionBy("q").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "priority", "rank", key)
    return one.withColumn("place", F.row_number().over(order))


def rerank(found: DataFrame, scorer: Callable[[Column, Column], Column], top_k: int | None = None) -> DataFrame:
    """``found (q, id, query, text, ...)`` in the order of ``scorer(query, text)``, stable by the former rank."""
    w = W.partitionBy("q").orderBy(F.desc("rerank_score"), "rank", "id")
    out = found.withColumn("rerank_score", scorer(F.col("query"), F.col("text"))).withColumn("place", F.row_number().over(w))
    return out if top_k is None else out.where(F.col("place") <= top_k)


def overlap_score(query: Column, text: Column) -> Column:
    """The default scorer: the share of the query's distinct words that the text has."""
    w = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != ""))
    return F.round(F.coalesce(F.size(F.array_intersect(w(query), w(text))) / F.nullif(F.size(w(query)), F.lit(0)), F.lit(0.0)), 6)


def children(chunks: DataFrame, parents: DataFrame, top_k: int = 20) -> DataFrame:
    """Per parent ``(parent_id)`` its first ``top_k`` children by ``ord``."""
    w = W.partitionBy("parent_id").orderBy("ord")
    return chunks.join(parents.select("parent_id").distinct(), "parent_id", "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("parent_id", "rank", "ord", "chunk_id")


def parents_of(pool: DataFrame, chunks: DataFrame) -> DataFrame:
    """The first delivery of each pooled chunk's parent."""
    ids = pool.where("parent_id <> ''").select(F.col("parent_id").alias("chunk_id")).distinct()
    return chunks.join(ids, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min("ord").alias("ord"))


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``existing`` with ``new`` put in: of each key the latest new row by ``order``, else the row that was there."""
    w = W.partitionBy(key).orderBy(F.desc(order))
    latest = new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return existing.join(latest.select(key), key, "left_anti").select(*existing.columns).unionByName(latest.select(*existing.columns))


def verify_vectors(df: DataFrame, vec_col: str, dim: int, sparse_col: str | None = None, text_col: str | None = None, sample: int | None = None) -> DataFrame:
    """Rows, wrong dimensions, norms off 1 by more than 0.01, null vectors, and where given empty sparse vectors and missing texts.

    All rows are looked at; a ``sample`` of so many by a hash, 1 to 30, is the quick look that tools take.
    """
    if sample is not None:
        df = df.orderBy(F.xxhash64(vec_col)).limit(max(1, min(30, sample)))
    v, checks = F.col(vec_col), []
    if sparse_col:
        checks.append(F.count_if(F.col(sparse_col).isNull() | (F.size(sparse_col) == 0)).alias("empty_sparse"))
    if text_col:
        checks.append(F.count_if(X.is_empty_text(text_col)).alias("no_text"))
    return df.agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("missing"), F.count_if(F.size(v) != dim).alias("wrong_dim"), F.count_if(F.abs(X.l2_norm(v) - 1) > 1e-2).alias("off_norm"), *checks)


def points(chunks: DataFrame, vec_col: str, dim: int, sparse_col: str | None = None, key: str = "chunk_id") -> DataFrame:
    """Rows ready to be put into a collection: a point id, the payload with metadata that is never null, and the vectors; a vector of another dimension or an empty sparse one is an error."""
    bad = (F.size(vec_col) != dim) | F.col(vec_col).isNull()
    told = lambda what: F.raise_error(F.concat(F.lit(f"{what} of "), F.col(key)))
    vectors = [F.when(bad, told("wrong dimension").cast("array<float>")).otherwise(F.col(vec_col).cast("array<float>")).alias("dense")]
    if sparse_col:
        vectors.append(F.when(F.col(sparse_col).isNull() | (F.size(sparse_col) == 0), told("empty sparse vector").cast("map<string,double>")).otherwise(F.col(sparse_col)).alias("sparse"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    payload = [F.coalesce("meta", none).alias("meta") if c == "meta" else F.col(c) for c in chunks.columns if c not in (vec_col, sparse_col)]
    return chunks.select(X.uuid5(key).alias("point_id"), F.struct(*payload).alias("payload"), *vectors)


def gold_hits(found: DataFrame, gold: DataFrame) -> DataFrame:
    """``(q, rank)`` of results ``(q, doc, section_no, rank)`` that are in ``gold (q, doc, section_no)``; a null section in it stands for any."""
    g = gold.select("q", "doc", F.col("section_no").alias("wanted"))
    return found.join(g, ["q", "doc"]).where(F.col("wanted").isNull() | (F.col("section_no").cast("string") == F.col("wanted"))).select("q", "rank").distinct()


def gold_recall(before: DataFrame, after: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """``(stage, k, n_queries, hits, recall)`` of two rankings of the same queries, before and after reranking: a query counts if one of its first ``k`` results is gold."""
    asked = gold.select("q").distinct()
    parts = []
    for stage, found in (("retrieved", before), ("reranked", after)):
        hit = gold_hits(found.where(F.col("rank") <= k), gold).select("q").distinct().withColumn("hit", F.lit(1))
        one = asked.join(hit, "q", "left").agg(F.count("*").alias("n_queries"), F.count("hit").alias("hits"))
        parts.append(one.select(F.lit(stage).alias("stage"), F.lit(k).alias("k"), "n_queries", "hits", F.round(F.col("hits") / F.col("n_queries"), 6).alias("recall")))
    return parts[0].unionByName(parts[1])


def recall_at(found: DataFrame, gold: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Per ``k`` the share of queries of which one of the first ``k`` results is in ``gold (q, id)``; queries without results count 0."""
    hit = found.join(gold, ["q", "id"]).groupBy("q").agg(F.min("rank").alias("first"))
    all_ = gold.select("q").distinct().join(hit, "q", "left")
    one = all_.agg(F.count("*").alias("n_queries"), *(F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"r{k}") for k in ks))
    rows = one.select("n_queries", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in ks))).alias("x"))
    return rows.select("x.k", "n_queries", "x.recall")
