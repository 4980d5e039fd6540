"""Collections of records in a folder: create, upsert by version, choose, describe."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.operators.graph import EDGE_ENDS, EDGE_TYPES, NODE_KEYS, NODE_PROPERTIES, SOURCES
from lexquarry.operators.retrieval import upsert


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


#: Buckets of a collection, by the hash of its key: an upsert reads and writes those that it touches.
BUCKETS = 64
#: Versions that are kept: the latest and the one before, which readers may still be using.
KEPT = 2


def _read(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions of a collection, in order."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(m.group(1)) for n in names if (m := re.fullmatch(r"v(\d+)\.json", n)))


def _manifest(spark: SparkSession, path: str, version: int) -> dict[str, Any]:
    return json.loads(_read(spark, f"{path}/v{version}.json"))


def _commit(spark: SparkSession, path: str, version: int, manifest: dict[str, Any]) -> None:
    """Make a version visible at once, by a rename; a version that another writer has made meanwhile is an error."""
    fs, tmp = _fs(spark, f"{path}/.v{version}-{uuid.uuid4().hex}")
    out = fs.create(tmp, False)
    try:
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    finally:
        out.close()
    final = _fs(spark, f"{path}/v{version}.json")[1]
    if fs.exists(final) or not fs.rename(tmp, final):
        fs.delete(tmp, False)
        raise FileExistsError(f"{path} has a version {version} already")


def _bucketed(df: DataFrame, key: str | None, buckets: int) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int") if key else F.lit(0))


def _write(df: DataFrame, path: str) -> dict[str, str]:
    """Write rows with their ``_bucket``; the folder of each bucket."""
    spark, folder = df.sparkSession, f"{path}/data/{uuid.uuid4().hex}"
    df.repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
    fs, p = _fs(spark, folder)
    return {n.rsplit("=", 1)[1]: f"{folder}/{n}" for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith("_bucket=")}


def create(df: DataFrame, path: str, recreate: bool = False, key: str | None = None, buckets: int = BUCKETS) -> None:
    """Write the first version; refused if the collection is there, unless it is to be made anew."""
    spark = df.sparkSession
    if exists(spark, path):
        if not recreate:
            raise FileExistsError(path)
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    _commit(spark, path, 1, {"key": key, "n": buckets if key else 1, "schema": df.schema.json(), "buckets": _write(_bucketed(df, key, buckets), path)})


def _rows(spark: SparkSession, manifest: dict[str, Any], only: list[str] | None = None) -> DataFrame:
    folders = [f for b, f in sorted(manifest["buckets"].items()) if only is None or b in only]
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The latest finished version."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(path)
    return _rows(spark, _manifest(spark, path, found[-1]))


def put(new: DataFrame, path: str, key: str, order: str, buckets: int = BUCKETS) -> None:
    """Put rows in by ``key``, the latest by ``order`` winning; doing it twice changes nothing.

    Only the buckets that ``new`` touches are read and written again.  The new version
    becomes visible when all of it is written; a writer that dies leaves nothing that is
    read.  Of old versions the one before is kept, folders of older ones are removed.
    """
    spark = new.sparkSession
    found = versions(spark, path)
    if not found:
        create(upsert(new.limit(0), new, key, order), path, key=key, buckets=buckets)
        return
    manifest = _manifest(spark, path, found[-1])
    if manifest["key"] != key:  # made without this key: dealt into buckets once
        manifest = {"key": key, "n": buckets, "schema": manifest["schema"], "buckets": _write(_bucketed(_rows(spark, manifest), key, buckets), path)}
    rows = _bucketed(new, key, manifest["n"])
    touched = sorted(str(r[0]) for r in rows.select("_bucket").distinct().collect())
    merged = upsert(_rows(spark, manifest, touched), new, key, order)
    _commit(spark, path, found[-1] + 1, manifest | {"buckets": manifest["buckets"] | _write(_bucketed(merged, key, manifest["n"]), path)})
    _forget(spark, path, [*found, found[-1] + 1][:-KEPT])


def _forget(spark: SparkSession, path: str, old: list[int]) -> None:
    """Remove versions, and the folders of data that no other version uses."""
    fs, data = _fs(spark, f"{path}/data")
    for v in old:
        fs.delete(_fs(spark, f"{path}/v{v}.json")[1], False)
    used = {f for v in versions(spark, path) for f in _manifest(spark, path, v)["buckets"].values()}
    for write in fs.listStatus(data):
        name = write.getPath().getName()
        parts = [p.getPath().getName() for p in fs.listStatus(write.getPath()) if p.getPath().getName().startswith("_bucket=")]
        gone = [p for p in parts if f"{path}/data/{name}/{p}" not in used]
        if len(gone) == len(parts):
            fs.delete(write.getPath(), True)
            continue
        for p in gone:
            fs.delete(_fs(spark, f"{path}/data/{name}/{p}")[1], True)


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of two tables of records; a column that one lacks is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def present(spark: SparkSession, root: str, wanted: list[str]) -> list[str]:
    """Those of the wanted collections that are there; all of them if none is."""
    there = [c for c in wanted if versions(spark, f"{root}/{c}")]
    return there or list(wanted)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json_array(df: DataFrame, path: str, most: int = 100_000) -> int:
    """Write one pretty JSON array, for people and small tools; how many records.  The driver writes it, so more than ``most`` rows are refused."""
    spark = df.sparkSession
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} records; write JSON lines")
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps([json.loads(r) for r in rows], ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()
    return len(rows)


def write_embedded(chunks: DataFrame, vectors: DataFrame, path: str, key: str = "chunk_id", vec_col: str = "embedding") -> None:
    """Write chunks with their vectors, ``(chunk, embedding)`` records, as Parquet; a chunk without a vector is left out."""
    cols = [c for c in chunks.columns if c != vec_col]
    rows = chunks.join(vectors.select(key, vec_col), key).select(F.struct(*cols).alias("chunk"), vec_col)
    rows.write.mode("overwrite").parquet(path)


def graph_document(nodes: DataFrame, edges: DataFrame, reasons: DataFrame, path: str) -> None:
    """Write an extracted graph: tables of nodes and edges, and a small table of counts of nodes, edges and what was skipped."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    skipped = reasons.groupBy(F.col("reason").alias("name")).agg(F.count("*").alias("n")).select(F.lit("skipped").alias("kind"), "name", "n")
    spark = nodes.sparkSession
    counts = graph_counts(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")).unionByName(skipped)
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/counts")


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes by label and edges by type, ``(kind, name, n)``."""
    n = nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    e = edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "name", "n")
    return n.unionByName(e)


def without_labels(nodes: DataFrame, edges: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """The graph without nodes of these labels and the edges that end in them."""
    hit = lambda c: F.coalesce(F.col(c).isin(labels), F.lit(False))
    return nodes.where(~hit("label")), edges.where(~hit("from_label") & ~hit("to_label"))


def ontology() -> dict[str, Any]:
    """Kinds of nodes with their keys and properties, kinds of edges with the kinds of their ends, and where each comes from."""
    nodes = [{"label": k, "key": v, "properties": sorted({*v, *NODE_PROPERTIES.get(k, ())})} for k, v in NODE_KEYS.items()]
    edges = [{"type": t, "ends": [{"from": a, "to": b} for a, b in EDGE_ENDS[t]]} for t in EDGE_TYPES]
    return {"nodes": nodes, "relationships": edges, "sources": dict(SOURCES)}


def environment(path: str, current: dict[str, str], override: bool = False) -> dict[str, str]:
    """``current`` with the ``NAME=value`` lines of a file; what is set stays, unless ``override``.  Comments, blank lines and a missing file give nothing."""
    file = Path(path)
    said = {}
    for line in file.read_text(encoding="utf-8").splitlines() if file.exists() else ():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and name.strip() and not name.startswith("#"):
            said[name.strip()] = value.strip().strip("'\"")
    return current | said if override else said | current


@dataclass(frozen=True)
class Settings:
    """Settings of retrieval; ``from_mapping`` takes those that are named and not empty."""

    top_k: int = 20
    prefetch: int = 50
    rerank: int = 10
    fast: int = 6
    final: int = 20
    max_hops: int = 1
    threshold: float = 0.4
    kg_hops: int = 1
    max_nodes: int = 12
    seeds: int = 24

    @classmethod
    def from_mapping(cls, given: dict[str, Any], defaults: Settings | None = None) -> Settings:
        base = {f.name: getattr(defaults or cls(), f.name) for f in fields(cls)}
        for f in fields(cls):
            if (value := given.get(f.name, given.get(f.name.upper()))) not in (None, ""):
                base[f.name] = type(base[f.name])(value)
        return cls(**base)
