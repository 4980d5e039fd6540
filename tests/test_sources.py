from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexquarry import storage
from lexquarry.sources import files, tables
from lexquarry.streaming import ingest


def test_json_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "t": "é"}, 5, {"id": 2}, None]))
    (tmp_path / "b.json").write_text(json.dumps({"x": {"id": 3}, "y": "no"}))
    (tmp_path / "c.json").write_text('{"id": 4}, {"id": 5}]')
    (tmp_path / "d.json").write_text("not json")
    got = files.json_records(spark, str(tmp_path), "id int, t string")
    assert sorted((r.id, r.t) for r in got.collect()) == [(1, "é"), (2, None), (3, None), (4, None), (5, None)]
    shapes = {r.file[-6:]: (r.shape, r.rejected) for r in files.json_rejects(spark, str(tmp_path)).collect()}
    assert shapes == {"a.json": ("list", 2), "b.json": ("dict", 1), "c.json": ("repaired", 0), "d.json": ("invalid", 0)}


def test_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo")
    (tmp_path / "b.txt").write_bytes(b"bad")

    def picky(content: bytes) -> list[str]:
        if content == b"bad":
            raise ValueError("bad")
        return files.text_pages(content)

    got = {r.name: (r.pages, r.error) for r in files.read_pages(spark, str(tmp_path), "*.txt", picky).collect()}
    assert got == {"a.txt": (["one", "two"], None), "b.txt": (None, "ValueError: bad")}


def test_collections(spark, tmp_path):
    path = str(tmp_path / "points")
    df = spark.createDataFrame([("a", 1), ("b", 1)], "k string, ord int")
    tables.create(df, path)
    with pytest.raises(FileExistsError):
        tables.create(df, path)
    tables.put(spark.createDataFrame([("b", 2), ("c", 1)], "k string, ord int"), path, "k", "ord")
    tables.put(spark.createDataFrame([("b", 2), ("c", 1)], "k string, ord int"), path, "k", "ord")
    assert sorted(map(tuple, tables.load(spark, path).collect())) == [("a", 1), ("b", 2), ("c", 1)]
    assert tables.versions(spark, path) == [2, 3]
    before = {str(p) for p in (tmp_path / "points" / "data").rglob("*.parquet")}
    tables.put(spark.createDataFrame([("c", 2)], "k string, ord int"), path, "k", "ord")
    after = {str(p) for p in (tmp_path / "points" / "data").rglob("*.parquet")}
    assert sorted(map(tuple, tables.load(spark, path).collect())) == [("a", 1), ("b", 2), ("c", 2)] and len(before & after) >= 2  # untouched buckets stay
    tables.put(spark.createDataFrame([], "k string, ord int"), path, "k", "ord")
    assert tables.load(spark, path).count() == 3
    assert tables.present(spark, str(tmp_path), ["points", "none"]) == ["points"] and tables.present(spark, str(tmp_path), ["none"]) == ["none"]
    tables.create(df, path, recreate=True)
    assert tables.versions(spark, path) == [1]
    with pytest.raises(FileNotFoundError):
        tables.load(spark, str(tmp_path / "no"))


def test_a_version_is_made_once(spark, tmp_path):
    path = str(tmp_path / "x")
    tables.create(spark.createDataFrame([("a", 1)], "k string, ord int"), path, key="k")
    with pytest.raises(FileExistsError):
        tables._commit(spark, path, 1, {})
    assert tables.versions(spark, path) == [1] and tables.load(spark, path).count() == 1


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "b_Act 1930.txt").write_text("1. Short title\n\fPART II\nthe long words of this line are fine")
    (tmp_path / "a (1).txt").write_text("a b c d e f g h")
    (tmp_path / "bad.txt").write_bytes(b"bad")

    def picky(content: bytes) -> list[str]:
        if content == b"bad":
            raise ValueError("bad")
        return files.text_pages(content)

    got = [(r.ord, r.name, r.title, r.doc_type, r.needs_ocr, r.error) for r in files.extract_documents(spark, str(tmp_path), "*.txt", picky).orderBy(F.col("ord").asc_nulls_last()).collect()]
    assert got == [(1, "a (1).txt", "a", "paragraph", True, None), (2, "b_Act 1930.txt", "b Act 1930", "statute", False, None), (None, "bad.txt", "bad", None, None, "ValueError: bad")]


def test_a_strict_list(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}]')
    (tmp_path / "b.json").write_text('[{"id": 1}, 5]')
    (tmp_path / "c.json").write_text('{"x": {"id": 1}}')
    assert [tuple(r) for r in files.json_list(spark, str(tmp_path / "a.json"), "id int").collect()] == [(1,)]
    for name in ("b.json", "c.json"):
        with pytest.raises(ValueError):
            files.json_list(spark, str(tmp_path / name), "id int")
    with pytest.raises(Exception, match="(?i)path"):
        files.json_list(spark, str(tmp_path / "none.json"), "id int")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "ä", [1.0]), ("b", None, None)], "chunk_id string, text string, embedding array<float>")
    assert tables.write_json_array(df.select("chunk_id", "text"), str(tmp_path / "x.json")) == 2
    assert json.loads((tmp_path / "x.json").read_text())[0] == {"chunk_id": "a", "text": "ä"}
    with pytest.raises(ValueError):
        tables.write_json_array(df, str(tmp_path / "y.json"), 1)
    tables.write_embedded(df.select("chunk_id", "text"), df.select("chunk_id", "embedding").where("embedding is not null"), str(tmp_path / "v"))
    assert [(r.chunk.text, r.embedding) for r in spark.read.parquet(str(tmp_path / "v")).collect()] == [("ä", [1.0])]
    nodes, edges = spark.createDataFrame([("Act",)], "label string"), spark.createDataFrame([("CITES",)], "type string")
    tables.graph_document(nodes, edges, spark.createDataFrame([("no_act_name",), ("no_act_name",)], "reason string"), str(tmp_path / "g"))
    assert {(r.kind, r.name, r.n) for r in spark.read.json(str(tmp_path / "g" / "counts")).collect()} == {("node", "Act", 1), ("edge", "CITES", 1), ("skipped", "no_act_name", 2)}


def test_environment(tmp_path):
    (tmp_path / ".env").write_text("# c\nTOP_K = '9'\n\nexport B=x=y\nbroken\n")
    env = tables.environment(str(tmp_path / ".env"), {"TOP_K": "5"})
    assert env == {"TOP_K": "5", "B": "x=y"} and tables.environment(str(tmp_path / ".env"), {"TOP_K": "5"}, True)["TOP_K"] == "9"
    assert tables.Settings.from_mapping(env).top_k == 5 and tables.environment(str(tmp_path / "none"), {"A": "1"}) == {"A": "1"}


def test_storage_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        applicationId, master = "x", "local-cluster[2,1,512]"

    class Session:
        sparkContext = Context

        class conf:  # noqa: N801
            get = staticmethod(lambda k, d: d)

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session)
    joined = spark.range(5).join(spark.range(5), "id")
    assert storage.spread(joined) is joined and storage.spread(spark.range(3)).rdd.getNumPartitions() >= 4


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä"), (2, None)], "a int, b string")
    tables.write_json_lines(df, str(tmp_path / "x"))
    assert sorted(map(tuple, files.read_json_lines(spark, str(tmp_path / "x"), "a int, b string").collect())) == [(1, "ä"), (2, None)]


def test_settings():
    s = tables.Settings.from_mapping({"top_k": "7", "threshold": "", "max_hops": None, "other": 1})
    assert (s.top_k, s.threshold, s.max_hops) == (7, 0.4, 1)
    o = tables.ontology()
    assert {n["label"] for n in o["nodes"]} >= {"Act", "Section", "Judgment"} and {"from": "Judgment", "to": "Court"} in next(r["ends"] for r in o["relationships"] if r["type"] == "DECIDED_BY")


def test_stream_keeps_each_record_once(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda *x: spark.createDataFrame(x, "k string, ord int, t string").selectExpr("k", "ord", "timestamp(t) t")
    rows(("a", 1, "2024-01-01"), ("b", 2, "2024-01-02"), (None, 3, "2024-01-02"), ("a", 1, "2024-01-01")).write.parquet(folder)
    got = ingest.ingest(spark, folder, "*.parquet", target, "k", "ord")
    assert sorted(r.k for r in got.collect()) == ["a", "b"]
    rows(("b", 5, "2024-01-03"), ("c", 6, "2024-01-03")).write.mode("append").parquet(folder)
    got = ingest.ingest(spark, folder, "*.parquet", target, "k", "ord")
    assert sorted((r.k, r.ord) for r in got.collect()) == [("a", 1), ("b", 5), ("c", 6)]
