"""Reading documents and records: directories of pages, tolerant JSON, JSON lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from lexquarry.functions import text as X
from lexquarry.storage import cut

#: A page extractor: from a file's bytes to the texts of its pages.
Extractor = Callable[[bytes], list[str]]


def pdf_pages(content: bytes) -> list[str]:
    """Pages of a PDF, opened with an empty password if it is encrypted; needs the optional ``pypdf``."""
    import io

    from pypdf import PdfReader

    reader = PdfReader(io.BytesIO(content))
    if reader.is_encrypted:
        reader.decrypt("")
    return [p.extract_text() or "" for p in reader.pages]


def text_pages(content: bytes) -> list[str]:
    """Pages of a plain text, parted by form feeds."""
    return content.decode("utf-8", "replace").split("\f")


def read_pages(spark: SparkSession, folder: str, glob: str = "*.pdf", extract: Extractor = pdf_pages) -> DataFrame:
    """``(name, path, pages, error)`` of a folder's files; a file that can't be read has a null ``pages`` and its error.

    Files are spread over the executors; order by ``name`` where order matters.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, content in zip(p["path"], p["content"]):
                try:
                    rows.append((path.rsplit("/", 1)[-1], path, extract(bytes(content)), None))
                except Exception as e:  # noqa: BLE001 - one bad file must not end the job
                    rows.append((path.rsplit("/", 1)[-1], path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["name", "path", "pages", "error"])

    return files.select("path", "content").mapInPandas(run, "name string, path string, pages array<string>, error string")


def extract_documents(spark: SparkSession, folder: str, glob: str = "*.[pP][dD][fF]", extract: Extractor = pdf_pages, judgments: bool = True) -> DataFrame:
    """``(ord, name, path, title, pages, text, doc_type, needs_ocr, error)`` of a folder's files, numbered by name.

    The title is made from the name, the kind is detected from text and name, and a
    text that looks garbled needs character recognition.  A file that can't be read
    has its error and nothing else, and no number.
    """
    docs = read_pages(spark, folder, glob, extract).withColumn("text", F.array_join("pages", "\n", ""))
    docs = cut(docs)  # the extractor runs once
    order = docs.where("error is null").select("path", F.row_number().over(W.orderBy("name", "path")).alias("ord"))
    known = F.col("error").isNull()
    return docs.join(order, "path", "left").select(
        "ord", "name", "path", X.title_from_filename("name").alias("title"), "pages", "text",
        F.when(known, X.doc_type_of("text", "name", judgments)).alias("doc_type"), F.when(known, X.looks_garbled("text")).alias("needs_ocr"), "error",
    )


def json_list(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The records of one file that must hold an array of objects; another shape, or no file, is an error."""
    shape = [(r.shape, r.rejected) for r in json_rejects(spark, path).collect()]
    if shape != [("list", 0)]:
        raise ValueError(f"{path} holds no list of records, but {shape}")
    return json_records(spark, path, schema).drop("file", "pos")


def json_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """``(file, pos, record)``: the objects of JSON files that hold an array, an object of objects, or an array without its ``[``.

    Items that are no objects are left out (``json_rejects`` counts them).  A file is
    one JSON value and can't be split; write JSON lines for large data.  With a
    ``schema`` the record's fields are columns.
    """
    rows = _items(spark, path).where("kind like 'OBJECT%'").select("file", "pos", "record")
    if schema is None:
        return rows
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    return rows.select("file", "pos", F.from_json(F.to_json("record"), ddl).alias("r")).select("file", "pos", "r.*")


def json_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Per file the shape found (``list``, ``dict``, ``repaired``, ``invalid``) and how many items were no objects."""
    shapes = _files(spark, path).select("file", "shape")
    bad = _items(spark, path).groupBy("file").agg(F.count_if(~F.col("kind").startswith("OBJECT")).alias("rejected"), F.count("*").alias("items"))
    return shapes.join(bad, "file", "left").na.fill(0, ["rejected", "items"])


def _files(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    headless = text.endswith("]") & ~text.startswith("[")  # the parser would take the first value and drop the rest
    v = F.try_parse_json(F.when(headless, F.concat(F.lit("["), "value")).otherwise(F.col("value")))
    kind = F.schema_of_variant("v")
    shape = F.when(kind.startswith("ARRAY"), F.when(headless, "repaired").otherwise("list")).when(kind.startswith("OBJECT"), "dict").otherwise("invalid")
    return raw.withColumn("v", v).withColumn("shape", shape)


def _items(spark: SparkSession, path: str) -> DataFrame:
    files = _files(spark, path).where("shape <> 'invalid'")
    name = "_lexquarry_json"
    files.createOrReplaceTempView(name)
    return spark.sql(f"SELECT file, e.pos, e.value AS record, schema_of_variant(e.value) AS kind FROM {name}, LATERAL variant_explode(v) AS e")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines by a fixed schema; lines that don't parse are null rows."""
    return spark.read.schema(schema).json(path)
