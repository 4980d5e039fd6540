"""Profiles of a chunk table: fields, counts, percentiles, structure and integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexquarry.functions import text as X


def is_empty(c: Column, kind: str) -> Column:
    """Null, an empty text, list or map; 0 and false are values."""
    if kind == "string":
        return c.isNull() | (c == "")
    if kind.startswith(("array", "map")):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def profile_fields(df: DataFrame, fields: list[str], order: str) -> DataFrame:
    """Per field: type, rows, nulls, non-empty rows, coverage (4 decimals), distinct values and the first example by ``order``.

    One pass makes one row per field and value with its count and first position
    (partial aggregation in the map tasks), a second sums those up; so a field with a
    hot value costs no more than others.
    """
    types = dict(df.dtypes)
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(types[f]).alias("type"), (F.to_json(f) if types[f].startswith(("array", "map", "struct")) else F.col(f).cast("string")).alias("value"), is_empty(F.col(f), types[f]).alias("empty")) for f in fields))
    long = df.select(F.col(order).alias("_ord"), F.explode(cells).alias("c")).select("_ord", "c.*")
    values = long.groupBy("field", "type", "value", "empty").agg(F.count("*").alias("n"), F.min("_ord").alias("at"))
    full = ~F.col("empty")
    return values.groupBy("field", "type").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(full, F.col("n"))), F.lit(0)).alias("non_empty"),
        F.round(F.coalesce(F.sum(F.when(full, F.col("n"))), F.lit(0)) / F.sum("n"), 4).alias("coverage"),
        F.count(F.when(full, 1)).alias("n_distinct"),
        F.min_by(F.when(full, F.col("value")), F.when(full, F.col("at"))).alias("example"),
    )


def categorical_counts(df: DataFrame, fields: list[str], order: str, most: int = 60) -> DataFrame:
    """The ``most`` commonest values of each field (ties in order of first appearance) and how many there are."""
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    long = df.select(F.col(order).alias("_ord"), F.explode(cells).alias("c")).select("_ord", "c.*").where("value <> ''")
    counts = long.groupBy("field", "value").agg(F.count("*").alias("n"), F.min("_ord").alias("_at"))
    totals = counts.groupBy("field").agg(F.count("*").alias("n_distinct"))
    rank = F.row_number().over(W.partitionBy("field").orderBy(F.desc("n"), "_at"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).drop("_at").join(F.broadcast(totals), "field")


def counts_per(df: DataFrame, field: str) -> DataFrame:
    return df.groupBy(field).agg(F.count("*").alias("n"))


def meta_keys(df: DataFrame, meta: str, order: str) -> DataFrame:
    """How often each key occurs, and its first value by ``order``."""
    long = df.select(F.col(order).alias("_ord"), F.explode(meta).alias("key", "value"))
    return long.groupBy("key").agg(F.count("*").alias("n"), F.min_by("value", "_ord").alias("sample"))


def nearest_rank(df: DataFrame, value: Column) -> DataFrame:
    """Count, least, median, 95th percentile and largest by nearest rank; nulls take no part."""
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY v)")
    return df.select(value.alias("v")).agg(F.count("v").alias("n"), F.min("v").alias("least"), at(0.5).cast(df.select(value).schema[0].dataType).alias("p50"), at(0.95).cast(df.select(value).schema[0].dataType).alias("p95"), F.max("v").alias("largest"))


#: Names of the types that values of records have.
TYPE_NAMES = {"VOID": "null", "BOOLEAN": "bool", "BIGINT": "int", "DECIMAL": "float", "DOUBLE": "float", "FLOAT": "float", "STRING": "str", "ARRAY": "list", "OBJECT": "dict"}


def type_name(v: Column) -> Column:
    """The name of a variant's type."""
    kind = F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in TYPE_NAMES.items() for x in kv)), kind), F.lower(kind))


def profile_records(df: DataFrame, records: str, order: str) -> DataFrame:
    """``(field, majority, types, n_rows, coverage, nulls, n_distinct, example)`` of the fields of records, a column of variants.

    ``types`` counts the types of a field's values; the majority is the commonest of
    those that aren't null, the first by name of equals.  The rows of a field are the
    records that have it; coverage is its share of values that aren't empty in all records.
    """
    n = df.count()
    df.createOrReplaceTempView("_lexquarry_records")
    long = df.sparkSession.sql(f"SELECT `{order}` AS at, e.key AS field, e.value AS v FROM _lexquarry_records, LATERAL variant_explode(`{records}`) AS e")
    said = F.to_json("v")
    cells = long.select("at", "field", type_name(F.col("v")).alias("type"), said.alias("value"), (F.col("v").isNull() | F.is_variant_null("v") | said.isin('""', "[]", "{}")).alias("empty"))
    values = cells.groupBy("field", "type", "value", "empty").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    full = ~F.col("empty")
    kinds = values.groupBy("field", "type").agg(
        F.sum("n").alias("n"), F.sum(F.when(full, F.col("n")).otherwise(0)).alias("full"), F.count(F.when(full, 1)).alias("n_distinct"), F.min(F.when(full, F.struct("at", "value"))).alias("first"),
    )
    known = F.when(F.col("type") != "null", F.struct((-F.col("n")).alias("n"), "type"))
    types = F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n"))))
    return kinds.groupBy("field").agg(
        F.coalesce(F.min(known)["type"], F.lit("null")).alias("majority"), types.alias("types"), F.sum("n").alias("n_rows"), F.round(F.sum("full") / F.lit(max(1, n)), 4).alias("coverage"),
        F.coalesce(F.sum(F.when(F.col("type") == "null", F.col("n"))), F.lit(0)).alias("nulls"), F.sum("n_distinct").alias("n_distinct"), F.min("first")["value"].alias("example"),
    )


def structure_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("n"), F.countDistinct(F.nullif("parent_id", F.lit(""))).alias("parents"), F.count_if(F.col("parent_id") != "").alias("with_parent"),
        F.count_if("is_parent").alias("parent_rows"), F.count_if(~F.col("is_parent")).alias("other_rows"),
    )


def sequence_mismatch(df: DataFrame) -> DataFrame:
    """Sections whose number in the id differs from the section number."""
    seq = F.regexp_extract("chunk_id", r":(\d+)$", 1).try_cast("int")
    no = F.regexp_extract("section_no", r"^(\d+)", 1).try_cast("int")
    both = df.where((F.col("level") == "section") & seq.isNotNull() & no.isNotNull()).select((seq != no).alias("differs"))
    return both.agg(F.count("*").alias("compared"), F.count_if("differs").alias("mismatched"), F.round(F.count_if("differs") / F.count("*"), 4).alias("ratio"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Composite keys that occur more than once; keys with a null or empty part are left out."""
    full = reduce(Column.__and__, [F.col(k).isNotNull() & (F.col(k) != "") for k in keys])
    return df.where(full).groupBy(*keys).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")).where("n > 1")


def amendment_coverage(df: DataFrame) -> DataFrame:
    a = df.where(F.lower("doc_type") == "amendment")
    return a.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.element_at("meta", "amends_section"), F.lit("")) != "").alias("in_meta"), F.count_if(F.regexp_extract("text", X.AMENDED_SECTION, 1) != "").alias("in_text"))


def header_coverage(df: DataFrame) -> DataFrame:
    j = df.where(F.lower("doc_type").isin("judgement", "judgment"))
    context = F.coalesce(F.element_at("meta", "context"), F.lit(""))
    return j.agg(F.count("*").alias("n"), F.count_if(F.contains(context, F.lit("Case:"))).alias("with_header"), F.count_if(F.contains(context, F.lit("|"))).alias("with_parts"))


def broken_parents(df: DataFrame) -> DataFrame:
    """Rows whose parent is not among the ids."""
    ids = df.select(F.col("chunk_id").alias("parent_id")).distinct()
    return df.where(F.col("parent_id") != "").select("ord", "chunk_id", "parent_id").join(ids, "parent_id", "left_anti")


def doc_summary(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks and largest token count per document; documents without chunks have 0."""
    per = chunks.groupBy(F.col("doc").alias("name")).agg(F.count("*").alias("n_chunks"), F.max("tokens").alias("max_tokens"))
    return docs.select("name").distinct().join(per, "name", "left").select("name", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("max_tokens", F.lit(0)).alias("max_tokens"))


def running_footers(docs: DataFrame, id_col: str, most: int = 90, least: int = 3) -> DataFrame:
    """Short lines that occur ``least`` times or more in a document."""
    rows = docs.select(F.col(id_col), F.explode(F.split(F.array_join("pages", "\n"), "\n")).alias("line")).withColumn("line", F.trim("line"))
    return rows.where((F.col("line") != "") & (F.length("line") <= most)).groupBy(id_col, "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def text_statistics(df: DataFrame) -> DataFrame:
    """Words, heading and paragraph structure of every chunk."""
    p = X.paragraphs("text")
    return df.select("ord", X.n_words("text").alias("n_words"), X.heading("section_no", "section_title").alias("heading"), F.size(p).alias("n_paragraphs"), F.coalesce(F.get(p, F.lit(0)).rlike(r"^\(\s*\d+[a-z]?\)"), F.lit(False)).alias("is_subsection"), X.shorten("text", 60).alias("short"), F.length(X.first_words("text", 20)).alias("first_words_length"))
