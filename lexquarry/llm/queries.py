"""Queries of the training-data operators, by name; SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm import canonical, confusables, encoding, mixing, names, neardup, ocr, splitting


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of the same person or organisation."""
    return names.variant_pairs(names.case_spellings(_t(spark, sf_dir, "extracted_docs"), _t(spark, sf_dir, "chunks")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue entry of every legislation file name and of every instrument cited, -1 for none."""
    found = canonical.instruments(_t(spark, sf_dir, "chunks"), _t(spark, sf_dir, "act_catalog"))
    return found.select("field", "item", F.col("entry").alias("act_id")).distinct()


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that have no entry, and how often each was entered."""
    found = canonical.instruments(_t(spark, sf_dir, "chunks"), _t(spark, sf_dir, "act_catalog"))
    return found.where(F.col("entry") == canonical.NONE).groupBy("field", "value").agg(F.count("*").alias("n"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of scanned pages that are furniture, broken or misread."""
    docs = _t(spark, sf_dir, "extracted_docs")
    return ocr.noisy_lines(docs, ocr.learn(docs)).distinct()


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The continuous readable paragraphs of every document."""
    docs = _t(spark, sf_dir, "extracted_docs")
    return ocr.readable(docs, ocr.learn(docs))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at least 40 words whose sets of three-word runs have a Jaccard similarity of 0.6 or more."""
    members, pairs = neardup.near_duplicates(_t(spark, sf_dir, "chunks"), "chunk_id")
    return neardup.linked_ids(members, pairs, "chunk_id").select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def _oversized_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "chunks").where(~F.coalesce("is_parent", F.lit(False)))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that are not parents and hold more than 600 words."""
    return splitting.split_oversized(_oversized_chunks(spark, sf_dir), ["ord"]).where("piece = 1").select("ord")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their pieces of at most 600 words, with up to 60 words repeated."""
    return splitting.split_oversized(_oversized_chunks(spark, sf_dir), ["ord", "chunk_id", "section_no"])


def p6_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every oversized chunk the words that its pieces hold beside the repeated ones, and whether no piece is too long or repeats too much."""
    pieces = splitting.split_oversized(_oversized_chunks(spark, sf_dir), ["ord"])
    return pieces.groupBy("ord").agg(F.sum(F.col("words") - F.col("repeated")).alias("words"), (F.max("words") <= 600).alias("fits"), (F.max("repeated") <= 60).alias("repeats_little"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return encoding.encode_corpus(_t(spark, sf_dir, "documents")).select("doc_id", "ids")


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    sizes = encoding.token_counts(_t(spark, sf_dir, "documents"), ["doc_id", "source"])
    sizes = sizes.withColumn("members", F.array("source"))
    return mixing.mix_sources(sizes, _t(spark, sf_dir, "mix_targets"), "doc_id", "members", "size")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix, each with its source and the number of times it is used."""
    return _mix(spark, sf_dir).documents


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every listed source, with its shortfall."""
    return _mix(spark, sf_dir).shares


def p8_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every listed source keeps its cap and its target, a document more at most."""
    mix = _mix(spark, sf_dir)
    largest = mix.documents.groupBy("source").agg(F.max("size").alias("largest"))
    kept = mix.shares.join(largest, "source", "left").select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), (F.col("mixed_tokens") <= F.col("target_tokens") + F.coalesce("largest", F.lit(0))).alias("within_target"))
    return kept


def p8_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of distinct texts, each of which belongs to all listed sources that have it."""
    targets = _t(spark, sf_dir, "mix_targets")
    docs = _t(spark, sf_dir, "documents").withColumn("same", F.md5("text"))
    listed = encoding.token_counts(docs, ["doc_id", "source", "same"]).join(targets.select("source").distinct(), "source", "left_semi")
    texts = listed.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"), F.collect_set("source").alias("members"))
    return mixing.mix_sources(texts, targets, "doc_id", "members", "size").documents


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents whose texts display alike although their characters differ."""
    pairs = confusables.display_alike(_t(spark, sf_dir, "documents"))
    return pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every document's text."""
    return confusables.consistent_forms(_t(spark, sf_dir, "documents")).select("doc_id", "form")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_unmatched": p2_unmatched,
    "p4_found": p4_found,
    "p4_paragraphs": p4_paragraphs,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p6_cover": p6_cover,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_caps": p8_caps,
    "p8_overlap": p8_overlap,
    "p9_found": p9_found,
    "p9_forms": p9_forms,
}

SQL: dict[str, str] = {
    "p6_cover": r"""
        SELECT ord, len(regexp_extract_all(text, '\S+')) AS words, true AS fits, true AS repeats_little FROM chunks
        WHERE is_parent IS DISTINCT FROM true AND len(regexp_extract_all(text, '\S+')) > 600""",
    "p8_caps": "SELECT source, true AS within_cap, true AS within_target FROM mix_targets WHERE source IS NOT NULL",
    "p6_found": r"""
        SELECT ord FROM chunks
        WHERE is_parent IS DISTINCT FROM true AND len(regexp_extract_all(text, '\S+')) > 600""",
}
