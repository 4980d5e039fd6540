from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexquarry.functions import text as X


def one(spark, expr, *values, types="string"):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {types}" for i in range(len(values))))
    return df.select(expr.alias("v")).first().v


def test_words(spark):
    assert one(spark, X.n_words("c0"), "  a b\n\tc ") == 3
    assert one(spark, X.n_words("c0"), "") == 0
    assert one(spark, X.first_words("c0", 2), "a  b c") == "a b"
    assert one(spark, X.first_words("c0", 5), "a  b c") == "a  b c"
    assert one(spark, X.n_words("c0"), None) in (None, -1)


def test_shorten(spark):
    assert one(spark, X.shorten("c0", 8), "ab\ncdefgh") == "ab cd..."
    assert one(spark, X.shorten("c0", 9), "ab\ncdefgh") == "ab cdefgh"


def test_names(spark):
    assert one(spark, X.title_from_filename("c0"), "A_b  (1)UPDATED.pdf") == "A b UPDATED"
    assert one(spark, X.friendly_name("c0"), "x_1234567.PDF") == "x"
    assert one(spark, X.friendly_name("c0"), ".pdf") == "Document"


def test_lines_and_garbled(spark):
    assert one(spark, X.clean_lines("c0"), "a  \nPage 2 of 3\n 12 \n\nb") == ["a", "", "b"]
    assert one(spark, X.looks_garbled("c0"), "a b c d e f") is True
    assert one(spark, X.looks_garbled("c0"), "the words of this line are long") is False
    assert one(spark, X.looks_garbled("c0"), "") is True


def test_gazette_threshold(spark):
    assert one(spark, X.gazette_score("c0"), "S.R.O. 12") == 2
    assert one(spark, X.gazette_score("c0"), "NOTIFICATION") == 1
    assert one(spark, X.gazette_score("c0"), "S R O 12") == one(spark, X.gazette_score("c0"), "SRO12") == 2
    assert one(spark, X.gazette_score("c0"), "NOTIFICATIONS GAZETTED EXTRAORDINARY") == 0
    assert one(spark, X.doc_type_of("c0", "c1"), "NOTIFICATION", "x.pdf") == "paragraph"
    assert one(spark, X.doc_type_of("c0", "c1"), "S.R.O. 12", "x.pdf") == "rules"


def test_doc_type_ladder(spark):
    assert one(spark, X.doc_type_of("c0", "c1"), "PART II\nx", "the ORDER.pdf") == "order"
    assert one(spark, X.doc_type_of("c0", "c1"), "Amendment of section 4", "a.pdf") == "amendment"
    assert one(spark, X.doc_type_of("c0", "c1"), "x\nCHAPTER IV\n", "a.pdf") == "statute"
    assert one(spark, X.doc_type_of("c0", "c1"), "JUDGMENT SHEET\nA vs B", "a.pdf") == "judgement"
    assert one(spark, X.doc_type_of("c0", "c1", False), "JUDGMENT SHEET\nA vs B", "a.pdf") == "paragraph"
    assert one(spark, X.doc_type_of("c0", "c1"), None, None) == "paragraph"


def test_case_header(spark):
    full = one(spark, X.case_header("c0"), "[Case: High Court of Osk | A vs B | W.P. No. 3/2010] [Para 2]")
    assert (full.court, full.case_no, full.parties) == ("High Court of Osk", "W.P. No. 3/2010", "A vs B")
    single = one(spark, X.case_header("c0"), "[Case: W.P. No. 3/2010]")
    assert (single.court, single.case_no, single.parties) == (None, "W.P. No. 3/2010", None)
    more = one(spark, X.case_header("c0"), "[Case: A vs B | High Court of Osk | Civil Court | W.P. No. 3/2010 | Appeal 4]")
    assert (more.court, more.case_no, more.parties) == ("High Court of Osk", "W.P. No. 3/2010", "A vs B | Civil Court | Appeal 4")
    none = one(spark, X.case_header("c0"), "no header")
    assert (none.court, none.case_no, none.parties) == (None, None, None)


def test_split_parties(spark):
    assert one(spark, X.split_parties("c0"), "A. Khan etc. VS. The State & others") == ["A. Khan", "The State"]
    assert one(spark, X.split_parties("c0"), " ;A. Khan, versus The State: , v ,;") == ["A. Khan", "The State"]


def test_context(spark):
    df = spark.sql("select 'A vs B' p, cast(null as string) c, array('1','2','3','4') n")
    assert df.select(X.case_context(F.col("p"), F.col("c"), F.col("n"), F.lit(7)).alias("v")).first().v == "[Case: A vs B | 1; 2; 3] [Para 7]"
    assert df.select(X.case_context(F.lit(""), F.col("c"), F.lit(None).cast("array<string>"), F.lit(7)).alias("v")).first().v == ""


def test_uuid5(spark):
    for s in ("a:section:1", "Straße:para:2", "文:1", ""):
        assert one(spark, X.uuid5("c0"), s) == str(uuid.uuid5(uuid.NAMESPACE_DNS, s))


def test_headings_and_paragraphs(spark):
    assert one(spark, X.heading("c0", "c1"), "3", "") == "3"
    assert one(spark, X.paragraphs("c0"), "a\n\n \nb\nc\n\n") == ["a", "b\nc"]


def test_lenient_int(spark):
    assert [one(spark, X.lenient_int("c0"), s) for s in ("7", "7.9", "x", "", None)] == [7, 7, None, None, None]


def test_percent(spark):
    df = spark.sql("select 1 n, 8 t union all select 0, 0")
    assert [r.v for r in df.select(X.percent_text(F.col("n"), F.col("t")).alias("v")).collect()] == ["1 (12%)", "0 (0%)"]


def test_act_names(spark):
    df = spark.createDataFrame([("A.pdf",), (".pdf",), (None,), ("B.pdf",)], "d string")
    assert [r.a for r in df.select(X.act_name("d", F.create_map(F.lit("A.pdf"), F.lit("Act of A"))).alias("a")).collect()] == ["Act of A", None, None, "B"]
    same = ["copy_of_The Coastal Rules, 1933 (1)UPDATED_67104593.pdf", "12345678 Coastal Rules of 1933-ocr.PDF", "COASTAL RULES NO. VII OF 1933 [1234567].pdf", "Coastal Rules 1933"]
    assert {one(spark, X.plain_title("c0"), t) for t in same} == {"coastal rules 1933"}


def test_amended_sections(spark):
    df = spark.sql("select map('amends_section', '4') m, 'Amendment of section 9' t union all select map('amends_section', ''), 'amendment of section 9-A of it' union all select null, 'Amendment of sub-section 3' union all select null, null")
    assert [r.s for r in df.select(X.amended_section("t", "m").alias("s")).collect()] == ["4", "9-A", None, None]
