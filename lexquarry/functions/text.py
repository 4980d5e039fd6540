"""Scalar functions on text as Spark columns: words, lines, titles, headers, ids.

All of them give null for null input unless said otherwise, and run inside the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: Column | str) -> Column:
    """The maximal runs of characters other than white space."""
    return F.filter(F.split(col(c), r"\s+"), lambda x: x != "")


def n_words(c: Column | str) -> Column:
    return F.size(words(c))


def first_words(c: Column | str, n: int) -> Column:
    """The first ``n`` words joined by single spaces; a text that isn't longer stays as it is."""
    w = words(c)
    return F.when(F.size(w) > n, F.array_join(F.slice(w, 1, n), " ")).otherwise(col(c))


def shorten(c: Column | str, n: int = 140) -> Column:
    """On one line, and of at most ``n`` characters, the last three being dots where it was cut."""
    one = F.regexp_replace(col(c), "\n", " ")
    return F.when(F.length(one) <= n, one).otherwise(F.concat(F.left(one, F.lit(n - 3)), F.lit("...")))


def is_empty_text(c: Column | str) -> Column:
    return col(c).isNull() | (col(c) == "")


def title_from_filename(c: Column | str) -> Column:
    """A file name without extension, bracketed parts and runs of underscores or spaces."""
    s = F.regexp_replace(col(c), r"\.[^.]*$", "")
    s = F.regexp_replace(s, r"\([^)]*\)", "")
    return F.trim(F.regexp_replace(s, r"[_\s]+", " "))


def friendly_name(c: Column | str) -> Column:
    """A name for display: no ``.pdf``, no long number at the end; ``Document`` if nothing is left."""
    s = F.regexp_replace(col(c), r"(?i)\.pdf$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"_\d{6,}$", ""), r"^[ _]+|[ _]+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("Document"))


def act_name(doc: Column | str, aliases: Column | None = None) -> Column:
    """The key of the act that a file holds: what ``aliases``, a map from file names to names, says, else the file's stem; null for none."""
    stem = F.nullif(file_stem(doc), F.lit(""))
    return stem if aliases is None else F.coalesce(F.nullif(F.try_element_at(aliases, col(doc)), F.lit("")), stem)


# What is taken off a file's name, in this order, to leave its title in plain words.
PLAIN_STEPS = (
    (r"\.(?:pdf|docx?|txt)$", ""), (r"_", " "), (r"\(\d+\)\s*(?:updated)?|[\[(]?\b\d{6,}\b[\])]?", " "), (r"\bno\.?\s+[ivxlc\d]+\b", " "), (r"[^a-z0-9]+", " "),
    (r"\b(?:copy of|the|of|final|updated|ocr|amd|new|scan|scanned|draft)\b", " "), (r" +", " "),
)


def plain_title(c: Column | str) -> Column:
    """A title or file name in plain lower-case words, without what typists add to file names."""
    return F.trim(reduce(lambda s, step: F.regexp_replace(s, *step), PLAIN_STEPS, F.lower(col(c))))


# The section that an amending text names, and as the title of a rule names it.
AMENDED_SECTION = r"(?i)Amendment of section\s+([\dA-Za-z\-]+)"


def amended_section(text: Column | str, meta: Column | str) -> Column:
    """The section that an amending chunk amends: what its metadata says, else its text."""
    said = F.nullif(F.element_at(col(meta), "amends_section"), F.lit(""))
    return F.coalesce(said, F.nullif(F.regexp_extract(col(text), AMENDED_SECTION, 1), F.lit("")))


def file_stem(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\.[^.]*$", ""))


# Lines that are page numbers.
PAGE_LINE = r"(?i)^\s*page\s+\d+\s+of\s+\d+\s*$"
NUMBER_LINE = r"^\s*-?\d+\s*-?\s*$"


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n")


def clean_lines(c: Column | str) -> Column:
    """Lines without page numbers; blank ones become empty, others lose spaces at their end."""
    kept = F.filter(lines(c), lambda x: ~x.rlike(PAGE_LINE) & ~x.rlike(NUMBER_LINE))
    return F.transform(kept, lambda x: F.regexp_replace(x, r"\s+$", ""))


def looks_garbled(c: Column | str) -> Column:
    """More than a quarter of the tokens have one character, or there are under three tokens to a line with text."""
    w = words(c)
    single = F.size(F.filter(w, lambda x: F.length(x) == 1))
    full = F.size(F.filter(lines(c), lambda x: F.trim(x) != ""))
    n = F.size(w)
    return F.when(n == 0, F.lit(True)).otherwise((single / n > 0.25) | (n / F.greatest(full, F.lit(1)) < 3))


def _score(parts: list[tuple[Column, int]]) -> Column:
    return reduce(Column.__add__, [F.when(F.coalesce(p, F.lit(False)), n).otherwise(0) for p, n in parts])


# Signs of a gazette notification.
GAZETTE_NO = r"(?i)S\.?\s*R\.?\s*O\.?\s*\d"
NOTIFICATION, GAZETTE, EXTRAORDINARY = r"(?i)\bNOTIFICATION\b", r"(?i)\bGAZETTE\b", r"(?i)EXTRAORDINARY"
ISSUED_AT = r"(?i)ISLAMABAD,? the \d"


def gazette_score(c: Column | str) -> Column:
    """Signs of a gazette notification in the first 2000 characters."""
    head = F.left(col(c), F.lit(2000))
    return _score([(head.rlike(GAZETTE_NO), 2), (head.rlike(NOTIFICATION), 1), (head.rlike(GAZETTE) & head.rlike(EXTRAORDINARY), 1), (head.rlike(ISSUED_AT), 1)])


# Court mastheads and the signs of a judgment.
MASTHEAD = r"(?i)(?:judgment|order)\s*sheet|(?:lahore|islamabad|sindh|peshawar|balochistan)\s+high\s+court|high\s+court\s+of\s+sindh|supreme\s+court\s+of\s+pakistan"
DECIDED_ON = r"(?i)decided\s+on\s*:?\s*[^\n]{3,60}"
JUDGE_DASH = r"(?:C\.J\.|HCJ\b|J\.)\s*[-—–]{2,}\s*[A-Z]"
VERSUS = r"(?i)\b(?:versus|vs)\b|\bv\.\s"
CASE_WORDS = r"(?i)criminal|petition|appeal|\bbail\b"
ROLES = r"Petitioner|Respondent|Appellant|Applicant|PETITIONER|RESPONDENT|APPELLANT|APPLICANT"
HEADNOTE_START = r"\([a-z]\)[^\n]{3,200}?-{2,}"


def judgment_score(c: Column | str) -> Column:
    """Signs of a judgment in the first 800, 1500 and 4000 characters."""
    t = col(c)
    a, b, d = (F.left(t, F.lit(n)) for n in (800, 1500, 4000))
    return _score([(a.rlike(MASTHEAD), 3), (b.rlike(DECIDED_ON), 2), (b.rlike(JUDGE_DASH), 3), (b.rlike(VERSUS), 1), (b.rlike(CASE_WORDS), 1), (b.rlike(ROLES), 1), (d.rlike(HEADNOTE_START), 3)])


# The structure of statutes.
PART_LINE = r"(?im)^\s*PART\s+[IVXLC\d]+\s*$"
CHAPTER_LINE = r"(?im)^\s*CHAPTER\s+[IVXLC\d]+(?:-?[A-Z])?\s*$"
HEADING_LINE = r"(?m)^\s*\d{1,3}[A-Z]?\.\s+[A-Z][^\n]{2,90}\s*$"
AMENDS = r"(?i)Amendment of (?:section|sub-section)|to amend the [^\n]+ act"
RULES_CALLED = r"(?is)these\s+(?:rules|regulations)\b.{0,40}?(?:may|shall)\s+be\s+called"


def doc_type_of(text: Column | str, name: Column | str, judgments: bool = True) -> Column:
    """The first kind whose signs are there; ``paragraph`` if none are, for null texts too."""
    t = F.coalesce(col(text), F.lit(""))
    low = F.lower(F.coalesce(col(name), F.lit("")))
    ladder = F.when(judgment_score(t) >= 4, "judgement") if judgments else F.when(F.lit(False), "")
    return (
        ladder.when(F.contains(low, F.lit("order")) | F.contains(low, F.lit("writ")), "order")
        .when(t.rlike(AMENDS), "amendment")
        .when((gazette_score(t) >= 2) | t.rlike(RULES_CALLED), "rules")
        .when(t.rlike(PART_LINE) | t.rlike(CHAPTER_LINE) | (F.size(F.regexp_extract_all(t, F.lit(HEADING_LINE), F.lit(0))) >= 5), "statute")
        .otherwise("paragraph")
    )


def paragraphs(c: Column | str) -> Column:
    """The parts between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(col(c), r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def heading(no: Column | str, title: Column | str) -> Column:
    """Number and title with a space between; null and empty ones are left out."""
    return F.concat_ws(" ", F.nullif(col(no), F.lit("")), F.nullif(col(title), F.lit("")))


def lenient_int(c: Column | str) -> Column:
    """An integer of any text that reads as a number; null for others."""
    return col(c).try_cast("double").try_cast("int")


# Courts and case numbers in a case header.
COURT_WORDS = r"(?i)high court|district court|sessions? court|family court|supreme court|federal shariat court|civil court|trial court|banking court|special court|judicial magistrate|additional session|competent court"
CASE_NO_WORDS = r"(?i)no\.?\s*[:.]?\s*\d|\b(?:19|20)\d\d\b|misc\.?|crl\.?|bail\s+application|writ\s+petition|petition|criminal\s+bail|revision|appeal|complaint|fir\b|cr\.\s*misc|criminal\s+revision"


def case_header(c: Column | str) -> Column:
    """``struct<court, case_no, parties>`` of ``[Case: ...]``; its segments are told apart by their look.

    The first segment that looks like a court is the court, the first that looks like a
    case number the number; all others, further courts and numbers too, are parties.
    """
    inside = F.regexp_extract(col(c), r"\[Case:\s*(.*?)\]", 1)
    parts = F.filter(F.transform(F.split(inside, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    is_no = lambda x: x.rlike(CASE_NO_WORDS)
    is_court = lambda x: x.rlike(COURT_WORDS) & ~is_no(x)
    single = F.size(parts) == 1
    first = lambda test: F.coalesce(F.array_position(F.transform(parts, test), F.lit(True)), F.lit(0))
    court, number = first(is_court), first(is_no)
    rest = F.array_join(F.filter(parts, lambda x, i: (i + 1 != court) & (i + 1 != number)), " | ")
    return F.struct(
        F.when(~single & (court > 0), F.get(parts, court - 1)).alias("court"),
        F.when(single, F.get(parts, F.lit(0))).when(number > 0, F.get(parts, number - 1)).alias("case_no"),
        F.when(~single, F.nullif(rest, F.lit(""))).alias("parties"),
    )


def split_parties(c: Column | str) -> Column:
    """The parties on both sides of versus, without a trailing "etc." or "& others" and without marks at their ends."""
    sides = F.split(col(c), r"(?i)\s+(?:vs|v)\.?\s+|\s+versus\s+")
    cleaned = F.transform(sides, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i),?\s*(?:etc\.?|&?\s*others)\s*$", ""), r"^[ ,;:]+|[ ,;:]+$", ""))
    return F.filter(cleaned, lambda x: x != "")


def case_context(parties: Column, court: Column, numbers: Column, para: Column) -> Column:
    """``[Case: parties | court | numbers] [Para n]`` with at most three numbers and 250 characters; empty if nothing is known."""
    listed = F.nullif(F.array_join(F.slice(F.coalesce(numbers, F.array().cast("array<string>")), 1, 3), "; "), F.lit(""))
    inner = F.concat_ws(" | ", F.nullif(parties, F.lit("")), F.nullif(court, F.lit("")), listed)
    para = F.concat(F.lit(" [Para "), F.nullif(para.cast("string"), F.lit("")), F.lit("]"))
    return F.when(inner == "", "").otherwise(F.left(F.concat(F.lit("[Case: "), inner, F.lit("]"), F.coalesce(para, F.lit(""))), F.lit(250)))


#: The DNS name space of RFC 4122, as bytes.
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column | str) -> Column:
    """The version-5 UUID of ``name`` in the DNS name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS)), F.encode(col(name), "UTF-8")))
    variant = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lower(F.hex(variant)), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def node_id(label: Column, key: Column) -> Column:
    """A chunk's id is that of its vector; other nodes' ids are made from label and key."""
    return F.when(label == "Chunk", uuid5(F.get(key, F.lit(0)))).otherwise(uuid5(F.concat(F.lit("graph:"), label, F.lit(":"), F.array_join(key, ":"))))


def percent_text(n: Column, total: Column) -> Column:
    """``n (p%)`` with a whole percentage."""
    return F.concat(n.cast("string"), F.lit(" ("), F.coalesce(F.bround(100.0 * n / F.nullif(total, F.lit(0)), 0), F.lit(0)).cast("int").cast("string"), F.lit("%)"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
