"""What a judgment's text states of itself: court, case numbers, parties, judges, date, statutes, outcome.

Captions are irregular, so each field has its own small reader of the text; they run
over Arrow batches, a row a judgment.  Null and empty texts give nulls and empty lists.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.operators.chunking import DISPOSITION
from lexquarry.storage import spread

#: Characters of a text that hold its caption, that may name its judges, that hold the signatures, and the outcome.
CAPTION, OPENING, SIGNATURE, ENDING = 3000, 4000, 900, 1200
#: Most case numbers, judges and statutes that are kept, and the longest case number and caption line.
MOST_NUMBERS, MOST_JUDGES, MOST_STATUTES, LONGEST_NUMBER, LONGEST_LINE = 8, 6, 12, 60, 90

# Courts by their names in a caption; a parameter of the readers.
COURTS = {
    "Supreme Court of Pakistan": r"SUPREME\s+COURT\s+OF\s+PAKISTAN", "Lahore High Court": r"LAHORE\s+HIGH\s+COURT", "Islamabad High Court": r"ISLAMABAD\s+HIGH\s+COURT",
    "Sindh High Court": r"SINDH\s+HIGH\s+COURT|HIGH\s+COURT\s+OF\s+SINDH", "Peshawar High Court": r"PESHAWAR\s+HIGH\s+COURT", "Balochistan High Court": r"BALOCHISTAN\s+HIGH\s+COURT",
}
# How case numbers, parties, judges, dates and statutes are written.
CASE_NO = re.compile(r"([A-Za-z][A-Za-z ./&()]{0,45}?N[Oo]s?\.\s*\.?\s*)(\d{1,6}(?:-[A-Z]+)?)\s*(?:[oO][fF]|/)\s*(\d{4})")
BARE_NO = re.compile(r"N[Oo]s?\.\s*\.?\s*(\d{1,6}(?:-[A-Z]+)?)\s*(?:[oO][fF]|/)\s*(\d{4})")
SIDES = re.compile(r"(?m)^[ \t]*([^\n]{3,90}?)\s*:?\s*\n[ \t]*(?:Versus|VERSUS|Vs\.?|VS\.?|v\.?|versus)\s*:?[ \t]*\n[ \t]*([^\n]{3,90})")
CLAIMANT = re.compile(r"(?mi)^\s*(?:APPLICANT|PETITIONER|APPELLANT)\s*(?:name)?\s*[:：]?\s*([^\n]{3,90})")
RESPONDENT = re.compile(r"(?mi)^\s*RESPONDENTS?\s*(?:name)?\s*[:：]?\s*([^\n]{3,90})")
JUSTICE = re.compile(r"\b(?:Mr\.?\s*)?Justice\s+(?:Mr\.?\s*)?[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,2}")
PRESENT = re.compile(r"(?m)^(?:Present\s*:?\s*\n?\s*)?([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){1,3})\s*,\s*(?:HCJ|C\.J\.|J\.)\s*$")
SIGNED = re.compile(r"(?m)^[ \t]*\W{0,3}\(?\s*([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){1,4})\s*\)?(?:\s*,\s*|\s*\)?\s*\n\s*)(?:HCJ\b|C\.J\.|J\.|JUDGE)")
DECIDED = re.compile(r"(?i)decided\s+on\s*:?\s*([^\n]{3,60})")
DAY, MONTH_DAY = re.compile(r"\b\d{1,2}[.-]\d{1,2}[.-]\d{2,4}\b"), re.compile(r"\b\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]+\s*,?\s*\d{4}")
CITED = (re.compile(r"(?m)^\([a-z]\)\s*(.{3,140}?)\s*[-—–]{2,}"), re.compile(r"(?m)^([A-Z][^\n]{3,130}?)\s*[-—–]{2,}\s*(?=Ss?\.)"))
_through = re.compile(r",\s*(?:through|via)\b|\s+through\s+")
_role = re.compile(r"\s*…+\s*|\s*-{2,}\s*")


def one_line(text: str) -> str:
    return re.sub(r"\s+", " ", text)


def prose(before: str, label: str) -> bool:
    """Whether a case number stands in a sentence: small words before or inside its label, or a police report."""
    words = re.findall(r"[A-Za-z]+", before)
    parts = one_line(label).strip().split(" ")
    first = re.sub(r"[^A-Za-z]", "", parts[0])
    small = lambda w: len(w) > 1 and w.isalpha() and w.islower()
    return not first or small(first) or any(map(small, parts[:-1])) or bool(words) and small(words[-1]) and words[-1] != "of" or "fir" in {w.lower() for w in (*parts, *words)}


def case_numbers(head: str) -> list[str]:
    """The case numbers on short lines of a caption, each number and year once."""
    found: dict[tuple[str, str], str] = {}
    for line in filter(None, map(str.strip, head.splitlines())):
        if len(line) > LONGEST_LINE or line.startswith("("):
            continue
        for m in CASE_NO.finditer(line):
            if not prose(line[: m.start()], m.group(1)):
                found.setdefault(m.group(2, 3), f"{one_line(m.group(1)).strip()} {m.group(2)}/{m.group(3)}")
        if m := BARE_NO.match(line):
            found.setdefault(m.group(1, 2), f"No.{m.group(1)}/{m.group(2)}")
    return list(islice((n for n in found.values() if len(n) <= LONGEST_NUMBER), MOST_NUMBERS))


def party(said: str) -> str | None:
    """A party's name without the mark of its role, 80 characters at most."""
    return one_line(_role.split(said)[0]).strip(" .,…-")[:80] or None


def parties(head: str) -> str | None:
    """Both sides around a line of versus, else the labelled ones."""
    if m := SIDES.search(head):
        sides = [party(m.group(1)), party(m.group(2))]
        return " vs ".join(sides) if all(sides) else None
    labelled = [party(_through.split(m.group(1))[0]) if (m := p.search(head)) else None for p in (CLAIMANT, RESPONDENT)]
    return " vs ".join(filter(None, labelled)) if labelled[0] else None


def judges(text: str) -> list[str]:
    """Judges in the opening, then in lines of presence, then in signatures."""
    opening, end = text[:OPENING], text[-SIGNATURE:]
    titled = (one_line(m.group()).replace("Mr. ", "").strip() for m in JUSTICE.finditer(opening))
    present = (m.group(1).title() for m in PRESENT.finditer(f"{opening}\n{end}"))
    signed = (m.group(1).title() for m in SIGNED.finditer(end))
    return list(dict.fromkeys([*titled, *present, *signed]))[:MOST_JUDGES]


def decided_on(text: str) -> str | None:
    """The date that the caption states, else the last date in figures of the text."""
    if m := DECIDED.search(text[:CAPTION]):
        day = DAY.search(m.group(1)) or MONTH_DAY.search(m.group(1))
        said = day.group().strip() if day else m.group(1).strip(" .,")
        if said and not re.search("(?i)NaN|Invalid", said):
            return said
    return next(reversed(DAY.findall(text)), None)


def statutes(text: str) -> list[str]:
    """Statutes that headnotes begin with, then those before a mark of sections; spellings that differ in case only are one."""
    said = (one_line(m.group(1)).strip(" .,;—-") for p in CITED for m in p.finditer(text))
    found: dict[str, str] = {}
    for s in filter(None, said):
        found.setdefault(s.lower(), s)
    return list(found.values())[:MOST_STATUTES]


def outcome(text: str) -> str | None:
    """The last disposition at the end of the text."""
    said = [m.group() for m in DISPOSITION.finditer(text[-ENDING:])]
    return one_line(said[-1]).lower().strip(" .,") if said else None


def metadata(text: str | None, courts: Iterable[tuple[str, re.Pattern]]) -> dict:
    text = text or ""
    head = text[:CAPTION]
    return {
        "court": next((name for name, p in courts if p.search(head)), None), "case_nos": case_numbers(head), "parties": parties(head), "judges": judges(text),
        "decided_on": decided_on(text), "statutes_cited": statutes(text), "disposition": outcome(text),
    }


def judgment_metadata(docs: DataFrame, id_col: str = "ord", text_col: str = "text", courts: dict[str, str] | None = None) -> DataFrame:
    """``(id, court, case_nos, parties, judges, decided_on, statutes_cited, disposition)`` of every row.

    ``courts`` maps names to patterns, in the order in which they are tried; it is a
    dictionary of settings.
    """
    tried = dict(COURTS if courts is None else courts)
    kinds = {"case_nos": pa.list_(pa.string()), "judges": pa.list_(pa.string()), "statutes_cited": pa.list_(pa.string())}
    names = ["court", "case_nos", "parties", "judges", "decided_on", "statutes_cited", "disposition"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [(name, re.compile(p, re.IGNORECASE)) for name, p in tried.items()]
        for b in batches:
            found = [metadata(t, patterns) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[n] for f in found], kinds.get(n, pa.string())) for n in names)], ["_id", *names])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    ddl = ", ".join(f"{n} {'array<string>' if n in kinds else 'string'}" for n in names)
    return spread(rows).mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, {ddl}").withColumnRenamed("_id", id_col)
