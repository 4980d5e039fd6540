"""Hooks for models: extraction from judgments, encoders, and texts that are handed to a model.

No model is shipped; every hook is a plain function that is given to the operator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: From a judgment's text to ``{"offences": [...], "cited_sections": [{"act": ..., "section": ...}], ...}``.
Extract = Callable[[str], dict]
#: From texts to their vectors.
Encode = Callable[[list[str]], list[list[float]]]

FIRST_CHUNKS, FIRST_CHARS = 6, 8000


def judgment_texts(chunks: DataFrame) -> DataFrame:
    """``(doc, text)``: the first six chunks of every judgment, 8000 characters at most."""
    w = W.partitionBy("doc").orderBy("ord")
    rows = chunks.where(F.lower("doc_type").isin("judgement", "judgment") & F.col("doc").isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= FIRST_CHUNKS)
    parts = F.array_sort(F.collect_list(F.struct("_r", F.coalesce("text", F.lit("")).alias("t"))))
    return rows.groupBy("doc").agg(F.left(F.array_join(F.transform(parts, lambda x: x["t"]), "\n"), F.lit(FIRST_CHARS)).alias("text"))


def enrich_judgments(chunks: DataFrame, extract: Extract, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``CITES`` and ``CONCERNS`` links ``(doc, type, act, name)`` that ``extract`` finds, and reasons ``(doc, reason)`` for what is left out.

    ``sections (act, section_no)`` are those of the graph.  A call that fails or gives
    nothing is a reason; an offence that is a reference to a section is left out.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for doc, text in zip(p["doc"], p["text"]):
                try:
                    got = extract(text) or {}
                except Exception:  # noqa: BLE001 - one failed call must not end the job
                    got = {}
                if not got:
                    rows.append((doc, "EMPTY", None, None))
                rows += [(doc, "CONCERNS", None, str(o)) for o in got.get("offences") or [] if str(o).strip()]
                rows += [(doc, "CITES", c.get("act"), str(c.get("section") or "")) for c in got.get("cited_sections") or []]
            yield pd.DataFrame(rows, columns=["doc", "type", "act", "name"])

    found = judgment_texts(chunks).mapInPandas(run, "doc string, type string, act string, name string").distinct()
    known = sections.select("act", F.col("section_no").alias("name"), F.lit(True).alias("_there")).distinct()
    found = found.join(known, ["act", "name"], "left")
    c = F.col
    reason = (
        F.when(c("type") == "EMPTY", "tier2_empty_response")
        .when((c("type") == "CONCERNS") & c("name").rlike(r"(?i)\bsection|sec\.?\s*\d"), "tier2_offence_is_section_ref")
        .when((c("type") == "CITES") & c("act").isNull(), "tier2_cite_unresolved_act")
        .when((c("type") == "CITES") & c("_there").isNull(), "tier2_cite_section_not_in_graph")
    )
    found = found.withColumn("reason", reason)
    return found.where("reason is null").select("doc", "type", "act", "name"), found.where("reason is not null").select("doc", "reason")


def encode_texts(df: DataFrame, id_col: str, text_col: str, encode: Encode) -> DataFrame:
    """``(id, embedding)`` of all rows with text, by Arrow batches; blank and null texts are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"id": p["id"], "embedding": list(encode(p["text"].tolist()))})

    rows = df.where(F.trim(text_col) != "").select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, embedding array<float>")


def evidence_line(place: Column, doc: Column, section: Column, title: Column, kind: Column, text: Column, chars: int = 1200) -> Column:
    """One piece of evidence as a model is given it."""
    shown = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    head = F.format_string("[%d] %s — Section %s (%s) [%s]", place, shown(doc, "None"), shown(section, "None"), shown(title, "n/a"), shown(kind, "None"))
    return F.concat(head, F.lit("\n"), F.left(F.coalesce(text, F.lit("")), F.lit(chars)))


def _joined(rows: DataFrame, order: str, by: list[str], sep: str) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("line").alias("l"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(lines, lambda x: x["l"]), sep).alias("text"))


def evidence_text(pool: DataFrame, most: int = 8, chars: int = 1200, by: list[str] | None = None) -> DataFrame:
    """One text of the first ``most`` pieces of evidence ``(place, doc, section_no, section_title, doc_type, text)``, in all or per ``by``."""
    line = evidence_line(*(F.col(c) for c in ("place", "doc", "section_no", "section_title", "doc_type", "text")), chars)
    return _joined(pool.where(F.col("place") <= most).select(*(by or []), "place", line.alias("line")), "place", by or [], "\n\n")


def cited_text(graph: DataFrame, most: int = 5, by: list[str] | None = None) -> DataFrame:
    """Lines of the first ``most`` judgments ``(id, source, case_no, court, outcome)`` that the graph found by citation."""
    rank = F.row_number().over(W.partitionBy(*(by or [F.lit(0)])).orderBy("id"))
    rows = graph.where("source = 'CITES'").withColumn("n", rank).where(F.col("n") <= most)
    line = F.format_string("[C%d] %s — %s (outcome: %s)", "n", F.coalesce("case_no", F.lit("None")), F.coalesce(F.nullif("court", F.lit("")), F.lit("court n/a")), F.coalesce(F.nullif("outcome", F.lit("")), F.lit("n/a")))
    return _joined(rows.select(*(by or []), "n", line.alias("line")), "n", by or [], "\n")


def turns_text(history: list[dict] | None, last: int = 6) -> str:
    """The last turns of one conversation as ``User:`` and ``Assistant:`` lines; blank ones are left out after the cut."""
    said = [((h.get("role") or "").lower(), (h.get("content") or "").strip()) for h in (history or [])[-last:]]
    return "\n".join(f"{'User' if r == 'user' else 'Assistant'}: {c}" for r, c in said if c)


def prompt_text(pool: DataFrame, graph: DataFrame | None, turns: str, most: int = 8, named: int = 5) -> str:
    """All that a model is given of one question's evidence, a bounded text."""
    cases = "" if graph is None else cited_text(graph, named).first().text
    parts = [evidence_text(pool, most).first().text, f"Related case law:\n{cases}" if cases else "", f"Conversation so far:\n{turns}" if turns else ""]
    return "\n\n".join(p for p in parts if p)


def history_text(turns: DataFrame, by: str, order: str, role: Column, text: Column, last: int = 6) -> DataFrame:
    """Per conversation its last turns as ``User:`` and ``Assistant:`` lines; blank ones are left out after the cut."""
    w = W.partitionBy(by).orderBy(F.desc(order))
    rows = turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last).where(F.trim(text) != "")
    line = F.concat(F.when(role == "user", "User").otherwise("Assistant"), F.lit(": "), F.trim(text))
    lines = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("o"), line.alias("l"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("history"))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small report table as Markdown; it is for aggregates and refuses more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def report(parts: dict[str, DataFrame], most: int = 1000) -> dict[str, list[dict]]:
    """Small report tables as one JSON-ready document; like ``markdown`` it is for aggregates and refuses more than ``most`` rows of one."""
    out = {}
    for name, df in parts.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} rows of {name}")
        out[name] = [r.asDict(recursive=True) for r in rows]
    return out
