"""All queries of the core, by name, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexquarry.plans import chunkings, flows, graphs, integrity, profiles, searches, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for part in (integrity, texts, profiles, chunkings, graphs, searches, flows):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
FLAGSHIP = "p3_found"
