"""Problem 8: the reading level of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.queries import REG
from rollbook.llm.reading import reading_level
from rollbook.plans.registry import Tables

LEAST_WORDS = 40


@REG.query("p8_found")
def p8_found(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    judged = reading_level(docs, "text", "doc_id", t.reading_labels)
    wanted = judged.where(F.regexp_count("text", F.lit(r"(?U)\S+")) >= LEAST_WORDS)
    return wanted.join(t.reading_labels.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "reading_level")


@REG.query("p8_levels")
def p8_levels(t: Tables) -> DataFrame:
    """Documents and mean level by source."""
    judged = reading_level(t.documents.select("doc_id", "text", "source"), "text", "doc_id", t.reading_labels)
    return judged.groupBy(F.lower(F.trim("source")).alias("source"), "reading_level").agg(F.count(F.lit(1)).alias("docs"))
