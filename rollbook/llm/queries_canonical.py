"""Problem 1: typed institutions and organisations mapped to the reference list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.canonical import nearest_reference
from rollbook.llm.queries import REG
from rollbook.plans.registry import Tables

# The typed fields as (table, key, column).
TYPED = (
    ("commissioner_education", "edu_id", "institution"),
    ("commissioner_education", "edu_id", "institution_norm"),
    ("organisations_classified", "org_row_id", "organisation"),
)


def typed_values(t: Tables) -> DataFrame:
    """(src_field, row_id, value) of the values that are neither null nor empty nor a canonical name."""
    out = None
    for table, key, column in TYPED:
        part = getattr(t, table).select(F.lit(f"{table}.{column}").alias("src_field"), F.col(key).alias("row_id"), F.col(column).alias("value"))
        out = part if out is None else out.unionByName(part)
    names = t.reference_names.select(F.col("canonical_name").alias("value")).where("value is not null").distinct()
    return out.where("value <> ''").join(names, "value", "left_anti")


@REG.query("p1_found")
def p1_found(t: Tables) -> DataFrame:
    return nearest_reference(typed_values(t), "value", t.reference_names).select("src_field", "row_id", "ref_id")


@REG.query("p1_unmatched")
def p1_unmatched(t: Tables) -> DataFrame:
    """Values that no entry explains, with their rows."""
    found = nearest_reference(typed_values(t), "value", t.reference_names)
    return found.where("ref_id = 0").groupBy("src_field", "value").agg(F.count(F.lit(1)).alias("n"))
