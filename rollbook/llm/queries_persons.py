"""Problem 3: court members and revolving-door records that describe the same person."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.persons import match_persons
from rollbook.llm.queries import REG
from rollbook.plans.registry import Tables


def _list(column: str, cut: str):
    return F.split(F.coalesce(F.col(column), F.lit("")), cut)


def _sides(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    none = F.lit(None).cast("string")
    raw = t.cjeu_members_raw.select(
        F.lit("cjeu_members_raw").alias("tab"), F.col("raw_id").alias("id"), "name", F.col("born_year").alias("born"), F.col("born_place").alias("place"), "country",
        _list("education", r" \| ").alias("schools"), _list("memberships", r" \| ").alias("bodies"), none.alias("mandate"))
    cv = t.cjeu_cv_data.select(
        F.lit("cjeu_cv_data").alias("tab"), F.col("cv_id").alias("id"), F.coalesce(F.nullif("name", F.lit("")), "name_wd").alias("name"), F.col("birth_date").alias("born"), F.col("birth_place").alias("place"),
        F.coalesce("country", "nationality").alias("country"), _list("education", r" \|\| ").alias("schools"),
        F.concat(_list("employers", r" \|\| "), _list("page_memberships", r" \| ")).alias("bodies"), none.alias("mandate"))
    doors = t.commission_revolving_door.where("name is not null").select(
        F.lit("commission_revolving_door").alias("tab"), F.col("rd_id").alias("id"), "name", none.alias("born"), none.alias("place"), none.alias("country"),
        F.array().cast("array<string>").alias("schools"), F.array("occupation").alias("bodies"), "mandate")
    return raw, cv, doors


@REG.query("p3_matches")
def p3_matches(t: Tables) -> DataFrame:
    """Matches with their confidence."""
    return match_persons(*_sides(t), t.reference_names)


@REG.query("p3_found")
def p3_found(t: Tables) -> DataFrame:
    return p3_matches(t).select("tab_a", "id_a", "tab_b", "id_b")
