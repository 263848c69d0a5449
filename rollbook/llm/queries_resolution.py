"""Problem 2: spellings of schools, employers and networks linked to bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.queries import REG
from rollbook.llm.resolution import resolve
from rollbook.plans.registry import Tables

MEMBERS_PER_TILE = 256


def pool(t: Tables) -> DataFrame:
    """(spelling, weight) of the three fields, values as stored."""
    one = lambda df: df.where("spelling <> ''").groupBy("spelling").agg(F.count(F.lit(1)).alias("weight"))
    schools = one(t.commissioner_education.select(F.col("institution").alias("spelling")))
    employers = one(t.commission_i_2019_2024.select(F.explode(F.split("employers", r" \|\| ")).alias("spelling")))
    networks = one(t.commissioner_appointments.select(F.explode(F.split("atlanticist_orgs", r" \| ")).alias("spelling")))
    return schools.unionByName(employers).unionByName(networks)


def member_pairs(members: DataFrame, group: str, item: str, tile: int = MEMBERS_PER_TILE) -> DataFrame:
    """(name_a < name_b) of the items of each group. Big groups are cut into tiles, each pair of tiles is a row of its own."""
    tiles = F.greatest(F.lit(1), F.ceil(F.col("n") / tile)).cast("int")
    sized = members.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("tiles", tiles)
    placed = members.join(sized, group).withColumn("tile", F.pmod(F.xxhash64(item), F.col("tiles")).cast("int"))
    packed = placed.groupBy(group, "tile", "tiles").agg(F.collect_list(item).alias("items"))
    left = packed.select(group, F.col("tile").alias("ti"), "items", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)).alias("tj"))
    right = packed.select(group, F.col("tile").alias("tj"), F.col("items").alias("others"))
    met = left.join(right, [group, "tj"]).repartition(group, "ti", "tj")
    same = met.where("ti = tj").select(F.explode("items").alias("x"), "others").select("x", F.explode("others").alias("y")).where("x < y")
    cross = met.where("ti < tj").select(F.explode("items").alias("x"), "others").select("x", F.explode("others").alias("y"))
    return same.unionByName(cross).select(F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b"))


@REG.query("p2_found")
def p2_found(t: Tables) -> DataFrame:
    return member_pairs(resolve(pool(t), t.reference_names), "body", "spelling")


@REG.query("p2_bodies")
def p2_bodies(t: Tables) -> DataFrame:
    """Spellings with the id of their body."""
    return resolve(pool(t), t.reference_names)
