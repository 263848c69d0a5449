"""Items that appear together: pair counts over baskets and their association with chance.

Baskets are sets: repeats inside one count once. Equal baskets are merged with a weight before any pair is formed. A basket of
up to `chunk` items emits its pairs in place. A larger one is first cut into rows of `chunk` items; these are joined with one
another stripe by stripe (a stripe is `chunk` neighbouring rows), so that its pairs of chunks spread over all tasks, no row
holds more than two chunks, and none forms more than chunk x chunk pairs. Counts of both kinds combine map-side before the
shuffle. No pair is dropped or sampled. Products of counts are compared as decimals, which billions of records do not overflow.

Cases: null and empty arrays count neither as baskets nor towards n; null and empty items are left out; a basket of one item
counts towards n and its item, and has no pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.session import cut

CHUNK = 64


def _pairs_within(items: Column) -> Column:
    """Ordered pairs of a sorted array of distinct items."""
    return F.flatten(F.transform(items, lambda x, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda y: F.struct(x.alias("item_a"), y.alias("item_b")))))


def _pairs_across(left: Column, right: Column) -> Column:
    return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.struct(x.alias("item_a"), y.alias("item_b")))))


def weighted_baskets(df: DataFrame, group: Sequence[str], items: str) -> DataFrame:
    """Distinct baskets (sorted arrays `_items`) of each group with the number of rows `_w` that hold them."""
    listed = F.array_sort(F.array_distinct(F.filter(F.col(items), lambda x: x.isNotNull() & (x != ""))))
    kept = df.where(F.col(items).isNotNull() & (F.size(items) > 0)).select(*group, listed.alias("_items"))
    merged = kept.groupBy(*group, F.md5(F.to_json("_items")).alias("_id")).agg(F.any_value("_items").alias("_items"), F.count(F.lit(1)).alias("_w"))
    return merged.select(*group, "_items", "_w")


def pair_counts(baskets: DataFrame, group: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """(group, item_a < item_b, n_ab) from weighted baskets."""
    small = baskets.where((F.size("_items") > 1) & (F.size("_items") <= chunk))
    ordinary = small.select(*group, "_w", F.explode(_pairs_within(F.col("_items"))).alias("_p"))
    large = baskets.where(F.size("_items") > chunk).withColumn("_id", F.md5(F.to_json("_items")))
    last = F.floor((F.size("_items") - 1) / chunk).cast("int")
    rows = large.select(*group, "_id", "_w", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("_items", k * chunk + 1, chunk))).alias("_i", "_left"))
    rows = rows.withColumn("_stripe", F.floor(F.col("_i") / chunk).cast("int"))
    stripes = large.select(*group, "_id", F.floor(last / chunk).cast("int").alias("_last"))
    keys = [*group, "_id", "_stripe"]
    right = rows.select(*keys, F.col("_i").alias("_j"), F.col("_left").alias("_right"))
    own = rows.drop("_stripe").join(stripes, [*group, "_id"])
    left = own.select(*group, "_id", "_w", "_i", "_left", F.explode(F.sequence(F.floor(F.col("_i") / chunk).cast("int"), F.col("_last"))).alias("_stripe"))
    met = left.join(right, keys).where("_i <= _j")
    spread = met.repartition(*group, "_id", "_i", "_j")
    within = spread.where("_i = _j").select(*group, "_w", F.explode(_pairs_within(F.col("_left"))).alias("_p"))
    across = spread.where("_i < _j").select(*group, "_w", F.explode(_pairs_across(F.col("_left"), F.col("_right"))).alias("_p"))
    pairs = ordinary.unionByName(within).unionByName(across).select(*group, "_p.item_a", "_p.item_b", "_w")
    return pairs.groupBy(*group, "item_a", "item_b").agg(F.sum("_w").alias("n_ab"))


def cooccurrence(df: DataFrame, group: Sequence[str], items: str, min_joint: int = 1, chunk: int = CHUNK) -> DataFrame:
    """Every pair with n_ab >= min_joint: n_a, n_b, n, lift (n_ab*n / n_a*n_b), pmi and normalised pmi (natural logs)."""
    baskets = cut(weighted_baskets(df, group, items))
    totals = baskets.groupBy(*group).agg(F.sum("_w").alias("n"))
    singles = baskets.select(*group, "_w", F.explode("_items").alias("item")).groupBy(*group, "item").agg(F.sum("_w").alias("n_item"))
    pairs = pair_counts(baskets, group, chunk).where(F.col("n_ab") >= min_joint)
    side = lambda s: singles.select(*group, F.col("item").alias(f"item_{s}"), F.col("n_item").alias(f"n_{s}"))
    out = pairs.join(side("a"), [*group, "item_a"]).join(side("b"), [*group, "item_b"]).join(totals, list(group))
    lift = F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    pmi = F.log(lift)
    return out.select(
        *group, "item_a", "item_b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), pmi.alias("pmi"),
        F.when(F.col("n_ab") == F.col("n"), F.lit(1.0)).otherwise(-pmi / F.log(F.col("n_ab") / F.col("n"))).alias("npmi"),
    )


def more_than_chance(times: int) -> Column:
    """Whether n_ab * n >= times * n_a * n_b, exactly, for counts below 10^18."""
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    return exact("n_ab") * exact("n") >= (exact("n_a") * times).cast("decimal(19,0)") * exact("n_b")
