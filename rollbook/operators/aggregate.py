"""Counts, coverage profiles, pivots with totals, cohort summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Non-empty values with their counts; `top` keeps the most frequent, ties by value."""
    out = df.where(F.coalesce(column, F.lit("")) != "").groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), column).limit(top)


def zero_filled_counts(domain: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Count of rows for every value of the domain, 0 where none occurs."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return domain.select(key).distinct().join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def field_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, populated, total): one scan; null and '' are unpopulated."""
    wide = df.agg(*[F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(c) for c in columns], F.count(F.lit(1)).alias("_total"))
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("populated"), F.col("_total").alias("total")) for c in columns])).alias("r")).select("r.*")


def pct(n: Column, size: Column) -> Column:
    return F.round(F.lit(100.0) * n / size, 1)


def hits_by_cohort(edges: DataFrame, item: str, cohort: str, person: str, cohorts: Sequence[str]) -> DataFrame:
    """Item x cohort: n distinct persons and their sorted names per cohort; absent cells are 0 and ''."""
    pivoted = edges.groupBy(item).pivot(cohort, list(cohorts)).agg(
        F.count_distinct(person).alias("n"), F.array_join(F.array_sort(F.collect_set(person)), ", ").alias("persons")
    )
    return pivoted.na.fill(0).na.fill("")


def hits_with_total(edges: DataFrame, item: str, person: str) -> DataFrame:
    """Distinct persons per item and, as TOTAL, over all items (never the sum of the rows)."""
    return (
        edges.rollup(item).agg(F.count_distinct(person).alias("n"), F.grouping(item).alias("_g"))
        .withColumn(item, F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(item)))
        .drop("_g")
    )


def cohort_trends(roster: DataFrame, persons: DataFrame, cohort: str, key: str, flags: Sequence[str], sizes: DataFrame | None = None) -> DataFrame:
    """Roster rows (repeats count) with person-level flags: per cohort the size, n and pct of each flag.

    sizes: (cohort, size) of the cohorts where they are not the number of roster rows.
    """
    joined = roster.select(cohort, key).join(persons.select(key, *flags), key, "left")
    out = joined.groupBy(cohort).agg(F.count(F.lit(1)).alias("size"), *[F.count_if(F.col(f)).alias(f"{f}_n") for f in flags])
    if sizes is not None:
        out = out.drop("size").join(sizes.select(cohort, "size"), cohort)
    return out.select(cohort, "size", *[c for f in flags for c in (F.col(f"{f}_n"), pct(F.col(f"{f}_n"), F.col("size")).alias(f"{f}_pct"))])


def ranked(df: DataFrame, n: str, place: str) -> DataFrame:
    """df with the place of its count n, largest first, ties on one place. Only the distinct counts are sorted."""
    counts = df.groupBy(n).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy(F.desc(n)).rowsBetween(Window.unboundedPreceding, -1))
    return df.join(counts.select(n, (F.coalesce(before, F.lit(0)) + 1).cast("int").alias(place)), n)


def first_seen(df: DataFrame, key: str, cohort: str, scan: Sequence[str], order: str) -> DataFrame:
    """The first row of each key when the cohorts are scanned in the given order, rows of a cohort by `order`; unknown cohorts come last."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(c) for c in scan]), F.col(cohort)), F.lit(0)), F.lit(len(scan) + 1))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(place, F.col(order))).alias("_r")).select("_r.*")

