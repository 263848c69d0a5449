"""Results do not depend on partitioning; counts, lists and totals agree with one another."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tools.differential import canonical

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
ORDERED = [
    "multivalue_collect", "distinct_order_preserving", "dedup_first_seen", "drop_duplicates_subset", "latest_by_date", "last_value_wins", "adjacent_element",
    "latest_position", "positional_zip", "numbered_items", "order_offset_limit", "hits_pivot", "flags_and_ties", "education_clusters", "p4_found",
]


@pytest.mark.parametrize("name", ORDERED)
def test_same_rows_with_one_and_eight_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = entry.queries()[name](spark, FOLDER)
            got.append(canonical([tuple(r) for r in df.collect()], df.columns))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def run(spark, name):
    return entry.queries()[name](spark, FOLDER)


def test_flags_follow_lists(spark):
    for r in run(spark, "flags_and_ties").collect():
        items = r.orgs.split(" | ") if r.orgs else []
        assert r.n_ties == len(items) == len(set(items)) and items == sorted(items) and r.flag == bool(items)


def test_total_is_the_distinct_union(spark):
    rows = {r.canonical_name: r.n for r in run(spark, "hits_total_row").collect()}
    total = rows.pop("TOTAL")
    assert max(rows.values(), default=0) <= total <= sum(rows.values())


def test_percentages(spark):
    for r in run(spark, "cohort_trends").collect():
        assert abs(r.has_phd_pct - 100 * r.has_phd_n / r["size"]) <= 0.05 + 1e-9


def test_left_join_keeps_left_rows(spark):
    assert run(spark, "left_join_normalized_key").count() == spark.read.parquet(f"{FOLDER}/commission_i_2019_2024.parquet").count()
