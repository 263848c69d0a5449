from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest

from rollbook.llm.cooccurrence import cooccurrence


@pytest.mark.parametrize("chunk", [64, 3, 1])
def test_against_brute_force(spark, chunk):
    rng = random.Random(3)
    baskets = [[f"i{rng.randint(0, 15)}" for _ in range(rng.choice([0, 1, 2, 5, 12]))] for _ in range(60)] * 2
    rows = [("f", b) for b in baskets] + [("f", None), ("g", ["a", "b", None, "", "a"]), ("g", ["a"])]
    pairs, single = Counter(), Counter()
    for f, b in rows:
        items = sorted({x for x in b or [] if x})
        single.update((f, x) for x in items)
        pairs.update((f, *p) for p in combinations(items, 2))
    n = Counter(f for f, b in rows if b)
    out = cooccurrence(spark.createDataFrame(rows, "src string, items array<string>"), ["src"], "items", chunk=chunk).collect()
    assert {(r.src, r.item_a, r.item_b): r.n_ab for r in out} == dict(pairs)
    assert all((r.n_a, r.n_b, r.n) == (single[r.src, r.item_a], single[r.src, r.item_b], n[r.src]) for r in out)
    assert all(abs(r.lift - r.n_ab * r.n / (r.n_a * r.n_b)) < 1e-9 for r in out)


def test_empty_and_threshold(spark):
    df = spark.createDataFrame([("f", ["a", "b"])] * 4, "src string, items array<string>")
    assert cooccurrence(df, ["src"], "items", min_joint=5).collect() == []
    assert cooccurrence(df.limit(0), ["src"], "items").collect() == []
    assert cooccurrence(df, ["src"], "items").first().npmi == 1.0


def test_counts_of_billions_do_not_overflow(spark):
    from rollbook.llm.cooccurrence import more_than_chance

    rows = [(10**9, 3 * 10**9, 3 * 10**9, 4 * 10**9), (9 * 10**9, 3 * 10**9, 3 * 10**9, 4 * 10**9), (10**17, 10**17, 10**17, 4 * 10**17), (10**17, 10**17, 10**17, 4 * 10**17 - 1)]
    df = spark.createDataFrame(rows, "n_ab bigint, n_a bigint, n_b bigint, n bigint")
    assert [r[0] for r in df.select(more_than_chance(4)).collect()] == [False, True, True, False]


def test_large_baskets_are_cut_before_they_are_paired(spark):
    from pyspark.sql import functions as F

    from rollbook.llm.cooccurrence import pair_counts, weighted_baskets

    # 600 items twice and once with one item less; 7 items a row give stripes of more than one row.
    big = [f"{i:05d}" for i in range(600)]
    df = spark.createDataFrame([("g", big), ("g", big), ("g", big[1:]), ("h", big[:3])], "g string, items array<string>")
    counts = pair_counts(weighted_baskets(df, ["g"], "items"), ["g"], chunk=7)
    got = counts.groupBy("g").agg(F.count(F.lit(1)).alias("pairs"), F.sum("n_ab").alias("n"), F.max("n_ab").alias("most")).collect()
    assert {tuple(r) for r in got} == {("g", 600 * 599 // 2, 3 * (599 * 598 // 2) + 2 * 599, 3), ("h", 3, 3, 1)}
