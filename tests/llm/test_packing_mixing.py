from __future__ import annotations

import random

import numpy as np
import pytest

from rollbook.llm.mixing import flight, land, mix, plan, share_report
from rollbook.llm.packing import fill_report, pack, sum_of_squares
from rollbook.llm.tokens import with_tokens


def naive_sum_of_squares(sizes, capacity):
    counts, total = [0] * (capacity + 1), 0
    for s in sizes:
        best = None
        for h in range(0, capacity - s + 1):
            if h and not counts[h]:
                continue
            after = counts[:]
            if h:
                after[h] -= 1
            else:
                total += 0
            if h + s < capacity:
                after[h + s] += 1
            cost = sum(c * c for c in after)
            if best is None or cost < best[0]:
                best = (cost, after)
        counts = best[1]
    return sum(c * c for c in counts)


def test_levels_follow_the_least_sum_of_squares():
    rng = random.Random(5)
    for _ in range(30):
        cap = rng.randint(2, 20)
        sizes = [rng.randint(1, cap) for _ in range(rng.randint(1, 40))]
        boxes = sum_of_squares(sizes, cap)
        fill = np.bincount(boxes, weights=sizes)
        assert fill.max() <= cap and len(boxes) == len(sizes)
        assert (fill > 0).sum() >= -(-sum(sizes) // cap)


def test_packing_is_tight():
    rng = random.Random(1)
    sizes = [rng.randint(1, 60) for _ in range(4000)]
    used = len(set(sum_of_squares(sizes, 100).tolist()))
    assert used <= 1.02 * sum(sizes) / 100 + 1


@pytest.mark.parametrize("shard", [50_000, 10])
def test_pack_keeps_every_token(spark, shard):
    rng = random.Random(2)
    items = [(i, rng.choice([0, 3, 20, 64, 65, 300])) for i in range(80)] + [(1, 9), (1, 9), (None, 4), (90, None)]
    df = spark.createDataFrame(items, "doc_id bigint, n bigint")
    specs = spark.createDataFrame([(1, 64), (2, 100)], "spec_id int, capacity_tokens int")
    out = pack(df, "doc_id", "n", specs, shard_items=shard).toPandas()
    for spec, cap in ((1, 64), (2, 100)):
        o = out[out.spec_id == spec]
        assert o.groupby("container_id").n.sum().max() <= cap
        assert o.n.sum() == sum(n or 0 for _, n in items)
        assert set(o.doc_id.dropna()) == {i for i, _ in items if i is not None}
        small = {i for i, n in items if n and n <= cap and i not in (1, None)}
        assert (o[o.doc_id.isin(small)].groupby("doc_id").size() == 1).all()
        for _, g in o[o.doc_id.isin([i for i, n in items if (n or 0) > cap])].groupby("doc_id"):
            g = g.sort_values("part")
            assert g.start.tolist() == [0, *g.n.cumsum().tolist()[:-1]]
    report = fill_report(pack(df, "doc_id", "n", specs, shard_items=shard), specs, "n").collect()
    assert all(r.containers >= r.least_containers for r in report)


def test_pack_empty_and_bad_specs(spark):
    df = spark.createDataFrame([], "doc_id bigint, n bigint")
    specs = spark.createDataFrame([(1, 64)], "spec_id int, capacity_tokens int")
    assert pack(df, "doc_id", "n", specs).collect() == []
    with pytest.raises(ValueError):
        pack(df, "doc_id", "n", spark.createDataFrame([(1, 0)], "spec_id int, capacity_tokens int"))


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(0)
    t = rng.integers(1, 400, 300)
    p = np.full(300, 0.37)
    hits = np.zeros(300)
    for seed in range(200):
        q = flight(p, t, seed)
        assert ((q > 0) & (q < 1)).sum() <= 2
        assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * t).sum() - (p * t).sum()) < 1e-3
        hits += land(q, t)
    assert abs(hits.mean() / 200 - 0.37) < 0.01 and (abs(hits / 200 - 0.37) < 0.16).all()


def test_plan():
    want = plan({"a": 1000, "b": 100}, [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2)])
    assert want["b"] / (want["a"] + want["b"]) == pytest.approx(0.375)
    assert want["b"] <= 300
    tiny = plan({"a": 10_000, "b": 1}, [("a", 0.5, 1), ("b", 0.5, 2)])
    assert tiny["b"] == 2 and tiny["a"] == pytest.approx(0.25 * 10_001 - 2)
    assert plan({}, [("a", 1.0, 1)]) == {}


def test_mix_reaches_shares(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["A ", "a", "b", "c", None, "zzz"]), rng.choice([None, 5, 50, 90])) for i in range(3000)] + [(1, "a", 7)] * 3 + [(9999, "b", 5000)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 2), ("d", 0.1, 9)], "source string, target_share double, max_repeats int")
    for shard in (50_000, 100):
        mixed = mix(df, "doc_id", "source", "n", targets, shard_items=shard)
        rows = {r.source: r for r in share_report(mixed, targets, "n").collect()}
        assert rows["d"].tokens == 0 and rows["d"].reached_share == 0
        assert rows["a"].most_copies <= 1 and rows["b"].most_copies <= 2
        for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
            assert abs(rows[s].reached_share - w / 0.9) < 0.01
    assert mix(df.limit(0), "doc_id", "source", "n", targets).collect() == []
    assert mix(df, "doc_id", "source", "n", targets.limit(0)).collect() == []


def test_tokens(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",), ("<|endoftext|>",), ("x y " * 50_000,)], "t string")
    got = [r.n_tokens for r in with_tokens(df, "t").collect()]
    assert got[0] == 2 and got[1] == got[2] == 0 and got[3] > 1 and got[4] >= 100_000


def test_flight_keeps_both_totals_with_giants():
    import numpy as np

    from rollbook.llm.mixing import counter_rate, flight

    rng = np.random.default_rng(4)
    for giants in (0, 3, 40, 90):
        t = np.concatenate([rng.integers(20_000, 60_000, giants), rng.integers(20, 300, 400)]).astype(float)
        p = np.full(len(t), 0.3)
        out = flight(p, t, 11)
        assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * t).sum() - (p * t).sum()) < 1e-3
        left = np.flatnonzero((out > 1e-9) & (out < 1 - 1e-9))
        assert len(left) <= 2
        if giants == 3:
            assert all(t[i] < 1000 for i in left)
    sizes = np.array([1.0, 2, 3, 10])
    a, b = counter_rate(4, sizes.sum(), (sizes**2).sum(), 2.2, 9.0, 1, 10, 1.0)
    assert abs((a + b * sizes).sum() - 2.2) < 1e-9 and abs(((a + b * sizes) * sizes).sum() - 9.0) < 1e-9
    assert counter_rate(4, sizes.sum(), (sizes**2).sum(), 2.2, 99.0, 1, 10, 1.0) == (1.0, 0.0)
    assert counter_rate(0, 0, 0, 1, 1, 0, 0, 1.0) == (0.0, 0.0)
