"""Mixing sources to target weights: cube-method balanced sampling.

The size of the mix is the largest at which every source that has documents reaches its share within its repeats, but never less
than `least` of the tokens at hand; a source that cannot reach its share then gives all it may. A source needs each document m
times on average: floor(m) copies of each, and one more for a balanced sample with inclusion probability m - floor(m).

Flight: three fractional probabilities move along the null space of the constraints (number of documents, number of tokens)
until one of them is 0 or 1, so both totals stay exact. The 64 longest of a flight move one by one against all others instead, as
a long one between two short ones hardly moves. Documents fly in shards, longest first; each shard leaves two fractional ones at
most, which fly again per source.

A document above 1/200 of the tokens wanted of its source can outweigh a whole shard. These fly by themselves first, in shards and then per source, which leaves two at most. Each of these goes to 1 with
its probability, else to 0, and all other documents of the source move against it: their rate becomes a + b * tokens, with a and b
such that both totals of the source stay exact (b = 0, tokens alone, where the rate would leave 0..max_repeats). Landing: the last
two of the others are rounded to the token total that is nearest.

Cases: null text counts 0 tokens; a source is compared in lower case without outer blanks; documents of no target source are
never used; a target without documents or tokens reaches 0; max_repeats null or below 1 means the source is not used; repeated
targets of one source are an error.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.session import cut

SHARD_ITEMS = 50_000
LEAST = 0.25
LARGE = 200
#: Items of a flight that move against all others before three move at a time.
WIDE = 64
_EPS = 1e-9


def normal_source(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def _settle_longest(p: np.ndarray, t: np.ndarray, rng: random.Random) -> None:
    """The longest fractional items moved one by one to 0 or 1 against all others, in the null space of (count, tokens).

    The others move in proportion to p (1 - p), the least change for them, so that hardly one of them reaches a bound.
    """
    for i in sorted(np.flatnonzero((p > _EPS) & (p < 1 - _EPS)), key=lambda k: (-t[k], k))[:WIDE]:
        for _ in range(8):
            w = p * (1 - p)
            w[i] = 0.0
            w[w < _EPS] = 0.0
            a, b, c = w.sum(), (w * t).sum(), (w * t * t).sum()
            det = a * c - b * b
            if not _EPS < p[i] < 1 - _EPS or np.count_nonzero(w) < 3 or det <= 1e-9 * a * c:
                break
            d = -w * ((c - b * t[i]) + (a * t[i] - b) * t) / det
            d[i] = 1.0
            moved = np.flatnonzero(d)
            q, e = p[moved], d[moved]
            up = np.where(e > 0, (1 - q) / e, q / -e).min()
            down = np.where(e > 0, q / e, (1 - q) / -e).min()
            p += d * (up if rng.random() * (up + down) < down else -down)
            p[p < _EPS], p[p > 1 - _EPS] = 0.0, 1.0


def flight(p: np.ndarray, tokens: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities moved along the null space of (count, tokens) until at most two are fractional."""
    rng = random.Random(seed)
    p = p.astype(float).copy()
    _settle_longest(p, tokens.astype(float), rng)
    waiting = [int(i) for i in np.flatnonzero((p > _EPS) & (p < 1 - _EPS))][::-1]
    t = tokens.astype(float)
    active: list[int] = []
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) < 2:
            break
        x = [t[i] for i in active]
        if len(active) == 3:
            u = [x[2] - x[1], x[0] - x[2], x[1] - x[0]]
            if not any(u):
                u = [1.0, -1.0, 0.0]
        elif x[0] == x[1]:
            u = [1.0, -1.0]
        else:
            break
        q = [p[i] for i in active]
        up = min(((1 - a) / d if d > 0 else a / -d) for a, d in zip(q, u) if d)
        down = min((a / d if d > 0 else (1 - a) / -d) for a, d in zip(q, u) if d)
        step = up if rng.random() * (up + down) < down else -down
        kept = []
        for i, a, d in zip(active, q, u):
            v = a + step * d
            v = 0.0 if v < _EPS else 1.0 if v > 1 - _EPS else v
            p[i] = v
            if 0.0 < v < 1.0:
                kept.append(i)
        active = kept
    return p


def land(p: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """0/1 for the few fractional values that are left: the rounding whose token total is nearest to the expected one."""
    out = p.copy()
    open_ = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    if len(open_):
        want = float((p[open_] * tokens[open_]).sum())
        best = min(range(1 << len(open_)), key=lambda m: (abs(sum(float(tokens[i]) for k, i in enumerate(open_) if m >> k & 1) - want), m))
        for k, i in enumerate(open_):
            out[i] = best >> k & 1
    return np.round(out)


def _open(supply: dict[str, int], targets: list[tuple[str, float, int]]) -> tuple[dict[str, int], dict[str, float]]:
    """Most tokens that each source can give, and the shares of the sources that can give any."""
    cap = {s: supply.get(s, 0) * max(0, r or 0) for s, _, r in targets}
    return cap, {s: w for s, w, _ in targets if cap[s] > 0 and w > 0}


def _reachable(cap: dict[str, int], share: dict[str, float]) -> float:
    """Tokens of the largest mix in which every source has its share."""
    return min(cap[s] * sum(share.values()) / w for s, w in share.items())


def size_rule(supply: dict[str, int], targets: list[tuple[str, float, int]], least: float = LEAST) -> str:
    """Whether the shares or the least size set the size of the mix."""
    cap, share = _open(supply, targets)
    return "shares" if not share or _reachable(cap, share) >= least * sum(supply[s] for s in share) else "size"


def plan(supply: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None, least: float = LEAST) -> dict[str, float]:
    """Tokens wanted of each source. supply: tokens at hand by source; targets: (source, share, most repeats)."""
    cap, share = _open(supply, targets)
    if not share:
        return {}
    if total is None:
        total = max(_reachable(cap, share), least * sum(supply[s] for s in share))
    want, left, open_ = {}, float(total), dict(share)
    while open_:
        w_open = sum(open_.values())
        short = [s for s in open_ if cap[s] < open_[s] / w_open * left * (1 - 1e-12)]
        if not short:
            want |= {s: min(float(cap[s]), w / w_open * left) for s, w in open_.items()}
            break
        for s in short:
            want[s] = float(cap[s])
            left -= cap[s]
            del open_[s]
    return want


def counter_rate(n: float, t: float, tt: float, docs: float, tokens: float, low: float, high: float, most: float) -> tuple[float, float]:
    """(a, b): rates a + b * size that give both totals over n items of sizes with sum t, sum of squares tt and the range low..high.

    Where they would leave 0..most, b is 0 and the token total alone is kept as far as that range allows.
    """
    det = n * tt - t * t
    if det > 1e-9 * n * tt:
        a, b = (docs * tt - tokens * t) / det, (tokens * n - docs * t) / det
        if all(-1e-12 <= a + b * x <= most for x in (low, high)):
            return a, b
    return (min(most, max(0.0, tokens / t)) if t else 0.0), 0.0


def mix(docs: DataFrame, doc_id: str, source: str, tokens: str, targets: DataFrame, total: float | None = None, least: float = LEAST, seed: int = 7, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc id, source, tokens, copies) of the documents used. Columns of docs other than these three are not carried."""
    rows = [(r[0], float(r[1] or 0), int(r[2] or 0)) for r in targets.select(normal_source(F.col("source")), "target_share", "max_repeats").limit(10_001).collect() if r[0]]
    if len(rows) > 10_000 or len({r[0] for r in rows}) < len(rows):
        raise ValueError("targets: at most 10,000 sources, each once")
    slim = docs.select(F.col(doc_id).alias("doc"), normal_source(F.col(source)).alias("src"), F.col(tokens).cast("bigint").alias("n"))
    slim = cut(slim.where(F.col("src").isin([r[0] for r in rows])) if rows else slim.where("false"))
    supply = {r[0]: (int(r[1] or 0), int(r[2])) for r in slim.groupBy("src").agg(F.sum("n"), F.count(F.lit(1))).collect()}
    want = plan({s: n for s, (n, _) in supply.items()}, rows, total, least)
    kind = dict(docs.dtypes)[doc_id]
    spark = docs.sparkSession
    schema = f"doc {kind}, src string, n bigint, base bigint, p double"

    def fly(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "doc"], ascending=[False, True], kind="stable")
        mark = zlib.crc32(f"{group['src'].iloc[0]}|{group['shard'].iloc[0] if 'shard' in group else -1}|{seed}".encode())
        group["p"] = flight(group["p"].to_numpy(), group["n"].to_numpy(), mark)
        return group[["doc", "src", "n", "base", "p"]]

    def fly_and_land(group: pd.DataFrame) -> pd.DataFrame:
        group = fly(group)
        group["p"] = land(group["p"].to_numpy(), group["n"].to_numpy())
        return group

    def rated(part: DataFrame, rates: list[tuple]) -> DataFrame:
        table = spark.createDataFrame(rates or [("", 0.0, 0.0, 1)], "src string, a double, b double, shards int")
        part = part.join(F.broadcast(table), "src").withColumn("m", F.greatest(F.lit(0.0), F.col("a") + F.col("b") * F.col("n"))).withColumn("base", F.floor(F.col("m") + 1e-12))
        part = part.withColumn("p", F.greatest(F.lit(0.0), F.col("m") - F.col("base"))).withColumn("shard", F.pmod(F.xxhash64("doc", F.lit(seed)), F.col("shards")).cast("int"))
        return part.select("doc", "src", "n", "base", "p", "shard")

    def flown(part: DataFrame, last: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
        """Flight by shard, then of what is left by source."""
        first = cut(part.groupBy("src", "shard").applyInPandas(fly, schema))
        left = (F.col("p") > 0) & (F.col("p") < 1)
        return first.where(~left).unionByName(first.where(left).groupBy("src").applyInPandas(last, schema))

    most = {s: r for s, _, r in rows}
    rate = {s: w / supply[s][0] for s, w in want.items()}
    sized = slim.join(F.broadcast(spark.createDataFrame([(s, w / LARGE) for s, w in want.items()] or [("", 0.0)], "src string, big double")), "src")
    large, small = (sized.where(c).drop("big") for c in (F.col("n") > F.col("big"), F.col("n") <= F.col("big")))
    count = {r[0]: int(r[1]) for r in large.groupBy("src").agg(F.count(F.lit(1))).collect()}
    shards = lambda n: max(1, -(-n // shard_items))
    drawn = cut(flown(rated(large, [(s, rate[s], 0.0, shards(n)) for s, n in count.items()]), fly))
    # The two of a source that are left go to 0 or 1 with their probability.
    coin = (F.pmod(F.xxhash64("doc", F.lit(seed), F.lit("coin")), F.lit(1 << 30)) / F.lit(float(1 << 30))) < F.col("p")
    drawn = cut(drawn.withColumn("p", F.when((F.col("p") > 0) & (F.col("p") < 1), coin.cast("double")).otherwise(F.col("p"))))
    copies = F.col("base") + F.round("p")
    spent = {r[0]: (float(r[1]), float(r[2])) for r in drawn.groupBy("src").agg(F.sum(copies), F.sum(F.col("n") * copies)).collect()}
    size = F.col("n").cast("double")
    rest = []
    for s, n, t, tt, low, high in small.groupBy("src").agg(F.count(F.lit(1)), F.sum(size), F.sum(size * size), F.min(size), F.max(size)).collect():
        docs_used, tokens_used = spent.get(s, (0.0, 0.0))
        a, b = counter_rate(n, t, tt, rate[s] * supply[s][1] - docs_used, want[s] - tokens_used, low, high, float(most[s]))
        rest.append((s, a, b, shards(n)))
    done = drawn.unionByName(flown(rated(small, rest), fly_and_land))
    return done.select(F.col("doc").alias(doc_id), F.col("src").alias("source"), F.col("n").alias(tokens), (F.col("base") + F.round("p")).cast("int").alias("copies")).where("copies > 0")


def share_report(mixed: DataFrame, targets: DataFrame, tokens: str, supply: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """Per target: its share, documents, copies and tokens used, the share reached. Targets without documents show 0.

    supply: (source, tokens) of all documents; adds the tokens at hand and the rule that set the size of the mix: "shares" where every
    source with documents reaches its share, "size" where the mix had to hold `least` of the tokens at hand at the cost of shares.
    """
    used = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col(tokens) * F.col("copies")).alias("tokens"))
    used = cut(used)
    whole = used.agg(F.sum("tokens")).first()[0] or 0
    listed = targets.select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats").join(used, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out = listed.select("source", "target_share", "max_repeats", *[zero(c) for c in ("docs", "copies", "most_copies", "tokens")], F.round(F.coalesce(F.col("tokens") / F.nullif(F.lit(whole), F.lit(0)), F.lit(0.0)), 6).alias("reached_share"))
    if supply is None:
        return out
    held = cut(supply.select(normal_source(F.col("source")).alias("source"), F.col(tokens).alias("_n")).groupBy("source").agg(F.sum("_n").alias("supply_tokens")))
    at_hand = cut(out.join(held, "source", "left").withColumn("supply_tokens", F.coalesce("supply_tokens", F.lit(0).cast("bigint"))))
    rows = [(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in at_hand.limit(10_001).collect()]
    return at_hand.withColumn("rule", F.lit(size_rule({r["source"]: r["supply_tokens"] for r in at_hand.limit(10_001).collect()}, rows, least)))
