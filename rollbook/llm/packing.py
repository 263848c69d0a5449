"""Filling containers of fixed capacity: sum-of-squares online packing.

Items arrive in a fixed pseudo-random order. An array holds, for each fill level, how many open containers stand at it; an item
goes to the level (or a new container) that makes the sum of the squared counts smallest. When a shard's items are placed, those of
the containers that have more than SLACK of their room unused are placed once more, best fit, largest first.

The work is cut into shards of at most `shard_items` items by a hash of the id, so a task never holds more; a shard leaves a few
open containers only. An item larger than the capacity is divided into full containers and one rest, which is packed like an item.

Cases: an item of size 0 or null takes part in the first container of its shard with size 0; an empty table gives no rows;
repeated ids are items of their own; a capacity below 1 is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ITEMS = 50_000
SLACK = 0.01


def sum_of_squares(sizes: Sequence[int], capacity: int) -> np.ndarray:
    """Container number of each item; sizes are 1..capacity."""
    levels = np.zeros(capacity + 1, dtype=np.int64)  # twice the count of open containers at each level
    source = np.full(capacity + 1, -(1 << 40), dtype=np.int64)  # the same where there are any, else out of the question
    levels[capacity] = -1  # a full container leaves the array: no square is added
    at_level: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    fill: list[int] = []
    for k, s in enumerate(sizes):
        gain = levels[s:] - source[: capacity - s + 1]
        best = int(gain.argmin())
        fresh = int(levels[s]) + 1 if s < capacity else 0
        if gain[best] + 2 <= fresh and source[best] > 0:
            box = at_level[best].pop()
            levels[best] -= 2
            source[best] = levels[best] if levels[best] > 0 else -(1 << 40)
        else:
            box, best = len(fill), 0
            fill.append(0)
        new = best + int(s)
        fill[box] = new
        out[k] = box
        if new < capacity:
            levels[new] += 2
            source[new] = levels[new]
            at_level[new].append(box)
    return _refill(out, np.asarray(fill, dtype=np.int64), np.asarray(sizes, dtype=np.int64), capacity)


def _refill(boxes: np.ndarray, fill: np.ndarray, sizes: np.ndarray, capacity: int, slack: float = SLACK) -> np.ndarray:
    """Items of the containers with more than `slack` of their room unused, placed again: largest first, tightest room first."""
    open_ = fill < capacity * (1 - slack)
    again = np.flatnonzero(open_[boxes])
    again = again[np.argsort(-sizes[again], kind="stable")]
    out = boxes.copy()
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = np.zeros(capacity + 1, dtype=bool)
    for box in np.flatnonzero(~open_ & (fill < capacity)):
        room[capacity - fill[box]].append(int(box))
        free[capacity - fill[box]] = True
    emptied = np.flatnonzero(open_)[::-1].tolist()
    for k in again:
        size = int(sizes[k])
        fits = int(free[size:].argmax()) + size
        if free[fits]:
            box = room[fits].pop()
            free[fits] = bool(room[fits])
        elif emptied:
            box, fits = emptied.pop(), capacity
        else:
            return boxes  # no gain: the online packing stands
        out[k] = box
        left = fits - size
        if left:
            room[left].append(box)
            free[left] = True
    used, dense = np.unique(out, return_inverse=True)
    return dense


def pack(items: DataFrame, item_id: str, size: str, specs: DataFrame, spec_id: str = "spec_id", capacity: str = "capacity_tokens", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(spec_id, container_id, item id, part, start, size): every item for every spec. Columns of `items` other than these two are not carried.

    specs: a few rows; more than 1,000 are refused.
    """
    rows = specs.select(spec_id, capacity).limit(1001).collect()
    if len(rows) > 1000 or any(r[1] is None or r[1] < 1 for r in rows):
        raise ValueError("specs: at most 1,000 rows with a capacity of 1 or more")
    shards = max(1, -(-items.count() // shard_items))
    kinds = dict(items.dtypes)
    each = F.array(*[F.struct(F.lit(int(r[0])).alias("spec"), F.lit(int(r[1])).alias("cap")) for r in rows]) if rows else F.array().cast("array<struct<spec:int,cap:int>>")
    slim = items.select(F.col(item_id).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n"))
    placed = slim.withColumn("order", F.xxhash64("item")).withColumn("shard", F.pmod("order", F.lit(shards)).cast("int"))
    wide = placed.select("*", F.explode(each).alias("s")).select("item", "n", "order", "shard", F.col("s.spec").alias("spec"), F.col("s.cap").alias("cap"))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        cap, shard, spec = int(group["cap"].iloc[0]), int(group["shard"].iloc[0]), int(group["spec"].iloc[0])
        group = group.sort_values(["order", "item", "n"], kind="stable")
        item, n = group["item"].to_numpy(), group["n"].to_numpy()
        whole = np.where(n > cap, n // cap, 0)
        rest = n - whole * cap
        live = np.flatnonzero(rest > 0)
        boxes = np.zeros(len(n), dtype=np.int64)
        boxes[live] = sum_of_squares(rest[live], cap)
        last = int(boxes.max(initial=0)) + 1
        rows_at = np.flatnonzero((rest > 0) | (n == 0))
        cut_at = np.repeat(np.arange(len(n)), whole)
        part = np.arange(len(cut_at)) - np.repeat(np.cumsum(whole) - whole, whole)
        out = pd.DataFrame(
            {
                "item": np.concatenate([item[rows_at], item[cut_at]]),
                "part": np.concatenate([whole[rows_at], part]).astype("int32"),
                "start": np.concatenate([whole[rows_at] * cap, part * cap]),
                "size": np.concatenate([rest[rows_at], np.full(len(cut_at), cap)]),
                "box": np.concatenate([boxes[rows_at], last + np.arange(len(cut_at))]),
            }
        )
        out["spec"], out["box"] = spec, out["box"] + (shard << 32)
        return out[["spec", "box", "item", "part", "start", "size"]]

    done = wide.groupBy("spec", "shard").applyInPandas(fill, f"spec int, box bigint, item {kinds[item_id]}, part int, start bigint, size bigint")
    return done.select(F.col("spec").alias(spec_id), F.col("box").alias("container_id"), F.col("item").alias(item_id), "part", "start", F.col("size").alias(size))


def fill_report(packed: DataFrame, specs: DataFrame, size: str, spec_id: str = "spec_id", capacity: str = "capacity_tokens") -> DataFrame:
    """Per spec: containers, tokens, the least number of containers possible and the unused share."""
    used = packed.groupBy(spec_id, "container_id").agg(F.sum(size).alias("filled"))
    total = used.groupBy(spec_id).agg(F.count(F.lit(1)).alias("containers"), F.sum("filled").alias("tokens"))
    joined = total.join(specs.select(spec_id, capacity), spec_id)
    return joined.select(spec_id, capacity, "containers", "tokens", F.ceil(F.col("tokens") / F.col(capacity)).alias("least_containers"), F.round(1 - F.col("tokens") / (F.col("containers") * F.col(capacity)), 6).alias("unused_share"))
