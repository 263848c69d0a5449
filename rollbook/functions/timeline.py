"""Positions with validity intervals: 'P (s to e)', 'P (from s)', 'P'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATED = r"^(.*) \((?:from )?(\d{4}-\d{2}-\d{2})(?: to (\d{4}-\d{2}-\d{2}))?\)$"


def parse_interval(c: Column) -> Column:
    """struct<position, start_date, end_date>; missing dates are ''. Text of another shape is all position."""
    hit = c.rlike(DATED)
    part = lambda n, other: F.when(hit, F.regexp_extract(c, DATED, n)).otherwise(other)
    return F.struct(part(1, c).alias("position"), part(2, F.lit("")).alias("start_date"), part(3, F.lit("")).alias("end_date"))


def render_interval(position: Column, start: Column, end: Column) -> Column:
    """An end without a start is dropped."""
    s, e = F.coalesce(start, F.lit("")), F.coalesce(end, F.lit(""))
    return (
        F.when((s != "") & (e != ""), F.concat(position, F.lit(" ("), s, F.lit(" to "), e, F.lit(")")))
        .when(s != "", F.concat(position, F.lit(" (from "), s, F.lit(")")))
        .otherwise(position)
    )


def latest_position(items: Column, excluded: str = "commission") -> Column:
    """Latest-dated position of an array of rendered positions, first wins on ties; struct<position, date> or null.

    Items naming the excluded word are left out; an item without dates ranks lowest.
    """
    kept = F.filter(items, lambda x: ~F.lower(x).contains(excluded))
    dated = F.transform(
        kept,
        lambda x, i: F.struct(
            F.when(parse_interval(x)["end_date"] != "", parse_interval(x)["end_date"]).otherwise(parse_interval(x)["start_date"]).alias("date"),
            (-i).alias("rank"),
            parse_interval(x)["position"].alias("position"),
        ),
    )
    best = F.array_max(dated)
    return F.when(best.isNotNull(), F.struct(best["position"].alias("position"), best["date"].alias("date")))
