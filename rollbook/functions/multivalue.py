"""Cells that hold several values: string <-> array, ordered distinct, zip and fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_list(c: Column, delimiter: str) -> Column:
    """Literal split; null and '' give an empty array, empty pieces are left out."""
    quoted = "\\Q" + delimiter + "\\E"
    return F.filter(F.split(F.coalesce(c, F.lit("")), quoted), lambda x: x != "")


def from_list(c: Column, delimiter: str) -> Column:
    return F.array_join(c, delimiter)


def ordered_list(value: Column, *order: Column) -> Column:
    """Aggregate: values of a group as an array in the order of the given columns."""
    items = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))))
    return F.transform(items, lambda s: s["v"])


def explode_list(df: DataFrame, column: str, delimiter: str, pos: str = "pos", val: str = "val") -> DataFrame:
    """One row per value with its place from 1; rows whose cell holds none drop out."""
    items = F.posexplode(to_list(F.col(column), delimiter)).alias("_p", val)
    return df.select("*", items).withColumn(pos, (F.col("_p") + 1).cast("int")).drop("_p")


def zip_outer(*columns: str) -> Column:
    """Arrays aligned by position, short ones padded with ''; array of structs a0, a1, ..."""
    zipped = F.arrays_zip(*[F.coalesce(F.col(c), F.array().cast("array<string>")).alias(f"a{i}") for i, c in enumerate(columns)])
    return F.transform(zipped, lambda s: F.struct(*[F.coalesce(s.getField(f"a{i}"), F.lit("")).alias(f"a{i}") for i in range(len(columns))]))


def numbered_items(lines: Column) -> Column:
    """Fold lines: 'n. text' opens an item, later lines join it by a blank; lines before the first item drop out.

    array<string> -> array<struct<num, txt>>, in one pass without a shuffle.
    """
    start = r"^(\d+)\.\s*(.*)"
    empty = F.array().cast("array<struct<num:string,txt:string>>")

    def step(acc, line):
        opened = F.concat(acc, F.array(F.struct(F.regexp_extract(line, start, 1).alias("num"), F.regexp_extract(line, start, 2).alias("txt"))))
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["num"].alias("num"), F.concat_ws(" ", last["txt"], line).alias("txt"))))
        return F.when(line.rlike(start), opened).when((F.size(acc) > 0) & (line != ""), longer).otherwise(acc)

    return F.aggregate(lines, empty, step)


def render_items(items: Column, delimiter: str = " || ") -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat(s["num"], F.lit(". "), s["txt"])), delimiter)
