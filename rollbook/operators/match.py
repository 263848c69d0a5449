"""Entity matching on normalised keys and the join shapes around it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """First row of each key in the given order. An aggregate, so partial results combine before the shuffle."""
    ranked = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(ranked.alias("_r")).select("_r.*")


def last_rows(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Row with the greatest order value of each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")


def normalized_left_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, suffix: str = "_wd") -> DataFrame:
    """Left outer join on the upper-cased name. Colliding right columns get the suffix; repeated right keys multiply rows."""
    renamed = right.select(F.upper(right_on).alias("_rk"), *[F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns])
    return left.withColumn("_lk", F.upper(left_on)).join(renamed, F.col("_lk") == F.col("_rk"), "left").drop("_lk", "_rk")


def coverage(df: DataFrame, key: str) -> DataFrame:
    """matched = rows with the key, total = all rows."""
    return df.agg(F.count(key).alias("matched"), F.count(F.lit(1)).alias("total"))


def semi_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def minus(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on).distinct(), list(on), "left_anti")


def label_or_id(df: DataFrame, labels: DataFrame, id_col: str, label_col: str, out: str) -> DataFrame:
    """The label of an id, or the id itself where no label exists. `labels` must be unique on the id."""
    return df.join(labels.select(id_col, label_col), id_col, "left").withColumn(out, F.coalesce(label_col, id_col)).drop(label_col)


def cohort_lookup(df: DataFrame, name: str, persons: DataFrame, person: str, cohort: str, out: str, otherwise: str = "Other/Earlier", fold_accents: bool = False) -> DataFrame:
    """df with the cohort of the person named, notes in brackets set aside; persons must be unique on the name.

    Accents count unless fold_accents; letter case does not.
    """
    plain = F.trim(F.regexp_replace(F.col(name), r"\(.*$", ""))
    key = (lambda c: F.collate(c, "UNICODE_CI_AI")) if fold_accents else F.upper
    known = persons.where(F.col(person).isNotNull()).groupBy(key(F.col(person)).alias("_pk")).agg(F.min(cohort).alias("_cohort"))
    return df.withColumn("_nk", key(plain)).join(known, F.col("_nk") == F.col("_pk"), "left").withColumn(out, F.coalesce("_cohort", F.lit(otherwise))).drop("_nk", "_pk", "_cohort")


def first_match_lookup(names: DataFrame, entities: DataFrame, name: str, entity_id: str) -> DataFrame:
    """Smallest entity id among the exact matches of each name; names without match keep null."""
    hits = entities.groupBy(name).agg(F.min(entity_id).alias("match_id"))
    return names.join(hits, name, "left")


#: Keywords per automaton; a longer list is searched block by block.
MAX_KEYWORDS = 100_000


def keyword_hits(texts: DataFrame, keywords: DataFrame, id_col: str, text_col: str, key_col: str) -> DataFrame:
    """Distinct (id, keyword) with the lower-cased keyword inside the lower-cased text, also in the middle of words.

    A multi-pattern automaton reads each text once, however many keywords there are; it is rebuilt by each Python worker from a
    broadcast block of at most MAX_KEYWORDS. Null texts and empty keywords have no hits.
    """
    keys = keywords.select(F.col(key_col).alias("k"), F.lower(key_col).alias("low")).where("k <> ''").distinct()
    blocks = max(1, -(-keys.count() // MAX_KEYWORDS))
    rows = texts.select(id_col, F.lower(text_col).alias("_t")).where("_t is not null")
    parts = []
    for b in range(blocks):
        part = keys if blocks == 1 else keys.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b)
        parts.append(texts.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()]))
    # All blocks are walked in the one pass that reads and folds a text.
    found = rows.select(id_col, F.explode(F.concat(*[_finder(p, k)("_t") for k, p in enumerate(parts)])).alias(key_col))
    return found.distinct()


_FINDERS: dict[int, tuple] = {}


def _finder(shared: Broadcast, number: int) -> Callable[[str], Column]:
    def find(texts: pd.Series) -> pd.Series:
        if number not in _FINDERS or _FINDERS[number][0] is not shared.value:
            automaton = ahocorasick.Automaton()
            for key, low in shared.value:
                automaton.add_word(low, (*automaton.get(low, ()), key))
            automaton.make_automaton()
            if len(_FINDERS) > 8:
                _FINDERS.clear()
            _FINDERS[number] = (shared.value, automaton)
        automaton = _FINDERS[number][1]
        if not len(automaton):
            return pd.Series([[] for _ in texts])
        return pd.Series([sorted({k for _, keys in automaton.iter(t) for k in keys}) for t in texts])

    return F.pandas_udf(find, "array<string>")


def adjacent(df: DataFrame, order: str, partition: Sequence[str], kind: str, first: str, second: str, span: int = 1_000_000) -> DataFrame:
    """Elements of kind `first` directly followed by one of kind `second` in the order of an integer column.

    A partition is walked in stretches of `span` order values, so a partition with most of the rows is no single task;
    the last element of a stretch takes its successor from the next stretch that has elements.
    """
    keys = [*partition, "_stretch"]
    cut = df.withColumn("_stretch", F.floor(F.col(order) / span))
    inner = cut.withColumn("_next", F.lead(kind).over(Window.partitionBy(*keys).orderBy(order))).withColumn(
        "_last", F.lead(order).over(Window.partitionBy(*keys).orderBy(order)).isNull())
    heads = cut.groupBy(*keys).agg(F.min_by(kind, order).alias("_head"))
    heads = heads.withColumn("_after", F.lead("_head").over(Window.partitionBy(*partition).orderBy("_stretch"))).drop("_head")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"i.{k}").eqNullSafe(F.col(f"h.{k}"))
    joined = inner.alias("i").join(heads.alias("h"), same, "left")
    follows = F.when(F.col("_last"), F.col("_after")).otherwise(F.col("_next"))
    return joined.where((F.col(kind) == first) & (follows == second)).select("i.*").drop("_next", "_last", "_stretch")


def map_values(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    from rollbook.functions.classify import dict_map

    return df.withColumn(column, dict_map(F.col(column), mapping))
