"""Problem 5: organisations of a commissioner and memberships of a court member that are named together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.cooccurrence import cooccurrence, more_than_chance
from rollbook.llm.queries import REG
from rollbook.plans.registry import Tables

_CELLS = """(select 'commissioner_appointments.atlanticist_orgs' as src_field, appt_id as id, atlanticist_orgs as cell from commissioner_appointments
 union all select 'cjeu_cv_data.page_memberships', cv_id, page_memberships from cjeu_cv_data)"""
_SCORED = f"""
with cells as (select * from {_CELLS} where cell <> ''),
 items as (select distinct src_field, id, unnest(string_split(cell, ' | ')) as item from cells),
 singles as (select src_field, item, count(*) as n_item from items where item <> '' group by 1, 2),
 totals as (select src_field, count(*) as n from cells group by 1),
 pairs as (select a.src_field, a.item as item_a, b.item as item_b, count(*) as n_ab from items a join items b on a.src_field = b.src_field and a.id = b.id and a.item < b.item where a.item <> '' group by 1, 2, 3),
 scored as (select p.*, x.n_item as n_a, y.n_item as n_b, t.n from pairs p join singles x on x.src_field = p.src_field and x.item = p.item_a
  join singles y on y.src_field = p.src_field and y.item = p.item_b join totals t on t.src_field = p.src_field)
"""


def _cells(t: Tables) -> DataFrame:
    cut = lambda c: F.split(F.nullif(F.col(c), F.lit("")), r" \| ")
    a = t.commissioner_appointments.select(F.lit("commissioner_appointments.atlanticist_orgs").alias("src_field"), cut("atlanticist_orgs").alias("items"))
    return a.unionByName(t.cjeu_cv_data.select(F.lit("cjeu_cv_data.page_memberships").alias("src_field"), cut("page_memberships").alias("items")))


@REG.query("p5_found", _SCORED + "select src_field, item_a, item_b from scored where n_ab >= 5 and n_ab * n >= 4 * n_a * n_b")
def p5_found(t: Tables) -> DataFrame:
    pairs = cooccurrence(_cells(t), ["src_field"], "items", min_joint=5)
    return pairs.where(more_than_chance(4)).select("src_field", "item_a", "item_b")


@REG.query("p5_scores", _SCORED + """select src_field, item_a, item_b, cast(n_ab as bigint) as n_ab, cast(n_a as bigint) as n_a, cast(n_b as bigint) as n_b, cast(n as bigint) as n,
 round(n_ab * n / (n_a::double * n_b), 6) as lift, round(ln(n_ab * n / (n_a::double * n_b)), 6) as pmi from scored""")
def p5_scores(t: Tables) -> DataFrame:
    s = cooccurrence(_cells(t), ["src_field"], "items")
    return s.select("src_field", "item_a", "item_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))
