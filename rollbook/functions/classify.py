"""Ordered first-match rules and dictionary maps; rule sets are data passed in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]


def first_match(text: Column, rules: Sequence[Rule], default: str = "Other") -> Column:
    """Label of the first rule of which a keyword occurs in the lower-cased text; null counts as ''."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for rule in rules:
        hit = F.lit(False)
        for word in rule.keywords:
            hit = hit | low.contains(word)
        out = F.when(hit, rule.label) if out is None else out.when(hit, rule.label)
    return F.lit(default) if out is None else out.otherwise(default)


def dict_map(c: Column, mapping: Mapping[str, str]) -> Column:
    """Dictionary lookup; a value without entry stays itself."""
    if not mapping:
        return c
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


# Sector rules, in order.
SECTOR_RULES = (
    Rule("Academia", ("universit", "universidad", "college", "school of", "sciences-po")),
    Rule("Finance / corporate", ("bank", "finance", "capital", "fund", "investment", "deloitte", "amundi", "donner")),
    Rule("Think tank / advisory", ("friends of europe", "elcano", "globsec", "leadership network", "club de madrid", "forum")),
    Rule("Consultancy / lobbying", ("consult", "advisory services", "speakers bureau", "speaking", "flint", "kekst", "teha", "prisa", "management")),
    Rule("Int'l organisation", ("united nations", "unesco", "unicef", "osce", "irena", "oecd", "una ")),
    Rule("Public / political", ("government", "chancellor", "parliament")),
    Rule("NGO / foundation", ("foundation", "ngo", "health", "association", "cancer", "alliance")),
)

# Prior-role rules, in order.
ROLE_RULES = (
    Rule("MEP", ("member of the european parliament",)),
    Rule("Head of state", ("president of the republic",)),
    Rule("European Council / EEAS", ("high representative",)),
    Rule("National minister", ("minister", "chief of staff")),
    Rule("Diplomat / ambassador", ("ambassador", "permanent representative")),
    Rule("Regional / local govt", ("governor", "mayor", "regional")),
    Rule("Party leader", ("president of the",)),
    Rule("Academic / think tank", ("rector", "director")),
    Rule("National parliament", ("parliament", "chamber", "bundestag", "riigikogu", "assembly", "teachta", "congress", "seimas", "house of", "privy council")),
)
