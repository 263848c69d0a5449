"""Problems 6 and 7: documents packed into containers, and mixed to target shares, by their size in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rollbook.llm.mixing import mix, share_report
from rollbook.llm.packing import fill_report, pack
from rollbook.llm.queries import REG
from rollbook.llm.tokens import with_tokens
from rollbook.plans.registry import Tables
from rollbook.session import cut


@REG.query("p6_packing")
def p6_packing(t: Tables) -> DataFrame:
    """Every document's place in containers of each capacity."""
    sized = with_tokens(t.documents.select("doc_id", "text"), "text").select("doc_id", "n_tokens")
    return pack(sized, "doc_id", "n_tokens", t.pack_specs)


@REG.query("p6_fill")
def p6_fill(t: Tables) -> DataFrame:
    return fill_report(p6_packing(t), t.pack_specs, "n_tokens")


def _sized(t: Tables) -> DataFrame:
    return with_tokens(t.documents.select("doc_id", "source", "text"), "text").select("doc_id", "source", "n_tokens")


@REG.query("p7_mix")
def p7_mix(t: Tables) -> DataFrame:
    """Documents used and how often."""
    return mix(_sized(t), "doc_id", "source", "n_tokens", t.mix_targets)


@REG.query("p7_shares")
def p7_shares(t: Tables) -> DataFrame:
    sized = cut(_sized(t))
    return share_report(mix(sized, "doc_id", "source", "n_tokens", t.mix_targets), t.mix_targets, "n_tokens", sized)
