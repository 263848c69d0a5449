"""Problem 4: packed cells of the first roster and of the appointments, one value per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.operators.packed import split_packed
from rollbook.plans.registry import Registry, Tables

REG = Registry()

# The packed fields as (table, key, column).
PACKED = (
    ("commission_barroso_i_2004_2009", "roster_id", "prev_positions"),
    ("commission_barroso_i_2004_2009", "roster_id", "education"),
    ("commissioner_appointments", "appt_id", "named_institutions"),
)


@REG.query("p4_found")
def p4_found(t: Tables) -> DataFrame:
    cells = None
    for table, key, column in PACKED:
        part = getattr(t, table).select(F.lit(f"{table}.{column}").alias("src_field"), F.col(key).alias("row_id"), F.col(column).alias("cell"))
        cells = part if cells is None else cells.unionByName(part)
    known = t.reference_names.where("kind = 'institution'").select("canonical_name")
    return split_packed(cells, "cell", extra_values=known).select("src_field", "row_id", "pos", "val")
