"""The registered queries at the smallest scale: exact columns and types, and what must hold of any result."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
SCHEMAS = {
    "p1_found": [("src_field", "string"), ("row_id", "bigint"), ("ref_id", "int")],
    "p2_found": [("name_a", "string"), ("name_b", "string")],
    "p3_found": [("tab_a", "string"), ("id_a", "bigint"), ("tab_b", "string"), ("id_b", "bigint")],
    "p5_found": [("src_field", "string"), ("item_a", "string"), ("item_b", "string")],
    "p8_found": [("doc_id", "bigint"), ("reading_level", "int")],
}


def run(spark, name):
    return entry.queries()[name](spark, FOLDER)


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_columns(spark, name):
    df = run(spark, name)
    assert df.dtypes == SCHEMAS[name]
    assert df.count() == df.distinct().count()


def test_every_typed_value_has_one_row(spark):
    got = run(spark, "p1_found").groupBy("src_field").count().collect()
    read = lambda t: spark.read.parquet(f"{FOLDER}/{t}.parquet")
    names = [r[0] for r in read("reference_names").select("canonical_name").collect()]
    for src, n in got:
        table, column = src.split(".")
        values = [r[0] for r in read(table).select(column).collect()]
        assert n == sum(bool(v) and v not in names for v in values)


def test_pairs_are_ordered(spark):
    assert run(spark, "p2_found").where("name_a >= name_b").count() == 0
    assert run(spark, "p3_found").where("tab_a >= tab_b").count() == 0
    assert run(spark, "p3_matches").where("confidence <= 0.5 or confidence > 1").count() == 0


def test_levels_cover_the_unlabelled_long_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").toPandas()
    labelled = {r[0] for r in spark.read.parquet(f"{FOLDER}/reading_labels.parquet").select("doc_id").collect()}
    want = {d for d, t in zip(docs.doc_id, docs.text) if t and len(t.split()) >= 40 and d not in labelled}
    got = run(spark, "p8_found").toPandas()
    assert set(got.doc_id) == want and got.reading_level.between(1, 5).all()


def test_containers_hold_every_token_and_shares_add_up(spark):
    packed = run(spark, "p6_packing").toPandas()
    assert packed.groupby("spec_id").n_tokens.sum().nunique() == 1
    caps = {r.spec_id: r.capacity_tokens for r in spark.read.parquet(f"{FOLDER}/pack_specs.parquet").collect()}
    fill = packed.groupby(["spec_id", "container_id"]).n_tokens.sum()
    assert all((fill[s] <= c).all() for s, c in caps.items())
    shares = run(spark, "p7_shares").toPandas()
    assert abs(shares.reached_share.sum() - 1) < 1e-4 and (shares.most_copies <= shares.max_repeats).all()
