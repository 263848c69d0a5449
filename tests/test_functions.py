from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rollbook.functions import classify, multivalue as mv, text as tx, timeline as tl


def one(spark, value, f):
    df = spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("r"))
    return df.first()[0]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (tx.py_strip, "  a b ", "a b"),
        (tx.clean_text, " a[1]  b c [note] ", "a b c"),
        (tx.clean_text, None, None),
        (tx.url_last_segment, "a/b/c", "c"),
        (tx.url_last_segment, "c", "c"),
        (tx.filename_to_name, "DOI-Ann Lee-FR (12).XML", "Ann Lee"),
        (tx.iso_date_prefix, "2001-02-03T04:05", "2001-02-03"),
        (tx.first_year, "13 November 2019 - 2315th meeting", 2019),
        (tx.first_year, "", None),
        (tx.slugify, " Ünal a/b ", "%C3%9Cnal_a/b"),
        (tx.strip_html_comments, "a<!-- x\ny -->b", "ab"),
        (tx.html_text, "<p> a </p><b>b</b>", "ab"),
        (tx.year_of_text, "x", None),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


def test_party_split(spark):
    grp = lambda v, i: one(spark, v, lambda c: tx.split_group_party(c)[i])
    assert (grp("A(B)(C)", 0), grp("A(B)(C)", 1)) == ("A", "B)(C")
    assert (grp("plain", 0), grp("plain", 1)) == ("plain", "")
    assert grp(None, 1) is None


def test_section(spark):
    t = '(A) "Posts" 1. x\ny (B) "Other"'
    assert one(spark, t, lambda c: tx.section_between(c, "A", "B")) == " 1. x\ny "
    assert one(spark, "none", lambda c: tx.section_between(c, "A", "B")) == ""


def test_numbered_items(spark):
    lines = "before\n1. a\nmore\n\n2. b\n2. c"
    got = one(spark, lines, lambda c: mv.render_items(mv.numbered_items(F.split(c, "\n"))))
    assert got == "1. a more || 2. b || 2. c"


def test_lists(spark):
    assert one(spark, "a || b || ", lambda c: mv.to_list(c, " || ")) == ["a", "b"]
    assert one(spark, None, lambda c: mv.to_list(c, " || ")) == []
    df = spark.createDataFrame([(["x", "y"], ["1"]), (None, ["2"]), ([], [])], "a array<string>, b array<string>")
    got = [[tuple(z) for z in r[0]] for r in df.select(mv.zip_outer("a", "b")).collect()]
    assert got == [[("x", "1"), ("y", "")], [("", "2")], []]


def test_classify(spark):
    rule = lambda v: one(spark, v, lambda c: classify.first_match(c, classify.SECTOR_RULES))
    assert rule("European Capital of Culture") == "Finance / corporate"
    assert rule("University bank") == "Academia"
    assert rule(None) == "Other"
    assert one(spark, "x", lambda c: classify.dict_map(c, {"x": "y"})) == "y"
    assert one(spark, "z", lambda c: classify.dict_map(c, {"x": "y"})) == "z"


def test_timeline(spark):
    items = lambda v: one(spark, v, lambda c: tl.latest_position(mv.to_list(c, " || ")))
    assert tuple(items("A (2001-01-01 to 2003-01-01) || B (from 2003-01-01) || C")) == ("A", "2003-01-01")
    assert tuple(items("C || D")) == ("C", "")
    assert items("Commissioner (2001-01-01 to 2003-01-01)") is None
    df = spark.createDataFrame([("p", None, "2001"), ("p", "2000", None), ("p", "2000", "2001")], "p string, s string, e string")
    assert [r[0] for r in df.select(tl.render_interval(F.col("p"), F.col("s"), F.col("e"))).collect()] == ["p", "p (from 2000)", "p (2000 to 2001)"]


def test_web_text_functions(spark):
    df = spark.createDataFrame([("A*b ~c/d", 'x "http://a/no.pdf" y "https://b/x_DPI_1.pdf?"', bytearray("Žá".encode()), bytearray(b"\xff\xfe"))], "s string, html string, ok binary, bad binary")
    row = df.select(tx.slugify(F.col("s")), tx.first_url(F.col("html"), "DPI", r"\.pdf"), tx.decode_utf8(F.col("ok")), tx.decode_utf8(F.col("bad")), tx.query_string({"a": F.col("s"), "b": F.lit(None).cast("string")})).first()
    assert tuple(row) == ("A%2Ab_~c/d", "https://b/x_DPI_1.pdf", "Žá", None, "a=A%2Ab+~c%2Fd&b=")


def test_files(spark, tmp_path):
    from rollbook.sources import io

    path = str(tmp_path / "t")
    for value in ("one", "two"):
        io.safe_overwrite(spark.createDataFrame([(value,)], "Name string"), path)
    again = io.read_csv(spark, path, io._strings("Name"))
    io.safe_overwrite(again, path)  # reads what it replaces
    assert [r.Name for r in io.read_csv(spark, path, io._strings("Name")).collect()] == ["two"]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t"]
    (tmp_path / "rows.json").write_text('[{"a": "1", "b": "x"}, {"a": "2"}]')
    assert sorted(tuple(r) for r in io.read_json_rows(spark, str(tmp_path / "rows.json"), io._strings("a", "b")).collect()) == [("1", "x"), ("2", None)]
    assert io.rows_of(spark, [], io._strings("a")).columns == ["a"] and io.rows_of(spark, [], io._strings("a")).count() == 0
    pages = tmp_path / "pages"
    pages.mkdir()
    for k in (1, 2):
        (pages / f"{k}.json").write_text('{"results": {"bindings": [{"x": {"value": "v%d"}}, {}]}}' % k)
    assert sorted(r.x for r in io.sparql_rows(io.read_pages(spark, str(pages)), "value", ["x"]).collect()) == ["", "", "v1", "v2"]
    shown = io.sample_report(spark.createDataFrame([(i, "t" * 400) for i in range(9)], "id int, t string"), "id", cuts={"t": 200})
    assert [(r.id, len(r.t)) for r in shown.collect()] == [(i, 200) for i in range(5)]
