from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from rollbook.operators import aggregate as ag, match as mt
from rollbook.sources import docs, io as sources


def test_left_join_keeps_rows_and_suffixes(spark):
    left = spark.createDataFrame([(1, "Ann"), (2, None), (3, "bob")], "id int, name string")
    right = spark.createDataFrame([("ANN", 1), ("Bob", 2), ("bob", 3)], "name string, x int")
    out = mt.normalized_left_join(left, right, "name", "name")
    assert out.columns == ["id", "name", "name_wd", "x"]
    assert sorted((r.id, r.x) for r in out.collect() if r.x) == [(1, 1), (3, 2), (3, 3)]
    assert out.where("id = 2").first().x is None


def test_first_and_last_rows(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), (None, 5, "n")], "k string, o int, v string")
    assert {r.k: r.v for r in mt.first_rows(df, ["k"], F.col("o")).collect()} == {"a": "x", None: "n"}
    assert {r.k: r.v for r in mt.last_rows(df, ["k"], F.col("o")).collect()} == {"a": "y", None: "n"}


def test_keyword_hits_in_one_block_and_in_many(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "The Blue Club met"), (2, "superblue clubs"), (3, None), (4, ""), (1, "The blue club")], "id int, t string")
    keys = spark.createDataFrame([("blue club",), ("Blue Club",), ("Red",), ("",), (None,), ("club",)], "k string")
    want = [(1, "Blue Club"), (1, "blue club"), (1, "club"), (2, "Blue Club"), (2, "blue club"), (2, "club")]
    assert sorted(map(tuple, mt.keyword_hits(texts, keys, "id", "t", "k").collect())) == want
    monkeypatch.setattr(mt, "MAX_KEYWORDS", 2)
    assert sorted(map(tuple, mt.keyword_hits(texts, keys, "id", "t", "k").collect())) == want
    assert mt.keyword_hits(texts, keys.limit(0), "id", "t", "k").collect() == []


def test_totals_and_pivot(spark):
    edges = spark.createDataFrame([("o1", "c1", "p"), ("o1", "c2", "p"), ("o2", "c1", "p"), ("o2", "c1", "q")], "o string, c string, p string")
    assert dict(ag.hits_with_total(edges, "o", "p").collect()) == {"o1": 1, "o2": 2, "TOTAL": 2}
    got = {r.o: (r.c1_n, r.c1_persons, r.c2_n, r.c2_persons) for r in ag.hits_by_cohort(edges, "o", "c", "p", ["c1", "c2"]).collect()}
    assert got == {"o1": (1, "p", 1, "p"), "o2": (2, "p, q", 0, "")}


def test_coverage_and_zero_fill(spark):
    df = spark.createDataFrame([("a", ""), (None, "x")], "u string, v string")
    assert sorted(ag.field_coverage(df, ["u", "v"]).collect()) == [("u", 1, 2), ("v", 1, 2)]
    domain = spark.createDataFrame([("a",), ("b",)], "u string")
    assert dict(ag.zero_filled_counts(domain, df, "u").collect()) == {"a": 1, "b": 0}


def test_csv_round_trip_and_safe_overwrite(spark, tmp_path):
    df = spark.createDataFrame([('a "quoted", b', "", "x", "y", "z")], sources.ROSTER)
    path = str(tmp_path / "roster")
    sources.write_csv(df, path)
    back = sources.read_csv(spark, path, sources.ROSTER)
    assert back.collect() == df.collect()
    sources.safe_overwrite(back.withColumn("Name", F.upper("Name")), path)
    assert sources.read_csv(spark, path, sources.ROSTER).first().Name == 'A "QUOTED", B'


def test_sparql_and_xml_and_json(spark, tmp_path):
    body = '{"results":{"bindings":[{"p":{"value":"Q1"},"l":{"value":"A"}},{"p":{"value":"Q2"}}]}}'
    df = spark.createDataFrame([(body,)], "j string")
    assert sources.sparql_rows(df, "j", ["p", "l"]).collect() == [("Q1", "A"), ("Q2", "")]
    (tmp_path / "m.xml").write_text("<meps><mep><id>1</id><fullName>Zoë</fullName><country>X</country><politicalGroup>G</politicalGroup></mep></meps>")
    assert sources.read_xml_list(spark, str(tmp_path / "m.xml")).collect() == [("1", "Zoë", "X", "G")]
    (tmp_path / "h.json").write_text('{"o":["p","q"]}')
    assert sources.read_json_map(spark, str(tmp_path / "h.json")).collect() == [("o", "p"), ("o", "q")]


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def control(props, text):
    return f'<w:sdt><w:sdtPr>{props}</w:sdtPr><w:sdtContent><w:t>{text}</w:t></w:sdtContent></w:sdt>'


def test_archive(spark):
    body = f'<w:doc xmlns:w="{W}">' + control('<w:alias w:val="role"/><w:tag w:val="t"/>', " Chair ") + control('<w:tag w:val="org"/>', "Club") + control("<w:alias/><w:tag w:val='z'/>", "lost") + "</w:doc>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("b.xml", body)
        z.writestr("a.xml", "<broken")
        z.writestr("Test Form.xml", body)
    files = spark.createDataFrame([(raw.getvalue(),), (b"no zip",)], "content binary")
    got = [tuple(r) for r in docs.archive_controls(files).drop("path").collect()]
    assert ("b.xml", 0, "role", "Chair", None) in got and ("b.xml", 1, "org", "Club", None) in got and len(got) == 4
    assert sum(r[4] is not None for r in got) == 2


def test_html_rows(spark):
    page = "<h2>Spain</h2><!-- c --><table class='wikitable sortable'><tr><th>N</th></tr><tr><td>a <b>b</b></td><td></td></tr></table><table><tr><td>z</td></tr></table>"
    got = docs.html_rows(spark.createDataFrame([(1, page), (2, None)], "id int, html string"), "id", "html").collect()
    assert [tuple(r) for r in got] == [(1, 0, "wikitable sortable", "Spain", 0, ["N"]), (1, 0, "wikitable sortable", "Spain", 1, ["a b", ""]), (1, 1, "", "", 0, ["z"])]


def test_broken_pdf_goes_aside(spark):
    r = docs.pdf_texts(spark.createDataFrame([("a.pdf", b"no pdf")], "path string, content binary")).first()
    assert r.path == "a.pdf" and r.text is None and r.error


def test_batches_without_rows(spark):
    assert docs.html_rows(spark.createDataFrame([(1, "<p>none</p>")], "id int, html string"), "id", "html").collect() == []
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    assert docs.archive_controls(spark.createDataFrame([(empty.getvalue(),)], "content binary")).collect() == []


def test_adjacent_across_stretches(spark):
    rows = [("p", i, "ab"[i % 3 == 1]) for i in (0, 1, 5, 7, 30, 31, 34)] + [(None, 2, "a"), (None, 900, "b"), ("q", 3, "a")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    want = sorted([("p", 0), ("p", 5), ("p", 30), (None, 2)], key=str)
    for span in (1_000_000, 10, 1):
        got = mt.adjacent(df, "o", ["k"], "v", "a", "b", span=span)
        assert got.columns == ["k", "o", "v"]
        assert sorted(((r.k, r.o) for r in got.collect()), key=str) == want


def test_first_seen_scans_cohorts_in_order(spark):
    rows = [(1, "Ann", "Late"), (2, "Ann", "Early"), (3, "Bo", "Other"), (4, None, "Early"), (5, "Ann", "Early"), (6, "Bo", None)]
    out = ag.first_seen(spark.createDataFrame(rows, "id int, name string, cohort string"), "name", "cohort", ["Early", "Late"], "id")
    assert sorted(tuple(r) for r in out.collect()) == [(2, "Ann", "Early"), (3, "Bo", "Other")]


def test_ranked_places_ties_together(spark):
    out = ag.ranked(spark.createDataFrame([("a", 5), ("b", 7), ("c", 5), ("d", 1)], "k string, n bigint"), "n", "place")
    assert {r.k: r.place for r in out.collect()} == {"b": 1, "a": 2, "c": 2, "d": 4}


def test_cohort_trends_with_given_sizes(spark):
    roster = spark.createDataFrame([("x", "Ann"), ("x", "Ann"), ("x", "Bo")], "c string, name string")
    persons = spark.createDataFrame([("Ann", True), ("Bo", False)], "name string, f boolean")
    sizes = spark.createDataFrame([("x", 8)], "c string, size bigint")
    assert tuple(ag.cohort_trends(roster, persons, "c", "name", ["f"], sizes).first()) == ("x", 8, 2, 25.0)
    assert tuple(ag.cohort_trends(roster, persons, "c", "name", ["f"]).first()) == ("x", 3, 2, 66.7)


def test_cohort_lookup_with_and_without_accents(spark):
    df = spark.createDataFrame([(1, "Věra Lee(Serving Member"), (2, "VERA LEE"), (3, "No One"), (4, None)], "id int, name string")
    persons = spark.createDataFrame([("Věra Lee", "I"), (None, "II")], "person string, cohort string")
    plain = {r.id: r.out for r in mt.cohort_lookup(df, "name", persons, "person", "cohort", "out").collect()}
    folded = {r.id: r.out for r in mt.cohort_lookup(df, "name", persons, "person", "cohort", "out", fold_accents=True).collect()}
    assert plain == {1: "I", 2: "Other/Earlier", 3: "Other/Earlier", 4: "Other/Earlier"}
    assert folded == {1: "I", 2: "I", 3: "Other/Earlier", 4: "Other/Earlier"}


def test_keywords_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mt, "MAX_KEYWORDS", 1)
    texts = spark.createDataFrame([(1, "Alpha and BETA"), (2, None), (3, "gamma")], "id int, t string")
    keys = spark.createDataFrame([("alpha",), ("Beta",), ("delta",), ("",)], "k string")
    assert sorted(tuple(r) for r in mt.keyword_hits(texts, keys, "id", "t", "k").collect()) == [(1, "Beta"), (1, "alpha")]
