from __future__ import annotations

import io
import zipfile

from rollbook.plans import pipelines as pl

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def form(*pairs):
    body = "".join(f'<w:sdt><w:sdtPr><w:tag w:val="{k}"/></w:sdtPr><w:sdtContent><w:t>{v}</w:t></w:sdtContent></w:sdt>' for k, v in pairs)
    return f'<w:doc xmlns:w="{W}">{body}</w:doc>'


def archive(**entries):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, body in entries.items():
            z.writestr(name, body)
    return raw.getvalue()


def test_affiliations(spark):
    raw = archive(**{
        "x/DOI-Ann Lee-EN.xml": form(("c11", "NO"), ("c11", "Chair"), ("c11", "Member"), ("c21", "Club"), ("c14", "Writer")),
        "DOI-File Name-FR (2).xml": form(("DOI_FullName", "Bo Roe"), ("c22", "School"), ("unknown", "x")),
    })
    out = pl.affiliations(spark.createDataFrame([(raw,)], "content binary")).collect()
    got = sorted((r.commissioner, r.section[:4].strip(), r.role, r.organisation, r.description) for r in out)
    assert got == [("Ann Lee", "I.1", "Chair", "Club", ""), ("Ann Lee", "I.1", "Member", "", ""), ("Ann Lee", "I.4", "Writer", "", ""), ("Bo Roe", "I.2", "", "School", "")]


def test_cv_and_enrichment(spark):
    names = spark.createDataFrame([("Ann Lee",), ("No One",)], "name string")
    labels = spark.createDataFrame([("Q2", "Ann Lee", True), ("Q1", "Ann Lee", True), ("Q0", "Ann Lee", False), ("S1", "School", False)], "id string, label string, human boolean")
    claims = spark.createDataFrame([("Q1", "P69", "S1", 2), ("Q1", "P69", "S9", 1), ("Q1", "P69", "S1", 3), ("Q1", "P569", "1950-01-01T00:00:00Z", 1), ("Q2", "P69", "S1", 1)], "entity string, prop string, value string, ord int")
    statements = spark.createDataFrame([("Q1", "Mayor", None, "2001-01-01T", 1), ("Q1", "Minister", "2000-01-01T", "2002-01-01T", 2), ("Q1", "Now", "2025-01-01T", None, 3)], "entity string, position string, start string, end string, ord int")
    cv = pl.cv_table(names, labels, claims, statements).collect()
    assert [(r.wikidata_id, r.name, r.birth_date, r.education, r.awards, r.prev_positions) for r in cv] == [("Q1", "Ann Lee", "1950-01-01", "S9 || School", "", "Mayor || Minister (2000-01-01 to 2002-01-01)")]
    roster = spark.createDataFrame([("ANN LEE", "Trade"), ("X Y", "Tax")], "Name string, Portfolio string")
    out = {r.Name: r.wikidata_id for r in pl.enriched_roster(roster, pl.cv_table(names, labels, claims, statements)).collect()}
    assert out == {"ANN LEE": "Q1", "X Y": None}
    assert pl.enriched_roster(roster, None).columns == roster.columns


def page_row(*cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


def test_web_roster(spark):
    table = "<table class='wikitable'>" + page_row(*"Portfolio Portrait Name Party State DG".split()) + page_row("Trade[1]", "", "Ann  Lee[2]", "EPP(CDU(X))", "DEU", "TRADE") + page_row("Tax", "", "Al", "S", "x") + page_row("a", "b", "c") + "</table>"
    out = pl.web_roster(spark.createDataFrame([(1, "<table></table>" + table)], "id int, html string"), "id", "html").collect()
    assert [(r.Name, r.Portfolio, r.Country, r.National_Party, r.EP_Group, r.Directorate_General) for r in out] == [("Ann Lee", "Trade", "DEU", "CDU(X)", "EPP", "TRADE")]


def test_member_roster(spark):
    wide = lambda name: page_row("North", name, "", "P", "", "", "", "RE", "2019", "", "1950", "note", "", "")
    narrow = page_row("Bo Roe", "", "Q", "", "", "", "XX", "2020", "", "1960", "n2", "")
    html = (
        "<h2>Spain (61)</h2><table>" + page_row("Constituency", "MEP") + page_row(*["MEP"] * 14) + wide("Ann Lee[1]") + wide("Ann Lee") + "</table>"
        "<h2>Italy</h2><table>" + page_row("MEP") + narrow + narrow + "</table><h2>Other</h2><table>" + page_row("MEP") + narrow + narrow + "</table>"
    )
    out = pl.member_roster(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html", ["Spain", "Italy"]).collect()
    got = sorted((r.Name, r.Country, r.Constituency, r.National_Party, r.EP_Group, r.In_Office_Since, r.Birth_Date, r.Notes) for r in out)
    assert got == [("Ann Lee", "Spain", "North", "P", "Renew Europe", "2019", "1950", "note"), ("Bo Roe", "Italy", "", "Q", "XX", "2020", "1960", "n2")]


def test_declarations(spark):
    text = '(A) "Work"\n1. one\nmore\n2. two\n(B) "x"\n(C) "y" none (D)'
    good, bad = pl.declarations(spark.createDataFrame([(1, text), (2, "  "), (3, None)], "id int, t string"), "t")
    r = good.first()
    assert (r.section_a_items, r.section_a_count, r.section_c_items, r.section_c_count) == ("1. one more || 2. two", 2, "", 0)
    assert sorted(x.id for x in bad.collect()) == [2, 3]


def test_forms_of_equal_file_names_stay_apart(spark):
    one = archive(**{"DOI-Ann Lee-EN.xml": form(("c11", "Chair"), ("c21", "Club")), "DOI-No-EN.XML": form(("c11", "not read"))})
    two = archive(**{"DOI-Ann Lee-EN.xml": form(("DOI_FullName", ""), ("c11", "Member"), ("c21", "Board"))})
    out = pl.affiliations(spark.createDataFrame([("a.zip", one), ("b.zip", two)], "path string, content binary")).collect()
    got = sorted((r.commissioner, r.role, r.organisation) for r in out)
    assert got == [("", "Member", "Board"), ("Ann Lee", "Chair", "Club")]  # a declared name counts also when it is empty


def test_declaration_flow(spark):
    link = '<a href="http://x/other.pdf"><a href="{}">'.format
    pages = [("Ann", link("https://x/1_DPI_a.pdf"), None), ("Bo", link("https://x/cv.pdf"), None), ("Cy", None, "timed out"), ("Di", link("https://x/DPI2.pdf"), None), ("Ed", link("https://x/DPI3.pdf"), None)]
    texts = [("https://x/1_DPI_a.pdf", '(A) "W"\n1. one\n2. two', None), ("https://x/DPI3.pdf", None, "broken")]
    good, errors, counters = pl.declaration_flow(spark.createDataFrame(pages, "name string, html string, page_error string"), spark.createDataFrame(texts, "url string, text string, error string"))
    assert [(r.name, r.section_a_items) for r in good.collect()] == [("Ann", "1. one || 2. two")]
    assert sorted(tuple(r) for r in errors.collect()) == [("Cy", "decl_page", "timed out"), ("Di", "pdf_download", "no such file"), ("Ed", "pdf_parse", "broken")]
    assert tuple(counters.first()) == (1, 1, 1, 1)
