"""The jobs from source documents to tables, each one declarative plan over the readers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions import multivalue as mv, text as tx, timeline as tl
from rollbook.functions.classify import dict_map
from rollbook.operators import match as mt
from rollbook.sources.docs import archive_controls, html_rows

# Form sections as (label, role field, name field, activity field).
SECTIONS = (
    ("I.1 Previous - Foundations/similar bodies", "c11", "c21", "c31"),
    ("I.2 Previous - Educational institutions", "c12", "c22", None),
    ("I.3 Previous - Governing/supervisory/advisory", "c13", "c23", "c33"),
    ("I.4 Previous - Other professional activities", "c14", None, None),
    ("II.1 Current - Honorary posts", "c15", "c25", "c35"),
    ("II.2 Current - Other functions", "c16", None, None),
)
FULL_NAME = "DOI_FullName"
SENTINELS = ("", "NOT APPLICABLE", "YES", "NO", "N/A")
# Claim properties and their fields; political groups written out.
PROPERTIES = {"P69": "education", "P106": "occupations", "P108": "employers", "P102": "party_history", "P166": "awards"}
GROUPS = {"RE": "Renew Europe", "G/EFA": "Greens/EFA", "Left": "The Left", "NI": "Non-Inscrits", "PfE": "Patriots for Europe", "ESN": "Europe of Sovereign Nations"}
HEADER_CELLS = ("Elected", "Current", "Initial", "In office", "MEP", "Constituency")


def affiliations(files: DataFrame) -> DataFrame:
    """ZIP archives (binaryFile rows) -> (commissioner, section, role, organisation, description, pos).

    Sentinel values leave the field lists before roles, names and activities are aligned, as a blank one moves later ones up.
    One shuffle: all fields of a form are collected by its archive and file name. A declared name counts as it is, also an empty one;
    the file name stands in only where the field is missing.
    """
    controls = archive_controls(files).where("error is null")
    fields = sorted({f for s in SECTIONS for f in s[1:] if f})
    lists = [
        F.transform(F.array_sort(F.collect_list(F.when((F.col("alias") == f) & ~F.col("text").isin(*SENTINELS), F.struct("pos", "text")))), lambda s: s["text"]).alias(f)
        for f in fields
    ]
    named = F.max_by(F.when(F.col("alias") == FULL_NAME, F.col("text")), F.when(F.col("alias") == FULL_NAME, F.col("pos")))
    forms = controls.groupBy("path", "entry").agg(named.alias("declared"), *lists)
    forms = forms.withColumn("commissioner", F.coalesce("declared", tx.filename_to_name(tx.url_last_segment(F.col("entry")))))
    parts = []
    for label, *columns in SECTIONS:
        aligned = mv.zip_outer(*[c for c in columns if c])
        rows = forms.select("commissioner", F.posexplode(aligned).alias("pos", "z"))
        given = [c for c in columns if c]
        cell = lambda c, given=given: F.col(f"z.a{given.index(c)}") if c else F.lit("")
        parts.append(rows.select("commissioner", F.lit(label).alias("section"), cell(columns[0]).alias("role"), cell(columns[1]).alias("organisation"), cell(columns[2]).alias("description"), "pos"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cv_table(names: DataFrame, labels: DataFrame, claims: DataFrame, statements: DataFrame) -> DataFrame:
    """CV rows out of triples.

    names: name. labels: id, label, human. claims: entity, prop, value, ord. statements: entity, position, start, end, ord; statements that
    began in 2024 or later and run on are the present office and left out. Each list is distinct in first-seen order.
    """
    ids = mt.first_match_lookup(names.select("name").distinct(), labels.where("human").select(F.col("label").alias("name"), "id"), "name", "id").where("match_id is not null")
    people = ids.groupBy(F.col("match_id").alias("entity")).agg(F.max("name").alias("name"))
    shown = labels.groupBy(F.col("id").alias("value")).agg(F.min("label").alias("label"))
    facts = mt.label_or_id(mt.semi_by_ids(claims, people, "entity"), shown, "value", "label", "shown").withColumn("field", dict_map(F.col("prop"), PROPERTIES))
    one = lambda prop: F.max_by(F.when(F.col("prop") == prop, F.col("shown")), F.when(F.col("prop") == prop, F.col("ord")))
    gathered = lambda field: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == field, F.struct("ord", "shown")))), lambda s: s["shown"])), " || ")
    attributes = facts.groupBy("entity").agg(tx.iso_date_prefix(one("P569")).alias("birth_date"), one("P19").alias("birth_place"), *[gathered(f).alias(f) for f in PROPERTIES.values()])
    past = statements.where(F.col("start").isNull() | (tx.year_of_text(F.col("start")) < 2024) | F.col("end").isNotNull())
    held = past.withColumn("item", tl.render_interval(F.col("position"), tx.iso_date_prefix(F.col("start")), tx.iso_date_prefix(F.col("end"))))
    positions = mt.semi_by_ids(held, people, "entity").groupBy("entity").agg(F.array_join(F.array_distinct(mv.ordered_list(F.col("item"), F.col("ord"))), " || ").alias("prev_positions"))
    out = people.join(attributes, "entity", "left").join(positions, "entity", "left")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select(F.col("entity").alias("wikidata_id"), "name", F.lit("").alias("term_start"), F.lit("").alias("wikidata_position"), *[blank(c) for c in ("birth_date", "birth_place", *PROPERTIES.values(), "prev_positions")])


def enriched_roster(roster: DataFrame, cv: DataFrame | None, on: str = "Name") -> DataFrame:
    """Roster with its CV columns; without a CV table the roster as it is."""
    return roster if cv is None else mt.normalized_left_join(roster, cv.withColumnRenamed("name", "name_wd"), on, "name_wd")


def _cell(i: int) -> Column:
    return F.coalesce(F.try_element_at("cells", F.lit(i + 1)), F.lit(""))


def web_roster(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """Commissioner roster out of the first wikitable of each page."""
    rows = html_rows(pages, page_id, html).where(F.array_contains(F.split("table_class", r"\s+"), "wikitable"))
    first = rows.groupBy(page_id).agg(F.min("table_no").alias("table_no"))
    body = rows.join(first, [page_id, "table_no"]).where((F.col("row_no") > 0) & (F.size("cells") >= 4))
    group, party = tx.split_group_party(tx.clean_text(_cell(3)))
    out = body.select(page_id, "row_no", tx.clean_text(_cell(2)).alias("Name"), tx.clean_text(_cell(0)).alias("Portfolio"), tx.clean_text(_cell(4)).alias("Country"), party.alias("National_Party"), group.alias("EP_Group"), tx.clean_text(_cell(5)).alias("Directorate_General"))
    return out.where(F.length("Name") >= 3)


def member_roster(pages: DataFrame, page_id: str, html: str, countries: Sequence[str], groups: Mapping[str, str] = GROUPS) -> DataFrame:
    """Parliament roster: tables under a heading that begins with a country's name, in either layout; first row of a (name, country)."""
    rows = html_rows(pages, page_id, html, strip_nodes=True)
    country = F.coalesce(*[F.when(F.startswith("heading", F.lit(c)), c) for c in countries], F.lit(""))
    listed = rows.withColumn("Country", country).where("Country <> ''")
    header = F.when(F.col("row_no") == 0, F.array_contains("cells", "Constituency"))
    tables = listed.groupBy(page_id, "table_no").agg(F.max(header).alias("wide"), F.count(F.lit(1)).alias("n_rows")).where("n_rows >= 3")
    body = listed.join(tables, [page_id, "table_no"]).where((F.size("cells") >= F.when(F.col("wide"), 14).otherwise(12)) & ~_cell(0).isin(*HEADER_CELLS))
    pick = lambda wide, narrow: F.when(F.col("wide"), _cell(wide)).otherwise(_cell(narrow))
    raw = body.withColumn("raw_name", pick(1, 0)).where(F.length("raw_name") >= 3)
    out = raw.select(
        page_id, "table_no", "row_no", tx.clean_text(F.col("raw_name")).alias("Name"), "Country", F.when(F.col("wide"), _cell(0)).otherwise("").alias("Constituency"),
        pick(3, 2).alias("National_Party"), dict_map(pick(7, 6), groups).alias("EP_Group"), pick(8, 7).alias("In_Office_Since"), pick(10, 9).alias("Birth_Date"), pick(11, 10).alias("Notes"))
    return mt.first_rows(out, ["Name", "Country"], F.col(page_id), F.col("table_no"), F.col("row_no"))


def declarations(texts: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): texts with the numbered items of sections A and C and their counts; blank texts go aside with a stage."""
    blank = F.coalesce(F.length(tx.py_strip(F.col(text))), F.lit(0)) == 0
    bad = texts.where(blank).withColumn("stage", F.lit("parse")).withColumn("error", F.lit("no text"))
    items = lambda a, b: mv.numbered_items(F.transform(F.split(tx.section_between(F.col(text), a, b), "\n"), tx.py_strip))
    good = texts.where(~blank).withColumn("_a", items("A", "B")).withColumn("_c", items("C", "D"))
    shown = good.withColumns({f"section_{k}_items": mv.render_items(F.col(f"_{k}")) for k in "ac"} | {f"section_{k}_count": F.size(f"_{k}") for k in "ac"})
    return shown.drop("_a", "_c"), bad


def declaration_flow(pages: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good, errors, counters) of the declarations found on people's pages.

    pages: name, html (null: the page could not be read), page_error. texts: url, text, error (of reading the file). The first absolute
    link with "DPI" that ends in ".pdf" is a page's declaration; people without one count as no_pdf and are no errors.
    errors: (name, stage, error). counters: success, no_pdf, pdf_fail (file not there), parse_fail (file not readable).
    """
    linked = pages.withColumn("url", F.nullif(tx.first_url(F.col("html"), "DPI", r"\.pdf"), F.lit("")))
    read = linked.join(texts.select(F.col("url"), F.lit(True).alias("there"), F.col("text"), F.col("error")), "url", "left")
    stage = (
        F.when(F.col("html").isNull(), "decl_page").when(F.col("url").isNull(), "no_pdf").when(F.col("there").isNull(), "pdf_download")
        .when(F.col("error").isNotNull(), "pdf_parse").otherwise("success")
    )
    staged = read.withColumn("stage", stage)
    good, _ = declarations(staged.where("stage = 'success'").drop("stage", "error"), "text")
    said = F.coalesce("error", "page_error", F.when(F.col("stage") == "pdf_download", "no such file"), F.lit(""))
    errors = staged.where("stage in ('decl_page', 'pdf_download', 'pdf_parse')").select("name", "stage", said.alias("error"))
    n = lambda s: F.count_if(F.col("stage") == s)
    counters = staged.agg(n("success").alias("success"), n("no_pdf").alias("no_pdf"), n("pdf_download").alias("pdf_fail"), n("pdf_parse").alias("parse_fail"))
    return good, errors, counters
