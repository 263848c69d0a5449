"""The jobs from source documents to tables, over documents made of the rows of the office-holder tables, with SQL on the rows themselves."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions import multivalue as mv
from rollbook.plans import pipelines as pl
from rollbook.plans.registry import Registry, Tables

REG = Registry()
query = REG.query

_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _list_sql(column: str, drop: str = "''") -> str:
    return f"list_filter(list_transform(string_split(coalesce({column}, ''), ' || '), lambda x: trim(x)), lambda x: x not in ({drop}))"


# Forms in archives

_SENTINELS = "'', 'NOT APPLICABLE', 'YES', 'NO', 'N/A'"


def form_archives(rows: DataFrame) -> DataFrame:
    """(path, content): per row an archive of one form; roles, names, activities and other posts are lists joined by ' || '."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, file, declared, *lists in b[["path", "file", "declared", "c11", "c21", "c31", "c14"]].itertuples(index=False, name=None):
                fields = [("DOI_FullName", declared)] if declared is not None else []
                fields += [(k, x) for k, cell in zip(("c11", "c21", "c31", "c14"), lists) for x in (cell or "").split(" || ")]
                body = "".join(f'<w:sdt><w:sdtPr><w:alias w:val="{k}"/></w:sdtPr><w:sdtContent><w:p><w:t>{escape(v)}</w:t></w:p></w:sdtContent></w:sdt>' for k, v in fields)
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w") as z:
                    z.writestr(f"forms/DOI-{file}-EN.xml", f'<w:document xmlns:w="{_NAMESPACE}">{body}</w:document>')
                    z.writestr("forms/Test Form.xml", "<broken")
                out.append((path, raw.getvalue()))
            if out:
                yield pd.DataFrame(out, columns=["path", "content"])

    return rows.mapInPandas(run, "path string, content binary")


@query("job_affiliations", f"""
with r as (select coalesce(name_wd, trim(name)) as commissioner, {_list_sql('occupations', _SENTINELS)} as o, {_list_sql('employers', _SENTINELS)} as e, {_list_sql('awards', _SENTINELS)} as a, {_list_sql('party_history', _SENTINELS)} as p
 from commission_i_2019_2024 where name is not null),
 one as (select commissioner, o, e, a, unnest(range(0, greatest(len(o), len(e), len(a)))) as i from r),
 four as (select commissioner, p, unnest(range(0, len(p))) as i from r)
select commissioner, 'I.1 Previous - Foundations/similar bodies' as section, coalesce(list_extract(o, i + 1), '') as role, coalesce(list_extract(e, i + 1), '') as organisation, coalesce(list_extract(a, i + 1), '') as description, cast(i as int) as pos from one
union all select commissioner, 'I.4 Previous - Other professional activities', list_extract(p, i + 1), '', '', cast(i as int) from four""")
def job_affiliations(t: Tables) -> DataFrame:
    r = t.commission_i_2019_2024.where("name is not null")
    rows = r.select(F.col("roster_id").cast("string").alias("path"), F.col("name").alias("file"), F.col("name_wd").alias("declared"), F.col("occupations").alias("c11"), F.col("employers").alias("c21"), F.col("awards").alias("c31"), F.col("party_history").alias("c14"))
    return pl.affiliations(form_archives(rows))


# Triples

_LISTS = ("education", "occupations", "employers", "party_history", "awards", "prev_positions")


def _gathered_sql(field: str) -> str:
    items = f"select wikidata_id, unnest(string_split({field}, ' || ')) as x, roster_id * 1000 + generate_subscripts(string_split({field}, ' || '), 1) as o from base"
    return f"(select wikidata_id, string_agg(x, ' || ' order by o) as {field} from (select wikidata_id, x, min(o) as o from ({items}) where x <> '' group by 1, 2) group by 1)"


_CV_SQL = f"""
with base as (select * from commission_i_2019_2024 where name is not null and wikidata_id <> ''),
 ids as (select name, min(wikidata_id) as wikidata_id from base group by 1), persons as (select wikidata_id, max(name) as name from ids group by 1),
 dates as (select wikidata_id, arg_max(substr(birth_date, 1, 10), roster_id) filter (where birth_date is not null) as birth_date, arg_max(birth_place, roster_id) filter (where birth_place is not null) as birth_place from base group by 1),
 cv as (select wikidata_id, persons.name, '' as term_start, '' as wikidata_position, coalesce(birth_date, '') as birth_date, coalesce(birth_place, '') as birth_place, {', '.join(f"coalesce({c}, '') as {c}" for c in _LISTS)}
 from persons left join dates using (wikidata_id) {' '.join(f'left join {_gathered_sql(c)} using (wikidata_id)' for c in _LISTS)})
"""


def _cv(t: Tables) -> DataFrame:
    base = t.commission_i_2019_2024.where("name is not null and wikidata_id <> ''")
    items = lambda c: mv.explode_list(base.select("wikidata_id", "roster_id", c), c, " || ", pos="i", val="value").select(F.col("wikidata_id").alias("entity"), "value", (F.col("roster_id") * 1000 + F.col("i")).alias("ord"))
    claims = None
    for prop, field in pl.PROPERTIES.items():
        part = items(field).withColumn("prop", F.lit(prop))
        claims = part if claims is None else claims.unionByName(part)
    for prop, field in (("P569", "birth_date"), ("P19", "birth_place")):
        claims = claims.unionByName(base.where(F.col(field).isNotNull()).select(F.col("wikidata_id").alias("entity"), F.col(field).alias("value"), F.col("roster_id").alias("ord"), F.lit(prop).alias("prop")))
    labels = base.select(F.col("wikidata_id").alias("id"), F.col("name").alias("label"), F.lit(True).alias("human")).distinct()
    none = F.lit(None).cast("string")
    statements = items("prev_positions").select("entity", F.col("value").alias("position"), none.alias("start"), none.alias("end"), "ord")
    return pl.cv_table(base.select("name"), labels, claims, statements)


@query("job_cv_table", _CV_SQL + "select * from cv")
def job_cv_table(t: Tables) -> DataFrame:
    return _cv(t)


@query("job_enriched_roster", _CV_SQL + "select r.roster_id, r.name, r.portfolio, cv.wikidata_id, cv.name as name_wd, cv.birth_date, cv.employers from commission_i_2019_2024 r left join cv on upper(cv.name) = upper(r.name)")
def job_enriched_roster(t: Tables) -> DataFrame:
    roster = t.commission_i_2019_2024.select("roster_id", "name", "portfolio")
    return pl.enriched_roster(roster, _cv(t), "name").select("roster_id", "name", "portfolio", "wikidata_id", "name_wd", "birth_date", "employers")


# Web pages

def _clean_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '\[.*?\]', '', 'g'), '{_SPACE}', ' ', 'g'))"


_SHAPE = r"^(.*?)\((.+)\)$"


@query("job_web_roster", rf"""
with r as (select coalesce(country, '') as page, row_number() over (partition by coalesce(country, '') order by roster_id) as row_no, {_clean_sql("name || '[1]'")} as n, {_clean_sql("coalesce(portfolio, '')")} as p,
 {_clean_sql("coalesce(ep_group, '') || '(' || coalesce(national_party, '') || ')'")} as g, {_clean_sql("coalesce(country, '')")} as c from commission_barroso_i_2004_2009 where name is not null)
select page, cast(row_no as int) as row_no, n as "Name", p as "Portfolio", c as "Country", case when regexp_matches(g, '{_SHAPE}') then trim(regexp_extract(g, '{_SHAPE}', 2)) else '' end as "National_Party",
 case when regexp_matches(g, '{_SHAPE}') then trim(regexp_extract(g, '{_SHAPE}', 1)) else g end as "EP_Group", 'DG' as "Directorate_General" from r where length(n) >= 3""")
def job_web_roster(t: Tables) -> DataFrame:
    """One page a country: a table of other things, then the roster."""
    safe = lambda c: F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    cells = [safe("portfolio"), F.lit("<img src='x'>"), F.concat(F.lit("<a>"), safe("name"), F.lit("</a><sup>[1]</sup>")), F.concat(safe("ep_group"), F.lit("("), safe("national_party"), F.lit(")")), safe("country"), F.lit("DG")]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    rows = t.commission_barroso_i_2004_2009.where("name is not null").select(F.coalesce("country", F.lit("")).alias("page"), "roster_id", row.alias("row"))
    body = F.array_join(mv.ordered_list(F.col("row"), F.col("roster_id")), "\n")
    html = F.concat(F.lit("<table class='infobox'><tr><td>a</td></tr></table><!-- <table> --><table class='wikitable sortable'><tr><th>Portfolio</th></tr>"), body, F.lit("</table>"))
    return pl.web_roster(rows.groupBy("page").agg(html.alias("html")), "page", "html")


# Declarations


@query("job_declarations", f"""
with r as (select roster_id, {_list_sql('occupations')} as a, {_list_sql('employers')} as c from commission_i_2019_2024 where name is not null),
 item as (select roster_id, 'a' as k, i, list_extract(a, i) as x from r, lateral (select unnest(range(1, len(a) + 1)) as i) union all select roster_id, 'c', i, list_extract(c, i) from r, lateral (select unnest(range(1, len(c) + 1)) as i)),
 shown as (select roster_id, string_agg(i || '. ' || x || ' since 2001', ' || ' order by i) filter (where k = 'a') as sa, string_agg(i || '. ' || x || ' since 2001', ' || ' order by i) filter (where k = 'c') as sc from item group by 1)
select r.roster_id, coalesce(sa, '') as section_a_items, cast(len(a) as int) as section_a_count, coalesce(sc, '') as section_c_items, cast(len(c) as int) as section_c_count from r left join shown on shown.roster_id = r.roster_id""")
def job_declarations(t: Tables) -> DataFrame:
    """Declarations whose items are the occupations and employers of the row, each on two lines."""
    items = lambda c: F.array_join(F.transform(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r" \|\| "), lambda x: F.trim(x)), lambda x: x != ""), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("\n since 2001"))), "\n")
    text = F.concat(F.lit('Declaration\n(A) "Occupation"\nbefore\n'), items("occupations"), F.lit('\n(B) "Other"\n1. none\n(C) "Membership"\n'), items("employers"), F.lit('\n(D) "Rest"'))
    good, _ = pl.declarations(t.commission_i_2019_2024.where("name is not null").select("roster_id", text.alias("text")), "text")
    return good.select("roster_id", "section_a_items", "section_a_count", "section_c_items", "section_c_count")


def _flow(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = t.commission_barroso_i_2004_2009.where("name is not null").select("roster_id", "name", "wikidata_id", "education", "portfolio")
    url = F.concat(F.lit("https://files.example/"), "roster_id", F.lit("_DPI_"), "wikidata_id", F.lit(".pdf"))
    html = F.when(F.col("portfolio").isNotNull(), F.concat(F.lit('<a href="https://files.example/a.pdf">x</a> <a href="'), F.coalesce(url, F.lit("none")), F.lit('">y</a>')))
    pages = r.select("name", html.alias("html"), F.when(F.col("portfolio").isNull(), "timed out").alias("page_error"))
    texts = r.where("wikidata_id is not null and education is not null").select(url.alias("url"), F.when(F.trim("education") != "", F.concat(F.lit('(A) "x"\n1. '), "education")).alias("text"), F.when(F.trim("education") == "", "broken file").alias("error"))
    return pl.declaration_flow(pages, texts)


_STAGE_SQL = """(select name, case when portfolio is null then 'decl_page' when wikidata_id is null then 'no_pdf' when education is null then 'pdf_download' when trim(education, ' ') = '' then 'pdf_parse' else 'success' end as stage
 from commission_barroso_i_2004_2009 where name is not null)"""


@query("job_declaration_counters", f"""
select cast(count(*) filter (where stage = 'success') as bigint) as success, cast(count(*) filter (where stage = 'no_pdf') as bigint) as no_pdf, cast(count(*) filter (where stage = 'pdf_download') as bigint) as pdf_fail, cast(count(*) filter (where stage = 'pdf_parse') as bigint) as parse_fail from {_STAGE_SQL}""")
def job_declaration_counters(t: Tables) -> DataFrame:
    return _flow(t)[2]


@query("job_declaration_errors", f"""
select name, stage, case stage when 'decl_page' then 'timed out' when 'pdf_download' then 'no such file' else 'broken file' end as error from {_STAGE_SQL} where stage in ('decl_page', 'pdf_download', 'pdf_parse')""")
def job_declaration_errors(t: Tables) -> DataFrame:
    return _flow(t)[1]
