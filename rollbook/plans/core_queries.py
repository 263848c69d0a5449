"""One query per operator of the survey, on the office-holder tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollbook.functions import classify, multivalue as mv, text as tx, timeline as tl
from rollbook.operators import aggregate as ag, match as mt
from rollbook.plans.registry import Registry

REG = Registry()
query = REG.query

_PEOPLE = "(select * from (select *, row_number() over (partition by name order by appt_id) rn from commissioner_appointments where name is not null) where rn = 1)"


def people(t, *columns):
    """One row per named person of the appointments, first seen wins; only the columns asked for are read."""
    rows = t.commissioner_appointments.where("name is not null").select("appt_id", "name", *columns)
    return mt.first_rows(rows, ["name"], F.col("appt_id")).drop("appt_id")


# Joins

@query("left_join_normalized_key", f"""
select r.roster_id, r.name, r.portfolio, p.name as name_appt, p.country_code
from commission_i_2019_2024 r left join {_PEOPLE} p on upper(r.name) = upper(p.name)""")
def _(t):
    right = people(t, "country_code")
    return mt.normalized_left_join(t.commission_i_2019_2024.select("roster_id", "name", "portfolio"), right, "name", "name", "_appt")


@query("match_coverage", f"""
select cast(count(p.name) as bigint) as matched, cast(count(*) as bigint) as total
from commission_revolving_door d left join {_PEOPLE} p on upper(d.name) = upper(p.name)""")
def _(t):
    right = people(t).select(F.col("name").alias("hit"))
    return mt.coverage(mt.normalized_left_join(t.commission_revolving_door.select("rd_id", "name"), right, "name", "hit"), "hit")


@query("semi_join_batch", """
select edu_id, name, institution from commissioner_education
where name in (select name from commission_i_2019_2024 where wikidata_id is not null)""")
def _(t):
    ids = t.commission_i_2019_2024.where("wikidata_id is not null")
    return mt.semi_by_ids(t.commissioner_education.select("name", "edu_id", "institution"), ids, "name")


@query("anti_join_minus", """
select appt_id, name from commissioner_appointments a
where not exists (select 1 from commissioner_education e where e.name = a.name)""")
def _(t):
    return mt.minus(t.commissioner_appointments.select("appt_id", "name"), t.commissioner_education, ["name"])


@query("optional_left_join", """
select b.roster_id, coalesce(i.name, '') as vdl_name, coalesce(i.portfolio, '') as vdl_portfolio
from commission_barroso_i_2004_2009 b
left join (select wikidata_id, min(name) as name, min(portfolio) as portfolio from commission_i_2019_2024 where wikidata_id is not null group by 1) i
on b.wikidata_id = i.wikidata_id""")
def _(t):
    right = t.commission_i_2019_2024.where("wikidata_id is not null").groupBy("wikidata_id").agg(F.min("name").alias("n"), F.min("portfolio").alias("p"))
    left = t.commission_barroso_i_2004_2009.select("roster_id", "wikidata_id")
    return left.join(right, "wikidata_id", "left").select("roster_id", F.coalesce("n", F.lit("")).alias("vdl_name"), F.coalesce("p", F.lit("")).alias("vdl_portfolio"))


_STATEMENTS_SQL = r"""(select roster_id, wikidata_id, x as item,
  case when regexp_matches(x, '^(.*) \((?:from )?(\d{4}-\d{2}-\d{2})(?: to (\d{4}-\d{2}-\d{2}))?\)$') then regexp_extract(x, '^(.*) \((?:from )?(\d{4}-\d{2}-\d{2})(?: to (\d{4}-\d{2}-\d{2}))?\)$', 1) else x end as position,
  nullif(regexp_extract(x, '^(.*) \((?:from )?(\d{4}-\d{2}-\d{2})(?: to (\d{4}-\d{2}-\d{2}))?\)$', 2), '') as start_date,
  nullif(regexp_extract(x, '^(.*) \((?:from )?(\d{4}-\d{2}-\d{2})(?: to (\d{4}-\d{2}-\d{2}))?\)$', 3), '') as end_date
 from (select roster_id, wikidata_id, unnest(string_split(coalesce(prev_positions, ''), ' || ')) as x from commission_i_2019_2024) where x <> '')"""


def statements(t):
    """Positions of the first roster as statements with validity."""
    items = mv.explode_list(t.commission_i_2019_2024.select("roster_id", "wikidata_id", "prev_positions"), "prev_positions", " || ", val="item")
    s = tl.parse_interval(F.col("item"))
    return items.select("roster_id", "wikidata_id", "pos", "item", s["position"].alias("position"), F.nullif(s["start_date"], F.lit("")).alias("start_date"), F.nullif(s["end_date"], F.lit("")).alias("end_date"))


@query("graph_pattern_inner", f"""
select a.appt_id, a.country_code, s.position
from {_STATEMENTS_SQL} s join commission_i_2019_2024 r on r.roster_id = s.roster_id join commissioner_appointments a on a.name = r.name
where s.start_date is not null""")
def _(t):
    roster = t.commission_i_2019_2024.select("roster_id", "name")
    held = statements(t).where("start_date is not null").select("roster_id", "position")
    return held.join(roster, "roster_id").join(t.commissioner_appointments.select("appt_id", "name", "country_code"), "name").select("appt_id", "country_code", "position")


@query("three_valued_filter", f"""
select roster_id, item from {_STATEMENTS_SQL} where start_date is null or cast(substr(start_date, 1, 4) as int) < 2004 or end_date is not null""")
def _(t):
    year = tx.year_of_text(F.col("start_date"))
    return statements(t).where(F.col("start_date").isNull() | (year < 2004) | F.col("end_date").isNotNull()).select("roster_id", "item")


@query("year_filter", "select edu_id, cast(year(observed_at) as int) as y from commissioner_education where year(observed_at) >= 2025")
def _(t):
    return t.commissioner_education.where(F.year("observed_at") >= 2025).select("edu_id", F.year("observed_at").alias("y"))


@query("label_or_id", """
select b.roster_id, coalesce(l.label, b.wikidata_id) as shown from commission_barroso_i_2004_2009 b
left join (select wikidata_id, min(name_wd) as label from commission_i_2019_2024 where wikidata_id is not null group by 1) l on l.wikidata_id = b.wikidata_id""")
def _(t):
    labels = t.commission_i_2019_2024.where("wikidata_id is not null").groupBy("wikidata_id").agg(F.min("name_wd").alias("label"))
    return mt.label_or_id(t.commission_barroso_i_2004_2009.select("roster_id", "wikidata_id"), labels, "wikidata_id", "label", "shown").select("roster_id", "shown")


@query("first_match_lookup", """
select d.rd_id, d.name, x.match_id from commission_revolving_door d
left join (select name, min(appt_id) as match_id from commissioner_appointments group by 1) x on x.name = d.name""")
def _(t):
    return mt.first_match_lookup(t.commission_revolving_door.select("name", "rd_id"), t.commissioner_appointments, "name", "appt_id")


# Sector recodes used by the map query.
_SECTOR_NAMES = {"Money and markets": "Finance", "Lobby and advice": "Consultancy", "Charity": "NGO"}


@query("dict_map_fallback", """
select rd_id, case sector when 'Money and markets' then 'Finance' when 'Lobby and advice' then 'Consultancy' when 'Charity' then 'NGO' else sector end as sector
from commission_revolving_door""")
def _(t):
    return mt.map_values(t.commission_revolving_door.select("rd_id", "sector"), "sector", _SECTOR_NAMES)


@query("section_lookup_inner", """
select m.raw_id, v.section from cjeu_members_raw m
join (values ('Judge', 'bench'), ('Advocate General', 'opinions'), ('Registrar', 'registry')) v(role, section) on v.role = m.role""")
def _(t):
    dim = t.spark.createDataFrame([("Judge", "bench"), ("Advocate General", "opinions"), ("Registrar", "registry")], "role string, section string")
    return t.cjeu_members_raw.join(F.broadcast(dim), "role").select("raw_id", "section")


@query("code_lookup", """
select b.roster_id, b.country, x.country_name from commission_barroso_i_2004_2009 b
left join (select country_code, min(country) as country_name from commissioner_appointments where country <> '' group by 1) x on x.country_code = b.country""")
def _(t):
    names = t.commissioner_appointments.where("country <> ''").groupBy(F.col("country_code").alias("country")).agg(F.min("country").alias("country_name"))
    return t.commission_barroso_i_2004_2009.select("roster_id", "country").join(names, "country", "left")


@query("keyword_match_join", """
select distinct d.doc_id, o.canonical_name from documents d join reference_names o
on o.kind = 'organisation' and contains(lower(d.text), lower(o.canonical_name))""")
def _(t):
    return hits(t)


def hits(t):
    orgs = t.reference_names.where("kind = 'organisation'")
    return mt.keyword_hits(t.documents, orgs, "doc_id", "text", "canonical_name")


_HITS_SQL = """(select distinct d.doc_id, o.canonical_name, d.lang, d.source from documents d join reference_names o
on o.kind = 'organisation' and contains(lower(d.text), lower(o.canonical_name)))"""


@query("hits_join_taxonomy", f"""
select h.canonical_name, r.country_code, cast(count(*) as bigint) as docs from {_HITS_SQL} h join reference_names r using (canonical_name) group by 1, 2""")
def _(t):
    return hits(t).groupBy("canonical_name").agg(F.count(F.lit(1)).alias("docs")).join(t.reference_names.select("canonical_name", "country_code"), "canonical_name")


@query("hits_pivot", f"""
select canonical_name,
 cast(count(distinct case when lang = 'de' then doc_id end) as bigint) as de_n, coalesce(string_agg(distinct case when lang = 'de' then cast(doc_id as varchar) end, ', ' order by case when lang = 'de' then cast(doc_id as varchar) end), '') as de_persons,
 cast(count(distinct case when lang = 'fr' then doc_id end) as bigint) as fr_n, coalesce(string_agg(distinct case when lang = 'fr' then cast(doc_id as varchar) end, ', ' order by case when lang = 'fr' then cast(doc_id as varchar) end), '') as fr_persons
from {_HITS_SQL} where lang in ('de', 'fr') group by 1""")
def _(t):
    edges = hits(t).join(t.documents.select("doc_id", "lang").where(F.col("lang").isin("de", "fr")), "doc_id")
    return ag.hits_by_cohort(edges.withColumn("doc_id", F.col("doc_id").cast("string")), "canonical_name", "lang", "doc_id", ["de", "fr"])


@query("hits_total_row", f"""
select coalesce(canonical_name, 'TOTAL') as canonical_name, cast(count(distinct doc_id) as bigint) as n from {_HITS_SQL} group by rollup(canonical_name)""")
def _(t):
    return ag.hits_with_total(hits(t), "canonical_name", "doc_id")


@query("most_connected", f"""
select doc_id, n, cast(rank() over (order by n desc) as int) as place from (select doc_id, cast(count(*) as bigint) as n from {_HITS_SQL} group by 1)""")
def _(t):
    """Everyone ranked by the number of hits; the places come from the few distinct numbers, not from one sorted partition."""
    n = hits(t).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return ag.ranked(n, "n", "place")


@query("flags_and_ties", """
select appt_id, coalesce((select string_agg(x, ' | ' order by x) from (select distinct unnest(string_split(a.atlanticist_orgs, ' | ')) as x) where x <> ''), '') as orgs,
 cast(coalesce((select count(*) from (select distinct unnest(string_split(a.atlanticist_orgs, ' | ')) as x) where x <> ''), 0) as int) as n_ties,
 coalesce((select count(*) from (select distinct unnest(string_split(a.atlanticist_orgs, ' | ')) as x) where x <> ''), 0) > 0 as flag
from commissioner_appointments a""")
def _(t):
    orgs = F.array_sort(F.array_distinct(mv.to_list(F.col("atlanticist_orgs"), " | ")))
    return t.commissioner_appointments.select("appt_id", mv.from_list(orgs, " | ").alias("orgs"), F.size(orgs).alias("n_ties"), (F.size(orgs) > 0).alias("flag"))


# Dedup and windows

@query("dedup_first_seen", "select edu_id, name, institution from (select *, row_number() over (partition by name order by observed_at nulls last, edu_id) rn from commissioner_education where name is not null) where rn = 1")
def _(t):
    e = t.commissioner_education.where("name is not null").select("edu_id", "name", "institution", "observed_at")
    return mt.first_rows(e, ["name"], F.col("observed_at").isNull(), F.col("observed_at"), F.col("edu_id")).drop("observed_at")


@query("drop_duplicates_subset", "select org_row_id, organisation, type from (select *, row_number() over (partition by organisation, type order by org_row_id) rn from organisations_classified) where rn = 1")
def _(t):
    return mt.first_rows(t.organisations_classified.select("org_row_id", "organisation", "type"), ["organisation", "type"], F.col("org_row_id"))


@query("distinct_rows", "select distinct commission, sector from commission_revolving_door")
def _(t):
    return t.commission_revolving_door.select("commission", "sector").distinct()


@query("latest_by_date", r"""
select appt_name as name, commission from (select name as appt_name, commission, row_number() over (partition by name order by loaded_at desc, appt_id) rn from commissioner_appointments where name is not null) where rn = 1""")
def _(t):
    a = t.commissioner_appointments.where("name is not null").select("name", "commission", "loaded_at", "appt_id")
    return mt.last_rows(a, ["name"], F.col("loaded_at"), -F.col("appt_id")).select("name", "commission")


@query("last_value_wins", "select name, institution from (select name, institution, row_number() over (partition by name order by edu_id desc) rn from commissioner_education where name is not null) where rn = 1")
def _(t):
    e = t.commissioner_education.where("name is not null").select("name", "institution", "edu_id")
    return mt.last_rows(e, ["name"], F.col("edu_id")).select("name", "institution")


# Cohorts of the test tables in the order in which they are scanned.
COHORTS = ("Delmar I", "Delmar II", "Yorvik", "Halden I", "Halden II")
_SCAN = "coalesce(nullif(list_position([" + ", ".join(f"'{c}'" for c in COHORTS) + "], commission), 0), 6)"
_FIRST_SEEN = f"(select * from (select *, row_number() over (partition by name order by {_SCAN}, edu_id) rn from commissioner_education where name is not null) where rn = 1)"


@query("first_cohort", f"select name, commission, edu_id from {_FIRST_SEEN}")
def _(t):
    return ag.first_seen(t.commissioner_education.select("name", "commission", "edu_id"), "name", "commission", COHORTS, "edu_id").select("name", "commission", "edu_id")


@query("education_long", f"""
select e.name, e.commission, e.institution, cast(row_number() over (partition by e.name order by e.edu_id) as int) as place
from commissioner_education e join {_FIRST_SEEN} f on f.name = e.name and f.commission is not distinct from e.commission where e.institution <> ''""")
def _(t):
    """Schools of each person in the cohort first seen, in roster order."""
    e = t.commissioner_education.where("name is not null").select("name", "commission", "institution", "edu_id")
    first = ag.first_seen(e, "name", "commission", COHORTS, "edu_id").select("name", F.struct("commission").alias("first"))
    own = e.join(first, "name").where(F.col("commission").eqNullSafe(F.col("first.commission")) & (F.col("institution") != ""))
    return own.select("name", "commission", "institution", F.row_number().over(Window.partitionBy("name").orderBy("edu_id")).alias("place"))


@query("adjacent_element", """
select rd_id from (select rd_id, sector, lead(sector) over (partition by name order by rd_id) nx from commission_revolving_door where name is not null) where sector = 'Charity' and nx = 'Other'""")
def _(t):
    d = t.commission_revolving_door.where("name is not null").select("rd_id", "name", "sector")
    return mt.adjacent(d, "rd_id", ["name"], "sector", "Charity", "Other").select("rd_id")


@query("order_offset_limit", "select roster_id, name from commission_i_2019_2024 where name is not null order by name, roster_id limit 50 offset 100")
def _(t):
    return t.commission_i_2019_2024.where("name is not null").select("roster_id", "name").orderBy("name", "roster_id").offset(100).limit(50)


# Multi-valued cells

@query("multivalue_collect", """
select name, string_agg(institution, ' || ' order by edu_id) as institutions from commissioner_education where name is not null and institution is not null group by 1""")
def _(t):
    e = t.commissioner_education.where("name is not null and institution is not null")
    return e.groupBy("name").agg(mv.from_list(mv.ordered_list(F.col("institution"), F.col("edu_id")), " || ").alias("institutions"))


@query("distinct_order_preserving", """
select name, string_agg(institution, ' || ' order by first_id) as institutions from
(select name, institution, min(edu_id) as first_id from commissioner_education where name is not null and institution is not null group by 1, 2) group by 1""")
def _(t):
    e = t.commissioner_education.where("name is not null and institution is not null").groupBy("name", "institution").agg(F.min("edu_id").alias("first_id"))
    return e.groupBy("name").agg(mv.from_list(mv.ordered_list(F.col("institution"), F.col("first_id")), " || ").alias("institutions"))


@query("explode_multivalue", """
select x as employer, cast(count(*) as bigint) as n from (select unnest(string_split(employers, ' || ')) as x from commission_i_2019_2024) where x <> '' group by 1""")
def _(t):
    items = mv.explode_list(t.commission_i_2019_2024.select("employers"), "employers", " || ", val="employer")
    return ag.value_counts(items, "employer")


@query("positional_zip", """
select roster_id, cast(i as int) as i, coalesce(nullif(list_extract(o, i), ''), '') as occupation, coalesce(nullif(list_extract(e, i), ''), '') as employer
from (select roster_id, list_filter(string_split(coalesce(occupations, ''), ' || '), lambda x: x <> '') as o, list_filter(string_split(coalesce(employers, ''), ' || '), lambda x: x <> '') as e from commission_i_2019_2024),
lateral (select unnest(range(1, greatest(len(o), len(e)) + 1)) as i)""")
def _(t):
    r = t.commission_i_2019_2024.select("roster_id", mv.to_list(F.col("occupations"), " || ").alias("o"), mv.to_list(F.col("employers"), " || ").alias("e"))
    z = r.select("roster_id", F.posexplode(mv.zip_outer("o", "e")).alias("p", "z"))
    return z.select("roster_id", (F.col("p") + 1).alias("i"), F.col("z.a0").alias("occupation"), F.col("z.a1").alias("employer"))



@query("numbered_items", """
select roster_id, '1. ' || portfolio || ' held in ' || coalesce(birth_place, '') || ' || 2. ' || name as items from commission_i_2019_2024 where portfolio is not null and name is not null""")
def _(t):
    return _decorated(t).select("roster_id", mv.render_items(mv.numbered_items(F.split(tx.section_between(F.col("body"), "A", r"B"), "\n"))).alias("items"))


def _decorated(t):
    r = t.commission_i_2019_2024.where("portfolio is not null and name is not null")
    body = F.concat(F.lit('(A) "Posts" preamble\n1. '), "portfolio", F.lit("\nheld in "), F.coalesce("birth_place", F.lit("")), F.lit("\n2. "), "name", F.lit('\n(B) "Other" none'))
    return r.select("roster_id", body.alias("body"))


@query("section_extract", """
select roster_id, chr(10) || '1. ' || portfolio || chr(10) as section from commission_i_2019_2024 where portfolio is not null""")
def _(t):
    body = F.concat(F.lit('x (A) "Posts"\n1. '), "portfolio", F.lit('\n(B) "Other" none'))
    return t.commission_i_2019_2024.where("portfolio is not null").select("roster_id", tx.section_between(body, "A", "B").alias("section"))


# Counts and profiles

@query("value_counts", "select sector, cast(count(*) as bigint) as n from commission_revolving_door where sector <> '' group by 1")
def _(t):
    return ag.value_counts(t.commission_revolving_door, "sector")


@query("value_counts_topk", "select institution, cast(count(*) as bigint) as n from commissioner_education where institution <> '' group by 1 order by n desc, institution limit 20")
def _(t):
    return ag.value_counts(t.commissioner_education, "institution", top=20)


@query("group_count_zero_fill", """
select d.country_code, cast(count(b.roster_id) as bigint) as n from (select distinct country_code from reference_names) d
left join (select roster_id, country from commission_barroso_i_2004_2009 where wikidata_id is null) b on b.country = d.country_code group by 1""")
def _(t):
    rows = t.commission_barroso_i_2004_2009.where("wikidata_id is null").select(F.col("country").alias("country_code"))
    return ag.zero_filled_counts(t.reference_names, rows, "country_code")


_COVER = ["wikidata_id", "birth_date", "birth_place", "education", "occupations", "employers", "party_history", "awards", "prev_positions"]


@query("field_coverage", " union all ".join(f"select '{c}' as field, cast(count(nullif({c}, '')) as bigint) as populated, cast(count(*) as bigint) as total from commission_i_2019_2024" for c in _COVER))
def _(t):
    return ag.field_coverage(t.commission_i_2019_2024.select(*_COVER), _COVER)


@query("count_if_positive", "select country_code, cast(count(*) filter (where n_atlanticist_ties > 0) as bigint) as tied from commissioner_appointments group by 1")
def _(t):
    return t.commissioner_appointments.groupBy("country_code").agg(F.count_if(F.col("n_atlanticist_ties") > 0).alias("tied"))


@query("decisions_by_cohort", """
select commission, cast(count(*) as bigint) as decisions, cast(count(distinct nullif(name, '')) as bigint) as persons from commission_revolving_door group by 1""")
def _(t):
    return t.commission_revolving_door.groupBy("commission").agg(F.count(F.lit(1)).alias("decisions"), F.count_distinct(F.nullif("name", F.lit(""))).alias("persons"))


_FLAGS = ["any_elite_institution", "has_phd", "has_law", "has_polsci", "atlanticist_flag"]


@query("cohort_trends", f"""
select r.commission, z.size, {', '.join(f"cast(count(*) filter (where p.{f}) as bigint) as {f}_n, round(100.0 * count(*) filter (where p.{f}) / z.size, 1) as {f}_pct" for f in _FLAGS)}
from commissioner_education r left join {_PEOPLE} p on p.name = r.name
join (select commission, cast(count(*) as bigint) as size from commissioner_education where commission is not null group by 1) z on z.commission = r.commission
where r.name is not null group by r.commission, z.size""")
def _(t):
    """The full roster with its repeats; the size of a cohort, unnamed rows included, is given."""
    rows = t.commissioner_education.where("commission is not null").select("commission", "name")
    sizes = rows.groupBy("commission").agg(F.count(F.lit(1)).alias("size"))
    return ag.cohort_trends(rows.where("name is not null"), people(t, *_FLAGS), "commission", "name", _FLAGS, sizes)


@query("decision_cohort", rf"""
select d.rd_id, try_cast(nullif(regexp_extract(d.date, '\d{{4}}', 0), '') as int) as y, coalesce(p.c, 'Other/Earlier') as cohort from commission_revolving_door d
left join (select upper(name) as k, min(commission) as c from commissioner_appointments where name is not null group by 1) p on p.k = upper(trim(regexp_replace(d.name, '\(.*$', '')))""")
def _(t):
    d = t.commission_revolving_door.select("rd_id", "name", tx.first_year(F.col("date")).alias("y"))
    return mt.cohort_lookup(d, "name", t.commissioner_appointments.select(F.col("name").alias("person"), "commission"), "person", "commission", "cohort").select("rd_id", "y", "cohort")


@query("union_sections", """
select roster_id, 'current' as section, name, null as country from commission_i_2019_2024 union all select roster_id, 'former', name, country from commission_barroso_i_2004_2009""")
def _(t):
    a = t.commission_i_2019_2024.select("roster_id", F.lit("current").alias("section"), "name", F.lit(None).cast("string").alias("country"))
    return a.unionByName(t.commission_barroso_i_2004_2009.select("roster_id", F.lit("former").alias("section"), "name", "country"))


@query("union_cohorts", """
select roster_id, name, portfolio, null as ep_group, birth_date from commission_i_2019_2024 union all select roster_id, name, portfolio, ep_group, birth_date from commission_barroso_i_2004_2009""")
def _(t):
    a = t.commission_barroso_i_2004_2009.select("roster_id", "name", "portfolio", "ep_group", "birth_date")
    return a.unionByName(t.commission_i_2019_2024.select("roster_id", "name", "portfolio", "birth_date"), allowMissingColumns=True)


# Scalar functions

@query("clean_text", r"""
select doc_id, md5(trim(regexp_replace(regexp_replace(text, '\[.*?\]', '', 'g'), '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))) as cleaned_md5 from documents where text is not null""")
def _(t):
    return t.documents.where("text is not null").select("doc_id", F.md5(tx.clean_text(F.col("text"))).alias("cleaned_md5"))


@query("regex_split_party", r"""
select roster_id, regexp_extract(ep_group || '(' || national_party || ')', '^(.*?)\((.+)\)$', 1) as grp, regexp_extract(ep_group || '(' || national_party || ')', '^(.*?)\((.+)\)$', 2) as party
from commission_barroso_i_2004_2009 where ep_group is not null and national_party <> ''""")
def _(t):
    grp, party = tx.split_group_party(F.concat("ep_group", F.lit("("), "national_party", F.lit(")")))
    return t.commission_barroso_i_2004_2009.where("ep_group is not null and national_party <> ''").select("roster_id", grp.alias("grp"), party.alias("party"))


@query("filename_to_name", "select roster_id, trim(name) as name from commission_i_2019_2024 where name is not null")
def _(t):
    file = F.concat(F.lit("DOI-"), "name", F.lit("-EN (2).XML"))
    return t.commission_i_2019_2024.where("name is not null").select("roster_id", tx.filename_to_name(file).alias("name"))


@query("slugify", "select roster_id, replace(url_encode(replace(trim(portfolio), ' ', '_')), '%2F', '/') as slug from commission_i_2019_2024 where portfolio is not null")
def _(t):
    return t.commission_i_2019_2024.where("portfolio is not null").select("roster_id", tx.slugify(F.col("portfolio")).alias("slug"))


@query("interval_string", f"""
select roster_id, case when start_date is not null and end_date is not null then position || ' (' || start_date || ' to ' || end_date || ')' when start_date is not null then position || ' (from ' || start_date || ')' else position end as item
from {_STATEMENTS_SQL}""")
def _(t):
    return statements(t).select("roster_id", tl.render_interval(F.col("position"), F.col("start_date"), F.col("end_date")).alias("item"))


@query("latest_position", rf"""
select roster_id, position, coalesce(end_date, start_date, '') as date from (
 select *, row_number() over (partition by roster_id order by coalesce(end_date, start_date, '') desc, o) rn from
 (select roster_id, o, position, start_date, end_date, item from (
   select roster_id, x as item, o, case when regexp_matches(x, '^(.*) \((?:from )?(\d{{4}}-\d{{2}}-\d{{2}})(?: to (\d{{4}}-\d{{2}}-\d{{2}}))?\)$') then regexp_extract(x, '^(.*) \((?:from )?(\d{{4}}-\d{{2}}-\d{{2}})(?: to (\d{{4}}-\d{{2}}-\d{{2}}))?\)$', 1) else x end as position,
   nullif(regexp_extract(x, '^(.*) \((?:from )?(\d{{4}}-\d{{2}}-\d{{2}})(?: to (\d{{4}}-\d{{2}}-\d{{2}}))?\)$', 2), '') as start_date,
   nullif(regexp_extract(x, '^(.*) \((?:from )?(\d{{4}}-\d{{2}}-\d{{2}})(?: to (\d{{4}}-\d{{2}}-\d{{2}}))?\)$', 3), '') as end_date
   from (select roster_id, unnest(string_split(coalesce(prev_positions, ''), ' || ')) as x, generate_subscripts(string_split(coalesce(prev_positions, ''), ' || '), 1) as o from commission_i_2019_2024) where x <> '') where not contains(lower(item), 'commission'))) where rn = 1""")
def _(t):
    best = tl.latest_position(mv.to_list(F.col("prev_positions"), " || "))
    return t.commission_i_2019_2024.select("roster_id", best.alias("b")).where("b is not null").select("roster_id", "b.position", "b.date")


@query("iso_date_prefix", "select edu_id, substr(cast(observed_at as varchar), 1, 10) as d from commissioner_education where observed_at is not null")
def _(t):
    return t.commissioner_education.where("observed_at is not null").select("edu_id", tx.iso_date_prefix(F.col("observed_at").cast("string")).alias("d"))


@query("date_year_parse", r"select rd_id, try_cast(nullif(regexp_extract(date, '\d{4}', 0), '') as int) as y from commission_revolving_door")
def _(t):
    return t.commission_revolving_door.select("rd_id", tx.first_year(F.col("date")).alias("y"))


@query("url_last_segment", "select rd_id, string_split(decision, '/')[-1] as seg from commission_revolving_door")
def _(t):
    return t.commission_revolving_door.select("rd_id", tx.url_last_segment(F.col("decision")).alias("seg"))


@query("md5_key", "select rd_id, md5(occupation) as k from commission_revolving_door")
def _(t):
    return t.commission_revolving_door.select("rd_id", F.md5("occupation").alias("k"))


@query("exclude_sentinels", "select edu_id, institution from commissioner_education where institution not in ('', 'NOT APPLICABLE', 'YES', 'NO', 'N/A')")
def _(t):
    return t.commissioner_education.where(~F.col("institution").isin("", "NOT APPLICABLE", "YES", "NO", "N/A")).select("edu_id", "institution")


@query("fallback_coalesce", "select roster_id, coalesce(name_wd, name) as shown from commission_barroso_i_2004_2009")
def _(t):
    return t.commission_barroso_i_2004_2009.select("roster_id", F.coalesce("name_wd", "name").alias("shown"))


def _rules_sql(rules, column):
    arms = " ".join("when " + " or ".join(f"contains({column}, '{k.replace(chr(39), chr(39) * 2)}')" for k in r.keywords) + f" then '{r.label.replace(chr(39), chr(39) * 2)}'" for r in rules)
    return f"case {arms} else 'Other' end"


@query("rule_classifier", f"select rd_id, {_rules_sql(classify.SECTOR_RULES, 'lower(coalesce(occupation, ' + chr(39) * 2 + '))')} as sector from commission_revolving_door")
def _(t):
    return t.commission_revolving_door.select("rd_id", classify.first_match(F.col("occupation"), classify.SECTOR_RULES).alias("sector"))


@query("role_classifier", f"select appt_id, {_rules_sql(classify.ROLE_RULES, 'lower(coalesce(prior_position, ' + chr(39) * 2 + '))')} as role from commissioner_appointments")
def _(t):
    return t.commissioner_appointments.select("appt_id", classify.first_match(F.col("prior_position"), classify.ROLE_RULES).alias("role"))


def _pages(t):
    r = t.commission_barroso_i_2004_2009.where("name is not null")
    return r.select("roster_id", F.expr(f"concat('<html><!-- ', coalesce(country, ''), ' --><h1> ', name, ' </h1><a href=\"/doc/', roster_id, '.pdf\">cv</a></html>')").alias("html"))


@query("html_strip_comments", "select roster_id, '<html><h1> '||name||' </h1><a href=\"/doc/'||roster_id||'.pdf\">cv</a></html>' as html from commission_barroso_i_2004_2009 where name is not null")
def _(t):
    return _pages(t).select("roster_id", tx.strip_html_comments(F.col("html")).alias("html"))


@query("html_text", "select roster_id, trim(name) || 'cv' as txt from commission_barroso_i_2004_2009 where name is not null")
def _(t):
    return _pages(t).select("roster_id", tx.html_text(F.col("html")).alias("txt"))


@query("first_link", "select roster_id, '/doc/' || roster_id || '.pdf' as link from commission_barroso_i_2004_2009 where name is not null")
def _(t):
    return _pages(t).select("roster_id", tx.first_link(F.col("html"), r"\.pdf").alias("link"))


@query("positional_cells", "select cv_id, coalesce(list_extract(c, 1), '') as c1, coalesce(list_extract(c, 3), '') as c3 from (select cv_id, list_filter(string_split(coalesce(education, ''), ' || '), lambda x: x <> '') as c from cjeu_cv_data) where len(c) >= 2")
def _(t):
    c = mv.to_list(F.col("education"), " || ")
    cell = lambda i: F.coalesce(F.try_element_at(c, F.lit(i)), F.lit(""))
    return t.cjeu_cv_data.where(F.size(c) >= 2).select("cv_id", cell(1).alias("c1"), cell(3).alias("c3"))


@query("schema_variant_projection", "select cv_id, case when court = 'CJ' then coalesce(list_extract(c, 1), '') else coalesce(list_extract(c, 2), '') end as picked from (select cv_id, court, list_filter(string_split(coalesce(education, ''), ' || '), lambda x: x <> '') as c from cjeu_cv_data)")
def _(t):
    c = mv.to_list(F.col("education"), " || ")
    cell = lambda i: F.coalesce(F.try_element_at(c, F.lit(i)), F.lit(""))
    return t.cjeu_cv_data.select("cv_id", F.when(F.col("court") == "CJ", cell(1)).otherwise(cell(2)).alias("picked"))


@query("json_nested_get", "select event_id, coalesce(json_extract_string(props, '$.k'), '') as k from events")
def _(t):
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"))


@query("error_side_output", """
select case when born_year is null or trim(born_year) = '' then 'missing' when try_cast(born_year as int) is null then 'bad' else 'ok' end as status, cast(count(*) as bigint) as n from cjeu_members_raw group by 1""")
def _(t):
    y = F.col("born_year")
    status = F.when(y.isNull() | (F.trim(y) == ""), "missing").when(F.trim(y).try_cast("int").isNull(), "bad").otherwise("ok")
    return t.cjeu_members_raw.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("education_profile", """
select name, coalesce(string_agg(distinct institution_norm, ' | ' order by institution_norm) filter (where institution_norm <> '' and not (institution_norm like '%degree' or institution_norm in ('PhD/Doctorate', 'MBA'))), '') as named,
 coalesce(string_agg(distinct institution_norm, ' | ' order by institution_norm) filter (where institution_norm like '%degree' or institution_norm in ('PhD/Doctorate', 'MBA')), '') as degrees
from commissioner_education where name is not null group by 1""")
def _(t):
    degree = F.col("institution_norm").endswith("degree") | F.col("institution_norm").isin("PhD/Doctorate", "MBA")
    side = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("institution_norm")))), " | ")
    return t.commissioner_education.where("name is not null").groupBy("name").agg(side(~degree & (F.col("institution_norm") != "")).alias("named"), side(degree).alias("degrees"))


@query("court_roster_join", """
select m.raw_id, m.name, c.wikidata_id, w.pages from cjeu_members_raw m
left join (select name, min(wikidata_id) as wikidata_id from cjeu_cv_data where wikidata_id <> '' group by 1) c on c.name = m.name
left join (select wikidata_id, string_agg(distinct x, ' | ' order by x) as pages from (select wikidata_id, unnest(string_split(page_memberships, ' | ')) as x from cjeu_cv_data where wikidata_id <> '' and page_memberships <> '') where x <> '' group by 1) w
 on w.wikidata_id = c.wikidata_id""")
def _(t):
    """Roster with the id of its CV, and by that id the memberships of the web pages."""
    cv = t.cjeu_cv_data.where("wikidata_id <> ''")
    ids = cv.groupBy("name").agg(F.min("wikidata_id").alias("wikidata_id"))
    pages = mv.explode_list(cv.select("wikidata_id", "page_memberships"), "page_memberships", " | ", val="x").select("wikidata_id", "x").distinct()
    pages = pages.groupBy("wikidata_id").agg(F.array_join(F.array_sort(F.collect_list("x")), " | ").alias("pages"))
    return t.cjeu_members_raw.select("raw_id", "name").join(ids, "name", "left").join(pages, "wikidata_id", "left").select("raw_id", "name", "wikidata_id", "pages")


# Education clusters of the test tables' kinds of institution, in order of their names.
CLUSTERS = (("Business", "Business School"), ("Economics", "School of Economics"), ("European", "College of European Studies"), ("State", "National School of Administration"), ("Technical", "Technical University"))


def _cluster_sql(column):
    return " || ".join(f"case when contains({column}, '{word}') then '{label} | ' else '' end" for label, word in CLUSTERS)


@query("education_clusters", f"""
select name, rtrim({_cluster_sql('joined')}, ' |') as clusters, {' or '.join(f"contains(joined, '{w}')" for _, w in CLUSTERS)} as any_elite
from (select name, coalesce(string_agg(institution, ' || ' order by edu_id), '') as joined from commissioner_education where name is not null group by 1)""")
def _(t):
    """Sorted clusters of each person's schools, and whether there is any."""
    e = t.commissioner_education.where("name is not null")
    hit = lambda word: F.coalesce(F.bool_or(F.contains(F.col("institution"), F.lit(word))), F.lit(False))
    flags = e.groupBy("name").agg(*[hit(w).alias(label) for label, w in CLUSTERS])
    clusters = F.array_join(F.array_compact(F.array(*[F.when(F.col(label), label) for label, _ in CLUSTERS])), " | ")
    return flags.select("name", clusters.alias("clusters"), (clusters != "").alias("any_elite"))


@query("institution_normalised", """
select e.edu_id, coalesce(r.short_name, e.institution) as institution_short from commissioner_education e
left join reference_names r on r.canonical_name = e.institution""")
def _(t):
    """A dictionary too large for a literal map: left join on the reference list, identity by default."""
    short = t.reference_names.select(F.col("canonical_name").alias("institution"), "short_name")
    return t.commissioner_education.select("edu_id", "institution").join(short, "institution", "left").select("edu_id", F.coalesce("short_name", "institution").alias("institution_short"))


@query("person_ties_ranked", """
select name, ties, cast(rank() over (order by ties desc) as int) as place from (
 select name, cast(count(distinct x) as bigint) as ties from (select name, unnest(string_split(atlanticist_orgs, ' | ')) as x from commissioner_appointments where name is not null and atlanticist_orgs <> '') where x <> '' group by 1)""")
def _(t):
    a = t.commissioner_appointments.where("name is not null").select("name", "atlanticist_orgs")
    ties = mv.explode_list(a, "atlanticist_orgs", " | ", val="org").groupBy("name").agg(F.count_distinct("org").alias("ties"))
    return ag.ranked(ties, "ties", "place")


# Spellings of organisations that the comparison counts as one.
HARMONISED = {"fdn": "foundation", "soc": "society", "conf": "conference", "assoc": "association", "inst": "institute"}
_LABEL_SQL = "array_to_string(list_transform(string_split(lower(trim(x)), ' '), lambda w: case rtrim(w, '.') " + " ".join(f"when '{a}' then '{b}'" for a, b in HARMONISED.items()) + " else w end), ' ')"


@query("network_comparison", f"""
with roster as (select commission, cast(count(distinct name) as bigint) as size from commissioner_appointments where name is not null and commission is not null group by 1),
 edges as (select commission, name, {_LABEL_SQL} as org from (select commission, name, unnest(string_split(atlanticist_orgs, ' | ')) as x from commissioner_appointments where name is not null and commission is not null and atlanticist_orgs <> '') where x <> '')
select e.commission, coalesce(e.org, 'TOTAL') as org, e.n, round(100.0 * e.n / r.size, 1) as pct from
 (select commission, org, cast(count(distinct name) as bigint) as n from edges group by grouping sets ((commission, org), (commission))) e join roster r using (commission)""")
def _(t):
    """Organisations under one label each, persons and their share of the cohort, with a TOTAL of distinct persons."""
    a = t.commissioner_appointments.where("name is not null and commission is not null").select("commission", "name", "atlanticist_orgs")
    word = lambda w: classify.dict_map(F.rtrim(w, F.lit(".")), HARMONISED)
    one = lambda w: F.when(F.rtrim(w, F.lit(".")).isin(*HARMONISED), word(w)).otherwise(w)
    label = F.array_join(F.transform(F.split(F.lower(F.trim("org")), " "), one), " ")
    edges = mv.explode_list(a, "atlanticist_orgs", " | ", val="org").select("commission", "name", label.alias("org"))
    sizes = a.groupBy("commission").agg(F.count_distinct("name").alias("size"))
    each = edges.groupBy("commission", "org").agg(F.count_distinct("name").alias("n"))
    total = edges.groupBy("commission").agg(F.count_distinct("name").alias("n")).withColumn("org", F.lit("TOTAL"))
    both = each.unionByName(total).join(sizes, "commission")
    return both.select("commission", "org", "n", ag.pct(F.col("n"), F.col("size")).alias("pct"))


@query("org_by_cohort_total", """
select commission, coalesce(x, 'TOTAL') as org, cast(count(distinct name) as bigint) as n from
(select commission, name, unnest(string_split(atlanticist_orgs, ' | ')) as x from commissioner_appointments where name is not null and commission is not null and atlanticist_orgs <> '') where x <> ''
group by grouping sets ((commission, x), (commission))""")
def _(t):
    """Persons per organisation in each cohort and, as TOTAL, over all its organisations."""
    a = t.commissioner_appointments.where("name is not null and commission is not null").select("commission", "name", "atlanticist_orgs")
    edges = mv.explode_list(a, "atlanticist_orgs", " | ", val="org").select("commission", "name", "org")
    each = edges.groupBy("commission", "org").agg(F.count_distinct("name").alias("n"))
    total = edges.groupBy("commission").agg(F.count_distinct("name").alias("n")).withColumn("org", F.lit("TOTAL"))
    return each.unionByName(total)


@query("status_counters", """
select cast(count(*) as bigint) as rows, cast(count(*) filter (where date is null or date = '') as bigint) as no_date,
 cast(count(*) filter (where date <> '' and year is null) as bigint) as no_year, cast(count(*) filter (where coalesce(name, '') = '') as bigint) as no_name from commission_revolving_door""")
def _(t):
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return t.commission_revolving_door.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(blank("date")).alias("no_date"), F.count_if(~blank("date") & F.col("year").isNull()).alias("no_year"), F.count_if(blank("name")).alias("no_name"))


@query("url_query_string", "select roster_id, 'search=' || replace(url_encode(name), '%20', '+') || '&from=' || replace(url_encode(coalesce(birth_place, '')), '%20', '+') as q from commission_i_2019_2024 where name is not null")
def _(t):
    return t.commission_i_2019_2024.where("name is not null").select("roster_id", tx.query_string({"search": F.col("name"), "from": F.coalesce("birth_place", F.lit(""))}).alias("q"))
