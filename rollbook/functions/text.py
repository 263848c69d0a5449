"""Text column functions. The patterns are fixed values: they belong to the formats of the sources. Every function takes and returns Column; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_strip(c: Column) -> Column:
    """Trim Unicode white space (NBSP included) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def drop_citations(c: Column) -> Column:
    """Remove bracketed citation marks such as [12]; a mark never spans lines."""
    return F.regexp_replace(c, r"\[.*?\]", "")


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def clean_text(c: Column) -> Column:
    """Citation marks out, white space collapsed, ends trimmed - in this order."""
    return py_strip(collapse_space(drop_citations(c)))


def split_group_party(c: Column) -> tuple[Column, Column]:
    """'GROUP(PARTY)' -> (GROUP, PARTY); text without that shape -> (text, '')."""
    shape = r"^(.*?)\((.+)\)$"
    hit = c.rlike(shape)
    return (
        F.when(hit, py_strip(F.regexp_extract(c, shape, 1))).otherwise(c),
        F.when(hit, py_strip(F.regexp_extract(c, shape, 2))).when(c.isNotNull(), F.lit("")),
    )


def url_last_segment(c: Column) -> Column:
    return F.split_part(c, F.lit("/"), F.lit(-1))


def filename_to_name(c: Column) -> Column:
    """'DOI-Some Name-EN (2).xml' -> 'Some Name'."""
    base = F.regexp_replace(c, r"(?i)\.xml$", "")
    base = F.regexp_replace(base, r"^DOI-", "")
    return py_strip(F.regexp_replace(base, r"-(EN|FR|DE)\s*(\(\d+\))?$", ""))


def section_between(c: Column, opening: str, closing: str) -> Column:
    """Text after `(opening) "title"` up to `(closing)` or the end; '' when the section is absent."""
    return F.regexp_extract(c, rf'(?is)\({opening}\)\s"[^"]*"(.*?)(?=\({closing}\)|$)', 1)


def iso_date_prefix(c: Column) -> Column:
    return F.substring(c, 1, 10)


def first_year(c: Column) -> Column:
    """First run of four digits as an int; null when there is none."""
    return F.nullif(F.regexp_extract(c, r"\d{4}", 0), F.lit("")).try_cast("int")


def slugify(c: Column) -> Column:
    """Words percent-encoded and joined by '_'; the slash stays as it is."""
    words = F.split(py_strip(c), r"(?U)\s+")
    encoded = lambda w: F.replace(F.replace(F.replace(F.url_encode(w), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.array_join(F.transform(words, encoded), "_")


def query_string(fields: dict[str, Column]) -> Column:
    """name=value pairs as a form sends them: a blank is '+', a missing value ''."""
    pairs = [F.concat(F.lit(f"{k}="), F.replace(F.replace(F.url_encode(F.coalesce(v, F.lit(""))), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))) for k, v in fields.items()]
    return F.concat_ws("&", *pairs)


def decode_utf8(c: Column) -> Column:
    """Text of landed bytes; null where they are not valid UTF-8."""
    return F.when(F.is_valid_utf8(c.cast("string")), F.decode(c, "UTF-8"))


def strip_html_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


def html_text(c: Column) -> Column:
    """Text nodes without tags, each node trimmed, joined without separator."""
    nodes = F.split(F.regexp_replace(strip_html_comments(c), r"(?s)<[^>]*>", "\u0001"), "\u0001")
    return F.array_join(F.transform(nodes, py_strip), "")


def first_link(c: Column, suffix: str) -> Column:
    """First href whose target ends with `suffix`; '' when none does."""
    return F.regexp_extract(c, rf'href="([^"]*{suffix})"', 1)


def first_url(c: Column, mark: str, suffix: str) -> Column:
    """First absolute URL anywhere in the text that holds `mark` and then runs up to `suffix`; '' when there is none."""
    return F.regexp_extract(c, rf'https?://[^"]*{mark}[^"]*{suffix}', 0)


def year_of_text(c: Column) -> Column:
    return F.substring(c, 1, 4).try_cast("int")
