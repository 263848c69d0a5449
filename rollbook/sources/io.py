"""CSV, JSON and XML readers with explicit schemas; a writer that never overwrites what is being read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Columns of the files.
ROSTER = _strings("Name", "Portfolio", "Country", "National_Party", "EP_Group")
CV = _strings("wikidata_id", "name_wd", "term_start", "wikidata_position", "birth_date", "birth_place", "education", "occupations", "employers", "party_history", "awards", "prev_positions")
SPARQL = T.StructType([T.StructField("results", T.StructType([T.StructField("bindings", T.ArrayType(T.MapType(T.StringType(), T.StructType([T.StructField("value", T.StringType())]))))]))])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with doubled quotes; an empty cell reads as ''."""
    df = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def safe_overwrite(df: DataFrame, path: str) -> None:
    """Write beside `path`, move the old table aside, the new one in, then delete the old: `df` may read `path` itself.

    At any moment a whole table is at `path`, `path`.old or `path`.next; one left aside by a crash is put back first.
    """
    spark = df.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in ("", ".next", ".old")]
    here, fresh, old = paths
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old):
        if fs.exists(here):
            fs.delete(old, True)
        elif not fs.rename(old, here):
            raise OSError(f"cannot put back {path}")
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(str(fresh))
    if fs.exists(here) and not fs.rename(here, old):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(fresh, here):
        raise OSError(f"cannot move the new table to {path}")
    fs.delete(old, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_xml_list(spark: SparkSession, path: str, row_tag: str = "mep") -> DataFrame:
    schema = _strings("id", "fullName", "country", "politicalGroup")
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """{group: [person, ...]} -> (item, person)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("item", "persons")).select("item", F.explode("persons").alias("person"))


def sparql_rows(df: DataFrame, json_column: str, variables: list[str]) -> DataFrame:
    """One row per binding; a variable that a binding lacks is ''."""
    rows = df.select(F.explode(F.from_json(json_column, SPARQL)["results"]["bindings"]).alias("b"))
    return rows.select(*[F.coalesce(F.try_element_at("b", F.lit(v))["value"], F.lit("")).alias(v) for v in variables])


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array of objects, one row each; a field that an object lacks is null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def rows_of(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """In-memory rows with declared columns, also for no rows at all."""
    return spark.createDataFrame(rows, schema)


def read_pages(spark: SparkSession, folder: str, json_column: str = "value") -> DataFrame:
    """Landed pages of a paged source (one JSON text a file), in no order; each page's rows come from sparql_rows."""
    return spark.read.text(folder, wholetext=True).withColumnRenamed("value", json_column)


def sample_report(df: DataFrame, order: str, n: int = 5, cuts: dict[str, int] | None = None) -> DataFrame:
    """The first n rows in the given order with the texts of some columns cut for reading."""
    cuts = cuts or {}
    return df.orderBy(order).limit(n).select(*[F.substring(c, 1, cuts[c]).alias(c) if c in cuts else F.col(c) for c in df.columns])
