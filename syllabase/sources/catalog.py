"""Nested catalogue files in, snapshots and exports out."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import text as X
from ..operators import reads as R
from ..schemas import CATALOG_FILE, INSTITUTION_FILE
from .documents import read_documents


def read_catalog(spark: SparkSession, paths, lines: bool = True) -> DataFrame:
    """Institutions of several nested files; rows with an error or without a name are dropped.

    Each file may be an object with an ``institutions`` list or a bare list, one
    document a line, which Spark splits. Files that are one document over several
    lines (``lines=False``) are cut at closing braces and put together by element
    (``read_documents``). ``source_file``, ``source_row`` and ``source_pos`` (in the
    list of that row) name a row's place, the same in each read of the same files.
    """
    if not lines:
        return _usable(_from_documents(spark, paths))
    raw = spark.read.schema(CATALOG_FILE).json(paths)
    # Where a row was read: the part of the file, and a number that grows by one from row to row of that part.
    place = F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")
    raw = raw.select("*", F.col("_metadata.file_path").alias("source_file"), *place)
    names = INSTITUTION_FILE.fieldNames()
    wrapped = raw.filter(F.col("institutions").isNotNull())
    wrapped = wrapped.select(*READ[:3], F.posexplode("institutions").alias("source_pos", "i")).select(*READ, "i.*")
    bare = raw.filter(F.col("institutions").isNull()).withColumn("source_pos", F.lit(0)).select(*READ, *names)
    return _usable(_with_rows(raw, wrapped.unionByName(bare)))


def _usable(rows: DataFrame) -> DataFrame:
    return rows.filter(X.is_blank(F.col("error")) & ~X.is_blank(F.trim("name")))


def _from_documents(spark: SparkSession, paths) -> DataFrame:
    rows = read_documents(spark, paths, CATALOG_FILE, "institutions")
    names = INSTITUTION_FILE.fieldNames()
    listed, number = F.col("in_list"), F.col("source_number")
    place = [F.when(listed, number).otherwise(0).cast("int").alias("source_pos"), F.when(listed, 0).otherwise(number).alias("source_row")]
    single = rows.filter(listed | F.col("institutions").isNull()).select("source_file", *place, *names)
    inner = rows.filter(~listed & F.col("institutions").isNotNull())
    inner = inner.select("source_file", number.alias("source_row"), F.posexplode("institutions").alias("source_pos", "i"))
    return single.unionByName(inner.select("source_file", "source_row", "source_pos", "i.*"))


READ = ["source_file", "_block", "_at", "source_pos"]


def _with_rows(raw: DataFrame, rows: DataFrame) -> DataFrame:
    """``source_row``, the number of the row in its file, however the file was cut: rows of earlier parts and of its own are counted."""
    parts = raw.groupBy("source_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    number = F.col("_before") + F.col("_at") - F.col("_first")
    # one row a part of a file, whatever the rows hold: small beside them, which need not move then
    return rows.join(F.broadcast(parts), ["source_file", "_block"]).withColumn("source_row", number).drop("_block", "_at", "_before", "_first")


def unify_programs(df: DataFrame) -> DataFrame:
    """One shape for both exports: ``institution_id`` and ``programs``."""
    for want, other in (("programs", "specialties"), ("institution_id", "id")):
        if other in df.columns:
            value = F.coalesce(want, other) if want in df.columns else F.col(other)
            df = df.withColumn(want, value).drop(other)
    return df


def first_source(*frames: DataFrame) -> DataFrame:
    """The first frame that has rows; probes one row of each."""
    for frame in frames[:-1]:
        if not frame.isEmpty():
            return frame
    return frames[-1]


def unnest_programs(df: DataFrame, keep: tuple[str, ...] = ("institution_id",)) -> DataFrame:
    """One row per programme with its position; institutions without programmes keep a row."""
    rows = df.select(*keep, F.posexplode_outer("programs").alias("pos", "p"))
    return rows.select(*keep, "pos", "p.*")


def nest_links(inst: DataFrame, link: DataFrame, spec: DataFrame, qual: DataFrame, limit: int = R.NEST_LIMIT) -> DataFrame:
    """Institutions with their links as an array of structs, empty where there are none."""
    rows = R.link_join(link, spec, qual, "qualification_id")
    fields = ["name", "cost", "duration", "qualification_name", "qualification_id"]
    return R.nest(inst, rows, "institution_id", ["specialization_id"], fields, "specialties", limit)


def registry_export(df: DataFrame, location: str = "Астана, Казахстан") -> DataFrame:
    """Registry rows in institution shape, defaults filled."""
    default = lambda col, value: F.when(X.is_blank(F.col(col)), F.lit(value)).otherwise(F.col(col))
    return df.select(
        "slug", "name", F.when(X.is_blank(F.col("notes")), F.col("directions")).otherwise(F.col("notes")).alias("description1"),
        default("location", location).alias("location"), "address", "latitude", "longitude", "website",
        default("type", "university").alias("type"), "directions", default("verified", "pending").alias("verified"),
    )


def coverage(df: DataFrame) -> DataFrame:
    """Totals of a registry: rows, with coordinates, with website."""
    lat, lng, web = (~X.is_blank(F.col(c)) for c in ("latitude", "longitude", "website"))
    return df.agg(
        F.count("*").alias("rows"), F.count_if(lat & lng).alias("with_coords"), F.count_if(web).alias("with_website"),
    )


def missing(df: DataFrame) -> DataFrame:
    """(what, name) for every row that lacks coordinates or a website."""
    part = lambda col, what: df.filter(X.is_blank(F.col(col))).select(F.lit(what).alias("what"), "name")
    return part("latitude", "coords").unionByName(part("website", "website"))


def geocode_worklist(inst: DataFrame) -> DataFrame:
    """Universities to place on the map, with a flag for those without coordinates."""
    return inst.filter("type = 'university'").select(
        "institution_id", "name", "address", "location", "latitude", "longitude",
        G.missing_any(F.col("latitude"), F.col("longitude")).alias("missing"),
    )


def write_snapshot(df: DataFrame, path: str, mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """Write a table to a new folder; readers switch to it once it is complete."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_export(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a nested result as JSON lines."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
