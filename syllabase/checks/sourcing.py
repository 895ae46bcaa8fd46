"""Nested files, registry, worklists and table scans."""
from pyspark.sql import functions as F

from ..operators import reads as R
from ..session import shared_folder
from ..sources import catalog as C
from .registry import query


def nested(t, into="specialties"):
    rows = t.program.select("institution_id", "pos", "name", "code", F.col("cost").cast("string").alias("cost"))
    return R.nest(t.uni.select("institution_id"), rows, "institution_id", ["pos"], ["name", "code", "cost"], into)


@query("s1_read_catalog", """
SELECT i.institution_id, i.name, i.type, p.name AS program, p.code, CAST(p.cost AS DOUBLE) AS cost FROM {uni} i LEFT JOIN {program} p USING (institution_id) WHERE i.website IS NOT NULL""")
def _(t):
    """Institutions written as JSON lines and read back; rows with an error leave."""
    rows = nested(t).join(t.uni.select("institution_id", "name", "type", "website"), "institution_id")
    rows = rows.withColumn("error", F.when(F.col("website").isNull(), F.lit("no_website")))
    folder = shared_folder(t.spark)
    C.write_export(rows, folder)
    back = C.unify_programs(C.read_catalog(t.spark, folder, lines=True)).select("institution_id", F.col("name").alias("owner"), "type", "programs")
    flat = C.unnest_programs(back, keep=("institution_id", "owner", "type"))
    return flat.select("institution_id", F.col("owner").alias("name"), "type", F.col("name").alias("program"), "code", F.col("cost").cast("double").alias("cost"))


@query("s8_write_snapshot", "SELECT institution_id, specialization_id, cost, duration, created_at FROM {link}")
def _(t):
    folder = shared_folder(t.spark)
    C.write_snapshot(t.link, folder)
    return t.spark.read.parquet(folder)


@query("s2_unify_programs", "SELECT i.institution_id, COUNT(p.pos) AS n FROM {uni} i LEFT JOIN {program} p USING (institution_id) GROUP BY 1")
def _(t):
    split = nested(t).withColumnRenamed("institution_id", "id")
    half = F.col("id") % 2 == 0
    mixed = split.withColumn("programs", F.when(half, F.col("specialties"))).withColumn("specialties", F.when(~half, F.col("specialties")))
    return C.unify_programs(mixed).groupBy("institution_id").agg(F.sum(F.size("programs")).alias("n"))


@query("s3_unnest_programs", """
SELECT i.institution_id, p.pos AS ord, p.name, p.code FROM {uni} i LEFT JOIN {program} p USING (institution_id)""")
def _(t):
    renamed = F.transform("programs", lambda s: s.withField("ord", s["pos"]).dropFields("pos"))
    rows = C.unnest_programs(C.unify_programs(nested(t)).withColumn("programs", renamed))
    return rows.select("institution_id", "ord", "name", "code")


@query("s4_nest_links", """
SELECT i.institution_id, i.website, l.specialization_id, s.name, l.cost, l.duration, q.qualification_name
FROM {institution} i LEFT JOIN {link} l USING (institution_id) LEFT JOIN {spec} s USING (specialization_id) LEFT JOIN {qual} q USING (qualification_id)""")
def _(t):
    out = C.nest_links(t.institution.select("institution_id", "website"), t.link, t.spec, t.qual)
    rows = out.select("institution_id", "website", F.explode_outer("specialties").alias("s"))
    return rows.select("institution_id", "website", "s.specialization_id", "s.name", "s.cost", "s.duration", "s.qualification_name")


REGISTRY = """SELECT concat('u', CAST(institution_id AS STRING)) AS slug, name, CASE WHEN institution_id % 3 = 0 THEN concat('note ', name) WHEN institution_id % 3 = 1 THEN '' END AS notes,
 CASE WHEN institution_id % 2 = 0 THEN 'it, law' END AS directions, CASE WHEN institution_id % 4 = 0 THEN location END AS location, address, latitude, longitude, website,
 CASE WHEN institution_id % 5 = 0 THEN '' ELSE type END AS type, CASE WHEN institution_id % 6 = 0 THEN 'accepted' END AS verified FROM {uni}"""


@query("s5_registry_export", f"""
SELECT slug, name, COALESCE(NULLIF(notes, ''), directions) AS description1, COALESCE(location, 'Астана, Казахстан') AS location, address, latitude, longitude, website,
 COALESCE(NULLIF(type, ''), 'university') AS type, directions, COALESCE(verified, 'pending') AS verified FROM ({REGISTRY})""")
def _(t):
    return C.registry_export(t.sql(REGISTRY))


@query("s5_coverage", f"""
SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE COALESCE(latitude, 0) <> 0 AND COALESCE(longitude, 0) <> 0) AS with_coords, COUNT(website) AS with_website FROM ({REGISTRY})""")
def _(t):
    return C.coverage(C.registry_export(t.sql(REGISTRY)))


@query("s5_missing", f"""
SELECT 'coords' AS what, name FROM ({REGISTRY}) WHERE COALESCE(latitude, 0) = 0 UNION ALL SELECT 'website', name FROM ({REGISTRY}) WHERE website IS NULL""")
def _(t):
    return C.missing(C.registry_export(t.sql(REGISTRY)))


@query("s6_geocode_worklist", """
SELECT institution_id, name, address, location, latitude, longitude, COALESCE(latitude, 0) = 0 OR COALESCE(longitude, 0) = 0 AS missing FROM {uni} WHERE type = 'university'""")
def _(t):
    return C.geocode_worklist(t.uni)


@query("s7_table_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def _(t):
    return t.orders.filter("o_orderdate >= TIMESTAMP_NTZ'1998-01-01'").select("o_orderkey", "o_custkey", "o_totalprice")
