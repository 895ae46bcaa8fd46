"""Registry data and coordinates joined onto institutions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import text as X

# Listing slug and a word in the name, each with the registry entry.
REGISTRY_WORDS = (
    ("astana it", "aitu"), ("гумил", "enu"), ("narikbayev", "mnu"), ("сейфулл", "kazatu"), ("медицин", "amu"),
    ("назарбаев", "nu"), ("туран", "tau"), ("esil", "esil"), ("международный университет астан", "aiu"),
    ("хореограф", "balletacademy"), ("искусств", "kaznui"), ("ломоносов", "msu-kz"), ("кулажан", "kutb"),
    ("технологи", "kutb"), ("государственн", "apa"), ("гуманитарный институт", "eagi"),
    ("казпотребсоюз", "keuk-astana"),
)
FILL_IF_EMPTY = ("address", "email", "phone")
OVERWRITE = ("latitude", "longitude", "website", "dormitory", "grants", "directions")


def registry_slug(name, slug=None, slug_map: dict | None = None):
    """Registry entry of a row: by its listing slug if that is known, else by a word in its name."""
    by_name = X.first_rule(F.lower(X.text(name)), REGISTRY_WORDS)
    if slug is None or not slug_map:
        return by_name
    return X.first_rule(slug, [(f"^{k}$", v) for k, v in slug_map.items()], how="rlike", default=by_name)


def enrich_registry(df: DataFrame, registry: DataFrame, key: str = "registry_slug",
                    fill: tuple = FILL_IF_EMPTY, overwrite: tuple = OVERWRITE, bad_site: str | None = "zero.kz") -> DataFrame:
    """Registry values: contact data only where empty, position and flags always."""
    if bad_site and "website" in df.columns:
        df = df.withColumn("website", F.when(~F.contains("website", F.lit(bad_site)), F.col("website")))
    cols = [c for c in (*fill, *overwrite) if c in df.columns and c in registry.columns]
    out = df.join(registry.select(key, *[F.col(c).alias("_r_" + c) for c in cols]), key, "left")
    for c in cols:
        own, other = F.col(c), F.col("_r_" + c)
        flag = df.schema[c].dataType.typeName() == "boolean"
        given = other.isNotNull() if flag else ~X.is_blank(other)
        take = given & (X.is_blank(own) if c in fill else F.lit(True))
        out = out.withColumn(c, F.when(take, other).otherwise(own))
    return out.drop(*["_r_" + c for c in cols])


def apply_results(inst: DataFrame, results: DataFrame) -> DataFrame:
    """Write geocoder results back; ``action`` is applied or kept.

    Only good results with both coordinates count. Of several results for one
    institution the last (highest ``seq``) is written.
    """
    good = results.filter(F.col("ok") & F.col("lat").isNotNull() & F.col("lng").isNotNull())
    last = good.groupBy("institution_id").agg(F.max_by(F.struct("lat", "lng"), "seq").alias("_g"))
    out = inst.join(last, "institution_id", "left")
    return (
        out.withColumn("latitude", F.coalesce("_g.lat", "latitude")).withColumn("longitude", F.coalesce("_g.lng", "longitude"))
        .withColumn("action", F.when(F.col("_g").isNotNull(), "applied").otherwise("kept")).drop("_g")
    )


def apply_stats(inst: DataFrame, results: DataFrame) -> DataFrame:
    """How many results were written and how many were skipped."""
    known = results.join(inst.select("institution_id", F.lit(True).alias("_known")), "institution_id", "left")
    good = F.col("ok") & F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.coalesce("_known", F.lit(False))
    return known.agg(F.count_if(good).alias("applied"), F.count_if(~good | good.isNull()).alias("skipped"))


def resolve_coords(inst: DataFrame, results: DataFrame) -> DataFrame:
    """Final position: geocoder result, else known pin, else the old one if it can be right.

    ``results`` holds at most one row per institution: institution_id, lat, lng, source.
    """
    city = X.city_label(F.col("location"), F.col("address"))
    lat, lng = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    rows = (
        inst.join(results.select("institution_id", "lat", "lng", "source"), "institution_id", "left")
        .withColumn("_pin", G.known_pin(F.col("name"), city))
        .withColumn("_old", (lat != 0) & (lng != 0) & G.in_country(lat, lng) & G.in_city(lat, lng, city)
                    & ~G.is_bad_point(lat, lng, F.col("name")))
    )
    found = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    pinned = F.col("_pin").isNotNull()

    def pick(api, pin, old):
        return F.when(found, api).when(pinned, pin).when(F.col("_old"), old)

    return rows.select(
        "institution_id", pick(F.col("lat"), F.col("_pin.lat"), lat).alias("lat"),
        pick(F.col("lng"), F.col("_pin.lng"), lng).alias("lng"),
        pick(F.col("source"), F.lit("known_pin"), F.lit("existing")).alias("source"),
    ).withColumn("ok", F.col("lat").isNotNull())


def geocode_stats(results: DataFrame) -> DataFrame:
    """Results per provider and the number of different points at five decimals."""
    point = F.struct(F.round("lat", 5), F.round("lng", 5))
    return results.filter("ok").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct(point).alias("points"))
