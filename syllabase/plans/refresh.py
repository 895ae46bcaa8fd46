"""Catalogue jobs from files to audited links, as one chain of frames."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import maintain as M
from ..operators import matching
from ..operators import places
from ..operators import programs as P
from ..operators import quality as Q
from ..operators.ordered import numbered
from ..session import checkpoint, discard
from ..sources import catalog as C


def keyed_rows(rows: DataFrame) -> DataFrame:
    """Institution rows of nested files with ``incoming_id``: file, row and place in the row's list.

    Two rows never share it, whatever they hold, and a second read gives the same. It sorts as the rows stand in the files.
    """
    digits = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    key = F.concat_ws("#", "source_file", digits("source_row", 15), digits("source_pos", 10))
    return C.unify_programs(rows).withColumn("incoming_id", key)


def new_ids(matches: DataFrame, existing: DataFrame) -> DataFrame:
    """(new_key, new_id): ids of the institutions to be made, counted on from the largest there is, in the order of their keys."""
    fresh = matches.filter("new_key IS NOT NULL").select("new_key").distinct().withColumn("_all", F.lit(0))
    last = existing.agg(F.max("institution_id")).first()[0] or 0
    return numbered(fresh, "_all", ["new_key"], "n").select("new_key", (F.col("n") + last + 1).alias("new_id"))


def empty_tree(spark) -> tuple[DataFrame, DataFrame, DataFrame]:
    make = lambda schema: spark.createDataFrame([], schema)
    return (
        make("global_id bigint, global_name string, description string"),
        make("qualification_id bigint, global_id bigint, qualification_name string, description string"),
        make("specialization_id bigint, qualification_id bigint, name string"),
    )


def rebuild_catalog(incoming: DataFrame, programs: DataFrame, existing: DataFrame, strict: bool = False) -> dict[str, DataFrame]:
    """Tree and links from nothing; institutions are matched with the existing ones.

    incoming: incoming_id, name, type, location, website. programs: incoming_id,
    pos, name, global_specialty, code, cost, duration. Institutions without a
    match that share a ``new_key`` get one new id. Returns the tree levels,
    ``links``, ``matches`` (with ``new_id``) and ``placed``.
    """
    matches = checkpoint(matching.match_cascade(incoming, existing, strict))
    matches = checkpoint(matches.join(new_ids(matches, existing), "new_key", "left"))
    owner = matches.select("incoming_id", F.coalesce("institution_id", "new_id").alias("institution_id"))
    rows = programs.withColumn("ord", F.struct("incoming_id", "pos")).join(owner, "incoming_id")
    levels = empty_tree(programs.sparkSession)
    tree, offers = M.place_programs(rows.select("ord", "institution_id", "cost", "duration", "name", "global_specialty", "code"), *levels)
    none = programs.sparkSession.createDataFrame(
        [], "institution_id bigint, specialization_id bigint, cost double, duration int"
    )
    return {**tree, "links": M.upsert_links(none, offers), "matches": matches}


def rebuild_from_files(spark, paths, existing: DataFrame, lines: bool = True) -> dict[str, DataFrame]:
    rows = keyed_rows(C.read_catalog(spark, paths, lines))
    programs = C.unnest_programs(rows, keep=("incoming_id",)).filter("name IS NOT NULL")
    return rebuild_catalog(rows, programs, existing)


def card_programs(institutions: DataFrame, listing: DataFrame, listing_programs: DataFrame, official: DataFrame,
                  by_id: DataFrame, name_rules: DataFrame) -> DataFrame:
    """Final programmes per institution: best listing match, official rows, price rules, one row each.

    listing: right_id, name, location; listing_programs: right_id, pos and the
    programme columns; official: institution_id, pos and the programme columns.
    """
    left = institutions.select(F.col("institution_id").alias("left_id"), "name", "location")
    best = checkpoint(matching.best_match(left, listing))
    owned = best.select(F.col("left_id").alias("institution_id"), "right_id")
    base = listing_programs.filter(F.length(F.trim("name")) >= 3).join(owned, "right_id").drop("right_id")
    base = base.withColumn("source", F.lit("listing"))
    extra = P.gate_official(official).withColumn("source", F.lit("official"))
    merged = checkpoint(P.merge_programs(base, extra))
    used = ["institution_id", "pos", "name", "code", "global_specialty", "qualification", "cost", "duration"]
    priced = checkpoint(P.apply_overrides(merged, by_id, name_rules).select(*used))
    discard(merged)
    out = checkpoint(P.dedupe_programs(priced))
    discard(best, priced)
    return out


def refresh(institutions: DataFrame, registry: DataFrame, **sources) -> dict[str, DataFrame]:
    """Enriched institutions, final programmes, their tree and links, and the audit."""
    named = institutions.withColumn("registry_slug", places.registry_slug(F.col("name")))
    enriched = places.enrich_registry(named, registry)
    programs = card_programs(enriched, **sources)
    rows = programs.withColumn("ord", F.struct("institution_id", "pos"))
    tree = M.upsert_tree(rows.select("ord", "name", "global_specialty", "code"), *empty_tree(programs.sparkSession))
    roots = M.duplicate_roots(enriched)
    offers = rows.select("ord", "institution_id", "cost", "duration").join(tree["placed"], "ord")
    links = M.merge_links(offers.drop("ord"), roots)
    return {
        **tree, "institutions": M.merge_institutions(enriched, roots), "programs": programs, "links": links,
        "audit": Q.audit(enriched.select("institution_id", "name"), programs),
    }
