"""Upserts, merges, purges and repairs of the catalogue as set-based plans.

Every job returns frames with an ``action`` column where rows change, so a dry
run is the frame before it is written.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..functions.plan import spread
from ..session import checkpoint
from . import reads as R
from .graph import components, star_edges

# Words in a name or website that mark the same university.
SAME_GROUP = (
    ("международный университет астан",), ("университет обороны",), ("астана it", "astana it"), ("гумил",),
    ("назарбаев",), ("туран-астана", "туран астана", "«туран-астана»"), ("сейфулл",),
    ("медицинский университет астана",), ("технолог", "кулажан"), ("ломоносов",), ("хореограф",),
    ("национальный университет искусств", "казнуи"),
)
# The one explicit pair, (words in the name, words in the website), and what the kept row becomes.
PAIR = ((("казгюу",), ("kazguu",)), (("narikbayev", "maqsut"), ("mnu.kz",)))
PAIR_ATTRIBUTES = {"name": "Maqsut Narikbayev University (КАЗГЮУ)", "website": "https://mnu.kz/ru"}
FILL_FIELDS = ("description1", "description2", "description3", "location", "address", "email", "phone", "website",
               "logo_url", "photo_url", "directions", "latitude", "longitude")


# ---- M1: programme tree ------------------------------------------------------

def placed_programs(programs: DataFrame) -> DataFrame:
    """Programme rows with the natural keys of the three levels; too short names leave."""
    name = F.trim(F.regexp_replace(X.text(F.col("name")), r"(?U)\s+", " "))
    group = F.trim(F.regexp_replace(X.text(F.col("global_specialty")), r"(?U)\s+", " "))
    return (
        programs.withColumn("program_name", name).filter(F.length(name) >= 2)
        .withColumn("global_name", F.coalesce(F.nullif(group, F.lit("")), F.lit(X.DEFAULT_GROUP)))
        .withColumn("code", X.normalize_code(F.col("code")))
        .withColumn("qual_name", F.concat_ws(" · ", "code", "global_name"))
    )


def upsert_tree(programs: DataFrame, level1: DataFrame, level2: DataFrame, level3: DataFrame) -> dict[str, DataFrame]:
    """Find or create the three levels for programme rows (ord, name, global_specialty, code).

    level1: global_id, global_name, description; level2: qualification_id,
    global_id, qualification_name, description; level3: specialization_id,
    qualification_id, name. New ids are hashes of the natural key, so a rerun
    gives the same ids and no global numbering is needed. Returns the levels with
    ``action`` (kept, updated, created) and ``placed``: ord -> specialization_id, with the other columns of ``programs``.
    """
    rows = placed_programs(programs)
    others = [c for c in programs.columns if c not in ("ord", "name", "global_specialty", "code")]

    # Level 1: the description names the code of the last row seen.
    wanted1 = rows.groupBy("global_name").agg(F.max_by("code", F.when(F.col("code").isNotNull(), F.col("ord"))).alias("code"))
    note = F.concat(F.lit("Код: "), "code")
    out1 = level1.join(wanted1.withColumn("_in", F.lit(True)), "global_name", "full")
    fresh = F.col("global_id").isNull()
    stale = F.col("code").isNotNull() & ~F.contains(F.coalesce("description", F.lit("")), F.col("code"))
    out1 = out1.select(
        F.coalesce("global_id", F.xxhash64("global_name")).alias("global_id"), "global_name",
        F.when(fresh | stale, note).otherwise(F.col("description")).alias("description"),
        F.when(fresh, "created").when(stale, "updated").otherwise("kept").alias("action"),
    )
    rows = rows.join(out1.select("global_name", "global_id"), "global_name")

    # Level 2: a row with a code is the same under its name, its first word or its description.
    first_word = F.when(F.contains("qualification_name", F.lit(" ")), F.split_part("qualification_name", F.lit(" "), F.lit(1)))
    by_code = (
        level2.select("global_id", "qualification_id", F.explode(F.array_compact(F.array_distinct(
            F.array("qualification_name", "description", first_word)))).alias("code"))
        .groupBy("global_id", "code").agg(F.min("qualification_id").alias("known_code"))
    )
    by_name = level2.groupBy("global_id", F.col("qualification_name").alias("qual_name")).agg(
        F.min("qualification_id").alias("known_name")
    )
    rows = (
        rows.join(by_code, ["global_id", "code"], "left").join(by_name, ["global_id", "qual_name"], "left")
        .withColumn("known2", F.coalesce("known_code", "known_name"))
        .withColumn("qualification_id", F.coalesce("known2", F.xxhash64("global_id", "qual_name")))
    )
    touched = rows.filter("known2 IS NOT NULL AND code IS NOT NULL").groupBy("qualification_id").agg(
        F.max_by(F.struct("code", "qual_name"), "ord").alias("last")
    )
    renew = F.col("last").isNotNull() & ~F.col("description").eqNullSafe(F.col("last.code"))
    old2 = level2.join(touched, "qualification_id", "left").select(
        "qualification_id", "global_id",
        F.when(renew, F.col("last.qual_name")).otherwise(F.col("qualification_name")).alias("qualification_name"),
        F.when(renew, F.col("last.code")).otherwise(F.col("description")).alias("description"),
        F.when(renew, "updated").otherwise("kept").alias("action"),
    )
    new2 = rows.filter("known2 IS NULL").groupBy("qualification_id", "global_id").agg(
        F.min("qual_name").alias("qualification_name"), F.min("code").alias("description")
    ).withColumn("action", F.lit("created"))

    # Level 3.
    known3 = level3.groupBy("qualification_id", F.col("name").alias("program_name")).agg(
        F.min("specialization_id").alias("known3")
    )
    rows = rows.join(known3, ["qualification_id", "program_name"], "left").withColumn(
        "specialization_id", F.coalesce("known3", F.xxhash64("qualification_id", "program_name"))
    )
    new3 = rows.filter("known3 IS NULL").groupBy("specialization_id", "qualification_id").agg(
        F.min("program_name").alias("name")
    ).withColumn("action", F.lit("created"))
    old3 = level3.select("specialization_id", "qualification_id", "name").withColumn("action", F.lit("kept"))
    return {
        "level1": out1, "level2": old2.unionByName(new2), "level3": old3.unionByName(new3),
        "placed": rows.select("ord", "specialization_id", *others),
    }


def place_programs(rows: DataFrame, *levels: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tree, rows with specialization_id) of many rows: ``upsert_tree`` over the distinct texts, each with the last ``ord`` it has.

    Levels depend on nothing else, so each text is cleaned once; the rows are read twice, to find their texts and to meet the tree.
    """
    texts = ["name", "global_specialty", "code"]
    kinds = rows.groupBy(*texts).agg(F.max("ord").alias("ord"))
    kinds = checkpoint(kinds.select("*", *[F.col(c).alias("_" + c) for c in texts]))
    tree = upsert_tree(spread(kinds), *levels)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col("_" + c)) for c in texts])
    placed = rows.join(tree["placed"].drop("ord"), same).drop(*["_" + c for c in texts])
    return {**tree, "placed": placed.select("ord", "specialization_id")}, placed


# ---- M2: links ------------------------------------------------------------------

def upsert_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links after offers arrive: a new value replaces the old one, an empty one does not.

    ``new``: ord, institution_id, specialization_id, cost, duration. Of several
    offers for one link the last value that is given counts.
    """
    key = ["institution_id", "specialization_id"]
    cost, years = V.normalize_cost(F.col("cost")), V.normalize_duration(F.col("duration"))
    offers = new.withColumn("c", cost).withColumn("d", years).groupBy(*key).agg(
        F.max_by("c", F.when(F.col("c").isNotNull(), F.col("ord"))).alias("new_cost"),
        F.max_by("d", F.when(F.col("d").isNotNull(), F.col("ord"))).alias("new_duration"),
    ).withColumn("_new", F.lit(True))
    out = links.select(*key, "cost", "duration").withColumn("_old", F.lit(True)).join(offers, key, "full")
    return out.select(
        *key, F.coalesce("new_cost", "cost").alias("cost"), F.coalesce("new_duration", "duration").alias("duration"),
        F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "kept").otherwise("updated").alias("action"),
    )


def change_stats(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("n"))


# ---- M3: duplicates ---------------------------------------------------------------

def _fits(words, sites) -> Column:
    name, web = F.lower(X.text(F.col("name"))), F.lower(X.text(F.col("website")))
    return X.has(name, *words) | X.has(web, *sites)


def duplicate_roots(inst: DataFrame, groups=SAME_GROUP, pair=PAIR) -> DataFrame:
    """(node, root) of universities that share a marker word, the explicit pair, or a website host."""
    unis = inst.filter("type = 'university'")
    marks = [F.when(_fits(words, words), F.lit(f"g:{i}")) for i, words in enumerate(groups)]
    host = F.concat(F.lit("h:"), X.website_host(F.col("website")))
    keyed = unis.select("institution_id", F.explode(F.array_compact(F.array(*marks, host))).alias("key"))
    edges = star_edges(keyed, "key", "institution_id")
    if pair:
        ends = unis.agg(*[F.min(F.when(_fits(*side), F.col("institution_id"))).alias(c) for c, side in zip("uv", pair)])
        edges = edges.unionByName(ends.filter("u <> v"))
    return components(edges)


def remap(fact: DataFrame, roots: DataFrame, unique: list[str] | None = None) -> DataFrame:
    """Point a fact table at the kept rows. Of rows that would break a unique key one stays: the kept side's own, else the one
    of the lowest old id, ties by the other columns."""
    out = fact.withColumn("_old", F.col("institution_id")).join(roots.withColumnRenamed("node", "institution_id"), "institution_id", "left")
    out = out.withColumn("institution_id", F.coalesce("root", "institution_id")).drop("root")
    if not unique:
        return out.drop("_old")
    rest = [c for c in fact.columns if c not in unique]
    best = F.min(F.struct((F.col("_old") != F.col("institution_id")).alias("_moved"), "_old", *rest)).alias("_best")
    return out.groupBy(*unique).agg(best).select(*[F.col(f"_best.{c}").alias(c) if c in rest else c for c in fact.columns])


def merge_links(link: DataFrame, roots: DataFrame) -> DataFrame:
    """Links of merged rows: the kept row's price and term first, then the others by id."""
    moved = link.withColumn("source_id", F.col("institution_id"))
    moved = remap(moved, roots)
    # The root has the lowest id of its group, so id order is keep-side first.
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("source_id"))).alias(c)
    return moved.groupBy("institution_id", "specialization_id").agg(first("cost"), first("duration"))


def merge_institutions(inst: DataFrame, roots: DataFrame, pair=PAIR, forced: dict = PAIR_ATTRIBUTES,
                       flags: tuple = ("dormitory", "grants")) -> DataFrame:
    """Kept rows with empty fields filled from their duplicates in id order and flags OR-ed."""
    rows = inst.join(roots.withColumnRenamed("node", "institution_id"), "institution_id", "left")
    rows = rows.withColumn("root", F.coalesce("root", "institution_id"))
    uni = F.col("type") == "university"
    sides = [F.max(uni & _fits(*side)).alias(f"_p{i}") for i, side in enumerate(pair or ())]
    cols = []
    for c in inst.columns:
        if c == "institution_id":
            continue
        if c in flags:
            cols.append(F.max(F.coalesce(c, F.lit(False))).alias(c))
        elif c in FILL_FIELDS:
            filled = F.min_by(c, F.when(~X.is_blank(F.col(c)), F.col("institution_id")))
            cols.append(F.coalesce(filled, F.min_by(c, "institution_id")).alias(c))
        else:
            cols.append(F.min_by(c, "institution_id").alias(c))
    out = rows.groupBy("root").agg(*cols, *sides, F.count("*").alias("merged_rows")).withColumnRenamed("root", "institution_id")
    if pair:
        both = F.col("_p0") & F.col("_p1") & (F.col("merged_rows") > 1)
        for c, value in forced.items():
            out = out.withColumn(c, F.when(both, F.lit(value)).otherwise(F.col(c)))
        out = out.drop("_p0", "_p1")
    return out


# ---- M4, M5, M6: purge, repair, import -------------------------------------------

def purge(level1: DataFrame, level2: DataFrame, level3: DataFrame, link: DataFrame,
          seeded: Column, keep_orphans: bool = False) -> dict[str, DataFrame]:
    """Remove seeded programmes (``seeded`` on level 3), their links and undated links, then empty levels."""
    seed = level3.filter(F.coalesce(seeded, F.lit(False)))
    link2 = R.where_lacks(link.filter(F.col("created_at").isNotNull()), seed, "specialization_id")
    spec2 = R.where_lacks(level3, seed, "specialization_id")
    if not keep_orphans:
        spec2 = R.where_has(spec2, link2, "specialization_id")
    qual2 = R.where_has(level2, spec2, "qualification_id")
    return {"link": link2, "level3": spec2, "level2": qual2, "level1": R.where_has(level1, qual2, "global_id")}


def repair_links(link: DataFrame, plan: DataFrame, cutoff) -> DataFrame:
    """Move recent misdirected links: ``plan`` gives wrong_id, right_id, specialization_id, cost, duration."""
    wrong = plan.select(F.col("wrong_id").alias("institution_id"), "specialization_id").distinct()
    recent = link.filter(F.col("created_at") >= cutoff)
    gone = recent.join(wrong, ["institution_id", "specialization_id"], "left_semi").select("institution_id", "specialization_id")
    kept = link.join(gone, ["institution_id", "specialization_id"], "left_anti")
    right = plan.select("ord", F.col("right_id").alias("institution_id"), "specialization_id", "cost", "duration")
    return upsert_links(kept, right)


def update_institutions(inst: DataFrame, incoming: DataFrame, cols: list[str]) -> DataFrame:
    """Overwrite with the values that are given; the last matched row (highest ord) counts per field."""
    given = {c: F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in cols}
    last = incoming.groupBy("institution_id").agg(
        *[F.max_by(c, F.when(given[c], F.col("ord"))).alias("_n_" + c) for c in cols]
    )
    out = inst.join(last, "institution_id", "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce("_n_" + c, c))
    return out.drop(*["_n_" + c for c in cols])


def import_links(link: DataFrame, new: DataFrame, mode: str = "attach") -> DataFrame:
    """Attach offers to links; ``replace`` first drops all links of the institutions that offer something."""
    if mode == "replace":
        link = R.where_lacks(link, new, "institution_id")
    return upsert_links(link, new)


# ---- M8, M9 -------------------------------------------------------------------------

def set_value(df: DataFrame, changes: DataFrame, key: str, col: str) -> DataFrame:
    """Write the last change per key (highest seq) into a column."""
    last = changes.groupBy(key).agg(F.max_by("value", "seq").alias("_value"), F.lit(True).alias("_hit"))
    out = df.join(last, key, "left")
    return out.withColumn(col, F.when(F.col("_hit"), F.col("_value")).otherwise(F.col(col))).drop("_value", "_hit")


def insert_if_absent(df: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``new`` to add: none that exists, the first one per key."""
    cols = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("row"))
    return first.join(df.select(*keys).distinct(), keys, "left_anti").select(*keys, "row.*")
