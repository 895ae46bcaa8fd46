"""Read queries: filters, joins, counts, ratings, nested catalogue, pages."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import checkpoint
from .ordered import numbered

NEST_LIMIT = 10_000


# ---- filters -------------------------------------------------------------

def search(df: DataFrame, col: str, term: str) -> DataFrame:
    """Rows whose column holds the term literally, in any case."""
    return df.filter(F.contains(F.lower(F.col(col)), F.lower(F.lit(term))))


def where_optional(df: DataFrame, **equal) -> DataFrame:
    """Apply only the filters that were given a value."""
    given = {k: v for k, v in equal.items() if v is not None and v != ""}
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == F.lit(kv[1])), given.items(), df)


def exclude_status(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """NOT IN with SQL meaning: a NULL status is left out as well."""
    return df.filter(~F.col(col).isin(values))


def pick_ids(df: DataFrame, key: str, ids: str, cols: list[str]) -> DataFrame:
    wanted = [int(i) for i in ids.split(",") if i.strip().isdigit()]
    return df.filter(F.col(key).isin(wanted)).select(*cols)


def active(df: DataFrame, deleted_at: str = "deleted_at") -> DataFrame:
    return df.filter(F.col(deleted_at).isNull())


def trashed(df: DataFrame, deleted_at: str = "deleted_at") -> DataFrame:
    return df.filter(F.col(deleted_at).isNotNull())


def public_columns(df: DataFrame, hidden: tuple[str, ...] = ("password",)) -> DataFrame:
    return df.drop(*hidden)


def for_owner(df: DataFrame, key: str, owner, order: str, tie: str) -> DataFrame:
    """Rows of one owner, newest first."""
    return df.filter(F.col(key) == F.lit(owner)).orderBy(F.col(order).desc(), F.col(tie).desc())


# ---- joins ---------------------------------------------------------------

def key_set(df: DataFrame, key: str, as_key: str | None = None) -> DataFrame:
    """Distinct non-null keys; duplicates of a hot key vanish before the shuffle."""
    return df.select(F.col(key).alias(as_key or key)).dropna().distinct()


def link_join(link: DataFrame, spec: DataFrame, qual: DataFrame | None = None, qual_key=None) -> DataFrame:
    """Links with programme columns, optionally with the level-2 columns."""
    out = link.join(spec, "specialization_id")
    return out if qual is None else out.join(qual, qual_key, "left")


def enrich(fact: DataFrame, dims: dict) -> DataFrame:
    """Left-join each dimension on its key; Spark broadcasts the small ones by size."""
    return reduce(lambda f, kv: f.join(kv[1], kv[0], "left"), dims.items(), fact)


def where_has(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None, cond: Column | None = None) -> DataFrame:
    """Rows that have at least one partner in ``other``."""
    partner = other if cond is None else other.filter(cond)
    return df.join(key_set(partner, other_key or key, key), key, "left_semi")


def where_lacks(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows without a partner in ``other``."""
    return df.join(key_set(other, other_key or key, key), key, "left_anti")


def available(spec: DataFrame, link: DataFrame, institution_id) -> DataFrame:
    """Programmes not yet offered by the institution."""
    return where_lacks(spec, link.filter(F.col("institution_id") == institution_id), "specialization_id")


def prune_tree(glob: DataFrame, qual: DataFrame, spec: DataFrame, link: DataFrame):
    """Surviving levels after removal of unlinked programmes and of emptied parents."""
    spec2 = where_has(spec, link, "specialization_id")
    qual2 = where_has(qual, spec2, "qualification_id")
    glob2 = where_has(glob, qual2, "global_id")
    return glob2, qual2, spec2


def backfill(child: DataFrame, parent: DataFrame, key: str, col: str) -> DataFrame:
    """Copy a parent column into the child where a parent exists."""
    source = parent.select(key, F.col(col).alias("_from_parent"))
    out = child.join(source, key, "left")
    old = F.col(col) if col in child.columns else F.lit(None)
    return out.withColumn(col, F.coalesce("_from_parent", old)).drop("_from_parent")


def type_by_membership(df: DataFrame, members: DataFrame, key: str, col: str, value: str) -> DataFrame:
    """Set a column for the rows listed in another table."""
    flag = key_set(members, key).withColumn("_member", F.lit(True))
    return df.join(flag, key, "left").withColumn(
        col, F.when(F.col("_member"), F.lit(value)).otherwise(F.col(col))
    ).drop("_member")


# ---- nested results ------------------------------------------------------

def nest(parents: DataFrame, rows: DataFrame, key: str, order: list[str], fields: list[str],
         into: str, limit: int = NEST_LIMIT) -> DataFrame:
    """Parents with their rows as arrays of ``limit`` rows: part 0 holds the first of them by ``order``, part 1 the next.

    The parts of a key, one after the other, are its list in order. Parents without rows get one empty array.
    """
    items = F.struct(*dict.fromkeys(order + fields))
    listed = F.sort_array(F.collect_list(items)).alias(into)
    rows = checkpoint(rows.select(key, *dict.fromkeys(order + fields)))
    if rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).isEmpty():
        # each list is one part: nothing to number, and the lists lie where their parents meet them
        nested = rows.groupBy(key).agg(listed).withColumn("part", F.lit(0))
    else:
        parts = numbered(rows, key, order, "_at").withColumn("part", F.floor(F.col("_at") / limit).cast("int"))
        nested = parts.groupBy(key, "part").agg(listed)
    out = parents.join(nested, key, "left")
    empty = F.array().cast(nested.schema[into].dataType)
    return out.withColumn(into, F.coalesce(into, empty)).withColumn("part", F.coalesce("part", F.lit(0)))


def catalog_tree(glob: DataFrame, qual: DataFrame, spec: DataFrame, limit: int = NEST_LIMIT) -> DataFrame:
    """Level 1 with an array of level 2, each with an array of programmes; ``limit`` programmes in a row at most."""
    side = max(1, int(limit ** 0.5))
    level2 = nest(qual, spec, "qualification_id", ["specialization_id"], ["name"], "specializations", side)
    return nest(
        glob, level2, "global_id", ["qualification_id", "part"], ["qualification_name", "specializations"],
        "qualifications", side,
    )


def institution_index(inst, link, spec, qual, review, like, limit: int = NEST_LIMIT) -> DataFrame:
    """Every institution with its ratings and, per kind of tree, its programmes as an array.

    One row per institution, kind and part; a kind without programmes has an empty array.
    """
    rows = link_join(link.select("institution_id", "specialization_id"), spec, qual, "qualification_id")
    kinds = F.explode(F.array(F.lit("university"), F.lit("college"))).alias("kind")
    base = rating_summary(inst, review, like).select("*", kinds)
    key = F.struct("institution_id", "kind")
    out = nest(
        base.withColumn("_key", key), rows.withColumn("_key", key), "_key", ["specialization_id"],
        ["name", "qualification_name"], "programs", limit,
    )
    return out.drop("_key")


# ---- aggregates ----------------------------------------------------------

def rating_summary(inst: DataFrame, review: DataFrame, like: DataFrame) -> DataFrame:
    """Review count, like count and mean rating; each fact is reduced before it is joined."""
    reviews = review.groupBy("institution_id").agg(
        F.count("*").alias("reviews_count"), F.avg("rating").alias("avg_rating")
    )
    likes = like.groupBy("institution_id").agg(F.count("*").alias("likes_count"))
    return (
        inst.join(reviews, "institution_id", "left")
        .join(likes, "institution_id", "left")
        .fillna(0, ["reviews_count", "likes_count"])
    )


def avg_or_zero(col: Column) -> Column:
    return F.coalesce(F.avg(col), F.lit(0.0))


def institutions_for(specialization_id, inst, link, review, like) -> DataFrame:
    """Institutions of one programme with price, term and ratings."""
    offers = link.filter(F.col("specialization_id") == specialization_id).select("institution_id", "cost", "duration")
    chosen = inst.join(offers, "institution_id")
    only = key_set(offers, "institution_id")
    return rating_summary(
        chosen, review.join(only, "institution_id", "left_semi"), like.join(only, "institution_id", "left_semi")
    )


def detail_card(institution_id, inst, links_by_kind: DataFrame, review, like) -> DataFrame:
    """Programmes of one institution from the tree its type names, with ratings.

    One row per programme, so an institution with very many programmes stays
    spread; an institution without programmes keeps one row.
    """
    one = inst.filter(F.col("institution_id") == institution_id)
    card = rating_summary(
        one,
        review.filter(F.col("institution_id") == institution_id),
        like.filter(F.col("institution_id") == institution_id),
    )
    offers = links_by_kind.filter(F.col("institution_id") == institution_id)
    return card.join(offers, ["institution_id", "type"], "left")


def dashboard(spark, counts: dict[str, DataFrame]) -> DataFrame:
    """One row of totals; every total is its own scalar subquery."""
    cells = [df.agg(F.count("*")).scalar().alias(name) for name, df in counts.items()]
    return spark.range(1).select(*cells)


def latest(df: DataFrame, ts: str, tie: str, n: int = 1) -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def multi_child(parent: DataFrame, child: DataFrame, key: str, n: int = 15) -> DataFrame:
    """Parents with more than one child, largest first."""
    sizes = child.groupBy(key).agg(F.count("*").alias("children")).filter("children > 1")
    return parent.join(sizes, key).orderBy(F.col("children").desc(), F.col(key)).limit(n)


def import_preview(programs: DataFrame, names: int = 8) -> DataFrame:
    """Size of an import: rows, level-1 names, codes, and the first names."""
    group = F.coalesce(F.nullif(F.trim("global_specialty"), F.lit("")), F.lit(X.DEFAULT_GROUP))
    rows = programs.select(group.alias("g"), F.nullif(F.trim("code"), F.lit("")).alias("c"))
    sample = (
        rows.select("g").distinct().orderBy("g").limit(names)
        .agg(F.array_join(F.sort_array(F.collect_list("g")), " | "))
    )
    return rows.agg(
        F.count("*").alias("program_rows"),
        F.countDistinct("g").alias("unique_groups"),
        F.countDistinct("c").alias("unique_codes"),
    ).withColumn("sample_groups", sample.scalar())


def event_board(event: DataFrame, app: DataFrame) -> DataFrame:
    """Events with their number of applications by status."""
    stats = app.groupBy("event_id").agg(
        F.count("*").alias("applications"),
        F.count_if(F.col("status") == "Pending").alias("pending"),
        F.count_if(F.col("status") == "Accepted").alias("accepted"),
        F.count_if(F.col("status") == "Rejected").alias("rejected"),
    )
    return event.join(stats, "event_id", "left").fillna(0, ["applications", "pending", "accepted", "rejected"])


def events_per_institution(inst: DataFrame, event: DataFrame) -> DataFrame:
    sizes = event.groupBy("institution_id").agg(F.count("*").alias("events"))
    return inst.join(sizes, "institution_id", "left").fillna(0, ["events"])


def host_groups(inst: DataFrame, website: str = "website") -> DataFrame:
    """Website hosts shared by several institutions."""
    return (
        inst.withColumn("host", X.website_host(F.col(website)))
        .filter("host IS NOT NULL")
        .groupBy("host")
        .agg(F.count("*").alias("members"), F.min("institution_id").alias("keep_id"))
        .filter("members > 1")
    )


# ---- order and pages -----------------------------------------------------

def paginate(df: DataFrame, page: int, per_page: int, *order: Column) -> DataFrame:
    """One page of rows with the totals; the total is counted apart, without a global window."""
    total = df.agg(F.count("*")).scalar()
    rows = df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)
    return (
        rows.withColumn("total", total)
        .withColumn("per_page", F.lit(per_page))
        .withColumn("last_page", F.greatest(F.ceil(F.col("total") / per_page), F.lit(1)).cast("bigint"))
    )


def sort_by_date(df: DataFrame, col: str, tie: str, direction: str = "newest") -> DataFrame:
    if direction == "oldest":
        return df.orderBy(F.col(col).asc(), F.col(tie).asc())
    return df.orderBy(F.col(col).desc(), F.col(tie).desc())


def catalog_order(df: DataFrame) -> DataFrame:
    """By code, rows without a code last, then by name."""
    return df.orderBy(F.col("code").asc_nulls_last(), F.col("name"))


# ---- sets ----------------------------------------------------------------

def catalog(university: DataFrame, college: DataFrame, kind: str | None = None) -> DataFrame:
    """Both trees tagged by kind, or one of them."""
    frames = {"university": university, "college": college}
    chosen = [d.withColumn("kind", F.lit(k)) for k, d in frames.items() if kind in (None, k)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chosen)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_in_order(col: Column) -> Column:
    return F.array_distinct(col)
