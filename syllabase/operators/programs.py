"""Programme rows: cleaning, duplicate titles, merging of sources, price rules.

The winner of a group is a ``min`` over a struct that starts with the sort keys.
Unlike a window, it is reduced on the map side, so a group with a third of all
rows does not end in one task.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import titles as T
from ..functions import values as V
from ..functions.plan import settle, spread
from ..session import checkpoint, discard
from .ordered import numbered
from .quality import first_per_group

# Words that mark menu entries and error pages among programme names.
MENU_WORDS = ("cookie", "меню", "главная", "войти", "login", "privacy", "политика", "подробнее", "скачать")
PAGE_WORDS = ("cookie", "javascript", "error", "404", "privacy", "политик")
# Code prefix and the branch of study it stands for.
BRANCHES = (
    ("6В01", "Педагогические науки"), ("6В02", "Искусство и гуманитарные науки"),
    ("6В03", "Социальные науки, журналистика и информация"), ("6В04", "Бизнес, управление и право"),
    ("6В05", "Естественные науки, математика и статистика"), ("6В06", "Информационно-коммуникационные технологии"),
    ("6В07", "Инженерные, обрабатывающие и строительные отрасли"), ("6В08", "Сельское, лесное, рыбное хозяйство"),
    ("6В09", "Здравоохранение и социальное обеспечение"), ("6В10", "Услуги"), ("6В11", "Национальная безопасность"),
    ("6В12", "Национальная безопасность / военное дело"),
)


def _first(order, *fields, when=None):
    row = F.struct(*order, *fields)
    return F.min(row if when is None else F.when(when, row))


# ---- links of the catalogue ----------------------------------------------

def analysis(titles: DataFrame) -> DataFrame:
    """Group key, clean title, language, score and term of each programme title (one per programme)."""
    found = T.analyze_titles(titles, T.LINK_RULES)
    key = T.link_group_key(F.col("title_code"), F.col("clean")).alias("group_key")
    return settle(found.select("specialization_id", key, "raw", "clean", "lang", "score", "drop", "hint"))


def clean_links(link: DataFrame, titles: DataFrame) -> DataFrame:
    """One kept link per institution and code (or name), with the best Russian title.

    Columns: institution_id, group_key, specialization_id, final_name, cost,
    duration, removed (other links of the group), renamed. Ties go to the lowest
    programme id. A Russian title always scores at least 40, so the first Russian
    row gives both the name and the link.
    """
    return _kept(link, analysis(titles))


def _kept(link: DataFrame, found: DataFrame) -> DataFrame:
    """Only numbers are compared: a title's rank and its group's lowest rank. Texts are fetched once a title has won."""
    order = ["_o", "specialization_id", "clean", "raw", "hint"]
    usable = found.filter(~F.col("drop")).withColumn("_all", F.lit(0)).withColumn("_o", -F.col("score"))
    ranked = checkpoint(numbered(usable, "_all", order, "_rank"))
    group = ranked.groupBy(F.col("group_key").alias("_key")).agg(F.min("_rank").alias("_group"))
    russian = F.when((F.col("lang") == "ru") & (F.col("score") >= 40), F.col("_rank")).alias("_ru")
    places = ranked.join(group, F.col("group_key").eqNullSafe(F.col("_key"))).select("specialization_id", "_group", "_rank", russian)
    years = F.col("duration").try_cast("int")
    groups = link.select("institution_id", "specialization_id", "cost", "duration").join(places, "specialization_id").groupBy("institution_id", "_group").agg(
        F.coalesce(F.min("_ru"), F.min("_rank")).alias("_rank"),
        F.max(F.when(F.col("cost") > 0, F.col("cost"))).alias("cost"),
        F.max(F.when(years > 0, years)).alias("years"),
        (F.count("*") - 1).alias("removed"),
    )
    texts = ranked.select("_rank", "group_key", "specialization_id", "clean", "raw", "hint")
    return groups.join(texts, "_rank").select(
        "institution_id", "group_key", "specialization_id", F.col("clean").alias("final_name"),
        "cost", F.coalesce("years", "hint").alias("duration"), "removed", (F.col("raw") != F.col("clean")).alias("renamed"),
    )


def clean_stats(link: DataFrame, titles: DataFrame) -> DataFrame:
    """Kept, removed and renamed links per institution."""
    found = checkpoint(analysis(titles))  # used twice
    gone = link.join(found.select("specialization_id", "drop"), "specialization_id", "left")
    totals = gone.groupBy("institution_id").agg(F.count_if("drop").alias("dropped"))
    kept = _kept(link, found).groupBy("institution_id").agg(
        F.count("*").alias("kept"), F.sum("removed").alias("merged"), F.count_if("renamed").alias("renamed")
    )
    out = totals.join(kept, "institution_id", "left").fillna(0, ["kept", "merged", "renamed"])
    return out.select("institution_id", "kept", (F.col("merged") + F.col("dropped")).alias("removed"), "renamed")


def apply_renames(kept: DataFrame, spec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, renamed programmes) after the cleaned names are written back.

    When the new name already belongs to a programme of the same level-2 row the
    link moves to that programme (lowest id); a link that is already there takes
    the moved values first. When institutions want different names for one
    programme the one with the highest id decides.
    """
    named = spec.groupBy("name", "qualification_id").agg(F.min("specialization_id").alias("target"))
    wanted = kept.join(spec.select("specialization_id", "qualification_id"), "specialization_id").withColumn("name", F.col("final_name"))
    wanted = wanted.join(named, ["name", "qualification_id"], "left")
    moves = F.col("renamed") & F.col("target").isNotNull() & (F.col("target") != F.col("specialization_id"))
    placed = wanted.withColumn("moved", F.coalesce(moves, F.lit(False))).withColumn(
        "place", F.when(F.col("moved"), F.col("target")).otherwise(F.col("specialization_id"))
    )
    order = F.struct(~F.col("moved"), F.col("specialization_id"))
    links = placed.groupBy("institution_id", F.col("place").alias("specialization_id")).agg(
        F.min_by("cost", F.when(F.col("cost").isNotNull(), order)).alias("cost"),
        F.min_by("duration", F.when(F.col("duration").isNotNull(), order)).alias("duration"),
    )
    names = (
        placed.filter("renamed AND NOT moved").groupBy("specialization_id")
        .agg(F.max_by("name", "institution_id").alias("new_name"))
    )
    return links, names


# ---- programme files ------------------------------------------------------

def prepared(programs: DataFrame) -> DataFrame:
    """Usable programme rows with clean title, code, score, price and years."""
    keys = ["name", "qualification", "code"]
    titles = T.analyze_titles(programs.select(*keys).distinct(), T.FILE_RULES, code="code").filter(~F.col("drop"))
    key = T.file_group_key(F.col("title_code"), F.col("clean")).alias("group_key")
    titles = settle(titles.select(
        *[F.col(k).alias("_" + k) for k in keys], "title_code", "clean", key, "lang", "score", "hint"
    ))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_" + k))
    given = F.col("duration")
    years = F.when(X.is_blank(given), F.col("hint")).otherwise(given.try_cast("int"))
    return (
        programs.join(titles, same)
        .withColumn("price", V.normalize_cost(F.col("cost")))
        .withColumn("years", F.when(years.between(1, 8), years))
        .withColumn("branch", F.coalesce(F.nullif("global_specialty", F.lit("")), F.lit(X.DEFAULT_GROUP)))
    )


def dedupe_programs(programs: DataFrame) -> DataFrame:
    """One row per institution and programme; gaps filled from the next best row."""
    order = [(-F.col("score")).alias("o"), F.col("pos").alias("p")]
    ru_first = [(F.col("lang") != "ru").alias("other"), *order]
    groups = prepared(programs).groupBy("institution_id", "group_key").agg(
        _first(ru_first, "clean", F.col("title_code").alias("code"), "branch", "price", "years").alias("best"),
        _first(order, "price", when=F.col("price").isNotNull()).alias("priced"),
        _first(order, "years", when=F.col("years").isNotNull()).alias("timed"),
    )
    code, branch = F.col("best.code"), F.col("best.branch")
    return groups.select(
        "institution_id", F.col("best.clean").alias("name"), code.alias("code"), branch.alias("global_specialty"),
        F.coalesce(F.concat(code, F.lit(" · "), branch), branch).alias("qualification"),
        F.coalesce("best.price", "priced.price").alias("cost"), F.coalesce("best.years", "timed.years").alias("duration"),
        F.col("best.p").alias("pos"),
    )


def keep_better(programs: DataFrame) -> DataFrame:
    """Better duplicate per code and name: price, term and code count one point each."""
    name = X.clean_program_name(F.col("name"))
    have = {"cost": ~X.is_zero(F.col("cost")), "duration": ~X.is_zero(F.col("duration")), "code": ~X.is_blank(F.col("code"))}
    points = sum((h.cast("int") for h in have.values()), F.lit(0))
    rest = [c for c in programs.columns if c not in ("institution_id", "pos")]
    best = (
        programs.filter(name != "")
        .groupBy("institution_id", F.coalesce("code", F.lit("")).alias("_code"), F.lower(name).alias("_name"))
        .agg(_first([(-points).alias("_o"), (~have["cost"]).alias("_c"), F.col("pos").alias("pos")], *rest).alias("b"))
    )
    low = F.lower("name")
    return (
        best.select("institution_id", "b.pos", *[F.col(f"b.{c}") for c in rest])
        .filter(~X.has(low, *PAGE_WORDS) & (F.length("name") >= 4))
    )


def gate_official(programs: DataFrame) -> DataFrame:
    """Named rows that have a code or a price, all of them."""
    name = F.trim(X.text(F.col("name")))
    return (
        programs.withColumn("name", name).withColumn("cost", V.normalize_cost(F.col("cost")))
        .filter(F.length("name").between(5, 160) & ~X.has(F.lower("name"), *MENU_WORDS))
        .filter(~X.is_blank(F.col("code")) | F.col("cost").isNotNull())
    )


def gate_min_programs(programs: DataFrame, least: int) -> DataFrame:
    """Institutions with their programme count and whether it reaches the minimum."""
    return programs.groupBy("institution_id").agg(F.count("*").alias("programs_count")).withColumn(
        "ok", F.col("programs_count") >= least
    )


def list_sizes(programs: DataFrame) -> DataFrame:
    """Every row with ``has_code`` and, for its institution, the number of rows (``listed``) and of coded rows (``coded``)."""
    rows = programs.withColumn("has_code", ~X.is_blank(F.col("code")))
    sizes = rows.groupBy("institution_id").agg(F.count("*").alias("listed"), F.count_if("has_code").alias("coded"))
    return rows.join(sizes, "institution_id")


#: Added to the positions of the second source: it comes after the first.
SECOND = 1 << 61


def merge_programs(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Programmes of two sources as one list per institution.

    A second-source row joins the row with the same code and name, else the first
    row with the same name, else the first second-source row with that name. It
    fills empty price, term and code. Of equal base rows the last one counts.
    ``pos`` is a whole number from 0 up to SECOND, unique per institution and
    source; in the result those of the second source lie SECOND higher.
    """
    fields = ["name", "code", "global_specialty", "qualification", "cost", "duration", "source"]

    def placed_at(df, side):
        return df.select("institution_id", (F.col("pos").cast("long") + side * SECOND).alias("at"), *fields)

    rows = checkpoint(placed_at(base, 0).unionByName(placed_at(extra, 1)))  # what made the rows runs once
    # Each distinct row of texts is one number from here on, and so are its name and key; each distinct name and code is read once.
    texts = ["name", "code", "global_specialty", "qualification", "source"]
    kinds = checkpoint(rows.select(*texts).distinct().withColumn("text", F.monotonically_increasing_id()))
    code = F.regexp_replace(F.upper(X.text(F.col("code"))), "B", "В")
    titles = settle(spread(kinds.select("name", "code").distinct()).select(
        F.col("name").alias("_name"), F.col("code").alias("_code"), code.alias("_c"), X.score_name(F.col("name")).alias("_n")))
    titles = checkpoint(titles.withColumn("_k", F.concat("_c", F.lit("||"), "_n")).withColumn("_id", F.monotonically_increasing_id()))
    least = lambda c, into: titles.groupBy(c).agg(F.min("_id").alias(into))
    numbers = titles.join(least("_n", "n"), "_n").join(least("_k", "k"), "_k").select("_name", "_code", "n", "k")
    same = lambda cols: reduce(Column.__and__, [F.col(c).eqNullSafe(F.col("_" + c)) for c in cols])
    numbers = kinds.join(numbers, same(["name", "code"])).select(*[F.col(c).alias("_" + c) for c in texts], "text", "n", "k")
    keyed = checkpoint(rows.join(numbers, same(texts)).select(
        "institution_id", "n", "k", "at", "text", "cost", "duration", (~X.is_blank(F.col("code"))).alias("coded"), (F.col("source") == "official").alias("official")))
    discard(rows, titles)
    first, second = F.when(F.col("at") < SECOND, F.col("at")), F.when(F.col("at") >= SECOND, F.col("at"))
    # Only places are compared: all sums below are of fixed width, and texts are fetched by their number once a row's place has won.
    keys = keyed.groupBy("institution_id", "n", "k").agg(
        F.min(first).alias("begin"), F.max(first).alias("last"), F.min(second).alias("own"))
    named = Window.partitionBy("institution_id", "n")
    keys = keys.select("institution_id", "k", "begin", "last", F.coalesce(
        "begin", F.min("begin").over(named), F.min("own").over(named)).alias("target"))
    placed = keyed.drop("n").join(keys, ["institution_id", "k"])
    placed = placed.filter((F.col("at") >= SECOND) | (F.col("at") == F.col("last")))
    base_row = F.col("at") < SECOND
    placed = placed.withColumn("ord", F.when(base_row, F.col("begin")).otherwise(F.col("at")))

    def first_of(col, given):
        return F.min_by(col, F.when(given, F.col("ord")))

    merged = placed.groupBy("institution_id", "target").agg(
        F.min("ord").alias("ord"), F.min_by("at", "ord").alias("head"), F.min_by("text", "ord").alias("head_text"), F.count("*").alias("rows"),
        first_of("cost", F.col("cost").isNotNull()).alias("cost"), first_of("duration", F.col("duration").isNotNull()).alias("duration"),
        first_of("at", F.col("coded")).alias("code_at"), first_of("text", F.col("coded")).alias("code_text"),
        F.max(F.when(~base_row, F.col("official"))).alias("official"),
    )
    place = ["institution_id", "at"]
    again = checkpoint(keyed.groupBy(*place).agg(F.count("*").alias("c")).filter("c > 1").select(*place))
    if not again.isEmpty():  # a place of several rows stands for the texts of each
        again = keyed.join(again, place).select("institution_id", "at", "text")
        for c, text in (("head", "head_text"), ("code_at", "code_text")):
            merged = merged.join(again.select("institution_id", F.col("at").alias(c), F.col("text").alias("_text")), ["institution_id", c], "left")
            merged = merged.withColumn(text, F.coalesce("_text", text)).drop("_text")
    codes = kinds.select(F.col("text").alias("code_text"), "code")
    heads = kinds.select(F.col("text").alias("head_text"), "name", "global_specialty", "qualification", "source")
    merged = merged.join(codes, "code_text", "left").join(heads, "head_text")
    joined = F.array_distinct(F.array("source", F.lit("official")))
    several = F.col("official") & (F.col("rows") > 1)
    return merged.select(
        "institution_id", "name", "code", "global_specialty", "qualification", "cost", "duration",
        F.when(several, joined).otherwise(F.array("source")).alias("sources"), F.col("ord").alias("pos"),
    )


def apply_overrides(programs: DataFrame, by_id: DataFrame, name_rules: DataFrame) -> DataFrame:
    """Published prices: name rules first (the last match wins), then defaults per institution.

    ``by_id``: institution_id, fill_null_only, default_cost, default_duration.
    ``name_rules``: institution_id, match (regular expression), cost, duration, ord.
    """
    title = X.text(F.col("name")).alias("_title")
    asked = programs.select("institution_id", title).distinct().join(
        name_rules.select("institution_id", "match", "ord", F.col("cost").alias("_c"), F.col("duration").alias("_d")), "institution_id")
    # A pattern meets each title once, however many institutions and rows have both.
    fits = asked.select("match", "_title").distinct().filter(F.rlike("_title", F.col("match")))
    won = asked.join(fits, ["match", "_title"]).groupBy("institution_id", "_title").agg(
        F.max(F.struct("ord", "match", "_c")).alias("_rule"), F.max(F.when(F.col("_d") > 0, F.struct("ord", "match", "_d"))).alias("_timed"))
    rows = programs.withColumn("_title", title).join(won, ["institution_id", "_title"], "left").drop("_title")
    rows = rows.join(by_id, "institution_id", "left")
    rule_years = F.col("_timed._d")
    ruled = F.col("_rule").isNotNull()
    fill = F.coalesce("fill_null_only", F.lit(True))
    offer = F.when(F.col("default_cost") > 0, F.col("default_cost"))
    filled = ~ruled & offer.isNotNull() & fill & ~(F.coalesce("cost", F.lit(0.0)) > 0)
    forced = ~ruled & offer.isNotNull() & ~fill
    source = (
        F.when(ruled, "official_name_rule").when(filled, "official_default_fill").when(forced, "official_default_force")
    )
    cost = F.when(ruled, F.col("_rule._c")).when(filled | forced, offer).otherwise(F.col("cost"))
    no_years = X.is_zero(F.col("duration")) & (F.col("default_duration") > 0)
    years = F.when(ruled, F.coalesce(rule_years, F.col("duration"))).when(no_years, F.col("default_duration")).otherwise(F.col("duration"))
    rows = rows.withColumn("cost_source", source).withColumn("_cost", cost).withColumn("_years", years)
    keep = [c for c in programs.columns if c not in ("cost", "duration")]
    return rows.select(*keep, F.col("_cost").alias("cost"), F.col("_years").alias("duration"), "cost_source")


def infer_branch(programs: DataFrame) -> DataFrame:
    """Fill branch and qualification from the prefix of the code."""
    canon = F.regexp_replace(F.upper(X.text(F.col("code"))), "B", "В")
    branch = X.first_rule(canon, BRANCHES, how="startswith", default=F.lit(X.DEFAULT_GROUP))
    out = programs.withColumn("global_specialty", F.coalesce(F.nullif("global_specialty", F.lit("")), branch))
    own = F.coalesce(F.nullif("code", F.lit("")), F.col("global_specialty"))
    return out.withColumn("qualification", F.coalesce(F.nullif("qualification", F.lit("")), own))


def run_totals(programs: DataFrame) -> DataFrame:
    """Institutions with programmes, programmes, priced programmes."""
    per = programs.groupBy("institution_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("cost").isNotNull()).alias("priced")
    )
    return per.agg(
        F.count("*").alias("ok_count"), F.sum("n").alias("total_programs"), F.sum("priced").alias("total_with_cost")
    )
