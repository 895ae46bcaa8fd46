"""Audit of programme titles and constraint reports."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import titles as T
from ..functions.plan import settle, spread
from ..session import checkpoint


def flagged(programs: DataFrame) -> DataFrame:
    """Programmes with flags, code and fingerprint, computed once per distinct title."""
    titles = settle(
        spread(programs.select(F.col("name").alias("_title")).distinct())
        .withColumn("flags", T.quality_flags(F.col("_title")))
        .withColumn("fp", F.regexp_replace(F.lower(X.text(F.col("_title"))), "[^a-zа-яё0-9]+", ""))
    )
    code = F.coalesce(X.extract_code(F.col("name")), X.extract_code(F.col("qualification")), X.extract_code(F.col("code")))
    return (
        programs.join(titles, F.col("name").eqNullSafe(F.col("_title")), "left")
        .drop("_title")
        .withColumn("audit_code", code)
    )


def _numbered_keys(judged: DataFrame, base: int) -> DataFrame:
    """(kind, key, number): a number for each code and each fingerprint there is, from ``base`` (even) on; codes even, names odd."""
    kinds = [(kind, F.col(c)) for kind, c in (("code", "audit_code"), ("name", "fp"))]
    keys = judged.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in kinds])).alias("e")).select("e.*")
    keys = checkpoint(keys.filter("key <> ''").distinct().withColumn("_n", F.monotonically_increasing_id()))
    return keys.select("kind", "key", (F.col("_n") * 2 + base + F.when(F.col("kind") == "name", 1).otherwise(0)).alias("number"))


def audit(inst: DataFrame, programs: DataFrame) -> DataFrame:
    """Per institution: rows, priced rows, flagged rows, flag counts, duplicates, severity.

    Each distinct row of texts is judged once. It counts for its institution, for each of its flags, for its code and for its
    fingerprint; all four are numbers by then, summed by one aggregate of fixed width, whose few rows per institution the next one folds.
    """
    texts = ["name", "qualification", "code"]
    counts = checkpoint(programs.groupBy("institution_id", *texts).agg(
        F.count("*").alias("n"), F.count_if(~X.is_zero(F.col("cost"))).alias("priced")))
    judged = checkpoint(flagged(counts.select(*texts).distinct()))
    names = [name for name, _ in T.flag_checks(F.lit(""))]
    keys = _numbered_keys(judged, 2 * (len(names) // 2 + 1))
    of_kind = lambda kind, col, into: keys.filter(F.col("kind") == kind).select(F.col("key").alias(col), F.col("number").alias(into))
    marks = judged.join(of_kind("code", "audit_code", "_c"), "audit_code", "left").join(of_kind("name", "fp", "_f"), "fp", "left")
    # 0 is the row itself, 1 and up the flags, then codes and names
    flags = F.transform("flags", lambda f: F.array_position(F.array(*[F.lit(n) for n in names]), f))
    marks = marks.select(*[F.col(c).alias("_" + c) for c in texts], F.size("flags").cast("long").alias("size"),
                         F.array_compact(F.concat(F.array(F.lit(0).cast("long"), "_c", "_f"), flags)).alias("marks"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col("_" + c)) for c in texts])
    rows = counts.join(marks, same).select("institution_id", "n", "priced", "size", F.explode("marks").alias("mark"))
    own = lambda c: F.sum(F.when(F.col("mark") == 0, c).otherwise(0))
    sums = rows.groupBy("institution_id", "mark").agg(
        F.sum("n").alias("n"), own(F.col("priced")).alias("priced"), own(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("issues"),
        own(F.col("size") * F.col("n")).alias("flags"))
    row, flag = F.col("mark") == 0, F.col("mark").between(1, len(names))
    again = lambda odd: (F.col("mark") > len(names)) & (F.col("mark") % 2 == odd) & (F.col("n") > 1)
    name_of = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("mark").cast("int"))
    report = sums.groupBy("institution_id").agg(
        F.sum(F.when(row, F.col("n"))).alias("specs_count"), F.sum("priced").alias("with_cost"), F.sum("issues").alias("issue_rows"),
        F.sum("flags").alias("flag_total"), F.collect_list(F.when(flag, F.struct(name_of.alias("key"), "n"))).alias("counts"),
        F.count_if(again(0)).alias("code_duplicate_groups"), F.sum(F.when(again(0), F.col("n") - 1)).alias("code_surplus"),
        F.count_if(again(1)).alias("name_duplicate_groups"),
    ).withColumn("flag_counts", F.map_from_entries(F.sort_array("counts"))).drop("counts")
    numbers = ["specs_count", "with_cost", "issue_rows", "flag_total", "code_duplicate_groups", "code_surplus", "name_duplicate_groups"]
    out = inst.join(report, "institution_id", "left").fillna(0, numbers)
    empty = F.create_map().cast("map<string,bigint>")
    out = out.withColumn("flag_counts", F.coalesce("flag_counts", empty)).withColumn("severity", F.col("flag_total") + 2 * F.col("code_surplus"))
    return out.select(*inst.columns, *numbers[:3], "flag_counts", "code_duplicate_groups", "name_duplicate_groups", "severity")


def audit_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("universities"),
        F.count_if(F.col("specs_count") > 0).alias("with_specs"),
        F.count_if(F.col("specs_count") == 0).alias("empty_specs"),
        F.count_if((F.col("severity") == 0) & (F.col("specs_count") > 0)).alias("clean_universities"),
        F.count_if(F.col("severity") > 0).alias("universities_with_issues"),
        F.sum("specs_count").alias("total_specialties"),
        F.sum("issue_rows").alias("rows_with_flags"),
    )


def flag_totals(report: DataFrame) -> DataFrame:
    """How often each flag occurs, most common first."""
    return (
        report.select(F.explode("flag_counts").alias("flag", "n"))
        .groupBy("flag").agg(F.sum("n").alias("total"))
        .orderBy(F.col("total").desc(), "flag")
    )


def worst(report: DataFrame, n: int = 25) -> DataFrame:
    return report.orderBy(F.col("severity").desc(), F.col("issue_rows").desc(), F.col("name")).limit(n)


def first_per_group(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """First k rows of each group; Spark limits each partition before the shuffle."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def sample_issues(programs: DataFrame, order: str, k: int = 12) -> DataFrame:
    """First k flagged titles of each institution as one array of strings."""
    rows = flagged(programs).filter(F.size("flags") > 0)
    first = first_per_group(rows, ["institution_id"], [F.col(order)], k)
    line = F.concat(F.col("name"), F.lit(" ["), F.array_join("flags", ","), F.lit("]"))
    return first.groupBy("institution_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]).alias("sample_issues")
    )


def sample_code_groups(programs: DataFrame, order: str, groups: int = 8, names: int = 5) -> DataFrame:
    """First names of the first duplicate codes of each institution, by first appearance."""
    rows = flagged(programs).filter("audit_code IS NOT NULL")
    dup = (
        rows.groupBy("institution_id", "audit_code").agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
        .filter("n > 1")
    )
    chosen = first_per_group(dup, ["institution_id"], [F.col("first_seen"), F.col("audit_code")], groups)
    picked = rows.join(chosen.select("institution_id", "audit_code"), ["institution_id", "audit_code"], "left_semi")
    first = first_per_group(picked, ["institution_id", "audit_code"], [F.col(order)], names)
    return first.groupBy("institution_id", "audit_code").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]).alias("names")
    )


def constraint_report(df: DataFrame, checks: dict, unique: dict | None = None, keys: dict | None = None) -> DataFrame:
    """(rule, violations): row rules in one pass, then unique keys and foreign keys.

    ``checks``: rule -> condition that a bad row fulfils; ``unique``: rule ->
    columns; ``keys``: rule -> (column, parent frame, parent column).
    """
    spark = df.sparkSession
    counted = df.agg(*[F.count_if(bad).alias(rule) for rule, bad in checks.items()])
    pairs = F.map_from_arrays(
        F.array(*[F.lit(r) for r in checks]), F.array(*[F.col(f"`{r}`") for r in checks])
    )
    out = counted.select(F.explode(pairs).alias("rule", "violations"))
    for rule, cols in (unique or {}).items():
        extra = df.groupBy(*cols).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
        out = out.unionByName(extra.select(F.lit(rule).alias("rule"), "violations"))
    for rule, (col, parent, parent_col) in (keys or {}).items():
        known = parent.select(F.col(parent_col).alias("_k")).distinct()
        used = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("_k")).agg(F.count("*").alias("n"))
        lost = used.join(known, "_k", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
        out = out.unionByName(lost.select(F.lit(rule).alias("rule"), "violations"))
    return out
