"""Files that hold one large JSON document, read by many tasks.

Spark cuts a text file into byte ranges at a separator; here that is the closing brace, so no task needs more than its own range.
Whether a piece begins inside a string, and how deep it lies, depends on all pieces before it. Both are sums: each range adds up its
pieces for either state it may begin in, and a small window over the ranges of a file says which one it was.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint

#: Stands for the key of the wanted list and its bracket. Valid JSON has no such character in the raw.
MARK = "\x01"
RANGE = ["source_file", "_block"]


def _skeleton(parts: Column, first: int) -> Column:
    """Brackets outside strings; ``first`` is the index of the first part outside."""
    outside = F.filter(parts, lambda _, i: i % 2 == first)
    return F.regexp_replace(F.array_join(outside, ""), rf"[^{{}}\[\]{MARK}]", "")


def _balance(skeleton: Column) -> Column:
    return 2 * F.length(F.regexp_replace(skeleton, r"[}\]]", "")) - F.length(skeleton)


def _pieces(spark: SparkSession, paths, key: str) -> DataFrame:
    """Texts up to each closing brace, with the number of quotes and both skeletons, in the order of (_block, _at)."""
    raw = spark.read.option("lineSep", "}").text(paths).select(
        F.col("value").alias("_text"), F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    # A backslash and what it escapes can go: both lie in a string, and neither ends it.
    bare = F.regexp_replace(F.regexp_replace("_text", r"(?s)\\.", ""), rf'"{key}"\s*:\s*\[', MARK)
    # The brace that ended the piece belongs to it, in a string or not.
    parts = F.split(F.concat(bare, F.lit("}")), '"')
    return raw.withColumn("_parts", parts).select(
        "*", ((F.size("_parts") - 1) % 2).alias("_quotes"), _skeleton(F.col("_parts"), 0).alias("_even"), _skeleton(F.col("_parts"), 1).alias("_odd"),
    ).drop("_parts")


def _levels(pieces: DataFrame) -> DataFrame:
    """``_skel``: the brackets of a piece that count; ``_depth``: how many are open before it."""
    earlier = Window.partitionBy(*RANGE).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)) % 2
    rows = pieces.withColumn("_begun", begun)
    # for a range that begins outside a string, and for one that begins inside
    out = F.when(F.col("_begun") == 0, F.col("_even")).otherwise(F.col("_odd"))
    ins = F.when(F.col("_begun") == 0, F.col("_odd")).otherwise(F.col("_even"))
    rows = rows.withColumn("_out", out).withColumn("_in", ins).drop("_even", "_odd", "_begun")
    for side in ("_out", "_in"):
        rows = rows.withColumn(side + "_n", _balance(F.col(side)))
        rows = rows.withColumn(side + "_d", F.coalesce(F.sum(side + "_n").over(earlier), F.lit(0)))
    ranges = rows.groupBy(*RANGE).agg(*[F.sum(c).alias(c) for c in ("_quotes", "_out_n", "_in_n")])
    before = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_inside", F.coalesce(F.sum("_quotes").over(before), F.lit(0)) % 2 == 1)
    own = F.when(F.col("_inside"), F.col("_in_n")).otherwise(F.col("_out_n"))
    ranges = ranges.withColumn("_own", own).select(*RANGE, "_inside", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_base"))
    rows = rows.join(ranges, RANGE)
    pick = lambda a, b: F.when(F.col("_inside"), F.col(a)).otherwise(F.col(b))
    return rows.select(*RANGE, "_at", "_text", pick("_in", "_out").alias("_skel"), (F.col("_base") + pick("_in_d", "_out_d")).alias("_depth"))


def _walk(skeleton: Column, depth: Column, base: Column | None = None) -> Column:
    """What opened last at depth 1 in a piece (null if nothing did), whether the wanted list did, and whether an object begins at ``base``."""
    no = F.lit(False)
    start = F.struct(depth.cast("long").alias("d"), F.lit(None).cast("string").alias("opened"), no.alias("marked"), no.alias("begins"))
    base = F.lit(-1) if base is None else base

    def step(s, c):
        opens = ~c.isin("}", "]")
        return F.struct(
            (s["d"] + F.when(opens, 1).otherwise(-1)).alias("d"),
            F.when(opens & (s["d"] == 1), c).otherwise(s["opened"]).alias("opened"),
            (s["marked"] | ((c == MARK) & (s["d"] == 1))).alias("marked"),
            (s["begins"] | ((c == "{") & (s["d"] == base))).alias("begins"))

    return F.aggregate(F.filter(F.split(skeleton, ""), lambda c: c != ""), start, step)


def read_documents(spark: SparkSession, paths, schema: T.StructType, key: str) -> DataFrame:
    """One row per object of a document: the elements of its list, those of the list ``key`` of its object, or the object itself.

    Adds ``source_file``, ``source_number`` (from 0, in the file's order, objects only) and ``in_list`` (true for elements of ``key``).
    An element is put together again from its pieces, so one element, not one document, must fit in memory. A file that ends within an
    element gives that element as far as the JSON reader understands it. Empty files give no rows; compressed ones are not split.
    """
    rows = _levels(_pieces(spark, paths, key))
    walk = rows.withColumn("_w", _walk(F.col("_skel"), F.col("_depth")))
    rows = checkpoint(walk.select(*rows.columns, F.col("_w.opened").alias("_opened"), F.col("_w.marked").alias("_marked")))
    first = F.min(F.when(F.col("_skel") != "", F.struct("_block", "_at", F.substring("_skel", 1, 1).alias("c"))))["c"]
    files = rows.groupBy("source_file").agg(first.alias("_first"), F.max("_marked").alias("in_list"))
    # the wanted list counts in a document that is an object; in a list each element is read by itself
    files = files.withColumn("in_list", F.col("in_list") & (F.col("_first") == "{"))
    files = files.withColumn("_base", F.when(F.col("in_list"), 2).when(F.col("_first") == "[", 1).otherwise(0)).drop("_first")
    rows = rows.join(files, "source_file")
    rows = rows.withColumn("_begins", _walk(F.col("_skel"), F.col("_depth"), F.col("_base"))["begins"])
    # Known in the range: the last list that opened. Before the first one, it is that of an earlier range.
    upto = Window.partitionBy(*RANGE).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.when(~F.col("in_list"), F.lit(True)).when(F.col("_opened").isNotNull(), F.col("_opened") == MARK)
    rows = rows.withColumn("_want", F.last(wanted, ignorenulls=True).over(upto))
    sure, open_ = F.col("_begins") & F.col("_want"), F.col("_begins") & F.col("_want").isNull()
    count = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    rows = rows.withColumn("_sure", count(sure)).withColumn("_maybe", count(open_))
    ranges = rows.groupBy(*RANGE).agg(F.sum("_sure").alias("_s"), F.sum("_maybe").alias("_m"), F.max_by("_want", "_at").alias("_end"))
    before = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_past", F.coalesce(F.last("_end", ignorenulls=True).over(before), F.lit(False)))
    ranges = ranges.withColumn("_n", F.col("_s") + F.when(F.col("_past"), F.col("_m")).otherwise(0))
    ranges = ranges.select(*RANGE, "_past", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_s", F.sum("_sure").over(upto)).withColumn("_m", F.sum("_maybe").over(upto)).join(ranges, RANGE)
    want = F.coalesce("_want", "_past")
    number = F.col("_before") + F.col("_s") + F.when(F.col("_past"), F.col("_m")).otherwise(0) - 1
    rows = rows.filter(want & (F.col("_begins") | (F.col("_depth") > F.col("_base"))))
    # What stands before an element: the list's beginning where it opened in this piece, else a comma.
    lead = F.when(F.col("in_list") & (F.col("_opened") == MARK), F.regexp_replace("_text", rf'(?s)^.*?"{key}"\s*:\s*\[[^{{]*', ""))
    text = F.when(F.col("_begins"), F.coalesce(lead, F.regexp_replace("_text", r"^[^{]*", ""))).otherwise(F.col("_text"))
    piece = F.struct("_block", "_at", text.alias("text"))
    whole = rows.groupBy("source_file", "in_list", number.alias("source_number")).agg(F.sort_array(F.collect_list(piece)).alias("_p"))
    json = F.concat(F.array_join(F.transform("_p", lambda p: p["text"]), "}"), F.lit("}"))
    return whole.select("source_file", "source_number", "in_list", F.from_json(json, schema).alias("_row")).select(
        "source_file", "source_number", "in_list", "_row.*")
