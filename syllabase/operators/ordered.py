"""Values carried along an order, safe for one very long key."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint


def numbered(df: DataFrame, key: str, order: list[str], into: str) -> DataFrame:
    """Add the position (0, 1, …) of each row within its key.

    Rows are cut into ranges of (key, order), numbered within each range and moved on by the sizes of the key's earlier ranges, so a
    key with a third of all rows is spread over many tasks. The ranges are checkpointed: a retried task finds the same ones.
    """
    cut = checkpoint(df.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))
    sizes = cut.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order))
    return cut.withColumn("_in", inside).join(sizes, [key, "_range"]).withColumn(into, F.col("_before") + F.col("_in") - 1).drop(
        "_before", "_in", "_range")


def carry_last(df: DataFrame, key: str, order: str, value: Column, into: str, width: int, strict: bool = False) -> DataFrame:
    """Add the last non-null ``value`` at or before each row (before it if ``strict``).

    ``order`` is a whole number, unique within the key. Rows are cut into stretches
    of ``width`` order steps: a window fills each stretch, a second small window
    over one row per stretch hands the last value on. A key with a third of all
    rows is spread over as many tasks as it has stretches.
    """
    rows = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(order) / width))
    upto = (Window.unboundedPreceding, -1 if strict else Window.currentRow)
    inside = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(*upto)
    filled = rows.withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
    ends = (
        rows.filter(F.col("_v").isNotNull()).groupBy(key, "_b")
        .agg(F.max_by("_v", order).alias("_end"))
    )
    steps = rows.select(key, "_b").distinct().join(ends, [key, "_b"], "left")
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("_past", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    out = filled.join(steps, [key, "_b"])
    return out.withColumn(into, F.coalesce("_in", "_past")).drop("_v", "_b", "_in", "_past")
