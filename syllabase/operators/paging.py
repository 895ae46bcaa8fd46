"""Deep pages without reading what lies before them: an index of key ranges, and pages that start after a key."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

#: A sort key: column and whether it rises. Nulls come first where it rises, last where it falls.
Order = list[tuple[str, bool]]


def _sorted(order: Order) -> list[Column]:
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order]


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(folder + "/cut").schema.add("_at", T.IntegerType())
    return spark.read.schema(schema).parquet(folder + "/rows")


def build_index(df: DataFrame, order: Order, folder: str | None = None, ranges: int = 200) -> str:
    """Write ``df`` in ``ranges`` key ranges, each sorted and numbered from 0, and the number of rows in each; returns the folder.

    ``order`` must be unique, so that every reader sees the same pages. A range lies in a folder of its own, so a reader opens the
    ranges of its page alone. A task numbers the rows of a range: take as many ranges as keep one small.
    """
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    cut = df.repartitionByRange(ranges, *_sorted(order)).withColumn("_range", F.spark_partition_id())
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*_sorted(order))) - 1
    # Written first, so that a task that runs again finds the same ranges.
    cut.write.parquet(folder + "/cut")
    rows = spark.read.schema(cut.schema).parquet(folder + "/cut").withColumn("_at", inside)
    rows.write.partitionBy("_range").parquet(folder + "/rows")
    sizes = _rows(spark, folder).groupBy("_range").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sizes.coalesce(1).write.parquet(folder + "/sizes")
    return folder


def seek_page(spark: SparkSession, folder: str, page: int, per_page: int, order: Order) -> DataFrame:
    """One page (from 1) of an index with the totals of ``paginate``; only the ranges that it touches are read.

    The sizes have a row per range. A page beyond the last one has no rows.
    """
    start = (page - 1) * per_page
    sizes = spark.read.parquet(folder + "/sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    touched = sizes.filter((F.col("before") < start + per_page) & (F.col("before") + F.col("n") > start)).orderBy("before").collect()
    rows = _rows(spark, folder)
    parts = [rows.filter((F.col("_range") == r["_range"]) & F.col("_at").between(start - r["before"], start + per_page - r["before"] - 1)) for r in touched]
    out = reduce(DataFrame.unionByName, parts) if parts else rows.filter("false")
    out = out.drop("_range", "_at").orderBy(*_sorted(order))
    return out.withColumns({"total": F.lit(total).cast("bigint"), "per_page": F.lit(per_page), "last_page": F.lit(max(-(-total // per_page), 1)).cast("bigint")})


def page_after(df: DataFrame, order: Order, last: list | None, per_page: int) -> DataFrame:
    """The ``per_page`` rows that follow the row with the keys ``last`` (None: the first ones).

    The condition is one on plain columns, so it reaches the scan; of what is left each task keeps ``per_page`` rows.
    """
    if last is not None:
        after, same = F.lit(False), F.lit(True)
        for (c, up), v in zip(order, last):
            key = F.lit(v).cast(df.schema[c].dataType)
            if v is None:
                beyond = F.col(c).isNotNull() if up else F.lit(False)
            else:
                beyond = F.col(c) > key if up else (F.col(c) < key) | F.col(c).isNull()
            after, same = after | (same & beyond), same & F.col(c).eqNullSafe(key)
        df = df.filter(after)
    return df.orderBy(*_sorted(order)).limit(per_page)
