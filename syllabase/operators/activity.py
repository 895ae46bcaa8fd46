"""Rows per day, week or month up to a given moment, empty buckets included."""
from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# unit: (buckets, date_trunc unit, step of the sequence)
BUCKETS = {"days": (7, "DAY", "INTERVAL 1 DAY"), "weeks": (4, "WEEK", "INTERVAL 7 DAYS"), "months": (12, "MONTH", "INTERVAL 1 MONTH")}


def bucket_starts(spark, unit: str, as_of: str) -> DataFrame:
    n, trunc, step = BUCKETS[unit]
    back = {"days": f"INTERVAL {n - 1} DAYS", "weeks": f"INTERVAL {7 * (n - 1)} DAYS", "months": f"INTERVAL {n - 1} MONTHS"}[unit]
    last = f"date_trunc('{trunc}', TIMESTAMP_NTZ'{as_of}')"
    return spark.range(1).select(
        F.posexplode(F.expr(f"sequence(CAST({last} AS DATE) - {back}, CAST({last} AS DATE), {step})")).alias("position", "bucket")
    ).withColumn("bucket", F.to_date("bucket"))


def first_bucket(unit: str, as_of: str) -> date:
    """Start of the oldest bucket, a literal the file scan can use."""
    day = datetime.fromisoformat(as_of).date()
    if unit == "days":
        return day - timedelta(days=6)
    if unit == "weeks":
        return day - timedelta(days=day.weekday() + 21)
    months = day.year * 12 + day.month - 1 - 11
    return date(months // 12, months % 12 + 1, 1)


def activity(df: DataFrame, ts: str, unit: str, as_of: str) -> DataFrame:
    """(position, bucket, label, total), oldest first.

    The start of the window filters the scan; later rows fall in no bucket.
    """
    _, trunc, _ = BUCKETS[unit]
    starts = bucket_starts(df.sparkSession, unit, as_of)
    first = F.lit(first_bucket(unit, as_of)).cast("timestamp_ntz")
    counts = (
        df.filter(F.col(ts) >= first)
        .groupBy(F.to_date(F.date_trunc(trunc, F.col(ts))).alias("bucket"))
        .agg(F.count("*").alias("total"))
    )
    label = {
        "days": F.date_format("bucket", "dd MMM"),
        "weeks": F.concat(F.lit("Week "), (F.col("position") + 1).cast("string")),
        "months": F.date_format("bucket", "MMM"),
    }[unit]
    return (
        starts.join(counts, "bucket", "left")
        .select("position", "bucket", label.alias("label"), F.coalesce("total", F.lit(0)).alias("total"))
        .orderBy("position")
    )
