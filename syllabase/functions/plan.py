"""Small helpers that keep the plan in the shape it was written."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """Compute the columns of ``df`` once before later filters and projections use them.

    Without this the optimiser moves a filter below a chain of derived columns
    and repeats the whole chain inside the predicate. A generator over a
    one-element array stops that and costs no shuffle.
    """
    return df.select(F.inline(F.array(F.struct("*"))))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows evenly to all shuffle partitions, before work that is long for the few bytes of a row.

    A small file is one task, and AQE joins small partitions, both by their bytes; a number given by the user is left as it is.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
