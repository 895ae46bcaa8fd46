"""Reading, settling and small Spark helpers of this package."""
from __future__ import annotations

from collections.abc import Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark setting: shuffle files go when the query that made them ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that all executors share, and read again: lost executors don't replay it.

    The shuffle files behind the table go as soon as it is written, as nothing reads them again.
    """
    spark = df.sparkSession
    folder, before = shared_folder(spark), spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(folder)
    _folders[out] = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``settled`` returned. Only for those that nothing reads any more: what came of them is settled too."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders.pop(df))
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def typed(df: DataFrame, **wanted: str) -> DataFrame:
    """The named columns alone, cast; columns that are missing are null. Other columns, whatever their names, go."""
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])


def guarded(df: DataFrame, *needed: str) -> tuple[DataFrame, list]:
    """(``df`` whose other columns have neutral names, the columns under their own names again): nothing clashes in between."""
    inside = {c: c if c in needed else f"in_{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in inside.items()]), [F.col(n).alias(c) for c, n in inside.items()]


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of about ``n`` keys, chosen by the key's hash; all rows if there are no more."""
    rows = df.count()
    if rows <= n:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1_000_000)) < int(n / rows * 1_000_000))


def crc_mod(key: str, n: int):
    """crc32 of the key as text, modulo n; null stays null."""
    return F.pmod(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")), F.lit(n))


def arrow(batch: dict, schema: T.StructType | pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(batch, schema=schema)


def in_order(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``: a group never spreads over two of them."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.num_rows - 1
        same = np.ones(batch.num_rows, bool)
        for k in key:
            col = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            same &= col == col[last]
        differs = np.flatnonzero(~same)
        cut = int(differs[-1]) + 1 if len(differs) else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and any(
            held[-1].column(i)[held[-1].num_rows - 1] != batch.column(i)[last] for i in map(batch.schema.get_field_index, key)
        ):
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
