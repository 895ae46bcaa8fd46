"""Session settings and lineage cuts shared by every job."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", name: str = "syllabase") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Parquet files grow several times when read; without this a large side looks
        # small enough to broadcast and its join runs in the few tasks of the other side.
        .config("spark.sql.sources.fileCompressionFactor", "4.0")
        .config("spark.driver.memory", os.environ.get("SYLLABASE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def _scratch_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a local session may go without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="syllabase-")
    return folder


def shared_folder(spark: SparkSession) -> str:
    """A new folder for intermediate tables and stream output."""
    return os.path.join(_scratch_root(spark), f"table-{uuid.uuid4().hex}")


#: Spark setting: shuffle files go when the query that made them ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint. The shuffle files behind it go once it is written, as nothing reads them again."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_scratch_root(spark))
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own: that of ``df`` keeps its files
    finally:
        spark.conf.set(CLEAN_UP, before)


def discard(*tables: DataFrame) -> None:
    """Delete checkpoints. Only those that nothing reads any more: what came of them is checkpointed too."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
