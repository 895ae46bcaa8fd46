"""Change-driven jobs. Each function takes a batch or a streaming frame unless it says otherwise."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X
from ..operators.ordered import carry_last
from ..session import shared_folder

# Notification texts.
NEW_EVENT = "Новое мероприятие '%s'"
ACCEPTED = "Ваша заявка на мероприятие '%s' принята. Номер билета: %s"
REJECTED = "Ваша заявка на мероприятие '%s' отклонена."
TEAM_ACCEPTED = "Ваша командная заявка на мероприятие '%s' одобрена."
TEAM_REJECTED = "Ваша командная заявка на мероприятие '%s' отклонена."


def fan_out(events: DataFrame, likes: DataFrame) -> DataFrame:
    """One notification per new event and distinct follower of its institution."""
    followers = likes.select("institution_id", "user_id").distinct()
    return events.join(followers, "institution_id").select(
        "event_id", "user_id", X.message(NEW_EVENT, F.col("event_name")).alias("message")
    )


def _status_message(status: Column, event: Column, ticket: Column) -> Column:
    return F.when(status == "Accepted", F.format_string(ACCEPTED, event, ticket)).when(
        status == "Rejected", F.format_string(REJECTED, event)
    )


def status_notices(changes: DataFrame, width: int = 10_000) -> DataFrame:
    """Messages for status changes (batch): accepted or rejected, and not what it was before.

    changes: application_id, user_id, event_id, event_name, ticket_code, n, status;
    n numbers the changes of all applications or of one, unique per application.
    """
    rows = carry_last(changes, "application_id", "n", F.col("status"), "previous", width, strict=True)
    moved = ~F.col("status").eqNullSafe(F.coalesce("previous", F.lit("Pending")))
    text = _status_message(F.col("status"), F.col("event_name"), F.col("ticket_code"))
    return rows.filter(moved).select("application_id", "n", "user_id", "event_id", text.alias("message")).filter("message IS NOT NULL")


#: Notices, and members, of a cell of ``team_notices``: a million rows of its result.
CELL = 1024


def team_notices(changes: DataFrame, members: DataFrame, width: int = 10_000) -> DataFrame:
    """Messages to every member when a team application is approved or rejected (batch).

    The result has a row per notice and member, so it grows with the product of both. Notices and members of an application are
    cut by hash into pieces of some CELL rows; each two pieces meet in a cell of their own, and cells are dealt to all tasks.
    """
    rows = carry_last(changes, "application_id", "n", F.col("status"), "previous", width, strict=True)
    moved = ~F.col("status").eqNullSafe(F.coalesce("previous", F.lit("pending")))
    text = F.when(F.col("status") == "approved", F.format_string(TEAM_ACCEPTED, "event_name")).when(
        F.col("status") == "rejected", F.format_string(TEAM_REJECTED, "event_name")
    )
    rows = rows.filter(moved).select("application_id", "n", "event_id", text.alias("message")).filter("message IS NOT NULL")
    people = members.select("application_id", "user_id").distinct()
    # all changes are counted: no fewer than the notices, and without their windows
    sizes = _pieces(changes, "_rows").join(_pieces(people, "_people"), "application_id")
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    piece = lambda col, count: F.pmod(F.xxhash64(col), F.col(count))
    cells = ["application_id", "_row", "_person"]
    parts = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.join(sizes, "application_id").withColumn("_row", piece("n", "_rows")).withColumn("_person", each("_people"))
    people = people.join(sizes, "application_id").withColumn("_person", piece("user_id", "_people")).withColumn("_row", each("_rows"))
    out = rows.repartition(parts, *cells).join(people.repartition(parts, *cells), cells)
    return out.select("application_id", "n", "event_id", "message", "user_id")


def _pieces(df: DataFrame, into: str) -> DataFrame:
    """How many pieces of some CELL rows each application has."""
    return df.groupBy("application_id").agg(F.ceil(F.count("*") / CELL).alias(into))


MOVED = "application_id long, user_id long, event_id long, event_name string, ticket_code string, n long, status string"
#: Number of a row that closes a feed: it lies behind all others, and as milliseconds it is still a date that Python knows.
END = 1 << 47
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


#: Numbers that share an entry of the state, and rows of one application that are held in Python at a time.
BLOCK, HELD = 4096, 50_000
#: A change on its way through Python, which reads number and status; the rest is one text there, as each cell of a row costs time.
REST = "user_id long, event_id long, event_name string, ticket_code string"
PACKED = "application_id long, n long, status string, rest string"


class _InOrder(StatefulProcessor):
    """Changes of one application in the order of ``n``, one by one.

    A change is held until no earlier one can come any more; the state has the last status and the held ones, those of BLOCK numbers
    that came together as one entry of columns, as each call for the state costs a trip to the JVM. Python holds one block, or HELD rows.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string")
        self.parts = handle.getValueState("parts", "parts long")
        self.held = handle.getMapState("held", "block long, part long", "n array<long>, status array<string>, rest array<string>")

    def handleInputRows(self, key, rows, timerValues):
        latest, fresh, count = None, {}, 0
        for r in rows:
            fresh.setdefault(r.n // BLOCK, []).append((r.n, r.status, r.rest))
            latest = r.n if latest is None else max(latest, r.n)
            count += 1
            if count == HELD:
                self._hold(fresh)
                fresh, count = {}, 0
        self._hold(fresh)
        if latest is not None:
            self.handle.registerTimer(latest + 1)
        yield from self._settled(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._settled(key, timerValues)

    def _hold(self, fresh):
        if fresh:
            part = self.parts.get()[0] + 1 if self.parts.exists() else 0
            self.parts.update((part,))
            for block, rows in fresh.items():
                self.held.updateValue((block, part), tuple(list(c) for c in zip(*rows)))

    def _settled(self, key, timerValues):
        until = timerValues.getCurrentWatermarkInMs()
        blocks = {}
        for block, part in sorted(tuple(k) for k in self.held.keys() if k[0] * BLOCK + 1 <= until):
            blocks.setdefault(block, []).append(part)
        if not blocks:
            return
        before = first = self.last.get()[0] if self.last.exists() else "Pending"
        for block, parts in blocks.items():
            # of rows with one number the last that came counts
            rows = {r[0]: r for part in parts for r in zip(*self.held.getValue((block, part)))}
            due = sorted(n for n in rows if n + 1 <= until)
            if not due:
                continue
            for part in parts:
                self.held.removeKey((block, part))
            for n in due:
                _, status, rest = rows.pop(n)
                if status != before:
                    before = status
                    yield Row(application_id=key[0], n=n, status=status, rest=rest)
            if rows:
                self.held.updateValue((block, parts[0]), tuple(list(c) for c in zip(*rows.values())))
        if before != first:
            self.last.update((before,))

    def close(self) -> None:
        pass


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB, as ``status_stream`` needs; ``spark`` stays as it is."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def status_stream(changes: DataFrame, late: int = 10_000) -> DataFrame:
    """Streaming form of ``status_notices``: each change is judged against the one before it by ``n``, in whatever batch it came.

    ``n`` (0 or more and below END, as in ``status_notices``) is the stream's clock: a change is settled once one has come whose number is
    ``late`` higher, in any application. One that comes later than that is dropped. The end of a feed is settled by a row with
    the number END (``run_status_stream``). Needs a session of ``state_session``.
    """
    rest = F.to_json(F.struct(*[c.split()[0] for c in REST.split(", ")])).alias("rest")
    timed = changes.select("application_id", "n", "status", rest, F.timestamp_millis(F.col("n") + 1).alias("_at"))
    moved = timed.withWatermark("_at", f"{late} milliseconds").groupBy("application_id").transformWithState(_InOrder(), PACKED, "append", "EventTime")
    moved = moved.select("application_id", "n", "status", F.from_json("rest", REST).alias("_r")).select("application_id", "n", "status", "_r.*")
    text = _status_message(F.col("status"), F.col("event_name"), F.col("ticket_code"))
    return moved.select("application_id", "n", "user_id", "event_id", text.alias("message")).filter("message IS NOT NULL")


def run_status_stream(changes: DataFrame, late: int = 10_000) -> DataFrame:
    """Notices of all changes that are there now: the stream over them, then, from its checkpoint, over the row that closes them."""
    spark, folder = changes.sparkSession, shared_folder(changes.sparkSession)
    end = folder + "/end"
    spark.createDataFrame([], MOVED).write.parquet(end)
    cols = [c.split()[0] for c in MOVED.split(", ")]
    whole = changes.select(*cols).unionByName(spark.readStream.schema(MOVED).parquet(end))
    run_available(status_stream(whole, late), folder)
    spark.createDataFrame([(None, None, None, None, None, END, None)], MOVED).coalesce(1).write.mode("append").parquet(end)
    return run_available(status_stream(whole, late), folder)


def first_application(stream: DataFrame, ts: str = "created_at", delay: str = "30 days") -> DataFrame:
    """First application per event and user within the watermark (streaming)."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["event_id", "user_id"])


def activity_stream(stream: DataFrame, ts: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Rows per time window, each window once it is closed by the watermark (streaming)."""
    counts = stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("total"))
    return counts.select(F.col("w.start").alias("bucket"), "total")


def activity_counts(stream: DataFrame, ts: str, width: str = "1 day", delay: str | None = None) -> DataFrame:
    """Rows per time window, open windows too, for ``run_upserts`` (streaming).

    Without ``delay`` every row counts, however late it comes, and the state holds a number for each window there is; with it, windows
    that far behind leave the state, and rows later than that are not counted.
    """
    timed = stream.withWatermark(ts, delay) if delay else stream
    return timed.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("total")).select(F.col("w.start").alias("bucket"), "total")


def run_available(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Drive a stream over all that is there now and read its parquet output. A second run with the folder goes on where the first ended."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", folder + "/state")
        .trigger(availableNow=True).start(folder + "/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder + "/rows")


def run_upserts(stream: DataFrame, key: list[str], folder: str | None = None) -> DataFrame:
    """Drive a stream in update mode over all that is there now; of each key, the row of the latest batch.

    A batch has a folder of its own and replaces it if it runs again, so a restart or a repeated batch changes nothing.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    rows = folder + "/rows"

    def upsert(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(upsert).outputMode("update").option("checkpointLocation", folder + "/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in key]
    kept = spark.read.schema(T.StructType(stream.schema.fields + [T.StructField("batch", T.LongType())])).parquet(rows)
    latest = kept.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return latest.select(*[F.col(c) if c in key else F.col(f"r.{c}") for c in stream.columns])


def read_table_stream(spark: SparkSession, folder: str, table: str, files_per_batch: int = 8) -> DataFrame:
    """A parquet table of the data folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", f"{table}*.parquet").parquet(folder)
    )
