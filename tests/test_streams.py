"""Streams against their batch forms, with late rows and repeats across batches."""
import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from syllabase.streaming import notices as N


def feed(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def change(app, n, status):
    return app, app * 10, 5, "День", f"T{app}", n, status


def notices(spark, folder, batches, late):
    own = N.state_session(spark)
    return {tuple(r) for r in N.run_status_stream(feed(own, folder, batches, N.MOVED), late).collect()}


def test_status_stream_equals_batch(spark, tmp_path):
    batches = [
        [change(1, 1, "Accepted"), change(2, 2, "Pending"), change(1, 3, "Accepted")],
        [change(1, 4, "Rejected"), change(2, 5, "Accepted")], [change(1, 6, "Pending"), change(1, 7, "Rejected"), change(2, 8, "Accepted")],
    ]
    got = notices(spark, tmp_path / "in", batches, 2)
    batch = N.status_notices(spark.createDataFrame(sum(batches, []), N.MOVED), width=3)
    assert got == {tuple(r) for r in batch.collect()}
    assert {(r[0], r[1]) for r in got} == {(1, 1), (1, 4), (1, 7), (2, 5)}


def test_a_lower_number_in_a_later_batch_is_put_in_its_place(spark, tmp_path):
    rng = random.Random(2)
    rows = [change(rng.randrange(4), n, rng.choice(["Pending", "Accepted", "Rejected"])) for n in range(120)]
    mixed = sorted(rows, key=lambda r: r[5] + rng.randrange(30))
    batches = [mixed[i:i + 40] for i in range(0, 120, 40)]
    assert min(r[5] for r in batches[1]) < max(r[5] for r in batches[0])
    got = notices(spark, tmp_path / "in", batches, 60)
    assert got == {tuple(r) for r in N.status_notices(spark.createDataFrame(rows, N.MOVED), width=10).collect()}


def test_a_change_beyond_the_wait_is_dropped(spark, tmp_path):
    batches = [[change(1, 1, "Accepted"), change(2, 100, "Accepted")], [change(1, 101, "Rejected")], [change(1, 2, "Rejected"), change(2, 102, "Pending")]]
    assert {(r[0], r[1]) for r in notices(spark, tmp_path / "in", batches, 10)} == {(1, 1), (2, 100), (1, 101)}


def test_first_application_drops_repeats_across_batches(spark, tmp_path):
    t = datetime(2024, 1, 1)
    batches = [[(1, 1, t), (1, 1, t + timedelta(hours=1)), (1, 2, t)], [(1, 1, t + timedelta(days=1)), (2, 1, t)]]
    stream = feed(spark, tmp_path / "in", batches, "event_id long, user_id long, created_at timestamp")
    got = N.run_available(N.first_application(stream)).collect()
    assert sorted((r["event_id"], r["user_id"]) for r in got) == [(1, 1), (1, 2), (2, 1)]


def test_activity_stream_ignores_late_rows(spark, tmp_path):
    d = lambda day, hour=0: (datetime(2024, 1, day, hour),)
    batches = [[d(1, 5), d(1, 6), d(2, 1)], [d(4, 0)], [d(1, 7), d(4, 3)]]
    stream = feed(spark, tmp_path / "in", batches, "ts timestamp")
    got = {(r["bucket"].day, r["total"]) for r in N.run_available(N.activity_stream(stream, "ts")).collect()}
    assert got == {(1, 2), (2, 1)}


def test_daily_counts_are_whole_after_a_restart(spark, tmp_path):
    d = lambda day, hour=0: (datetime(2024, 1, day, hour),)
    batches = [[d(1, 5), d(1, 6), d(2, 1)], [d(4, 0)]]
    counts = lambda: N.activity_counts(feed(spark, tmp_path / "in", [], "ts timestamp"), "ts")
    read = lambda df: {(r["bucket"].day, r["total"]) for r in df.collect()}
    feed(spark, tmp_path / "in", batches, "ts timestamp")
    folder = str(tmp_path / "out")
    assert read(N.run_upserts(counts(), ["bucket"], folder)) == {(1, 2), (2, 1), (4, 1)}
    spark.createDataFrame([d(1, 7), d(4, 3), d(5, 0)], "ts timestamp").write.parquet(str(tmp_path / "in" / "late"))
    assert read(N.run_upserts(counts(), ["bucket"], folder)) == {(1, 3), (2, 1), (4, 2), (5, 1)}
    assert read(N.run_upserts(counts(), ["bucket"], folder)) == {(1, 3), (2, 1), (4, 2), (5, 1)}
    # a batch whose commit was lost runs again and replaces its own rows
    last = max((tmp_path / "out" / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)
    assert read(N.run_upserts(counts(), ["bucket"], folder)) == {(1, 3), (2, 1), (4, 2), (5, 1)}


def test_team_notice_reaches_each_member_once(spark):
    changes = spark.createDataFrame([(1, 3, "Олимпиада", 1, "approved"), (1, 3, "Олимпиада", 2, "approved")], "application_id long, event_id long, event_name string, n long, status string")
    members = spark.createDataFrame([(1, 7), (1, 8), (1, 8)], "application_id long, user_id long")
    got = N.team_notices(changes, members).collect()
    assert sorted(r["user_id"] for r in got) == [7, 8] and "одобрена" in got[0]["message"]


def test_team_notices_of_one_large_application_are_made_by_all_tasks(spark):
    rows = [(1, 3, f"Олимпиада {n % 3}", n, "approved" if n % 2 else "rejected") for n in range(300)] + [(2, None, "А", 5, "approved"), (3, 1, "А", 5, "approved"), (None, 1, "А", 6, "approved")]
    people = [(1, u) for u in range(200)] * 2 + [(2, None), (2, 7), (2, None), (4, 1), (None, 1)]
    changes = spark.createDataFrame(rows, "application_id long, event_id long, event_name string, n long, status string")
    members = spark.createDataFrame(people, "application_id long, user_id long")
    limit, cell = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), getattr(N, "CELL", None)
    try:
        # as for members too many to be sent to every task, with cells as much smaller
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        N.CELL = 20
        got = N.team_notices(changes, members).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        N.CELL = cell
    text = {"approved": N.TEAM_ACCEPTED, "rejected": N.TEAM_REJECTED}
    want = Counter((a, n, e, text[s] % name, u) for a, e, name, n, s in rows for b, u in set(people) if a is not None and a == b)
    assert Counter(tuple(r)[:5] for r in got) == want
    shares = Counter(r["part"] for r in got if r["application_id"] == 1)
    assert len(shares) == 4 and max(shares.values()) < len(got) / 2


def test_fan_out_is_one_notice_per_follower(spark):
    events = spark.createDataFrame([(1, 5, "A"), (2, 6, "B")], "event_id long, institution_id long, event_name string")
    likes = spark.createDataFrame([(5, 1), (5, 1), (5, 2)], "institution_id long, user_id long")
    got = N.fan_out(events, likes).select("event_id", "user_id", F.col("message")).collect()
    assert sorted((r[0], r[1]) for r in got) == [(1, 1), (1, 2)]
