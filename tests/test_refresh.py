"""Identity of file rows and ids of new institutions."""
import json

from pyspark.sql import functions as F

from syllabase.plans import refresh
from syllabase.sources import catalog as C

EXISTING = "institution_id long, name string, type string, location string, address string, website string"
PROGRAMS = [{"name": "Право и закон", "cost": 5, "code": "6B1"}]


def rows_of(spark, path):
    return refresh.keyed_rows(C.read_catalog(spark, str(path), lines=True))


def test_equal_rows_and_nulls_in_other_fields_stay_apart(spark, tmp_path):
    base = {"name": "A", "type": "college", "location": "x", "website": "http://a.kz", "programs": PROGRAMS}
    rows = [base, base, {**base, "location": None}, {**base, "website": None}, {**base, "location": None, "website": "x"},
            {**base, "location": "http://a.kz", "website": None}, {**base, "type": None}]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    (tmp_path / "b.json").write_text(json.dumps({"institutions": rows[:3]}) + "\n\n" + json.dumps({"institutions": rows[3:]}))
    got = rows_of(spark, tmp_path)
    assert got.count() == 14 and got.select("incoming_id").distinct().count() == 14
    place = {(r["source_file"][-6:], r["source_row"], r["source_pos"]) for r in got.collect()}
    assert place == {("a.json", i, 0) for i in range(7)} | {("b.json", 0, i) for i in range(3)} | {("b.json", 1, i) for i in range(4)}
    programs = C.unnest_programs(got, keep=("incoming_id",))
    out = refresh.rebuild_catalog(got, programs, spark.createDataFrame([], EXISTING))
    assert out["placed"].count() == 14 and out["matches"].count() == 14


def test_places_are_the_same_however_a_file_is_cut(spark, tmp_path):
    lines = [json.dumps({"name": f"N{i}", "location": "x" * (i % 50), "programs": PROGRAMS * (i % 3)}) for i in range(500)]
    (tmp_path / "a.json").write_text("\n".join(lines))
    want = {(f"N{i}", i) for i in range(500)}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("1g", "4k", "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            rows = rows_of(spark, tmp_path)
            assert {(r["name"], r["source_row"]) for r in rows.collect()} == want
            assert rows.rdd.getNumPartitions() > 3 or size == "1g"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_new_ids_go_on_from_the_known_ones_and_are_shared_by_alike_rows(spark):
    existing = spark.createDataFrame([(7, "Назарбаев Университет", "university", None, None, None)], EXISTING)
    names = ["Новый Университет", "«новый университет»", "Другой", "Назарбаев Университет", "Ещё один"]
    incoming = spark.createDataFrame([(i, n, "university", None, None, None) for i, n in enumerate(names)], EXISTING.replace("institution_id", "incoming_id"))
    programs = incoming.select("incoming_id", F.lit(0).alias("pos"), F.concat(F.lit("Право "), "name").alias("name"), F.lit(None).cast("string").alias("global_specialty"),
                               F.lit(None).cast("string").alias("code"), F.lit(1.0).alias("cost"), F.lit(4).alias("duration"))
    out = refresh.rebuild_catalog(incoming, programs, existing)
    ids = {r["incoming_id"]: r["institution_id"] or r["new_id"] for r in out["matches"].collect()}
    assert ids == {0: 8, 1: 8, 2: 9, 3: 7, 4: 10}
    assert {r["institution_id"] for r in out["links"].collect()} == {7, 8, 9, 10}
