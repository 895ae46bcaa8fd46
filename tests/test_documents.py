"""Files of one JSON document, cut into byte ranges, against a plain reading."""
import json
import random

import pytest
from pyspark.sql import functions as F

from syllabase.sources import catalog as C
from syllabase.sources.documents import read_documents

SCHEMA = "name string, items array<struct<n:string,m:map<string,string>>>, extra string"
BITS = ['a', '}', '{', '"', '\\', ']', '[', '"institutions": [', 'é', 'Қ', '\n', ',', ':', ' ', '\\"', '}}"']


@pytest.fixture()
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def text(rng):
    return "".join(rng.choice(BITS) for _ in range(rng.randrange(12)))


def element(rng):
    items = [{"n": text(rng), "m": {text(rng): text(rng) for _ in range(rng.randrange(3))}} for _ in range(rng.randrange(4))]
    out = {"name": text(rng), "items": items, "extra": text(rng)}
    return {k: v for k, v in out.items() if rng.random() < 0.8}


def plain(x):
    return json.dumps([x.get("name"), x.get("items"), x.get("extra")], sort_keys=True)


def got(df):
    rows = df.orderBy("source_file", "source_number").collect()
    out = {}
    for r in rows:
        items = None if r["items"] is None else [{"n": i["n"], "m": i["m"]} for i in r["items"]]
        assert r["source_number"] == len(out.setdefault(r["source_file"].rsplit("/", 1)[1], []))
        out[r["source_file"].rsplit("/", 1)[1]].append(json.dumps([r["name"], items, r["extra"]], sort_keys=True))
    return out


def test_elements_of_cut_documents(spark, tmp_path, small_ranges):
    rng = random.Random(5)
    want = {}
    for k in range(12):
        rows = [element(rng) for _ in range(rng.choice([1, 3, 25]))]
        indent = rng.choice([None, 2])
        if k % 3 == 0:
            doc = rows
        elif k % 3 == 1:
            other = [{"name": "not wanted", "institutions": [{"name": "deep"}]} for _ in range(rng.randrange(4))]
            doc = {"meta": {"a": [1, {"b": 2}]}, "before": other, "institutions": rows, "after": other, "last": {"x": {"y": "}"}}}
        else:
            rows = rows[:1]
            doc = rows[0]
        name = f"f{k:02d}.json"
        (tmp_path / name).write_text(json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=indent) + rng.choice(["", "\n", " \n"]))
        want[name] = [plain(r) for r in rows]
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text('{"institutions": [], "after": [{"name": "x"}]}')
    (tmp_path / "nolist.json").write_text("[]")
    df = read_documents(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema, "institutions")
    assert got(df) == want
    raw = spark.read.option("lineSep", "}").text(str(tmp_path)).groupBy(F.col("_metadata.file_path")).agg(
        F.countDistinct("_metadata.file_block_start").alias("n"))
    assert raw.agg(F.max("n")).first()[0] > 10  # one document, many ranges


def test_catalog_is_the_same_by_either_reading(spark, tmp_path, small_ranges):
    rng = random.Random(7)
    rows = [{"id": i, "name": f"{i} {text(rng)}", "error": rng.choice(["", None, "x"]),
             "specialties": [{"name": text(rng), "code": "6B1"} for _ in range(rng.randrange(5))]} for i in range(40)]
    (tmp_path / "a.json").write_text(json.dumps({"institutions": rows}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps([*rows, {"institutions": rows[:3]}]))
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text(json.dumps({"institutions": rows}) + "\n")
    (tmp_path / "lines" / "b.json").write_text("\n".join(json.dumps(r) for r in [*rows, {"institutions": rows[:3]}]))
    columns = [F.regexp_extract("source_file", "[^/]+$", 0).alias("file"), "source_row", "source_pos", "id", "name", "specialties"]
    one = C.read_catalog(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], lines=False).select(*columns)
    two = C.read_catalog(spark, str(tmp_path / "lines"), lines=True).select(*columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
