"""The pipeline's stages against brute force on a small fixture, and whole runs on odd tables."""
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import brute_hits, brute_sets

from syllabase.llm import resample


@pytest.fixture()
def corpus(spark, tmp_path):
    """A folder of tables: clean prose, junk, copies, near copies, shared passages and benchmark passages."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("aeiou") + rng.choice("bdlmnrst") for _ in range(rng.randrange(1, 4))) for _ in range(500)]
    line = lambda n=12: " ".join(rng.choice(vocabulary) for _ in range(n))
    prose = lambda n=8: "\n".join(line() for _ in range(n))
    bench = [(k, line(25)) for k in range(5)]
    passage = "\n".join(line() for _ in range(8))
    rows = [(k, prose()) for k in range(60)]
    rows += [(100 + k, " | ".join(f"{rng.choice(vocabulary)}%%%" for _ in range(60))) for k in range(12)]
    rows += [(200 + k, rows[k][1]) for k in range(5)]
    rows += [(300 + k, prose(4) + "\n" + passage + "\n" + prose(4)) for k in range(6)]
    rows += [(400 + k, prose(3) + "\n" + bench[k][1] + " " + line() + "\n" + prose(3)) for k in range(5)]
    one = rows[10][1].split()
    rows += [(500, " ".join([*one[:50], "zz", *one[51:]])), (600, None), (601, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(k, 0 if 100 <= k < 200 else 1, 0) for k, t in rows if k % 2 == 0 or 100 <= k < 200]
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows, bench, passage


def test_stages(spark, corpus):
    folder, rows, bench, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, folder).cache()
    kept = {r["doc_id"] for r in good.collect()}
    assert good.columns == columns and not kept & set(range(100, 112)) and kept >= set(range(60))

    lined = stages["line dedup"](spark, good, folder).cache()
    texts = {r["doc_id"]: r["text"] for r in lined.collect()}
    assert lined.columns == columns and not set(texts) & set(range(200, 205)) and set(texts) >= set(range(60))
    assert [k for k in texts if texts[k] and passage in texts[k]] == [300]
    assert lined.filter(F.length("text") != F.col("n_chars")).count() == 0

    apart = stages["n-gram Jaccard join"](spark, lined, folder).cache()
    want = {k for k, (n, root) in brute_sets(texts.items(), 80, 5).items() if root == k}
    assert apart.columns == columns and {r["doc_id"] for r in apart.collect()} == want and 500 not in want

    clean = stages["benchmark decontamination"](spark, apart, folder).cache()
    want = {r["doc_id"] for r in apart.collect() if not brute_hits(r["text"], bench)[1]}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == want and not want & set(range(400, 405))

    packed = stages["best-fit packing"](spark, clean, folder)
    assert {r["doc_id"] for r in packed.collect()} == want
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect()))


def test_stages_on_no_rows(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
        if "piece" in docs.columns:
            break


def test_same_draw_each_time(spark, corpus):
    folder = corpus[0]
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    one, two = (sorted(str(r[0]) for r in resample.resampled(d, labels).select("doc_id").collect()) for d in (docs, docs.repartition(5)))
    assert one == two
