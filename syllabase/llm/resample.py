"""Quality classifier by importance resampling (dealt operator 3).

Two bags of hashed word n-grams are generative models of target text (labelled as good) and of raw text (the whole corpus). A
text's mean log ratio of the two is turned into importance weights, the odds of being target text; Gumbel noise on their
logarithms and the k largest keys draw k texts without replacement in proportion to their weights.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, guarded, settled, typed
from .textbytes import PUNCTUATED, column_bytes, runs, slices, tokens

BUCKETS = 1 << 16
#: Bound of the labelled sample for the target model and the calibration.
LABELLED = 20_000
#: Scale of the Gumbel noise. At 1 the draw follows the weights; below 1 it follows their powers (weight ** (1 / TEMPERATURE)).
TEMPERATURE = 0.25
#: Largest logarithm of a weight, either way.
CLIP = 12.0
#: N-grams of evidence that the prior odds stand for, so that a text of a few words isn't judged by them alone.
PRIOR_GRAMS = 10.0


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Buckets of the words, punctuation marks and pairs of neighbours of each text."""
    data, off = column_bytes(column)
    for first, last, part, own in slices(data, off):
        _, _, hashes, bounds = tokens(part, own, PUNCTUATED)
        pairs, pair_bounds = runs(hashes, bounds, 2)
        one, two = (hashes % np.uint64(BUCKETS)).astype(np.int64), (pairs % np.uint64(BUCKETS)).astype(np.int64)
        for d in range(last - first):
            yield np.concatenate([one[bounds[d]:bounds[d + 1]], two[pair_bounds[d]:pair_bounds[d + 1]]])


def _bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's texts by bucket and side (1: labelled as good, 0: other)."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for side, own in zip(batch.column(1).to_pylist(), features(batch.column(0))):
            if side not in total:
                total[side] = np.zeros(BUCKETS, np.int64)
            total[side] += np.bincount(own, minlength=BUCKETS)
    for side, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), side, np.int32)), pa.array(at), pa.array(n[at])], names=["side", "bucket", "n"])


def _ratio(counts: DataFrame) -> np.ndarray:
    """Log ratio of each bucket under a smoothed target and raw model; BUCKETS numbers."""
    n = np.zeros((2, BUCKETS))
    for r in counts.collect():  # at most 2 * BUCKETS rows
        n[r["side"], r["bucket"]] = r["n"]
    raw, target = n[0] + n[1], n[1]
    base = (raw + 1) / (raw.sum() + BUCKETS)
    smooth = max(1.0, min(BUCKETS, target.sum() / 10))
    return (np.log((target + smooth * base) / (target.sum() + smooth)) - np.log(base)).astype(np.float64)


def _mean_ratio(column: pa.Array, ratio: np.ndarray) -> tuple[list[float], list[int]]:
    """(mean ratio, number of n-grams) of each text."""
    got = [(float(ratio[x].mean()) if len(x) else 0.0, len(x)) for x in features(column)]
    return [x for x, _ in got], [n for _, n in got]


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> dict:
    """Both models, and the weights' calibration on labelled texts.

    The raw model counts every text of ``docs``; labels are a sample of about ``labelled``, chosen by hash and broadcast as
    bounded. A doc_id with several labels has its smallest. Without good or without bad labels all weights are equal.
    """
    spark = docs.sparkSession
    usable = typed(labels, doc_id="long", quality="int").filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = F.broadcast(bounded_sample(usable, "doc_id", labelled))
    rows = typed(docs, doc_id="long", text="string").join(sample, "doc_id", "left")
    good = F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))
    counts = rows.select("text", good.alias("side")).mapInArrow(_bag, "side int, bucket bigint, n bigint")
    ratio = _ratio(counts.groupBy("side", "bucket").agg(F.sum("n").alias("n")))
    shared = spark.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_mean_ratio(batch.column(0), shared.value)[0], pa.float64()), batch.column(1)], names=["x", "y"])

    seen = rows.filter("quality is not null and text is not null").select("text", F.col("quality").alias("y")).mapInArrow(
        run, "x double, y int").collect()  # bounded by `labelled`
    x, y = np.array([r["x"] for r in seen]), np.array([float(r["y"] == 1) for r in seen])
    if not len(y) or y.min() == y.max():
        return {"ratio": ratio, "slope": 0.0, "base": 0.0, "prior": 0.0}
    slope, base = _calibrate(x, y)
    return {"ratio": ratio, "slope": slope, "base": base, "prior": math.log(y.mean() / (1 - y.mean()))}


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic slope and intercept of standardised ratios, with a small ridge against perfect separation."""
    mean, scale = x.mean(), max(1e-9, x.std())
    z, a, b = (x - mean) / scale, 0.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * z).sum() - 0.01 * a, (y - p).sum()])
        h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum()]])
        da, db = np.clip(np.linalg.solve(h, g), -3, 3)
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-7:
            break
    return float(a / scale), float(b - a * mean / scale)


def keyed(docs: DataFrame, model: dict, temperature: float = TEMPERATURE, keep: bool = False) -> DataFrame:
    """``_weight`` (log) and ``_key`` (log weight and Gumbel noise) of each text, with doc_id or, on ``keep``, all columns.

    The noise depends on doc_id and text alone: repeated rows stay or go together, and a retried task draws the same.
    Null and empty texts have the prior odds.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns if keep else ["doc_id"]
    base = docs if keep else typed(docs, doc_id="long", text="string")
    unit = (F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(31)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rows = base.withColumn("_noise", -F.log(-F.log(unit)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            x, n = (np.array(v, np.float64) for v in _mean_ratio(batch.column(at["text"]), m["ratio"]))
            weight = np.clip((n * (m["slope"] * x + m["base"]) + PRIOR_GRAMS * m["prior"]) / (n + PRIOR_GRAMS), -CLIP, CLIP)
            key = weight + temperature * batch.column(at["_noise"]).to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in columns), pa.array(weight), pa.array(key)],
                                             names=[*columns, "_weight", "_key"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name in columns)
    return rows.mapInArrow(run, f"{kinds}, _weight double, _key double")


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, exact: the range of values is narrowed by histograms of 1,024 counts."""
    if k <= 0:
        return math.inf
    low, high = rows.agg(F.min(column), F.max(column)).first()
    inside = F.lit(True)
    for _ in range(12):
        width = (high - low) / 1024
        if width <= 0 or low + width == low:
            return low
        bucket = F.least(F.floor((F.col(column) - low) / width), F.lit(1023))
        found = rows.filter(inside).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(found, key=lambda r: -r["b"]):
            if k <= r["n"]:
                low, high = r["lo"], r["hi"]
                break
            k -= r["n"]
        else:
            return low
        if low == high:
            return low
        inside = F.col(column).between(low, high)
    return low


def _threshold(keys: DataFrame) -> float:
    """Key of the last text that stays: as many stay as are more likely target text than not."""
    return kth_largest(keys, "_key", keys.filter("_weight >= 0").count())


def resampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts that were drawn, with their own columns. Texts move nowhere: keys are settled, the texts scored again."""
    model = train(docs, labels)
    limit = _threshold(settled(keyed(docs, model)))
    inner, back = guarded(docs, "doc_id", "text")
    return keyed(inner, model, keep=True).filter(F.col("_key") >= limit).select(*back)


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: log weight, key and whether it was drawn."""
    keys = settled(keyed(docs, train(docs, labels)))
    return keys.select("doc_id", F.col("_weight").alias("log_weight"), F.col("_key").alias("draw_key"),
                       (F.col("_key") >= _threshold(keys)).alias("kept"))
