"""Toxic passages by maximum-scoring segments (dealt operator 8).

Every token scores the log-odds of toxic against clean texts, with a Dirichlet prior drawn from both, less a drift. A linear
scan finds all maximal segments of a text. The scores of segments that chance makes follow an extreme-value law with rate
lambda and size K n; what exceeds it is summed over a text's segments and turned into a probability.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, crc_mod, typed
from .textbytes import WORDS, column_bytes, slices, tokens

#: Bound of the training sample: labelled texts.
LABELLED = 20_000
#: Bound of the model: tokens with a score of their own, the most telling ones.
TOKENS = 1 << 16
#: Log-likelihood ratio from which a token tells the classes apart.
TELLING = 18.0
PRIOR = 0.5
DRIFT = 0.1
THRESHOLD = 0.3


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, toxic texts, clean texts) that hold it, of each batch: a word that one text repeats counts once."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        data, off = column_bytes(batch.column(0))
        keys: dict[bool, list] = {True: [], False: []}
        for first, last, part, own in slices(data, off):
            _, _, hashes, bounds = tokens(part, own, WORDS)
            for d in range(last - first):
                keys[bool(toxic[first + d])].append(np.unique(hashes[bounds[d]:bounds[d + 1]]))
        token, yes, no = [], [], []
        for side, parts in keys.items():
            if parts:
                own, n = np.unique(np.concatenate(parts), return_counts=True)
                token.append(own.view(np.int64))
                yes.append(n if side else np.zeros(len(n), np.int64))
                no.append(np.zeros(len(n), np.int64) if side else n)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(join(x)) for x in (token, yes, no)], names=["token", "yes", "no"])


def segments(at: np.ndarray, score: np.ndarray, drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first token, last token), in one pass.

    ``at`` and ``score`` give the tokens that have a score of their own; each token in between scores -drift.
    """
    kept: list[list[float]] = []  # sum before, sum after, first, last
    total, before = 0.0, -1
    for p, s in zip(at.tolist(), score.tolist()):
        total -= drift * (p - before - 1)
        before = p
        low = total
        total += s
        if s <= 0:
            continue
        new = [low, total, p, p]
        while True:
            k = len(kept) - 1
            while k >= 0 and kept[k][0] >= new[0]:
                k -= 1
            if k < 0 or kept[k][1] >= new[1]:
                kept.append(new)
                break
            new = [kept[k][0], new[1], kept[k][2], p]
            del kept[k:]
    return [(b - a, int(i), int(j)) for a, b, i, j in kept]


def _rate(scores: np.ndarray, share: np.ndarray, drift: float) -> float:
    """lambda > 0 with sum share * exp(lambda * score) = 1 over the tokens of clean texts."""
    rest = 1 - share.sum()
    f = lambda x: float((share * np.exp(np.minimum(x * scores, 700))).sum() + rest * math.exp(-x * drift)) - 1
    high = 1e-3
    while f(high) < 0 and high < 100:
        high *= 1.5
    low = high / 1.5
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(high, 1e-3)


class Scorer:
    """Evidence and segments of texts under one model."""

    def __init__(self, model: dict):
        self.key, self.weight, self.rate, self.size, self.drift = (model[k] for k in ("key", "weight", "rate", "size", "drift"))

    def texts(self, column: pa.Array) -> Iterator[tuple[float, int, list, tuple]]:
        """(evidence, tokens, [(score, first, last)] of significant passages, (starts, ends)) of each text."""
        data, off = column_bytes(column)
        for first, last, part, own in slices(data, off):
            starts, ends, hashes, bounds = tokens(part, own, WORDS)
            if len(self.key):
                k = np.minimum(np.searchsorted(self.key, hashes), len(self.key) - 1)
                known = np.flatnonzero(self.key[k] == hashes)
                score = self.weight[k[known]] - self.drift
            else:
                known, score = np.zeros(0, np.int64), np.zeros(0)
            cut = np.searchsorted(known, bounds)
            for d in range(last - first):
                a, b, n = cut[d], cut[d + 1], int(bounds[d + 1] - bounds[d])
                found = segments(known[a:b] - bounds[d], score[a:b], self.drift) if b > a else []
                level = math.log(max(self.size * max(n, 1), 1e-9))
                above = [(s, i, j) for s, i, j in found if self.rate * s > level]
                evidence = sum(self.rate * s - level for s, _, _ in above)
                yield evidence, n, above, (starts[bounds[d]:bounds[d + 1]] - own[d], ends[bounds[d]:bounds[d + 1]] - own[d])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small ridge."""
    a, b = 0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((y - p) * x).sum() - 0.01 * a, (y - p).sum()])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        da, db = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-6:
            break
    return max(0.0, float(a)), float(b)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> dict:
    """Model from at most about ``labelled`` labelled texts, chosen by the hash of their doc_id.

    The sample of labels is bounded, so it is broadcast and the texts don't move. Counts over the sample are grouped by Spark;
    the driver sees at most TOKENS telling tokens and one number per sampled text. A doc_id with several labels has its largest.
    """
    usable = typed(labels, doc_id="long", toxic="int").filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = bounded_sample(usable.filter(crc_mod("doc_id", 4) != 2), "doc_id", labelled)
    rows = typed(docs, doc_id="long", text="string").join(F.broadcast(sample), "doc_id").select("text", (F.col("toxic") == 1).alias("toxic"))
    counts = rows.mapInArrow(_counts, "token bigint, yes bigint, no bigint").groupBy("token").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    total = counts.agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).first()
    n_yes, n_no = int(total["yes"] or 0), int(total["no"] or 0)
    empty = {"key": np.zeros(0, np.uint64), "weight": np.zeros(0), "rate": 1.0, "size": 1.0, "drift": DRIFT, "slope": 0.0, "base": -4.0}
    if not n_yes or not n_no:
        return empty
    texts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    d_yes, d_no = texts[True], texts[False]
    part = d_yes / (d_yes + d_no)
    seen = F.col("yes") + F.col("no")
    side = lambda c, e: F.when(c > 0, c * F.log(c / e)).otherwise(0.0)
    ratio = sum(
        (side(F.col(c), seen * p) + side(F.lit(d) - F.col(c), (F.lit(d_yes + d_no) - seen) * p) for c, d, p in (("yes", d_yes, part), ("no", d_no, 1 - part))),
        F.lit(0.0))
    telling = counts.withColumn("telling", 2 * ratio).filter(F.col("telling") >= TELLING)
    top = telling.orderBy(F.desc("telling"), "token").limit(TOKENS).collect()  # TOKENS rows at most
    if not top:
        return empty
    key, yes, no = (np.array([r[c] for r in top], np.int64) for c in ("token", "yes", "no"))
    order = np.argsort(key.view(np.uint64))
    key, yes, no = key.view(np.uint64)[order], yes[order].astype(float), no[order].astype(float)
    # prior counts in proportion to both classes together, PRIOR for each token in all
    a_yes, a_no = PRIOR * 2 * part, PRIOR * 2 * (1 - part)
    weight = np.log((yes + a_yes) / (d_yes + a_yes)) - np.log((no + a_no) / (d_no + a_no))
    drift = max(DRIFT, 2 * float((weight * no).sum() / n_no))  # clean text must lose on average
    model = {"key": key, "weight": weight, "rate": _rate(weight - drift, no / n_no, drift), "size": 1.0, "drift": drift}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def chance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Scorer({**shared.value, "size": 0.0})
        for batch in batches:
            got = [(len(x[2]), sum(math.exp(min(0.0, -made.rate * s)) for s, _, _ in x[2]), x[1]) for x in made.texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([float(g[k]) for g in got], pa.float64()) for k in range(3)], names=["segments", "decay", "n"])

    # segments that chance makes in clean texts: expected number above s is K n exp(-lambda s)
    clean = rows.filter("not toxic").select("text").mapInArrow(chance, "segments double, decay double, n double").agg(
        F.sum("segments").alias("m"), F.sum("decay").alias("d"), F.sum("n").alias("n")).first()
    model["size"] = max(1e-6, float(clean["d"] or 0) * 2 / max(1.0, float(clean["n"] or 1)))
    shared2 = docs.sparkSession.sparkContext.broadcast(dict(model))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Scorer(shared2.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(x[0]) for x in made.texts(batch.column(0))], pa.float64()), batch.column(1)], names=["x", "y"])

    pairs = rows.mapInArrow(evidence, "x double, y boolean").collect()  # bounded by `labelled`
    x, y = np.array([r["x"] for r in pairs]), np.array([float(r["y"]) for r in pairs])
    model["slope"], model["base"] = _logistic(np.log1p(x), y)
    return model


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score and ``passages`` (code points of significant passages with their scores) of each text, empty ones too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Scorer(shared.value)
        slope, base = shared.value["slope"], shared.value["base"]
        for batch in batches:
            scores, spans = [], []
            for k, (x, _, above, (starts, ends)) in enumerate(made.texts(batch.column(1))):
                scores.append(1 / (1 + math.exp(-min(30.0, max(-30.0, slope * math.log1p(x) + base)))))
                own = []
                if above:
                    raw = batch.column(1)[k].as_py().encode()
                    point = lambda b, raw=raw: len(raw[:b].decode("utf-8", "ignore"))
                    own = [{"start": point(int(starts[i])), "end": point(int(ends[j])), "score": s} for s, i, j in above]
                spans.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)],
                                             names=["doc_id", "score", "passages"])

    return typed(docs, doc_id="long", text="string").mapInArrow(
        run, "doc_id bigint, score double, passages array<struct<start:bigint,end:bigint,score:double>>")


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels whose crc32(doc_id) mod 4 isn't 2, score all documents. A null doc_id isn't held out."""
    got = scored(docs, train(docs, labels))
    return got.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
