"""Language identification in two steps (dealt operator 2): the family first, then one-versus-one
linear support vector machines between the languages of that family. Features are hashed trigrams of bytes of the whole text."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, typed
from .textbytes import column_bytes, slices

DIMS = 1 << 14
#: Bound of the training sample: texts of each language.
PER_LANGUAGE = 600
#: Families of languages by ISO 639-1 code. A language that isn't listed is a family by itself.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no sv yi", "romance": "ca es fr gl it la oc pt ro", "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "turkic": "az ba kk ky tk tr tt ug uz", "indic": "bn gu hi mr ne pa si ur", "iranian": "fa ku ps tg", "uralic": "et fi hu",
    "semitic": "am ar he mt", "baltic": "lt lv", "celtic": "br cy ga gd", "sinitic": "zh yue", "dravidian": "kn ml ta te",
    "austronesian": "id jv ms tl", "bantu": "sw xh zu",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return FAMILY_OF.get(lang, lang)


def _folded() -> np.ndarray:
    out = np.full(256, 32, np.uint32)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


FOLDED = _folded()


def grams(data: np.ndarray) -> np.ndarray:
    """Feature of the trigram that begins at each byte but the last two."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    b = FOLDED[data]
    code = (b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:]
    code *= np.uint32(2654435761)
    return (code >> np.uint32(18)).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = column_bytes(batch.column(1))
        at, share = [], []
        for d in range(batch.num_rows):
            count = np.bincount(grams(data[off[d]:off[d + 1]]), minlength=DIMS)
            own = np.flatnonzero(count)
            at.append(own.astype(np.int32))
            share.append((count[own] / max(1, count.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))],
                                         names=["lang", "at", "share"])


def train_svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss and balanced classes, by accelerated gradient steps."""
    mean = x.mean(0)
    x = x - mean
    scale = 1 / max(1e-12, np.sqrt((x * x).sum(1).mean()))
    x *= np.float32(scale)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):  # largest curvature
        v = x.T @ (weight * (x @ v))
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    step = 1 / (2 * (top + 1) + strength)
    w = np.zeros(x.shape[1], np.float32)
    b, w0, b0 = 0.0, w, 0.0
    for k in range(rounds):
        m = k / (k + 3)
        u, c = w + m * (w - w0), b + m * (b - b0)
        slack = np.maximum(0, 1 - y * (x @ u + c)) * weight * y
        w0, b0 = w, b
        w, b = u - step * (strength * u - 2 * (x.T @ slack)), c + step * 2 * float(slack.sum())
    w = w * scale
    return w.astype(np.float32), float(b - w @ mean)


def _fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One machine from the bounded sample of its two sides."""
    x = np.zeros((len(rows), DIMS), np.float32)
    rows = rows.sort_values("order", kind="stable")
    for k, (at, share) in enumerate(zip(rows["at"], rows["share"])):
        x[k, np.asarray(at, np.int64)] = share
    y = rows["side"].to_numpy(np.float32)
    w, b = train_svm(x, y)
    return pd.DataFrame({"level": [key[0]], "one": [key[1]], "other": [key[2]], "w": [w], "b": [b]})


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """Machines from at most about ``per_language`` texts of each language, chosen by the hash of their doc_id."""
    rows = docs.filter("lang is not null and text is not null and text <> ''")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a number per language
    langs = sorted(counts)
    pairs = [("family", a, b) for a, b in combinations(sorted({family(x) for x in langs}), 2)]
    pairs += [("language", a, b) for a, b in combinations(langs, 2) if family(a) == family(b)]
    if not pairs:
        return {"langs": langs, "machines": []}
    # The bounds are literals: a join by language would deal all texts of a language to one task.
    bound = F.create_map(*[F.lit(v) for x in langs for v in (x, per_language * 1_000_000 / counts[x])])
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < bound[F.col("lang")])
    made = chosen.select("lang", "text").mapInArrow(_features, "lang string, at array<int>, share array<float>")
    roles = [(level, a, b, x, 1.0 if (family(x) if level == "family" else x) == a else -1.0)
             for level, a, b in pairs for x in langs if (family(x) if level == "family" else x) in (a, b)]
    roles = docs.sparkSession.createDataFrame(roles, "level string, one string, other string, lang string, side double")
    order = F.xxhash64(F.col("at").cast("string"))
    fitted = made.join(roles, "lang").withColumn("order", order).groupBy("level", "one", "other").applyInPandas(
        _fit, "level string, one string, other string, w array<float>, b double")
    # as many machines as pairs of languages within a family, of DIMS numbers each
    return {"langs": langs, "machines": [(r["level"], r["one"], r["other"], np.array(r["w"], np.float32), r["b"]) for r in fitted.collect()]}


def _vote(names: list[str], margins: dict[tuple[str, str], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the winner, confidence) of one-versus-one machines; more votes, then the larger sum of margins wins."""
    votes, total = np.zeros((len(names), n)), np.zeros((len(names), n))
    for (a, b), m in margins.items():
        i, j = names.index(a), names.index(b)
        votes[i] += m >= 0
        votes[j] += m < 0
        total[i] += np.clip(m, -5, 5)
        total[j] -= np.clip(m, -5, 5)
    rank = votes + total / (20 * max(1, len(names)))
    best = rank.argmax(0)
    sure = np.ones(n)
    for (a, b), m in margins.items():
        i, j = names.index(a), names.index(b)
        p = 1 / (1 + np.exp(-4 * np.clip(m, -8, 8)))
        sure = np.where(best == i, np.minimum(sure, p), np.where(best == j, np.minimum(sure, 1 - p), sure))
    return best, sure


def _sums(at: np.ndarray, bounds: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Mean weight of each text's features; 0 without any."""
    size = np.diff(bounds)
    out = np.zeros(len(size))
    has = size > 0
    if has.any():
        out[has] = np.add.reduceat(w[at], bounds[:-1][has], dtype=np.float64) / size[has]
    return out


def _predict(data: np.ndarray, off: np.ndarray, model: dict) -> tuple[list[str], np.ndarray]:
    n, langs = len(off) - 1, model["langs"]
    at = grams(data)
    ids = np.arange(len(data) - 2 if len(data) > 2 else 0)
    inside = ids + 2 < off[np.searchsorted(off, ids, "right")]  # trigrams of one text only
    at = at[inside]
    bounds = np.searchsorted(ids[inside], off)
    families = sorted({family(x) for x in langs})
    got = {(a, b): _sums(at, bounds, w) + c for level, a, b, w, c in model["machines"] if level == "family"}
    best, sure = _vote(families, got, n)
    out = np.empty(n, object)
    size = np.diff(bounds)
    for k, name in enumerate(families):
        rows = np.flatnonzero(best == k)
        members = [x for x in langs if family(x) == name]
        if not len(rows):
            continue
        pick = np.zeros(len(rows), np.int64)
        if len(members) > 1:
            sub_bounds = np.concatenate([[0], np.cumsum(size[rows])])
            sub = np.concatenate([at[bounds[r]:bounds[r + 1]] for r in rows])
            margins = {(a, b): _sums(sub, sub_bounds, w) + c for level, a, b, w, c in model["machines"] if level == "language" and a in members}
            pick, own = _vote(members, margins, len(rows))
            sure[rows] = np.minimum(sure[rows], own)
        out[rows] = np.array(members, object)[pick]
    return list(out), sure


def identified(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score of each text; ``und`` with score 0 for texts without a letter, null and empty ones among them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = typed(docs, doc_id="long", text="string").select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, off = column_bytes(batch.column(1))
            langs, scores = [], []
            for first, last, part, own in slices(data, off):
                if model["langs"]:
                    names, sure = _predict(part, own, model)
                else:
                    names, sure = ["und"] * (last - first), np.zeros(last - first)
                langs += names
                scores += sure.tolist()
            known = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x if k else "und" for x, k in zip(langs, known)], pa.string()),
                 pa.array([s if k and x != "und" else 0.0 for s, x, k in zip(scores, langs, known)], pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def language_table(docs: DataFrame) -> DataFrame:
    """Learn from documents whose crc32(doc_id) mod 3 isn't 1, predict all. A null doc_id is neither learnt from nor held out."""
    rows = typed(docs, doc_id="long", text="string", lang="string")
    model = train(rows.filter(crc_mod("doc_id", 3) != 1))
    return identified(rows, model).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
