"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds to them (dealt operator 9).

The field tags tokens as the begin of a secret, its inside or outside. Features are a token's shape, its neighbouring words and how
its file looks. It learns from a bounded sample that the fixed patterns tag. Most tokens are outside by so wide a margin that no
transition can turn them; Viterbi decoding runs over the stretches in between and finds the same best path.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, typed
from .textbytes import PUNCTUATED, column_bytes, slices, tokens

#: Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "field")
#: Bound of the training sample: documents, and windows of each that hold a secret.
SAMPLE = 20_000
WINDOWS_EACH = 8
WINDOW = 32
QUIET = 16
NEIGHBOURS = 1 << 14
SHAPES = 1 << 12
FILES = 64
BEGIN, INSIDE, OUT = 0, 1, 2
#: How far the best tag must lead to count as a find.
LEAD = 2.0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind. Runs of hex digits are found by length at once: shorter runs drop anyway."""
    if not text:
        return []
    out = []
    low = text.lower() if "=" in text or ":" in text else ""
    if low and any(n in low for n in NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _value_spans(text: str) -> list[tuple[int, int]]:
    """The secret itself within each base span."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [m.span() for m in HEX.finditer(text)]


def _byte_kinds() -> np.ndarray:
    out = np.zeros((4, 256), np.uint8)  # digit, lower, upper, beyond ASCII
    out[0, 48:58] = 1
    out[1, 97:123] = 1
    out[2, 65:91] = 1
    out[3, 128:] = 1
    return out


BYTE_KINDS = _byte_kinds()
_LOG = np.minimum(15, np.floor(2 * np.log2(np.arange(1, 4097)))).astype(np.int64)


def token_features(data: np.ndarray, off: np.ndarray):
    """(starts, ends, bounds, table of six features a token): shape, three words before, one after, file."""
    starts, ends, hashes, bounds = tokens(data, off, PUNCTUATED)
    n = len(starts)
    if not n:
        return starts, ends, bounds, np.zeros((0, 6), np.int64)
    long = ends - starts
    counts = [np.add.reduceat(k[data], starts, dtype=np.int64) if k is not None else None for k in BYTE_KINDS]
    # blanks between tokens have no kind, so sums up to the next token are those of the token
    digit, lower, upper, high = counts
    quarter = lambda x: np.minimum(3, (4 * x + long - 1) // long)
    turns = np.zeros(n, np.int64)
    kind = np.where(BYTE_KINDS[0][data], 1, np.where(BYTE_KINDS[1][data] | BYTE_KINDS[2][data], 2, 0)).astype(np.int8)
    turn = np.concatenate([[0], (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)]).astype(np.int64)
    turns = np.minimum(3, np.add.reduceat(turn, starts) // 2)
    shape = _LOG[np.minimum(long, 4096) - 1] * 256 + quarter(digit) * 64 + quarter(upper) * 16 + turns * 4 + (lower > 0) * 2 + (high > 0)
    mark = (digit + lower + upper + high) == 0
    shape = np.where(mark, data[starts].astype(np.int64), shape) % SHAPES
    word = (hashes % np.uint64(NEIGHBOURS - 1) + np.uint64(1)).astype(np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = np.zeros((n, 6), np.int64)
    out[:, 0] = shape
    for k, step in enumerate((1, 2, 3)):
        if n > step:
            same = owner[step:] == owner[:-step]
            out[step:, 1 + k] = np.where(same, word[:-step], 0)
    if n > 1:
        out[:-1, 4] = np.where(owner[1:] == owner[:-1], word[1:], 0)
    size = np.maximum(1, np.diff(bounds))
    marks = np.concatenate([[0], np.cumsum(mark)])
    share = np.minimum(7, 16 * (marks[bounds[1:]] - marks[bounds[:-1]]) // size)
    out[:, 5] = (np.minimum(7, np.log2(size).astype(np.int64) // 2) * 8 + share)[owner]
    return starts, ends, bounds, out


OFFSETS = np.array([0, SHAPES, SHAPES + NEIGHBOURS, SHAPES + 2 * NEIGHBOURS, SHAPES + 3 * NEIGHBOURS, SHAPES + 4 * NEIGHBOURS], np.int64)
WEIGHTS = SHAPES + 4 * NEIGHBOURS + FILES


def _points(text: str, data: np.ndarray) -> np.ndarray:
    """Code point of each byte position of a text, and of its end."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tagged windows of WINDOW tokens: those around secrets, and one of each QUIET-th text without any."""
    for batch in batches:
        made, tags = [], []
        wanted = [bool(_value_spans(x.as_py())) or (k.as_py() or 0) % QUIET == 0 for k, x in zip(batch.column(0), batch.column(1))]
        batch = batch.filter(pa.array(wanted, pa.bool_()))
        data, off = column_bytes(batch.column(1))
        for first, last, part, own in slices(data, off):
            starts, ends, bounds, table = token_features(part, own)
            for d in range(last - first):
                a, b = bounds[d], bounds[d + 1]
                if b - a == 0:
                    continue
                text = batch.column(1)[first + d].as_py()
                spans = _value_spans(text)
                tag = np.full(b - a, OUT)
                if spans:
                    raw = part[own[d]:own[d + 1]]
                    point = _points(text, raw)
                    s, e = point[starts[a:b] - own[d]], point[ends[a:b] - own[d] - 1] + 0
                    for x, y in sorted(set(spans)):
                        inside = np.flatnonzero((s >= x) & (e <= y))
                        if len(inside):
                            tag[inside] = INSIDE
                            tag[inside[0]] = BEGIN
                    at = np.flatnonzero(tag == BEGIN)[:WINDOWS_EACH] - WINDOW // 2
                else:
                    key = batch.column(0)[first + d].as_py() or 0
                    at = np.array([(key * 7919) % max(1, b - a)])
                for lo in at:
                    rows = np.arange(lo, lo + WINDOW)
                    ok = (rows >= 0) & (rows < b - a)
                    f = np.where(ok[:, None], table[a + np.clip(rows, 0, b - a - 1)], 0) + OFFSETS
                    made.append(f.ravel().astype(np.int32))
                    tags.append(np.where(ok, tag[np.clip(rows, 0, b - a - 1)], OUT).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.int32())), pa.array(tags, pa.list_(pa.int32()))], names=["features", "tags"])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def fit(features: np.ndarray, tags: np.ndarray, rounds: int = 60, rate: float = 0.1, ridge: float = 1e-3):
    """Maximum-likelihood weights (feature x tag) and transitions by Adam steps over all windows at once."""
    n, length, _ = features.shape
    w, t = np.zeros((WEIGHTS, 3)), np.zeros((3, 3))
    flat = features.reshape(n * length, -1)
    used, compact = np.unique(flat, return_inverse=True)
    compact = compact.reshape(flat.shape)
    v, moments = np.zeros((len(used), 3)), [np.zeros((len(used), 3)), np.zeros((len(used), 3)), np.zeros((3, 3)), np.zeros((3, 3))]
    true = np.eye(3)[tags]
    true_pairs = np.einsum("nti,ntj->ij", true[:, :-1], true[:, 1:])
    for step in range(1, rounds + 1):
        e = v[compact].sum(1).reshape(n, length, 3)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for k in range(1, length):
            alpha[:, k] = e[:, k] + _log_sum(alpha[:, k - 1][:, :, None] + t, 1)
        for k in range(length - 2, -1, -1):
            beta[:, k] = _log_sum(t[None] + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        z = _log_sum(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None])
        pairs = np.zeros((3, 3))
        for k in range(length - 1):
            pairs += np.exp(alpha[:, k][:, :, None] + t + (e[:, k + 1] + beta[:, k + 1])[:, None, :] - z[:, None, None]).sum(0)
        miss = ((p - true) / n).reshape(n * length, 3)
        g = np.stack([np.bincount(compact.ravel(), np.repeat(miss[:, c], compact.shape[1]), len(used)) for c in range(3)], 1) + ridge * v
        gt = (pairs - true_pairs) / n + ridge * t
        for x, grad, a, b in ((v, g, 0, 1), (t, gt, 2, 3)):
            moments[a] = 0.9 * moments[a] + 0.1 * grad
            moments[b] = 0.999 * moments[b] + 0.001 * grad * grad
            x -= rate * (moments[a] / (1 - 0.9 ** step)) / (np.sqrt(moments[b] / (1 - 0.999 ** step)) + 1e-8)
    w[used] = v
    return w, t


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    """A field from at most about ``sample`` documents, chosen by the hash of doc_id; None if they hold no secret."""
    rows = bounded_sample(typed(docs, doc_id="long", text="string").filter("text is not null"), "doc_id", sample)
    got = rows.mapInArrow(_windows, "features array<int>, tags array<int>").collect()  # bounded by `sample` and WINDOWS_EACH
    if not got:
        return None
    got = sorted((tuple(r["features"]), tuple(r["tags"])) for r in got)
    tags = np.array([r[1] for r in got])
    if (tags == OUT).all():
        return None
    return fit(np.array([r[0] for r in got]).reshape(len(got), WINDOW, 6), tags)


def viterbi(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    best, back = e[0].copy(), np.zeros((len(e), 3), np.int64)
    for k in range(1, len(e)):
        ways = best[:, None] + t
        back[k] = ways.argmax(0)
        best = ways.max(0) + e[k]
    out = np.empty(len(e), np.int64)
    out[-1] = best.argmax()
    for k in range(len(e) - 1, 0, -1):
        out[k - 1] = back[k, out[k]]
    return out


def decode(e: np.ndarray, bounds: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The best tags of each text. A token that is outside by more than its two transitions can make up for is so in every
    best path; only the stretches between such tokens are decoded, with these as neighbours."""
    slack = 2 * (t.max() - t.min())
    open_ = e[:, OUT] - np.maximum(e[:, BEGIN], e[:, INSIDE]) <= slack
    tags = np.full(len(e), OUT)
    at = np.flatnonzero(open_)
    if not len(at):
        return tags
    owner = np.searchsorted(bounds, at, "right")
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])])
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(at))
    # every transition that touches a secret costs at least -gain against staying outside, so a run of secret tokens pays only
    # if one of them leads by more than that
    gain = np.delete(t.ravel(), 3 * OUT + OUT).max() - t[OUT, OUT]
    if gain <= 0:
        seed = np.maximum(e[at, BEGIN], e[at, INSIDE]) - e[at, OUT] > -gain
        keep = np.add.reduceat(seed.astype(np.int64), begins) > 0
        begins, ends = begins[keep], ends[keep]
    for a, b in zip(begins, ends):
        lo, hi = at[a], at[b - 1] + 1
        left, right = bounds[owner[a] - 1], bounds[owner[a]]
        lo2, hi2 = max(left, lo - 1), min(right, hi + 1)
        own = e[lo2:hi2].copy()
        if lo2 < lo:
            own[0, [BEGIN, INSIDE]] = -1e9
        if hi2 > hi:
            own[-1, [BEGIN, INSIDE]] = -1e9
        tags[lo2:hi2] = viterbi(own, t)
    return tags


def found_spans(column: pa.Array, model: tuple[np.ndarray, np.ndarray] | None) -> Iterator[list[tuple[str, int, int]]]:
    """Base spans of each text, and the field's spans that touch none of them."""
    texts = column.to_pylist()
    if model is None:
        yield from (base_spans(x) for x in texts)
        return
    w, t = model
    data, off = column_bytes(column)
    for first, last, part, own in slices(data, off):
        starts, ends, bounds, table = token_features(part, own)
        e = np.zeros((len(starts), 3))
        for k in range(6):
            e += w[table[:, k] + OFFSETS[k]]
        tags = decode(e, bounds, t)
        lead = np.maximum(e[:, BEGIN], e[:, INSIDE]) - e[:, OUT]
        hit = np.searchsorted(np.flatnonzero(tags != OUT), bounds)
        for d in range(last - first):
            spans = base_spans(texts[first + d])
            if hit[d + 1] > hit[d]:
                a, b = bounds[d], bounds[d + 1]
                point = _points(texts[first + d], part[own[d]:own[d + 1]])
                k = a
                while k < b:
                    if tags[k] == OUT:
                        k += 1
                        continue
                    j = k + 1
                    while j < b and tags[j] == INSIDE:
                        j += 1
                    s, z = int(point[starts[k] - own[d]]), int(point[ends[j - 1] - own[d]])
                    if lead[k:j].max() >= LEAD and z - s >= 6 and not any(x < z and s < y for _, x, y in spans):
                        spans.append(("field", s, z))
                    k = j
                spans.sort(key=lambda x: (x[1], KINDS.index(x[0])))
            yield spans


def scanned(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """doc_id and ``found``: (kind, start, end) of each span, in code points. Null and empty texts have none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [[dict(zip(("kind", "start", "end"), x)) for x in spans] for spans in found_spans(batch.column(1), shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, kind)], names=["doc_id", "found"])

    return typed(docs, doc_id="long", text="string").mapInArrow(run, "doc_id bigint, found array<struct<kind:string,start:bigint,end:bigint>>")


def secret_table(docs: DataFrame) -> DataFrame:
    """Counts of the base spans, their digest, and all spans of each document."""
    got = scanned(docs, train(docs))
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter("found", lambda x: x["kind"] != "field"), line), ",")
    return got.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"),
                      F.array_join(F.transform("found", line), ",").alias("spans"))
