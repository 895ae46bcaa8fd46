"""Removal of repeated multi-line passages by content-defined chunks of lines (dealt operator 5).

A passage is a run of lines of PASSAGE words or more. For every line the shortest passages that start and that end there are
marked: together they cover each longer one, wherever it stands. A passage that occurs more than once in the corpus is
removed but for its first occurrence, after its bytes have been compared with the first one's.

Repeated lines of fewer words are found by content-defined chunks. Where a rolling hash over two line hashes is lower than on
either side, a chunk ends, so the same lines fall into the same chunks wherever they stand, save for the rims. A line of PASSAGE
words or more is a chunk of its own. Chunks of several lines go as passages do. So do the two lines at a boundary; from there
the comparison goes on line by line until lines differ or it has reached a passage, and the rims go with it.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, guarded, settled, typed

#: Words from which a single line counts as a passage.
PASSAGE = 50
#: Lines at which a chunk ends even without a boundary.
LONGEST = 16
WORD = re.compile(r"\S+")


def _is_passage(line: str) -> bool:
    return len(line) >= 2 * PASSAGE - 1 and len(WORD.findall(line)) >= PASSAGE


def chunks(text: str | None) -> list[tuple[int, int]]:
    """(first line, after last) of the chunks of a text; they cover all its lines.

    A chunk ends where the rolling hash of two lines is lower than its neighbours: that depends on four lines alone.
    """
    if not text:
        return []
    lines = text.split("\n")
    rolled, before, long = [], 0, set()
    for k, line in enumerate(lines):
        if _is_passage(line):
            long.add(k)
            before = 0
            rolled.append(1 << 64)
            continue
        now = xxhash.xxh3_64_intdigest(line.encode())
        rolled.append(((before * 0x9E3779B97F4A7C15 ^ now) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF)
        before = now
    rolled.append(1 << 64)
    out: list[tuple[int, int]] = []
    first = 0
    for k in range(len(lines)):
        if k in long:
            if k > first:
                out.append((first, k))
            out.append((k, k + 1))
            first = k + 1
        elif k > first and (k + 1 - first >= LONGEST or rolled[k] < rolled[k - 1] and rolled[k] <= rolled[k + 1]):
            out.append((first, k + 1))
            first = k + 1
    if first < len(lines):
        out.append((first, len(lines)))
    return out


def _words(lines: list[str]) -> list[int]:
    """Words before each line, and in all."""
    return [0, *accumulate(len(x.split()) for x in lines)]


def passages(before: list[int]) -> set[tuple[int, int]]:
    """(first line, after last) of the shortest passage that starts at each line, and of that which ends there."""
    n, out, end, start = len(before) - 1, set(), 0, 0
    for k in range(n):
        while end < n and before[end] - before[k] < PASSAGE:
            end += 1
        if before[end] - before[k] < PASSAGE:
            break
        out.add((k, end))
    for k in range(1, n + 1):
        if before[k] < PASSAGE:
            continue
        while start + 1 < k and before[k] - before[start + 1] >= PASSAGE:
            start += 1
        out.add((start, k))
    return out


def _spans(lines: list[str], cut: list[tuple[int, int]], before: list[int]) -> set[tuple[int, int]]:
    """What may be removed: passages, chunks of several lines, and the two lines at each boundary between chunks, from which
    the lines beside are compared. Chunks and pairs that reach PASSAGE words are covered by passages."""
    short = {(a, b) for a, b in cut if b - a >= 2 and any(lines[a:b])}
    short |= {(b - 1, b + 1) for _, b in cut[:-1] if lines[b - 1].strip() and lines[b].strip()}
    return passages(before) | {(a, b) for a, b in short if before[b] - before[a] < PASSAGE}


def _cover(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """As few of the spans as cover the same lines."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and b <= out[-1][1]:
            continue
        while out and (a <= out[-1][0] or len(out) > 1 and a <= out[-2][1]):
            out.pop()
        out.append((a, b))
    return out


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of every span that may be removed."""
    for batch in batches:
        docs, keys, starts, ends, high, low = [], [], [], [], [], []
        for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = text.as_py()
            if not text or "\n" not in text and len(text) < 2 * PASSAGE - 1:
                continue
            lines = text.split("\n")
            for a, b in _spans(lines, chunks(text), _words(lines)):
                digest = hashlib.blake2b("\n".join(lines[a:b]).encode(), digest_size=16).digest()
                docs.append(doc)
                keys.append(key)
                starts.append(a)
                ends.append(b)
                high.append(int.from_bytes(digest[:8], "little", signed=True))
                low.append(int.from_bytes(digest[8:], "little", signed=True))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, keys, starts, ends, high, low)],
                                         names=["doc_id", "text_key", "line", "after", "high", "low"])


FIRST = {"is_first": True}
OCCURRENCES = (
    "doc_id bigint, text_key bigint, line bigint, after bigint, high bigint, low bigint, is_first boolean, body binary, "
    "above binary, below binary"
)


def _rims(lines: list[str], before: list[int], a: int, b: int) -> tuple[int, int]:
    """(first line, after last) around two lines, up to where a passage is reached on either side: passages are found by themselves."""
    lo, hi = a, b
    while lo > 0 and before[b] - before[lo] < PASSAGE:
        lo -= 1
    while hi < len(lines) and before[hi] - before[a] < PASSAGE:
        hi += 1
    return lo, hi


def _with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the repeated spans of a text; of passages that aren't first ones, as many as cover the lines. A boundary between
    chunks that both go tells nothing new; else it brings the lines on the side that stays, and a first one on both."""
    for batch in batches:
        out: list[tuple] = []
        for doc, key, text, marks in zip(*(c.to_pylist() for c in batch.columns)):
            lines, cut = text.split("\n"), chunks(text)
            before = _words(lines)
            wanted = {(m["line"], m["after"]): m for m in marks}
            begin, end = {x[0]: x for x in cut}, {x[1]: x for x in cut}
            long = {x for x in wanted if before[x[1]] - before[x[0]] >= PASSAGE}
            needed = set(_cover([x for x in long if not wanted[x]["is_first"]]))
            for (a, b), m in wanted.items():
                above = below = None
                if (a, b) in long:
                    if not m["is_first"] and (a, b) not in needed:
                        continue
                elif begin.get(a) != (a, b):  # a boundary
                    up, down = end[a + 1], begin[a + 1]
                    above, below = (m["is_first"] or wanted.get(x, FIRST)["is_first"] for x in (up, down))  # is it needed there?
                    if not above and not below:
                        continue
                    lo, hi = _rims(lines, before, a, b)
                    above = "\n".join(lines[lo:a]).encode() if above and a else None
                    below = "\n".join(lines[b:hi]).encode() if below and b < len(lines) else None
                out.append((doc, key, a, b, m["high"], m["low"], m["is_first"], "\n".join(lines[a:b]).encode(), above, below))
        kinds = [pa.int64()] * 6 + [pa.bool_()] + [pa.binary()] * 3
        names = [x.split()[0] for x in OCCURRENCES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 10, kinds)], names=names)


def _alike(a: bytes | None, b: bytes | None, from_end: bool) -> int:
    """Number of equal lines, counted from the side that touches the chunk."""
    if a is None or b is None:
        return 0
    n = 0
    x, y = a.split(b"\n"), b.split(b"\n")
    for p, q in zip(reversed(x), reversed(y)) if from_end else zip(x, y):
        if p != q:
            break
        n += 1
    return n


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, key, line, after, above, below, first_above, first_below = (c.to_pylist() for c in batch.columns)
        start = [a - _alike(x, y, True) for a, x, y in zip(line, above, first_above)]
        end = [b + _alike(x, y, False) for b, x, y in zip(after, below, first_below)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, key, start, end)],
                                         names=["doc_id", "text_key", "start", "end"])


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, gone): line ranges of each document that stand earlier in the corpus, bytes compared.

    The first occurrence is the one of the smallest doc_id (null last), then text key and line. Rows with the same doc_id and
    text count as one document. Of lines that repeat within a text, what overlaps the first occurrence is part of it.
    """
    rows = typed(docs, doc_id="long", text="string").filter("text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    marks = settled(rows.mapInArrow(_marks, "doc_id bigint, text_key bigint, line bigint, after bigint, high bigint, low bigint"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "line")
    repeated = settled(marks.groupBy("high", "low").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    hits = settled(marks.join(repeated.hint("merge"), ["high", "low"]))
    discard(marks, repeated)
    first = hits.groupBy("high", "low").agg(F.min(place).alias("first"))
    within = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_key") == F.col("text_key"))
    own = hits.join(first.hint("merge"), ["high", "low"]).withColumn("is_first", place.eqNullSafe(F.col("first")))
    own = settled(own.filter(F.col("is_first") | ~within | (F.col("line") >= F.col("first.line") + F.col("after") - F.col("line"))).drop("first"))
    discard(hits)
    by_doc = own.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("line", "after", "high", "low", "is_first")).alias("marks"))
    other = by_doc.withColumnsRenamed({"doc_id": "d", "text_key": "k"})
    found = settled(
        rows.join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
        .select("doc_id", "text_key", "text", "marks").mapInArrow(_with_bytes, OCCURRENCES))
    discard(own)
    firsts = found.filter("is_first").select("high", "low", F.col("body").alias("first_body"), F.col("above").alias("first_above"),
                                             F.col("below").alias("first_below")).dropDuplicates(["high", "low"])
    same = found.filter("not is_first").join(firsts, ["high", "low"]).filter("body = first_body")
    gone = same.select("doc_id", "text_key", "line", "after", "above", "below", "first_above", "first_below").mapInArrow(
        _ranges, "doc_id bigint, text_key bigint, start bigint, end bigint")
    gone = settled(gone.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("gone")))
    discard(found)
    return gone


def _without(text: str | None, gone: list[dict] | None) -> tuple[str | None, int, int]:
    """(what stays, lines, lines removed)."""
    if text is None:
        return None, 0, 0
    if not gone:
        return text, text.count("\n") + 1, 0
    lines = text.split("\n")
    out = set()
    for r in gone:
        out.update(range(r["start"], r["end"]))
    return "\n".join(x for k, x in enumerate(lines) if k not in out), len(lines), len(out)


def line_deduplicated(docs: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``text`` freed of repeated passages, ``_n_lines`` and ``_n_removed``.

    Null texts stay null and empty ones empty; columns of ``docs`` named as the two counts go. A text of repeated passages alone becomes empty; its row stays.
    """
    gone = (removals(docs) if gone is None else gone).withColumnsRenamed({"doc_id": "_d", "text_key": "_k"})
    docs = docs.drop("_n_lines", "_n_removed")
    inner, back = guarded(docs, "doc_id", "text")
    columns = inner.columns
    rows = inner.withColumn("_t", F.xxhash64(F.col("text").cast("string")))
    doc = F.col("doc_id").cast("long") if "doc_id" in columns else F.lit(None).cast("long")
    # By shuffle at every size, so that the plan of a small corpus is that of a large one.
    rows = rows.join(gone.hint("merge"), doc.eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_k")), "left").drop("_t", "_d", "_k")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            texts, marks = batch.column(at["text"]), batch.column(at["gone"])
            done = [_without(t.as_py(), g.as_py()) for t, g in zip(texts, marks)]
            made = {"text": pa.array([x[0] for x in done], pa.string())}
            yield pa.RecordBatch.from_arrays(
                [*(made.get(c, batch.column(at[c])) for c in columns), pa.array([x[1] for x in done], pa.int64()),
                 pa.array([x[2] for x in done], pa.int64())], names=[*columns, "_n_lines", "_n_removed"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields)
    return rows.mapInArrow(rebuild, f"{kinds}, _n_lines bigint, _n_removed bigint").select(*back, "_n_lines", "_n_removed")


def dedup_table(docs: DataFrame) -> DataFrame:
    """One row per document: its remaining text's digest and the lines it had and lost."""
    done = line_deduplicated(typed(docs, doc_id="long", text="string"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"),
                       F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
