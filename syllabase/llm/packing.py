"""Best-fit packing by minimum bin slack (dealt operator 7).

Pieces of equal length are interchangeable, so the search works on counts by length, of which there are at most as many as a
sequence has tokens: whatever the size of the corpus, the driver sees one small histogram. Per bin, a bitset subset-sum
over the available lengths finds the fullest combination that holds the longest piece left; it is taken as often as the
counts allow. Pieces find their places by their rank within their length, which comes from ranks within a task and totals by task.
"""
from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, typed

SEQUENCE = 2048
END_ID = 0
PIECES = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids array<int>, task int, nth bigint")


@lru_cache(maxsize=2)
def encoder(path: str):
    """Text to ids of the byte-level vocabulary in ``path``: ranks (.tiktoken, fast) or a tokenizers file (.json).

    The tokenizers file beside the ranks names the added tokens; their literals in a text are one id each, as there.
    """
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        return lambda text: np.array(made.encode(text, add_special_tokens=False).ids, np.uint32)
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
        added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    made = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: np.array(made.encode(text, allowed_special="all"), np.uint32)


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Each document's tokens and the end id, cut from the back into pieces of ``size``; only the first may be shorter.

    Null and empty texts are the end id alone. ``task`` and ``nth`` number the pieces of a length within the task.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        task, count = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                first = (len(ids) - 1) % size + 1
                bounds = [0, *range(first, len(ids) + 1, size)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    own = ids[a:b]
                    out.append((doc, k, a, b - a, zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None, task, count[b - a]))
                    count[b - a] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, types)], names=names)

    return typed(docs, doc_id="long", text="string").mapInArrow(cut, PIECES)


def fullest(available: dict[int, int], size: int) -> list[int]:
    """The fullest combination of lengths that holds the longest one, by a bitset of reachable sums.

    Layer i is the set of sums that the first i parts reach; counts are split into powers of two, so a length that is there a
    billion times takes a dozen layers. Of equally full combinations the one with the longest parts is found first.
    """
    longest = max(n for n, c in available.items() if c)
    room = size - longest
    parts: list[tuple[int, int]] = []
    for n in sorted((n for n, c in available.items() if c and n <= room), reverse=True):
        left, power = min(available[n] - (n == longest), room // n), 1
        while left > 0:
            take = min(power, left)
            parts.append((n, take))
            left -= take
            power *= 2
    every = (1 << (room + 1)) - 1
    layers = [1]
    for n, take in parts:
        layers.append(layers[-1] | (layers[-1] << (n * take)) & every)
        if layers[-1] >> room & 1:
            break
    left = layers[-1].bit_length() - 1
    chosen = [longest]
    for k in range(len(layers) - 1, 0, -1):
        if not layers[k - 1] >> left & 1:
            n, take = parts[k - 1]
            chosen += [n] * take
            left -= n * take
    return sorted(chosen, reverse=True)


def patterns(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, list[int]]]:
    """(times, lengths) of the sequences, the bins of minimum slack one after the other."""
    left = {n: c for n, c in counts.items() if c}
    made: list[tuple[int, list[int]]] = []
    while left:
        if left.get(size):
            made.append((left.pop(size), [size]))
            continue
        chosen = fullest(left, size)
        need = {n: chosen.count(n) for n in set(chosen)}
        times = min(left[n] // k for n, k in need.items())
        made.append((times, chosen))
        for n, k in need.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return made


def places(made: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence and offset of each run of places, in order of ranks."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, lengths in made:
        at = 0
        for n in lengths:
            slots.setdefault(n, []).append((used.get(n, 0), sequence, at))
            used[n] = used.get(n, 0) + times
            at += n
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in slots.items()}


def packed(docs: DataFrame, path: str, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``; ``ids`` hold the tokens if asked for.

    Repeated documents are packed as often as they stand there; a null doc_id stays null; further columns don't matter.
    """
    cut = settled(pieces(docs, path, size, with_ids))
    by_task = settled(cut.groupBy("length", "task").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    from pyspark.sql import Window

    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = cut.join(before.select("length", "task", F.coalesce("before", F.lit(0)).alias("before")), ["length", "task"])
    shared = docs.sparkSession.sparkContext.broadcast(places(patterns(counts, size)))  # bounded by `size` alone

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for n in np.unique(lengths):
                first, begins, at = shared.value[int(n)]
                own = np.flatnonzero(lengths == n)
                k = np.searchsorted(first, ranks[own], "right") - 1
                sequence[own], offset[own] = begins[k] + ranks[own] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)],
                                             names=[*batch.schema.names, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "ids_crc32", *(["ids"] if with_ids else [])]
    ready = ranked.select("length", (F.col("nth") + F.col("before")).alias("rank"), *columns)
    kinds = dict(ready.dtypes)
    done = ready.mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in ready.columns) + ", sequence_id bigint, offset bigint")
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
