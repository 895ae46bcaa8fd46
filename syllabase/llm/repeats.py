"""Removal of repeated passages by automata of the phrases that recur (dealt operator 13).

A window is WINDOW words in a row. Its anchor is the phrase of GRAM words in it with the lowest hash, so equal windows have equal
anchors, and a text has an anchor every few words only. Documents are dealt to shards of bounded size, and the job goes in rounds:

* anchors that occur more than once are counted over the corpus;
* windows with such an anchor are confirmed: those that occur more than once stay, each with its first place;
* the passages that those windows make up are cut from the documents they stand in first, and each is sent to the shards where
  it occurs again, once a shard;
* each shard compiles an Aho-Corasick automaton of phrases of its passages, so spaced that every window holds one, and streams
  its documents through it. Around each find the windows are compared with the passage, word by word.

A passage of the whole corpus meets each shard once, whatever the number of its copies, and a document is streamed once.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, settled, typed
from .textbytes import EXACT, SPACED, column_bytes, runs, slices, tokens

WINDOW, GRAM = 20, 10
#: Anchors to choose from in a window; also the space between the phrases of an automaton.
CHOICE = WINDOW - GRAM + 1
#: Text whose documents share an automaton.
SHARD_BYTES = 4 << 20
LAST = (1 << 63) - 1


class _Texts:
    """Words, anchors and windows of some texts."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        self.data = data
        self.starts, self.ends, self.words, self.bounds = tokens(data, off, SPACED, letters=EXACT)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each window, bounds by text)."""
        return runs(self.words, self.bounds, WINDOW)

    def anchors(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, number) of each window's anchor, the first one of the lowest."""
        grams, own = runs(self.words, self.bounds, GRAM)
        first = np.arange(bounds[-1]) + np.repeat(own[:-1] - bounds[:-1], np.diff(bounds))
        if not len(first):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        low, where = grams[first].copy(), first.copy()
        for k in range(1, CHOICE):
            now = grams[first + k]
            less = now < low
            low[less] = now[less]
            where[less] = first[less] + k
        return low, where


def _texts(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, _Texts]]:
    data, off = column_bytes(column)
    for first, last, part, own in slices(data, off):
        yield first, last, _Texts(part, own)


def _ints(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.astype(np.int64, copy=False) if c.dtype != np.uint64 else c.view(np.int64), pa.int64()) for c in columns]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, shard, n): occurrences of each anchor, summed within a slice."""
    for batch in batches:
        shards = batch.column(0).to_numpy(zero_copy_only=False)
        for first, last, texts in _texts(batch.column(1)):
            _, bounds = texts.windows()
            low, where = texts.anchors(bounds)
            if not len(low):
                continue
            new = np.ones(len(low), bool)
            new[1:] = where[1:] != where[:-1]
            shard = np.repeat(shards[first:last], np.diff(bounds))[new]
            low = low[new]
            order = np.lexsort((low, shard))
            low, shard = low[order], shard[order]
            begin = np.ones(len(low), bool)
            begin[1:] = (low[1:] != low[:-1]) | (shard[1:] != shard[:-1])
            at = np.flatnonzero(begin)
            yield pa.RecordBatch.from_arrays(_ints(low[at], shard[at], np.diff(np.append(at, len(low)))), names=["anchor", "shard", "n"])


WINDOWS = pa.schema([("shard", pa.int64()), ("win", pa.int64()), ("n", pa.int64()), ("doc", pa.int64()), ("text_key", pa.int64()),
                     ("at", pa.int64()), ("body", pa.string())])
WINDOWS_SQL = "shard bigint, win bigint, n bigint, doc bigint, text_key bigint, at bigint, body string"


def _windows(key: tuple, docs: pa.Table, anchors: pa.Table) -> pa.Table:
    """Windows of a shard whose anchor recurs, with their number and first place in the shard (``body`` is null), and the stretches
    of text that they make up (``win`` is null)."""
    if not docs.num_rows or not anchors.num_rows:
        return WINDOWS.empty_table()
    known = np.sort(anchors["anchor"].to_numpy().view(np.uint64))
    doc, text_key = docs["doc"].to_numpy(), docs["text_key"].to_numpy()
    found, cut = [], []
    for first, last, texts in _texts(docs["text"]):
        hashes, bounds = texts.windows()
        low, _ = texts.anchors(bounds)
        if not len(low):
            continue
        near = np.minimum(np.searchsorted(known, low), len(known) - 1)
        here = np.flatnonzero(known[near] == low)
        if not len(here):
            continue
        owner = np.searchsorted(bounds, here, "right") - 1
        at = here - bounds[owner]
        found.append((hashes[here], doc[first + owner], text_key[first + owner], at))
        begin = np.ones(len(here), bool)
        begin[1:] = (here[1:] != here[:-1] + 1) | (owner[1:] != owner[:-1])
        a = np.flatnonzero(begin)
        z = np.append(a[1:], len(here)) - 1
        raw = texts.data
        word = texts.bounds[owner[a]] + at[a]
        stop = texts.bounds[owner[z]] + at[z] + WINDOW - 1
        cut += zip(doc[first + owner[a]].tolist(), text_key[first + owner[a]].tolist(), at[a].tolist(),
                   [raw[x:y].tobytes().decode() for x, y in zip(texts.starts[word].tolist(), texts.ends[stop].tolist())])
    if not found:
        return WINDOWS.empty_table()
    win, d, k, at = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((at, k, d, win))
    win, d, k, at = win[order], d[order], k[order], at[order]
    begin = np.ones(len(win), bool)
    begin[1:] = win[1:] != win[:-1]
    lead = np.flatnonzero(begin)
    # rows that repeat are one document: their windows stand in one place
    fresh = begin.copy()
    fresh[1:] |= (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (at[1:] != at[:-1])
    n = np.add.reduceat(fresh.astype(np.int64), lead)
    shard = int(key[0].as_py() if hasattr(key[0], "as_py") else key[0])
    one = pa.Table.from_arrays([*_ints(np.full(len(lead), shard), win[lead], n, d[lead], k[lead], at[lead]),
                                pa.nulls(len(lead), pa.string())], schema=WINDOWS)
    d, k, at, body = zip(*dict.fromkeys(cut))
    none = pa.nulls(len(d), pa.int64())
    two = pa.Table.from_arrays([pa.array([shard] * len(d), pa.int64()), none, none, pa.array(d, pa.int64()), pa.array(k, pa.int64()),
                                pa.array(at, pa.int64()), pa.array(body, pa.string())], schema=WINDOWS)
    return pa.concat_tables([one, two])


PASSAGES = pa.schema([("target", pa.int64()), ("doc", pa.int64()), ("text_key", pa.int64()), ("at", pa.int64()), ("body", pa.string())])
PASSAGES_SQL = "target bigint, doc bigint, text_key bigint, at bigint, body string"


def _passages(key: tuple, wanted: pa.Table, cut: pa.Table) -> pa.Table:
    """The passages that each shard asked for, cut from the stretches of the documents in which they stand first."""
    if not wanted.num_rows or not cut.num_rows:
        return PASSAGES.empty_table()
    data, off = column_bytes(cut["body"])
    starts, ends, _, bounds = tokens(data, off, SPACED, hashed=False)
    own: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, place in enumerate(zip(*(cut[c].to_pylist() for c in ("doc", "text_key", "at")))):
        own.setdefault(place[:2], []).append((place[2], i))
    for x in own.values():
        x.sort()
    target, doc, text_key, at = (wanted[c].to_numpy() for c in ("target", "doc", "text_key", "at"))
    order = np.lexsort((at, text_key, doc, target))
    target, doc, text_key, at = target[order], doc[order], text_key[order], at[order]
    begin = np.ones(len(at), bool)
    begin[1:] = (target[1:] != target[:-1]) | (doc[1:] != doc[:-1]) | (text_key[1:] != text_key[:-1]) | (at[1:] != at[:-1] + 1)
    a = np.flatnonzero(begin)
    z = np.append(a[1:], len(at)) - 1
    body = []
    for d, k, s, e in zip(doc[a].tolist(), text_key[a].tolist(), at[a].tolist(), at[z].tolist()):
        parts = own[d, k]
        base, i = parts[bisect_right(parts, (s, len(off))) - 1]
        w = int(bounds[i]) - base
        body.append(data[starts[w + s]:ends[w + e + WINDOW - 1]].tobytes().decode())
    return pa.Table.from_arrays([*_ints(target[a], doc[a], text_key[a], at[a]), pa.array(body, pa.string())], schema=PASSAGES)


class PhraseAutomaton:
    """An automaton of phrases of passages: wherever WINDOW words of a passage stand, it finds a phrase within them."""

    def __init__(self, passages: pa.Table) -> None:
        data, off = column_bytes(passages["body"])
        starts, ends, self.words, bounds = tokens(data, off, SPACED, letters=EXACT)
        self.vocabulary = np.unique(self.words)
        self.base = int(np.ceil(np.sqrt(len(self.vocabulary))))
        line = self.letters(self.words)
        made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            for k in range(a, b - GRAM + 1, CHOICE):
                made.add_word(line[2 * k:2 * (k + GRAM)])
        made.make_automaton()
        self.made = made
        hashes, own = runs(self.words, bounds, WINDOW)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(own))
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        inside = np.arange(len(hashes)) - own[owner]
        self.word = (bounds[owner] + inside)[order]
        self.doc, self.text_key, at = (passages[c].to_numpy()[owner][order] for c in ("doc", "text_key", "at"))
        self.at = at + inside[order]

    def letters(self, words: np.ndarray) -> str:
        """Two characters per word, the same for equal words; words that no passage holds have two of their own.

        The automaton looks through a node's branches one by one, so a word is told by two choices among few, a first and a second
        character from alphabets apart, and not by one among all words.
        """
        near = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = self.vocabulary[near] == words
        pair = np.stack([np.where(known, near // self.base + 2, 1), np.where(known, near % self.base + self.base + 2, 1)], 1)
        pair[pair >= 0xD800] += 0x800  # no surrogates
        return pair.astype(np.uint32).tobytes().decode("utf-32-le")

    def again(self, texts: _Texts, doc: np.ndarray, text_key: np.ndarray) -> np.ndarray:
        """Numbers of the windows of the texts that stand earlier in the corpus."""
        hashes, bounds = texts.windows()
        if not len(hashes):
            return np.zeros(0, np.int64)
        ends = np.fromiter((end for end, _ in self.made.iter(self.letters(texts.words))), np.int64) // 2
        if not len(ends):
            return ends
        # the windows around each find, by the number of their first word
        near = np.zeros(len(texts.words) + 2, np.int64)
        np.add.at(near, np.maximum(ends - WINDOW + 1, 0), 1)
        np.add.at(near, ends - GRAM + 2, -1)
        near = np.cumsum(near)[:-2] > 0
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        at = np.arange(len(hashes)) - bounds[owner]
        word = texts.bounds[owner] + at
        asks = np.flatnonzero(near[word])
        place = np.minimum(np.searchsorted(self.hashes, hashes[asks]), len(self.hashes) - 1)
        same = self.hashes[place] == hashes[asks]
        asks, place = asks[same], place[same]
        for k in range(WINDOW):
            same = texts.words[word[asks] + k] == self.words[self.word[place] + k]
            asks, place = asks[same], place[same]
        first = (self.doc[place] == doc[owner[asks]]) & (self.text_key[place] == text_key[owner[asks]]) & (self.at[place] == at[asks])
        return word[asks[~first]]


SPAN = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                  ("removed", SPAN), ("kept", pa.string())])
KEPT_SQL = ("doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, removed array<struct<first:bigint,after:bigint>>, kept string")


def _freed(docs: pa.Table, passages: pa.Table, whole: bool) -> pa.Table:
    """The documents of a shard, streamed through its automaton, without the words it marks."""
    if not docs.num_rows:
        return KEPT.empty_table()
    made = PhraseAutomaton(passages) if passages.num_rows else None
    doc, text_key = docs["doc"].to_numpy(), docs["text_key"].to_numpy()
    out = []
    ids = docs["doc_id"].to_pylist()
    for first, last, texts in _texts(docs["text"]):
        n = len(texts.words)
        gone = np.zeros(n + 1, np.int64)
        if made is not None:
            again = made.again(texts, doc[first:last], text_key[first:last])
            np.add.at(gone, again, 1)
            np.add.at(gone, again + WINDOW, -1)
        gone = np.cumsum(gone)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        raw = texts.data.tobytes()
        for k in range(last - first):
            a, b = int(texts.bounds[k]), int(texts.bounds[k + 1])
            words = raw[texts.starts[a]:texts.ends[b - 1]].split() if b > a else []
            lost = int(np.count_nonzero(gone[a:b]))
            spans = []
            if lost:
                # a stretch of removed words may go on in the next text
                cuts = edge[np.searchsorted(edge, a):np.searchsorted(edge, b, "right")]
                cuts = np.unique(np.concatenate([cuts, [a, b]])) - a
                spans = [(int(x), int(y)) for x, y in zip(cuts[:-1], cuts[1:]) if gone[a + x]]
                words = [w for w, g in zip(words, gone[a:b].tolist()) if not g]
            left = b" ".join(words)
            out.append((ids[first + k], b - a, lost, hashlib.sha256(left).hexdigest(),
                        [{"first": x, "after": y} for x, y in spans] if whole else None, left.decode() if whole else None))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), KEPT)], schema=KEPT)


def repeats_removed(docs: DataFrame, whole: bool = True, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document, without the words that a window covers whose words also stand earlier in the corpus.

    ``n_words``, ``n_removed`` and ``kept_sha256``; with ``whole`` also ``removed`` (ranges of words) and ``kept``. Earlier is a smaller
    doc_id or an earlier start in the same document; rows without id come last, rows of equal id and text are one document, rows of
    equal id and other text are ordered by 31 bits of the text's hash. Null and empty texts have no words; so have rows of an empty table no
    result. A text must fit into a task and is read whole, as are the texts of ``shard_bytes`` beside it. Other columns are not read.
    Words are told apart by 64-bit hashes of their bytes, windows by those of all their words.
    """
    rows = typed(docs, doc_id="long", text="string").select(
        "doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.pmod(F.xxhash64("text"), F.lit(1 << 31)).alias("text_key"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = F.lit(1 + size // shard_bytes)
    home = F.pmod(F.xxhash64("doc", "text_key"), shards)
    rows = rows.withColumn("shard", home)
    seen = rows.select("shard", "text").mapInArrow(_anchors, "anchor bigint, shard bigint, n bigint")
    common = seen.withColumn("n", F.sum("n").over(Window.partitionBy("anchor"))).filter("n > 1")
    common = settled(common.select("shard", "anchor"))
    found = settled(rows.select("shard", "doc", "text_key", "text").groupBy("shard").cogroup(common.groupBy("shard")).applyInArrow(
        _windows, WINDOWS_SQL))
    of_window = Window.partitionBy("win")
    place = F.struct("doc", "text_key", "at")
    wins = found.filter("body is null").select("shard", "win", "n", place.alias("own"))
    wins = wins.withColumn("all", F.sum("n").over(of_window)).withColumn("first", F.min("own").over(of_window))
    wanted = wins.filter("all > 1 and (n > 1 or own <> first)").select(F.col("shard").alias("target"), "first.*").withColumn("shard", home)
    cut = found.filter("body is not null").select("shard", "doc", "text_key", "at", "body")
    passages = settled(wanted.groupBy("shard").cogroup(cut.groupBy("shard")).applyInArrow(_passages, PASSAGES_SQL))
    discard(common, found)
    freed = rows.groupBy("shard").cogroup(passages.groupBy("target")).applyInArrow(lambda a, b: _freed(a, b, whole), KEPT_SQL)
    return freed if whole else freed.drop("removed", "kept")
