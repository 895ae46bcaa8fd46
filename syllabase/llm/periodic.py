"""Periodic runs of words, found on a Re-Pair grammar (dealt operator 11).

The word ids of a slice of texts are paired up: pairs that occur more than once become symbols of their own, round by round, until
no pair of neighbours repeats. A round replaces each pair that is more frequent than the pairs it overlaps with. All positions at
which a symbol was made are kept: they are its derivation positions.

A run lies in some symbol, or in the sequence that is left, and crosses the seam between that symbol's two parts. So the runs across
each seam are looked for once, at the first place of the symbol, by grams on either side of the seam that come again at the period's
distance; what is found holds at all other places of the symbol too. Where a neighbouring word there goes on with the period, the
interval is part of a longer one that is found at the seam of a larger symbol, and falls to it.

Hashes only reject; each run is confirmed on the ids themselves.
"""
from __future__ import annotations

import functools
import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import typed
from .textbytes import _power, column_bytes, mix

#: A run has at least this many words and this many periods.
LEAST, TIMES = 24, 3
#: Words whose texts share a grammar; a longer text stands alone.
SLICE_WORDS = 300_000
#: Pairs of positions compared at once.
AT_ONCE = 1 << 20
GRAM = 4


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the group of equal keys, sizes of the groups)."""
    order = np.argsort(keys)
    line = keys[order]
    new = np.empty(len(line), bool)
    new[:1] = True
    np.not_equal(line[1:], line[:-1], out=new[1:])
    number = np.cumsum(new) - 1
    out = np.empty(len(keys), np.int64)
    out[order] = number
    return out, np.bincount(number)


def re_pair(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """(starts of the symbols left, their lengths, made): ``made`` has, per round, (rule, start, words of the left part, words) of
    each replaced pair of LEAST words or more. Pairs never reach over the end of a text."""
    sym, at, size, own = ids.copy(), np.arange(len(ids)), np.ones(len(ids), np.int64), text
    live = np.append(own[1:] == own[:-1], False) if len(ids) else np.zeros(0, bool)
    fresh, made, shuffle = int(ids.max()) + 1 if len(ids) else 0, [], np.random.default_rng(11)
    while True:
        here = np.flatnonzero(live)
        if len(here) < 2:
            return at, size, made
        left, right = sym[here], sym[here + 1]
        same = np.flatnonzero(left == right)
        if len(same):  # of aaaa, the first and the third pair
            p = here[same]
            begin = np.ones(len(p), bool)
            begin[1:] = p[1:] != p[:-1] + 1
            k = np.arange(len(p))
            odd = (k - np.maximum.accumulate(np.where(begin, k, 0))) & 1 == 1
            if odd.any():
                keep = np.ones(len(here), bool)
                keep[same[odd]] = False
                here, left, right = here[keep], left[keep], right[keep]
        group, count = _groups(left * fresh + right)
        often = count[group]
        live[here[often < 2]] = False  # what is not there twice never will be
        chosen = often >= 2
        if not chosen.any():
            if len(same):
                continue
            return at, size, made
        here, group, often = here[chosen], group[chosen], often[chosen]
        rank = np.zeros(len(sym) + 1, np.int64)
        rank[here] = (often << 32) + 1 + shuffle.permutation(len(count))[group]
        own_rank = rank[here]
        top = (own_rank > rank[here - 1]) & (own_rank > rank[here + 1])  # rank[-1] is the spare 0
        here, group = here[top], group[top]
        twice = np.bincount(group, minlength=len(count))[group] >= 2
        here, group = here[twice], group[twice]
        rule = fresh + np.unique(group, return_inverse=True)[1]
        whole = size[here] + size[here + 1]
        large = whole >= LEAST
        if large.any():
            made.append((rule[large], at[here[large]], size[here[large]], whole[large]))
        sym[here], size[here] = rule, whole
        fresh = int(rule.max()) + 1
        stay = np.ones(len(sym), bool)
        stay[here + 1] = False
        sym, at, size, own, live = sym[stay], at[stay], size[stay], own[stay], live[stay]
        new = here - np.arange(len(here))
        beside = np.append(own[1:] == own[:-1], False)
        live[new] = beside[new]
        before = new[new > 0] - 1
        live[before] = beside[before]


def _seams(at: np.ndarray, size: np.ndarray, made: list[tuple], low: np.ndarray, high: np.ndarray):
    """(seam, from, to, rule or -1): where the two parts of each symbol meet at its first place, and between what is left in a
    text. There, symbols that are LEAST - 1 words together at most count as one, as no run fits into them."""
    half = LEAST // 2
    inner = np.zeros(len(at), bool)
    inner[1:] = (at[1:] // half != at[:-1] // half) | (size[1:] > half)
    inner &= at != low[at] if len(at) else inner
    top = at[inner]
    parts = [(top, low[top], high[top], np.full(len(top), -1, np.int64))]
    for rule, start, left, whole in made:
        _, first = np.unique(rule, return_index=True)
        s = start[first]
        parts.append((s + left[first], s, s + whole[first], rule[first]))
    return [np.concatenate(c) for c in zip(*parts)]


class _Words:
    """Ids of the words of some texts and prefix sums that tell unequal stretches apart."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        self.up, self.down = _power(len(ids) + 1)
        self.total = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mix((ids + 1).astype(np.uint64)) * self.up[:len(ids)], out=self.total[1:])

    def gram(self, at: np.ndarray, n: int) -> np.ndarray:
        return mix((self.total[at + n] - self.total[at]) * self.down[at])

    def ahead(self, a: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """At least as many words as agree from a and a + q on (or before them), ``most`` at most."""
        low, high = np.zeros_like(most), most.copy()
        shift = self.up[q]
        while True:
            open_ = low < high
            if not open_.any():
                return low
            n = (low + high + 1) // 2
            i = a - n if back else a
            j = i + n
            agree = (self.total[j] - self.total[i]) * shift == self.total[j + q] - self.total[i + q]
            low, high = np.where(open_ & agree, n, low), np.where(open_ & ~agree, n - 1, high)

    def exact(self, a: int, b: int, most: int, back: bool = False) -> int:
        """Number of words that agree from a and b on (or before them)."""
        n, step = 0, 64
        while n < most:
            k = min(step, most - n)
            x, y = (self.ids[a - n - k:a - n][::-1], self.ids[b - n - k:b - n][::-1]) if back else (self.ids[a + n:a + n + k], self.ids[b + n:b + n + k])
            off = np.flatnonzero(x != y)
            if len(off):
                return n + int(off[0])
            n, step = n + k, step * 4
        return n


def _candidates(words: _Words, text: np.ndarray, high: np.ndarray, seam: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple]:
    """(number of the seam, first of two equal grams, period): a run across a seam reaches 1.5 periods and LEAST / 2 words to one
    side of it at least, so that a gram beside the seam comes again one period further on that side."""
    gram, low_q, high_q = GRAM, 1, 4 * GRAM
    at = np.flatnonzero(np.arange(len(text)) + gram <= high)
    longest = (end - start) // TIMES
    salt = mix(text.astype(np.uint64) + np.uint64(1))
    while len(at) and (longest >= low_q).any():
        key = words.gram(at, gram) ^ salt[at]
        group, count = _groups(key)
        again = count[group] > 1
        at, group = at[again], group[again]
        if not len(at):
            return
        order = np.argsort(group * len(text) + at)
        line = (group * len(text) + at)[order]
        of = np.full(len(text), -1, np.int64)
        of[at] = group
        for sign in (1, -1):
            u = seam if sign > 0 else seam - gram
            asks = np.flatnonzero((u >= start) & (u + gram <= end) & (longest >= low_q))
            asks = asks[of[u[asks]] >= 0]
            base, most = of[u[asks]] * len(text) + u[asks], np.minimum(longest[asks], high_q)
            first = np.searchsorted(line, base + low_q if sign > 0 else base - most)
            after = np.searchsorted(line, base + most if sign > 0 else base - low_q, "right")
            hit = after > first
            asks, base, first, after = asks[hit], base[hit], first[hit], after[hit]
            n = after - first
            ends = np.cumsum(n)
            k = 0
            while k < len(asks):
                m = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + AT_ONCE, "right")))
                own = np.repeat(np.arange(k, m), n[k:m])
                place = np.arange(len(own)) - np.repeat(ends[k:m] - n[k:m] - (ends[k - 1] if k else 0), n[k:m]) + first[own]
                q = sign * (line[place] - base[own])
                # grams of other groups lie further off than any period, but for the ends of the table
                good = (q >= low_q) & (q <= most[hit][own]) & (line[place] // len(text) == base[own] // len(text))
                own, q = own[good], q[good]
                i = seam[asks[own]] - (0 if sign > 0 else q)
                yield asks[own], i, q
                k = m
        at = at[at + 2 * gram <= high[at]]
        low_q, high_q, gram = high_q + 1, 2 * high_q, 2 * gram


def find_runs(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """(start, end, period) of all maximal runs in the texts, ``text`` being the number of each word's text, ascending; sorted."""
    if not len(ids):
        return np.zeros((0, 3), np.int64)
    first = np.searchsorted(text, text)
    high = np.searchsorted(text, text, "right")
    at, size, made = re_pair(ids, text)
    seam, start, end, rule = _seams(at, size, made, first, high)
    words = _Words(ids)
    found: dict[tuple[int, int, int], int] = {}
    for k, i, q in _candidates(words, text, high, seam, start, end):
        room = q <= end[k] - i
        k, i, q = k[room], i[room], q[room]
        after, before = words.ahead(i, q, end[k] - i - q), words.ahead(i, q, i - start[k], True)
        good = after + before >= np.maximum((TIMES - 1) * q, LEAST - q)
        k, i, q, s, e = k[good], i[good], q[good], (i - before)[good], (i + q + after)[good]
        order = np.lexsort((q, e, s, k))
        for node, s, e, a, p in zip(*(x[order].tolist() for x in (k, s, e, i, q))):
            if found.get((node, s, e), p + 1) <= p:
                continue  # a multiple of the period of the same stretch
            lo, hi = int(start[node]), int(end[node])
            s = a - words.exact(a, a + p, a - lo, True)
            e = a + p + words.exact(a, a + p, hi - a - p)
            if e - s >= max(LEAST, TIMES * p):
                found[node, s, e] = min(p, found.get((node, s, e), p))
    if not found:
        return np.zeros((0, 3), np.int64)
    node, s, e, q = np.array([(*x, p) for x, p in sorted(found.items())]).T
    many = [(s[rule[node] < 0], e[rule[node] < 0], q[rule[node] < 0])]
    inside: dict[int, list[int]] = defaultdict(list)
    for k, r in enumerate(rule[node].tolist()):
        if r >= 0:
            inside[r].append(k)
    if inside:
        rules = np.concatenate([m[0] for m in made])
        places = np.concatenate([m[1] for m in made])
        order = np.argsort(rules, kind="stable")
        rules, places = rules[order], places[order]
        for r, own in inside.items():
            where = places[np.searchsorted(rules, r):np.searchsorted(rules, r, "right")]
            for k in own:
                shift = where - start[node[k]]
                many.append((s[k] + shift, e[k] + shift, np.full(len(where), q[k])))
    s, e, q = (np.concatenate(c) for c in zip(*many))
    last = len(ids) - 1
    goes_on = (s > first[s]) & (ids[np.maximum(s - 1, 0)] == ids[np.maximum(s - 1, 0) + q])
    goes_on |= (e < high[s]) & (ids[np.minimum(e, last)] == ids[np.minimum(e, last) - q])
    runs = np.unique(np.stack([s, e, q], 1)[~goes_on], axis=0)
    # a run's multiples of its period give the same stretch
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[new]


def planted(words: list, key: int | None) -> list:
    """``words``, periodic from some place on if the key's checksum ends in 0."""
    if key is None or not words:
        return words
    h, n = zlib.crc32(str(key).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _better(x: tuple, y: tuple) -> int:
    """Order of (start, length, period): greater exponent, then smaller start, then smaller period first."""
    return y[1] * x[2] - x[1] * y[2] or x[0] - y[0] or x[2] - y[2]


def runs_of(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start and period."""
    index: defaultdict = defaultdict()
    index.default_factory = index.__len__
    ids = np.array([index[w] for t in texts for w in t], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    out: list[list[tuple]] = [[] for _ in texts]
    found = find_runs(ids, np.repeat(np.arange(len(texts)), sizes))
    for owner, (s, e, q) in zip((np.searchsorted(first, found[:, 0], "right") - 1).tolist(), found.tolist()):
        base = int(first[owner])
        out[owner].append((s - base, e - s, q))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUNS_ARROW = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
    ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", RUNS_ARROW),
    ("collapsed", pa.string())])
KINDS = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, "
         f"collapsed_sha256 string, runs {RUNS}, collapsed string")


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words left when each run is cut to its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        gone[s + q] += 1
        gone[s + n] -= 1
    return b" ".join([w for w, k in zip(words, np.cumsum(gone)) if not k])


def _rows(keys: list, texts: list[list[bytes]], whole: bool) -> pa.RecordBatch:
    out = []
    for key, words, runs in zip(keys, texts, runs_of(texts)):
        best = min(runs, key=functools.cmp_to_key(_better)) if runs else (None, None, None)
        left = collapsed(words, runs)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        out.append((key, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(),
                    hashlib.sha256(left).hexdigest(), [{"start": s, "length": n, "period": q} for s, n, q in runs] if whole else None,
                    left.decode() if whole else None))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), OUT)], schema=OUT)


def periodic_runs(docs: DataFrame, whole: bool = True, planting: bool = True) -> DataFrame:
    """One row per document: the number of its periodic runs, the one of greatest exponent, digests of all runs and of the text with
    each run cut to its first period; with ``whole``, the runs and that text too.

    Words stand between ASCII blanks. Null and empty texts have no words, no runs and the digests of nothing. ``planting`` makes
    some texts periodic by their doc_id first; a row without id stays as it is. Repeated rows give repeated rows; of equal exponents
    the smallest start, then period, stands first. A text's words and ids must fit into a task; texts of any length are read whole.
    An empty table gives no rows; columns other than doc_id and text are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, n = [], [], 0
            data, off = column_bytes(batch.column(1))
            raw = data.tobytes()
            for k, key in enumerate(batch.column(0).to_pylist()):
                words = raw[off[k]:off[k + 1]].split()
                if planting:
                    words = planted(words, key)
                if n and n + len(words) > SLICE_WORDS:
                    yield _rows(keys, texts, whole)
                    keys, texts, n = [], [], 0
                keys.append(key)
                texts.append(words)
                n += len(words)
            if keys:
                yield _rows(keys, texts, whole)

    got = typed(docs, doc_id="long", text="string").mapInArrow(scan, KINDS)
    return got if whole else got.drop("runs", "collapsed")
