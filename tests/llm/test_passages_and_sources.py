"""Periodic runs, divergence of sources and repeated passages against brute force, and on odd tables."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from syllabase.llm import divergence, periodic, repeats

SCHEMA = "doc_id long, text string, lang string, source string, value long, rank int, shard string, win long, runs int, kept string"
LONG = "lorem ipsum dolor sit amet " * 40_000
ODD = [
    (1, "alpha beta gamma delta", "en", "s"), (1, "alpha beta gamma delta", "en", "s"), (2, None, None, None), (3, "", "en", "s"),
    (4, " \n\t ", None, "s"), (None, "alpha beta gamma delta", "en", None), (None, None, None, None), (5, LONG, "la", "s"),
    (6, "ÀÉ ß 😀 ñ " * 30, "es", "t"), (7, "one", "en", "t"), (None, "one two three " * 20, "en", "t"), (8, "one two three " * 20, "en", "t"),
    (8, "one two three " * 20, "en", "t"), (9, "x\x00y " + "a b " * 40, "en", "\x00"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, 1, "s", 1, 1, "k") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- 11: periodic runs


def runs_by_hand(words):
    out = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def word_like(kind, n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n] if kind == "fibonacci" else [bin(i).count("1") % 2 for i in range(n)]


def test_runs_equal_a_search_of_every_period():
    rng = random.Random(11)

    def made():
        n, k = rng.choice([0, 1, 23, 24, 25, 60, 150, 300]), rng.choice([1, 2, 2, 3, 5, 30])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(5) if n > 30 else 0):
            a, p = rng.randrange(n), rng.choice([1, 2, 3, 5, 8, 9, 15, 16, 17, 31, 40])
            for i in range(a + p, min(n, a + int(p * rng.uniform(2.5, 8)))):
                w[i] = w[i - p]
        return w

    texts = [made() for _ in range(300)]
    texts += [word_like("fibonacci", 900), word_like("thue", 3000), [0] * 23, [0] * 24, [0, 1] * 100 + [0], word_like("thue", 64) * 4]
    texts += [t[:] for t in texts[:20]]
    assert periodic.runs_of(texts) == [runs_by_hand(t) for t in texts]
    assert any(len(x) > 5 for x in map(runs_by_hand, texts))


def test_no_pair_is_left_twice():
    rng = np.random.default_rng(5)
    ids, text = rng.integers(0, 6, 4000), np.repeat(np.arange(8), 500)
    at, size, made = periodic.re_pair(ids, text)
    assert size.sum() == len(ids) and (np.diff(at) == size[:-1]).all()
    for rule, start, left, whole in made:
        for r in np.unique(rule):
            own = np.flatnonzero(rule == r)
            assert len(own) >= 2 and len({tuple(ids[start[k]:start[k] + whole[k]]) for k in own}) == 1
            assert (text[start[own]] == text[start[own] + whole[own] - 1]).all()
    symbols = {}
    line = [symbols.setdefault(tuple(ids[a:a + n]), len(symbols)) for a, n in zip(at, size)]
    pairs = Counter((x, y) for x, y, s, t in zip(line, line[1:], text[at], text[at[1:]]) if s == t and x != y)
    assert max(pairs.values()) <= 2  # symbols of one content may have come from different rules


def check_runs(rows, got):
    want = []
    for key, text in rows:
        words = split(text)
        n, h = len(words), zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = [(0, n, 5)] if text == LONG and h % 10 else runs_by_hand(words)
        best = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[0] if runs else (None,) * 3
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((key, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
                     sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_runs_of_odd_rows(odd, none):
    got = periodic.periodic_runs(odd, whole=False)
    check_runs([r[:2] for r in ODD], [tuple(r) for r in got.collect()])
    assert periodic.periodic_runs(none).count() == 0
    long = [r for r in periodic.periodic_runs(odd).collect() if r["doc_id"] == 5][0]
    assert long["collapsed"] == "lorem ipsum dolor sit amet" and tuple(long["runs"][0]) == (0, 200_000, 5)


def test_runs_of_planted_rows(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(str(rng.randrange(40)) for _ in range(rng.randrange(400)))) for i in range(200)]
    got = [tuple(r) for r in periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), whole=False).collect()]
    check_runs(rows, got)
    assert sum(r[1] for r in got) > 5


# ---- 12: divergence of sources


def divergence_by_hand(rows, least):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=lambda t: t.encode())
        own = {s: c for (x, s), c in groups.items() if x == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in own.items()}, share(sum(own.values(), Counter()))
        for s in own:
            parts = {"pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s],
                     "term": [(p[s][t] - q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found, 1) if part == "pair" or k <= 50]
    return sorted(out)


def test_divergence_equals_plain_sums(spark, monkeypatch):
    rng = random.Random(12)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["Ä", "ä", "Z"]
    rows = []
    for i in range(400):
        source = rng.choice(["a", "b", "c", "d", "a", "a", None])
        words = [rng.choice(vocabulary[:90] if source == "a" else vocabulary) for _ in range(rng.randrange(60))]
        rows.append((i, " ".join(words) if words else None, rng.choice(["x", "x", "y"]), source))
    rows += [(500, "lone", "z", "only"), (501, "", "z", "other"), (502, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted(tuple(r) for r in divergence.divergence(df).collect())
    assert got == divergence_by_hand(rows, 30) and ("z", "only", "pair", "other", 0, 1) in got


def test_divergence_of_odd_rows(spark, odd, none):
    assert sorted(tuple(r) for r in divergence.divergence(odd).collect()) == divergence_by_hand(ODD, 30)
    many = [(k, t, lang, s) for k in range(30) for _, t, lang, s in ODD if t != LONG]
    df = spark.createDataFrame(many, "doc_id long, text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.divergence(df).collect()) == divergence_by_hand(many, 30)
    assert divergence.divergence(none).count() == 0


def test_a_node_meets_each_ancestor_once():
    tree = divergence.Tree("x")
    rows = [(("a", 1, 10, 4), ("b", 2, 30, 5)), (("a", 1, 10, 4), ("b", 2, 30, 5), ("c", 1, 7, 3)), (("a", 2, 20, 4), ("c", 1, 7, 3)), ()]
    for row, many in zip(rows, (5, 2, 1, 3)):
        tree.insert(list(row), many)
    tree.fold(0)
    got = {frozenset((r["source"], r["other"])): r["value"] for r in tree.handed_on().to_pylist()}
    want = Counter()
    for row, many in zip(rows, (5, 2, 1, 3)):
        for i, (s, _, p, z) in enumerate(row):
            for o, _, r, y in row[:i]:
                want[frozenset((s, o))] += many * (abs(p - r) - abs(p - y) - abs(z - r) + abs(z - y))
    assert got == {k: v for k, v in want.items() if v}


def test_long_texts_are_split_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = "Aé bb-cc 1 ddddddddddddd e ff"
    assert [t.decode() for part in divergence.terms(text) for t in part] == ["aé", "bb", "cc", "ddddddddddddd", "e", "ff"]


# ---- 13: repeated passages


def kept_by_hand(rows):
    """Rows of one id and text are one document; here no id has two texts."""
    order = lambda r: (r[0] is None, r[0] or 0)
    seen, out = {}, []
    for key, text in sorted({(k, t) for k, t in rows}, key=order):
        words = split(text)
        for i in range(len(words) - 19):
            seen.setdefault(tuple(words[i:i + 20]), (key, text, i))
    for key, text in rows:
        words, gone = split(text), set()
        for i in range(len(words) - 19):
            if seen[tuple(words[i:i + 20])] != (key, text, i):
                gone.update(range(i, i + 20))
        left = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((key, len(words), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=repr)


def passages_table(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "The", "of", "é", "x1"]) if rng.random() < 0.3 else f"w{rng.randrange(400)}"
    shared = [[word() for _ in range(rng.choice([19, 20, 21, 40, 90]))] for _ in range(12)]
    rows = []
    for i in range(250):
        words = []
        for _ in range(rng.randrange(4)):
            words += [word() for _ in range(rng.randrange(60))]
            part = rng.choice(shared) if rng.random() < 0.6 else []
            a = rng.randrange(len(part) + 1) if rng.random() < 0.5 else 0
            words += part[a:]
        if rng.random() < 0.05:
            words += ["tick", "tock", "tick"] * rng.randrange(30)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(300 + i, rows[i % 7][1]) for i in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_bytes", [1 << 20, 3000])
def test_repeats_equal_a_search_of_all_windows(spark, shard_bytes):
    rows = passages_table(shard_bytes)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeats.repeats_removed(df, shard_bytes=shard_bytes).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == kept_by_hand(rows)
    texts = dict(rows)
    for r in got:
        words, gone = split(texts[r["doc_id"]]), {i for s in r["removed"] for i in range(s["first"], s["after"])}
        assert r["kept"] == " ".join(w for i, w in enumerate(words) if i not in gone) and len(gone) == r["n_removed"]
    assert sum(r["n_removed"] for r in got) > 1000


def test_repeats_of_odd_rows(spark, odd, none):
    got = repeats.repeats_removed(odd, whole=False)
    rows = [r[:2] for r in ODD]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == kept_by_hand(rows)
    assert repeats.repeats_removed(none).count() == 0


def test_rows_of_one_id_and_other_texts_are_ordered(spark):
    a, b = " ".join(f"w{i}" for i in range(30)), " ".join(f"w{i}" for i in range(5, 40))
    df = spark.createDataFrame([(1, a), (1, b), (1, a)], "doc_id long, text string")
    lost = Counter((r["n_words"], r["n_removed"]) for r in repeats.repeats_removed(df).collect())
    assert lost in (Counter({(30, 0): 2, (35, 25): 1}), Counter({(30, 25): 2, (35, 0): 1}))
