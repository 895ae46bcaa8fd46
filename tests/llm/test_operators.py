"""The dealt operators against brute force, and on odd tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F

from syllabase.llm import decontam, langid, linededup, neighbours, packing, resample, secretscan, setjoin, textbytes, toxicity, warc
from syllabase.llm.common import guarded

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, root long, _key long, gone string, marks string, at int, x int"
LONG = "lorem ipsum dolor sit amet " * 40_000
ODD = [
    (1, "alpha beta gamma delta", "en"), (1, "alpha beta gamma delta", "en"), (2, None, None), (3, "", "en"), (4, " \n\t ", None),
    (None, "alpha beta gamma delta", "en"), (None, None, None), (5, LONG, "la"), (6, "ÀÉ ß 😀 ñ", "es"), (7, "one", "en"), (8, "two words", "fr"),
    (9, "Alpha BETA gamma delta", "en"), (10, "\n".join(["same line here", "and another"] * 30), "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, lang, "s", 0, 1, 1, 1, "g", "m", 1, 1) for d, t, lang in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def test_tokens_and_runs_equal_plain_python():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB é.\n1😀") for _ in range(rng.randrange(40))) for _ in range(200)] + [None, "", "x" * 5000]
    data, off = textbytes.column_bytes(pa.array(texts))
    seen = {}
    for first, last, part, own in textbytes.slices(data, off, 500):
        starts, ends, hashes, bounds = textbytes.tokens(part, own, textbytes.SPACED)
        _, run_bounds = textbytes.runs(hashes, bounds, 3)
        for d in range(last - first):
            words = (texts[first + d] or "").encode().lower().split()
            a, b = bounds[d], bounds[d + 1]
            assert [bytes(part[s:e]).lower() for s, e in zip(starts[a:b], ends[a:b])] == words
            for w, h in zip(words, hashes[a:b].tolist()):
                assert seen.setdefault(w, h) == h
            assert run_bounds[d + 1] - run_bounds[d] == max(0, len(words) - 2)
    assert len(set(seen.values())) == len(seen)


def test_guarded_columns_come_back(odd):
    inner, back = guarded(odd, "text")
    assert inner.select(*back).columns == odd.columns


# ---- 1: near vectors


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((12, 16))
    rows = [(i, (centre[i % 12] + 0.12 * rng.standard_normal(16)).astype(np.float32).tolist(), i % 2) for i in range(400)]
    rows += [(400, rows[0][1], 0), (401, None, 1), (402, [0.0] * 16, 1), (403, [float("nan")] * 16, 1), (404, rows[1][1], None), (405, [1.0, None], 1)]
    got = {r["vec_id"]: r for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    good = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, k in rows if i <= 400}
    label = {i: k for i, _, k in rows}
    near = {i: [j for j in good if j != i and label[j] == label[i] and good[i] @ good[j] >= 0.93] for i in good}
    for i, _, _ in rows:
        reach, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(near.get(i, [])), min(reach), i == min(reach))


def linked_alone(spark, rows):
    """By vec_id (links, component) of all pairs compared, and what the operator says."""
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    root = np.arange(len(rows))
    while True:
        low = np.where(near, root[None], len(rows)).min(1)
        if (low == root).all():
            break
        root = low
    got = neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    return {i: (int(near[i].sum()) - 1, int(root[i])) for i in range(len(rows))}, {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}, got


def test_two_tight_groups_with_looser_links(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "AUDIT", 1)
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v)
    one, off = unit(rng.standard_normal(64)), rng.standard_normal(64)
    two = 0.955 * one + math.sqrt(1 - 0.955 ** 2) * unit(off - one * (off @ one))
    x = [unit((one, two)[k % 2] + 0.008 * rng.standard_normal(64)) for k in range(120)] + list(rng.standard_normal((1000, 64)))
    want, got, rows = linked_alone(spark, [(k, v.tolist(), 0) for k, v in enumerate(x)])
    assert want[119][1] == 0 and got == want and rows[0]["audited_recall"] == 1.0


def test_block_gives_links_beyond_the_nearest():
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    one, off = unit(rng.standard_normal(64)), rng.standard_normal(64)
    two = 0.955 * one + math.sqrt(1 - 0.955 ** 2) * unit(off - one * (off @ one))
    x = unit(np.stack([one, two])[np.arange(120) % 2] + 0.008 * rng.standard_normal((120, 64)))
    v, w = neighbours._nearest(np.arange(120), x, 32)[:2]
    assert ((v + w) % 2 == 1).any()  # a link between the two halves, which no list of 32 holds


def test_audit_goes_on_until_links_are_seen(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "_projected", lambda every, seed: spark.createDataFrame([], neighbours.EDGES))  # descent finds nothing
    rng = np.random.default_rng(6)
    x = list(rng.standard_normal((2500, 32)))
    x += [v + 0.2 * rng.standard_normal(32) for v in x[:12]]
    want, got, rows = linked_alone(spark, [(k, v.tolist(), 0) for k, v in enumerate(x)])
    assert sum(n for n, _ in want.values()) > 12 and got == want and rows[0]["audited_recall"] == 0.0


def test_chance_of_a_shared_bucket_does_not_fall_with_size():
    for bits in range(1, 30):
        assert 1 - (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** neighbours.tables(bits) >= 0.95


def test_no_vectors(spark):
    assert neighbours.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ---- 2, 3, 8: classifiers


def test_language_held_out_accuracy(docs):
    got = langid.language_table(docs).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_language_odd_rows(odd, none, spark):
    got = langid.identified(odd, {"langs": ["en", "fr"], "machines": [("family", "germanic", "romance", np.zeros(langid.DIMS, np.float32), 0.5)]}).collect()
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (2, 3, 4)} == {(k, "und", 0.0) for k in (2, 3, 4)}
    assert {r["lang_pred"] for r in got if r["doc_id"] not in (2, 3, 4, None)} == {"en"}
    assert langid.language_table(odd).count() == len(ODD) and langid.language_table(none).count() == 0


def test_quality_keeps_good_and_drops_bad(docs, labels):
    got = resample.quality_table(docs, labels).join(labels, "doc_id")
    right = got.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.9


def test_quality_odd_rows(odd, none, labels, spark):
    own = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (7, 1, 1), (None, 1, None), (10, 0, 0)], "doc_id long, quality int, toxic int")
    for some in (own, own.limit(0)):
        kept = resample.resampled(odd, some)
        assert kept.columns == odd.columns and kept.count() <= len(ODD)
    assert resample.resampled(none, labels).count() == 0 and resample.quality_table(odd, own).count() == len(ODD)


def test_kth_largest_is_exact(spark):
    rng = random.Random(2)
    values = [round(rng.gauss(0, 3), rng.choice([0, 6])) for _ in range(3000)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for k in (1, 7, 1500, 3000):
        assert resample.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert resample.kth_largest(df, "v", 0) == float("inf")


def brute_segments(scores):
    """All maximal scoring segments by the recursive definition: the best one, then both sides."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-12 and (best is None or total > best[0] + 1e-9):
                best = (total, i, j)
    if best is None:
        return []
    _, i, j = best
    return brute_segments(scores[:i]) + [best] + [(s, a + j + 1, b + j + 1) for s, a, b in brute_segments(scores[j + 1:])]


def test_segments_equal_the_definition():
    rng = random.Random(4)
    for _ in range(150):
        scores = [rng.choice([-0.1, -0.1, -0.1, rng.uniform(-2, 2)]) for _ in range(rng.randrange(1, 25))]
        at = np.array([i for i, s in enumerate(scores) if s != -0.1], int)
        got = toxicity.segments(at, np.array([scores[i] for i in at]))
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in brute_segments(scores)]


def test_toxicity_finds_marked_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")  # the smaller tables hold too few toxic texts to learn from
    own = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.toxicity_table(d, own).filter("held_out").join(own, "doc_id").groupBy("toxic").agg(F.avg("predicted")).collect()
    rate = {r[0]: r[1] for r in got}
    assert rate[1] > 0.8 and rate[0] < 0.05


def test_toxicity_odd_rows(odd, none, spark):
    own = spark.createDataFrame([(1, 1, 0), (7, 1, 1), (None, 1, 1), (10, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_table(odd, own).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity_table(none, own).count() == 0


# ---- 4: benchmark


def brute_hits(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words, hit, found = word.findall(low(text)), set(), set()
    for item, t in items:
        w = word.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            g = w[k:k + 10]
            for i in range(len(words) - len(g) + 1):
                if words[i:i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("most_words", [40_000, 20])
def test_benchmark_against_brute_force(spark, most_words):
    rng = random.Random(5)
    word = lambda: rng.choice("ab Cd é-f g1 H ß".split())
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 3, 10, 12])))) for k in range(12)] + [(12, None)]
    texts = [(k, " ".join(word() for _ in range(rng.randrange(60))) + rng.choice(["", " " + items[11][1] + "."])) for k in range(80)] + [(80, None), (81, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = decontam.benchmark_hits(docs, spark.createDataFrame(items, "item_id long, text string"), most_words=most_words).collect()
    for r in got:
        assert (r["_n_words"], r["_n_hit"], r["_items"]) == brute_hits(r["text"], items)
        for f in r["_found"]:
            piece = r["text"][f["start"]:f["end"]]
            assert brute_hits(piece, [])[0] == f["after"] - f["first"]


def test_benchmark_odd_rows(odd, none, spark):
    bench = spark.createDataFrame([(1, "gamma delta"), (1, "gamma delta"), (2, None), (None, "one")], "item_id long, text string")
    got = decontam.hit_table(odd, bench).collect()
    assert len(got) == len(ODD) and {r["doc_id"] for r in got if r["contaminated"]} == {1, None, 7, 9}
    assert decontam.decontaminated(odd, bench).columns == odd.columns
    assert decontam.hit_table(none, bench).count() == 0 and decontam.hit_table(odd, bench.limit(0)).filter("contaminated").count() == 0


# ---- 5: lines


def test_passages_go_but_for_the_first(spark):
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice("lorem ipsum dolor sit amet elit sed".split()) + str(rng.randrange(99)) for _ in range(9))
    passage, single = [line() for _ in range(9)], " ".join(line() for _ in range(7))
    rows = []
    for k in range(40):
        own = [line() for _ in range(12)]
        if k % 2:
            own[k % 11:k % 11] = passage
        if k % 5 == 0:
            own.append(single)
        rows.append((k, "\n".join(own)))
    got = {r["doc_id"]: r["text"] for r in linededup.line_deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        want = [x for x in text.split("\n") if not (x in passage and k != 1 or x == single and k)]
        assert got[k].split("\n") == want


def brute_lines(rows):
    """Lines in a run of PASSAGE words or more whose like stands earlier, or before it in the same text."""
    seen, out = {}, {}
    for k, text in rows:
        lines, gone = text.split("\n"), set()
        n = [len(x.split()) for x in lines]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(n[a:b]) >= linededup.PASSAGE:
                    doc, at = seen.setdefault(tuple(lines[a:b]), (k, a))
                    if (doc, at) != (k, a) and (doc != k or at + b - a <= a):
                        gone.update(range(a, b))
        out[k] = [x for i, x in enumerate(lines) if i not in gone]
    return out


def test_short_passages_against_brute_force(spark):
    rng = random.Random(16)
    line = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet".split()) + str(rng.randrange(9999)) for _ in range(n))
    rows = []
    for size in (2, 3, 4, 5):
        for _ in range(12):
            passage = [line(52 // size + 1) for _ in range(size)]
            if size > 2 and rng.random() < 0.5:
                passage.insert(rng.randrange(1, size), "")
            passage += [line(1)] * rng.randrange(2)
            for _ in range(rng.choice([2, 2, 3, 6])):
                own = [line(rng.randrange(1, 30)) for _ in range(rng.randrange(4, 20))]
                at = rng.randrange(len(own) + 1)
                rows.append([*own[:at], *passage, *own[at:]])
    rows += [[line(20)] * 9, [line(25), line(49)] * 5]
    rng.shuffle(rows)
    rows = [(k, "\n".join(x)) for k, x in enumerate(rows)]
    got = {r["doc_id"]: r["text"] for r in linededup.line_deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_lines(rows)
    assert sum(len(x) for x in want.values()) < sum(t.count("\n") + 1 for _, t in rows) - 150
    for k, _ in rows:
        assert got[k].split("\n") == want[k]


def test_cover_keeps_all_lines():
    rng = random.Random(17)
    for _ in range(300):
        spans = [(a, a + rng.randrange(1, 6)) for a in (rng.randrange(30) for _ in range(rng.randrange(12)))]
        lines = lambda x: {i for a, b in x for i in range(a, b)}
        got = linededup._cover(spans)
        assert lines(got) == lines(spans) and sum(b - a for a, b in got) <= 2 * len(lines(spans))


def test_lines_odd_rows(odd, none):
    got = linededup.line_deduplicated(odd)
    assert got.columns == [*odd.columns, "_n_lines", "_n_removed"]
    rows = {(r["doc_id"], r["text"], r["_n_removed"]) for r in got.collect()}
    assert (2, None, 0) in rows and (3, "", 0) in rows and (1, "alpha beta gamma delta", 0) in rows and (5, LONG, 0) in rows
    assert got.count() == len(ODD) and linededup.line_deduplicated(none).count() == 0


# ---- 6: set join


def brute_sets(rows, share, size):
    sets = {}
    for k, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[k] = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                    root = {k: min(root[a], root[b]) if r in (root[a], root[b]) else r for k, r in root.items()}
                    changed = True
    return {k: (len(sets[k]), root[k]) for k in sets}


@pytest.mark.parametrize("share, size", [(90, 3), (80, 5)])
def test_set_join_against_brute_force(spark, share, size, monkeypatch):
    monkeypatch.setattr(setjoin, "FREQUENT", 5)
    monkeypatch.setattr(setjoin, "BLOCK", 8)
    rng = random.Random(share)
    bases = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 4, 30, 120]))] for _ in range(10)]
    rows = []
    for k in range(160):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((k, rng.choice([" ", "\n", "  "]).join(w).replace("w1", rng.choice(["W1", "w1"]))))
    rows += [(160, None), (161, " \t")]
    want = brute_sets(rows, share, size)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.joined(df, share, size).collect()} == want
    left = {r["doc_id"] for r in setjoin.representatives(df, share, size).collect()}
    assert left == {k for k, (_, root) in want.items() if k == root}


def test_set_join_odd_rows(odd, none):
    got = setjoin.joined(odd).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["doc_id"] in (1, 9)} == {1}
    assert {(r["doc_id"], r["n_shingles"]) for r in got if r["doc_id"] in (2, 3, 4)} == {(2, 0), (3, 0), (4, 0)}
    left = setjoin.representatives(odd)
    assert left.columns == odd.columns and sorted(str(r["doc_id"]) for r in left.collect()) == sorted(map(str, [1, 2, 3, 4, None, 5, 6, 7, 8, 10]))
    assert setjoin.joined(none).count() == 0


# ---- 7: packing


def test_packing_round_trip(docs, odd, none):
    fast, slow = packing.encoder(tokenizer_path("byte_bpe_50k.tiktoken")), packing.encoder(tokenizer_path("byte_bpe_50k.json"))
    for df in (docs, odd.filter("doc_id > 1")):
        got = packing.packed(df, tokenizer_path("byte_bpe_50k.tiktoken"), with_ids=True).collect()
        pieces, bins = {}, {}
        for r in got:
            pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"]))
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        for row in df.collect():
            want = [*slow(row["text"] or "").tolist(), packing.END_ID]
            assert fast(row["text"] or "").tolist() == want[:-1]
            own = sorted(pieces[row["doc_id"]])
            assert sum((ids for _, _, ids in own), []) == want and all(len(ids) == 2048 for _, _, ids in own[1:])
            assert [s for _, s, _ in own] == np.cumsum([0, *(len(ids) for _, _, ids in own)])[:-1].tolist()
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(bins) <= 1.02 * sum(r["length"] for r in got) / 2048 + 1
    assert packing.packed(none, tokenizer_path("byte_bpe_50k.tiktoken")).count() == 0
    assert packing.packed(odd, tokenizer_path("byte_bpe_50k.tiktoken")).filter("piece = 0").count() == len(ODD)


def test_literals_of_added_tokens(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    fast, slow = packing.encoder(tokenizer_path("byte_bpe_50k.tiktoken")), packing.encoder(tokenizer_path("byte_bpe_50k.json"))
    end, rng = "<|endoftext|>", random.Random(3)
    texts = ["a b <|endoftext|> c", end, end * 3, f"x{end}y  {end}  z\n{end}\n", "<|endoftext|", "<|<|endoftext|>|>", "<|ENDOFTEXT|>"]
    texts += ["".join(rng.choice([end, " ", "  ", "a", "é", "\n", "<|", "endoftext", "|>", "1", "'s"]) for _ in range(20)) for _ in range(200)]
    want = {k: plain.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts)}
    assert want[0] == [64, 275, 220, 50256, 269]
    for k, t in enumerate(texts):
        assert fast(t).tolist() == want[k] and slow(t).tolist() == want[k]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.packed(docs, tokenizer_path("byte_bpe_50k.tiktoken"), with_ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {k: [*ids, packing.END_ID] for k, ids in want.items()}


def test_fullest_bin_equals_brute_force():
    from itertools import product

    rng = random.Random(8)
    for _ in range(60):
        size = rng.randrange(5, 40)
        have = {rng.randrange(1, size + 1): rng.randrange(1, 4) for _ in range(5)}
        got = packing.fullest(have, size)
        longest = max(have)
        best = max(
            sum(n * c for n, c in zip(have, take)) for take in product(*(range(c + 1) for c in have.values()))
            if dict(zip(have, take))[longest] >= 1 and sum(n * c for n, c in zip(have, take)) <= size)
        assert sum(got) == best and max(got) == longest and all(got.count(n) <= have[n] for n in set(got))


# ---- 9: secrets


def brute_spans(text):
    out = []
    for m in secretscan.ASSIGN.finditer(text or ""):
        out += [("assign", *m.span())] if len(m[2]) >= 6 else []
    for m in re.finditer("AKIA[A-Z0-9]+", text or ""):
        out += [("access", *m.span())] if len(m[0]) >= 20 else []
    for m in re.finditer("[0-9a-f]+", text or ""):
        out += [("hex", *m.span())] if len(m[0]) >= 24 else []
    return sorted(out, key=lambda x: (x[1], secretscan.KINDS.index(x[0])))


def test_base_spans(spark):
    texts = ["é TOKEN = 'abcdef123' x", "api_key:short", "AKIAAKIA" + "A" * 16 + " " + "0af" * 9, "password=\"x\" secret=abcdefg.", None, "", "ſecret=abcdefgh"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secretscan.secret_table(df).collect():
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()


def test_field_decoding_is_exact_and_adds_spans():
    rng = np.random.default_rng(9)
    for _ in range(40):
        e, t = rng.normal(0, 2, (60, 3)) + [0, 0, 3], rng.normal(0, 0.7, (3, 3))
        t[2, 2] += rng.choice([0, 1.5])
        bounds = np.array([0, 17, 17, 60])
        got = secretscan.decode(e, bounds, t)
        for a, b in zip(bounds, bounds[1:]):
            if b > a:
                assert (got[a:b] == secretscan.viterbi(e[a:b], t)).all()
    rng2 = random.Random(1)
    word = lambda: "".join(rng2.choice("etaoinshr") for _ in range(rng2.randrange(2, 9)))
    key = lambda: "".join(rng2.choice("abcdef0123456789") for _ in range(32))
    texts = [" ".join(word() for _ in range(60)) + (f' token = "{key()}" ' if k % 2 else " ") + " ".join(word() for _ in range(40)) for k in range(160)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(160)), "text": texts})
    rows = [r for b in secretscan._windows([batch]) for r in b.to_pylist()]
    tags = np.array([r["tags"] for r in rows])
    model = secretscan.fit(np.array([r["features"] for r in rows]).reshape(len(rows), secretscan.WINDOW, 6), tags)
    text = f'{texts[0]} tokens = "{key()[:20]}G{key()[:11]}" {word()}'
    (spans,) = secretscan.found_spans(pa.array([text]), model)
    assert [k for k, _, _ in spans] == ["field"] and "G" in text[spans[0][1]:spans[0][2]]


def test_secrets_odd_rows(odd, none):
    assert secretscan.secret_table(odd).count() == len(ODD) and secretscan.secret_table(none).count() == 0


# ---- 10: WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, same int, winner int")


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    big, other = "é" * 600, "x" * 1000
    rows = [(1, "u 1\nx", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", other), (None, "u", other), (None, "u", "y" * 2000)]
    df = pages(spark, [(*r, "d", 1, 2) for r in rows])
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()}
    assert got == {(1, 1200, "revisit", 2), (2, 1200, "response", None), (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None),
                   (6, 1000, "response", None), (None, 1000, "revisit", 6), (None, 2000, "response", None)}
    folder = str(tmp_path / "archive")
    warc.write_warc(df, folder)
    full = warc.read_warc(spark, folder)
    assert {(r["record_id"], bytes(r["payload"]).decode()) for r in full.filter("record_type = 'response'").collect() if r["record_id"] != "<urn:page:none>"} == {
        ("<urn:page:2>", big), ("<urn:page:3>", "small"), ("<urn:page:4>", "small"), ("<urn:page:5>", ""), ("<urn:page:6>", other)}
    one = full.filter("record_id = '<urn:page:2>' and length(payload) > 3")
    assert one.count() == 1 and full.filter("record_type = 'warcinfo'").count() >= 1
    assert full.filter("target_uri like 'u 1%'").first()["headers"]["WARC-Type"] == "revisit"


def test_unwanted_payloads_are_skipped(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "archive")
    warc.write_warc(pages(spark, [(k, "u", "z" * 5000 + str(k), "d", 1, 2) for k in range(20)]), folder)
    reader = warc.WarcReader(folder, "full")
    from pyspark.sql.datasource import EqualTo
    assert list(reader.pushFilters([EqualTo(("record_id",), "<urn:page:7>")])) == []
    read = []
    monkeypatch.setattr(warc._Buffered, "read", lambda self, n, f=warc._Buffered.read: read.append(n) or f(self, n))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == 1 and len(read) == 1


def test_no_pages(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
