"""Benchmark decontamination by one Aho-Corasick automaton (dealt operator 4).

The windows of all benchmark items are the automaton's patterns, each between blanks; a text is
normalised to words between blanks and scanned once, and hits are mapped to words and to positions
in the original text.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import guarded, settled, typed

WINDOW = 10
#: Words of benchmark text in one automaton: some 60 nodes of 60 bytes a word, a few hundred MB at most.
AUTOMATON_WORDS = 40_000
#: A word in the original text, where A-Z are still there.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: A-Z to a-z, other ASCII but digits and a-z to blank; bytes of other characters stay.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)
FOUND = "array<struct<first:bigint,after:bigint,start:bigint,end:bigint>>"
HIT_ARROW = pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "after", "start", "end")]))
_built: dict = {}


def words(text: str | None) -> list[str]:
    return (text or "").encode().translate(NORMAL).decode().split(" ") if text else []


def _spread(text: str | None) -> str:
    """The words of a text, each between single blanks."""
    return f" {' '.join(x for x in words(text) if x)} "


def windows(text: str | None, size: int = WINDOW) -> list[str]:
    got = [x for x in words(text) if x]
    if not got:
        return []
    return [f" {' '.join(got[i:i + size])} " for i in range(max(1, len(got) - size + 1))]


def _automaton(key: str, items: list[tuple], size: int):
    if key not in _built:
        owners: dict[str, list] = {}
        for item, text in items:
            for w in windows(text, size):
                if (own := owners.setdefault(w, [])) is not None and item not in own:
                    own.append(item)
        made = ahocorasick.Automaton()
        for w, own in owners.items():
            made.add_word(w, (w.count(" ") - 1, tuple(own)))
        if owners:
            made.make_automaton()
        _built.clear()
        _built[key] = made if owners else None
    return _built[key]


def _scan(text: str | None, made) -> tuple[int, list[tuple[int, int]], set]:
    """(number of words, hit word ranges in order and apart, items found)."""
    line = _spread(text)
    n = line.count(" ") - 1 if len(line) > 2 else 0
    if made is None or not n:
        return n, [], set()
    hits: list[tuple[int, int]] = []
    items: set = set()
    seen_to, seen_words = 0, 0
    for end, (long, own) in made.iter(line):
        # the blank that ends the hit is the one after word number `after`
        seen_words += line.count(" ", seen_to, end)
        seen_to = end
        first, after = seen_words - long, seen_words
        items.update(own)
        hits.append((first, after))
    return n, _joined(hits), items


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _positions(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """Word ranges with the code points they cover in the original text."""
    spans = [m.span() for m in WORD.finditer(text)]
    return [{"first": a, "after": b, "start": spans[a][0], "end": spans[b - 1][1]} for a, b in ranges]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW,
                   most_words: int = AUTOMATON_WORDS, without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` and what they share with the benchmark: ``_n_words``, ``_n_hit``, ``_items`` (strings, sorted), ``_found``.

    ``_found`` holds the hit ranges, in words and in code points of the text. The benchmark (item_id, text) must be small
    beside the documents, but isn't taken to be: its words are counted first, and items are dealt to as many automata of at
    most ``most_words`` words as it takes (one item may exceed that), which scan the texts one after the other. Null and
    empty texts have no words. Items that repeat count once by their id; items without words occur nowhere; an item without
    id is named ``null``. Columns named in ``without`` are left out of the result. Documents may repeat, have any further columns and any ids.
    """
    spark = docs.sparkSession
    items = typed(benchmark, item_id="string", text="string").filter("text is not null")
    items = items.withColumn("w", F.length("text") / 2 + 1)
    total = items.agg(F.sum("w")).first()[0] or 0
    blocks = int(total // (4 * most_words)) + 1
    keep = [c for c in docs.columns if c not in without]
    kind = T._parse_datatype_string(FOUND)
    rows = docs
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        # bounded by the count above: one block of the benchmark
        own = sorted((r.item_id or "null", r.text) for r in part.select("item_id", "text").distinct().collect())
        key = hashlib.sha256(repr((size, own)).encode()).hexdigest()
        shared = spark.sparkContext.broadcast((key, own, size))
        last = block == blocks - 1
        carried = [c for c in rows.columns if not last or c not in without and c not in ("_n_words", "_hits", "_items")]

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, last=last, carried=carried) -> Iterator[pa.RecordBatch]:
            made = _automaton(*shared.value)
            for batch in batches:
                at = {name: i for i, name in enumerate(batch.schema.names)}
                before = batch.column(at["_hits"]).to_pylist() if "_hits" in at else [""] * batch.num_rows
                known = batch.column(at["_items"]).to_pylist() if "_items" in at else [[]] * batch.num_rows
                n_words, hits, found, n_hit, items = [], [], [], [], []
                for t, old, names in zip(batch.column(at[text]), before, known):
                    t = t.as_py()
                    n, ranges, got = _scan(t, made)
                    n_words.append(n)
                    items.append(sorted({*names, *got}) if got else names)
                    if old:
                        ranges = _joined(ranges + [tuple(map(int, x.split(":"))) for x in old.split(" ")])
                    if last:
                        found.append(_positions(t, ranges) if ranges else [])
                        n_hit.append(sum(b - a for a, b in ranges))
                    else:
                        hits.append(" ".join(f"{a}:{b}" for a, b in ranges))
                own_columns = [batch.column(at[c]) for c in carried if c not in ("_n_words", "_hits", "_items")]
                names = [c for c in carried if c not in ("_n_words", "_hits", "_items")]
                made_columns = [pa.array(n_words, pa.int64()), pa.array(items, pa.list_(pa.string()))]
                if last:
                    made_columns += [pa.array(n_hit, pa.int64()), pa.array(found, HIT_ARROW)]
                else:
                    made_columns += [pa.array(hits, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [*own_columns, *made_columns], names=[*names, "_n_words", "_items", *(["_n_hit", "_found"] if last else ["_hits"])])

        fields = [docs.schema[c] for c in (keep if last else docs.columns)]
        fields += [T.StructField("_n_words", T.LongType()), T.StructField("_items", T.ArrayType(T.StringType()))]
        fields += [T.StructField("_n_hit", T.LongType()), T.StructField("_found", kind)] if last else [T.StructField("_hits", T.StringType())]
        rows = rows.mapInArrow(scan, T.StructType(fields))
        if not last:
            rows = settled(rows)
    return rows


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with their own columns."""
    inner, back = guarded(docs, "text")
    return benchmark_hits(inner, benchmark).filter("_n_hit = 0").select(*back)


def hit_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: counts, the items' digest and whether it is contaminated."""
    got = benchmark_hits(typed(docs, doc_id="long", text="string"), benchmark, without=("text",))
    return got.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"),
    )
