"""Divergence of sources within a language by a frequent-pattern tree of term rows (dealt operator 12).

A term's row lists the sources of one language that use the term, in the order of their names, with their counts; sources that
don't use it are left out. Rows go into a prefix tree with multiplicities. The distance of two sources over all terms is what it
would be if neither used any term, plus a correction for each use of a term by one of them alone, plus a correction wherever both
use it. The last part is read off the tree: rows that share a path share its nodes, so each node meets each of its ancestors once,
whatever the number of terms below it.

All figures are integers; sums over terms are exact in any order, so trees may be cut between tasks anywhere.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, typed

#: Documents of a language that a term must stand in.
LEAST_DOCS = 30
#: Probabilities are counted in parts of this.
UNIT = 1_000_000_000
#: Added to each count.
PRIOR = 5
#: Telling terms listed per group.
TOP = 50
#: A-Z to a-z, other ASCII but letters to blank; bytes of other characters stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Terms held in a task before they are handed on, and bytes of text split at once.
HELD, PIECE = 200_000, 1 << 22
#: Pairs of sources held in a task before their sums are handed on.
CELLS = 1 << 22


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, a piece of it at a time."""
    data = (text or "").encode().translate(NORMAL)
    at = 0
    while at < len(data):
        after = data.find(b" ", at + PIECE)
        after = len(data) if after < 0 else after
        yield data[at:after].split()
        at = after


COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, summed over as many rows as fit."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed_on() -> pa.RecordBatch:
        out = [(*group, term.decode(), n, docs[term]) for group, (uses, docs) in seen.items() for term, n in uses.items()]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, COUNTS)], schema=COUNTS)

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2)):
            uses, docs = seen.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for part in terms(text.as_py()):
                uses.update(part)
                own.update(part)
            docs.update(own)
            if len(uses) > HELD or len(seen) > 1 and sum(len(x) for x, _ in seen.values()) > HELD:
                yield handed_on()
    yield handed_on()


def term_rows(docs: DataFrame) -> DataFrame:
    """(lang, term, uses): each kept term with the groups of its language that use it; one shuffle."""
    raw = docs.select("lang", "source", "text").mapInArrow(_counts, "lang string, source string, term string, n bigint, docs bigint")
    by_source = raw.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("uses"))
    return rows.filter(F.col("docs") >= LEAST_DOCS).select("lang", "term", "uses")


def share(count, total, kept):
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * kept)), in decimals as counts may be large."""
    part = F.lit(UNIT).cast("decimal(11,0)") * (count + PRIOR).cast("decimal(19,0)")
    return F.call_function("div", part, (total + PRIOR * kept).cast("decimal(19,0)")) + 1


SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("value", pa.int64())])


class Tree:
    """The tree of one language's rows. They come in order, so only the path to the last row is held: a branch that no further
    row can enter is folded into the sums at once, each node with all of its ancestors."""

    def __init__(self, lang: str) -> None:
        self.lang, self.names, self.index, self.sums, self.cells = lang, [], {}, {}, 0
        self.path: list[tuple] = []
        self.many: list[int] = []
        self.source, self.p, self.none = (np.zeros(16, np.int64) for _ in range(3))

    def insert(self, row: list[tuple], many: int) -> None:
        """``row``: (source, count, p, p of no use) in the order of sources."""
        shared = 0
        while shared < min(len(row), len(self.path)) and self.path[shared] == row[shared]:
            shared += 1
        self.fold(shared)
        for item in row[shared:]:
            k = len(self.path)
            if k == len(self.p):
                self.source, self.p, self.none = (np.concatenate([x, np.zeros_like(x)]) for x in (self.source, self.p, self.none))
            name, _, self.p[k], self.none[k] = item
            if name not in self.index:
                self.index[name] = len(self.names)
                self.names.append(name)
            self.source[k] = self.index[name]
            self.path.append(item)
            self.many.append(0)
        if row:
            self.many[-1] += many

    def fold(self, depth: int) -> None:
        """Leave the path's nodes from ``depth`` on."""
        while len(self.path) > depth:
            k, many = len(self.path) - 1, self.many.pop()
            self.path.pop()
            if not k:
                return
            self.many[-1] += many
            p, none, above, above_none = self.p[k], self.none[k], self.p[:k], self.none[:k]
            value = np.abs(p - above) - np.abs(p - above_none) - np.abs(none - above) + np.abs(none - above_none)
            own = int(self.source[k])
            held = self.sums.get(own)
            if held is None or len(held) < len(self.names):
                grown = np.zeros(2 * len(self.names), np.int64)
                if held is not None:
                    grown[:len(held)] = held
                self.cells += len(grown) - (0 if held is None else len(held))
                held = self.sums[own] = grown
            held[self.source[:k]] += many * value

    def handed_on(self) -> pa.RecordBatch:
        out = [(self.lang, self.names[own], self.names[k], int(held[k])) for own, held in self.sums.items() for k in np.flatnonzero(held)]
        self.sums, self.cells = {}, 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, SUMS)], schema=SUMS)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of pairs of sources that share terms, from rows sorted by language and path."""
    tree: Tree | None = None
    for batch in batches:
        for lang, path, many in zip(*(c.to_pylist() for c in batch.columns)):
            if tree is None or tree.lang != lang:
                if tree is not None:
                    tree.fold(0)
                    yield tree.handed_on()
                tree = Tree(lang)
            tree.insert([(x["source"], x["n"], x["p"], x["none"]) for x in path], many)
            if tree.cells > CELLS:
                yield tree.handed_on()
    if tree is not None:
        tree.fold(0)
        yield tree.handed_on()


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) for every occurring group of ``docs``.

    ``pair``: the distance to each other source of the language, all ranks. ``term``: the TOP terms that the group uses more than
    its language does. Null text, lang and source count as empty strings, so they form groups of their own; each row counts as a
    document, repeated rows too. Texts are read whole, a piece at a time. Groups without terms and languages without kept terms
    have pairs (value 0 in the latter) but no terms. Equal values rank by item. No rows give no rows; further columns are not read.
    """
    docs = typed(docs, lang="string", source="string", text="string").fillna("")
    rows = settled(term_rows(docs))
    uses = rows.select("lang", "term", F.explode("uses").alias("u")).select("lang", "term", "u.source", "u.n")
    kept = rows.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = uses.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(kept, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.fillna(0, ["kept", "total"]).withColumn("none", F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(0))
    groups = settled(groups)
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.max("kept").alias("kept"))

    size = F.aggregate("uses", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    of_lang = rows.withColumn("lang_n", size).join(langs, "lang").withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("kept")))
    items = of_lang.select("lang", "term", "q", F.explode("uses").alias("u")).select("lang", "term", "q", "u.source", "u.n")
    items = items.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    items = settled(items.select("lang", "source", "term", "n", "p", "none", "q"))

    paths = items.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n", "p", "none"))).alias("path"))
    paths = settled(paths.groupBy("lang", "path").agg(F.count("*").alias("many")))
    both = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path").mapInArrow(
        _trees, "lang string, source string, other string, value bigint")

    other = groups.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none"))
    alone = items.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("many")).join(other, "lang").filter("source <> other")
    alone = alone.groupBy("lang", "source", "other").agg(
        F.sum(F.expr("many * (abs(p - other_none) - abs(none - other_none))")).alias("value"))
    found = settled(both.unionByName(alone).groupBy("lang", "source", "other").agg(F.sum("value").alias("value")))
    found = found.unionByName(found.selectExpr("lang", "other as source", "source as other", "value"))
    base = groups.join(other, "lang").filter("source <> other").selectExpr("lang", "source", "other", "kept * abs(none - other_none) as value")
    pairs = base.unionByName(found).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    ranked = ranked.withColumn("rank", F.row_number().over(by_value))
    telling = items.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("p - q").alias("value"))
    telling = telling.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= TOP)
    return ranked.unionByName(telling)
