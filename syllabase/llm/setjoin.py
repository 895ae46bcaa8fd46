"""Exact set-similarity join on word shingles by set-relation skipping (dealt operator 6).

Sets link when 100 * intersection >= share * union. The smallest shingles of a set in one order of all shingles are its
prefix; linked sets share a prefix shingle. Shingles are ordered by hash, those that very many sets hold last. Index lists
are skipped as a whole where all their sets already hang together, and block by block by size and position in the rest. A
set that resembles another takes over its answers: the overlap with a third set follows from the known one and the
few shingles in which the two differ.

The index holds hashes of 64 bits: sets are told apart by an id of 64 bits, shingles by theirs.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import guarded, in_order, settled, typed
from .textbytes import SPACED, column_bytes, runs, slices, tokens

WORDS_IN_SHINGLE = 3
SHARE = 90
#: Sets that hold a shingle from which it counts as frequent; and how many frequent ones are set back in the order.
#: Both steer the work alone: any order gives the same links.
FREQUENT = 150
SET_BACK = 1 << 17
#: Entries of an index list or of a partner list that meet in one block.
BLOCK = 512
BITS = 512
#: Buckets of the largest sets' bitmaps in the index.
MOST_BITS = 4096


def shingle_sets(column: pa.Array, size: int = WORDS_IN_SHINGLE) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    data, off = column_bytes(column)
    for first, last, part, own in slices(data, off):
        _, _, hashes, bounds = tokens(part, own, SPACED)
        made, made_bounds = runs(hashes, bounds, size)
        for d in range(last - first):
            n = bounds[d + 1] - bounds[d]
            if n >= size:
                yield np.unique(made[made_bounds[d]:made_bounds[d + 1]])
            elif n:
                yield runs(hashes[bounds[d]:bounds[d + 1]], np.array([0, n]), int(n))[0] ^ np.uint64(n)
            else:
                yield np.zeros(0, np.uint64)


def set_id(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_size(n: int, share: int) -> int:
    return n - -(-share * n // 100) + 1


def bitmap(values: np.ndarray, most: int = BITS) -> np.ndarray:
    """Parity of the shingles in each bucket: two sets differ in at least as many shingles as their bitmaps in bits.

    A large set has more buckets, ``most`` at most; its bitmap folds to that of fewer buckets, half upon half.
    """
    size = BITS
    while size < most and size < len(values):
        size *= 2
    odd = np.bincount((values >> np.uint64(20)) & np.uint64(size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Bitmaps:
    """Bitmaps of several sizes, each folded to all smaller ones."""

    def __init__(self, column: pa.Array):
        flat, off = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy()
        off = off - off[0]
        self.level = np.log2(np.diff(off) * 64 // BITS).astype(np.int64)
        self.place = [np.full(len(self.level), -1) for _ in range(self.level.max(initial=0) + 1)]
        self.folded: list[np.ndarray] = []
        for level in range(len(self.place) - 1, -1, -1):
            own = np.flatnonzero(self.level == level)
            width = BITS // 64 << level
            rows = flat[off[own][:, None] + np.arange(width)] if len(own) else np.zeros((0, width), np.uint64)
            above = np.flatnonzero(self.level > level)
            if len(above):
                big = self.folded[-1][self.place[level + 1][above]]
                rows = np.concatenate([rows, big[:, :width] ^ big[:, width:]])
            self.place[level][np.concatenate([own, above])] = np.arange(len(rows))
            self.folded.append(rows)
        self.folded.reverse()

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        low = np.minimum(self.level[i], self.level[j])
        for level in range(len(self.place)):
            k = np.flatnonzero(low == level)
            if len(k):
                rows, at = self.folded[level], self.place[level]
                out[k] = np.bitwise_count(rows[at[i[k]]] ^ rows[at[j[k]]]).sum(1)
        return out


def ordered(values: np.ndarray, late: np.ndarray) -> np.ndarray:
    """A set in the common order: by hash, the frequent shingles behind the others."""
    if not len(late):
        return values
    back = np.isin(values, late, assume_unique=True)
    return np.concatenate([values[~back], values[back]])


def _counted(share: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out = []
            for values in shingle_sets(batch.column(0), size):
                if len(values) and (own := set_id(values)) not in seen:
                    seen.add(own)
                    out.append(values[:prefix_size(len(values), share)])
            shingles = np.concatenate(out) if out else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64))], names=["shingle"])
    return run


def _signed(share: int, size: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, sizes, prefixes, bitmaps = [], [], [], []
            for values in shingle_sets(batch.column(1), size):
                sizes.append(len(values))
                if not len(values):
                    ids.append(None)
                    prefixes.append(None)
                    bitmaps.append(None)
                    continue
                own = set_id(values)
                ids.append(own)
                new = own not in seen
                seen.add(own)
                prefixes.append(ordered(values, shared.value)[:prefix_size(len(values), share)].view(np.int64) if new else None)
                bitmaps.append(bitmap(values, MOST_BITS) if new else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(prefixes, pa.list_(pa.int64())), pa.array(bitmaps, pa.list_(pa.int64()))],
                names=["doc_id", "row_key", "set_id", "n", "prefix", "bits"])
    return run


def least_overlap(a, b, share: int):
    """Smallest intersection with which sets of these sizes link."""
    return -(-share * (a + b) // (100 + share))


def _block_pairs(share: int):
    """Pairs of an index block that may link and don't hang together yet, by sizes, positions and bitmaps: a forest of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_order(batches, ["shingle", "cell"]):
            t = t.combine_chunks()
            key, cell, own, root, n, at = (t.column(c).to_numpy() for c in ("shingle", "cell", "set_id", "root", "n", "at"))
            column = t.column("bits").combine_chunks()
            bits = Bitmaps(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
            ends = np.append(starts[1:], len(key))
            found: list[np.ndarray] = []
            for a, b in zip(starts, ends):
                if b - a < 2 or (root[a:b] == root[a]).all():
                    continue
                own_pairs: list[np.ndarray] = []
                for lo in range(a, b, BLOCK):
                    rows = np.arange(lo, min(lo + BLOCK, b))
                    for lo2 in range(lo, b, BLOCK):
                        cols = np.arange(lo2, min(lo2 + BLOCK, b))
                        need = least_overlap(n[rows][:, None], n[cols][None, :], share)
                        left = np.minimum((n[rows] - at[rows])[:, None], (n[cols] - at[cols])[None, :])
                        ok = (left >= need) & (root[rows][:, None] != root[cols][None, :])
                        i, j = np.nonzero(ok)
                        i, j = rows[i], cols[j]
                        keep = (bits.apart(i, j) <= n[i] + n[j] - 2 * least_overlap(n[i], n[j], share)) & (i < j)
                        i, j = i[keep], j[keep]
                        if len(i):
                            own_pairs.append(_forest(own[i], own[j]))
                if own_pairs:
                    every = np.concatenate(own_pairs)
                    found.append(_forest(every[:, 0], every[:, 1]))
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])
    return run


class Groups:
    """Union of sets that hang together within a task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As many of the pairs as hold their sets together."""
    groups = Groups()
    keep = [groups.join(x, y) for x, y in zip(a.tolist(), b.tolist())]
    return np.stack([a[keep], b[keep]], 1)


def _overlaps(sets: list[np.ndarray], root: np.ndarray):
    """overlap(i, j). The first set of each root is worked out against i; another one's answer follows from that and the shingles
    in which it differs from the first."""
    base: dict[int, int] = {}
    for k, r in enumerate(root.tolist()):
        base.setdefault(r, k)
    differs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    known: dict[tuple[int, int], int] = {}

    def held(values: np.ndarray, own: np.ndarray) -> int:
        at = np.minimum(np.searchsorted(own, values), len(own) - 1)
        return int((own[at] == values).sum())

    def overlap(i: int, j: int) -> int:
        b = base[int(root[j])]
        if (i, b) not in known:
            known[i, b] = held(sets[b], sets[i])
        if j == b:
            return known[i, b]
        if j not in differs:
            differs[j] = (np.setdiff1d(sets[j], sets[b], assume_unique=True), np.setdiff1d(sets[b], sets[j], assume_unique=True))
        more, less = differs[j]
        return known[i, b] + held(more, sets[i]) - held(less, sets[i])

    return overlap


def _cell_links(share: int, size: int):
    """Links between the sets of a cell that don't hang together yet, as many as hold them together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_order(batches, ["grp", "one", "two"]):
            grp, one, two, mine, own, root = (t.column(c).to_numpy() for c in ("grp", "one", "two", "mine", "set_id", "root"))
            new = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
            us, vs = [], []
            for lo, hi in zip(new, np.append(new[1:], len(grp))):
                sets = list(shingle_sets(t.column("text").slice(lo, hi - lo).combine_chunks(), size))
                ids, roots, side = own[lo:hi], root[lo:hi], mine[lo:hi]
                bits = np.stack([bitmap(x) for x in sets]).view(np.uint64)
                n = np.array([len(x) for x in sets])
                groups, overlap = Groups(), _overlaps(sets, roots)
                for i in range(len(ids)):
                    other = np.flatnonzero((roots != roots[i]) & ((side != side[i]) | (one[lo] == two[lo])))
                    other = other[other > i]
                    need = least_overlap(n[i], n[other], share)
                    apart = np.bitwise_count(bits[other] ^ bits[i]).sum(1).astype(np.int64)
                    for j in other[(np.minimum(n[i], n[other]) >= need) & (apart <= n[i] + n[other] - 2 * need)].tolist():
                        if groups.top(int(roots[i])) == groups.top(int(roots[j])):
                            continue
                        both = overlap(i, j)
                        if 100 * both >= share * (n[i] + n[j] - both):
                            groups.join(int(roots[i]), int(roots[j]))
                            us.append(ids[i])
                            vs.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
    return run


def _grouped_links(candidates: DataFrame, roots: DataFrame, texts: DataFrame, share: int, size: int) -> DataFrame:
    """All links that the candidates' groups still lack. A group's sets are dealt over blocks, those of a large root over blocks of
    its own; blocks meet in cells, but for two blocks of one root."""
    groups = components(candidates).select(F.col("node").alias("set_id"), F.col("root").alias("grp"))
    members = settled(groups.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")))
    by_root = members.groupBy("grp", "root").agg(F.count("*").alias("n"))
    small = by_root.filter(F.col("n") < BLOCK // 2).groupBy("grp").agg(F.sum("n").alias("mixed"))
    plan = settled(by_root.join(small, "grp", "left"))
    large = F.col("n") >= BLOCK // 2
    cuts = F.ceil(F.when(large, F.col("n")).otherwise(F.col("mixed")) / (BLOCK // 2)).cast("int")
    owner = F.when(large, F.col("root"))  # null: a block of several roots
    rows = members.join(plan.withColumn("cuts", cuts).withColumn("owner", owner), ["grp", "root"])
    rows = settled(rows.withColumn("block", F.xxhash64("owner", F.pmod(F.xxhash64("set_id"), F.col("cuts")))).select(
        "grp", "set_id", "root", "owner", "block"))
    blocks = settled(rows.select("grp", "owner", "block").distinct())
    other = blocks.select("grp", F.col("owner").alias("owner2"), F.col("block").alias("block2"))
    cells = blocks.join(other, "grp").filter((F.col("owner").isNull() | F.col("owner2").isNull() | (F.col("owner") != F.col("owner2"))))
    cells = cells.select("grp", F.col("block").alias("mine"), F.least("block", "block2").alias("one"), F.greatest("block", "block2").alias("two"))
    dealt = rows.select("grp", "set_id", "root", F.col("block").alias("mine")).join(cells, ["grp", "mine"]).join(texts, "set_id")
    dealt = dealt.select("grp", "one", "two", "mine", "set_id", "root", "text").repartition("grp", "one", "two")
    return dealt.sortWithinPartitions("grp", "one", "two", "root", "set_id").mapInArrow(_cell_links(share, size), "u bigint, v bigint")


def _links(share: int, size: int):
    """Links between a cell's left set and its right ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_order(batches, ["a", "part"]):
            a, part, own = (t.column(c).to_numpy() for c in ("a", "part", "set_id"))
            sets = list(shingle_sets(t.column("text"), size))
            starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (part[1:] != part[:-1])]))
            us, vs = [], []
            for lo, hi in zip(starts, np.append(starts[1:], len(a))):
                head = next((sets[k] for k in range(lo, hi) if own[k] == a[lo]), None)
                if head is None:
                    continue
                for k in range(lo, hi):
                    if own[k] != a[lo]:
                        at = np.minimum(np.searchsorted(head, sets[k]), len(head) - 1)
                        both = int((head[at] == sets[k]).sum())
                        if 100 * both >= share * (len(sets[k]) + len(head) - both):
                            us.append(own[k])
                            vs.append(a[lo])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
    return run


def _verified(pairs: DataFrame, texts: DataFrame, share: int, size: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that link. Partners of a set that has very many are dealt over several cells."""
    counts = settled(pairs.groupBy("a").agg(F.count("*").alias("m")))
    parts = F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK)).cast("int")
    right = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"), F.col("b").alias("set_id"))
    heads = counts.select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("a").alias("set_id"))
    cells = right.unionByName(heads).join(texts, "set_id").select("a", "part", "set_id", "text")
    cells = cells.repartition("a", "part").sortWithinPartitions("a", "part")
    return cells.mapInArrow(_links(share, size), "u bigint, v bigint")


def grouped(docs: DataFrame, share: int = SHARE, size: int = WORDS_IN_SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(a row per row of ``docs``: doc_id, row_key, set_id, n; a row per set: set_id, root), sets of one root hanging together.

    Texts that are null or have no word have an empty set, whose set_id is null, and are linked with nothing. ``row_key`` is
    the hash of doc_id and text.
    """
    spark = docs.sparkSession
    rows = typed(docs, doc_id="long", text="string")
    counted = rows.select("text").mapInArrow(_counted(share, size), "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n"))
    late = counted.filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "shingle").limit(SET_BACK).collect()  # SET_BACK numbers at most
    shared = spark.sparkContext.broadcast(np.sort(np.array([r["shingle"] for r in late], np.int64).view(np.uint64)))
    signed = settled(rows.withColumn("row_key", F.xxhash64("doc_id", "text")).mapInArrow(
        _signed(share, size, shared), "doc_id bigint, row_key bigint, set_id bigint, n bigint, prefix array<bigint>, bits array<bigint>"))
    sets = settled(signed.filter("set_id is not null").groupBy("set_id").agg(
        F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("bits", ignorenulls=True).alias("bits"),
        F.first("prefix", ignorenulls=True).alias("prefix")))
    index = sets.select("set_id", "n", F.posexplode("prefix").alias("at", "shingle"))
    lists = settled(index.groupBy("shingle").agg(F.min("set_id").alias("pivot"), F.max("set_id").alias("top"), F.count("*").alias("m"))
                    .filter("pivot <> top").select("shingle", "pivot", "m"))
    index = settled(index.join(lists, "shingle"))
    pool = settled(_texts(rows, sets.join(index.select("set_id").distinct(), "set_id"), size))

    # Each set first meets the pivot that it shares most lists with.
    best = index.filter("set_id <> pivot").groupBy("set_id", "pivot").agg(F.count("*").alias("c"))
    best = best.groupBy("set_id").agg(F.max(F.struct("c", "pivot"))["pivot"].alias("pivot"))
    narrow = sets.select("set_id", "n", "bits")
    star = (best.join(narrow, "set_id").join(narrow.select(F.col("set_id").alias("pivot"), F.col("n").alias("n2"), F.col("bits").alias("bits2")), "pivot")
            .filter(_may_link(share)).select(F.col("pivot").alias("a"), F.col("set_id").alias("b")))
    first = settled(_verified(star, pool, share, size))
    roots = settled(components(first).select(F.col("node").alias("set_id"), "root"))

    # Lists in which not all sets hang together are compared block by block; the sets that may link there meet in cells.
    named = index.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    mixed = named.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("shingle")
    blocks = _cells(settled(named.join(mixed, "shingle")), share)
    blocks = blocks.join(narrow.select("set_id", "bits"), "set_id")
    blocks = blocks.repartition("shingle", "cell").sortWithinPartitions("shingle", "cell", "n")
    pairs = settled(blocks.select("shingle", "cell", "set_id", "root", "n", "at", "bits").mapInArrow(_block_pairs(share), "u bigint, v bigint").distinct())
    second = _grouped_links(pairs, roots, pool, share, size)
    edges = roots.filter("set_id <> root").select(F.col("set_id").alias("u"), F.col("root").alias("v")).union(second)
    groups = components(edges)
    whole = sets.join(groups, sets["set_id"] == groups["node"], "left").select("set_id", F.coalesce("root", "set_id").alias("root"))
    return signed.select("doc_id", "row_key", "set_id", "n"), whole


def joined(docs: DataFrame, share: int = SHARE, size: int = WORDS_IN_SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id of linked documents).

    Rows with equal sets are linked, also rows that repeat. A null doc_id takes part but names no component.
    """
    rows, sets = grouped(docs, share, size)
    sets = settled(sets)
    least = rows.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id")).join(sets, "set_id")
    names = settled(least.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    member = settled(sets.join(names, "root").select("set_id", "component_id"))
    return rows.join(member, "set_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, share: int = SHARE, size: int = WORDS_IN_SHINGLE) -> DataFrame:
    """One document of each group of linked ones: the one of smallest doc_id (null last). Documents without words all stay."""
    rows, sets = grouped(docs, share, size)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    by_set = rows.filter("set_id is not null").groupBy("set_id").agg(F.min(order).alias("first"))
    chosen = by_set.join(sets, "set_id").groupBy("root").agg(F.min("first")["row_key"].alias("_key")).select("_key", F.lit(False).alias("_blank"))
    blank = rows.filter("set_id is null").select(F.col("row_key").alias("_key"), F.lit(True).alias("_blank")).distinct()
    keep = settled(chosen.union(blank).groupBy("_key").agg(F.max("_blank").alias("_blank")))
    inner, back = guarded(docs, "doc_id", "text")
    own = inner.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))).join(keep, "_key")
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_blank"))
    return own.withColumn("_nth", nth).filter("_nth = 1 or _blank").select(*back)


def _may_link(share: int):
    need = F.ceil(F.lit(share) * (F.col("n") + F.col("n2")) / (100 + share))
    apart = F.aggregate(F.zip_with("bits", "bits2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = (F.size("bits") != F.size("bits2")) | (apart <= F.col("n") + F.col("n2") - 2 * need)
    return (F.least("n", "n2") >= need) & near


def _texts(rows: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """(set_id, text): the text of each set's row. Of texts that share a row key by chance only the one with the set's id stays.

    Rows that repeat give one text each task; a set that comes twice into a cell changes no link.
    """
    keyed = rows.select(F.xxhash64("doc_id", "text").alias("row_key"), "text")
    found = keyed.join(sets.select("set_id", "row_key"), "row_key").select("set_id", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            right = []
            for k, values in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size)):
                right.append(k not in seen and len(values) > 0 and set_id(values) == k)
                if right[-1]:
                    seen.add(k)
            yield batch.filter(pa.array(right, pa.bool_()))

    return found.mapInArrow(check, "set_id bigint, text string")


def _cells(index: DataFrame, share: int) -> DataFrame:
    """Blocks of the index lists. A list of up to BLOCK entries is one; a longer one is cut by size class and, within that,
    by hash, and only blocks whose sizes can link meet."""
    # a little under one level per share, so that rounding never puts two sets that may link two levels apart
    level = F.floor(0.999 * F.log("n") / F.log(F.lit(100 / share))).cast("int")
    short = index.filter(F.col("m") <= BLOCK).withColumn("cell", F.lit(0).cast("long"))
    cuts = F.ceil(F.col("m") / BLOCK).cast("int")
    long = index.filter(F.col("m") > BLOCK).withColumn("level", level).withColumn("cut", F.pmod(F.xxhash64("set_id"), cuts).cast("int"))
    other = F.explode(F.sequence(F.lit(0), cuts - 1))
    long = long.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("cut2", other)
    mine, theirs = F.struct("level", "cut"), F.struct((F.col("level") + F.col("step")).alias("level"), F.col("cut2").alias("cut"))
    long = long.withColumn("cell", F.xxhash64(F.least(mine, theirs), F.greatest(mine, theirs)))
    return short.unionByName(long.select(*short.columns))
