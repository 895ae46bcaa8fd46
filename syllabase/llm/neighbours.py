"""Near-duplicate vectors by NN-descent (dealt operator 1).

Equal vectors are one node with a weight. Blocks of random projections give each node its first neighbours; then neighbours
of neighbours are compared, round after round, and each node keeps the nearest. A list that is full of near
duplicates is saturated and may grow to twice its length. Every link that any comparison sees is kept as a link, whatever
the lists hold, and the saturated nodes of different groups of a label are compared with one another, save for blocks
whose centres and radii rule out a link. An audit compares samples of nodes with all nodes of their label, until it has seen AUDIT nodes
with links or all nodes: links between groups that descent has kept apart are added, and while it finds too many, another round
of projections and descent follows, with an audit of twice as many. At the end the nodes of each group are compared with one another in blocks, which
gives the exact links.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import discard, in_order, settled, typed

NEAR = 0.93
#: Neighbours in a list at first, and after it has been enlarged as often as it may.
LIST, LONGEST = 8, 32
#: Least number of projections, nodes of a block in which all meet, and the chance that two nodes at NEAR share a bucket at least once.
TABLES, BLOCK, SEEDED = 6, 256, 0.95
#: Nodes with links that an audit must see, nodes that it compares at once at most, and the share of their links that descent must have found.
AUDIT, AT_ONCE, RECALL = 256, 2048, 0.999
ROUNDS = 4
EDGES = "v bigint, w bigint, sim double, link boolean"


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows as unit vectors in double precision; rows of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their node, nodes). A vector counts with its label if neither is null and all components are finite, not all 0."""
    rows = typed(vectors, vec_id="long", embedding="array<float>", label="long")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine & F.col("label").isNotNull() & (F.size("embedding") > 0), F.lit(False)))
    rows = rows.withColumn("node", F.when(F.col("fine"), F.xxhash64("label", "embedding")))
    made = rows.filter("fine").groupBy("node").agg(
        F.first("label").alias("label"), F.first("embedding").alias("x"), F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
    return rows.select("vec_id", "node"), made.withColumn("dims", F.size("x"))


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return list(zip(starts, np.append(starts[1:], len(new))))


def tables(bits: int) -> int:
    """Projections by which two nodes at NEAR share a bucket of so many signs at least once, with a chance of SEEDED."""
    one = (1 - math.acos(NEAR) / math.pi) ** bits
    return TABLES if one == 1 else max(TABLES, math.ceil(math.log(1 - SEEDED) / math.log(1 - one)))


def _forest(ids: np.ndarray, sims: np.ndarray):
    """(v, w, sim) of links that hold together what hangs together in a block: one less than nodes, from the lowest id on."""
    near = sims >= NEAR
    out = [np.zeros((2, 0), np.int64)]
    seen = ~near.any(1)
    for start in np.argsort(ids):
        if seen[start]:
            continue
        front = np.array([start])
        seen[start] = True
        while len(front):
            reach = near[front] & ~seen
            new = np.flatnonzero(reach.any(0))
            out.append(np.stack([front[reach[:, new].argmax(0)], new]))
            seen[new] = True
            front = new
    v, w = np.concatenate(out, axis=1)
    return ids[v], ids[w], sims[v, w]


def _nearest(ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None):
    """(v, w, sim, link): the k nearest others of each row, of those nearer than ``floor``, and a forest of all links."""
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    k = min(k, len(ids) - 1)
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < len(ids) - 1 else np.argsort(-sims, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(ids)), at.shape[1])
    cols = at.ravel()
    got = sims[rows, cols]
    keep = (got > -2) & (ids[rows] != ids[cols])
    if floor is not None:
        keep &= got > floor[rows]
    linked = _forest(ids, sims)
    both = [np.concatenate(c) for c in zip((ids[rows[keep]], ids[cols[keep]], got[keep]), linked)]
    return *both, np.arange(len(both[0])) >= keep.sum()


def _batch(parts: list) -> pa.RecordBatch:
    kinds = (np.int64, np.int64, np.float64, bool)
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["v", "w", "sim", "link"])


def _projected(every: DataFrame, seed: int) -> DataFrame:
    """Nearest nodes within blocks of equal signs of random projections; a large bucket is cut into blocks by hash."""
    size = every.groupBy("label", "dims").agg(F.count("*").alias("n"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / (BLOCK / 2)))).cast("int")
    size = size.withColumn("bits", F.least(bits, F.lit(48)))
    size = size.withColumn("tables", F.element_at(F.array(*[F.lit(tables(k)) for k in range(49)]), F.col("bits") + 1))
    plain = every.join(settled(size), ["label", "dims"])

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "label", "dims", "x"]
        for batch in batches:
            t = pa.Table.from_batches([batch]).sort_by("dims").combine_chunks()
            if not t.num_rows:
                continue
            dims = t.column("dims").to_numpy()
            for a, b in _runs(dims):
                own = t.slice(a, b - a)
                x, bits, times = _vectors(own.column("x")), own.column("bits").to_numpy(), own.column("tables").to_numpy()
                for table in range(times.max()):
                    planes = np.random.default_rng((seed, table, int(dims[a]))).standard_normal((x.shape[1], 48))
                    on = (x @ planes > 0) & (np.arange(48)[None] < bits[:, None])
                    key = (on.astype(np.int64) << np.arange(48)[None]).sum(1)
                    part = pa.table({**{c: own.column(c) for c in names}, "at": np.full(b - a, table, np.int32), "bucket": key})
                    yield from part.filter(pa.array(times > table)).combine_chunks().to_batches()

    kinds = dict(every.dtypes)
    keyed = plain.select("node", "label", "dims", "x", "bits", "tables").mapInArrow(
        signs, f"node bigint, label bigint, dims int, x {kinds['x']}, at int, bucket bigint")
    keyed = settled(keyed)
    bucket = ["label", "dims", "at", "bucket"]
    counts = settled(keyed.groupBy(*bucket).agg(F.count("*").alias("m")))
    cut = F.pmod(F.xxhash64("node", "at", F.lit(seed)), F.ceil(F.col("m") / BLOCK).cast("int"))
    cells = keyed.join(counts, bucket).select(F.xxhash64(*bucket).alias("cell"), cut.cast("long").alias("cut"), "node", "x")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_order(batches, ["cell", "cut"]):
            ids = t.column("node").to_numpy()
            found = []
            for a, b in _runs(t.column("cell").to_numpy(), t.column("cut").to_numpy()):
                if b - a > 1:
                    x = _vectors(t.column("x").slice(a, b - a))
                    for lo in range(0, b - a, 2 * BLOCK):  # a cut that hashing has filled beyond measure
                        hi = min(b - a, lo + 2 * BLOCK)
                        if hi - lo > 1:
                            found.append(_nearest(ids[a + lo:a + hi], x[lo:hi], LIST // 2))
            yield _batch(found)

    return cells.repartition("cell", "cut").sortWithinPartitions("cell", "cut").mapInArrow(near, EDGES)


def _lists(edges: DataFrame, lengths: DataFrame | None) -> DataFrame:
    """The nearest of each node, as many as its list holds."""
    rows = edges.groupBy("v", "w").agg(F.max("sim").alias("sim"))
    if lengths is not None:
        rows = rows.join(lengths, "v", "left")
    else:
        rows = rows.withColumn("long", F.lit(None).cast("int"))
    order = Window.partitionBy("v").orderBy(F.desc("sim"), "w")
    rows = rows.withColumn("long", F.coalesce("long", F.lit(LIST))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= LONGEST)
    return rows.filter(F.col("rank") <= F.col("long")).select("v", "w", "sim", "long", "rank")


def _parted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges for lists, links), computed once. The links are settled, each pair once."""
    held = settled(edges)
    links = settled(held.filter("link").select(F.least("v", "w").alias("u"), F.greatest("v", "w").alias("v")).distinct())
    return held, links


def _descend(every: DataFrame, lists: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """One round: at each node its neighbours, and those that name it, meet; saturated lists may grow first. With the links seen."""
    state = lists.groupBy("v").agg(F.min("sim").alias("floor"), F.count("*").alias("n"), F.first("long").alias("long"))
    full = (F.col("n") >= F.col("long")) & (F.col("floor") >= NEAR)
    state = state.withColumn("long", F.when(full, F.least(F.col("long") * 2, F.lit(LONGEST))).otherwise(F.col("long")))
    state = settled(state.withColumn("floor", F.when(F.col("n") < F.col("long"), -2.0).otherwise(F.col("floor"))))
    turn = F.pmod(F.xxhash64("v", "w"), F.lit(1 << 20))
    # of those that name a node, a list's length of them, chosen by hash; the audit watches over what this leaves out
    back = lists.withColumn("rank", F.row_number().over(Window.partitionBy("w").orderBy(turn))).filter(F.col("rank") <= LIST)
    meet = lists.select(F.col("v").alias("at"), F.col("w").alias("v")).union(back.select(F.col("w").alias("at"), "v")).union(
        lists.select(F.col("v").alias("at"), "v")).distinct()
    meet = meet.join(every.select(F.col("node").alias("v"), "x"), "v").join(state.select("v", "floor"), "v", "left")
    meet = meet.withColumn("floor", F.coalesce("floor", F.lit(-2.0)))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_order(batches, ["at"]):
            ids, floor = t.column("v").to_numpy(), t.column("floor").to_numpy()
            found = [
                _nearest(ids[a:b], _vectors(t.column("x").slice(a, b - a)), LIST, floor[a:b])
                for a, b in _runs(t.column("at").to_numpy()) if b - a > 1
            ]
            yield _batch(found)

    new = meet.select("at", "v", "x", "floor").repartition("at").sortWithinPartitions("at").mapInArrow(local, EDGES)
    held, links = _parted(new)
    after = settled(_lists(lists.select("v", "w", "sim").union(held.filter("not link").drop("link")), state.select("v", "long")))
    changed = after.select("v", "w").join(lists.select("v", "w"), ["v", "w"], "left_anti").count()
    discard(held, lists, state)
    return after, changed, links


def _between(every: DataFrame, roots: DataFrame, lists: DataFrame) -> DataFrame:
    """(u, v): a link between each two blocks of different groups that have one. Only nodes whose lists are full of links count here,
    as another's list would hold the link; blocks are groups cut by hash."""
    full = lists.groupBy("v").agg(F.min("sim").alias("floor"), F.count("*").alias("n"), F.first("long").alias("long")).filter(
        (F.col("n") >= F.col("long")) & (F.col("floor") >= NEAR)).select(F.col("v").alias("k"))
    own = roots.join(full, "k").withColumnRenamed("k", "node")
    size = own.groupBy("root").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("cuts"))
    own = own.join(size, "root").withColumn("block", F.xxhash64("root", F.pmod(F.xxhash64("node", F.lit(3)), F.col("cuts")))).drop("cuts")
    own = settled(every.select("node", "label", "dims", "x").join(own, "node"))

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_order(batches, ["block"]):
            out = []
            for a, b in _runs(t.column("block").to_numpy()):
                x = _vectors(t.column("x").slice(a, b - a))
                mid = x.sum(0) / max(np.linalg.norm(x.sum(0)), 1e-12)
                angle = float(np.arccos(np.clip((x @ mid).min(), -1, 1)))
                out.append((*(t.column(c)[a].as_py() for c in ("block", "root", "label", "dims")), mid.tolist(), angle))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64()))],
                names=["block", "root", "label", "dims", "mid", "angle"])

    at = own.select("block", "root", "label", "dims", "x").repartition("block").sortWithinPartitions("block").mapInArrow(
        centre, "block bigint, root bigint, label bigint, dims int, mid array<double>, angle double")
    at = settled(at)
    one, two = at.alias("one"), at.alias("two")
    dot = F.aggregate(F.zip_with("one.mid", "two.mid", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    reach = F.least(F.lit(math.pi), F.col("one.angle") + F.col("two.angle") + F.lit(math.acos(NEAR) + 1e-6))
    pairs = one.join(two, (F.col("one.label") == F.col("two.label")) & (F.col("one.dims") == F.col("two.dims")) & (
        F.col("one.root") < F.col("two.root")) & (dot >= F.cos(reach) - 1e-9))
    pairs = settled(pairs.select(F.col("one.block").alias("one"), F.col("two.block").alias("two")))
    rows = pairs.withColumn("block", F.explode(F.array("one", "two"))).join(own.select("block", "node", "x"), "block")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_order(batches, ["one", "two"]):
            first, second, side, ids = (t.column(c).to_numpy() for c in ("one", "two", "block", "node"))
            found = []
            for a, b in _runs(first, second):
                x = _vectors(t.column("x").slice(a, b - a))
                p, q = np.flatnonzero(side[a:b] == first[a]), np.flatnonzero(side[a:b] == second[a])
                near = x[p] @ x[q].T
                i, j = np.unravel_index(near.argmax(), near.shape)
                if near[i, j] >= NEAR:
                    found.append((int(ids[a + p[i]]), int(ids[a + q[j]])))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    cells = rows.select("one", "two", "block", "node", "x").repartition("one", "two").sortWithinPartitions("one", "two")
    return cells.mapInArrow(meet, "u bigint, v bigint")


def _compared(named: DataFrame, asked: DataFrame) -> DataFrame:
    """The nodes of ``asked``, at most some AT_ONCE, against all of their label: (v, null, links, links within v's group) of each with a
    link, a row a batch, and (v, w) of one link to each group that isn't v's."""
    blocks: dict = {}
    for r in asked.collect():
        blocks.setdefault((r["label"], r["dims"]), []).append((r["node"], r["root"], np.array(r["x"], np.float64)))
    blocks = {k: (np.array([a for a, _, _ in v]), np.array([b for _, b, _ in v]), np.stack([c / np.linalg.norm(c) for _, _, c in v])) for k, v in blocks.items()}
    shared = named.sparkSession.sparkContext.broadcast(blocks)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            label, dims = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for (k, d), (ids, groups, q) in shared.value.items():
                own = np.flatnonzero((label == k) & (dims == d))
                if not len(own):
                    continue
                x = _vectors(batch.column(3).take(pa.array(own)))
                node, root = batch.column(0).to_numpy()[own], batch.column(4).to_numpy()[own]
                near = (q @ x.T >= NEAR) & (ids[:, None] != node)
                within = near & (groups[:, None] == root)
                for i in np.flatnonzero(near.any(1)):
                    out.append((int(ids[i]), None, int(near[i].sum()), int(within[i].sum())))
                    other = np.flatnonzero(near[i] & ~within[i])
                    out += [(int(ids[i]), int(node[other[j]]), 0, 0) for j in np.unique(root[other], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(4)], names=["v", "w", "n", "m"])

    return named.mapInArrow(compare, "v bigint, w bigint, n bigint, m bigint")


def _audit(every: DataFrame, roots: DataFrame, seed: int, wanted: int) -> tuple[DataFrame, float, bool]:
    """(links missed, recall, whether all nodes were asked): nodes by hash are compared with all, until ``wanted`` with a link were seen.

    Recall is the share of a node's links that are in its group, on average over the nodes that have any."""
    named = every.join(roots, every["node"] == roots["k"], "left").select("node", "label", "dims", "x", F.coalesce("root", "node").alias("root"))
    named = settled(named)
    rows, turn, end = named.count(), F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 40)), 1 << 40
    missed, seen, share, lo, step = None, 0, 0.0, 0, AUDIT
    while lo < end and seen < wanted:
        hi = min(end, lo + max(1, end * step // max(1, rows)))
        found = settled(_compared(named, named.filter((turn >= lo) & (turn < hi))))
        new = found.filter("w is not null").select(F.col("v").alias("u"), F.col("w").alias("v"))
        missed = new if missed is None else settled(missed.union(new))
        by_node = found.filter("w is null").groupBy("v").agg((F.sum("m") / F.sum("n")).alias("share"))
        got = by_node.agg(F.count("*").alias("n"), F.sum("share").alias("share")).first()
        seen, share = seen + got["n"], share + (got["share"] or 0.0)
        lo, step = hi, min(2 * step, AT_ONCE)
    return missed, share / seen if seen else 1.0, lo >= end


def _exact(every: DataFrame, roots: DataFrame) -> DataFrame:
    """(v, links, ) of each node in a group: the other vectors at NEAR or more, and the edges that hold the group together.

    A group is cut into blocks by hash; each pair of blocks meets in a cell, so no cell exceeds some 2 * BLOCK nodes.
    """
    size = settled(roots.groupBy("root").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("cuts")))
    rows = every.join(roots.withColumnRenamed("k", "node"), "node").join(size, "root")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("cuts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    rows = rows.select("root", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "node", "weight", "x", "label", "dims")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_order(batches, ["root", "one", "two"]):
            root, one, two, own = (t.column(c).to_numpy() for c in ("root", "one", "two", "own"))
            ids, weight = t.column("node").to_numpy(), t.column("weight").to_numpy()
            out = []
            for a, b in _runs(root, one, two):
                x, side, w = _vectors(t.column("x").slice(a, b - a)), own[a:b], weight[a:b]
                if one[a] == two[a]:
                    near = x @ x.T >= NEAR
                    np.fill_diagonal(near, False)
                    out.append((ids[a:b], near @ w))
                else:
                    p, q = np.flatnonzero(side == one[a]), np.flatnonzero(side == two[a])
                    near = x[p] @ x[q].T >= NEAR
                    out += [(ids[a:b][p], near @ w[q]), (ids[a:b][q], near.T @ w[p])]
            got = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ([], []))]
            yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1].astype(np.int64))], names=["v", "links"])

    cells = rows.repartition("root", "one", "two").sortWithinPartitions("root", "one", "two")
    return cells.mapInArrow(count, "v bigint, links bigint").groupBy("v").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept, and ``audited_recall`` of the last descent.

    Rows with an equal label that isn't null link at a cosine of NEAR or more. Vectors that are null or zero or hold null or non-finite
    components link with nothing, each its own component. Equal vectors of a label are linked; vectors of other lengths never.
    Without any usable vector nothing is linked.
    """
    rows, made = nodes(vectors)
    rows, every = settled(rows), settled(made)
    lists, attempt = None, 0
    links = every.sparkSession.createDataFrame([], "u bigint, v bigint")

    def grouped() -> DataFrame:
        return settled(components(links).select(F.col("node").alias("k"), "root"))

    while True:
        held, seen = _parted(_projected(every, attempt))
        links = links.union(seen)
        first = held.filter("not link").drop("link")
        lengths = None if lists is None else lists.groupBy("v").agg(F.first("long").alias("long"))
        lists = settled(_lists(first if lists is None else first.union(lists.select("v", "w", "sim")), lengths))
        discard(held)
        total = lists.count()
        for _ in range(ROUNDS):
            lists, changed, seen = _descend(every, lists)
            links = links.union(seen)
            if changed <= total // 200:
                break
        links = links.union(lists.filter(F.col("sim") >= NEAR).select(F.col("v").alias("u"), F.col("w").alias("v")))
        links = settled(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        roots = grouped()
        more = settled(_between(every, roots, lists))
        if not more.isEmpty():
            links = links.union(more)
            roots = grouped()
        missed, recall, whole = _audit(every, roots, attempt, AUDIT << attempt)
        if missed is not None and not missed.isEmpty():
            links = links.union(missed)
            roots = grouped()
        if whole or recall >= RECALL:
            break
        attempt += 1
    counts = _exact(every, roots)
    groups = every.join(roots.withColumnRenamed("k", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = settled(groups.groupBy("root").agg(F.min("vec_id").alias("component_id")))
    member = groups.select("node", "root", "weight").join(least, "root").join(counts, F.col("node") == F.col("v"), "left").select(
        "node", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    return rows.join(settled(member), "node", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"), F.lit(recall).alias("audited_recall"))
