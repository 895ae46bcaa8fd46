"""Work that must not gather in one task, one sort or one batch as tables grow."""
import inspect
import json
import random
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from syllabase.functions import html as H
from syllabase.functions import titles as T
from syllabase.functions.plan import spread
from syllabase.operators import maintain as M
from syllabase.operators import programs as G
from syllabase.operators import quality as Q
from syllabase.operators import reads as R
from syllabase.plans import refresh
from syllabase.session import checkpoint
from syllabase.sources import catalog as C
from syllabase.streaming import notices as N

PROGRAM = "institution_id long, pos long, name string, code string, global_specialty string, qualification string, cost double, duration int"
TITLES = ["6В06101 Информационные системы", "Право", "Х", "12 Дизайн одежды (", "Finance and Accounting", None, "Cookie policy notice"]


def tasks(df):
    return df.rdd.getNumPartitions()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(spark, n=300):
    rng = random.Random(5)
    return [(rng.randrange(6), i, rng.choice(TITLES), rng.choice(["6В06101", "6В041", "", None]), rng.choice(["IT", None]),
             rng.choice(["6B04101 x", None]), rng.choice([0.0, 5.0, None]), rng.choice([3, None])) for i in range(n)]


def test_rebuild_meets_the_tree_by_texts_and_keeps_equal_places(spark):
    rows = [((i // 4, i % 2), i % 3, TITLES[i % 7], "IT" if i % 2 else None, "6B06101" if i % 5 else None, 1.0 + i, None) for i in range(60)]
    df = spark.createDataFrame(rows, "ord struct<a:long,b:long>, institution_id long, name string, global_specialty string, code string, cost double, duration int")
    tree, offers = M.place_programs(df, *refresh.empty_tree(spark))
    named = offers.join(tree["level3"].select("specialization_id", F.col("name").alias("found")), "specialization_id")
    usable = [r for r in rows if r[2] and len(r[2]) >= 2]
    assert sorted((r["cost"], r["found"]) for r in named.collect()) == sorted((r[5], r[2]) for r in usable)
    old = M.upsert_tree(df.select("ord", "name", "global_specialty", "code"), *refresh.empty_tree(spark))
    for level, cols in (("level2", ["qualification_id", "qualification_name", "description"]), ("level3", ["specialization_id", "name"])):
        assert {tuple(r) for r in tree[level].select(*cols).collect()} == {tuple(r) for r in old[level].select(*cols).collect()}
    # rows meet the tree by their texts, not by a join of all rows with all rows
    assert "place_programs" in inspect.getsource(refresh.rebuild_catalog)


def test_lists_of_one_part_are_not_numbered(spark, monkeypatch):
    parents = spark.createDataFrame([(i,) for i in range(4)], "k long")
    rows = spark.createDataFrame([(i % 3, i, f"v{i}") for i in range(30)] + [(None, 1, "x")], "k long, o long, v string")
    want = {(k, p): v for k, p, v in [(r["k"], r["part"], [x["v"] for x in r["l"]]) for r in R.nest(parents, rows, "k", ["o"], ["v"], "l", 4).collect()]}
    assert want[0, 0] == ["v0", "v3", "v6", "v9"] and want[0, 2] == ["v24", "v27"] and want[3, 0] == []

    def numbered(*_):
        raise AssertionError("numbered")

    monkeypatch.setattr(R, "numbered", numbered)
    got = {(r["k"], r["part"]): [x["v"] for x in r["l"]] for r in R.nest(parents, rows, "k", ["o"], ["v"], "l", 10).collect()}
    assert got == {(k, 0): [f"v{i}" for i in range(k, 30, 3)] if k < 3 else [] for k in range(4)}


def test_rows_of_files_get_their_places_without_moving(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"name": f"N{i}"}) for i in range(20)))
    rows = C.read_catalog(spark, str(tmp_path))
    assert {(r["name"], r["source_row"]) for r in rows.collect()} == {(f"N{i}", i) for i in range(20)}
    assert "SortMergeJoin" not in plan(rows)


def test_elements_are_made_in_pieces_of_a_batch():
    texts = ["x" * 1000] * 50 + ["y" * 100_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(51)), pa.array(texts)], names=["id", "t"])
    parts = list(H.pieces(iter([batch, batch.slice(0, 0)]), 10_000))
    assert len(parts) > 10 and all(p.num_rows for p in parts)
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(51))


@pytest.mark.parametrize("held", [7, 50_000])
def test_held_changes_are_few_entries_of_the_state(spark, tmp_path, monkeypatch, held):
    assert N.BLOCK > 1 and N.HELD >= 1
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "HELD", held)

    class State(dict):
        calls = 0

        def updateValue(self, k, v):
            State.calls += 1
            self[k] = v

        getValue, removeKey = dict.__getitem__, dict.__delitem__

    class Value:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    class Handle:
        getValueState = getMapState = None

        def registerTimer(self, _):
            pass

    class Timer:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

    p = N._InOrder()
    p.handle, p.last, p.parts, p.held = Handle(), Value(), Value(), State()
    rng = random.Random(3)
    status = {n: rng.choice(["Pending", "Accepted", "Rejected"]) for n in range(200)}
    made = lambda ns: [N.Row(n=n, status=status[n], rest=f"r{n}") for n in ns]
    first = [n for n in range(200) if n % 3]
    rng.shuffle(first)
    out = list(p.handleInputRows((4,), made(first), Timer(0)))
    assert not out and State.calls < len(first)
    out += p.handleInputRows((4,), made([n for n in range(200) if n % 3 == 0]), Timer(100))
    out += p.handleExpiredTimer((4,), Timer(N.END), None)
    want, before = [], "Pending"
    for n in range(200):
        if status[n] != before:
            want.append((n, status[n], f"r{n}"))
        before = status[n]
    early = [(r.n, r.status, r.rest) for r in out]
    assert sorted(early) == early == want and not p.held


def test_few_bytes_of_much_work_are_dealt_to_all_tasks(spark):
    one = spark.createDataFrame([(i, TITLES[i % 7], None) for i in range(200)], "id long, name string, qualification string").coalesce(1)
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks(one) == 1 and tasks(spread(one)) == wide
    out = T.analyze_titles(one, T.LINK_RULES)
    assert tasks(out) == wide and out.count() == 200
    assert "RoundRobinPartitioning" in plan(Q.flagged(spark.createDataFrame(rows_of(spark), PROGRAM)))


def test_audit_sums_numbers_and_judges_each_text_once(spark, monkeypatch):
    rows = rows_of(spark)
    seen = []
    whole = Q.flagged
    monkeypatch.setattr(Q, "flagged", lambda df: seen.append(df.count()) or whole(df))
    inst = spark.createDataFrame([(i, f"U{i}") for i in range(7)], "institution_id long, name string")
    df = spark.createDataFrame(rows, PROGRAM)
    got = {r["institution_id"]: r for r in Q.audit(inst, df).collect()}
    assert seen == [len({(r[2], r[5], r[3]) for r in rows})]
    flagged = whole(df).collect()
    for i in range(7):
        own = [r for r in flagged if r["institution_id"] == i]
        times = lambda keys: {k: keys.count(k) for k in keys if k}
        codes, names = times([r["audit_code"] for r in own]), times([r["fp"] for r in own])
        r = got[i]
        assert (r["specs_count"], r["with_cost"], r["issue_rows"]) == (
            len(own), sum(bool(x["cost"]) for x in own), sum(bool(x["flags"]) for x in own))
        assert r["flag_counts"] == times([f for x in own for f in x["flags"]])
        assert r["code_duplicate_groups"] == sum(n > 1 for n in codes.values())
        assert r["name_duplicate_groups"] == sum(n > 1 for n in names.values())
        assert r["severity"] == sum(len(x["flags"]) for x in own) + 2 * sum(n - 1 for n in codes.values())


def test_links_are_kept_by_rank_without_a_sort_of_texts(spark):
    titles = spark.createDataFrame([(1, "6В06101 Информационные системы", None), (1, "6В06101 Архитектура систем", None), (2, "6B06101 Ақпараттық жүйелер", None),
                                    (None, "6В06101 Право и закон", None)], "specialization_id long, name string, qualification string")
    link = spark.createDataFrame([(9, 1, 5.0, "3"), (9, 2, 7.0, None), (None, 2, 1.0, "2"), (9, None, 9.0, "9")],
                                 "institution_id long, specialization_id long, cost double, duration string")
    out = G.clean_links(link, titles)
    assert "SortAggregate" not in plan(out)
    # of two titles with one id, the first by its text; both count for the group
    assert {tuple(r) for r in out.collect()} == {
        (9, "6В06101", 1, "Архитектура систем", 7.0, 3, 2, True), (None, "6В06101", 2, "Ақпараттық жүйелер", 1.0, 2, 0, True)}


def test_merged_programs_read_each_title_once(spark, monkeypatch):
    rows = rows_of(spark)
    base = spark.createDataFrame([r + ("list",) for r in rows if r[1] % 3], PROGRAM + ", source string")
    extra = spark.createDataFrame([r + ("official",) for r in rows if r[1] % 3 == 0], PROGRAM + ", source string")
    dealt = []
    monkeypatch.setattr(G, "spread", lambda df: dealt.append(df.count()) or spread(df), raising=False)
    out = G.merge_programs(base, extra)
    assert dealt == [len({(r[2], r[3]) for r in rows})]
    key = lambda r: (r[0], (r[3] or "") + "|" + (r[2] or ""))
    assert out.count() <= len({key(r) for r in rows}) and out.select("institution_id", "pos").distinct().count() == out.count()


def test_offers_of_one_place_keep_their_own_price(spark):
    """Places may be null or repeat: a price stays with the texts of its own row."""
    incoming = spark.createDataFrame([(1, "Новый", "university", None, None, None)],
                                     "incoming_id long, name string, type string, location string, address string, website string")
    programs = spark.createDataFrame([(1, None, n, None, None, c, None) for n, c in (("Право", 1.0), ("Экономика", 2.0), ("Дизайн", 3.0))],
                                     "incoming_id long, pos long, name string, global_specialty string, code string, cost double, duration int")
    existing = incoming.limit(0).withColumnRenamed("incoming_id", "institution_id")
    out = refresh.rebuild_catalog(incoming, programs, existing)
    got = out["links"].join(out["level3"], "specialization_id")
    assert {(r["name"], r["cost"]) for r in got.collect()} == {("Право", 1.0), ("Экономика", 2.0), ("Дизайн", 3.0)}
    assert out["placed"].count() == 3


def test_merged_programs_of_repeated_places_have_the_texts_of_each_row(spark):
    schema = PROGRAM + ", source string"
    base = spark.createDataFrame([(1, 1, "Право", "6В1", "g", "q", 1.0, None, "list")] * 2 + [(1, 2, "Дизайн", None, "g", "q", 2.0, 3, "list"), (1, 2, "Экономика", "6В2", "h", "q", 4.0, 5, "list")], schema)
    extra = spark.createDataFrame([(1, 1, "ПРАВО", None, "x", "x", 9.0, 4, "official"), (None, 1, "Право", None, "x", "x", 9.0, 4, "official"),
                                   (1, None, "Право", None, "x", "x", 9.0, 4, "official"), (2, 7, "Право", None, None, None, 9.0, 4, "official")], schema)
    got = G.merge_programs(base, extra).select("institution_id", "pos", "name", "code", "global_specialty", F.array_join("sources", ",").alias("s"))
    # a row for each row at the place that won and each at the place of the code
    want = [(1, 1, "Право", "6В1", "g", "list,official")] * 4 + [(2, G.SECOND + 7, "Право", None, None, "official")]
    want += [(1, 2, n, c, g, "list") for n, g in (("Дизайн", "g"), ("Экономика", "h")) for c in (None, "6В2")]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if "shuffle_" in f}

    before, setting = shuffles(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    asked = spark.conf.get(setting, None)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    out = checkpoint(rows)
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert out.count() == rows.count() == 7 and spark.conf.get(setting, "false") == (asked or "false")


def test_merged_programs_leave_no_checkpoint_of_rows(spark, monkeypatch):
    """What the rows were is deleted once numbers stand for their texts."""
    made = []
    monkeypatch.setattr(G, "checkpoint", lambda df: made.append(checkpoint(df)) or made[-1])
    rows = rows_of(spark)
    base = spark.createDataFrame([r + ("list",) for r in rows if r[1] % 3], PROGRAM + ", source string")
    extra = spark.createDataFrame([r + ("official",) for r in rows if r[1] % 3 == 0], PROGRAM + ", source string")
    out = G.merge_programs(base, extra)
    context = spark.sparkContext
    path = lambda df: context._jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    there = [path(df).getFileSystem(context._jsc.hadoopConfiguration()).exists(path(df)) for df in made]
    wide = ["name" in df.columns and "at" in df.columns for df in made]
    assert out.count() and any(wide) and not any(t for t, w in zip(there, wide) if w)
