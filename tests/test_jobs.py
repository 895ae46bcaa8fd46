"""Properties of the jobs: winners, merges, carries, parts, graphs, files."""
import json
import random

from pyspark.sql import functions as F

from syllabase.operators import answers as W
from syllabase.operators import maintain as M
from syllabase.operators import pages as P
from syllabase.operators import programs as G
from syllabase.operators import quality as Q
from syllabase.operators import reads as R
from syllabase.operators.graph import components, star_edges
from syllabase.operators.ordered import carry_last
from syllabase.plans import refresh
from syllabase.sources import catalog as C

PROGRAM = "institution_id long, pos long, name string, code string, global_specialty string, qualification string, cost double, duration int"


def programs(spark, rows):
    return spark.createDataFrame(rows, PROGRAM)


def test_clean_links_prefers_russian_and_best_price(spark):
    titles = spark.createDataFrame([
        (1, "6В06101 Информационные системы", None), (2, "6B06101 Ақпараттық жүйелер", None), (3, "6В06101 Information Systems", None),
        (4, "Х", None), (5, "Архитектура зданий 5 лет", None),
    ], "specialization_id long, name string, qualification string")
    link = spark.createDataFrame([
        (9, 1, None, None), (9, 2, 900.0, "3"), (9, 3, 700.0, "4"), (9, 4, 1.0, "1"), (9, 5, 0.0, None), (8, 2, 5.0, None),
    ], "institution_id long, specialization_id long, cost double, duration string")
    got = {(r["institution_id"], r["specialization_id"]): r for r in G.clean_links(link, titles).collect()}
    assert set(got) == {(9, 1), (9, 5), (8, 2)}
    top = got[9, 1]
    assert (top["final_name"], top["cost"], top["duration"], top["removed"], top["renamed"]) == ("Информационные системы", 900.0, 4, 2, True)
    assert (got[9, 5]["duration"], got[9, 5]["cost"]) == (5, None)
    stats = {r["institution_id"]: (r["kept"], r["removed"]) for r in G.clean_stats(link, titles).collect()}
    assert stats == {9: (2, 3), 8: (1, 0)}


def test_renames_move_to_an_existing_programme(spark):
    kept = spark.createDataFrame([(1, 10, "Право", 5.0, None, True), (1, 11, "Право", None, 4, False), (2, 12, "Новое имя", 1.0, 1, True)],
                                 "institution_id long, specialization_id long, final_name string, cost double, duration int, renamed boolean")
    spec = spark.createDataFrame([(10, "6В1 Право", "q"), (11, "Право", "q"), (12, "старое", "q")], "specialization_id long, name string, qualification_id string")
    links, names = G.apply_renames(kept, spec)
    assert {tuple(r) for r in links.collect()} == {(1, 11, 5.0, 4), (2, 12, 1.0, 1)}
    assert [tuple(r) for r in names.collect()] == [(12, "Новое имя")]


def test_dedupe_programs_is_idempotent_and_fills_gaps(spark):
    rows = programs(spark, [
        (1, 1, "6В06101 Информационные системы", None, "IT", None, None, None),
        (1, 2, "Ақпараттық жүйелер", "6B06101", "IT", None, 700.0, None),
        (1, 3, "Information Systems", "6B06101", None, None, 900.0, 4),
        (1, 4, "6В061", None, None, None, 1.0, 1), (1, 5, "Право и закон", None, None, None, -5.0, 9),
    ])
    once = G.dedupe_programs(rows)
    got = {r["name"]: (r["code"], r["cost"], r["duration"], r["qualification"]) for r in once.collect()}
    assert got == {
        # English without a second language outranks the Kazakh title, so its price fills the gap.
        "Информационные системы": ("6В06101", 900.0, 4, "6В06101 · IT"),
        "Право и закон": (None, None, None, "Образовательные программы"),
    }
    twice = G.dedupe_programs(once)
    assert {tuple(r[c] for c in ("name", "code", "cost", "duration")) for r in twice.collect()} == {
        tuple(r[c] for c in ("name", "code", "cost", "duration")) for r in once.collect()}


def test_merge_programs_follows_the_key_then_the_name(spark):
    schema = PROGRAM + ", source string"
    base = spark.createDataFrame([
        (1, 1, "Право", "6B1", "g", "q", None, None, "list"), (1, 2, "право.", None, "g", "q", 5.0, None, "list"),
        (1, 3, "Право", "6В1", "g", "q", 7.0, None, "list"),
    ], schema)
    extra = spark.createDataFrame([
        (1, 1, "ПРАВО", None, "x", "x", 9.0, 4, "official"), (1, 2, "Право", "6В9", "x", "x", 1.0, 3, "official"),
        (1, 3, "Новое", "6В2", "x", "x", None, None, "official"), (1, 4, "новое", None, "x", "x", 3.0, 2, "official"),
    ], schema)
    got = {(r["name"], r["code"], r["cost"], r["duration"], tuple(r["sources"])) for r in G.merge_programs(base, extra).collect()}
    assert got == {
        ("Право", "6В1", 7.0, 3, ("list", "official")),
        ("право.", None, 5.0, 4, ("list", "official")), ("Новое", "6В2", 3.0, 2, ("official",)),
    }


def test_keep_better_and_caps(spark):
    rows = programs(spark, [
        (1, 1, "Право", None, None, None, None, 4), (1, 2, "право", None, None, None, 5.0, None), (1, 3, "Право", None, None, None, 6.0, None),
        (1, 4, "Error 404", None, None, None, 1.0, 1), (1, 5, "abc", None, None, None, 1.0, 1),
    ])
    assert [r["pos"] for r in G.keep_better(rows).collect()] == [2]
    long = programs(spark, [(k, i, f"Имя {i}", "6В1" if k == 1 and i < 6 else None, None, None, None, None) for k in (1, 2, 3) for i in range(6 if k == 3 else 12)])
    got = G.list_sizes(long).groupBy("institution_id", "listed", "coded").count().collect()
    assert {tuple(r) for r in got} == {(1, 12, 6, 12), (2, 12, 0, 12), (3, 6, 0, 6)}


def test_overrides_last_rule_wins_and_defaults_spare_ruled_rows(spark):
    rows = programs(spark, [(1, 1, "Nursing", None, None, None, None, None), (1, 2, "Law", None, None, None, 5.0, None), (2, 3, "Law", None, None, None, None, 2), (3, 4, "Law", None, None, None, 1.0, 1)])
    by_id = spark.createDataFrame([(1, False, 100.0, 4), (2, None, 200.0, None)], "institution_id long, fill_null_only boolean, default_cost double, default_duration int")
    rules = spark.createDataFrame([(1, "(?i)nurs", 10.0, 3, 1), (1, "Nurs", 20.0, None, 2)], "institution_id long, match string, cost double, duration int, ord int")
    got = {r["pos"]: (r["cost"], r["duration"], r["cost_source"]) for r in G.apply_overrides(rows, by_id, rules).collect()}
    assert got == {1: (20.0, 3, "official_name_rule"), 2: (100.0, 4, "official_default_force"), 3: (200.0, 2, "official_default_fill"), 4: (1.0, 1, None)}


def test_audit_severity(spark):
    inst = spark.createDataFrame([(1, "A"), (2, "B")], "institution_id long, name string")
    rows = programs(spark, [
        (1, 1, "6В06101 Право и закон", None, None, None, 1.0, 1), (1, 2, "Экономика труда", "6B06101", None, None, 0.0, 1),
        (1, 3, "экономика-труда", "6В06101", None, None, None, 1), (1, 4, None, None, None, None, None, None),
    ])
    got = {r["institution_id"]: r for r in Q.audit(inst, rows).collect()}
    a = got[1]
    assert (a["specs_count"], a["with_cost"], a["issue_rows"], a["code_duplicate_groups"], a["name_duplicate_groups"], a["severity"]) == (4, 1, 2, 1, 1, 3 + 2 * 2)
    assert a["flag_counts"] == {"leading_code_in_name": 1, "empty_or_too_short": 1, "too_few_letters": 1}
    assert (got[2]["specs_count"], got[2]["severity"], got[2]["flag_counts"]) == (0, 0, {})


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(1, 300), rng.randint(1, 300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


def test_one_hot_key_gives_star_edges_not_pairs(spark):
    rows = spark.range(5000).select(F.lit("k").alias("key"), F.col("id").alias("node"))
    edges = star_edges(rows, "key", "node")
    assert edges.count() == 4999
    roots = components(edges)
    assert roots.filter("root = 0").count() == 5000


def test_merge_duplicates_leaves_no_dangling_key(spark):
    inst = spark.createDataFrame([
        (1, "ЕНУ Гумилёва", "university", None, "https://a.kz", False), (2, "Гумилёв ЕНУ", "university", "Астана", "https://b.kz", True),
        (3, "Другой", "university", "X", "https://www.b.kz/x", False), (4, "КАЗГЮУ", "university", "0", None, False),
        (5, "Maqsut Narikbayev", "university", "Y", None, False), (6, "Колледж гумилёва", "college", None, "https://a.kz", False),
    ], "institution_id long, name string, type string, address string, website string, grants boolean")
    roots = M.duplicate_roots(inst)
    assert {(r["node"], r["root"]) for r in roots.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    kept = {r["institution_id"]: r for r in M.merge_institutions(inst, roots, flags=("grants",)).collect()}
    assert set(kept) == {1, 4, 6}
    assert (kept[1]["address"], kept[1]["grants"], kept[1]["website"]) == ("Астана", True, "https://a.kz")
    assert (kept[4]["name"], kept[4]["address"]) == ("Maqsut Narikbayev University (КАЗГЮУ)", "Y")
    link = spark.createDataFrame([(1, 7, None, 4), (2, 7, 5.0, 3), (3, 8, 6.0, None)], "institution_id long, specialization_id long, cost double, duration int")
    assert {tuple(r) for r in M.merge_links(link, roots).collect()} == {(1, 7, 5.0, 4), (1, 8, 6.0, None)}


def test_upserts_keep_given_values(spark):
    old = spark.createDataFrame([(1, 1, 5.0, 4), (1, 2, 7.0, None)], "institution_id long, specialization_id long, cost double, duration int")
    new = spark.createDataFrame([(1, 1, 1, None, "3"), (2, 1, 1, "", None), (3, 1, 3, "9", None), (4, 1, 3, None, "2")], "ord long, institution_id long, specialization_id long, cost string, duration string")
    got = {tuple(r) for r in M.upsert_links(old, new).collect()}
    assert got == {(1, 1, 5.0, 3, "updated"), (1, 2, 7.0, None, "kept"), (1, 3, 9.0, 2, "created")}


def test_upsert_tree_is_stable(spark):
    rows = spark.createDataFrame([(1, "Право", "Юр", "6B1 "), (2, "Закон", "Юр", "6в1"), (3, "Право", None, None), (4, "x", "Юр", None)], "ord long, name string, global_specialty string, code string")
    first = M.upsert_tree(rows, *refresh.empty_tree(spark))
    assert {r["qualification_name"] for r in first["level2"].collect()} == {"6В1 · Юр", "6в1 · Юр", "Образовательные программы"}
    level2 = first["level2"].drop("action")
    again = M.upsert_tree(rows, first["level1"].drop("action"), level2, first["level3"].drop("action"))
    for part in ("level2", "level3"):
        assert {r["action"] for r in again[part].collect()} <= {"kept"}
    assert {tuple(r) for r in again["placed"].collect()} == {tuple(r) for r in first["placed"].collect()}
    known = spark.createDataFrame([(5, r["global_id"], "6В1 старое", None) for r in first["level1"].filter("global_name = 'Юр'").collect()], level2.schema)
    out = M.upsert_tree(rows, first["level1"].drop("action"), known, first["level3"].drop("action").limit(0))
    assert {(r["qualification_name"], r["description"], r["action"]) for r in out["level2"].filter("qualification_id = 5").collect()} == {("6В1 · Юр", "6В1", "updated")}


def test_carry_equals_a_window_for_any_width(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2]), i, rng.choice([None, None, f"v{i}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, pos long, v string")
    for strict in (False, True):
        want, last = [], {}
        for k, i, v in rows:
            if strict:
                want.append((k, i, last.get(k)))
            if v is not None:
                last[k] = v
            if not strict:
                want.append((k, i, last.get(k)))
        for width in (1, 7, 1000):
            got = carry_last(df, "k", "pos", F.col("v"), "out", width, strict)
            assert sorted(tuple(r) for r in got.select("k", "pos", "out").collect()) == sorted(want)


def test_long_lists_are_nested_in_parts_and_stay_whole(spark):
    parents = spark.range(3).withColumnRenamed("id", "p")
    rows = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(1).cast("long").alias("p"), F.col("id").alias("i"))
    out = R.nest(parents, rows, "p", ["i"], [], "items", limit=100)
    sizes = {}
    for r in out.orderBy("p", "part").collect():
        sizes.setdefault(r["p"], []).append([x["i"] for x in r["items"]])
    assert len(sizes[0]) == 9 and sum(sizes[0], []) == list(range(900))
    assert sizes[1] == [list(range(900, 1000))] and sizes[2] == [[]]
    many = R.nest(parents, spark.range(30_000).select(F.lit(0).cast("long").alias("p"), F.col("id").alias("i")).repartition(7), "p", ["i"], [], "items")
    assert sum([[x["i"] for x in r["items"]] for r in many.filter("p = 0").orderBy("part").collect()], []) == list(range(30_000))


def test_answers_short_and_long(spark):
    rows = [(1, 0, "В?", " да "), (1, 1, None, "нет")] + [(2, i, "q", str(i)) for i in range(26)]
    answers = spark.createDataFrame(rows, "result_id long, pos long, question string, answer string")
    plain, staged = ({(r["result_id"], r["stage"]): r["text"] for r in W.compact_answers(answers, s).collect()} for s in (False, True))
    assert plain[1, 0] == "1. В? — да\n2. нет" and plain[2, 1].startswith("21. q — 20\n22. q — 21")
    assert staged[2, 1] == "Предпочтения в работе:\n" + "\n".join(f"- q — {i}" for i in range(20, 26))
    assert staged[1, 0] == "Личностные качества:\n- В? — да\n- нет"


def test_page_price_and_tables(spark):
    html = ("<p>Стоимость 700 000 тг</p><table><tr><th>a</th></tr><tr><td>6B06101</td><td>Право и закон</td><td>4 года</td></tr>"
            "<tr><td>1</td></tr><tr><td>6В071</td><td>12</td></tr></table><table><tr></tr></table>")
    pages = spark.createDataFrame([(1, "http://a.kz", html)], "page_id long, url string, html string")
    rows = P.inherit_page_cost(P.table_programs(pages), pages)
    got = {(r["name"], r["code"], r["cost"], r["duration"], r["cost_inherited"]) for r in rows.collect()}
    assert got == {("Право и закон", "6В06101", 700000.0, 4, True), ("6В071", "6В071", 700000.0, None, True)}


def test_catalog_files_of_both_shapes(spark, tmp_path):
    rows = [{"name": "A", "website": "https://a.kz", "specialties": [{"name": "Право", "cost": 5, "code": "6B1"}]}, {"name": "B", "error": "timeout"}, {"name": " "}]
    (tmp_path / "one.json").write_text(json.dumps({"city": "x", "institutions": rows}, ensure_ascii=False))
    (tmp_path / "two.json").write_text(json.dumps([{"id": 7, "name": "C", "programs": []}, {"name": "A", "specialties": None}]))
    df = C.unify_programs(C.read_catalog(spark, [str(tmp_path / "one.json"), str(tmp_path / "two.json")], lines=False))
    assert sorted((r["name"], r["institution_id"]) for r in df.collect()) == [("A", None), ("A", None), ("C", 7)]
    flat = C.unnest_programs(df.select(F.col("name").alias("owner"), "programs"), keep=("owner",))
    assert sorted((r["owner"], r["pos"], r["name"], r["cost"]) for r in flat.filter("name IS NOT NULL").collect()) == [("A", 0, "Право", "5")]
    existing = spark.createDataFrame([(1, "A", "university", None, None, None)], "institution_id long, name string, type string, location string, address string, website string")
    out = refresh.rebuild_from_files(spark, [str(tmp_path / "one.json"), str(tmp_path / "two.json")], existing, lines=False)
    assert [(r["institution_id"], r["cost"], r["action"]) for r in out["links"].collect()] == [(1, 5.0, "created")]


def test_snapshot_and_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, v string")
    C.write_snapshot(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    C.write_export(df, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 2
    assert C.first_source(df.limit(0), df).count() == 2
