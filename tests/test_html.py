"""Elements paired by depth, against a stack, and the readers of nested tables and blocks."""
import random
import re

from pyspark.sql import functions as F

from syllabase.functions import html as H
from syllabase.operators import pages as P


def by_stack(html, tags):
    out = []
    for kind, tag in enumerate(tags):
        stack, found = [], []
        for m in re.finditer(rf"(?is)</?(?:{tag})(?:\s[^>]*)?/?>", html):
            for e in found[-1:]:
                e["next"] = m.start() if e["next"] is None else e["next"]
            if not m[0].startswith("</"):
                found.append({"tag": m[0], "from": m.end(), "to": None, "next": None})
                stack.append(found[-1])
            elif stack:
                stack.pop()["to"] = m.start()
        for e in found:
            to = e["to"] if e["to"] is not None else e["next"] if e["next"] is not None else len(html)
            out.append((kind, e["tag"], html[e["from"]:to]))
    return out


def test_elements_equal_a_stack(spark):
    rng = random.Random(1)
    parts = ["<div>", "</div>", "<div class='é'>", "<td>", "</td>", "<TD x>", "<th>", "</th>", "x", "é ", "<divx>", "<p>", "</p>\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 20, 60, 300])))) for i in range(60)]
    rows += [(100, ""), (101, "<div>" * 3 + "a" + "</div>" * 5 + "<div>b"), (102, "<p>a<p>b</p>")]
    tags = ["div", "t[dh]", "p"]
    got = H.with_elements(spark.createDataFrame(rows, "id int, html string"), F.col("html"), tags, "e").collect()
    assert {r["id"]: [tuple(e) for e in r["e"]] for r in got} == {i: by_stack(h, tags) for i, h in rows}


def test_elements_of_a_small_page(spark):
    html = "<div a>x<DIV>y</div><div>z</div>w</div></div><div>open<p>1<p>2</p>"
    df = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    got = {r["id"]: r["e"] for r in H.with_elements(df, F.col("html"), ["div", "p"], "e").collect()}
    assert [tuple(e) for e in got[1]] == [
        (0, "<div a>", "x<DIV>y</div><div>z</div>w"), (0, "<DIV>", "y"), (0, "<div>", "z"), (0, "<div>", "open<p>1<p>2</p>"),
        (1, "<p>", "1"), (1, "<p>", "2")]
    assert got[2] is None


def page(spark, html):
    return spark.createDataFrame([(1, "http://a.kz", html)], "page_id long, url string, html string")


def test_tables_of_three_levels(spark):
    deep = "<table><tr><td>h</td></tr><tr><td>Третий уровень 6B07103</td></tr></table>"
    middle = f"<table><tr><th>h</th></tr><tr><td>6B06102</td><td>Второй {deep} уровень</td></tr></table>"
    html = f"<table><tr><th>код</th><th>имя</th></tr><tr><td>6B06101</td><td>Первый {middle}</td><td>700 000 тг</td></tr><tr><td>После вложенной</td></tr></table>"
    got = sorted((r["tab"], r["row"], r["name"], r["code"]) for r in P.table_programs(page(spark, html)).collect())
    third, second = "Третий уровень 6B07103", "Второй h Третий уровень 6B07103 уровень"
    first = f"Первый h 6B06102 {second}"
    # Rows of inner tables are rows of the outer ones too.
    assert got == [
        (0, 1, first, "6В06101"), (0, 3, second, "6В06102"), (0, 5, third, "6В07103"), (0, 6, "После вложенной", None),
        (1, 1, second, "6В06102"), (1, 3, third, "6В07103"), (2, 1, third, "6В07103")]


def test_text_of_nested_blocks(spark):
    html = "<div>" + "слово " * 60 + "<div>Бакалавр <div>права</div> и закона</div></div><ul><li>Образовательная <ul><li>программа вложенная</li></ul></li></ul>"
    got = {r["txt"] for r in P.text_programs(page(spark, html)).collect()}
    assert "Бакалавр права и закона" in got and "Образовательная программа вложенная" in got


def test_cards_with_blocks_inside_labels(spark):
    html = ('<div class="px-3"><div class="flex border-b"><div><a>Право</a></div><span class="ml-5">6В042</span></div>'
            '<div class="college-qualification x"><div><a>Юриспруденция</a></div><div class="flex flex-col"><div>Стоимость</div><div>700 000 тг</div></div>'
            '<div class="flex-col"><div>Срок <div>обучения</div></div><div>4 года</div></div></div><div>после 90 000 тг</div></div>')
    got = P.card_programs(page(spark, html)).collect()
    assert [(r["global_specialty"], r["code"], r["name"], r["cost"], r["duration"]) for r in got] == [("Право", "6В042", "Юриспруденция", 700000.0, 4)]


def test_group_rows_head_what_follows(spark):
    rows = ('<tr><td colspan="4"><a href="/g">Право</a> (6В042)</td></tr><tr><td><a>Юрист</a></td><td>очно</td><td>700 000 тг</td><td>4 года</td></tr>'
            "<tr><th>x</th></tr><tr><td>Экономика (бакалавр) </td></tr><tr><td>Учёт</td><td></td><td>10</td><td>3</td></tr>")
    html = f'<table><tbody><tr><td>не здесь</td><td>x</td></tr></tbody><tbody class="a college-specialty-table-body">{rows}</tbody></table>'
    got = P.header_table_programs(page(spark, html).union(spark.createDataFrame([(2, "u", None), (3, "u", "<p>no table</p>")], "a long, b string, c string")))
    assert sorted((r["pos"], r["global_specialty"], r["code"], r["name"], r["cost"], r["duration"]) for r in got.collect()) == [
        (1, "Право", "6В042", "Юрист", 700000.0, 4), (4, "Экономика", None, "Учёт", None, 3)]
