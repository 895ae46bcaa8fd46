"""Numbers, payloads, model answers, coordinates, page helpers on hand-worked values."""
from pyspark.sql import functions as F

from syllabase.functions import geo as G
from syllabase.functions import html as H
from syllabase.functions import text as X
from syllabase.functions import values as V


def check(spark, fn, table, kind="string"):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(table)], f"i int, s {kind}")
    assert [r[0] for r in rows.orderBy("i").select(fn(F.col("s"))).collect()] == [b for _, b in table]


def test_money(spark):
    check(spark, V.parse_money, [
        ("Стоимость обучения: 1 200 000 тг", 1200000.0), ("900 000 тенге в год", 900000.0), ("цена 400", None),
        ("tuition fee 60000 KZT", 60000.0), ("60000", None), ("tuition fee 99000000 KZT", None), ("99 000 000 тг", 9000000.0), ("500 000 ₸", None), (None, None),
    ])
    check(spark, V.parse_money_cell, [("1 200 000", 1200000.0), ("99 000 000 000", 99000000000.0), ("12", None), (None, None)])


def test_years(spark):
    check(spark, V.parse_years, [("4 года", 4), ("5 years", 5), ("9 лет", None), ("лет", None), (None, None)])
    check(spark, V.parse_years_cell, [("4", 4), ("9", None), ("10 лет", 10), ("x", None)])


def test_cost_and_duration(spark):
    check(spark, V.normalize_cost, [("1 200,50 тг", 1200.5), ("₸5", 5.0), ("-3", None), ("abc", None), ("", None), ("0", None)])
    check(spark, V.normalize_duration, [("4 года", 4), ("11", None), ("0", None), ("", None), (None, None)])


def test_payload_rules(spark):
    form = ('[{"name":"a","type":"number","required":true},{"name":"m","type":"email"},{"name":"p","type":"phone"},'
            '{"label":"no name","required":true},{"name":"t","required":true}]')
    rows = [
        ('{"a":"1.5","m":"x@y.kz","p":"+7 701 1","t":"ok"}', []),
        ('{"a":"x","m":"nobody","p":"12a","t":" "}', ["a:number", "m:email", "p:phone", "t:required"]),
        ("{}", ["a:required", "t:required"]), (None, ["a:required", "t:required"]),
    ]
    check(spark, lambda c: V.validate_payload(F.lit(form), c), rows)
    stored = '"' + form.replace('"', '\\"') + '"'
    check(spark, lambda c: V.validate_payload(F.lit(stored), c), rows)
    check(spark, lambda c: V.validate_payload(F.lit(None).cast("string"), c), [("{}", [])])


def test_model_output(spark):
    table = [
        ('{"summary":" текст ","specialties":[" Право ",""," Дизайн"]}', ("текст", ["Право", "Дизайн"])),
        ('Ответ:\n{"разбор":"a\\nb","специальности":["X"]} конец', ("a\nb", ["X"])),
        ('{"summary":"{\\"интересы\\":\\"x\\",\\"specialties\\":[\\"Y\\"]}"}', ("x", ["Y"])),
        ('{"summary":{"a":"one","b":{"c":["two","three"]}},"specialties":["Z"]}', ("one\n\ntwo\n\nthree", ["Z"])),
        ('{"summary":["p1","p2"]}', ("p1\n\np2", [])),
        ("{broken", (None, [])), ("nothing", (None, [])), ('{"summary":""}', (None, [])),
    ]
    check(spark, lambda c: F.struct(*V.parse_model_output(c)), table)


def test_week_key_follows_iso_years(spark):
    df = spark.sql("SELECT explode(array(DATE'2021-01-03', DATE'2024-12-30', DATE'2024-01-01')) AS s")
    assert [r[0] for r in df.select(V.iso_week_key(F.col("s"))).collect()] == ["202053", "202501", "202401"]


def test_hosts(spark):
    check(spark, X.website_host, [
        ("https://www.Mnu.kz/ru", "mnu.kz"), ("mnu.kz", None), ("https://zero.kz/x", None), (None, None), ("ht!tp:// bad", None),
    ])


def test_coordinates_in_text(spark):
    check(spark, G.coords_from_text, [
        ("x!3d51.1!4d71.4", (51.1, 71.4)), ("@1.5,2.5 @43.2,76.9,15z", (43.2, 76.9)), ("center=43.2%2C76.9", (43.2, 76.9)),
        ("!3d1.5!4d2.5 center=50.5%2C60.5", (50.5, 60.5)), ("none", None), (None, None),
    ])


def test_urls_resolve_like_a_browser(spark):
    base = F.lit("https://www.a.kz/ru/page/index.html?x=1#f")
    check(spark, lambda c: H.resolve_url(base, c), [
        ("/x", "https://www.a.kz/x"), ("y.html", "https://www.a.kz/ru/page/y.html"), ("../z", "https://www.a.kz/ru/z"),
        ("?q=2", "https://www.a.kz/ru/page/index.html?q=2"), ("//b.kz/p", "https://b.kz/p"), ("http://c.kz/#t", "http://c.kz/"),
        ("./a/./b/../c", "https://www.a.kz/ru/page/a/c"),
    ])


def test_anchor_text_is_decoded(spark):
    html = "<script>var a='<a href=\"/no\">x</a>'</script><a class=x href='/p?a=1&amp;b=2'> Tom <b>&amp;</b>\n Co</a>"
    check(spark, lambda c: H.anchors(H.visible(c)), [(html, [("/p?a=1&b=2", "Tom & Co")])])


def test_ticket_is_stable_and_looks_like_a_uuid(spark):
    got = spark.range(2).select(V.stable_ticket(F.col("id"), F.lit(5))).collect()
    assert len({r[0] for r in got}) == 2 and all(len(r[0]) == 36 and r[0].count("-") == 4 for r in got)


def test_each_form_is_read_once_and_joined(spark):
    from syllabase.operators import answers as W

    form = '[{"name": "k", "type": "number", "required": true}]'
    rows = [(1, form, '{"k": "x"}'), (2, form, '{"k": "5"}'), (3, None, '{"k": "x"}'), (4, "no json", None), (5, form, None), (6, '"' + form.replace('"', '\\"') + '"', "{}")]
    df = W.validate_payloads(spark.createDataFrame(rows, "id long, form string, payload string"), "form", "payload", "bad")
    assert {r["id"]: r["bad"] for r in df.collect()} == {1: ["k:number"], 2: [], 3: [], 4: [], 5: ["k:required"], 6: ["k:required"]}
