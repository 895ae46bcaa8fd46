"""Page extraction, ordered carries, answers, notifications."""
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers as W
from ..operators import pages as P
from ..streaming import notices as N
from . import duck as D
from .registry import query
from .roles import ROLES, TITLES

ROLES.update({
    # Stored pages with a programme list, a price table and contact links put in.
    "rich_page": f"""
SELECT page_id, url, replace(html, '</article>', concat('<h2>Программы</h2><ul><li>6B0', CAST(10 + page_id % 80 AS STRING), '01 ', word, ' стоимость ', CAST(300 + page_id % 500 AS STRING), ' 000 тг, ',
  CAST(page_id % 10 AS STRING), ' года</li><li>Образовательная программа: ', word, '</li></ul><table class="x"><tr><th>Код</th><th>Название</th><th>Цена</th></tr><tr><td>6В0', CAST(10 + page_id % 80 AS STRING),
  '</td><td>', word, '</td><td>', CAST(300 + page_id % 500 AS STRING), ' 000 тг</td><td>4 года</td></tr><tr><td>12</td><td> 34 </td></tr><tr><td>', word, ' заочно</td><td>-</td></tr><tr><td><div class="a">Вложенная <div>таблица ', word, '</div></div><table><tr><th>к</th></tr><tr><td>6B0', CAST(20 + page_id % 70 AS STRING), '02</td><td>Внутри ', word,
  '<table><tr><td>a</td></tr><tr><td>Глубже ', CAST(page_id AS STRING), '</td></tr></table></td></tr></table></td><td>700 000 тг</td></tr></table>',
  '<a href="/ru/admission/', CAST(page_id AS STRING), '#top">Поступление</a><a class="d" href="docs/price', CAST(page_id % 7 AS STRING), '.pdf?v=1">Стоимость</a><a href="../up/./fee.html">x</a><a href="mailto:info', CAST(page_id AS STRING),
  '@mail.kz?s=1">m</a><a href="https://site', CAST(page_id AS STRING), '.edu.kz/x">s</a><p>г. Алматы, ул. Абая ', CAST(page_id AS STRING), '</p>', CASE WHEN page_id % 2 = 0 THEN '<p>тел. +7 (727) 123-45-67</p>' ELSE '<a href="tel:+77010000000">t</a>' END, '</article>')) AS html
FROM {{pages}} JOIN {{title_word}} ON page_id % {len(TITLES)} = k""",
    # A card listing made of the programmes of one level-2 row per block.
    "card_row": """
SELECT p_size AS page_id, p_partkey AS pos, p_brand AS header_name, concat('6В', CAST(100 + p_partkey % 800 AS STRING)) AS header_code, p_partkey % 6 = 0 AS is_header, p_name AS name FROM {part}""",
})

SEEN = r"regexp_replace(COALESCE(html, ''), '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<noscript\b[^>]*>.*?</noscript>|<svg\b[^>]*>.*?</svg>|<!--.*?-->', '', 'g')"


def decode(s):
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        s = f"replace({s}, '{a}', '{b}')"
    return s


def plain(s):
    return D.norm(decode(D.sub(s, "<[^>]*>", " ")))


def lines(s):
    split = f"string_split({decode(D.sub(s, '<[^>]*>', chr(92) + 'n')).replace(chr(39) + chr(92) + 'n' + chr(39), 'chr(10)')}, chr(10))"
    return f"list_filter(list_transform({split}, lambda y: {D.norm('y')}), lambda x: x <> '')"


def inner(s, tag):
    return f"regexp_extract_all({s}, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1)"


def elements(name, source, keys, col, tag):
    """Common table expressions that end in ``name``: (keys, n, tg, body) of the elements of a tag, paired by depth."""
    rx = rf"(?is)</?(?:{tag})(?:\s[^>]*)?/?>"
    shut, all_ = "starts_with(tg, '</')", f"PARTITION BY {keys} ORDER BY i"
    return f"""
 {name}_t AS (SELECT {keys}, {col} AS src0, UNNEST(regexp_extract_all({col}, '{rx}')) AS tg, UNNEST(list_transform(regexp_split_to_array({col}, '{rx}')[:-2], lambda x: length(x))) AS gap, generate_subscripts(regexp_extract_all({col}, '{rx}'), 1) AS i FROM {source}),
 {name}_p AS (SELECT *, CAST(SUM(gap + length(tg)) OVER ({all_}) AS BIGINT) AS stop, SUM(CASE WHEN {shut} THEN -1 ELSE 1 END) OVER ({all_}) AS s FROM {name}_t),
 {name}_m AS (SELECT *, stop - length(tg) AS start, least(0, MIN(s) OVER ({all_})) AS lo, least(0, COALESCE(MIN(s) OVER ({all_} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lo0 FROM {name}_p),
 {name}_d AS (SELECT *, s - lo + CASE WHEN {shut} THEN 1 ELSE 0 END AS depth, lead(start) OVER ({all_}) AS nxt FROM {name}_m),
 {name}_l AS (SELECT *, lead({shut}) OVER w AS shuts, lead(start) OVER w AS upto FROM {name}_d WHERE NOT ({shut} AND lo < lo0) WINDOW w AS (PARTITION BY {keys}, depth ORDER BY i)),
 {name} AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY i) - 1 AS n, tg, substr(src0, stop + 1, CASE WHEN shuts THEN upto ELSE COALESCE(nxt, length(src0)) END - stop) AS body FROM {name}_l WHERE NOT {shut})"""


A_RE = r"(?is)<a\s[^>]*?href\s*=\s*[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>"
ANCHORS = f"""
 v AS (SELECT page_id, url, {SEEN} AS src FROM {{rich_page}}),
 a0 AS (SELECT page_id, url, UNNEST(regexp_extract_all(src, '{A_RE}', 1)) AS href0, UNNEST(regexp_extract_all(src, '{A_RE}', 2)) AS t0, generate_subscripts(regexp_extract_all(src, '{A_RE}', 1), 1) - 1 AS place FROM v),
 a AS (SELECT page_id, url, place, trim({decode('href0')}) AS href, {plain('t0')} AS txt FROM a0)
"""
HINTS = P.LINK_HINTS.replace(r"\w", D.W)
HOST_OF = lambda s: f"lower(regexp_replace(regexp_extract({s}, '^[a-zA-Z]+://([^/?#]+)', 1), '^www\\.', ''))"
SCORED = ANCHORS + rf""",
 l0 AS (SELECT *, regexp_replace(href, '#.*$', '') AS h, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, regexp_extract(regexp_replace(url, '#.*$', ''), '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM a WHERE NOT regexp_matches(href, '^(#|mailto:|tel:|javascript:)')),
 l1 AS (SELECT *, regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') AS folder FROM l0),
 l2 AS (SELECT page_id, place, url, txt, CASE WHEN regexp_matches(h, '^[A-Za-z]+:') THEN h WHEN h = '' THEN regexp_replace(url, '#.*$', '') WHEN starts_with(h, '/') THEN origin || h
   WHEN starts_with(h, '../') THEN origin || regexp_replace(folder, '[^/]+/$', '') || replace(substr(h, 4), './', '') ELSE origin || folder || h END AS link FROM l1),
 l3 AS (SELECT *, concat(txt, ' ', link) AS w FROM l2 WHERE starts_with(link, 'http') AND ({HOST_OF('url')} = {HOST_OF('link')} OR ends_with({HOST_OF('url')}, '.' || {HOST_OF('link')}) OR ends_with({HOST_OF('link')}, '.' || {HOST_OF('url')}))),
 links AS (SELECT page_id, CAST(place AS INTEGER) AS place, link, CASE WHEN regexp_matches(link, '\.(pdf|docx?|xlsx?|zip|rar|jpg|png)(\?|$)', 'i') THEN CASE WHEN regexp_matches(w, '{HINTS}', 'i') THEN 2 ELSE 0 END
   ELSE CASE WHEN regexp_matches(w, '{HINTS}', 'i') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(w, '{P.DEGREE_HINTS}', 'i') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(w, '{P.PRICE_HINTS}', 'i') THEN 2 ELSE 0 END END AS score FROM l3),
 scored AS (SELECT * FROM links WHERE score > 0 UNION ALL SELECT page_id, 1000000 + s.n, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || s.p, 5 FROM v JOIN (VALUES ('example.org', 0, '/admission'), ('example.org', 1, '/')) AS s(h, n, p) ON contains({HOST_OF('url')}, s.h))
"""
SEEDS = {"example.org": ("/admission", "/")}


@query("h1_page_links", "WITH" + SCORED + "SELECT page_id, place, link, score FROM scored")
def _(t):
    return P.page_links(t.rich_page, seeds=SEEDS)


@query("w4_top_links", "WITH" + SCORED + """, b AS (SELECT page_id, link, MAX(score) AS score, MIN(place) AS place FROM scored GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, place) AS rank FROM b) SELECT page_id, link, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""")
def _(t):
    return P.top_links(P.page_links(t.rich_page, seeds=SEEDS), 3).select("page_id", "link", "score", "rank")


CLEANED = lambda s: f"regexp_replace({D.norm(s)}, '^(ОП|образовательная программа|программа)\\s*[:\\-]?\\s*', '', 'i')"
PCODE = lambda s: f"regexp_replace(NULLIF(regexp_extract({s}, '{P.PAGE_CODE}'), ''), '^6[Bb]', '6В')"
TABLES = f"""
 v AS (SELECT page_id, {SEEN} AS src FROM {{rich_page}}),
{elements('tb', 'v', 'page_id', 'src', 'table')},
 tb1 AS (SELECT page_id, n AS tab, body FROM tb), {elements('tr', 'tb1', 'page_id, tab', 'body', 'tr')},
 tr1 AS (SELECT page_id, tab, n AS row, body FROM tr WHERE n > 0), {elements('td', 'tr1', 'page_id, tab, row', 'body', 't[dh]')},
 ce AS (SELECT page_id, tab, row, list({plain('body')} ORDER BY n) AS cells FROM td GROUP BY 1, 2, 3),
 tx AS (SELECT *, array_to_string(cells, ' | ') AS txt, list_reduce(list_prepend('', list_filter(cells, lambda c: NOT regexp_matches(c, '^{P.PAGE_CODE}$') AND NOT regexp_matches(c, '^[\\d\\s]+$') AND length(c) >= 4)), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS nm FROM ce WHERE len(cells) > 0),
 tn AS (SELECT *, {PCODE('txt')} AS code, COALESCE(NULLIF(nm, ''), 'Программа ' || {PCODE('txt')}) AS name0 FROM tx),
 table_rows AS (SELECT page_id, CAST(tab AS INTEGER) AS tab, CAST(row AS INTEGER) AS row, {CLEANED('name0')} AS name, code, {D.money('txt')} AS cost, {D.years('txt')} AS duration, 'table' AS source_hint FROM tn
   WHERE length(name0) BETWEEN 4 AND 200 AND NOT regexp_matches(name0, '^(главная|меню|вход|login|cookie)', 'i'))
"""


@query("h2_table_programs", "WITH" + TABLES + "SELECT * FROM table_rows")
def _(t):
    return P.table_programs(t.rich_page)


BLOCKS = ",".join(elements(f"b_{tag}", "v", "page_id", "src", tag) for tag in P.BLOCK_TAGS)
BLOCK_ROWS = " UNION ALL ".join(f"SELECT page_id, {plain('body')} AS txt FROM b_{tag}" for tag in P.BLOCK_TAGS)
MONEY_ANY = rf"([\d\s{D.NB}]{{4,9}}){D.SP}*(?:(?:тг|тенге)($|{D.NW})|₸({D.W}))"


@query("h3_text_programs", f"""WITH
 v AS (SELECT page_id, {SEEN} AS src FROM {{rich_page}}),
{BLOCKS}, bl AS ({BLOCK_ROWS}),
 c AS (SELECT DISTINCT page_id, txt FROM (SELECT page_id, txt FROM bl WHERE length(txt) BETWEEN 8 AND 280 AND (regexp_matches(txt, '{P.PAGE_CODE}') OR regexp_matches(txt, 'бакалавр|образовательн', 'i'))
   UNION ALL SELECT page_id, UNNEST(list_filter({lines('src')}, lambda t: regexp_matches(t, '{P.PAGE_CODE}') AND length(t) BETWEEN 11 AND 259)) FROM v)),
 n AS (SELECT page_id, txt, regexp_replace(regexp_replace(regexp_replace(txt, '{P.PAGE_CODE}', '', 'g'), '{MONEY_ANY}', '\\2\\3', 'gi'), 'стоимость.*$', '', 'i') AS n0 FROM c),
 m AS (SELECT page_id, txt, {CLEANED('n0')} AS name FROM n)
SELECT page_id, txt, name, {PCODE('txt')} AS code, {D.money('txt')} AS cost, {D.years('txt')} AS duration, 'text' AS source_hint FROM m
WHERE length(name) >= 4 AND NOT regexp_matches(name, '^(меню|главная|cookie|подробнее|читать|скачать)', 'i')""")
def _(t):
    return P.text_programs(t.rich_page)


@query("w8_inherit_page_cost", "WITH" + TABLES + f""", pg AS (SELECT page_id, {plain('src')} AS pt FROM v),
 pc AS (SELECT page_id, CASE WHEN regexp_matches(pt, 'стоимост|tuition|платн', 'i') THEN {D.money('pt')} END AS page_cost FROM pg)
SELECT t.page_id, tab, row, name, COALESCE(cost, page_cost) AS cost, cost IS NULL AND page_cost IS NOT NULL AS cost_inherited FROM table_rows t JOIN pc USING (page_id)""")
def _(t):
    return P.inherit_page_cost(P.table_programs(t.rich_page), t.rich_page).select("page_id", "tab", "row", "name", "cost", "cost_inherited")


@query("h4_page_contacts", "WITH" + ANCHORS + f""",
 li AS (SELECT page_id, {lines('src')} AS ls, list_filter(list_transform({inner('src', 'p')}, lambda c: {plain('c')}), lambda s: length(s) > 80) AS ps FROM v),
 m AS (SELECT page_id, arg_max(href, place) FILTER (WHERE starts_with(href, 'mailto:')) AS mail, arg_max(href, place) FILTER (WHERE starts_with(href, 'tel:')) AS tel,
   arg_min(href, place) FILTER (WHERE starts_with(href, 'http') AND NOT regexp_matches(lower(href), 'listing\\.example|facebook|instagram|youtube|tiktok|telegram|vk\\.com|zero\\.kz|google\\.|goo\\.gl|bit\\.ly|t\\.me|wa\\.me|whatsapp|twitter|x\\.com|linkedin|play\\.google') AND regexp_matches(lower(href), '\\.edu|\\.kz|university|academy|college')) AS website FROM a GROUP BY 1)
SELECT li.page_id, regexp_replace(mail, '^mailto:|\\?.*$', '', 'g') AS email, COALESCE(substr(tel, 5), NULLIF(regexp_extract(array_to_string(ls, chr(10)), '\\+?7[\\s\\-\\(]?\\d{{3}}[\\s\\-\\)]?\\d{{3}}[\\s\\-]?\\d{{2}}[\\s\\-]?\\d{{2}}'), '')) AS phone, website,
 list_filter(ls, lambda s: regexp_matches(s, 'Алматы|пр\\.|ул\\.|шоссе|даңғылы|мкр', 'i') AND length(s) BETWEEN 11 AND 159 AND NOT contains(lower(s), 'cookie'))[1] AS address, ps[1] AS description1, ps[2] AS description2, ps[3] AS description3
FROM li LEFT JOIN m USING (page_id)""")
def _(t):
    return P.page_contacts(t.rich_page)


@query("h5_directory_entries", "WITH" + ANCHORS + """
SELECT page_id, regexp_extract(href, '^/([A-Za-z0-9\\-]+)/?$', 1) AS slug, arg_min(txt, place) AS name FROM a WHERE regexp_extract(href, '^/([A-Za-z0-9\\-]+)/?$', 1) <> '' AND length(txt) >= 3 GROUP BY 1, 2""")
def _(t):
    return P.directory_entries(t.rich_page, r"^/([A-Za-z0-9\-]+)/?$")


@query("w5_fill_headers", """
WITH h AS (SELECT page_id, pos, name, is_header, last_value(CASE WHEN is_header THEN header_name END IGNORE NULLS) OVER w AS global_specialty, last_value(CASE WHEN is_header THEN header_code END IGNORE NULLS) OVER w AS code FROM {card_row} WINDOW w AS (PARTITION BY page_id ORDER BY pos))
SELECT page_id, pos, name, global_specialty, code FROM h WHERE NOT is_header""")
def _(t):
    return P.fill_headers(t.card_row, width=500).select("page_id", "pos", "name", "global_specialty", "code")


# Pages with a table of groups and programmes; one cell holds a table, whose row with one cell heads what follows.
ROLES["group_page"] = """
SELECT page_id, replace(html, '</article>', concat('<table><thead><tr><th>x</th></tr></thead><tbody class="b college-specialty-table-body"><tr><td colspan="4"><a href="/g">Группа ', CAST(page_id % 50 AS STRING), '</a> (6В0', CAST(10 + page_id % 80 AS STRING), ')</td></tr>',
 '<tr><td><a>Право ', CAST(page_id AS STRING), '</a></td><td>очная</td><td>', CAST(300 + page_id % 500 AS STRING), ' 000 тг</td><td>', CAST(1 + page_id % 5 AS STRING), ' года</td></tr><tr><td>Без цены</td><td>-</td></tr>',
 CASE WHEN page_id % 3 = 0 THEN '<tr><td>Вместе<table><tbody><tr><td>Внутри</td></tr></tbody></table></td><td>1</td><td>2</td></tr>' ELSE '' END,
 CASE WHEN page_id % 2 = 0 THEN '<tr><td>Заочно (без кода)</td></tr>' ELSE '' END, '<tr><td>Экономика</td><td></td><td>цена</td><td>3</td></tr></tbody></table></article>')) AS html
FROM {pages}"""


@query("w5_header_tables", """
WITH g AS (SELECT page_id, concat('Группа ', page_id % 50) AS g, concat('6В0', 10 + page_id % 80) AS c, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 0 END AS k, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS h FROM pages WHERE contains(html, '</article>'))
SELECT page_id, 1 AS pos, g AS global_specialty, c AS code, concat('Право ', page_id) AS name, CAST(300 + page_id % 500 AS DOUBLE) * 1000 AS cost, CAST(1 + page_id % 5 AS INTEGER) AS duration FROM g
UNION ALL SELECT page_id, 2, g, c, 'Без цены', NULL, NULL FROM g
UNION ALL SELECT page_id, 3, g, c, 'Вместе Внутри', NULL, 2 FROM g WHERE k = 2
UNION ALL SELECT page_id, 3 + k + h, CASE WHEN h = 1 THEN 'Заочно' WHEN k = 2 THEN 'Внутри' ELSE g END, CASE WHEN h = 0 AND k = 0 THEN c END, 'Экономика', NULL, 3 FROM g""")
def _(t):
    return P.header_table_programs(t.group_page)


@query("h6_card_programs", """
SELECT p_partkey AS page_id, 1 AS pos, p_type AS global_specialty, CASE WHEN p_size % 3 <> 0 THEN '6В061' END AS code, p_name AS name,
 CASE WHEN p_size % 2 = 0 THEN CAST((60000 + p_partkey) AS DOUBLE) END AS cost, CASE WHEN p_size % 4 <> 1 THEN CAST(1 + p_size % 5 AS INTEGER) END AS duration FROM part
UNION ALL SELECT p_partkey, 2, p_type, CASE WHEN p_size % 3 <> 0 THEN '6В061' END, p_brand, NULL, NULL FROM part""")
def _(t):
    """Each programme of the parts table as a small card listing."""
    html = F.expr("""concat('<div class="institution-specialty-list"><div class="px-3"><div class="flex border-b p-2"><a href="/g">', p_type, '</a>', CASE WHEN p_size % 3 <> 0 THEN '<span class="ml-5">6В061</span>' ELSE '' END,
      '</div><div class="college-qualification"><a href="/q">', p_name, '</a>', CASE WHEN p_size % 2 = 0 THEN concat('<div class="flex flex-col">Стоимость ', CAST(60000 + p_partkey AS STRING), ' тг</div>') ELSE '' END,
      CASE WHEN p_size % 4 <> 1 THEN concat('<div class="flex flex-col">Срок ', CAST(1 + p_size % 5 AS STRING), ' года</div>') ELSE '' END, '</div><div class="college-qualification"><a>', p_brand, '</a></div></div></div>')""")
    return P.card_programs(t.part.select(F.col("p_partkey").alias("page_id"), html.alias("html")))


@query("h7_site_health", """
SELECT page_id, url, CASE WHEN page_id % 9 = 0 THEN 404 ELSE 200 END AS status, page_id % 9 <> 0 AND length(html) > 1500 AS ok, CAST(CASE WHEN page_id % 9 <> 0 AND length(html) > 1500 THEN length(html) ELSE 0 END AS INTEGER) AS size FROM pages""")
def _(t):
    return P.site_health(t.pages.withColumn("status", F.when(F.col("page_id") % 9 == 0, 404).otherwise(200)), least=1500)


@query("h7_health_totals", f"""
SELECT {HOST_OF('url')} AS host, COUNT(*) AS pages, COUNT(*) FILTER (WHERE length(html) > 500) AS ok_pages, CAST(SUM(CASE WHEN length(html) > 500 THEN length(html) ELSE 0 END) AS BIGINT) AS size FROM pages GROUP BY 1""")
def _(t):
    return P.health_totals(P.site_health(t.pages.withColumn("status", F.lit(200))))


# ---- W6, T5

ANSWERS = """SELECT user_id AS result_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, CASE WHEN event_id % 2 = 0 THEN concat('Вопрос ', CAST(event_id AS STRING)) END AS question, event_type AS answer FROM {events}"""


def compact_sql(source, staged):
    mark = "'- '" if staged else "CAST(pos + 1 AS STRING) || '. '"
    title = """(CASE stage WHEN 0 THEN 'Личностные качества' WHEN 1 THEN 'Предпочтения в работе' WHEN 2 THEN 'Интересы' WHEN 3 THEN 'Профильные предпочтения'
  ELSE 'Этап ' || CAST(stage + 1 AS STRING) END) || ':' || chr(10) || """ if staged else ""
    return f"""
WITH l AS (SELECT result_id, pos, pos // 20 AS stage, {mark} || CASE WHEN question IS NOT NULL THEN question || ' — ' ELSE '' END || trim(answer) AS line FROM ({source}))
SELECT result_id, CAST(stage AS INTEGER) AS stage, {title}string_agg(line, chr(10) ORDER BY pos) AS text FROM l GROUP BY result_id, stage"""


@query("w6_compact_answers", compact_sql(ANSWERS, True))
def _(t):
    return W.compact_answers(t.sql(ANSWERS), staged=True)


CONVERSATIONS = "SELECT result_id, pos, role AS question, answer FROM {answer}"


@query("w6_compact_conversations", compact_sql(CONVERSATIONS, False))
def _(t):
    return W.compact_answers(t.sql(CONVERSATIONS))


@query("t5_assemble_chunks", "SELECT conv_id AS id, turn // 3 AS part, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1, 2")
def _(t):
    return W.assemble_chunks(t.conversations.select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"), F.col("text").alias("txt")), width=3)


# ---- notifications: streams over the table files, and the batch form of T2

# As many institutions as parts, and a follower for each order.
NEW_EVENTS = "SELECT event_id, event_id % (SELECT COUNT(*) FROM {part}) AS institution_id, concat('Event ', CAST(event_id AS STRING)) AS event_name FROM {events}"
FOLLOWERS = "SELECT o_custkey AS user_id, o_orderkey % (SELECT COUNT(*) FROM {part}) AS institution_id FROM {orders}"


@query("t1_fan_out", f"SELECT e.event_id, f.user_id, 'Новое мероприятие ''' || e.event_name || '''' AS message FROM ({NEW_EVENTS}) e JOIN (SELECT DISTINCT * FROM ({FOLLOWERS})) f USING (institution_id)")
def _(t):
    events = N.read_table_stream(t.spark, t.folder, "events").selectExpr(
        "event_id", f"event_id % {t.part.count()} AS institution_id", "concat('Event ', CAST(event_id AS STRING)) AS event_name")
    return N.run_available(N.fan_out(events, t.sql(FOLLOWERS)))


STATUS = """SELECT user_id % 400 AS application_id, user_id, event_id % 50 AS event_id, 'День открытых дверей' AS event_name, concat('T', CAST(user_id % 400 AS STRING)) AS ticket_code, event_id AS n,
 CASE event_type WHEN 'view' THEN 'Pending' WHEN 'click' THEN 'Accepted' WHEN 'purchase' THEN 'Rejected' ELSE 'Accepted' END AS status FROM {events}"""


NOTICES = f"""
WITH p AS (SELECT *, COALESCE(lag(status) OVER (PARTITION BY application_id ORDER BY n), 'Pending') AS prev FROM ({STATUS}))
SELECT application_id, n, user_id, event_id, CASE status WHEN 'Accepted' THEN 'Ваша заявка на мероприятие ''' || event_name || ''' принята. Номер билета: ' || ticket_code ELSE 'Ваша заявка на мероприятие ''' || event_name || ''' отклонена.' END AS message
FROM p WHERE status <> prev AND status <> 'Pending'"""


@query("t2_status_notices", NOTICES)
def _(t):
    return N.status_notices(t.sql(STATUS), width=1000)


@query("t2_status_stream", NOTICES)
def _(t):
    """The same rows as a stream over the files of the table."""
    own = N.state_session(t.spark)
    changes = own.sql(STATUS.replace("{events}", "{rows}"), rows=N.read_table_stream(own, t.folder, "events"))
    return N.run_status_stream(changes)


MEMBERS = "SELECT DISTINCT o_custkey % 400 AS application_id, o_custkey AS user_id FROM {orders}"


@query("t2_team_notices", f"""
WITH s AS (SELECT application_id, event_id, event_name, n, CASE status WHEN 'Accepted' THEN 'approved' ELSE lower(status) END AS status FROM ({STATUS})),
 p AS (SELECT *, COALESCE(lag(status) OVER (PARTITION BY application_id ORDER BY n), 'pending') AS prev FROM s)
SELECT application_id, n, event_id, 'Ваша командная заявка на мероприятие ''' || event_name || CASE status WHEN 'approved' THEN ''' одобрена.' ELSE ''' отклонена.' END AS message, m.user_id
FROM p JOIN ({MEMBERS}) m USING (application_id) WHERE status <> prev AND status <> 'pending'""")
def _(t):
    changes = t.sql(STATUS).withColumn("status", F.when(F.col("status") == "Accepted", "approved").otherwise(F.lower("status")))
    return N.team_notices(changes, t.sql(MEMBERS), width=1000)


@query("t3_first_application", "SELECT DISTINCT o_orderkey % 1000 AS event_id, o_custkey % 100 AS user_id FROM orders")
def _(t):
    apps = N.read_table_stream(t.spark, t.folder, "orders").selectExpr(
        "o_orderkey % 1000 AS event_id", "o_custkey % 100 AS user_id", "CAST(o_orderdate AS TIMESTAMP) AS created_at")
    return N.run_available(N.first_application(apps, delay="4000 days").select("event_id", "user_id"))


@query("t4_activity_stream", "SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS bucket, COUNT(*) AS total FROM events GROUP BY 1")
def _(t):
    events = N.read_table_stream(t.spark, t.folder, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return N.run_upserts(N.activity_counts(events, "ts"), ["bucket"]).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
