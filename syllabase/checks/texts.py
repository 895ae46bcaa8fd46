"""Text, title, number and JSON functions over the multilingual role tables."""
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import titles as T
from ..functions import values as V
from ..operators import answers as W
from . import duck as D
from .registry import query

RAW_SQL = "(SELECT *, " + D.norm("name") + " AS raw FROM {title})"


def column(name, role, key, fn, sql):
    """One function over one role column; NULL input included."""

    @query(name, f"SELECT {key}, {sql} AS value FROM {role}")
    def _(t):
        source = "title" if role is RAW_SQL else role.strip("{}")
        df = getattr(t, source)
        if role is RAW_SQL:
            df = df.withColumn("raw", X.norm(F.col("name")))
        return df.select(key, fn().alias("value"))


sid, iid = "specialization_id", "institution_id"
column("x1_norm", "{title}", sid, lambda: X.norm(F.col("name")), D.norm("name"))
column("x2_norm_name", "{uni}", iid, lambda: X.norm_name(F.col("name")), D.norm_name("name"))
column("x3_soft_name", "{incoming}", "incoming_id", lambda: X.soft_name(F.col("name")), D.soft_name("name"))
column("x4_fingerprint", "{title}", sid, lambda: X.fingerprint(F.col("name")), D.fingerprint("name"))
column("x5_detect_lang", "{title}", sid, lambda: X.detect_lang(F.col("name")), D.lang("name"))
column("x6_is_mash", RAW_SQL, sid, lambda: X.is_mash(F.col("raw"), 45), D.mash("raw", 45))
column("x6_is_mash_file", RAW_SQL, sid, lambda: X.is_mash(F.col("raw"), 48, any_case=False), D.mash("raw", 48, False))
column("x7_extract_russian", RAW_SQL, sid, lambda: T.extract_russian(F.col("raw")), D.russian("raw"))
column("x7_extract_russian_file", RAW_SQL, sid, lambda: T.extract_russian(F.col("raw"), T.FILE_RULES), D.russian("raw", True))
column("x8_strip_noise", RAW_SQL, sid, lambda: T.strip_noise(F.col("raw")), D.strip_noise("raw"))
column("x8_strip_noise_file", RAW_SQL, sid, lambda: T.strip_noise(F.col("raw"), T.FILE_RULES), D.strip_noise("raw", True))
column("x9_is_junk", RAW_SQL, sid, lambda: T.is_junk(F.col("raw")), D.junk("raw"))
column("x9_is_junk_file", RAW_SQL, sid, lambda: T.is_junk(F.col("raw"), T.FILE_RULES), D.junk("raw", True))
column("x10_is_fragment", RAW_SQL, sid, lambda: T.is_fragment(F.col("raw")), D.fragment("raw"))
column("x11_extract_code", "{title}", sid, lambda: X.extract_code(F.col("name")), D.code("name"))
column("x11_normalize_code", "{title}", sid, lambda: X.normalize_code(F.col("code")),
       r"NULLIF(regexp_replace(regexp_replace(trim(code), '^6[Bb]', '6В'), '\s+', '', 'g'), '')")
column("x12_website_host", "{uni}", iid, lambda: X.website_host(F.col("website")), D.host("website"))
column("x12_page_host", "pages", "page_id", lambda: X.website_host(F.col("url")), D.host("url"))
column("x13_city_key", "{uni}", iid, lambda: X.city_key(F.col("location"), F.col("address")), D.city("concat_ws(' ', location, address)", latin=True))
column("x14_name_tokens", "{uni}", iid, lambda: F.array_join(F.array_sort(X.related_tokens(F.col("name"))), " "), f"array_to_string(list_sort({D.tokens5('name')}), ' ')")
column("x14_score_tokens", "{uni}", iid, lambda: F.array_join(F.array_sort(X.score_tokens(X.score_name(F.col("name")))), " "),
       f"array_to_string(list_sort({D.score_tokens(D.score_name('name'))}), ' ')")
column("x18_group_key", "{title}", sid, lambda: T.file_group_key(X.extract_code(F.col("code")), F.col("name")),
       f"CASE WHEN regexp_matches({D.code('code')}, '^6В\\d{{5,}}$') THEN concat('full:', {D.code('code')}) "
       f"WHEN regexp_matches({D.code('code')}, '^6В\\d{{2,4}}$') THEN concat('grp:', {D.code('code')}, ':', {D.fingerprint('name')}) "
       f"ELSE concat('n:', {D.fingerprint('name')}) END")
column("x19_clean_program_name", "{spec}", sid, lambda: X.clean_program_name(F.concat(F.element_at(F.array(F.lit("ОП: "), F.lit("Программа - "), F.lit("")), (F.col(sid) % 3 + 1).cast("int")), F.col("name"))),
       "name")
column("x20_absolute_url", "{uni}", iid, lambda: X.absolute_url(F.coalesce(F.col("website"), F.nullif(F.col("address"), F.lit(""))), "https://cdn.example.org/storage/"),
       "CASE WHEN COALESCE(website, NULLIF(address, '')) IS NULL THEN NULL WHEN website IS NOT NULL THEN website ELSE concat('https://cdn.example.org/storage/', address) END")
column("x21_clip", "documents", "doc_id", lambda: F.concat(X.clip(F.col("text"), 240), F.lit("|"), X.clip(F.col("text"), 100, "...")),
       "concat(substr(text, 1, 240), '|', CASE WHEN length(text) > 100 THEN concat(rtrim(substr(text, 1, 100)), '...') ELSE text END)")
column("x22_message", "{calendar_event}", "event_id", lambda: X.message("Новое мероприятие '%s' от института %d", F.col("event_name"), F.col("institution_id")),
       "concat('Новое мероприятие ''', event_name, ''' от института ', CAST(institution_id AS STRING))")

FLAGS = [
    ("empty_or_too_short", "length(raw) < 3"), ("code_only", D.hit("raw", f"^{D.CODE}$")),
    ("has_accreditation_date", D.hit("raw", r"\d{2}\.\d{2}\.\d{4}")), ("has_accreditation_label", "contains(lower(raw), 'первичн')"),
    ("leading_index", D.hit("raw", r"^\d{1,2}\s+")), ("leading_code_in_name", D.hit("raw", rf"^{D.CODE}\s+")),
    ("group_code_label", D.hit("lower(raw)", rf"^в\d{{2,3}}($|{D.NW})")), ("english_test_junk", "contains(lower(raw), 'ағылшын тілі деңгейін')"),
    ("kazakh_only", f"({D.lang('raw')}) = 'kk'"), ("english_only", f"({D.lang('raw')}) = 'en'"), ("mixed_script", f"({D.lang('raw')}) = 'mix'"),
    ("multilang_mash", D.mash("raw", 50, False)), ("possible_fragment", D.hit("raw", r"^[а-яё]{1,3}\s+[А-ЯЁ]") + " AND length(raw) < 40"),
    ("broken_trailing", D.hit("raw", "[(«]$")), ("ui_junk", D.hit("lower(raw)", "cookie|javascript|privacy|войти|login|меню|главная")),
    ("too_long", "length(raw) > 160"), ("too_few_letters", D.count("raw", D.LETTERS) + " < 8"),
]
FLAGS_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{f}' END" for f, c in FLAGS) + ")"
column("x16_quality_flags", RAW_SQL, sid, lambda: F.array_join(T.quality_flags(F.col("raw")), ","), FLAGS_SQL)


@query("x17_title_score", "WITH" + D.analysis("{title}", "name", "qualification")
       + ' SELECT specialization_id, title_code, clean, lang, score, "drop" AS dropped, hint FROM analysed')
def _(t):
    out = T.analyze_titles(t.title, T.LINK_RULES)
    return out.select(sid, "title_code", "clean", "lang", "score", F.col("drop").alias("dropped"), "hint")


@query("x17_title_score_file", "WITH" + D.analysis("{title}", "name", "qualification", "code", hard=True)
       + ' SELECT specialization_id, title_code, CASE WHEN NOT "drop" THEN clean END AS clean, CASE WHEN NOT "drop" THEN score END AS score, "drop" AS dropped FROM analysed')
def _(t):
    out = T.analyze_titles(t.title, T.FILE_RULES, code="code")
    kept = lambda c: F.when(~F.col("drop"), F.col(c)).alias(c)
    return out.select(sid, "title_code", kept("clean"), kept("score"), F.col("drop").alias("dropped"))


# ---- numbers: price and term texts made from offer lines

PRICE_TEXT = """CASE l_partkey % 6
  WHEN 0 THEN concat('Стоимость обучения: ', CAST(CAST(FLOOR(l_extendedprice) AS BIGINT) * 10 AS STRING), ' тг')
  WHEN 1 THEN concat(CAST(l_orderkey % 900 AS STRING), ' 000 ₸')
  WHEN 2 THEN concat('tuition fee ', CAST(CAST(FLOOR(l_extendedprice) AS BIGINT) AS STRING), ' KZT')
  WHEN 3 THEN concat('цена ', CAST(l_suppkey AS STRING))
  WHEN 4 THEN concat('1 ', CAST(100 + l_orderkey % 800 AS STRING), ' 000 тенге, ', CAST(CAST(l_quantity AS INT) % 12 AS STRING), ' года')
  ELSE concat('Срок обучения ', CAST(CAST(l_quantity AS INT) % 12 AS STRING), ' лет') END"""
PRICED = f"(SELECT DISTINCT l_orderkey, l_partkey, {PRICE_TEXT} AS txt FROM lineitem)"


def priced(t):
    return t.lineitem.select("l_orderkey", "l_partkey", F.expr(PRICE_TEXT).alias("txt")).distinct()


@query("n1_parse_money", f"SELECT l_orderkey, l_partkey, txt, {D.money('txt')} AS value FROM {PRICED}")
def _(t):
    return priced(t).withColumn("value", V.parse_money(F.col("txt")))


@query("n1_parse_money_cell", rf"""
SELECT l_orderkey, l_partkey, txt, CASE WHEN v >= 50000 THEN CAST(v AS DOUBLE) END AS value FROM (SELECT *, TRY_CAST(regexp_replace(regexp_extract(txt, '([\d\s{D.NB}]{{3,}})', 1), '{D.SP}', '', 'g') AS BIGINT) AS v FROM {PRICED})""")
def _(t):
    return priced(t).withColumn("value", V.parse_money_cell(F.col("txt")))


@query("n2_parse_years", f"SELECT l_orderkey, l_partkey, txt, {D.years('txt')} AS value FROM {PRICED}")
def _(t):
    return priced(t).withColumn("value", V.parse_years(F.col("txt")))


@query("n2_parse_years_cell", rf"""
SELECT DISTINCT l_orderkey, l_quantity, CASE WHEN l_quantity <= 8 THEN CAST(l_quantity AS INTEGER) WHEN CAST(l_quantity AS INTEGER) % 2 = 0 THEN CAST(l_quantity AS INTEGER) END AS value FROM lineitem""")
def _(t):
    n = F.col("l_quantity").cast("int")
    cell = F.when((n % 2 == 0) & (n > 8), F.concat(F.lit("срок "), n.cast("string"), F.lit(" года"))).otherwise(n.cast("string"))
    return t.lineitem.select("l_orderkey", "l_quantity", V.parse_years_cell(cell).alias("value")).distinct()


COST_TEXT = """CASE l_partkey % 5 WHEN 0 THEN concat(CAST(l_orderkey % 900 AS STRING), ' 000 ₸') WHEN 1 THEN concat(CAST(l_orderkey AS STRING), ',5 тг')
  WHEN 2 THEN 'по запросу' WHEN 3 THEN concat('-', CAST(l_orderkey AS STRING)) END"""


@query("n3_normalize_cost", f"""
SELECT DISTINCT l_orderkey, l_partkey, CASE l_partkey % 5 WHEN 0 THEN NULLIF(CAST(l_orderkey % 900 * 1000 AS DOUBLE), 0) WHEN 1 THEN CAST(l_orderkey AS DOUBLE) + 0.5 END AS value FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_partkey", V.normalize_cost(F.expr(COST_TEXT)).alias("value")).distinct()


@query("n4_normalize_duration", """
SELECT DISTINCT l_orderkey, l_quantity, CASE WHEN l_quantity BETWEEN 1 AND 10 THEN CAST(l_quantity AS INTEGER) END AS duration,
 CASE WHEN l_quantity BETWEEN 1 AND 8 THEN CAST(l_quantity AS INTEGER) END AS file_duration FROM lineitem""")
def _(t):
    n = F.concat(F.lit("около "), F.col("l_quantity").cast("int").cast("string"), F.lit(" лет"))
    return t.lineitem.select("l_orderkey", "l_quantity", V.normalize_duration(n).alias("duration"),
                             V.normalize_duration(F.col("l_quantity"), 8).alias("file_duration")).distinct()


@query("n5_date_labels", """
SELECT review_id, strftime(created_at, '%d %b') AS day, strftime(created_at, '%G%V') AS week, strftime(created_at, '%b') AS month, strftime(created_at, '%d.%m.%Y %H:%M') AS minute FROM {review}""")
def _(t):
    ts = F.col("created_at")
    return t.review.select("review_id", V.date_label(ts, "days").alias("day"), V.date_label(ts, "weeks").alias("week"),
                           V.date_label(ts, "months").alias("month"), V.date_label(ts, "minute").alias("minute"))


@query("n6_calendar_feed", "SELECT event_name AS title, strftime(event_date, '%Y-%m-%d') AS start, event_type AS description FROM {calendar_event}")
def _(t):
    return t.calendar_event.select(F.col("event_name").alias("title"), F.date_format("event_date", "yyyy-MM-dd").alias("start"), F.col("event_type").alias("description"))


SCHEMA_JSON = ('[{"name":"k","label":"K","type":"number","required":true},{"name":"mail","label":"M","type":"email","required":true},'
               '{"name":"phone","type":"phone","required":false},{"name":"note","required":false}]')
MAIL = "CASE event_id % 4 WHEN 0 THEN concat('u', CAST(user_id AS STRING), '@mail.kz') WHEN 1 THEN 'nobody' WHEN 2 THEN '' END"
PHONE = "CASE event_id % 3 WHEN 0 THEN '+7 (701) 123-45-67' WHEN 1 THEN 'call me' END"
KEY = "CASE WHEN event_id % 7 = 0 THEN 'many' ELSE CAST(user_id AS STRING) END"


@query("n7_validate_payload", f"""
SELECT event_id, concat_ws(',', CASE WHEN event_id % 7 = 0 THEN 'k:number' END,
  CASE WHEN event_id % 4 = 1 THEN 'mail:email' WHEN event_id % 4 IN (2, 3) THEN 'mail:required' END,
  CASE WHEN event_id % 3 = 1 THEN 'phone:phone' END) AS errors FROM events""")
def _(t):
    payload = F.to_json(F.struct(F.expr(KEY).alias("k"), F.expr(MAIL).alias("mail"), F.expr(PHONE).alias("phone")))
    form = F.lit(SCHEMA_JSON)
    stored = F.when(F.col("event_id") % 2 == 0, form).otherwise(F.concat(F.lit('"'), F.replace(form, F.lit('"'), F.lit('\\"')), F.lit('"')))
    sent = t.events.select("event_id", stored.alias("form"), payload.alias("payload"))
    return W.validate_payloads(sent, "form", "payload", "broken").select("event_id", F.array_join("broken", ",").alias("errors"))


@query("n8_parse_model_output", """
WITH w AS (SELECT conv_id, turn, trim(regexp_replace(text, '["\\\\{}\\[\\]\\s]+', ' ', 'g')) AS s FROM conversations)
SELECT conv_id, turn, CASE turn % 5 WHEN 4 THEN NULL WHEN 2 THEN NULLIF(concat_ws(chr(10) || chr(10), NULLIF(s, ''), 'второй'), '') ELSE NULLIF(s, '') END AS summary,
 CASE turn % 5 WHEN 0 THEN 'Право|Дизайн' WHEN 1 THEN 'Физика' WHEN 3 THEN 'Химия' ELSE '' END AS names FROM w""")
def _(t):
    s = F.trim(F.regexp_replace("text", r'["\\{}\[\]\s]+', " "))
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    inner = F.concat(F.lit('{\\"summary\\":\\"'), s, F.lit('\\",\\"specialties\\":[\\"Химия\\"]}'))
    out = (
        F.when(F.col("turn") % 5 == 0, F.concat(F.lit('Вот ответ: {"summary":'), q(s), F.lit(',"specialties":[" Право ","Дизайн",""]} удачи')))
        .when(F.col("turn") % 5 == 1, F.concat(F.lit('{"разбор":'), q(s), F.lit(',"специальности":["Физика"]}')))
        .when(F.col("turn") % 5 == 2, F.concat(F.lit('{"summary":{"a":'), q(s), F.lit(',"b":["второй"]}}')))
        .when(F.col("turn") % 5 == 3, F.concat(F.lit('{"summary":"'), inner, F.lit('"}')))
        .otherwise(F.concat(F.lit("{broken "), s))
    )
    summary, names = V.parse_model_output(out)
    return t.conversations.select("conv_id", "turn", summary.alias("summary"), F.array_join(names, "|").alias("names"))


@query("n12_directions", """
SELECT specialization_id, array_to_string(list_filter(list_transform(string_split(name, ','), lambda s: trim(s)), lambda s: s <> ''), ', ') AS joined,
 CAST(len(list_filter(list_transform(string_split(name, ','), lambda s: trim(s)), lambda s: s <> '')) AS INTEGER) AS n FROM {title}""")
def _(t):
    parts = V.split_list(F.col("name"))
    return t.title.select(sid, V.join_list(parts).alias("joined"), F.size(parts).alias("n"))


@query("n13_ticket_code", """
SELECT application_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) AS ticket_code
FROM (SELECT application_id, md5(concat_ws('|', CAST(event_id AS STRING), CAST(user_id AS STRING), CAST(application_id AS STRING))) AS h FROM {application})""")
def _(t):
    return t.application.select("application_id", V.stable_ticket(F.col("event_id"), F.col("user_id"), F.col("application_id")).alias("ticket_code"))


ABOUT = {"Право": ("Юристы: {name}", "Суды и право")}
KEYWORDS = [("финанс|financ", ("{name}: банки", "Учёт")), ("инженер|engineer", ("{name}: заводы", "Техника")), ("ring|bolt", ("{name}: детали", "Металл"))]
OTHER = ("Подготовка по специальности «{name}»", "Практика")


@query("j12_describe_titles", """
SELECT specialization_id, CASE WHEN name = 'Право' THEN 'Юристы: Право' WHEN regexp_matches(lower(name), 'финанс|financ') THEN name || ': банки' WHEN regexp_matches(lower(name), 'инженер|engineer') THEN name || ': заводы'
 WHEN regexp_matches(lower(name), 'ring|bolt') THEN name || ': детали' ELSE 'Подготовка по специальности «' || name || '»' END AS about1,
 CASE WHEN name = 'Право' THEN 'Суды и право' WHEN regexp_matches(lower(name), 'финанс|financ') THEN 'Учёт' WHEN regexp_matches(lower(name), 'инженер|engineer') THEN 'Техника'
 WHEN regexp_matches(lower(name), 'ring|bolt') THEN 'Металл' ELSE 'Практика' END AS about2 FROM {title}""")
def _(t):
    about1, about2 = T.describe(F.col("name"), ABOUT, KEYWORDS, OTHER)
    return t.title.select(sid, about1.alias("about1"), about2.alias("about2"))
