"""The driver's tables seen as catalogue tables.

Every view is one SQL text that Spark and DuckDB both run. ``{name}`` stands for
a base table or another view. The multilingual columns are made from the tables
by joining a short word list on a key modulo its length, so they grow with them.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Repeat counts of regular expressions such as ``{2}`` are no placeholders.
PLACE = r"\{([a-z]\w{2,})\}"
BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations").split()

TITLES = [
    "6В06101 Информационные системы", "6B06101 Ақпараттық жүйелер", "6B06101 Information Systems",
    "Ақпараттық жүйелер Информационные системы Information Systems",
    "12 Компьютерная инженерия 01.09.2020 - 31.08.2025 (первичная)", "– Маркетинг и реклама", "6В041",
    "В057 Транспортные услуги", "Транспортные услуги", "Уровень английского языка", "Финансы и учёт (4 года)",
    "ет Экономика", "Дизайн одежды (", "Cookie policy notice", "Войти в меню", "Право", "Журналистика и медиа",
    "Finance and Accounting", "IT-менеджмент и бизнес аналитика", "Ағылшын тілі деңгейін анықтау", "Мұғалімдер даярлау",
    "6В01101 Педагогика и психология", "6b01101 педагогика и психология", "Х", "", "В071 - Горное дело",
    "Архитектура зданий 5 лет", "Программная инженерия Software Engineering Development Track",
    "Экономика және менеджмент", "Social work", "Первичная   подготовка кадров", "6В07115 Геология и разведка месторождений",
    "әуе транспорты воздушный транспорт air transport technologies", "көлік қызметтері",
    "Международные отношения и мировая политика с углублённым изучением восточных языков, истории дипломатии, "
    "международного права, экономики и культуры стран Центральной Азии и Ближнего Востока",
]
INSTITUTIONS = [
    "Казахский национальный университет имени Аль-Фараби", "Назарбаев Университет", "Евразийский университет им. Гумилёва",
    "Astana IT University", "«Нархоз» университет", "Университет КИМЭП", "Туран-Астана университет", "SDU University",
    "Казахстанский институт менеджмента", "Академия гражданской авиации", "Esil University", "Университет Астаны и права",
    "Международный университет бизнеса", "Колледж экономики и финансов", "Q University", "Alma Management",
    "Университет Сатпаева технический", "Медицинский университет Караганды",
]
PLACES = ["Алматы, Казахстан", "г. Астана, ул. Кенесары 1", "Шымкент", "Караганда, Казахстан", "Нур-Султан", "Almaty city", "Nur-Sultan, Kazakhstan"]


def _values(words: list[str]) -> str:
    rows = ", ".join("({}, '{}')".format(i, w.replace("'", "''")) for i, w in enumerate(words))
    return f"SELECT * FROM (VALUES {rows}) AS v(k, word)"


ROLES: dict[str, str] = {
    "institution": """
SELECT s_suppkey AS institution_id, s_name AS name, n_name AS location, s_acctbal AS acctbal,
       CASE WHEN s_suppkey % 3 = 2 THEN 'college' ELSE 'university' END AS type,
       CASE s_suppkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected' WHEN 2 THEN NULL ELSE 'accepted' END AS verified,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE concat('https://www.host', CAST(s_suppkey % 40 AS STRING), '.example.org/ru') END AS website,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 40.0e0 + (s_suppkey % 160) / 10.0e0 END AS latitude,
       CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 46.0e0 + (s_suppkey % 420) / 10.0e0 END AS longitude
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "level1": "SELECT DISTINCT p_type AS global_id, p_type AS global_name FROM {part}",
    "qual": """
SELECT DISTINCT concat(p_type, '|', p_brand) AS qualification_id, p_brand AS qualification_name, p_type AS global_id FROM {part}""",
    "spec": """
SELECT p_partkey AS specialization_id, p_name AS name, concat(p_type, '|', p_brand) AS qualification_id,
       CASE WHEN p_size % 2 = 0 THEN 'university' ELSE 'college' END AS kind FROM {part}""",
    "link": """
SELECT l_suppkey AS institution_id, l_partkey AS specialization_id, MAX(l_extendedprice) AS cost,
       MAX(CASE WHEN CAST(l_quantity AS INT) % 9 = 0 THEN NULL ELSE CAST(l_quantity AS INT) % 9 END) AS duration,
       MIN(l_shipdate) AS created_at
FROM {lineitem} GROUP BY l_suppkey, l_partkey""",
    "app_user": """
SELECT c_custkey AS user_id, c_name AS username, c_mktsegment AS segment, 'secret' AS password,
       c_custkey % 10 = 0 AS is_banned,
       CASE WHEN c_custkey % 8 = 0 THEN CAST('2001-01-01' AS DATE) - CAST(c_custkey % 300 AS INT) END AS deleted_at
FROM {customer}""",
    "review": """
SELECT o_orderkey AS review_id, o_custkey AS user_id, o_orderkey % (SELECT COUNT(*) FROM {supplier}) AS institution_id,
       CAST(1 + o_orderkey % 5 AS INT) AS rating, o_orderdate AS created_at FROM {orders}""",
    "fav": """
SELECT DISTINCT o_custkey AS user_id, l_suppkey AS institution_id FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "calendar_event": """
SELECT event_id, event_id % (SELECT COUNT(*) FROM {supplier}) AS institution_id, ts AS event_date, concat('Event ', CAST(event_id AS STRING)) AS event_name,
       CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'closed' WHEN 'purchase' THEN 'group' ELSE 'open' END AS event_type
FROM {events}""",
    "application": """
SELECT o_orderkey AS application_id, o_custkey AS user_id, o_orderkey % (SELECT COUNT(*) FROM {events}) AS event_id,
       CASE o_orderstatus WHEN 'P' THEN 'Pending' WHEN 'F' THEN 'Accepted' ELSE 'Rejected' END AS status,
       o_orderdate AS created_at FROM {orders}""",
    "test_result": "SELECT event_id AS result_id, user_id, ts AS created_at FROM {events}",
    "answer": "SELECT conv_id AS result_id, turn AS pos, role, text AS answer FROM {conversations}",
    "title_word": _values(TITLES),
    "name_word": _values(INSTITUTIONS),
    "place_word": _values(PLACES),
    # One title per programme: a word-list title, with a track number on two of three.
    "title": f"""
SELECT p_partkey AS specialization_id,
       CASE WHEN p_partkey % 3 = 0 OR word = '' THEN word
            WHEN p_partkey % 3 = 1 THEN concat(word, ' ', p_name)
            ELSE concat(word, ' профиль ', CAST(p_partkey % 50 AS STRING)) END AS name,
       CASE WHEN p_partkey % 5 = 0 THEN concat('6B0', CAST(p_size AS STRING), '01 ', p_brand) ELSE p_brand END AS qualification,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS global_specialty,
       CASE WHEN p_partkey % 6 = 0 THEN concat('6b0', CAST(10 + p_partkey % 12 AS STRING), '01')
            WHEN p_partkey % 6 = 1 THEN concat('6В0', CAST(10 + p_partkey % 30 AS STRING)) END AS code
FROM {{part}} JOIN {{title_word}} ON p_partkey % {len(TITLES)} = k""",
    # Programme rows of the nested files, one per offer line.
    "program": """
SELECT g.institution_id, g.pos, t.name, t.code, t.global_specialty, t.qualification, g.cost, g.duration FROM
 (SELECT l_suppkey AS institution_id, l_partkey, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey % 1000000 AS pos,
   MAX(CASE WHEN CAST(l_quantity AS INT) % 4 = 0 THEN NULL WHEN CAST(l_quantity AS INT) % 11 = 0 THEN 0.0e0 ELSE l_extendedprice END) AS cost,
   MAX(CASE WHEN CAST(l_quantity AS INT) % 9 = 0 THEN NULL ELSE CAST(l_quantity AS INT) % 9 END) AS duration
  FROM {lineitem} GROUP BY l_suppkey, l_partkey, l_orderkey, l_linenumber) AS g JOIN {title} AS t ON g.l_partkey = t.specialization_id""",
    # Institutions with multilingual names; two rows in three share a base name with another row.
    "uni": f"""
SELECT s_suppkey AS institution_id,
       concat(n.word, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat(' ', CAST(CAST(FLOOR(s_suppkey / 60.0) AS BIGINT) AS STRING)) END) AS name,
       CASE WHEN n.word LIKE 'Колледж%' THEN 'college' ELSE 'university' END AS type, p.word AS location,
       CASE WHEN s_suppkey % 4 = 1 THEN concat('пр. Абая ', CAST(s_suppkey AS STRING)) WHEN s_suppkey % 4 = 2 THEN '' END AS address,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 13 = 0 THEN 'https://zero.kz/x'
            ELSE concat('https://www.Host', CAST(s_suppkey % 61 AS STRING), '.edu.kz/ru') END AS website,
       CASE WHEN s_suppkey % 3 = 0 THEN concat('info', CAST(s_suppkey AS STRING), '@mail.kz') ELSE '' END AS email,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 40.0e0 + (s_suppkey % 160) / 10.0e0 END AS latitude,
       CASE WHEN s_suppkey % 11 = 0 THEN 0.0e0 ELSE 46.0e0 + (s_suppkey % 420) / 10.0e0 END AS longitude,
       s_suppkey % 2 = 0 AS dormitory, s_suppkey % 5 = 0 AS grants
FROM {{supplier}} JOIN {{name_word}} AS n ON s_suppkey % {len(INSTITUTIONS)} = n.k
JOIN {{place_word}} AS p ON s_suppkey % {len(PLACES)} = p.k""",
    # The same institutions as another source spells them.
    "incoming": f"""
SELECT c_custkey AS incoming_id,
       CASE c_custkey % 7 WHEN 0 THEN n.word WHEN 1 THEN concat('«', upper(n.word), '»')
            WHEN 2 THEN replace(replace(n.word, 'университет', 'академия'), 'University', 'university')
            WHEN 3 THEN concat('Филиал ', CAST(c_custkey AS STRING)) WHEN 4 THEN concat('Кампус ', n.word, ' ', CAST(c_custkey AS STRING))
            WHEN 5 THEN concat(n.word, ' ', CAST(c_custkey % 9 AS STRING)) ELSE concat('Unknown ', CAST(c_custkey AS STRING)) END AS name,
       CASE WHEN n.word LIKE 'Колледж%' OR c_custkey % 31 = 0 THEN 'college' ELSE 'university' END AS type, p.word AS location,
       CASE WHEN c_custkey % 2 = 0 THEN concat('http://host', CAST(c_custkey % 97 AS STRING), '.edu.kz') END AS website
FROM {{customer}} JOIN {{name_word}} AS n ON c_custkey % {len(INSTITUTIONS)} = n.k
JOIN {{place_word}} AS p ON c_custkey % {len(PLACES)} = p.k""",
}


def deps(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(PLACE, sql)))


class Tables:
    """Base tables and role views of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._seen = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            if name in ROLES:
                self._seen[name] = self.sql(ROLES[name])
            else:
                self._seen[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._seen[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{d: getattr(self, d) for d in deps(text)})


def with_roles(sql: str) -> str:
    """DuckDB text for ``sql``: its role views become common table expressions."""
    order: list[str] = []

    def visit(text):
        for d in deps(text):
            if d in ROLES and d not in order:
                visit(ROLES[d])
                order.append(d)

    visit(sql)
    plain = lambda s: re.sub(PLACE, r"\1", s)
    views = [f"{n} AS ({plain(ROLES[n])})" for n in order]
    body = plain(sql).strip()
    if not views:
        return body
    head = re.match(r"WITH(\s+RECURSIVE)?\s", body)
    if head:
        return head.group(0).rstrip() + " " + ",\n".join(views) + ",\n" + body[head.end():]
    return "WITH " + ",\n".join(views) + "\n" + body
