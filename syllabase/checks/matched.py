"""Matching of sources, registry data, coordinates."""
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import text as X
from ..operators import matching as M
from ..operators import places as L
from . import duck as D
from .registry import query


# ---- J10 cascade

def cascade_sql(strict):
    aliases = M.ALIASES_STRICT if strict else M.ALIASES
    q = lambda s: s.replace("'", "''")
    trig = ", ".join(f"({i}, '{q(w)}')" for i, (h, ns) in enumerate(aliases) for w in dict.fromkeys((h, *ns)))
    need = ", ".join(f"({i}, '{q(w)}')" for i, (h, ns) in enumerate(aliases)
                     for w in dict.fromkeys(ns if strict else (*ns, h)) if strict or len(w) >= 5)
    stop = D.STRICT_STOP if strict else D.STOP
    city = D.city("location", third=strict)
    host = "lower(regexp_replace(regexp_extract(website, '^[a-zA-Z]+://([^/?#]+)', 1), '^www\\.', '', 'i'))"
    cols = f"trim(name) AS name, type, {city} AS city, {host} AS host, lower(trim(name)) AS low, {D.norm_name('name')} AS norm, {D.soft_name('name')} AS soft, {D.tokens5('name', stop)} AS tok, {D.college('name')} AS col"
    related = "(a.col = b.col AND (a.low = b.low OR list_has_any(a.tok, b.tok)))" if strict else \
        "(a.low = b.low OR (a.soft <> '' AND a.soft = b.soft) OR (a.col = b.col AND list_has_any(a.tok, b.tok)))"
    near = "(a.city = '' OR b.city = '' OR a.city = b.city)"
    tier2 = "" if strict else """UNION ALL SELECT a.id, 2, b.id FROM a JOIN b ON a.type = b.type AND (a.norm = b.norm OR (a.soft <> '' AND a.soft = b.soft))"""
    alone = "FALSE" if strict else "h.n = 1"
    guard = "b.type = 'university'" if strict else "a.type = b.type AND NOT (b.type = 'university' AND contains(b.low, 'колледж'))"
    return f"""
WITH a AS (SELECT incoming_id AS id, {cols} FROM {{incoming}}), b AS (SELECT institution_id AS id, {cols} FROM {{uni}}),
 hosted AS (SELECT a.id, b.id AS bid, {related} AS rel, COUNT(*) OVER (PARTITION BY a.id) AS n FROM a JOIN b ON a.type = b.type AND a.host = b.host AND a.host <> '' AND {near}),
 trig AS (SELECT * FROM (VALUES {trig}) AS v(i, w)), need AS (SELECT * FROM (VALUES {need}) AS v(i, w)),
 asked AS (SELECT DISTINCT a.id, a.type, a.city, need.w FROM a JOIN trig ON contains(a.low, trig.w) JOIN need ON need.i = trig.i),
 m AS (SELECT a.id, 1 AS tier, b.id AS hit FROM a JOIN b ON a.type = b.type AND a.name = b.name {tier2}
  UNION ALL SELECT id, 3, bid FROM hosted h WHERE {alone} OR rel
  UNION ALL SELECT a.id, 4, b.id FROM asked a JOIN b ON contains(b.low, a.w) AND {guard} AND {near}),
 r AS (SELECT id, tier, hit, row_number() OVER (PARTITION BY id ORDER BY tier, hit) AS rk FROM m)
SELECT a.id AS incoming_id, r.hit AS institution_id, r.tier,
 CASE WHEN r.id IS NULL THEN MIN(CASE WHEN r.id IS NULL THEN a.id END) OVER (PARTITION BY a.type, a.norm) END AS new_key
FROM a LEFT JOIN r ON a.id = r.id AND r.rk = 1"""


@query("j10_match_cascade", cascade_sql(False))
def _(t):
    return M.match_cascade(t.incoming, t.uni)


@query("j10_match_cascade_strict", cascade_sql(True))
def _(t):
    return M.match_cascade(t.incoming, t.uni, strict=True)


# ---- J11 fuzzy score

SIDE = f"{D.score_name('name')} AS n, {D.score_tokens(D.score_name('name'))} AS t, contains({D.score_name('location')}, 'алматы') AS c1, contains({D.score_name('location')}, 'астана') AS c2"


BEST_SQL = f"""
WITH a AS (SELECT institution_id AS id, {SIDE} FROM {{uni}}), b AS (SELECT incoming_id AS id, {SIDE} FROM {{incoming}}),
 p AS (SELECT a.id AS l, b.id AS r, CASE WHEN a.n = '' OR b.n = '' THEN 0 WHEN a.n = b.n THEN 20
   WHEN list_has_any(a.t, b.t) THEN 4 * len(list_intersect(a.t, b.t)) + CASE WHEN abs(len(a.t) - len(b.t)) <= 1 THEN 3 ELSE 0 END
   WHEN length(a.n) >= 5 AND (contains(b.n, a.n) OR contains(a.n, b.n)) THEN 6
   WHEN len(list_filter(a.t, lambda x: length(x) >= 4 AND contains(b.n, x))) > 0 OR len(list_filter(b.t, lambda x: length(x) >= 4 AND contains(a.n, x))) > 0 THEN 4 ELSE 0 END
   + CASE WHEN a.c1 AND b.c1 THEN 1 ELSE 0 END + CASE WHEN a.c2 AND b.c2 THEN 1 ELSE 0 END AS score FROM a CROSS JOIN b),
 k AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS rk FROM p)
SELECT l AS left_id, r AS right_id, CAST(score AS INTEGER) AS score FROM k WHERE rk = 1 AND score >= 4"""


@query("j11_best_match", BEST_SQL)
def _(t):
    left = t.uni.withColumnRenamed("institution_id", "left_id")
    right = t.incoming.withColumnRenamed("incoming_id", "right_id")
    return M.best_match(left, right, hot=40)


# ---- J12 keyword rules

SLUGS = {"u3": "aitu", "u4": "kaznui"}
WORDS = " ".join(f"WHEN contains(lower(name), '{w}') THEN '{s}'" for w, s in L.REGISTRY_WORDS)


@query("j12_registry_slug", f"SELECT institution_id, CASE WHEN institution_id % 50 = 3 THEN 'aitu' WHEN institution_id % 50 = 4 THEN 'kaznui' {WORDS} END AS slug FROM {{uni}}")
def _(t):
    own = F.concat(F.lit("u"), (F.col("institution_id") % 50).cast("string"))
    return t.uni.select("institution_id", L.registry_slug(F.col("name"), own, SLUGS).alias("slug"))


CITY_EN = ("CASE WHEN regexp_matches(lower(concat_ws(' ', location, address)), 'алматы|almaty') THEN 'Almaty' WHEN regexp_matches(lower(concat_ws(' ', location, address)), 'астана|astana|нур-султан|nur-sultan') THEN 'Astana' "
           "WHEN regexp_matches(lower(concat_ws(' ', location, address)), 'шымкент|shymkent') THEN 'Shymkent' ELSE COALESCE(NULLIF(trim(split_part(location, ',', 1)), ''), 'Kazakhstan') END")
LOW = "lower(translate({}, '«»\"', ''))".format(D.norm("name"))


def pins_sql():
    parts = [f"WHEN city = '{c}' AND contains(low, '{w}') THEN '{lat!r},{lng!r}'" for c, w, lat, lng in G.CITY_PINS]
    for w, lat, lng in G.KNOWN_PINS:
        guard = " AND city <> 'Astana'" if lat < 45 else " AND city <> 'Almaty'" if lat > 50 else ""
        parts.append(f"WHEN contains(low, '{w}'){guard} THEN '{lat!r},{lng!r}'")
    return "CASE " + " ".join(parts) + " END"


PINNED = f"(SELECT *, {pins_sql()} AS pin FROM (SELECT *, {LOW} AS low, {CITY_EN} AS city FROM {{uni}}))"


@query("j12_known_pin", f"SELECT institution_id, city, CAST(split_part(pin, ',', 1) AS DOUBLE) AS lat, CAST(split_part(pin, ',', 2) AS DOUBLE) AS lng FROM {PINNED}")
def _(t):
    city = X.city_label(F.col("location"), F.col("address"))
    pin = G.known_pin(F.col("name"), city)
    return t.uni.select("institution_id", city.alias("city"), pin["lat"].alias("lat"), pin["lng"].alias("lng"))


# ---- J13, J16, N9-N11, A13

REG = """SELECT DISTINCT v.slug AS registry_slug, concat('reg ', v.slug) AS address, CASE WHEN v.slug = 'enu' THEN NULL ELSE concat(v.slug, '@reg.kz') END AS email,
 CASE WHEN v.slug <> 'nu' THEN 51.5e0 END AS latitude, 0.0e0 AS longitude, concat('https://', v.slug, '.kz') AS website, v.slug = 'nu' AS dormitory, CASE WHEN v.slug = 'esil' THEN TRUE END AS grants
FROM (VALUES (0, 'enu'), (1, 'nu'), (2, 'aitu'), (3, 'esil'), (4, 'tau')) AS v(k, slug) JOIN {region} ON r_regionkey = v.k"""


@query("j13_enrich_registry", f"""
WITH r AS ({REG}), i AS (SELECT *, CASE {WORDS} END AS registry_slug FROM {{uni}})
SELECT i.institution_id, CASE WHEN COALESCE(i.address, '') = '' AND r.address <> '' THEN r.address ELSE i.address END AS address,
 CASE WHEN COALESCE(i.email, '') = '' AND r.email <> '' THEN r.email ELSE i.email END AS email,
 CASE WHEN r.latitude <> 0 THEN r.latitude ELSE i.latitude END AS latitude, i.longitude,
 COALESCE(r.website, CASE WHEN NOT contains(i.website, 'zero.kz') THEN i.website END) AS website, COALESCE(r.dormitory, i.dormitory) AS dormitory, COALESCE(r.grants, i.grants) AS grants
FROM i LEFT JOIN r USING (registry_slug)""")
def _(t):
    rows = t.uni.withColumn("registry_slug", L.registry_slug(F.col("name")))
    out = L.enrich_registry(rows, t.sql(REG))
    return out.select("institution_id", "address", "email", "latitude", "longitude", "website", "dormitory", "grants")


RESULTS = """SELECT event_id AS seq, event_id % 130 AS institution_id, event_type <> 'error' AS ok, CASE WHEN event_id % 9 <> 0 THEN 50.0e0 + (event_id % 40) / 100.0e0 END AS lat,
 71.0e0 + (event_id % 7) / 10.0e0 AS lng, CASE event_id % 3 WHEN 0 THEN 'nominatim' WHEN 1 THEN 'google' ELSE 'pin' END AS source FROM {events}"""
GOOD = f"(SELECT * FROM ({RESULTS}) WHERE ok AND lat IS NOT NULL)"


@query("j16_apply_results", f"""
WITH g AS (SELECT institution_id, arg_max(lat, seq) AS lat, arg_max(lng, seq) AS lng FROM {GOOD} GROUP BY 1)
SELECT i.institution_id, COALESCE(g.lat, i.latitude) AS latitude, COALESCE(g.lng, i.longitude) AS longitude, CASE WHEN g.lat IS NULL THEN 'kept' ELSE 'applied' END AS action
FROM {{uni}} i LEFT JOIN g USING (institution_id)""")
def _(t):
    return L.apply_results(t.uni, t.sql(RESULTS)).select("institution_id", "latitude", "longitude", "action")


@query("j16_apply_stats", f"""
SELECT COUNT(*) FILTER (WHERE g) AS applied, COUNT(*) FILTER (WHERE NOT g) AS skipped FROM
 (SELECT ok AND lat IS NOT NULL AND institution_id IN (SELECT institution_id FROM {{uni}}) AS g FROM ({RESULTS}))""")
def _(t):
    return L.apply_stats(t.uni, t.sql(RESULTS))


@query("a13_geocode_stats", f"""
SELECT source, COUNT(*) AS n, COUNT(DISTINCT concat(CAST(ROUND(lat, 5) AS STRING), '/', CAST(ROUND(lng, 5) AS STRING))) AS points FROM {GOOD} GROUP BY 1""")
def _(t):
    return L.geocode_stats(t.sql(RESULTS).filter("lat IS NOT NULL"))


MAP_TEXT = """CASE event_id % 6 WHEN 0 THEN concat('<a href="x!3d', CAST(40 + event_id % 20 AS STRING), '.25!4d71.5">')
 WHEN 1 THEN concat('https://maps/@10.5,20.5,17z and @51.', CAST(10 + event_id % 80 AS STRING), ',71.25,15z') WHEN 2 THEN concat('center=43.25%2C76.', CAST(10 + event_id % 80 AS STRING))
 WHEN 3 THEN concat('!3d1.5!4d2.5 @-12.5,99.5 center=50.5%2C', CAST(40 + event_id % 60 AS STRING), '.5') WHEN 4 THEN 'nothing' END"""


@query("n9_coords_from_text", """
WITH r AS (SELECT event_id, event_id % 6 AS k, 40 + event_id % 20 + 0.25e0 AS a0, CAST(concat('51.', CAST(10 + event_id % 80 AS STRING)) AS DOUBLE) AS a1, CAST(concat('76.', CAST(10 + event_id % 80 AS STRING)) AS DOUBLE) AS b2, 40 + event_id % 60 + 0.5e0 AS b3 FROM events)
SELECT event_id, CASE WHEN k = 0 AND a0 BETWEEN 40.5 AND 55.5 THEN a0 WHEN k = 1 THEN a1 WHEN k = 2 THEN 43.25e0 WHEN k = 3 AND b3 BETWEEN 46.5 AND 87.5 THEN 50.5e0 END AS lat,
 CASE WHEN k = 0 AND a0 BETWEEN 40.5 AND 55.5 THEN 71.5e0 WHEN k = 1 THEN 71.25e0 WHEN k = 2 THEN b2 WHEN k = 3 AND b3 BETWEEN 46.5 AND 87.5 THEN b3 END AS lng FROM r""")
def _(t):
    c = G.coords_from_text(F.expr(MAP_TEXT))
    return t.events.select("event_id", c["lat"].alias("lat"), c["lng"].alias("lng"))


CANDS = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Astana' WHEN 1 THEN 'Almaty' WHEN 2 THEN 'Shymkent' ELSE 'Aktau' END AS city,
 51.0e0 + (event_id % 5) / 10.0e0 AS lat0, 71.1e0 + (event_id % 7) / 10.0e0 AS lng0, 43.0e0 + (event_id % 6) / 10.0e0 AS lat1, 76.5e0 + (event_id % 8) / 10.0e0 AS lng1, event_type AS et FROM {events}"""


@query("n10_pick_candidate", f"""
WITH e AS ({CANDS}),
 c AS (SELECT event_id, city, 0 AS i, lat0 AS lat, lng0 AS lng, 'amenity' AS class, CASE WHEN et = 'view' THEN 'university' ELSE 'cafe' END AS type, 'Cafe' AS display FROM e
  UNION ALL SELECT event_id, city, 1, lat1, lng1, 'building', 'university', 'Main campus' FROM e UNION ALL SELECT event_id, city, 2, lat0, lng0 + 0.01e0, 'shop', 'book', 'Академия книг' FROM e
  UNION ALL SELECT event_id, city, 3, 10.0e0, 20.0e0, 'amenity', 'university', 'Far university' FROM e),
 s AS (SELECT *, 10 + CASE WHEN regexp_matches(lower(concat_ws(' ', type, class, display)), 'university|college|campus|school|университет|институт|академия') THEN 5 ELSE 0 END
   + CASE WHEN class = 'amenity' AND type = 'university' THEN 8 ELSE 0 END + CASE WHEN class = 'building' AND contains(type, 'university') THEN 4 ELSE 0 END AS score FROM c
   WHERE lat BETWEEN 40.5 AND 55.5 AND lng BETWEEN 46.5 AND 87.5 AND CASE city WHEN 'Astana' THEN lat BETWEEN 50.9 AND 51.35 AND lng BETWEEN 71.2 AND 71.7
    WHEN 'Almaty' THEN lat BETWEEN 43.05 AND 43.45 AND lng BETWEEN 76.55 AND 77.15 WHEN 'Shymkent' THEN lat BETWEEN 42.2 AND 42.5 AND lng BETWEEN 69.4 AND 69.8 ELSE TRUE END),
 k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, i) AS rk FROM s)
SELECT e.event_id, CAST(k.score AS INTEGER) AS score, k.lat, k.lng, k.display FROM e LEFT JOIN k ON e.event_id = k.event_id AND k.rk = 1""")
def _(t):
    hit = lambda lat, lng, cls, typ, name: F.struct(lat.alias("lat"), lng.alias("lng"), cls.alias("class"), typ.alias("type"), F.lit(name).alias("display"))
    c, one = F.col, F.lit
    cands = F.array(
        hit(c("lat0"), c("lng0"), one("amenity"), F.when(c("et") == "view", "university").otherwise("cafe"), "Cafe"),
        hit(c("lat1"), c("lng1"), one("building"), one("university"), "Main campus"),
        hit(c("lat0"), c("lng0") + 0.01, one("shop"), one("book"), "Академия книг"),
        hit(one(10.0), one(20.0), one("amenity"), one("university"), "Far university"))
    best = G.pick_candidate(cands, c("city"))
    return t.sql(CANDS).select("event_id", best["score"].alias("score"), best["lat"].alias("lat"), best["lng"].alias("lng"), best["display"].alias("display"))


@query("n10_first_typed", """
WITH c AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 4 = 0 THEN 2 ELSE 0 END AS k, 38.0e0 + event_id % 20 AS lat0, 40.5e0 + event_id % 50 AS lng0 FROM events),
 b AS (SELECT event_id, CASE k WHEN 0 THEN lat0 WHEN 1 THEN 43.5e0 ELSE 10.0e0 END AS lat, CASE k WHEN 0 THEN lng0 WHEN 1 THEN 76.5e0 ELSE 20.0e0 END AS lng, CASE k WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'third' END AS display FROM c WHERE event_id % 11 <> 0),
 g AS (SELECT * FROM b WHERE lat BETWEEN 40 AND 56 AND lng BETWEEN 46 AND 88)
SELECT c.event_id, lat, lng, display FROM c LEFT JOIN g USING (event_id)""")
def _(t):
    i, d = F.col("event_id"), lambda c: c.cast("double")
    hit = lambda lat, lng, cls, typ, name: F.struct(d(lat).alias("lat"), d(lng).alias("lng"), cls.alias("class"), typ.alias("type"), F.lit(name).alias("display"))
    cands = F.array(
        hit(38 + i % 20, F.lit(40.5) + i % 50, F.lit("amenity"), F.lit("cafe"), "first"),
        hit(F.lit(43.5), F.lit(76.5), F.lit(None).cast("string"), F.when(i % 3 == 0, "main_CAMPUS").otherwise("house"), "second"),
        hit(F.lit(10), F.lit(20), F.when(i % 4 == 0, "School").otherwise("shop"), F.lit(None).cast("string"), "third"))
    best = G.pick_first_typed(F.when(i % 11 == 0, F.slice(cands, 1, 0)).otherwise(cands))
    return t.events.select("event_id", best["lat"].alias("lat"), best["lng"].alias("lng"), best["display"].alias("display"))


API = f"(SELECT institution_id, arg_max(lat, seq) AS lat, arg_max(lng, seq) AS lng, 'api' AS source FROM {GOOD} WHERE source = 'google' GROUP BY 1)"


@query("n11_resolve_coords", f"""
WITH p AS (SELECT p.*, CAST(split_part(pin, ',', 1) AS DOUBLE) AS plat, CAST(split_part(pin, ',', 2) AS DOUBLE) AS plng, a.lat AS alat, a.lng AS alng,
   latitude <> 0 AND longitude <> 0 AND latitude BETWEEN 40.5 AND 55.5 AND longitude BETWEEN 46.5 AND 87.5 AND CASE city WHEN 'Astana' THEN latitude BETWEEN 50.9 AND 51.35 AND longitude BETWEEN 71.2 AND 71.7
    WHEN 'Almaty' THEN latitude BETWEEN 43.05 AND 43.45 AND longitude BETWEEN 76.55 AND 77.15 WHEN 'Shymkent' THEN latitude BETWEEN 42.2 AND 42.5 AND longitude BETWEEN 69.4 AND 69.8 ELSE TRUE END AS old
  FROM {PINNED} p LEFT JOIN {API} a USING (institution_id))
SELECT institution_id, CASE WHEN alat IS NOT NULL THEN alat WHEN pin IS NOT NULL THEN plat WHEN old THEN latitude END AS lat,
 CASE WHEN alat IS NOT NULL THEN alng WHEN pin IS NOT NULL THEN plng WHEN old THEN longitude END AS lng,
 CASE WHEN alat IS NOT NULL THEN 'api' WHEN pin IS NOT NULL THEN 'known_pin' WHEN old THEN 'existing' END AS source,
 alat IS NOT NULL OR pin IS NOT NULL OR COALESCE(old, FALSE) AS ok FROM p""")
def _(t):
    good = t.sql(RESULTS).filter("ok AND lat IS NOT NULL AND source = 'google'")
    api = good.groupBy("institution_id").agg(F.max_by("lat", "seq").alias("lat"), F.max_by("lng", "seq").alias("lng"), F.lit("api").alias("source"))
    return L.resolve_coords(t.uni, api)


NAMED = "translate({}, '«»\"', '')".format(D.norm("name"))


def queries_sql():
    alias = []
    for w, v in G.QUERY_ALIASES:
        value = f"'{v}'" if w != "turan" else f"CASE WHEN contains(lower(n), 'астана') THEN 'Turan-Astana University' ELSE '{v}' END"
        alias.insert(0, f"CASE WHEN contains(lower(n), '{w}') THEN {value} END")
    loc = "NULLIF(trim(split_part(location, ',', 1)), '')"
    ru = f"CASE city WHEN 'Almaty' THEN 'Алматы' WHEN 'Astana' THEN 'Астана' WHEN 'Shymkent' THEN 'Шымкент' ELSE COALESCE({loc}, 'Казахстан') END"
    addr = "trim(COALESCE(address, ''))"
    tail = [f"concat(n, ', ', {ru}, ', Казахстан')", "concat(n, ', ', city, ', Kazakhstan')", "concat(n, ' ', city)",
            f"CASE WHEN length({addr}) BETWEEN 9 AND 89 AND NOT starts_with(lower({addr}), lower(substr(n, 1, 20))) THEN concat({addr}, ', ', {ru}, ', Казахстан') END"]
    return ", ".join(alias + tail)


@query("x15_geocode_queries", f"""
WITH u AS (SELECT *, {NAMED} AS n, {CITY_EN} AS city FROM {{uni}}),
 q AS (SELECT institution_id, UNNEST([{queries_sql()}]) AS q, generate_subscripts([{queries_sql()}], 1) AS i FROM u),
 f AS (SELECT institution_id, q, MIN(i) AS i FROM q WHERE q IS NOT NULL GROUP BY 1, 2)
SELECT institution_id, string_agg(q, '|' ORDER BY i) AS queries FROM f GROUP BY 1""")
def _(t):
    qs = G.geocode_queries(F.col("name"), F.col("location"), F.col("address"))
    return t.uni.select("institution_id", F.array_join(qs, "|").alias("queries"))


def plain_city(names, default, head):
    """City of the two plain query builders, which don't know the Latin spelling of a former name."""
    key = D.city("concat_ws(' ', location, address)")
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in zip(("almaty", "astana", "shymkent"), names))
    return f"CASE {key} {cases} ELSE CASE WHEN COALESCE(location, '') <> '' THEN {head} ELSE '{default}' END END"


# Addresses of all lengths.
ADDRESSED = """(SELECT * REPLACE (CASE WHEN institution_id % 5 = 0 THEN repeat(concat('ул. ', COALESCE(address, 'x'), ' '), CAST(institution_id % 40 AS INTEGER)) ELSE address END AS address,
 CASE WHEN institution_id % 17 = 0 THEN ' ' ELSE name END AS name) FROM {uni})"""


@query("x15_queries_ru", f"""
WITH u AS (SELECT institution_id, trim(COALESCE(name, '')) AS n, trim(COALESCE(address, '')) AS a, {plain_city(('Алматы', 'Астана', 'Шымкент'), 'Казахстан', "trim(split_part(location, ',', 1))")} AS c FROM {ADDRESSED}),
 q AS (SELECT institution_id, UNNEST([CASE WHEN n <> '' THEN n || ', ' || c || ', Казахстан' END, CASE WHEN n <> '' THEN n || ' ' || c END,
   CASE WHEN a <> '' AND n <> '' AND length(a) < 120 THEN n || ', ' || a || ', Казахстан' END, CASE WHEN a <> '' AND length(a) < 80 THEN a || ', ' || c || ', Казахстан' END]) AS q, UNNEST([1, 2, 3, 4]) AS i FROM u),
 f AS (SELECT institution_id, q, MIN(i) AS i FROM q WHERE q IS NOT NULL GROUP BY 1, 2)
SELECT institution_id, COALESCE(queries, '') AS queries FROM u LEFT JOIN (SELECT institution_id, string_agg(q, '|' ORDER BY i) AS queries FROM f GROUP BY 1) USING (institution_id)""")
def _(t):
    return addressed(t).select("institution_id", F.array_join(G.geocode_queries_ru(F.col("name"), F.col("location"), F.col("address")), "|").alias("queries"))


@query("x15_query_line", f"""
WITH u AS (SELECT institution_id, name AS n, address AS a, {plain_city(('Almaty', 'Astana', 'Shymkent'), 'Kazakhstan', "split_part(location, ',', 1)")} AS c FROM {ADDRESSED})
SELECT institution_id, CASE WHEN length(a) > 120 THEN concat_ws(', ', CASE WHEN n NOT IN ('', '0') THEN n END, CASE WHEN c NOT IN ('', '0') THEN c END, 'Kazakhstan')
 ELSE concat_ws(', ', CASE WHEN length(trim(n)) > 1 THEN n END, CASE WHEN length(trim(a)) > 1 THEN a END, CASE WHEN length(trim(c)) > 1 THEN c END, 'Kazakhstan') END AS line FROM u""")
def _(t):
    return addressed(t).select("institution_id", G.geocode_query(F.col("name"), F.col("location"), F.col("address")).alias("line"))


def addressed(t):
    i, address = F.col("institution_id"), F.col("address")
    long = F.expr("repeat(concat('ул. ', COALESCE(address, 'x'), ' '), CAST(institution_id % 40 AS INT))")
    return t.uni.withColumn("address", F.when(i % 5 == 0, long).otherwise(address)).withColumn("name", F.when(i % 17 == 0, " ").otherwise(F.col("name")))


# ---- J17, J18

SUGGEST = """SELECT result_id, 0 AS pos, w.word AS name FROM {test_result} JOIN {title_word} AS w ON result_id % 35 = w.k
 UNION ALL SELECT result_id, 1, upper(p_name) FROM {test_result} JOIN {part} ON result_id % 200 = p_partkey
 UNION ALL SELECT result_id, 2, concat('прикладная Информационные/', CAST(result_id % 5 AS STRING)) FROM {test_result}
 UNION ALL SELECT result_id, 3, substr(w.word, 3, 12) FROM {test_result} JOIN {title_word} AS w ON (result_id + 7) % 35 = w.k"""


@query("j17_names_to_ids", f"""
WITH s AS (SELECT *, lower(trim(name)) AS ask FROM ({SUGGEST}) WHERE trim(name) <> ''),
 a AS (SELECT DISTINCT ask FROM s), k AS (SELECT lower(name) AS nm, MIN(specialization_id) AS id FROM {{title}} WHERE name <> '' GROUP BY 1),
 w AS (SELECT ask, UNNEST(string_split_regex(ask, '[\\s,\\-/]+')) AS w, generate_subscripts(string_split_regex(ask, '[\\s,\\-/]+'), 1) AS i FROM a),
 wr AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY length(w) DESC, i) AS rk FROM w),
 m AS (SELECT ask, 1 AS tier, id FROM a JOIN k ON ask = nm UNION ALL SELECT ask, 2, id FROM a JOIN k ON contains(nm, ask)
  UNION ALL SELECT ask, 2 + rk, id FROM wr JOIN k ON contains(nm, w) WHERE rk <= 2 AND length(w) >= 5),
 b AS (SELECT ask, id, row_number() OVER (PARTITION BY ask ORDER BY tier, id) AS rk FROM m)
SELECT s.result_id, b.id AS specialization_id, MIN(s.pos) AS pos FROM s JOIN b ON s.ask = b.ask AND b.rk = 1 GROUP BY 1, 2""")
def _(t):
    return M.names_to_ids(t.sql(SUGGEST), t.title)


@query("j18_names_related", f"""
WITH p AS (SELECT i.incoming_id, u.institution_id, i.name AS a, u.name AS b FROM {{incoming}} i JOIN {{uni}} u ON i.incoming_id % (SELECT COUNT(*) FROM {{uni}}) = u.institution_id)
SELECT incoming_id, institution_id, ({D.soft_name('a')} <> '' AND {D.soft_name('a')} = {D.soft_name('b')}) OR lower(a) = lower(b)
  OR (list_has_any({D.tokens5('a')}, {D.tokens5('b')}) AND {D.college('a')} = {D.college('b')}) AS related,
 lower(a) = lower(b) OR list_has_any({D.tokens5('a', D.STRICT_STOP)}, {D.tokens5('b', D.STRICT_STOP)}) AS related_strict FROM p""")
def _(t):
    p = t.incoming.select("incoming_id", F.col("name").alias("a")).join(
        t.uni.select("institution_id", F.col("name").alias("b")), F.col("incoming_id") % t.uni.count() == F.col("institution_id"))
    a, b = F.col("a"), F.col("b")
    return p.select("incoming_id", "institution_id", X.names_related(a, b).alias("related"), X.names_related(a, b, strict=True).alias("related_strict"))
