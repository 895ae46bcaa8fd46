"""Upserts, duplicate merge, purge, repair, status changes."""
from pyspark.sql import functions as F

from ..operators import maintain as M
from . import duck as D
from .registry import query
from .roles import ROLES

# An existing tree that covers part of what the titles ask for, under several spellings.
ROLES.update({
    "tree1": """SELECT p_type AS global_name, MIN(p_partkey) AS global_id, CASE WHEN p_type LIKE 'E%' THEN 'Код: 6В01001' END AS description
 FROM {part} WHERE p_type NOT LIKE 'S%' GROUP BY p_type""",
    "tree2": """SELECT t.specialization_id AS qualification_id, g.global_id,
 CASE t.specialization_id % 4 WHEN 0 THEN concat('6В', substr(t.code, 3)) WHEN 2 THEN concat('6В', substr(t.code, 3), ' старое имя') ELSE concat('группа ', CAST(t.specialization_id AS STRING)) END AS qualification_name,
 CASE WHEN t.specialization_id % 3 = 0 THEN concat('6В', substr(t.code, 3)) END AS description
 FROM {title} AS t JOIN {tree1} AS g ON t.global_specialty = g.global_name JOIN {part} ON p_partkey = t.specialization_id WHERE t.code IS NOT NULL AND p_size < 18""",
    "tree3": """SELECT 1000000 + qualification_id AS specialization_id, qualification_id, CASE WHEN qualification_id % 2 = 0 THEN 'Финансы и учёт (4 года)' ELSE 'Social work' END AS name FROM {tree2}""",
    "offer": "SELECT specialization_id AS ord, name, global_specialty, code FROM {title}",
})

PLACED = f"""
WITH p0 AS (SELECT ord, trim(regexp_replace(COALESCE(name, ''), '{D.SP}+', ' ', 'g')) AS nm, COALESCE(global_specialty, 'Образовательные программы') AS g,
   CASE WHEN code IS NOT NULL THEN concat('6В', substr(code, 3)) END AS code FROM {{offer}}),
 p AS (SELECT ord, nm, g, code, CASE WHEN code IS NULL THEN g ELSE concat(code, ' · ', g) END AS qn FROM p0 WHERE length(nm) >= 2),
 k2 AS (SELECT g.global_name, q.* FROM {{tree2}} q JOIN {{tree1}} g USING (global_id)),
 r AS (SELECT p.*, (SELECT MIN(qualification_id) FROM k2 WHERE k2.global_name = p.g AND p.code IS NOT NULL AND (qualification_name = qn OR qualification_name = p.code OR description = p.code OR starts_with(qualification_name, p.code || ' '))) AS byc,
   (SELECT MIN(qualification_id) FROM k2 WHERE k2.global_name = p.g AND qualification_name = qn) AS byn FROM p),
 r2 AS (SELECT *, COALESCE(byc, byn) AS kq FROM r),
 lastq AS (SELECT kq, arg_max(code, ord) AS code, arg_max(qn, ord) AS qn FROM r2 WHERE kq IS NOT NULL AND code IS NOT NULL GROUP BY 1)
"""


def tree(t):
    return M.upsert_tree(t.offer, t.tree1, t.tree2, t.tree3)


@query("m1_tree_level1", PLACED + """
, w AS (SELECT g, arg_max(code, ord) FILTER (WHERE code IS NOT NULL) AS code FROM p GROUP BY 1)
SELECT COALESCE(t.global_name, w.g) AS global_name, CASE WHEN t.global_name IS NULL OR (w.code IS NOT NULL AND NOT contains(COALESCE(t.description, ''), w.code)) THEN 'Код: ' || w.code ELSE t.description END AS description,
 CASE WHEN t.global_name IS NULL THEN 'created' WHEN w.code IS NOT NULL AND NOT contains(COALESCE(t.description, ''), w.code) THEN 'updated' ELSE 'kept' END AS action
FROM {tree1} t FULL JOIN w ON t.global_name = w.g""")
def _(t):
    return tree(t)["level1"].select("global_name", "description", "action")


@query("m1_tree_level2", PLACED + """
SELECT k.global_name, CASE WHEN l.code IS NOT NULL AND k.description IS DISTINCT FROM l.code THEN l.qn ELSE k.qualification_name END AS qualification_name,
 CASE WHEN l.code IS NOT NULL AND k.description IS DISTINCT FROM l.code THEN l.code ELSE k.description END AS description,
 CASE WHEN l.code IS NOT NULL AND k.description IS DISTINCT FROM l.code THEN 'updated' ELSE 'kept' END AS action
FROM k2 k LEFT JOIN lastq l ON k.qualification_id = l.kq
UNION ALL SELECT DISTINCT g, qn, code, 'created' FROM r2 WHERE kq IS NULL""")
def _(t):
    out = tree(t)
    return out["level2"].join(out["level1"].select("global_id", "global_name"), "global_id").select("global_name", "qualification_name", "description", "action")


@query("m1_tree_level3", PLACED + """
, q3 AS (SELECT DISTINCT nm, g, CASE WHEN kq IS NULL THEN qn ELSE CAST(kq AS STRING) END AS qk, kq FROM r2)
SELECT q3.nm AS name, CASE WHEN t.qualification_id IS NULL THEN 'created' ELSE 'kept' END AS action, q3.g AS global_name FROM q3
 LEFT JOIN {tree3} t ON t.qualification_id = q3.kq AND t.name = q3.nm WHERE t.qualification_id IS NULL
UNION ALL SELECT t.name, 'kept', k2.global_name FROM {tree3} t JOIN k2 USING (qualification_id)""")
def _(t):
    out = tree(t)
    level2 = out["level2"].select("qualification_id", "global_id").join(out["level1"].select("global_id", "global_name"), "global_id")
    return out["level3"].join(level2, "qualification_id").select("name", "action", "global_name")


NEW_LINKS = """SELECT l_orderkey * 10 + l_linenumber AS ord, l_suppkey AS institution_id, l_partkey AS specialization_id,
 CASE WHEN CAST(l_quantity AS INT) % 3 = 0 THEN NULL WHEN CAST(l_quantity AS INT) % 3 = 1 THEN concat(CAST(l_orderkey AS STRING), ' 000 тг') ELSE 'нет' END AS cost,
 CASE WHEN CAST(l_quantity AS INT) % 2 = 0 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ' лет') END AS duration FROM {lineitem}"""
# All links; the later ones under programmes that no new line names, so some are kept, some updated and some created.
OLD_LINKS = "SELECT institution_id, specialization_id + CASE WHEN created_at < TIMESTAMP '1997-06-01' THEN 0 ELSE 1000000000 END AS specialization_id, cost, duration, created_at FROM {link}"


def upsert_sql(old, new, extra=""):
    return f"""
 n0 AS ({new}),
 n1 AS (SELECT *, CASE WHEN l IS NOT NULL AND l > 0 THEN l END AS c, CASE WHEN y BETWEEN 1 AND 10 THEN y END AS d FROM
   (SELECT *, TRY_CAST(replace(replace(lower(CAST(cost AS STRING)), ' ', ''), 'тг', '') AS DOUBLE) AS l, TRY_CAST(regexp_extract(CAST(duration AS STRING), '(\\d+)', 1) AS INTEGER) AS y FROM n0)),
 n AS (SELECT institution_id, specialization_id, arg_max(c, ord) FILTER (WHERE c IS NOT NULL) AS nc, arg_max(d, ord) FILTER (WHERE d IS NOT NULL) AS nd, TRUE AS is_new FROM n1 GROUP BY 1, 2),
 o AS ({old})
SELECT COALESCE(o.institution_id, n.institution_id) AS institution_id, COALESCE(o.specialization_id, n.specialization_id) AS specialization_id,
 COALESCE(nc, o.cost) AS cost, COALESCE(nd, o.duration) AS duration, CASE WHEN o.institution_id IS NULL THEN 'created' WHEN is_new THEN 'updated' ELSE 'kept' END AS action
FROM o FULL JOIN n ON o.institution_id = n.institution_id AND o.specialization_id = n.specialization_id"""


# Equal (ord, link) rows may hold different values; the lowest wins nothing by order, so make ord unique.
NEW_UNIQUE = NEW_LINKS.replace("l_orderkey * 10 + l_linenumber AS ord", "(l_orderkey * 10 + l_linenumber) * 100 + CAST(l_quantity AS INT) AS ord")


@query("m2_upsert_links", "WITH" + upsert_sql(OLD_LINKS, NEW_UNIQUE))
def _(t):
    return M.upsert_links(t.sql(OLD_LINKS), t.sql(NEW_UNIQUE))


@query("a15_change_stats", "WITH x AS (WITH" + upsert_sql(OLD_LINKS, NEW_UNIQUE) + ") SELECT action, COUNT(*) AS n FROM x GROUP BY 1")
def _(t):
    return M.change_stats(M.upsert_links(t.sql(OLD_LINKS), t.sql(NEW_UNIQUE)))


@query("m6_import_replace", "WITH" + upsert_sql(f"SELECT * FROM ({OLD_LINKS}) WHERE institution_id NOT IN (SELECT institution_id FROM n0)", NEW_UNIQUE))
def _(t):
    return M.import_links(t.sql(OLD_LINKS), t.sql(NEW_UNIQUE), mode="replace")


UPDATE = "SELECT incoming_id AS ord, incoming_id % 90 AS institution_id, location, CASE WHEN incoming_id % 3 = 0 THEN '' ELSE website END AS website FROM {incoming}"


@query("m6_import_update", f"""
WITH n AS (SELECT institution_id, arg_max(location, ord) FILTER (WHERE location <> '') AS l, arg_max(website, ord) FILTER (WHERE website <> '') AS w FROM ({UPDATE}) GROUP BY 1)
SELECT u.institution_id, COALESCE(n.l, u.location) AS location, COALESCE(n.w, u.website) AS website FROM {{uni}} u LEFT JOIN n USING (institution_id)""")
def _(t):
    return M.update_institutions(t.uni, t.sql(UPDATE), ["location", "website"]).select("institution_id", "location", "website")


# ---- M3: components by a recursive query

GROUPS = ", ".join(f"CASE WHEN {' OR '.join(f'contains(nm, {w!r}) OR contains(web, {w!r})' for w in ws)} THEN 'g:{i}' END" for i, ws in enumerate(M.SAME_GROUP))
ROOTS = f"""
WITH RECURSIVE u AS (SELECT institution_id AS id, lower(name) AS nm, lower(COALESCE(website, '')) AS web, {D.host('website')} AS host FROM {{uni}} WHERE type = 'university'),
 k AS (SELECT id, UNNEST([{GROUPS}, 'h:' || host]) AS key FROM u),
 pair AS (SELECT (SELECT MIN(id) FROM u WHERE contains(nm, 'казгюу') OR contains(web, 'kazguu')) AS a, (SELECT MIN(id) FROM u WHERE contains(nm, 'narikbayev') OR contains(nm, 'maqsut') OR contains(web, 'mnu.kz')) AS b),
 e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.key = y.key AND x.id <> y.id UNION SELECT a, b FROM pair WHERE a <> b UNION SELECT b, a FROM pair WHERE a <> b),
 reach(id, other) AS (SELECT id, id FROM u UNION SELECT r.id, e.b FROM reach r JOIN e ON r.other = e.a),
 root AS (SELECT id, MIN(other) AS root FROM reach GROUP BY 1),
 m AS (SELECT i.*, COALESCE(r.root, i.institution_id) AS root FROM {{uni}} i LEFT JOIN root r ON i.institution_id = r.id)
"""


@query("m3_duplicate_roots", ROOTS + "SELECT id AS node, root FROM root WHERE root IN (SELECT root FROM root GROUP BY 1 HAVING COUNT(*) > 1)")
def _(t):
    return M.duplicate_roots(t.uni)


@query("m3_merge_links", ROOTS + """
SELECT m.root AS institution_id, l.specialization_id, arg_min(l.cost, l.institution_id) FILTER (WHERE l.cost IS NOT NULL) AS cost, arg_min(l.duration, l.institution_id) FILTER (WHERE l.duration IS NOT NULL) AS duration
FROM {link} l JOIN m USING (institution_id) GROUP BY 1, 2""")
def _(t):
    return M.merge_links(t.link, M.duplicate_roots(t.uni))


@query("m3_remap_favourites", ROOTS + "SELECT DISTINCT f.user_id, m.root AS institution_id FROM {fav} f JOIN m USING (institution_id)")
def _(t):
    return M.remap(t.fav, M.duplicate_roots(t.uni), unique=["user_id", "institution_id"]).select("user_id", "institution_id")


@query("m3_merge_institutions", ROOTS + """
SELECT root AS institution_id, arg_min(name, institution_id) AS name, COALESCE(arg_min(address, institution_id) FILTER (WHERE COALESCE(address, '') NOT IN ('', '0')), arg_min_null(address, institution_id)) AS address,
 arg_min(website, institution_id) FILTER (WHERE website IS NOT NULL) AS website, COALESCE(arg_min(latitude, institution_id) FILTER (WHERE latitude <> 0), arg_min_null(latitude, institution_id)) AS latitude,
 COALESCE(arg_min(longitude, institution_id) FILTER (WHERE longitude <> 0), arg_min_null(longitude, institution_id)) AS longitude,
 bool_or(dormitory) AS dormitory, bool_or(grants) AS grants, COUNT(*) AS merged_rows FROM m GROUP BY 1""")
def _(t):
    out = M.merge_institutions(t.uni, M.duplicate_roots(t.uni))
    return out.select("institution_id", "name", "address", "website", "latitude", "longitude", "dormitory", "grants", "merged_rows")


# ---- M4, M5, M8, M9

DATED = "SELECT institution_id, specialization_id, cost, duration, CASE WHEN specialization_id % 7 = 0 THEN NULL ELSE created_at END AS created_at FROM {link}"
ABOUT = "SELECT specialization_id, qualification_id, CASE WHEN specialization_id % 3 = 0 THEN name WHEN specialization_id % 3 = 1 THEN '' END AS about1 FROM {spec}"


@query("m4_purge", f"""
WITH sp AS ({ABOUT}), seed AS (SELECT specialization_id FROM sp WHERE about1 <> ''),
 l AS (SELECT * FROM ({DATED}) WHERE created_at IS NOT NULL AND specialization_id NOT IN (SELECT specialization_id FROM seed)),
 s AS (SELECT * FROM sp WHERE specialization_id NOT IN (SELECT specialization_id FROM seed) AND specialization_id IN (SELECT specialization_id FROM l)),
 q AS (SELECT * FROM {{qual}} WHERE qualification_id IN (SELECT qualification_id FROM s))
SELECT 'link' AS part, COUNT(*) AS n FROM l UNION ALL SELECT 'level3', COUNT(*) FROM s UNION ALL SELECT 'level2', COUNT(*) FROM q
UNION ALL SELECT 'level1', COUNT(*) FROM {{level1}} WHERE global_id IN (SELECT global_id FROM q)""")
def _(t):
    out = M.purge(t.level1, t.qual, t.sql(ABOUT), t.sql(DATED), F.col("about1") != "")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, df in out.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


PLAN = """SELECT l_orderkey * 1000 + CAST(l_quantity AS INT) AS ord, l_suppkey AS wrong_id, l_suppkey + 1 AS right_id, l_partkey AS specialization_id, l_extendedprice AS cost, CAST(NULL AS INT) AS duration
 FROM {lineitem}"""


@query("m5_repair_links", f"WITH pl AS ({PLAN}), gone AS (SELECT l.institution_id, l.specialization_id FROM {{link}} l WHERE l.created_at >= TIMESTAMP '1998-01-01' AND EXISTS (SELECT 1 FROM pl WHERE pl.wrong_id = l.institution_id AND pl.specialization_id = l.specialization_id)), "
       + upsert_sql("SELECT l.institution_id, l.specialization_id, l.cost, l.duration FROM {link} l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.institution_id = l.institution_id AND g.specialization_id = l.specialization_id)",
                    "SELECT ord, right_id AS institution_id, specialization_id, cost, duration FROM pl"))
def _(t):
    return M.repair_links(t.link, t.sql(PLAN), F.expr("TIMESTAMP_NTZ'1998-01-01'"))


CHANGES = "SELECT event_id AS seq, event_id % 1500 AS application_id, CASE event_type WHEN 'view' THEN 'Accepted' WHEN 'click' THEN 'Rejected' WHEN 'error' THEN NULL ELSE 'Pending' END AS value FROM {events}"


@query("m8_set_status", f"""
WITH c AS (SELECT application_id, last(value ORDER BY seq) AS v FROM ({CHANGES}) GROUP BY 1)
SELECT a.application_id, CASE WHEN c.application_id IS NOT NULL THEN c.v ELSE a.status END AS status FROM {{application}} a LEFT JOIN c USING (application_id)""")
def _(t):
    return M.set_value(t.application, t.sql(CHANGES), "application_id", "status").select("application_id", "status")


NEW_LIKES = "SELECT event_id, user_id, event_id % 97 AS institution_id, ts FROM {events}"


@query("m9_insert_if_absent", f"""
SELECT user_id, institution_id, MIN(event_id) AS event_id FROM ({NEW_LIKES}) n
WHERE NOT EXISTS (SELECT 1 FROM {{fav}} f WHERE f.user_id = n.user_id AND f.institution_id = n.institution_id) GROUP BY 1, 2""")
def _(t):
    return M.insert_if_absent(t.fav, t.sql(NEW_LIKES), ["user_id", "institution_id"], "event_id").select("user_id", "institution_id", "event_id")
