"""Filters, joins, counts, pages and activity over the role tables."""
import datetime

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import text as X
from ..operators import activity as A
from ..operators import paging
from ..operators import reads as R
from .registry import query

COUNTED = "SELECT institution_id, COUNT(*) AS n FROM"


# ---- filters

@query("p1_search", "SELECT institution_id, name FROM {uni} WHERE contains(lower(name), 'университет') OR contains(lower(name), '%')")
def _(t):
    hits = R.search(t.uni, "name", "УНИВЕРСИТЕТ")
    return R.union_all(hits, R.search(t.uni, "name", "%")).select("institution_id", "name").distinct()


@query("p2_where_optional", "SELECT institution_id, type, verified FROM {institution} WHERE type = 'university' AND verified = 'accepted'")
def _(t):
    return R.where_optional(t.institution, type="university", verified="accepted", location=None).select("institution_id", "type", "verified")


@query("p3_exclude_status", "SELECT institution_id, verified FROM {institution} WHERE verified NOT IN ('pending', 'rejected')")
def _(t):
    return R.exclude_status(t.institution, "verified", ["pending", "rejected"]).select("institution_id", "verified")


@query("p4_missing_coordinates", "SELECT institution_id FROM {uni} WHERE COALESCE(latitude, 0) = 0 OR COALESCE(longitude, 0) = 0")
def _(t):
    return t.uni.filter(G.missing_any(F.col("latitude"), F.col("longitude"))).select("institution_id")


@query("p5_in_box", """
SELECT institution_id, latitude BETWEEN 40.5 AND 55.5 AND longitude BETWEEN 46.5 AND 87.5 AS in_country,
  CASE institution_id % 4 WHEN 0 THEN latitude BETWEEN 50.9 AND 51.35 AND longitude BETWEEN 71.2 AND 71.7
    WHEN 1 THEN latitude BETWEEN 43.05 AND 43.45 AND longitude BETWEEN 76.55 AND 77.15
    WHEN 2 THEN latitude BETWEEN 42.2 AND 42.5 AND longitude BETWEEN 69.4 AND 69.8 ELSE TRUE END AS in_city
FROM {institution}""")
def _(t):
    city = F.expr("CASE institution_id % 4 WHEN 0 THEN 'Astana' WHEN 1 THEN 'Almaty' WHEN 2 THEN 'Shymkent' ELSE 'Elsewhere' END")
    lat, lng = F.col("latitude"), F.col("longitude")
    return t.institution.select(
        "institution_id", G.in_country(lat, lng).alias("in_country"), G.in_city(lat, lng, city).alias("in_city"))


@query("p6_pick_ids", "SELECT institution_id, name, website FROM {institution} WHERE institution_id IN (1, 2, 5, 8)")
def _(t):
    return R.pick_ids(t.institution, "institution_id", "1,2, 5,8,x", ["institution_id", "name", "website"])


@query("p7_active_and_trashed", """
SELECT user_id, 'active' AS scope, deleted_at FROM {app_user} WHERE deleted_at IS NULL
UNION ALL SELECT user_id, 'trashed', deleted_at FROM {app_user} WHERE deleted_at IS NOT NULL""")
def _(t):
    tag = lambda d, s: d.select("user_id", F.lit(s).alias("scope"), "deleted_at")
    return R.union_all(tag(R.active(t.app_user), "active"), tag(R.trashed(t.app_user), "trashed"))


@query("p8_banned_users", "SELECT user_id, username FROM {app_user} WHERE is_banned AND deleted_at IS NULL")
def _(t):
    return R.where_optional(R.active(t.app_user), is_banned=True).select("user_id", "username")


@query("p11_public_columns", "SELECT user_id, username, segment, is_banned, deleted_at FROM {app_user}")
def _(t):
    return R.public_columns(t.app_user)


@query("p12_for_owner", "SELECT review_id, user_id, institution_id, rating, created_at FROM {review} WHERE institution_id = 7")
def _(t):
    return R.for_owner(t.review, "institution_id", 7, "created_at", "review_id")


# ---- joins

@query("j1_link_join", """
SELECT l.institution_id, l.specialization_id, l.cost, l.duration, s.name, q.qualification_name
FROM {link} l JOIN {spec} s ON l.specialization_id = s.specialization_id
LEFT JOIN {qual} q ON s.qualification_id = q.qualification_id""")
def _(t):
    out = R.link_join(t.link, t.spec, t.qual, "qualification_id")
    return out.select("institution_id", "specialization_id", "cost", "duration", "name", "qualification_name")


@query("j2_catalog_tree", """
SELECT g.global_name, q.qualification_name, s.specialization_id, s.name
FROM {level1} g LEFT JOIN {qual} q ON g.global_id = q.global_id LEFT JOIN {spec} s ON q.qualification_id = s.qualification_id""")
def _(t):
    tree = R.catalog_tree(t.level1, t.qual, t.spec)
    level2 = tree.select("global_name", F.explode_outer("qualifications").alias("q"))
    leaf = level2.select("global_name", "q.qualification_name", F.explode_outer("q.specializations").alias("s"))
    return leaf.select("global_name", "qualification_name", "s.specialization_id", "s.name")


@query("j3_institution_index", """
WITH r AS (SELECT institution_id, COUNT(*) AS reviews_count, ROUND(AVG(rating), 6) AS avg_rating FROM {review} GROUP BY institution_id),
 f AS (SELECT institution_id, COUNT(*) AS likes_count FROM {fav} GROUP BY institution_id),
 k AS (SELECT * FROM (VALUES ('university'), ('college')) AS v(kind)),
 o AS (SELECT l.institution_id, s.kind, l.specialization_id, s.name AS program, q.qualification_name
   FROM {link} l JOIN {spec} s USING (specialization_id) LEFT JOIN {qual} q ON s.qualification_id = q.qualification_id)
SELECT i.institution_id, i.name, COALESCE(reviews_count, 0) AS reviews_count, COALESCE(likes_count, 0) AS likes_count, avg_rating, k.kind, o.specialization_id, o.program, o.qualification_name
FROM {institution} i JOIN k ON TRUE LEFT JOIN r USING (institution_id) LEFT JOIN f USING (institution_id) LEFT JOIN o ON i.institution_id = o.institution_id AND k.kind = o.kind""")
def _(t):
    out = R.institution_index(t.institution.select("institution_id", "name"), t.link, t.spec, t.qual, t.review, t.fav)
    return out.select(
        "institution_id", "name", "reviews_count", "likes_count", F.round("avg_rating", 6).alias("avg_rating"), "kind",
        F.explode_outer("programs").alias("p"),
    ).select("institution_id", "name", "reviews_count", "likes_count", "avg_rating", "kind", "p.specialization_id", F.col("p.name").alias("program"), "p.qualification_name")


@query("j4_enrich", """
SELECT r.review_id, r.rating, u.username, i.name FROM {review} r
LEFT JOIN {app_user} u ON r.user_id = u.user_id LEFT JOIN {institution} i ON r.institution_id = i.institution_id""")
def _(t):
    out = R.enrich(t.review, {"user_id": t.app_user.select("user_id", "username"), "institution_id": t.institution.select("institution_id", "name")})
    return out.select("review_id", "rating", "username", "name")


@query("j5_institutions_for", """
WITH o AS (SELECT * FROM {link} WHERE specialization_id = 7),
 r AS (SELECT institution_id, COUNT(*) AS n, AVG(rating) AS a FROM {review} GROUP BY 1),
 f AS (SELECT institution_id, COUNT(*) AS n FROM {fav} GROUP BY 1)
SELECT i.institution_id, i.name, o.cost, o.duration, COALESCE(r.n, 0) AS reviews_count, ROUND(r.a, 6) AS avg_rating, COALESCE(f.n, 0) AS likes_count
FROM {institution} i JOIN o USING (institution_id) LEFT JOIN r USING (institution_id) LEFT JOIN f USING (institution_id)""")
def _(t):
    out = R.institutions_for(7, t.institution, t.link, t.review, t.fav)
    return out.select("institution_id", "name", "cost", "duration", "reviews_count", F.round("avg_rating", 6).alias("avg_rating"), "likes_count")


@query("j6_where_has", """
SELECT 'liked' AS what, institution_id AS id FROM {institution} WHERE institution_id IN (SELECT institution_id FROM {fav})
UNION ALL SELECT 'event', event_id FROM {calendar_event} WHERE institution_id IN (SELECT institution_id FROM {institution} WHERE type = 'college')
UNION ALL SELECT 'application', application_id FROM {application} WHERE event_id IN (SELECT event_id FROM {calendar_event} WHERE institution_id = 5)""")
def _(t):
    tag = lambda d, what, key: d.select(F.lit(what).alias("what"), F.col(key).alias("id"))
    return R.union_all(
        tag(R.where_has(t.institution, t.fav, "institution_id"), "liked", "institution_id"),
        tag(R.where_has(t.calendar_event, t.institution, "institution_id", cond=F.col("type") == "college"), "event", "event_id"),
        tag(R.where_has(t.application, t.calendar_event, "event_id", cond=F.col("institution_id") == 5), "application", "application_id"))


@query("j7_available", """
SELECT specialization_id, name FROM {spec} s
WHERE NOT EXISTS (SELECT 1 FROM {link} l WHERE l.institution_id = 3 AND l.specialization_id = s.specialization_id)""")
def _(t):
    return R.available(t.spec, t.link, 3).select("specialization_id", "name")


@query("j8_prune_tree", """
WITH keep AS (SELECT * FROM {link}),
 s AS (SELECT * FROM {spec} WHERE specialization_id IN (SELECT specialization_id FROM keep)),
 q AS (SELECT * FROM {qual} WHERE qualification_id IN (SELECT qualification_id FROM s))
SELECT 'spec' AS level, CAST(specialization_id AS STRING) AS id FROM s UNION ALL SELECT 'qual', qualification_id FROM q
UNION ALL SELECT 'glob', global_id FROM {level1} WHERE global_id IN (SELECT global_id FROM q)
UNION ALL SELECT 'orphan', CAST(specialization_id AS STRING) FROM {spec} WHERE specialization_id NOT IN (SELECT specialization_id FROM keep)""")
def _(t):
    keep = t.link
    glob, qual, spec = R.prune_tree(t.level1, t.qual, t.spec, keep)
    tag = lambda d, level, key: d.select(F.lit(level).alias("level"), F.col(key).cast("string").alias("id"))
    return R.union_all(
        tag(spec, "spec", "specialization_id"), tag(qual, "qual", "qualification_id"), tag(glob, "glob", "global_id"),
        tag(R.where_lacks(t.spec, keep, "specialization_id"), "orphan", "specialization_id"))


@query("j9_backfill", """
SELECT e.event_id, i.type AS institution_type, CASE WHEN e.institution_id IN (SELECT institution_id FROM {link} WHERE duration = 8) THEN 'college' ELSE 'other' END AS marked
FROM {calendar_event} e LEFT JOIN {institution} i USING (institution_id)""")
def _(t):
    parent = t.institution.withColumnRenamed("type", "institution_type")
    out = R.backfill(t.calendar_event, parent, "institution_id", "institution_type").withColumn("marked", F.lit("other"))
    out = R.type_by_membership(out, t.link.filter("duration = 8"), "institution_id", "marked", "college")
    return out.select("event_id", "institution_type", "marked")


@query("j19_detail_card", """
SELECT i.institution_id, i.type, o.specialization_id, o.name AS program, o.cost, o.duration,
  (SELECT COUNT(*) FROM {review} WHERE institution_id = 5) AS reviews_count, (SELECT COUNT(*) FROM {fav} WHERE institution_id = 5) AS likes_count,
  ROUND((SELECT AVG(rating) FROM {review} WHERE institution_id = 5), 6) AS avg_rating
FROM {institution} i LEFT JOIN (SELECT l.*, s.name, s.kind FROM {link} l JOIN {spec} s USING (specialization_id)) o
  ON i.institution_id = o.institution_id AND i.type = o.kind WHERE i.institution_id = 5""")
def _(t):
    offers = R.link_join(t.link, t.spec).select("institution_id", F.col("kind").alias("type"), "specialization_id", F.col("name").alias("program"), "cost", "duration")
    out = R.detail_card(5, t.institution, offers, t.review, t.fav)
    return out.select("institution_id", "type", "specialization_id", "program", "cost", "duration", "reviews_count", "likes_count", F.round("avg_rating", 6).alias("avg_rating"))


# ---- aggregates

RATING = """
WITH r AS (SELECT institution_id, COUNT(*) AS reviews_count, AVG(rating) AS avg_rating FROM {review} GROUP BY institution_id),
 f AS (SELECT institution_id, COUNT(*) AS likes_count FROM {fav} GROUP BY institution_id),
 s AS (SELECT i.institution_id, i.name, COALESCE(reviews_count, 0) AS reviews_count, COALESCE(likes_count, 0) AS likes_count, ROUND(avg_rating, 6) AS avg_rating
  FROM {institution} i LEFT JOIN r USING (institution_id) LEFT JOIN f USING (institution_id))
"""


def ratings(t):
    out = R.rating_summary(t.institution.select("institution_id", "name"), t.review, t.fav)
    return out.withColumn("avg_rating", F.round("avg_rating", 6))


@query("a1_rating_summary", RATING + "SELECT * FROM s")
def _(t):
    return ratings(t)


@query("a1_top_rated", RATING + "SELECT * FROM s ORDER BY avg_rating DESC NULLS LAST, reviews_count DESC, institution_id LIMIT 20")
def _(t):
    return ratings(t).orderBy(F.col("avg_rating").desc_nulls_last(), F.col("reviews_count").desc(), "institution_id").limit(20)


@query("a2_avg_or_zero", """
SELECT i.institution_id, COALESCE(ROUND(AVG(r.rating), 6), 0.0e0) AS rating FROM {institution} i LEFT JOIN {review} r
  ON i.institution_id = r.institution_id GROUP BY i.institution_id""")
def _(t):
    few = t.review.groupBy("institution_id").agg(R.avg_or_zero(F.col("rating")).alias("rating"))
    return t.institution.select("institution_id").join(few, "institution_id", "left").fillna(0.0, ["rating"]).withColumn("rating", F.round("rating", 6))


@query("a3_dashboard", """
SELECT (SELECT COUNT(*) FROM {app_user}) AS users, (SELECT COUNT(*) FROM {institution} WHERE type = 'university') AS universities,
 (SELECT COUNT(*) FROM {institution} WHERE type = 'college') AS colleges, (SELECT COUNT(*) FROM {spec}) AS programs,
 (SELECT COUNT(*) FROM {calendar_event}) AS events, (SELECT COUNT(*) FROM {application}) AS applications""")
def _(t):
    trees = R.catalog(t.spec.filter("kind = 'university'"), t.spec.filter("kind = 'college'"))
    return R.dashboard(t.spark, {
        "users": t.app_user, "universities": t.institution.filter("type = 'university'"), "colleges": t.institution.filter("type = 'college'"),
        "programs": trees, "events": t.calendar_event, "applications": t.application})


@query("a4_latest", """
SELECT a.application_id, a.created_at, u.username FROM (SELECT * FROM {application} ORDER BY created_at DESC, application_id DESC LIMIT 1) a
LEFT JOIN {app_user} u ON a.user_id = u.user_id""")
def _(t):
    last = R.latest(t.application, "created_at", "application_id")
    return R.enrich(last, {"user_id": t.app_user.select("user_id", "username")}).select("application_id", "created_at", "username")


@query("a5_multi_child", """
SELECT g.global_id, g.global_name, COUNT(*) AS children FROM {level1} g JOIN {qual} q USING (global_id)
GROUP BY ALL HAVING COUNT(*) > 1 ORDER BY children DESC, g.global_id LIMIT 15""")
def _(t):
    return R.multi_child(t.level1, t.qual, "global_id", 15)


@query("a6_import_preview", """
WITH p AS (SELECT COALESCE(NULLIF(trim(global_specialty), ''), 'Образовательные программы') AS g, NULLIF(trim(code), '') AS c FROM {program})
SELECT COUNT(*) AS program_rows, COUNT(DISTINCT g) AS unique_groups, COUNT(DISTINCT c) AS unique_codes,
 (SELECT string_agg(g, ' | ' ORDER BY g) FROM (SELECT DISTINCT g FROM p ORDER BY g LIMIT 8)) AS sample_groups FROM p""")
def _(t):
    return R.import_preview(t.program)


def _activity(name, table, key, ts, unit, as_of, starts, trunc, label):
    @query(name, f"""
WITH b AS ({starts}), c AS (SELECT CAST(date_trunc('{trunc}', {ts}) AS DATE) AS bucket, COUNT(*) AS n FROM {{{table}}} GROUP BY 1)
SELECT CAST(b.position AS INTEGER) AS position, CAST(b.bucket AS DATE) AS bucket, {label} AS label, COALESCE(c.n, 0) AS total FROM b LEFT JOIN c ON CAST(b.bucket AS DATE) = c.bucket""")
    def _(t):
        return A.activity(getattr(t, table), ts, unit, as_of)


DAYS = "SELECT i AS position, DATE '{0}' + CAST(i AS INTEGER) AS bucket FROM range({1}) r(i)"
_activity("a7_activity_days", "calendar_event", "event_id", "event_date", "days", "2024-01-30 10:00:00",
          DAYS.format("2024-01-24", 7), "day", "strftime(b.bucket, '%d %b')")
_activity("a8_activity_weeks", "test_result", "result_id", "created_at", "weeks", "2024-01-30 10:00:00",
          "SELECT i AS position, DATE '2024-01-08' + CAST(7 * i AS INTEGER) AS bucket FROM range(4) r(i)", "week", "'Week ' || CAST(b.position + 1 AS STRING)")
_activity("a9_activity_months", "application", "application_id", "created_at", "months", "2001-08-01 00:00:00",
          "SELECT i AS position, DATE '2000-09-01' + to_months(CAST(i AS INTEGER)) AS bucket FROM range(12) r(i)", "month", "strftime(b.bucket, '%b')")


@query("a14_host_groups", """
SELECT host, COUNT(*) AS members, MIN(institution_id) AS keep_id FROM
 (SELECT institution_id, lower(regexp_replace(regexp_extract(website, '^https?://([^/]+)', 1), '^www\\.', '')) AS host FROM {uni} WHERE website IS NOT NULL)
WHERE host NOT IN ('zero.kz', 'facebook.com', 'instagram.com') GROUP BY host HAVING COUNT(*) > 1""")
def _(t):
    return R.host_groups(t.uni)


@query("a17_event_board", """
SELECT e.event_id, e.institution_id, COUNT(a.application_id) AS applications, COUNT(*) FILTER (WHERE a.status = 'Pending') AS pending,
 COUNT(*) FILTER (WHERE a.status = 'Accepted') AS accepted, COUNT(*) FILTER (WHERE a.status = 'Rejected') AS rejected
FROM {calendar_event} e LEFT JOIN {application} a USING (event_id) GROUP BY 1, 2""")
def _(t):
    return R.event_board(t.calendar_event.select("event_id", "institution_id"), t.application)


@query("a17_events_per_institution", "SELECT i.institution_id, COUNT(e.event_id) AS events FROM {institution} i LEFT JOIN {calendar_event} e USING (institution_id) GROUP BY 1")
def _(t):
    return R.events_per_institution(t.institution.select("institution_id"), t.calendar_event)


@query("a18_programs_by_qualification", """
SELECT q.qualification_name, s.specialization_id, s.name
FROM {link} l JOIN {spec} s USING (specialization_id) JOIN {qual} q USING (qualification_id) WHERE l.institution_id = 4""")
def _(t):
    rows = R.link_join(t.link.filter("institution_id = 4"), t.spec, t.qual, "qualification_id")
    cards = R.nest(rows.select("qualification_name").distinct(), rows, "qualification_name", ["specialization_id"], ["name"], "items")
    return cards.select("qualification_name", F.inline("items"))


# ---- order, pages, sets

@query("o1_paginate", """
SELECT specialization_id, name, (SELECT COUNT(*) FROM {spec}) AS total, 24 AS per_page, CAST(ceil((SELECT COUNT(*) FROM {spec}) / 24.0) AS BIGINT) AS last_page
FROM {spec} ORDER BY name, specialization_id LIMIT 24 OFFSET 48""")
def _(t):
    return R.paginate(t.spec.select("specialization_id", "name"), 3, 24, F.col("name"), F.col("specialization_id"))


LINES = "SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM {lineitem}"


@query("o1_seek_page", f"""
SELECT *, (SELECT COUNT(*) FROM lineitem) AS total, 50 AS per_page, CAST(ceil((SELECT COUNT(*) FROM lineitem) / 50.0) AS BIGINT) AS last_page
FROM ({LINES}) ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 50 OFFSET 4950""")
def _(t):
    """Page 100 of all lines, from an index of their ranges."""
    order = [("l_shipdate", False), ("l_orderkey", True), ("l_linenumber", True)]
    folder = paging.build_index(t.sql(LINES), order, ranges=16)
    return paging.seek_page(t.spark, folder, 100, 50, order)


@query("o1_after_key", f"""
SELECT * FROM ({LINES}) WHERE l_shipdate < TIMESTAMP '1997-03-05' OR (l_shipdate = TIMESTAMP '1997-03-05' AND (l_orderkey > 300 OR (l_orderkey = 300 AND l_linenumber > 2)))
ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 50""")
def _(t):
    order = [("l_shipdate", False), ("l_orderkey", True), ("l_linenumber", True)]
    return paging.page_after(t.sql(LINES), order, [datetime.datetime(1997, 3, 5), 300, 2], 50)


@query("o2_sort_by_date", """
SELECT event_id, event_date, institution_id FROM {calendar_event} ORDER BY event_date DESC, event_id DESC""")
def _(t):
    return R.sort_by_date(t.calendar_event.select("event_id", "event_date", "institution_id"), "event_date", "event_id")


@query("o4_catalog_order", "SELECT code, name FROM {title} ORDER BY code NULLS LAST, name")
def _(t):
    return R.catalog_order(t.title.select("code", "name"))


@query("u1_catalog", """
SELECT specialization_id, name, 'university' AS kind FROM {spec} WHERE kind = 'university'
UNION ALL SELECT specialization_id, name, 'college' FROM {spec} WHERE kind = 'college'""")
def _(t):
    part = lambda k: t.spec.filter(F.col("kind") == k).select("specialization_id", "name")
    return R.catalog(part("university"), part("college"))


@query("u2_union_all", "SELECT name, code, CAST(NULL AS STRING) AS source FROM {title} UNION ALL SELECT name, NULL, kind FROM {spec}")
def _(t):
    return R.union_all(t.title.select("name", "code"), t.spec.select("name", F.col("kind").alias("source")))


@query("u3_distinct_in_order", """
WITH w AS (SELECT doc_id, word, MIN(i) AS i FROM (SELECT doc_id, UNNEST(string_split(text, ' ')) AS word,
  generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) GROUP BY 1, 2)
SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM w GROUP BY doc_id""")
def _(t):
    return t.documents.select("doc_id", F.array_join(R.distinct_in_order(F.split("text", " ")), " ").alias("words"))
