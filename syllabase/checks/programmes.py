"""Title winners, merged sources, price rules and the audit."""
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import programs as P
from ..operators import quality as Q
from ..sources import catalog as C
from . import duck as D
from .registry import query
from .texts import FLAGS_SQL

# ---- W1: links

CLEAN = "WITH" + D.analysis("{title}", "name", "qualification") + f""",
 rows AS (SELECT l.institution_id, l.specialization_id, l.cost, l.duration, a.raw, a.clean, a.lang, a.score, a.hint, a."drop",
   COALESCE(a.title_code, concat('name:', {D.fingerprint('a.clean')})) AS group_key FROM {{link}} l JOIN analysed a USING (specialization_id)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY institution_id, group_key ORDER BY CASE WHEN lang = 'ru' AND score >= 40 THEN 0 ELSE 1 END, score DESC, specialization_id) AS rk,
   COUNT(*) OVER g AS n, MAX(CASE WHEN cost > 0 THEN cost END) OVER g AS best_cost, MAX(CASE WHEN duration > 0 THEN duration END) OVER g AS best_dur
   FROM rows WHERE NOT "drop" WINDOW g AS (PARTITION BY institution_id, group_key)),
 kept AS (SELECT institution_id, group_key, specialization_id, clean AS final_name, best_cost AS cost, COALESCE(best_dur, hint) AS duration, n - 1 AS removed, raw <> clean AS renamed
   FROM ranked WHERE rk = 1)
"""


@query("w1_clean_links", CLEAN + "SELECT * FROM kept")
def _(t):
    return P.clean_links(t.link, t.title)


@query("w1_clean_stats", CLEAN + """
SELECT i.institution_id, COALESCE(k.kept, 0) AS kept, COALESCE(k.removed, 0) + COALESCE(d.n, 0) AS removed, COALESCE(k.renamed, 0) AS renamed
FROM (SELECT DISTINCT institution_id FROM {link}) i
LEFT JOIN (SELECT institution_id, COUNT(*) AS kept, CAST(SUM(removed) AS BIGINT) AS removed, COUNT(*) FILTER (WHERE renamed) AS renamed FROM kept GROUP BY 1) k USING (institution_id)
LEFT JOIN (SELECT institution_id, COUNT(*) AS n FROM rows WHERE "drop" GROUP BY 1) d USING (institution_id)""")
def _(t):
    return P.clean_stats(t.link, t.title)


SPECS = "(SELECT specialization_id, name, concat(CAST(specialization_id % 4 AS STRING), '/', COALESCE(global_specialty, '')) AS qualification_id FROM {title})"


@query("w1_apply_renames", CLEAN + f""",
 sp AS {SPECS}, named AS (SELECT name, qualification_id, MIN(specialization_id) AS target FROM sp GROUP BY 1, 2),
 placed AS (SELECT k.*, COALESCE(k.renamed AND n.target IS NOT NULL AND n.target <> k.specialization_id, FALSE) AS moved, n.target
   FROM kept k JOIN sp USING (specialization_id) LEFT JOIN named n ON n.name = k.final_name AND n.qualification_id = sp.qualification_id),
 pl AS (SELECT *, CASE WHEN moved THEN target ELSE specialization_id END AS place FROM placed)
SELECT institution_id, place AS specialization_id,
  first(cost ORDER BY moved DESC, specialization_id) FILTER (WHERE cost IS NOT NULL) AS cost,
  first(duration ORDER BY moved DESC, specialization_id) FILTER (WHERE duration IS NOT NULL) AS duration FROM pl GROUP BY 1, 2""")
def _(t):
    spec = t.title.withColumn("qualification_id", F.expr("concat(CAST(specialization_id % 4 AS STRING), '/', COALESCE(global_specialty, ''))"))
    return P.apply_renames(P.clean_links(t.link, t.title), spec.select("specialization_id", "name", "qualification_id"))[0]


# ---- W2, W3, gates

PREPARED = "WITH" + D.analysis("(SELECT DISTINCT name, qualification, code FROM {program})", "name", "qualification", "code", hard=True) + f""",
 prep AS (SELECT p.institution_id, p.pos, a.clean, a.title_code, a.lang, a.score,
   CASE WHEN p.cost > 0 THEN p.cost END AS price, CASE WHEN COALESCE(p.duration, a.hint) BETWEEN 1 AND 8 THEN COALESCE(p.duration, a.hint) END AS years,
   COALESCE(NULLIF(p.global_specialty, ''), 'Образовательные программы') AS branch,
   CASE WHEN regexp_matches(a.title_code, '^6В\\d{{5,}}$') THEN concat('full:', a.title_code)
        WHEN regexp_matches(a.title_code, '^6В\\d{{2,4}}$') THEN concat('grp:', a.title_code, ':', {D.fingerprint('a.clean')})
        ELSE concat('n:', {D.fingerprint('a.clean')}) END AS group_key
   FROM {{program}} p JOIN analysed a ON p.name IS NOT DISTINCT FROM a.name AND p.qualification IS NOT DISTINCT FROM a.qualification AND p.code IS NOT DISTINCT FROM a.code
   WHERE NOT a."drop"),
 best AS (SELECT *, row_number() OVER (PARTITION BY institution_id, group_key ORDER BY CASE WHEN lang = 'ru' THEN 0 ELSE 1 END, score DESC, pos) AS rk,
   first_value(price IGNORE NULLS) OVER g AS p1, first_value(years IGNORE NULLS) OVER g AS y1 FROM prep
   WINDOW g AS (PARTITION BY institution_id, group_key ORDER BY score DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 deduped AS (SELECT institution_id, clean AS name, title_code AS code, branch AS global_specialty,
   CASE WHEN title_code IS NOT NULL THEN concat(title_code, ' · ', branch) ELSE branch END AS qualification,
   COALESCE(price, p1) AS cost, COALESCE(years, y1) AS duration, pos FROM best WHERE rk = 1)
"""


@query("w2_dedupe_programs", PREPARED + "SELECT * FROM deduped")
def _(t):
    return P.dedupe_programs(t.program)


@query("a12_run_totals", PREPARED + "SELECT COUNT(DISTINCT institution_id) AS ok_count, COUNT(*) AS total_programs, COUNT(cost) AS total_with_cost FROM deduped")
def _(t):
    return P.run_totals(P.dedupe_programs(t.program))


CLEAN_NAME = "regexp_replace(" + D.norm("name") + r", '^(ОП|образовательная программа|программа)\s*[:\-]?\s*', '', 'i')"


@query("w3_keep_better", f"""
WITH r AS (SELECT *, CASE WHEN COALESCE(cost, 0) <> 0 THEN 1 ELSE 0 END AS hc, CASE WHEN duration IS NOT NULL THEN 1 ELSE 0 END AS hd, CASE WHEN code IS NOT NULL THEN 1 ELSE 0 END AS hk,
  {CLEAN_NAME} AS cn FROM {{program}}),
 k AS (SELECT *, row_number() OVER (PARTITION BY institution_id, COALESCE(code, ''), lower(cn) ORDER BY hc + hd + hk DESC, hc DESC, pos) AS rk FROM r WHERE cn <> '')
SELECT institution_id, pos, name, code, cost, duration FROM k WHERE rk = 1 AND NOT regexp_matches(lower(name), 'cookie|javascript|error|404|privacy|политик') AND length(name) >= 4""")
def _(t):
    return P.keep_better(t.program).select("institution_id", "pos", "name", "code", "cost", "duration")


GATED = """
WITH r AS (SELECT * REPLACE (trim(name) AS name, CASE WHEN cost > 0 THEN cost END AS cost) FROM {program})
SELECT * FROM r
WHERE length(name) BETWEEN 5 AND 160 AND NOT regexp_matches(lower(name), 'cookie|меню|главная|войти|login|privacy|политика|подробнее|скачать') AND (code IS NOT NULL OR cost IS NOT NULL)"""


@query("p9_gate_official", f"SELECT institution_id, pos, name, code, cost FROM ({GATED})")
def _(t):
    return P.gate_official(t.program).select("institution_id", "pos", "name", "code", "cost")


@query("p10_gate_min_programs", "SELECT institution_id, COUNT(*) AS programs_count, COUNT(*) >= 600 AS ok FROM {program} GROUP BY 1")
def _(t):
    return P.gate_min_programs(t.program, 600)


@query("w7_list_sizes", """
WITH r AS (SELECT institution_id, pos, name, CASE WHEN institution_id % 2 = 0 THEN code END AS code FROM {program}),
 s AS (SELECT *, code IS NOT NULL AS has_code, COUNT(*) OVER (PARTITION BY institution_id) AS listed, COUNT(code) OVER (PARTITION BY institution_id) AS coded FROM r)
SELECT institution_id, pos, name, code, has_code, listed, coded FROM s""")
def _(t):
    rows = t.program.select("institution_id", "pos", "name", F.when(F.col("institution_id") % 2 == 0, F.col("code")).alias("code"))
    return P.list_sizes(rows)


# ---- J14: two sources; the second one holds every third row under changed spelling

BASE_SQL = "SELECT institution_id, pos, name, code, global_specialty, qualification, cost, duration, 'list' AS source FROM {program} WHERE pos % 3 <> 0"
EXTRA_SQL = """SELECT institution_id, pos, CASE WHEN pos % 2 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN pos % 5 = 0 THEN NULL ELSE code END AS code,
 global_specialty, qualification, cost, duration, 'official' AS source FROM {program} WHERE pos % 3 = 0"""


def merged_sql(base, extra):
    return f"""
WITH base AS (SELECT *, {D.score_name('name')} AS n, concat(replace(upper(COALESCE(code, '')), 'B', 'В'), '||', {D.score_name('name')}) AS k FROM {base}),
 extra AS (SELECT *, {D.score_name('name')} AS n, concat(replace(upper(COALESCE(code, '')), 'B', 'В'), '||', {D.score_name('name')}) AS k FROM {extra}),
 known AS (SELECT institution_id, k, n, MIN(pos) AS first_pos, arg_max(name, pos) AS name, last(code ORDER BY pos) AS code, last(cost ORDER BY pos) AS cost, last(duration ORDER BY pos) AS duration, last(global_specialty ORDER BY pos) AS global_specialty, last(qualification ORDER BY pos) AS qualification, last(source ORDER BY pos) AS source FROM base GROUP BY 1, 2, 3),
 byname AS (SELECT institution_id, n, arg_min(k, first_pos) AS name_key FROM known GROUP BY 1, 2),
 own AS (SELECT institution_id, n, arg_min(k, pos) AS own_key FROM extra GROUP BY 1, 2),
 tgt AS (SELECT e.institution_id, COALESCE(x.k, b.name_key, o.own_key) AS k, 1 AS s, e.pos AS p, e.name, e.code, e.cost, e.duration, e.global_specialty, e.qualification, e.source
   FROM extra e LEFT JOIN known x ON e.institution_id = x.institution_id AND e.k = x.k LEFT JOIN byname b ON e.institution_id = b.institution_id AND e.n = b.n
   JOIN own o ON e.institution_id = o.institution_id AND e.n = o.n),
 u AS (SELECT institution_id, k, 0 AS s, first_pos AS p, name, code, cost, duration, global_specialty, qualification, source FROM known UNION ALL SELECT * FROM tgt)
SELECT institution_id, first(name ORDER BY s, p) AS name, first(global_specialty ORDER BY s, p) AS global_specialty, first(qualification ORDER BY s, p) AS qualification, min(struct_pack(s := s, p := p)) AS pos, first(code ORDER BY s, p) FILTER (WHERE code IS NOT NULL) AS code,
 first(cost ORDER BY s, p) FILTER (WHERE cost IS NOT NULL) AS cost, first(duration ORDER BY s, p) FILTER (WHERE duration IS NOT NULL) AS duration,
 CASE WHEN MIN(s) = 0 AND MAX(s) = 1 THEN concat(first(source ORDER BY s, p), ',official') ELSE first(source ORDER BY s, p) END AS sources FROM u GROUP BY institution_id, k"""


@query("j14_merge_programs", "SELECT institution_id, name, code, cost, duration, sources FROM (" + merged_sql(f"({BASE_SQL})", f"({EXTRA_SQL})") + ")")
def _(t):
    out = P.merge_programs(t.sql(BASE_SQL), t.sql(EXTRA_SQL))
    return out.select("institution_id", "name", "code", "cost", "duration", F.array_join("sources", ",").alias("sources"))


# ---- J15: rules made from the institutions and programmes

BY_ID = """SELECT s_suppkey AS institution_id, s_suppkey % 4 <> 0 AS fill_null_only, CASE WHEN s_suppkey % 5 = 0 THEN 0.0e0 ELSE 1000.0e0 * (s_suppkey + 1) END AS default_cost,
 CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(4 AS INT) END AS default_duration FROM {supplier} WHERE s_suppkey % 3 <> 0"""
NAME_RULES = """SELECT s_suppkey AS institution_id, '(?i)finance' AS match, 777.0e0 AS cost, CAST(NULL AS INT) AS duration, 1 AS ord FROM {supplier} WHERE s_suppkey % 2 = 0
 UNION ALL SELECT s_suppkey, 'Экономика|and Acc', 888.0e0, CAST(5 AS INT), 2 FROM {supplier} WHERE s_suppkey % 4 = 0"""


RULED = f"""
WITH d AS ({BY_ID}),
 p AS (SELECT *, institution_id % 2 = 0 AND regexp_matches(name, '(?i)finance') AS r1, institution_id % 4 = 0 AND regexp_matches(name, 'Экономика|and Acc') AS r2 FROM {{program}}),
 j AS (SELECT p.*, d.default_cost, d.default_duration, d.fill_null_only, (d.default_cost > 0) AS offered FROM p LEFT JOIN d USING (institution_id))
SELECT institution_id, pos, name, code, global_specialty, qualification, CASE WHEN r2 THEN 888.0e0 WHEN r1 THEN 777.0e0 WHEN offered AND fill_null_only AND NOT COALESCE(cost, 0) > 0 THEN default_cost WHEN offered AND NOT fill_null_only THEN default_cost ELSE cost END AS cost,
 CASE WHEN r2 THEN 5 WHEN r1 THEN duration ELSE COALESCE(duration, default_duration) END AS duration,
 CASE WHEN r1 OR r2 THEN 'official_name_rule' WHEN offered AND fill_null_only AND NOT COALESCE(cost, 0) > 0 THEN 'official_default_fill' WHEN offered AND NOT fill_null_only THEN 'official_default_force' END AS cost_source FROM j"""


@query("j15_apply_overrides", f"SELECT institution_id, pos, cost, duration, cost_source FROM ({RULED})")
def _(t):
    return P.apply_overrides(t.program, t.sql(BY_ID), t.sql(NAME_RULES)).select("institution_id", "pos", "cost", "duration", "cost_source")


CASES = " ".join(f"WHEN starts_with(c, '{k}') THEN '{v}'" for k, v in P.BRANCHES)


@query("j12_branch_by_code", f"""
WITH r AS (SELECT *, replace(upper(COALESCE(code, '')), 'B', 'В') AS c FROM {{title}}),
 b AS (SELECT *, COALESCE(global_specialty, CASE {CASES} ELSE 'Образовательные программы' END) AS g FROM r)
SELECT specialization_id, g AS global_specialty, COALESCE(NULLIF(qualification, ''), code, g) AS qualification FROM b""")
def _(t):
    return P.infer_branch(t.title).select("specialization_id", "global_specialty", "qualification")


# ---- audit

FLAGGED = f"""
WITH n AS (SELECT DISTINCT name, {D.norm('name')} AS raw FROM {{program}}),
 f AS (SELECT name, {FLAGS_SQL} AS flags, regexp_replace(lower(COALESCE(name, '')), '[^a-zа-яё0-9]+', '', 'g') AS fp FROM n),
 r AS (SELECT p.*, f.fp, f.flags, CASE WHEN f.flags = '' THEN 0 ELSE len(string_split(f.flags, ',')) END AS nf,
   COALESCE({D.code('p.name')}, {D.code('p.qualification')}, {D.code('p.code')}) AS ac FROM {{program}} p JOIN f ON p.name IS NOT DISTINCT FROM f.name),
 cd AS (SELECT institution_id, COUNT(*) AS g, SUM(n - 1) AS s FROM (SELECT institution_id, ac, COUNT(*) AS n FROM r WHERE ac IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) > 1) GROUP BY 1),
 nd AS (SELECT institution_id, COUNT(*) AS g FROM (SELECT institution_id, fp FROM r WHERE fp <> '' GROUP BY 1, 2 HAVING COUNT(*) > 1) GROUP BY 1),
 fc AS (SELECT institution_id, flag, COUNT(*) AS n FROM (SELECT institution_id, UNNEST(string_split(flags, ',')) AS flag FROM r WHERE flags <> '') GROUP BY 1, 2),
 fl AS (SELECT institution_id, string_agg(concat(flag, '=', CAST(n AS STRING)), ',' ORDER BY flag) AS flag_counts FROM fc GROUP BY 1),
 b AS (SELECT institution_id, COUNT(*) AS specs_count, COUNT(*) FILTER (WHERE COALESCE(cost, 0) <> 0) AS with_cost, COUNT(*) FILTER (WHERE nf > 0) AS issue_rows, SUM(nf) AS ft FROM r GROUP BY 1),
 report AS (SELECT i.institution_id, i.name, COALESCE(specs_count, 0) AS specs_count, COALESCE(with_cost, 0) AS with_cost, COALESCE(issue_rows, 0) AS issue_rows, COALESCE(flag_counts, '') AS flag_counts,
   COALESCE(cd.g, 0) AS code_duplicate_groups, COALESCE(nd.g, 0) AS name_duplicate_groups, CAST(COALESCE(ft, 0) + 2 * COALESCE(cd.s, 0) AS BIGINT) AS severity
   FROM {{uni}} i LEFT JOIN b USING (institution_id) LEFT JOIN fl USING (institution_id) LEFT JOIN cd USING (institution_id) LEFT JOIN nd USING (institution_id))
"""
FLAT = "transform(map_entries(flag_counts), e -> concat(e.key, '=', CAST(e.value AS STRING)))"


def report(t):
    return Q.audit(t.uni.select("institution_id", "name"), t.program)


@query("a10_audit", FLAGGED + "SELECT * FROM report")
def _(t):
    return report(t).withColumn("flag_counts", F.array_join(F.expr(FLAT), ","))


@query("a11_audit_summary", FLAGGED + """
SELECT COUNT(*) AS universities, COUNT(*) FILTER (WHERE specs_count > 0) AS with_specs, COUNT(*) FILTER (WHERE specs_count = 0) AS empty_specs,
 COUNT(*) FILTER (WHERE severity = 0 AND specs_count > 0) AS clean_universities, COUNT(*) FILTER (WHERE severity > 0) AS universities_with_issues,
 CAST(SUM(specs_count) AS BIGINT) AS total_specialties, CAST(SUM(issue_rows) AS BIGINT) AS rows_with_flags FROM report""")
def _(t):
    return Q.audit_summary(report(t))


@query("a11_flag_totals", FLAGGED + "SELECT flag, CAST(SUM(n) AS BIGINT) AS total FROM fc GROUP BY 1")
def _(t):
    return Q.flag_totals(report(t))


@query("o3_worst", FLAGGED + "SELECT institution_id, severity, issue_rows FROM report ORDER BY severity DESC, issue_rows DESC, name LIMIT 25")
def _(t):
    return Q.worst(report(t)).select("institution_id", "severity", "issue_rows")


@query("o5_sample_issues", FLAGGED + """
SELECT institution_id, string_agg(concat(name, ' [', flags, ']'), ';' ORDER BY pos) AS sample_issues
FROM (SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY pos) AS rk FROM r WHERE nf > 0) WHERE rk <= 12 GROUP BY 1""")
def _(t):
    return Q.sample_issues(t.program, "pos").withColumn("sample_issues", F.array_join("sample_issues", ";"))


@query("o5_sample_code_groups", FLAGGED + """,
 g AS (SELECT institution_id, ac, MIN(pos) AS f FROM r WHERE ac IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) > 1),
 g8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY f, ac) AS gk FROM g) WHERE gk <= 8)
SELECT institution_id, ac AS audit_code, string_agg(name, ';' ORDER BY pos) AS names FROM
 (SELECT r.*, row_number() OVER (PARTITION BY r.institution_id, r.ac ORDER BY pos) AS nk FROM r JOIN g8 USING (institution_id, ac)) WHERE nk <= 5 GROUP BY 1, 2""")
def _(t):
    return Q.sample_code_groups(t.program, "pos").withColumn("names", F.array_join("names", ";"))


@query("a19_constraint_report", """
SELECT 'rating_range' AS rule, COUNT(*) FILTER (WHERE rating NOT BETWEEN 1 AND 4) AS violations FROM {review}
UNION ALL SELECT 'user_required', COUNT(*) FILTER (WHERE user_id IS NULL) FROM {review}
UNION ALL SELECT 'user_institution_unique', CAST(COALESCE(SUM(n), 0) AS BIGINT) FROM (SELECT COUNT(*) - 1 AS n FROM {review} GROUP BY user_id, institution_id)
UNION ALL SELECT 'institution_exists', COUNT(*) FROM {review} WHERE institution_id NOT IN (SELECT institution_id FROM {institution} WHERE type = 'college')""")
def _(t):
    return Q.constraint_report(
        t.review, {"rating_range": ~F.col("rating").between(1, 4), "user_required": F.col("user_id").isNull()},
        unique={"user_institution_unique": ["user_id", "institution_id"]},
        keys={"institution_exists": ("institution_id", t.institution.filter("type = 'college'"), "institution_id")})
