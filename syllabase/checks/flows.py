"""Whole jobs: rebuild from nested rows, refresh from several sources."""
from pyspark.sql import functions as F

from ..plans import refresh as R
from . import duck as D
from .matched import BEST_SQL, REG, cascade_sql
from .programmes import BY_ID, EXTRA_SQL, FLAGGED, GATED, NAME_RULES, PREPARED, RULED, merged_sql
from .registry import query


@query("m7_rebuild_catalog", f"""
WITH casc AS ({cascade_sql(False)}),
 fresh AS (SELECT new_key, (SELECT MAX(institution_id) FROM {{uni}}) + row_number() OVER (ORDER BY new_key) AS new_id FROM (SELECT DISTINCT new_key FROM casc WHERE new_key IS NOT NULL)),
 own AS (SELECT incoming_id, COALESCE(institution_id, new_id) AS institution_id FROM casc LEFT JOIN fresh USING (new_key)),
 p0 AS (SELECT o.institution_id, p.institution_id AS inc, p.pos, trim(regexp_replace(COALESCE(p.name, ''), '{D.SP}+', ' ', 'g')) AS name, COALESCE(p.global_specialty, 'Образовательные программы') AS g,
   CASE WHEN p.code IS NOT NULL THEN concat('6В', substr(p.code, 3)) END AS code, CASE WHEN p.cost > 0 THEN p.cost END AS cost, CASE WHEN p.duration BETWEEN 1 AND 10 THEN p.duration END AS duration
   FROM {{program}} p JOIN own o ON p.institution_id = o.incoming_id)
SELECT institution_id, g AS global_name, CASE WHEN code IS NULL THEN g ELSE concat(code, ' · ', g) END AS qualification_name, name, last(cost ORDER BY inc, pos) FILTER (WHERE cost IS NOT NULL) AS cost, last(duration ORDER BY inc, pos) FILTER (WHERE duration IS NOT NULL) AS duration
FROM p0 WHERE length(name) >= 2 GROUP BY institution_id, g, code, name""")
def _(t):
    """Rows of another source, matched with the institutions that are there, some of them new."""
    programs = t.program.withColumnRenamed("institution_id", "incoming_id")
    out = R.rebuild_catalog(t.incoming, programs, t.uni)
    level2 = out["level2"].select("qualification_id", "qualification_name", "global_id").join(out["level1"].select("global_id", "global_name"), "global_id")
    rows = out["links"].join(out["level3"], "specialization_id").join(level2, "qualification_id")
    return rows.select("institution_id", "global_name", "qualification_name", "name", "cost", "duration")


def over(sql, **tables):
    """A step's statement on other inputs than the given tables."""
    for role, other in tables.items():
        sql = sql.replace("{" + role + "}", other)
    return sql


REFRESHED = f"""
WITH best AS ({BEST_SQL}),
 listed AS (SELECT b.left_id AS institution_id, p.pos, p.name, p.code, p.global_specialty, p.qualification, p.cost, p.duration, 'listing' AS source
   FROM {{program}} p JOIN best b ON p.institution_id = b.right_id WHERE length(trim(p.name)) >= 3),
 official AS ({over(GATED, program=f"({EXTRA_SQL})")}),
 merged AS ({merged_sql("listed", "official")}),
 priced AS ({over(RULED, program="merged")}),
 final AS ({over(PREPARED, program="priced")} SELECT * FROM deduped)
SELECT * FROM ({over(FLAGGED, program="final")} SELECT institution_id, specs_count, with_cost, issue_rows, severity FROM report)"""


@query("m7_refresh_audit", REFRESHED)
def _(t):
    """The full chain of section 3.2 against the statements of its steps, each on the result of the one before."""
    listing = t.incoming.withColumnRenamed("incoming_id", "right_id")
    listed = t.program.withColumnRenamed("institution_id", "right_id")
    out = R.refresh(t.uni, t.sql(REG), listing=listing, listing_programs=listed, official=t.sql(EXTRA_SQL),
                    by_id=t.sql(BY_ID), name_rules=t.sql(NAME_RULES))
    return out["audit"].select("institution_id", "specs_count", "with_cost", "issue_rows", "severity").orderBy(F.col("severity").desc(), "institution_id")
