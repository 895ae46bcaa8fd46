"""Time the headline queries once each, after a warm-up, and print one JSON line.

BENCH_SF_DIR: data folder; BENCH_CPUS: local threads; BENCH_QUERIES: comma list or ``all``.
"""
from __future__ import annotations

import json
import os
import sys
import time

from syllabase.checks import QUERIES
from syllabase.session import local_session

HEADLINE = (
    "m7_rebuild_catalog m7_refresh_audit "
    "a1_rating_summary a1_top_rated a3_dashboard a5_multi_child a9_activity_months a10_audit a11_audit_summary a17_event_board "
    "j1_link_join j2_catalog_tree j3_institution_index j5_institutions_for j8_prune_tree j10_match_cascade j11_best_match "
    "j14_merge_programs j15_apply_overrides j17_names_to_ids w1_clean_links w2_dedupe_programs w3_keep_better w4_top_links "
    "w6_compact_answers h3_text_programs h4_page_contacts m1_tree_level3 m2_upsert_links m3_merge_links m4_purge "
    "n1_parse_money n7_validate_payload o1_paginate s4_nest_links t2_status_notices t4_activity_stream x17_title_score"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    # Compile and warm up on the smallest data, so the times show the work on the data.
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    for name in names if os.path.isdir(small) else []:
        QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    for name in names:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - started, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total" if not chosen else "selected_queries_total",
        "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
