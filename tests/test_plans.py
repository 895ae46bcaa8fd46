"""Shape of the physical plans."""
import pytest

from syllabase.checks import ORACLES, QUERIES
from syllabase.checks.roles import Tables

SMALL = "/root/testdata/sf0.001"
JOBS = [
    "a1_rating_summary", "a10_audit", "j1_link_join", "j10_match_cascade", "j11_best_match", "j14_merge_programs",
    "j15_apply_overrides", "j17_names_to_ids", "j2_catalog_tree", "j3_institution_index", "j8_prune_tree", "m1_tree_level3", "m2_upsert_links", "m4_purge",
    "m5_repair_links", "s4_nest_links", "t2_status_notices", "w1_clean_links", "w2_dedupe_programs", "w6_compact_answers",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOBS)
def test_no_pairwise_joins(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["w4_top_links", "o5_sample_issues"])
def test_top_k_is_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, SMALL))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["s7_table_scan"](spark, SMALL))
    assert "GreaterThanOrEqual(o_orderdate" in text and "o_orderpriority" not in text
    text = plan(QUERIES["a9_activity_months"](spark, SMALL))
    assert "GreaterThanOrEqual(o_orderdate" in text and "o_totalprice" not in text


def test_page_is_taken_without_a_global_sort_of_all_columns(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["o1_paginate"](spark, SMALL))


def test_every_oracle_has_a_query_and_reads_given_tables():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) <= {"m7_refresh_audit"}


def test_role_views_are_lazy(spark):
    assert Tables(spark, SMALL).link.columns == ["institution_id", "specialization_id", "cost", "duration", "created_at"]
