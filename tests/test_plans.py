"""Plans that must hold when the tables grow."""

import pytest
from pyspark.sql import functions as F

from paperloom.plans.catalog import QUERIES
from paperloom.sources.tables import load, vector_table

CHECKED = [
    "proto_topk", "segment_topk", "group_candidates_merged", "group_chunk_topk", "group_medoid", "group_mean_vector",
    "nearest_centroid", "upsert_latest", "replace_by_document", "cascade_regroup", "change_gate", "debounce_sessions",
    "version_changes", "commit_enrichment", "normalize_jira", "window_chunks", "citation_map",
]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_pair_join_and_no_single_task(spark, sf, name):
    plan = _plan(QUERIES[name](spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        assert bad not in plan


@pytest.mark.parametrize("name", ["proto_topk", "segment_topk", "group_chunk_topk"])
def test_topk_is_cut_before_the_shuffle(spark, sf, name):
    plan = _plan(QUERIES[name](spark, sf))
    assert plan.count("WindowGroupLimit") >= 2


def test_search_scans_without_a_shuffle_of_the_vectors(spark, sf):
    plan = _plan(QUERIES["group_chunk_topk"](spark, sf))
    assert plan.count("Exchange") == 1
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in plan


def test_group_filter_reaches_the_scan(spark, sf):
    rows = vector_table(load(spark, sf, "embeddings"), [3, 7], group="label")
    assert "PushedFilters: [In(label, [3,7])]" in _plan(rows.select("vec_id"))
    assert {r.label for r in rows.collect()} == {3, 7}


def test_vectors_are_summed_before_the_shuffle(spark, sf):
    plan = _plan(QUERIES["group_mean_vector"](spark, sf))
    above, _, below = plan.partition("Exchange")
    assert "MapInArrow" in above and "MapInArrow" in below and plan.count("Exchange") == 1


def test_chunks_are_made_in_one_pass(spark, sf):
    plan = _plan(QUERIES["chunk_stats"](spark, sf))
    assert plan.count("FileScan") == 1 and "isnotnull(CASE" not in plan
    assert plan.count("Exchange") <= 1


def test_small_sides_are_not_forced_to_broadcast(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(QUERIES["replace_by_document"](spark, sf))
        assert "BroadcastHashJoin" not in plan
        assert QUERIES["buffered_distinct_docs"](spark, sf).where(F.col("n_buffered") > 0).count() == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
