"""Plan shape: no nested loops in matching joins, pushed filters, pruned columns, checked broadcasts."""

import pytest
from harness import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corrobora.session import broadcast_checked, estimated_bytes, spread, values_frame
from corrobora.sources.tables import load

QUERIES = entry.queries()
MATCHING = [
    "flagship_top_evidence", "jn3_domain_score", "jn4_identifiers", "jn5_phonetic", "jn6_one_edit", "jn7_names",
    "jn7_substring", "jn8_window", "jn8_window_counts", "jn13_hash", "sim1_cosine", "sim2_similar_titles", "sc1_relevance",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", MATCHING)
def test_no_nested_loops(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", MATCHING)
def test_no_nested_loops_without_broadcast(spark, name):
    """The same joins stay equality joins when nothing may be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES[name](spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_filter_reaches_scan(spark):
    plan = plan_of(QUERIES["flt3_filter_batch"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,O)" in plan


def test_columns_are_pruned(spark):
    plan = plan_of(QUERIES["ag3_overall_score"](spark, SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan


def test_top_k_is_limited_before_the_shuffle(spark):
    plan = plan_of(QUERIES["wn1_rank_evidence"](spark, SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_broadcast_hint_needs_a_small_estimate(spark):
    small = values_frame(spark, [("a", 1)], "k STRING, v INT")
    big = load(spark, SMALL, "lineitem")
    assert estimated_bytes(small) < 1000
    assert "ResolvedHint" in broadcast_checked(small)._jdf.queryExecution().analyzed().toString() or "broadcast" in broadcast_checked(
        small
    )._jdf.queryExecution().logical().toString().lower()
    assert broadcast_checked(big, limit=1000) is big


def test_spread_leaves_wide_inputs_alone(spark):
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide, "id") is wide
    assert spread(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_results_do_not_depend_on_partitioning(spark):
    from corrobora.operators.ranking import interleaved_topk, top_tokens

    docs = load(spark, SMALL, "documents")
    a = top_tokens(docs, "doc_id", "text").orderBy("doc_id", "ordinal").collect()
    b = top_tokens(docs.repartition(13, F.rand(1)), "doc_id", "text").orderBy("doc_id", "ordinal").collect()
    assert a == b
    plan = spark.range(200).select(
        (F.col("id") % 3).alias("c"), (F.col("id") % 4 + 1).alias("tier"), F.concat(F.col("id") % 4, F.lit("-"), F.col("id") % 5).alias("cls"), F.col("id").alias("seq")
    )
    one = interleaved_topk(plan, "c", 10).orderBy("c", "pick").collect()
    two = interleaved_topk(plan.repartition(7), "c", 10).orderBy("c", "pick").collect()
    assert one == two
