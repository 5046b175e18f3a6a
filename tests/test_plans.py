"""Plans that must hold at scale: what is pushed down, what is read, and which operators must not occur."""

import re

import pytest

from siftwork import catalog

catalog.load()


def plan(spark, data, name):
    return catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned_and_filtered(spark, data):
    text = plan(spark, data, "s1_table_scan")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(l_returnflag,R\)", text)
    assert "l_extendedprice" not in text and "l_shipdate" not in text


@pytest.mark.parametrize("name", ["n8_dataset_urls", "n11_numbers", "g1_g2_source_urls", "v1_to_v10_issues", "p4_search", "p12_filter_algebra", "x1_csv_lines", "d2_text_fold", "n5_clean_text"])
def test_row_local_work_has_no_exchange(spark, data, name):
    text = plan(spark, data, name)
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


@pytest.mark.parametrize("name", ["p11_by_source", "z1_range_join", "z2_asof_join", "w1_w2_w3_scores", "d13_d14_d15_d16_pairs", "e3_citations", "j1_j2_j7_nested_view", "g15_lifecycle", "pages_by_host", "s3_collected_sources"])
def test_no_cross_joins(spark, data, name):
    text = plan(spark, data, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["p11_by_source", "p1_tenant"])
def test_semi_joins(spark, data, name):
    assert "LeftSemi" in plan(spark, data, name)


@pytest.mark.parametrize("name", ["q11_latest_child", "s3_collected_sources", "t5_live_fold", "w1_w2_w3_scores", "g15_lifecycle"])
def test_aggregates_are_combined_before_the_shuffle(spark, data, name):
    text = plan(spark, data, name)
    assert "partial_" in text and "Window" not in text


def test_top_k_keeps_few_rows(spark, data):
    assert "TakeOrderedAndProject" in plan(spark, data, "l5_l6_l7_sorted")


def test_what_matching_wrote_is_not_broadcast(spark):
    """A file's size says little of its rows, so no join with it goes by way of the driver."""
    from siftwork.operators import match

    rows = match.settled(spark.range(100).withColumnRenamed("id", "rec_idx"))
    text = spark.range(100).withColumnRenamed("id", "rec_idx").join(rows.groupBy("rec_idx").count(), "rec_idx")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in text and "SortMergeJoin" in text


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """Joins of many rows get more tasks than a shuffle has by itself, all by one partitioning; the result is the same."""
    from pyspark.sql import functions as F

    from siftwork.operators import provenance, runs
    from siftwork.sources import tables

    evidence = spark.range(6000).select((F.col("id") % 2000).alias("rec_idx"), F.col("id").alias("evidence_id"), F.when(F.col("id") % 3 > 0, "a").alias("field"), F.lit("is x").alias("snippet"))
    rows = spark.range(2000).select(F.col("id").alias("rec_idx"), F.lit("a").alias("field"), F.lit("is").alias("value"))
    steps = spark.range(6000).selectExpr("id % 2000 as run", "id as step", "'PENDING' as status", "'' as error_code", "'' as error_message")
    of, failures = steps.where("step < 2000").drop("step"), spark.range(5).selectExpr("id as run", "'E' as code", "'m' as message")
    made = lambda: [provenance.field_view(provenance.field_citations(rows, evidence)), runs.fail(of, steps, failures)[1]]
    few = [sorted(map(tuple, df.collect())) for df in made()]
    monkeypatch.setattr(tables.dealt, "__kwdefaults__", {"most": 100})
    many = made()
    assert [sorted(map(tuple, df.collect())) for df in many] == few
    assert all("hashpartitioning(" in (p := df._jdf.queryExecution().executedPlan().toString()) and ", 60)" in p for df in many)
