"""Plan checks: what reaches the scan, and nothing that gathers rows in one task."""

import re

import pytest

from laggard.plans import catalog

NO_PYTHON = ["skew_labels", "job_mart", "event_skew_labels", "early_features_sweep", "evaluate_models", "policy_comparison", "score_bands", "clean_events"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_PYTHON)
def test_no_python_in_plan(spark, small, name):
    text = plan(catalog.QUERIES[name](spark, small))
    assert "Python" not in text and "InPandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["time_split", "template_split", "stratified_split", "rolling_splits", "cv_folds"])
def test_splits_do_not_shuffle_rows(spark, small, name):
    text = plan(catalog.QUERIES[name](spark, small))
    assert "Exchange" not in text and "Join" not in text and "Window" not in text


@pytest.mark.parametrize("name", ["early_features", "skew_labels", "event_skew_labels"])
def test_no_single_task_stage(spark, small, name):
    """One task may only end an aggregate whose partial results it gets."""
    lines = plan(catalog.QUERIES[name](spark, small)).splitlines()
    after = [lines[i + 1] for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert all("partial_" in line for line in after)


def test_labels_read_two_columns_and_shuffle_once(spark, small):
    text = plan(catalog.QUERIES["skew_labels"](spark, small))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in text
    assert "GreaterThan(l_extendedprice,0.0)" in text
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1


def test_mart_counts_before_it_shuffles(spark, small):
    text = plan(catalog.QUERIES["job_mart"](spark, small))
    assert "partial_count" in text and "partial_stddev_samp" in text
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 3
