"""Scaling guards on physical plans."""

import pytest

import __spark_entry__ as se
from conftest import SF_SMALL

NATIVE = ["l2_distance", "profile_mean", "centroids", "paper_text", "latex_strip", "prompt_fill", "label_clean",
          "authors_split", "person_names", "id_tail", "safe_ids", "config_hash", "feed_window", "feed_recent",
          "run_date", "score_clamp", "cache_split", "cache_upsert", "ingest_counts"]


def _plan(df):
    df.write.format("noop").mode("overwrite").save()          # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_have_no_python_eval(spark, name):
    plan = _plan(se.queries()[name](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in plan


@pytest.mark.parametrize("name", ["assign_topk", "oversample", "samples", "knn_exact"])
def test_per_group_topk_is_limited_before_shuffle(spark, name):
    df = se.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("name", ["seq_ids", "batch_ids", "vector_append"])
def test_sequence_numbers_avoid_single_partition(spark, name):
    df = se.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    windows = [ln for ln in plan.splitlines() if "Window [" in ln]
    # the numbering window is partitioned by key range ...
    assert any("row_number() windowspecdefinition(_rng" in ln for ln in windows)
    # ... and the only unpartitioned window is the running sum over the per-range counts table
    for ln in windows:
        if "row_number()" not in ln:
            assert "sum(_cnt" in ln


def test_feed_window_pushes_filters(spark):
    df = se.queries()["feed_window"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), In(event_type" in plan
