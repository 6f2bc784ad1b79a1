"""The plans are the ones we want: pushdown, pruning, partial work before shuffles, no Python."""

import re

from pyspark.sql import functions as F

from hostloom.operators import change, keyed, logs
from hostloom.plans import report, roles


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_what_is_used(spark, small):
    text = plan(logs.latency_percentiles(roles.searches(spark, small), ["kind"]))
    assert re.search(r"ReadSchema: struct<event_type:string,value:double>", text)
    text = plan(roles.table(spark, small, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in text


def test_top_per_group_limits_before_the_shuffle(spark, small):
    text = plan(logs.bot_totals(roles.bot_hits(spark, small)))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_top_k_is_not_a_full_sort(spark, small):
    text = plan(report.category_counts(roles.sites(spark, small)))
    assert "TakeOrderedAndProject" in text


def test_keyed_picks_combine_on_the_map_side(spark, small):
    df = keyed.keep_first(roles.table(spark, small, "orders"), ["o_custkey"], F.col("o_orderkey"))
    text = plan(df)
    assert "partial_min_by" in text and "Window" not in text


def test_lag_never_holds_a_whole_key(spark, small):
    text = plan(change.price_drops(roles.price_log(spark, small)))
    assert text.count("Window") >= 2 and "partial_max_by" in text
    assert re.search(r"windowspecdefinition\(url#\d+, _chunk#\d+", text)


def test_percentiles_shrink_before_windows(spark, small):
    text = plan(logs.latency_percentiles(roles.searches(spark, small), ["kind"]))
    assert "partial_count" in text and "percentile" not in text
