"""Grouping helpers against brute force, with one key that holds a third of the rows."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from hostloom.operators import keyed as K
from hostloom.operators.sites import duplicate_copies


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        rows.append((i, key, rng.randrange(500), rng.choice([-3.5, 0.0, 0.001, 17.25, 99.0, 1e6]) * rng.random(), rng.randrange(5000)))
    return spark.createDataFrame(rows, "id long, k string, n int, v double, t long").cache()


def test_keep_first_and_last(skewed):
    first = {r["k"]: (r["n"], r["id"], r["c"]) for r in K.keep_first(skewed, ["k"], F.col("n"), F.col("id"), count_as="c").collect()}
    last = {r["k"]: r["id"] for r in K.keep_last(skewed, ["k"], F.col("n"), F.col("id")).collect()}
    rows = skewed.collect()
    for key in {r["k"] for r in rows}:
        mine = [r for r in rows if r["k"] == key]
        low = min(mine, key=lambda r: (r["n"], r["id"]))
        assert first[key] == (low["n"], low["id"], len(mine))
        assert last[key] == max(mine, key=lambda r: (r["n"], r["id"]))["id"]


def test_keep_first_is_idempotent(skewed):
    once = K.keep_first(skewed, ["k"], F.col("id"))
    twice = K.keep_first(once, ["k"], F.col("id"))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


@pytest.mark.parametrize("chunk", [1, 50, 10_000])
def test_previous_row_equals_lag(skewed, chunk):
    got = K.previous_row(skewed, ["k"], ["t", "id"], ["v", "id"], F.floor(F.col("t") / chunk))
    w = Window.partitionBy("k").orderBy("t", "id")
    want = skewed.withColumn("prev_v", F.lag("v").over(w)).withColumn("prev_id", F.lag("id").over(w))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def brute(values, share):
    ordered = sorted(values)
    return ordered[min(int(len(ordered) * share), len(ordered) - 1)]


def test_percentiles_equal_a_sort(skewed):
    shares = {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}
    got = {r["k"]: r for r in K.floor_index_percentiles(skewed, ["k"], "v", shares).collect()}
    rows = skewed.collect()
    for key, r in got.items():
        mine = [x["v"] for x in rows if x["k"] == key]
        assert r["n"] == len(mine)
        for name, share in shares.items():
            assert r[name] == brute(mine, share)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=60))
def test_percentiles_of_any_numbers(spark, values):
    df = spark.createDataFrame([(1, float(v)) for v in values], "g int, v double")
    row = K.floor_index_percentiles(df, ["g"], "v", {"p": 0.73}).collect()[0]
    assert row["p"] == brute([float(v) for v in values], 0.73)


def test_floor_index_is_not_interpolated(spark):
    df = spark.range(20).select(F.lit(1).alias("g"), F.col("id").alias("v"))
    assert K.floor_index_percentiles(df, ["g"], "v", {"p": 0.95}).collect()[0]["p"] == 19


def test_hot_copies_are_salted_and_whole(skewed):
    plain = duplicate_copies(skewed.select("id", "k"), "id", "k")
    salted = duplicate_copies(skewed.select("id", "k"), "id", "k", hot_rows=10)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect()))
    assert plain.count() == skewed.count() - skewed.select("k").distinct().count()


def test_rule_tables_have_a_limit(spark):
    with pytest.raises(ValueError):
        K.rule_table(spark, [(i,) for i in range(K.MAX_RULE_ROWS + 1)], "x int")
