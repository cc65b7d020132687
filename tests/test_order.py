"""Places and order statistics of large groups: far values, long integers, one group of all rows, many equal values."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from quernstone.functions.rank import dealt, placed
from quernstone.operators import evaluation


def test_long_integers_and_far_values_have_their_places(spark):
    big = 2**53
    keys = [big + k for k in (3, 1, 0, 2)] + [10**15 * 9, -(2**63), 2**63 - 1] + list(range(500))
    df = spark.createDataFrame([(1, v, k) for k, v in enumerate(keys)], "g int, v long, k int").repartition(6)
    want = {k: n + 1 for n, (_, k) in enumerate(sorted((v, k) for k, v in enumerate(keys)))}
    for size in (10**6, 40):
        assert {r["k"]: r["place"] for r in placed(df, "g", F.col("v"), "k", bucket_rows=size).collect()} == want


def test_a_far_value_does_not_undo_the_buckets(spark):
    df = spark.range(20_000).select((F.lit("all")).alias("g"), F.when(F.col("id") == 7, 1e15).otherwise(F.rand(3)).alias("v"), "id")
    rows, cut = dealt(df, ["g"], [F.col("v"), F.col("id")], 500)
    sizes = [r["count"] for r in rows.groupBy("_bucket").count().collect()]
    assert cut and sum(sizes) == 20_000 and len(sizes) > 30 and max(sizes) < 2500


def test_equal_keys_are_cut_by_what_breaks_their_ties(spark):
    df = spark.range(10_000).select(F.lit(1).alias("g"), F.lit(5.0).alias("v"), "id")
    rows, _ = dealt(df, ["g"], [F.col("v"), F.col("id")], 500)
    assert max(r["count"] for r in rows.groupBy("_bucket").count().collect()) < 2500
    assert placed(df, "g", F.col("v"), "id", bucket_rows=500).where("place <> id + 1").isEmpty()


@pytest.mark.parametrize("size", [10**6, 7, 1])
def test_summaries_are_those_of_sorted_values(spark, size):
    rng = random.Random(8)
    values = {"a": [rng.choice([1.5, 2.5, 1e12, -3.0]) for _ in range(101)], "b": [rng.random() for _ in range(150)], None: [4.0, 8.0], "none": [None, None]}
    rows = [(g, v) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    out = {r["g"]: r for r in evaluation.latency_summary(df, F.col("v"), "g", bucket_rows=size).collect()}
    assert set(out) == set(values) and out["none"]["median"] is None and out["none"]["p95"] is None and out["none"]["n"] == 2
    for g in ("a", "b", None):
        s = sorted(values[g])
        assert out[g]["median"] == pytest.approx(statistics.median(s), abs=1e-6)
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            assert out[g][name] == pytest.approx(s[int((len(s) - 1) * p)], abs=1e-6)
    whole = evaluation.latency_summary(df, F.col("v"), bucket_rows=size).first()
    every = sorted(v for _, v in rows if v is not None)
    assert whole["median"] == pytest.approx(statistics.median(every), abs=1e-6) and whole["p99"] == pytest.approx(every[int((len(every) - 1) * 0.99)], abs=1e-6)


def test_only_the_bucket_that_has_the_element_is_sorted(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), F.rand(1).alias("v"))
    plan = evaluation.floor_percentiles(df, F.col("v"), {"p": 0.5}, "g", bucket_rows=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan
    got = evaluation.floor_percentiles(df, F.col("v"), {"p": 0.5}, "g", bucket_rows=100).first()["p"]
    assert got == sorted(r["v"] for r in df.collect())[int(4999 * 0.5)]
