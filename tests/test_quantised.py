"""Quantised vectors: recall against exact search, filters, vectors without codes, and the engine with stored codes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import quantised, semantic
from quernstone.plans.engine import Engine


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 32))[rng.integers(0, 12, 3000)] + 0.7 * rng.normal(size=(3000, 32))
    rows = [(k, v.tolist(), k % 7 == 0) for k, v in enumerate(x)] + [(9000, None, False), (9001, [1.0], False), (9002, [0.0] * 32, False), (9003, [float("nan")] * 32, False)]
    return spark.createDataFrame(rows, "symbol_id int, embedding array<float>, is_test boolean").repartition(6).cache()


def asked(vectors):
    return vectors.where("symbol_id % 60 = 1 AND symbol_id < 3000").select(F.col("symbol_id").alias("query_id"), "embedding", (F.col("symbol_id") % 120 == 1).alias("intent"))


def test_recall_and_filter(spark, vectors):
    book = quantised.fit(vectors, 32, 8)
    codes = quantised.encode(vectors, book, flag_col="is_test")
    assert codes.count() == 3000 and codes.where("length(code) <> 8").isEmpty()
    stored = quantised.codebook_of(quantised.codebook_rows(spark, book))
    assert np.array_equal(stored, book)
    q = asked(vectors)
    want = {(r["query_id"], r["id"]) for r in semantic.search(vectors, q, 10, 32, "symbol_id", filtered="is_test").collect()}
    got = quantised.search(codes, book, vectors, q, 10).collect()
    pairs = {(r["query_id"], r["id"]) for r in got}
    assert len(got) == len(pairs) == len(want) and len(pairs & want) / len(want) >= 0.95
    assert not any(r["id"] % 7 == 0 for r in got if r["query_id"] % 120 != 1) and any(r["id"] % 7 == 0 for r in got)
    exact = {(r["query_id"], r["id"]): r["score"] for r in semantic.search(vectors, q, 3000, 32, "symbol_id", filtered="is_test").collect()}
    assert all(r["score"] == pytest.approx(exact[r["query_id"], r["id"]], abs=2e-6) for r in got)
    # with all documents as candidates the answers are the exact ones
    assert {(r["query_id"], r["id"]) for r in quantised.search(codes, book, vectors, q, 10, candidates=300).collect()} == want


def test_few_and_no_vectors(spark, vectors):
    one = vectors.where("symbol_id = 5")
    book = quantised.fit(one, 32, 4)
    assert [(r["id"], r["score"]) for r in quantised.search(quantised.encode(one, book), book, one, one.select(F.lit(1).alias("query_id"), "embedding", F.lit(True).alias("intent")), 3).collect()] == [(5, 1.0)]
    none = vectors.limit(0)
    book = quantised.fit(none, 32, 4)
    assert quantised.search(quantised.encode(none, book), book, none, asked(vectors), 3).count() == 0
    assert quantised.search(quantised.encode(one, book), book, one, asked(none), 3).count() == 0
    with pytest.raises(ValueError):
        quantised.fit(vectors, 32, 5)


def test_an_engine_with_codes_syncs_and_searches(spark, tmp_path):
    schema = "symbol_id int, repository_id int, file_id int, repository string, language string, path string, is_test boolean, name string, qualified_name string, kind string, start_line int, end_line int, code string, embedding array<float>"
    rng = np.random.default_rng(3)
    row = lambda k, path: (k, 1, 1, "r", "python", path, False, f"name{k}", f"name{k}", "function", k, k, f"code {k}", rng.normal(size=16).tolist())
    rows = [row(k, f"f{k % 20}.py") for k in range(1, 300)]
    engines = [Engine(spark, str(tmp_path / n), dims=16, code_bytes=b) for n, b in (("coded", 8), ("exact", None))]
    feed = spark.createDataFrame([(0, "M", None, "f3.py")], "ordinal int, status string, old_path string, path string")
    fresh = spark.createDataFrame([row(1000, "f3.py")], schema)
    for e in engines:
        e.index(spark.createDataFrame(rows, schema))
        e.sync(1, feed, fresh)
    coded, exact = engines
    assert {r["id"] for r in coded.store.read("codes").collect()} == {r["symbol_id"] for r in exact.store.read().collect()}
    q = coded.batch(["name7 code", "code 30 name30", "anything"])
    a, b = ({(r["query_id"], r["id"]) for r in e.semantic(q, 10).collect()} for e in engines)
    assert len(a & b) / len(b) > 0.9
    assert coded.search("name7 code", 5)["results"][0]["qualified_name"] == exact.search("name7 code", 5)["results"][0]["qualified_name"]
