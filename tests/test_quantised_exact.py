"""Search by codes has the answers of exact search: beyond the candidates, among many equal vectors, and with documents whose flag is null."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import quantised, semantic
from quernstone.plans import catalog


def plain(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def scattered(spark):
    x = np.random.default_rng(4).normal(size=(4000, 32))
    rows = [(k, v.tolist(), None if k % 11 == 5 else k % 7 == 0) for k, v in enumerate(x)] + [(9000, None, False), (9001, [0.0] * 32, False)]
    return spark.createDataFrame(rows, "symbol_id long, embedding array<float>, is_test boolean").repartition(5).cache()


@pytest.mark.parametrize(("listed", "told", "flag"), [(10_000, 500_000, "is_test"), (10, 500_000, "is_test"), (10, 20, "is_test"), (10_000, 500_000, None), (10, 20, None)])
def test_codes_that_say_little_cost_time_and_no_answer(spark, scattered, monkeypatch, listed, told, flag):
    monkeypatch.setattr(quantised, "LISTED_IDS", listed)
    monkeypatch.setattr(quantised, "BROADCAST_IDS", told)
    book = quantised.fit(scattered, 32, 4)
    codes = quantised.encode(scattered, book, flag_col="is_test")
    asked = scattered.where("symbol_id % 500 = 1").select(F.col("symbol_id").alias("query_id"), "embedding", (F.col("symbol_id") % 1000 == 1).alias("intent"))
    want = plain(semantic.search(scattered, asked, 10, 32, "symbol_id", filtered="is_test"))
    assert plain(quantised.search(codes, book, scattered, asked, 10, flag_col=flag)) == want
    assert plain(quantised.search(codes.drop("near"), book, scattered, asked, 10, candidates=1, flag_col=flag)) == want


def test_codes_that_say_much_leave_most_vectors_unread(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 32))[rng.integers(0, 40, 4000)] + 0.1 * rng.normal(size=(4000, 32))
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "symbol_id long, embedding array<float>").cache()
    book = quantised.fit(vectors, 32, 16)
    asked = vectors.where("symbol_id = 7").select(F.lit(1).alias("query_id"), "embedding", F.lit(True).alias("intent"))
    want = plain(semantic.search(vectors, asked, 10, 32, "symbol_id"))
    codes = quantised.encode(vectors, book)
    assert quantised._reaching(codes, book, asked.toArrow(), {1: want[-1][3]}).count() < 400
    assert plain(quantised.search(codes, book, vectors, asked, 10)) == want


def test_the_query_has_the_rows_of_its_sql_among_copies_and_without_texts(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=(400, 64))
    order = np.random.default_rng(7).permutation(400)
    x[order[:200]] = x[10]  # more copies than candidates
    texts = [(k, None if k % 3 == 0 else "a test" if k % 5 == 0 else "text") for k in range(400)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, x[k].tolist()) for k in range(400)], "vec_id long, embedding array<float>").repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(f"SELECT query_id, rank, id, score FROM ({catalog.ORACLE['r2_quantised']})").fetchall()
    assert plain(catalog.QUERIES["r2_quantised"](spark, str(tmp_path))) == sorted(want)
