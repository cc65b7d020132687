"""Models behind columns: loaded once a task, asked in batches, and checked."""

import pytest
from pyspark.sql import functions as F

from quernstone.operators import models
from quernstone.plans.engine import Engine, hashing_embedder


def test_batches_are_of_like_length_and_in_order():
    seen = []

    def ask(texts):
        seen.append([len(t) for t in texts])
        return [[len(t), 1.0] for t in texts]

    texts = ["a" * k for k in (9, 1, 5, 7, 3, 2, 8)]
    out = models.in_batches(ask, texts, [len(t) for t in texts], 3, 2)
    assert out[:, 0].tolist() == [9, 1, 5, 7, 3, 2, 8] and seen == [[1, 2, 3], [5, 7, 8], [9]]
    assert models.in_batches(ask, [], [], 3, 2).shape == (0, 2)


@pytest.mark.parametrize("answer", [lambda t: [[1.0]] * (len(t) + 1), lambda t: [[1.0, 2.0]] * len(t), lambda t: [[float("nan")]] * len(t), lambda t: ["x"] * len(t), lambda t: [True] * len(t), lambda t: [[1.0], [1.0, 2.0]][: len(t)]])
def test_wrong_results_are_refused(answer):
    with pytest.raises(models.ModelError):
        models.in_batches(answer, ["a", "b"], [1, 1], 8, 1)


def test_columns_of_models(spark):
    def load():
        return lambda texts: [[float(len(t)), float(t.count("a"))] for t in texts]

    df = spark.createDataFrame([(k, None if k == 3 else "a" * k + "b") for k in range(8)], "k int, t string").repartition(3)
    rows = {r["k"]: r["v"] for r in df.select("k", models.embedder(load, 2, 2)(F.col("t")).alias("v")).collect()}
    assert rows == {k: None if k == 3 else [k + 1.0, float(k)] for k in range(8)}
    pairs = df.select("k", models.scorer(lambda: lambda ps: [len(d) - len(q) for q, d in ps], 3)(F.lit("xx"), F.col("t")).alias("s"))
    assert {r["k"]: r["s"] for r in pairs.collect()} == {k: None if k == 3 else k - 1.0 for k in range(8)}
    with pytest.raises(Exception, match="results for"):
        df.select(models.embedder(lambda: lambda texts: [], 2)(F.col("t"))).collect()
    for bad in (lambda: models.embedder(load, 0), lambda: models.embedder(load, 2, 0), lambda: models.scorer(load, 0)):
        with pytest.raises(ValueError):
            bad()


def test_an_engine_with_models(spark, tmp_path):
    schema = "symbol_id int, repository_id int, file_id int, repository string, language string, path string, is_test boolean, name string, qualified_name string, kind string, start_line int, end_line int, code string"
    rows = [(k, 1, 1, "r", "python", f"f{k}.py", False, w, w, "function", k, k, f"def {w}(): pass") for k, w in enumerate(("alpha", "beta", "gamma", "delta"), 1)]

    def load():
        return lambda texts: [[1.0 + sum(map(ord, t.lower())) % 7, 1.0 + len(t) % 5, float("beta" in t.lower())] for t in texts]

    engine = Engine(spark, str(tmp_path / "e"), dims=3, embedder=models.embedder(load, 3), reranker=models.scorer(lambda: lambda ps: [float(q.split()[-1] in d) for q, d in ps]))
    docs = spark.createDataFrame(rows, schema)
    engine.index(docs.withColumn("embedding", engine.embed(F.col("code"))))
    assert engine.search("beta", 2)["results"][0]["name"] == "beta"
    again = engine.reranked(engine.batch(["alpha beta gamma"]), 2).orderBy("final_rank").collect()
    assert again[0]["name"] == "gamma" and again[0]["reranker_score"] == 1.0


def test_the_hashing_embedder_in_either_precision(spark):
    df = spark.createDataFrame([("one two two",), ("",), (None,)], "t string")
    for kind, name in (("float", "array<float>"), ("double", "array<double>")):
        out = df.select(hashing_embedder(16, kind)(F.col("t")).alias("v"))
        assert out.dtypes[0][1] == name
        v = [r["v"] for r in out.collect()]
        assert sum(x * x for x in v[0]) == pytest.approx(1, abs=1e-6) and len(v[1]) == 16
