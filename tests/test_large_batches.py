"""Lexical search of many queries, document by document, gives the rows of the plan that joins postings."""

import random

from pyspark.sql import functions as F

from quernstone.operators import lexical

WORDS = [f"w{k}" for k in range(40)]


def corpus(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(WORDS[min(int(rng.expovariate(0.2)), 39)] for _ in range(n))
    rows = [(k, text(rng.randrange(0, 4)), text(rng.randrange(0, 30)), rng.choice([True, False, None])) for k in range(300)]
    rows += [(1000 + k, "w1", rows[7][2], False) for k in range(30)] + [(2000, None, None, None)]
    docs = spark.createDataFrame(rows, "symbol_id int, name string, code string, is_test boolean").repartition(5)
    return docs, spark.createDataFrame([(f"q{k}", text(rng.randrange(1, 6)) + (" absent" if k % 9 == 0 else ""), k % 3 == 0) for k in range(50)], "query_id string, query string, intent boolean")


def test_a_large_batch_has_the_answers_of_the_joined_postings(spark, monkeypatch):
    docs, queries = corpus(spark)
    boosts = {"name": 4.0, "code": 1.0}
    for more in ({}, {"is_test": "is_test", "intent": "intent"}):
        monkeypatch.setattr(lexical, "WHOLE_QUERIES", 32)
        monkeypatch.setattr(lexical, "TILE_CELLS", 40 * 50)
        whole = lexical.search(docs, queries, 5, boosts, **more)
        monkeypatch.setattr(lexical, "WHOLE_QUERIES", 10**9)
        joined = lexical.search(docs, queries, 5, boosts, **more)
        assert whole.schema["id"].dataType == joined.schema["id"].dataType and set(whole.columns) == set(joined.columns)
        rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "id", "score").collect())
        assert rows(whole) == rows(joined) and len(rows(whole)) > 200


def test_a_large_batch_shuffles_no_postings(spark):
    docs, queries = corpus(spark)
    plan = lexical.search(docs, queries, 5, {"code": 1.0})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_holders_are_the_same_by_automaton_and_by_runs(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a b c d e f g h"), (2, "xa b c d e f gx"), (3, None), (4, "a b c")], "id int, text string")
    items = spark.createDataFrame([(1, "a b c d e f g"), (2, "b c"), (3, ""), (4, "é"), (5, "b c d e f g h")], "query_id int, item string")
    found = sorted(tuple(r) for r in lexical.holders(texts, items).collect())
    monkeypatch.setattr(lexical, "AUTOMATON_CHARS", 4)
    assert found == sorted(tuple(r) for r in lexical.holders(texts, items).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 4), (5, 1)]
    assert lexical.holders(texts, items.where(F.lit(False))).isEmpty()
