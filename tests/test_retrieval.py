import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.functions.rank import floor_percentile, min_max
from quernstone.functions.vector import is_valid
from quernstone.operators import evaluation, fusion


def _norms(spark, values):
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(values)], "query_id int, k int, score double")
    return [r["n"] for r in df.select("k", min_max(F.col("score"), "query_id").alias("n")).orderBy("k").collect()]


def test_min_max(spark):
    assert _norms(spark, [-7.5, 0.0, 12.5, 2.5]) == [0, 0.375, 1, 0.5]
    assert _norms(spark, [0.25, 0.25, 0.25]) == [1, 1, 1] == [*_norms(spark, [-3.0]), 1, 1]
    for bad in ([5, math.nan, 6], [-math.inf, 0], [-9e307, 1, 9.5e307]):
        with pytest.raises(Exception, match="finite"):
            _norms(spark, bad)


def test_fusion_order_and_scores(spark):
    """Against the formula, in plain Python."""
    lexical = {"p": 7.0, "q": 4.0, "r": 3.5, "s": 1.0}
    vectors = {"r": 0.81, "t": 0.77, "p": 0.52, "u": 0.49}
    cols = "query_id int, id string, score double, rank int"
    side = lambda d: fusion.normalised(spark.createDataFrame([(1, k, v, n + 1) for n, (k, v) in enumerate(d.items())], cols))
    scaled = lambda d: {k: (v - min(d.values())) / (max(d.values()) - min(d.values())) for k, v in d.items()}
    for weight in (0.0, 0.35, 0.6, 1.0):
        a, b = scaled(lexical), scaled(vectors)
        order = [*lexical, *(k for k in vectors if k not in lexical)]
        want = {k: round(weight * b.get(k, 0) + (1 - weight) * a.get(k, 0), 8) for k in order}
        rows = fusion.fuse(side(lexical), side(vectors), ["id"], weight).orderBy("rank").collect()
        assert [(r["id"], r["score"]) for r in rows] == sorted(want.items(), key=lambda x: (-x[1], order.index(x[0])))
    assert [fusion.depth(k) for k in (1, 5, 6, 25)] == [20, 20, 24, 100] and [fusion.rerank_depth(k) for k in (1, 10, 12)] == [30, 30, 36]
    for bad in (-1e-9, 1.0001, False, "0.5", None):
        with pytest.raises(ValueError):
            fusion.check_weight(bad)


def test_ties_keep_lexical_order(spark):
    cols = "query_id int, id string, score double, rank int"
    b = fusion.normalised(spark.createDataFrame([(1, "x", 1.0, 1), (1, "y", 1.0, 2)], cols))
    s = fusion.normalised(spark.createDataFrame([(1, "z", 1.0, 1)], cols))
    assert [r["id"] for r in fusion.fuse(b, s, ["id"], 0.5).orderBy("rank").collect()] == ["x", "y", "z"]


def test_duplicate_keys_keep_first_place_and_last_values(spark):
    rows = fusion.collapse(spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2), (1, "a", 0.1, 3)], "query_id int, id string, norm double, rank int"), ["id"])
    assert {(r["id"], r["rank"], r["norm"]) for r in rows.collect()} == {("a", 1, 0.1), ("b", 2, 0.8)}


def test_rerank_is_stable_and_refuses_nonfinite_scores(spark):
    df = spark.createDataFrame([(1, "a", 1, 0.5), (1, "b", 2, 0.9), (1, "c", 3, 0.5)], "query_id int, id string, rank int, s double")
    assert [r["id"] for r in fusion.rerank(df, F.col("s"), 3).orderBy("final_rank").collect()] == ["b", "a", "c"]
    with pytest.raises(Exception, match="finite"):
        fusion.rerank(df.withColumn("s", F.lit(math.nan)), F.col("s"), 3).collect()


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 1), (2, 3), (3, 5), (4, 10), (5, None)], "query_id int, rank int")
    m = evaluation.metrics(rows).first()
    assert (m["recall_1"], m["recall_3"], m["recall_5"], m["recall_10"], m["mrr"]) == (0.2, 0.4, 0.6, 0.8, round(49 / 150, 6))
    assert evaluation.quality_gate(0.88, 0.88) and not evaluation.quality_gate(0.8799999, 0.88)


def test_best_weight_prefers_full_recall_then_smaller_weight(spark):
    cols = "weight double, recall_1 double, recall_3 double, recall_5 double, recall_10 double, mrr double, cases long"
    rows = [(0.5, 0.1, 0.2, 0.3, 0.9, 0.9, 5), (0.6, 0.1, 0.2, 0.3, 1.0, 0.4, 5), (0.7, 0.1, 0.2, 0.3, 1.0, 0.4, 5)]
    assert evaluation.best_weight(spark.createDataFrame(rows, cols)).first()["weight"] == 0.6


def test_percentile_is_an_element(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 11)], "v double")
    assert df.agg(floor_percentile(F.col("v"), 0.95)).first()[0] == 9.0


def test_percentiles_of_groups_with_and_without_values(spark):
    rows = [("a", float(v)) for v in range(1, 11)] * 3 + [("a", None), ("b", None), (None, 4.0), ("c", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {"a": (5.0, 10.0), "b": (None, None), None: (4.0, 4.0), "c": (7.0, 7.0)}
    got = {r["g"]: (r["p50"], r["p99"]) for r in evaluation.latency_summary(df, F.col("v"), "g").collect()}
    assert got == want
    assert {r["g"]: r["p"] for r in df.groupBy("g").agg(floor_percentile(F.col("v"), 0.5).alias("p")).collect()} == {k: v[0] for k, v in want.items()}
    assert evaluation.latency_summary(df, F.col("v")).first()["p50"] == 5.0


def test_places_in_groups_cut_into_buckets(spark):
    from quernstone.functions.rank import placed

    rows = [(("x", "y", None)[k % 3], None if k % 11 == 0 else float((k * 7) % 13), k) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, v double, k int").repartition(5)
    want, count = {}, {}
    for g, _, k in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2])):
        count[g] = want[k] = count.get(g, 0) + 1
    for size in (10**6, 30, 5, 1):
        assert {r["k"]: r["place"] for r in placed(df, "g", F.col("v"), "k", bucket_rows=size).collect()} == want
    assert {r["place"] for r in placed(df.where("v = 3"), "g", F.col("v"), "k").where("g = 'x'").collect()} == set(range(1, 1 + df.where("v = 3 AND g = 'x'").count()))


def test_evaluated_results_are_checked(spark):
    cols = "query_id int, repository string, qualified_name string, rank long"
    good = [(1, "r", "q", 1), (1, "r", "z", 2), (2, "r", "z", 1)]
    cases = spark.createDataFrame([(1, "r", "z"), (2, "r", "none")], "query_id int, repository string, qualified_name string")
    keys = ["repository", "qualified_name"]
    rows = {r["method"]: (r["recall_1"], r["recall_3"], r["mrr"]) for r in evaluation.by_method({"a": spark.createDataFrame(good, cols), "b": spark.createDataFrame(good[:1], cols)}, cases, keys).collect()}
    assert rows == {"a": (0.0, 0.5, 0.25), "b": (0.0, 0.0, 0.0)}
    for bad in ((3, "r", "q", 11), (3, " ", "q", 1), (3, "r", None, 1)):
        with pytest.raises(Exception, match="rows|identity"):
            evaluation.checked_results(spark.createDataFrame([*good, bad], cols), keys).collect()


PATHS = {"test/a.py": True, "src\\Tests\\x.py": True, "a/test_x.py": True, "a/x_test.py": True, "latest/x.py": False, "contest.py": False}


def test_test_paths_and_intent(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    assert {r["p"]: r["t"] for r in df.select("p", X.is_test_path(F.col("p")).alias("t")).collect()} == PATHS
    assert X.query_has_test_intent("latest unit") and not X.query_has_test_intent("http request") and X.query_has_test_intent("a Sanity Check")


def test_code_words(spark):
    df = spark.createDataFrame([("Value.backward self.zero_grad core.py 3.14 1,000 it's a.1 foo_.bar src/click",)], "t string")
    assert df.select(X.analyse(F.col("t"), X.CODE_WORDS).alias("w")).first()["w"] == ["value.backward", "self.zero_grad", "core.py", "3.14", "1,000", "it's", "a", "1", "foo_", "bar", "src", "click"]


def test_lines_and_previews(spark):
    texts = ["a\nb\r\nc", "a\n", "", "x\u2028y\x0bz", "one"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["l"] for r in df.select(X.lines(F.col("t")).alias("l")).collect()] == [t.splitlines() for t in texts]


GOOD = {"https://github.com/Owner-1/repo_name.v2.git": ("Owner-1", "repo_name.v2"), "http://www.github.com/Owner-1/repo_name.v2/": ("Owner-1", "repo_name.v2"), "https://GITHUB.COM/Owner-1/repo_name.v2.git/": ("Owner-1", "repo_name.v2")}
BAD = ["https://u:p@github.com/o/r", "https://github.com:443/o/r", "https://github.com/o/r?x=1", "https://github.com/o/r#f", "https://github.com//o/r", "https://github.com/o/%72", "https://github.com/o\\r", "https://github.com/o/r\n", "https://github.com/o/r r", "https://github.com/ö/r", "https://github.com/o/..", "https://github.com/o/..git", "ftp://github.com/o/r", "https://gitlab.com/o/r", "https://github.com/o"]


def test_repository_urls(spark):
    df = spark.createDataFrame([(u,) for u in [*GOOD, *BAD]], "u string")
    owner, name = X.repository_of(F.col("u"))
    found = {r["u"]: (r["o"], r["n"]) for r in df.select("u", owner.alias("o"), name.alias("n")).collect()}
    assert {u: found[u] for u in GOOD} == GOOD
    assert [u for u in BAD if found[u] != (None, None)] == []


def test_vectors_are_validated(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.1]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (5, None), (6, [None, 1.0])], "k int, v array<double>")
    assert [r["k"] for r in df.where(is_valid(F.col("v"), 2)).collect()] == [1]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=12))
def test_min_max_bounds_and_order(spark, values):
    out = _norms(spark, values)
    assert all(0 <= x <= 1 for x in out) and max(out) == 1
    assert all(a <= b for (_, a), (_, b) in zip(sorted(zip(values, out, strict=True))[:-1], sorted(zip(values, out, strict=True))[1:], strict=True))


def test_large_query_batches_go_by_a_shuffle_and_in_blocks(spark, monkeypatch):
    from quernstone.operators import lexical, semantic

    docs = spark.createDataFrame([(k, f"alpha {'beta ' * (k % 4)} w{k}", [float(k % 7), 1.0]) for k in range(60)], "symbol_id int, code string, embedding array<double>")
    queries = spark.createDataFrame([(k, f"beta w{k}", [1.0, float(k)]) for k in range(9)], "query_id int, query string, embedding array<double>")
    run = lambda: (sorted(map(repr, lexical.search(docs, queries, 5, {"code": 1.0}).collect())), sorted(map(repr, semantic.search(docs, queries, 5, 2, "symbol_id").collect())))
    want = run()
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 1)
    monkeypatch.setattr(semantic, "BROADCAST_QUERIES", 4)
    assert run() == want and all(len(x) == 45 for x in want)
    monkeypatch.setattr(semantic, "MATRIX_QUERIES", 1)
    assert run() == want


def test_matrix_search_filters_and_orders_like_expressions(spark, monkeypatch):
    from quernstone.operators import semantic

    vectors = spark.createDataFrame([(k, [float(k % 5), 1.0], k % 3 == 0) for k in range(40)] + [(99, [0.0, 0.0], False)], "id int, embedding array<double>, is_test boolean")
    queries = spark.createDataFrame([(k, [1.0, float(k)], k % 2 == 0) for k in range(4)], "query_id int, embedding array<double>, intent boolean")
    run = lambda: [tuple(r) for r in semantic.search(vectors, queries, 6, 2, filtered="is_test").orderBy("query_id", "rank").collect()]
    want = run()
    monkeypatch.setattr(semantic, "MATRIX_QUERIES", 1)
    assert run() == want and len(want) == 24


def test_texts_that_hold_items_are_found_without_a_nested_loop(spark, monkeypatch):
    import random

    from quernstone.operators import lexical

    rng = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    opening = "the best of the best there ever was"
    texts = [(k, f"{opening} " * (k % 2) + " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for k in range(150)] + [(900, None), (901, "")]
    items = [(k, " ".join(texts[rng.randrange(150)][1].split(" ")[a : a + rng.randrange(1, 14)])) for k, a in ((k, rng.randrange(0, 20)) for k in range(120))]
    items += [(500, f"{opening} {words[3]}"), (501, ""), (502, "w1"), (503, "w1"), (504, "no text holds these seven words at all"), (505, "1 w2")]
    want = {(q, i) for q, item in items for i, text in texts if item and text and item in text}
    t, x = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(items, "query_id int, item string")
    for chars in (2_000_000, 100):
        monkeypatch.setattr(lexical, "AUTOMATON_CHARS", chars)
        found = lexical.holders(t, x)
        assert {(r["query_id"], r["id"]) for r in found.collect()} == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_very_many_short_items(spark):
    from quernstone.operators import lexical

    items = spark.range(300_000).selectExpr("CAST(id AS INT) AS query_id", "concat('key ', id, '.') AS item")
    texts = spark.createDataFrame([(1, "a key 77. and key 299999. here"), (2, "key 300000. is none"), (3, "key 5")], "id long, text string")
    assert {(r["query_id"], r["id"]) for r in lexical.holders(texts, items).collect()} == {(77, 1), (299999, 1)}
