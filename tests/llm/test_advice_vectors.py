"""Lists that a query does not search first are ruled out by a bound, not by a count."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.llm import vector_lists


@pytest.mark.parametrize("bound", [None, 40])
def test_answers_are_exact_beyond_128_lists(spark, monkeypatch, bound):
    if bound:
        monkeypatch.setattr(vector_lists, "QUERY_ROWS", bound)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(48_000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[:20_000] *= rng.uniform(0.2, 2, (20_000, 1))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(v)), "embedding": pa.FixedSizeListArray.from_arrays(v.ravel(), 64).cast(pa.list_(pa.float64()))}))
    rows = vector_lists.nearest(df, F.pmod(F.col("i"), F.lit(400)) == 0).collect()
    got = {(r["query_id"], r["vec_id"]) for r in rows}
    want = set()
    for q in range(0, len(v), 400):
        s = v @ v[q]
        s[q] = -np.inf
        want |= {(q, int(i)) for i in np.argsort(-s)[:20]}
    assert got == want


def test_neighbouring_lists_share_a_block():
    c = np.random.default_rng(1).normal(size=(40, 8))
    block, chunks = vector_lists.blocks_of(c, np.full(40, 100), 300)
    assert chunks.tolist() == [1] * len(chunks) and np.bincount(block).max() == 3 and len(chunks) == 14
    block, chunks = vector_lists.blocks_of(c[:3], np.array([10, 1000, 10]), 300)
    assert chunks[block[1]] == 4 and (block != block[1]).sum() == 2


@pytest.mark.parametrize("kind", ["uniform", "log-normal norms", "clustered"])
def test_recall_by_the_measured_ratio_where_lists_are_many(spark, kind):
    """50,000 vectors of any shape: the ratio measured on trial queries keeps what it promises on others."""
    rng = np.random.default_rng(11)
    n = 50_000
    v = rng.normal(size=(n, 64))
    if kind == "clustered":
        v = 3 * rng.normal(size=(200, 64))[rng.integers(0, 200, n)] + v
    elif kind == "log-normal norms":
        v = v / np.linalg.norm(v, axis=1, keepdims=True) * np.exp(rng.normal(size=(n, 1)))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(v.ravel(), 64).cast(pa.list_(pa.float64()))}))
    got = vector_lists.nearest(df, F.pmod(F.col("i"), F.lit(100)) == 0, target=vector_lists.TARGET).select("query_id", "vec_id").toPandas()
    by = {q: set(x) for q, x in got.groupby("query_id")["vec_id"]}
    hit = 0
    for q in range(0, n, 100):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(by[q] & set(np.argpartition(-s, 20)[:20].tolist()))
    assert hit / (n // 100 * 20) >= 0.95 and all(len(x) == 20 for x in by.values())


def test_two_levels_of_lists(monkeypatch):
    monkeypatch.setattr(vector_lists, "FLAT_LISTS", 50)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(12, 8))[rng.integers(0, 12, 4000)] + 0.5 * rng.normal(size=(4000, 8))
    lists = vector_lists.fit(v, float(np.linalg.norm(v, axis=1).max()), 4000, list_rows=20)
    assert 150 <= len(lists.centroids) <= 250 and lists.coarse.max() >= 10
    q = lists.asked(v[:200])
    rows, found, _ = vector_lists.within_ratio(lists, q, 1.3, 6)
    dist = np.sqrt(vector_lists._squares(q, lists.centroids))
    want = {(r, c) for r, c in zip(*np.nonzero(dist <= 1.3 * dist.min(axis=1, keepdims=True)), strict=True)}
    got = set(zip(rows.tolist(), found.tolist(), strict=True))
    assert len(want & got) >= 0.97 * len(want)
    block, chunks = vector_lists.blocks_of(lists.centroids, np.full(len(lists.centroids), 20), 100, lists.coarse)
    assert all(len(set(lists.coarse[block == b])) == 1 for b in range(len(chunks)))


def test_empty_lists_and_few_answers(spark, monkeypatch):
    """Every query has its answers, however many lists near it are empty or small."""
    whole = vector_lists.fit

    def with_empty(vectors, greatest, rows, **options):
        lists = whole(vectors, greatest, rows, **options)
        queries = lists.asked(v[:40])
        lists.centroids = np.concatenate([lists.centroids, queries + 1e-3])  # near queries, and far from all vectors on the sphere
        lists.coarse = np.zeros(len(lists.centroids), np.int64)
        lists.graph = vector_lists.neighbour_graph(lists.centroids, lists.coarse)
        return lists

    rng = np.random.default_rng(6)
    v = rng.normal(size=(4000, 16)) * np.exp(2 * rng.normal(size=(4000, 1)))
    monkeypatch.setattr(vector_lists, "fit", with_empty)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = vector_lists.nearest(df, F.col("i") < 40, target=0.9, chunk=8, first_lists=1).toPandas()
    assert (got.groupby("query_id").size() == 20).all() and got["query_id"].nunique() == 40
    hit = 0
    for q in range(40):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(set(got[got["query_id"] == q]["vec_id"]) & set(np.argsort(-s)[:20].tolist()))
    assert hit / 800 > 0.8


def test_bounds_of_a_block_of_queries_and_many_lists_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 17)))
    ways, part, widest = unit(65_536), unit(vector_lists.ROUTED), rng.random(65_536)
    tracemalloc.start()
    most = vector_lists.most_cosines(part, ways, widest)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and most.shape == (vector_lists.ROUTED, 65_536)
    # no vector within a list's angle of its direction has a greater cosine
    for r, c in ((0, 5), (7, 60_000), (127, 1)):
        x = ways[c] + 0.5 * rng.normal(size=(200, 17)) / 4
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        inside = np.arccos(np.clip(x @ ways[c], -1, 1)) <= widest[c]
        assert (x[inside] @ part[r] <= most[r, c] + 1e-9).all()
