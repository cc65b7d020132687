"""Hard negatives against brute force: several shapes of vectors, blocks, ties, and the cases of the docstring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, i string, x string, slot string"


def brute(rows, every=10, keep=5, low=80):
    """rows: (id, integer vector, label) as they take part."""
    out = set()
    for a, v, label in rows:
        if a % every:
            continue
        scored = [(int(sum(int(p) * int(q) for p, q in zip(v, w))), i, other) for i, w, other in rows if i != a]
        best = lambda pairs: sorted(pairs, key=lambda s: (-s[0], s[1]))[:keep]
        for p, positive, _ in best([s for s in scored if s[2] == label]):
            window = [s for s in scored if s[2] != label and low * p <= 100 * s[0] <= 100 * p]
            out |= {(a, positive, k + 1, i, p, n) for k, (n, i, _) in enumerate(best(window))}
    return out


def mined(spark, rows, every=10, **options):
    df = spark.createDataFrame([(i, v, label, "a", "b", "c") for i, v, label in rows], SCHEMA)
    got = hn.mine(df, F.pmod(F.col("i"), F.lit(every)) == 0, **options)
    return [tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]


def whole(v):
    return [int(np.floor(256 * c)) for c in v]


@pytest.mark.parametrize("shape", ["even", "leading", "clustered", "equal", "negative"])
def test_same_as_brute_force(spark, shape):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 12))
    if shape == "leading":
        x *= 0.5 ** np.arange(12)
    elif shape == "clustered":
        x = rng.normal(size=(6, 12))[rng.integers(0, 6, 400)] + 0.05 * x
    elif shape == "equal":
        x[:150] = x[0]  # a vector of over a third of the rows: ties by id
    elif shape == "negative":
        x = -np.abs(x) * np.where(np.arange(400) % 2, 1, -1)[:, None]
    rows = [(i, v.tolist(), int(label)) for i, (v, label) in enumerate(zip(x, rng.integers(0, 3, 400), strict=True))]
    want = brute([(i, whole(v), label) for i, v, label in rows])
    got = mined(spark, rows)
    assert len(got) == len(set(got)) and set(got) == want and want
    if shape == "leading":  # anchors in many blocks, and a sample that says little
        assert set(mined(spark, rows, block_bytes=6000, sample_rows=5)) == want


def test_discarding_never_loses_a_pair_and_does_discard():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(3000, 32)) * 0.7 ** np.arange(32) * 500).astype(np.int64)
    turning = hn.fit(x[:500])
    slots = hn.Slots(np.arange(20), np.full(20, hn.LOWEST), np.full(20, hn.HIGHEST))
    miner = hn.Miner(turning, np.arange(20), np.zeros(20, int), x[:20], slots, 5, True)
    verified = []
    keep = miner._verify
    miner._verify = lambda r, c, ids, rows: (verified.append(len(r)), keep(r, c, ids, rows))
    for a in range(0, 3000, 500):
        miner.add(np.arange(a, a + 500), np.zeros(500, int), x[a : a + 500])
    scores = x[:20] @ x.T
    for k in range(20):
        scores[k, k] = hn.LOWEST
        best = sorted(range(3000), key=lambda i: (-scores[k, i], i))[:5]
        own = miner.found[0] == k
        assert sorted(miner.found[1][own].tolist()) == sorted(best)
    assert sum(verified) < 0.4 * 20 * 3000


def test_rows_without_part_short_vectors_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [1.0], 1), (3, [0.9, 0.5], 2), (4, [0.9, 0.5, 0.0], 2), (5, [], 2), (6, [-1.0, -1.0], 2),
        (7, None, 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 2), (11, [None, 1.0], 2), (12, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (13, [1e30, 0.0], 1), (14, [1e300, 0.0], 2),
        (10, [], 1), (20, [5.0, 5.0], 9), (30, None, 1), (40, [0.1, 0.1], None),
    ]
    part = [(0, [256, 128, 0], 1), (1, [256, 128, 0], 1), (2, [256, 0, 0], 1), (3, [230, 128, 0], 2), (4, [230, 128, 0], 2), (5, [0, 0, 0], 2), (6, [-256, -256, 0], 2), (10, [0, 0, 0], 1), (20, [1280, 1280, 0], 9)]
    got = mined(spark, rows)
    assert set(got) == brute(part) and len(got) == len(set(got))
    assert {r[0] for r in got} == {0, 10} and mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == [(0, 1, 1, 2, 0, 0)]
    assert mined(spark, [(0, None, 1), (1, None, None)]) == []


def test_large_integers_are_exact(spark):
    rows = [(0, [4e6, 1.0], 1), (1, [4e6, 1.0 / 256], 1), (2, [4e6, 0.0], 2), (3, [4e6, -1.0 / 256], 2)]
    got = mined(spark, rows)
    assert set(got) == brute([(i, whole(v), label) for i, v, label in rows]) and got
