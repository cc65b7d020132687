"""Overlaps by the stated rule, tried on every stretch."""

import numpy as np

from quernstone.llm import decontaminate


def _any_stretch(equal, need=13, tenths=7):
    n = len(equal)
    return any(10 * sum(equal[a:b]) >= tenths * (b - a) for a in range(n) for b in range(a + need, n + 1))


def test_any_similar_stretch_of_a_diagonal_counts():
    rng = np.random.default_rng(2)
    seen = {True: 0, False: 0}
    for _ in range(1500):
        equal = rng.random(int(rng.integers(1, 60))) < rng.choice([0.1, 0.4, 0.6, 0.7])
        want = _any_stretch(equal.tolist())
        found = decontaminate.accepted(equal, 100, 13, 0.7)
        assert (found is not None) == want
        if found:
            a, b = found
            assert b - a >= 13 and 10 * equal[a:b].sum() >= 7 * (b - a) and 0 <= a < b <= len(equal)
        seen[want] += 1
    assert min(seen.values()) > 200


def test_quoted_parts_with_replaced_words_are_found(spark, prose):
    rng = np.random.default_rng(3)
    items = [(k, prose(k, 60)) for k in range(20)]
    docs = []
    for k in range(200):
        n, replaced = [(13, 1), (15, 2), (16, 3), (20, 5), (25, 7)][k % 5]
        leak = items[k % 20][1].split()[20 : 20 + n]
        for at in rng.choice(np.arange(1, n - 1), replaced, replace=False):
            leak[at] = "changed"
        text = prose(1000 + k, 150).split()
        text[40:40] = leak
        docs.append((k, " ".join(text)))
    docs += [(1000 + k, prose(5000 + k, 150)) for k in range(50)]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_overlaps(docs, items).collect()}
    assert found == {(k, k % 20) for k in range(200)}
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(docs, items).collect()) == list(range(1000, 1050))


def test_every_stretch_that_counts_has_a_seed():
    """By the last words' pattern, the fewest replaced words that leave no seed."""
    masks, fewest = decontaminate.MASKS, {(True,): 0}
    for n in range(2, 151):
        new = {}
        for last, replaced in fewest.items():
            for same in (True, False):
                t = (*last, same)
                if any(len(t) > m[-1] and all(t[len(t) - 1 - m[-1] + o] for o in m) for m in masks):
                    continue
                new[t[-6:]] = min(new.get(t[-6:], n), replaced + (not same))
        fewest = new
        assert n < 13 or 10 * min(fewest.values()) > 3 * n
