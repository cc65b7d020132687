"""Deobfuscation against all readings of a lattice, held-out texts plain and disguised, and the cases of the docstring."""

import itertools
import random

import numpy as np
import pytest

from quernstone.llm import toxicity as tx


@pytest.fixture(scope="module")
def model():
    text = "the silly fool met another fool and they were loud on the old road to the small town near the river " * 40
    counts = np.zeros(tx.CELLS, np.int64)
    tx.counted(tx.folded(text), counts)
    return tx.language_model(counts)


def test_the_model_sums_to_one(model):
    assert np.allclose(np.exp(-model).reshape(-1, tx.LETTERS).sum(axis=1), 1)


def test_counts_are_those_of_words():
    counts = np.zeros(tx.CELLS, np.int64)
    tx.counted("ab a  b", counts)
    cell = lambda *c: ((c[0] * 28 + c[1]) * 28 + c[2]) * 28 + c[3]
    want = {cell(0, 0, 0, 1): 2, cell(0, 0, 1, 2): 1, cell(0, 1, 2, 0): 1, cell(0, 0, 1, 0): 1, cell(0, 0, 0, 2): 1, cell(0, 0, 2, 0): 1}
    assert {int(k): int(counts[k]) for k in np.flatnonzero(counts)} == want


def by_all_readings(units, model):
    best = None
    for choice in itertools.product(*units):
        letters, cost = "".join(c for c, _ in choice), sum(m for _, m in choice)
        for word in letters.split():
            context = [0, 0, 0]
            for c in [ord(x) - 96 for x in word] + [0]:
                cost += model[((context[0] * 28 + context[1]) * 28 + context[2]) * 28 + c]
                context = [*context[1:], c]
        if best is None or cost < best[1] - 1e-12:
            best = (" ".join(letters.split()), cost)
    return best


@pytest.mark.parametrize("span", ["f00l", "s1lly", "f o o l", "f-o-o--l", "foooool", "fo0|", "$!lly", "f**l", "a", "b b", "0n ro4d"])
def test_viterbi_is_the_best_of_all_readings(model, span):
    units = tx.lattice(span)
    got, cost = tx.decoded(units, model.tolist())
    want = by_all_readings(units, model)
    assert cost == pytest.approx(want[1]) and " ".join(got.split()) == want[0]


def test_disguises_are_undone_and_plain_words_stay(model):
    r = tx.Restorer(model)
    for hidden in ("f00l", "F O O L", "f.o.o.l", "fooooool", "f-0-0-l", "ｆｏｏｌ", "fооl", "f​o​ol", "föol", "f0o|", "f_o_o_l"):
        assert "fool" in r.text(f"they met the {hidden} near the town!").split(), hidden
    plain = "they met the old fool near the small town and were loud"
    assert r.text(plain) == plain and r.text("1,000 of 25 on 3.14") == "1,000 of 25 on 3.14"
    assert r.text(None) == "" and r.words(None) == set() and r.words("") == set()
    assert "a" in r.words("a " * 200_000) and len(r.words("a " * 200_000)) <= 2
    assert r.words("* " * 100_000) == set()


def corpus(prose, n=900):
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(n):
        words = prose(k, 60, 4000).split()
        toxic = k % 5 == 0
        if toxic:
            for w in rng.sample(["grumbler", "nitwit", "dunce"], 2):
                words.insert(rng.randrange(60), w)
        rows.append((k, " ".join(words), "x", "y"))
        labels.append((k, 0, int(toxic), "z"))
    return rows, labels


def test_held_out_texts_and_their_disguises_are_found(spark, prose):
    rows, labels = corpus(prose)
    disguised = [(10_000 + k, " ".join({"grumbler": "gr00mbl3r" if k % 2 else "g r u m b l e r", "nitwit": "n1tw1t", "dunce": "d-u-n-c-e"}.get(w, w) for w in t.split()), "x", "y") for k, t, *_ in rows if k % 5 == 0]
    docs = spark.createDataFrame([*rows, *disguised, (20_000, None, "x", "y"), (20_001, "", "x", "y"), (None, rows[0][1], "x", "y"), (0, rows[0][1], "x", "y")], "doc_id long, text string, toxic string, score string")
    told = spark.createDataFrame([*labels, (0, 0, 1, "z"), (None, 0, 1, "z"), (3, None, None, "z")], "doc_id long, quality int, toxic int, text string")
    scorer = tx.fit(docs, told)
    out = tx.scores(docs, scorer).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    got = {r["doc_id"]: r for r in out}
    held = [k for k in range(900) if got[k]["held_out"]]
    assert 200 < len(held) < 400 and [got[k]["predicted"] for k in held] == [int(k % 5 == 0) for k in held]
    hidden = [got[k] for k, *_ in disguised]
    assert np.mean([r["predicted"] for r in hidden]) > 0.9
    assert got[20_000]["score"] == got[20_001]["score"] < 0.7 and got[None]["predicted"] == 1 and not got[None]["held_out"]
    again = tx.fit(docs.orderBy("text"), told)
    assert again.weights == scorer.weights and again.bias == scorer.bias
    text = {r["doc_id"]: r["text"] for r in tx.restored(docs, scorer.model).collect()}
    assert text[20_000] is None and "nitwit" in " ".join(t for k, t in text.items() if k and 10_000 <= k < 20_000)


def test_copies_count_once_and_rare_labels_are_all_learned(spark, prose):
    rows, labels = corpus(prose, 3000)
    few = [(k, q, t if k % 50 == 0 else 0, z) for k, q, t, z in labels]
    rows = [(k, " ".join(w for w in t.split() if k % 50 == 0 or w not in ("grumbler", "nitwit", "dunce")), a, b) for k, t, a, b in rows]
    copied = [(50_000 + k, rows[7][1] + f" grumbler w{k:x}", "x", "y") for k in range(600)]
    docs = spark.createDataFrame(rows + copied, "doc_id long, text string, a string, b string")
    told = spark.createDataFrame(few + [(50_000 + k, 0, 1, "z") for k in range(600)], "doc_id long, quality int, toxic int, z string")
    sample, stands_for = tx.sampled(docs, told, 20_000)
    assert stands_for == {0: 1.0, 1: 1.0} and sample.count() == told.where(tx.learned_from(told["doc_id"])).count()
    sample, stands_for = tx.sampled(docs, told, 900)
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    assert 300 < n[1] < 550 and 300 < n[0] < 600 and stands_for[0] > 2
    out = {r["doc_id"]: r["predicted"] for r in tx.scores(docs, tx.fit(docs, told, sample_rows=1500)).collect()}
    assert out[7] == 0  # the copied text is none of a toxic one's marks


def test_nothing_to_learn_from(spark, prose):
    docs = spark.createDataFrame([(k, prose(k, 20)) for k in range(30)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r["score"], r["predicted"]) for r in tx.scores(docs, tx.fit(docs, none)).collect()} == {(0.0, 0)}
    all_one = spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, toxic int")
    got = tx.scores(docs, tx.fit(docs, all_one)).collect()
    assert {r["predicted"] for r in got} == {1} and len({r["score"] for r in got}) == 1
    assert tx.scores(docs.limit(0), tx.fit(docs.limit(0), none)).count() == 0
