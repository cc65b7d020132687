"""The recursion of the induced sort, and the exchanges that aggregate before they send."""

import random

import numpy as np
import pytest

from quernstone.llm import suffix_dedup as s


@pytest.mark.parametrize(("digits", "levels"), [(4, 1), (4, 3), (16, 2), (512, 1)])
def test_names_sorted_by_recursion(monkeypatch, digits, levels):
    monkeypatch.setattr(s, "DIGITS", digits)
    monkeypatch.setattr(s, "LEVELS", levels)
    doubled, depth = [], []
    plain, whole = s.sort_tied, s.suffix_array
    monkeypatch.setattr(s, "sort_tied", lambda names: doubled.append(len(names)) or plain(names))
    monkeypatch.setattr(s, "suffix_array", lambda text, size=257, level=0: depth.append(len(text)) or whole(text, size, level))
    rng = random.Random(digits)
    for _ in range(30):
        unit = [rng.randrange(1, 20) for _ in range(rng.randrange(2, 60))]
        text = np.array((unit * rng.randrange(1, 6) + [rng.randrange(1, 20) for _ in range(rng.randrange(40))]) * 2)
        order = s.suffix_array(text, 257)
        values = text.tolist()
        assert order.tolist() == sorted(range(len(values)), key=lambda k: values[k:])
    assert len(depth) > 45  # some strings of names are sorted as strings
    if digits == 512:
        assert not doubled


def brute(docs, length):
    """(bytes removed, spans) of each document, string by string."""
    out = {}
    for i, text in docs:
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            piece = data[p : p + length]
            if any(j < i and piece in other.encode() for j, other in docs):
                gone[p : p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])) == 1)
        out[i] = (int(gone.sum()), len(edges))
    return out


@pytest.mark.parametrize("group_bytes", [200, 1 << 22])
def test_a_passage_of_most_documents(spark, monkeypatch, group_bytes):
    """Equal runs inside a group are flagged there; the group's smallest document is judged by the shard."""
    monkeypatch.setattr(s, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(s, "HASH_BYTES", 1000)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [word(90), word(60)]
    docs = []
    for i in range(60):
        parts = [word(rng.randrange(5, 40))]
        for p in passages:
            if rng.random() < 0.7:
                parts += [p if rng.random() < 0.6 else p[rng.randrange(10) :], word(rng.randrange(3, 30))]
            if rng.random() < 0.2:
                parts += [p, word(4)]
        docs.append((i * 3 % 61, "".join(parts)))
    rows = s.repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in rows} == brute(docs, 50)


def test_what_goes_to_a_shard_does_not_grow_with_copies():
    """A group sends one string for equal runs of many documents."""
    import pyarrow as pa

    line = "the very same long line of words that stands in all of these documents, over and over again"
    texts = pa.table({"i": np.arange(500), "h": np.arange(500), "g": pa.array(np.zeros(500, np.int32)), "t": [f"{k} {line} {k}" for k in range(500)]})
    _, _, _, least = s.window_runs(np.frombuffer(line.encode(), np.uint8), np.array([0, len(line)]))
    out = s._segments(50, 1)(texts, pa.table({"g": pa.array([0], pa.int32()), "b": [s._blob(np.unique(least))]}))
    (blob,) = out.column("b").to_pylist()
    _, _, _, hashes, windows, data, _, _, starts, owners, _, _ = s._arrays(blob, "qqiuibiiiiii")
    # runs inside the line are one string each; at its two ends, where its neighbours come in, they differ
    assert len(hashes) == len(starts) and len(owners) >= 499 * (len(set(least.tolist())) - 2)
