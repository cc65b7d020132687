"""What groups of documents send to shards grows with the input, not with its square."""

import numpy as np
import pyarrow as pa

from quernstone.llm import suffix_dedup as s


def test_values_sent_between_groups_and_shards_follow_the_input():
    sent = lambda gb: s.groups_of(int(gb * 1e9)) ** 2 / gb
    # from some 0.84 GB of text on, until groups have grown to GROWN times their bytes
    assert max(sent(gb) for gb in (1, 2, 5, 10, 20, 50)) < 1.1 * min(sent(gb) for gb in (1, 2, 5, 10, 20, 50))
    assert all(1e9 * gb / s.groups_of(int(gb * 1e9)) <= s.GROWN * s.GROUP_BYTES for gb in (1, 10, 100, 1000))
    assert s.groups_of(0) == s.groups_of(1) == 12 and s.groups_of(400 << 20) == 100 and s.groups_of(1 << 60) == s.MOST_GROUPS


def by_group(table, column):
    return {k: table.filter(pa.compute.equal(table[column], k)) for k in set(table[column].to_pylist())}


def flags(texts, groups, shards, shard_bytes, monkeypatch):
    monkeypatch.setattr(s, "SHARD_BYTES", shard_bytes)
    ids = np.arange(len(texts))
    rows = pa.table({"i": ids, "h": ids, "g": pa.array(ids % groups, pa.int32()), "t": texts, "r": pa.nulls(len(ids))})
    hashes = pa.Table.from_batches(s._hashes(s.LENGTH, 3)(rows.select(["i", "g", "t"]).to_batches()))
    shared = by_group(pa.concat_tables([s._shared(t) for t in by_group(hashes, "p").values()]), "g")
    segments = pa.concat_tables([s._segments(s.LENGTH, shards)(t, shared[g]) for g, t in by_group(rows, "g").items() if g in shared])
    out = set()
    for t in by_group(segments, "s").values():
        for b in s._decided(s.LENGTH)(t)["b"].to_pylist():
            docs, _, owner, start, n = s._arrays(b, "qqiii")
            out |= {(int(docs[o]), a) for o, x, k in zip(owner, start, n, strict=True) for a in range(x, x + k)}
    return out


def test_windows_are_those_of_all_pairs_whatever_the_groups_and_batches(monkeypatch):
    rng = np.random.default_rng(8)
    passages = ["".join(rng.choice(list("abcd "), 90)) for _ in range(6)] + ["ab" * 60, "x" * 130]
    texts = ["".join(rng.choice(list("abcdefgh "), rng.integers(0, 80))) + "".join(passages[k][a:] + "|" for k, a in zip(rng.integers(0, 8, 3), rng.integers(0, 30, 3), strict=True)) for _ in range(60)]
    first, want = {}, set()
    for i, t in enumerate(texts):
        for a in range(len(t) - s.LENGTH + 1):
            if first.setdefault(t[a : a + s.LENGTH], i) < i:
                want.add((i, a))
    for groups, shards, shard_bytes in ((1, 1, 1 << 20), (7, 5, 1), (7, 3, 500), (60, 2, 3000)):
        assert flags(texts, groups, shards, shard_bytes, monkeypatch) == want
    assert len(want) > 1000
