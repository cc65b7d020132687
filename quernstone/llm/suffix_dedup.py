"""Exact repeated byte strings by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a
smaller id. Two windows of that length can be equal only if the least hashed ``GRAM``-gram in
them is, so each document is cut into runs of windows with the same least hash. A
first exchange of these hashes alone (no text) finds those that two documents share, and
with them the only runs that can repeat. The bytes of such runs go to the shard of
their hash, where a suffix array decides. Both exchanges aggregate first: a task sends a hash with the smallest and
greatest of its documents, and a group sends equal runs as one string with its smallest document and flags the others' itself.
So a passage that a third of all documents share costs its shard a row for each group, of which there are at most
``MOST_GROUPS``, and not for each document. In the shard:

1. suffixes are classified as smaller or greater than their right neighbour;
2. the substrings between leftmost-smaller suffixes are sorted by inducing, named, and the
   string of names is sorted in turn, by the same steps on its digits (and below ``LEVELS`` by rank doubling);
3. from the sorted leftmost-smaller suffixes all others are induced, linearly, in one
   sweep up and one down the buckets; a bucket is a few array operations;
4. permuted common prefixes are computed at irreducible places and follow from their left neighbour elsewhere.

Windows whose neighbours share ``length`` bytes form a group; a window is flagged if its
document is not the group's smallest. Flags go back to the documents' group, where the
text is cut. Exact copies of a whole text are set aside beforehand by their digest.

Cases: a null text is empty. Texts under ``length`` bytes keep all. A null id is never
smaller than another, and its text is kept whole. Rows that repeat an id do not count as
repeats of one another. An empty table gives an empty result. In ``cut`` spans shrink to whole characters.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_table, flat_text, materialise, mix64, release_memory, slices

LENGTH, GRAM = 50, 16
#: Bytes of text in a group of documents, and about so many of runs in a shard.
GROUP_BYTES = 4 << 20
#: Up to so many groups and shards. As each group sends to each shard, in larger tables both grow with the root of the input, to ``GROWN`` times their bytes, so that what is sent are as many values a byte.
PAIRED_GROUPS, GROWN = 200, 8
#: Groups at most: in larger tables they grow.
MOST_GROUPS = 1 << 20
#: Bytes of text whose hashes one task compares.
HASH_BYTES = 48 << 20
#: Up to so many exact copies (16 bytes each), or texts with copies (72 bytes), are told by a broadcast; beyond it by a shuffle.
BROADCAST_COPIES = 500_000
SHARD_BYTES = 3 << 19
#: Names that are characters themselves; more are written in two digits each.
DIGITS = 512
#: Levels at which names are written in digits.
LEVELS = 1

_T = byte_table(50)
_MUL = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_EMPTY = hashlib.sha256(b"").hexdigest()


# ---- runs of windows


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each place."""
    h, s = _T[data], 1
    for c in _MUL:
        h = h[:-s] * c + h[s:]
        h ^= h >> np.uint64(29)
        s *= 2
    return mix64(h)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    s = 1
    while s * 2 <= width:
        h = np.minimum(h[:-s], h[s:])
        s *= 2
    return np.minimum(h[: len(h) - (width - s)], h[width - s :]) if s < width else h


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in data, windows, least hash) of the runs of windows; no window crosses a row's end."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64)
    least = sliding_min(gram_hashes(data), length - GRAM + 1)
    n = len(least)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    valid = np.arange(n) + length <= offsets[1:][row]
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(fresh)
    if not len(start):
        return none, none, none, np.zeros(0, np.uint64)
    count = np.add.reduceat(valid.astype(np.int64), start)
    return row[start], start, count, least[start]


# ---- suffix arrays


def _split(at: np.ndarray, chars: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Append the places, in order, to the buckets of their characters."""
    order = np.argsort(chars, kind="stable")
    at, chars = at[order], chars[order]
    cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    begins = [0, *cuts.tolist()]
    for a, b, c in zip(begins, [*begins[1:], len(at)], chars[begins].tolist(), strict=True):
        into[c].append(at[a:b])


def _cat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.int32)


def induce(text: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order (of their substrings, at least)."""
    before = np.empty(len(text), text.dtype)  # the character before each place
    before[1:], before[0] = text[:-1], 0
    seeds: list[list[np.ndarray]] = [[] for _ in range(size)]
    if len(lms):
        _split(lms, text[lms], seeds)
    greater: list[list[np.ndarray]] = [[] for _ in range(size)]
    greater[text[-1]].append(np.array([len(text) - 1], np.int32))
    for c in range(size):
        now = _cat(greater[c])
        waves = [now]
        while len(now):
            now = now[(before[now] == c) & (now > 0)] - 1
            waves.append(now)
        greater[c] = [_cat(waves)]
        whole = _cat(greater[c] + seeds[c])
        chars = before[whole]
        take = (chars > c) & (whole > 0)
        if take.any():
            _split(whole[take] - 1, chars[take], greater)
    smaller: list[list[np.ndarray]] = [[] for _ in range(size)]  # from the right
    for c in range(size - 1, -1, -1):
        now = _cat(smaller[c])
        waves = [now]
        while len(now):
            now = now[(before[now] == c) & (now > 0)] - 1
            waves.append(now)
        smaller[c] = [_cat(waves)]
        whole = _cat(smaller[c] + [greater[c][0][::-1]])
        chars = before[whole]
        take = (chars < c) & (whole > 0)
        if take.any():
            _split(whole[take] - 1, chars[take], smaller)
    return np.concatenate([x for c in range(size) for x in (greater[c][0], smaller[c][0][::-1])])


def leftmost_smaller(text: np.ndarray) -> np.ndarray:
    """Places whose suffix is smaller than its right neighbour, after one that is greater."""
    n = len(text)
    step = np.zeros(n, np.int8)  # 1: rises, -1: falls, at the next other character
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1])
    step[-1] = -1
    moves = np.flatnonzero(step)
    is_small = step[moves[np.searchsorted(moves, np.arange(n))]] > 0
    return (np.flatnonzero(is_small[1:] & ~is_small[:-1]) + 1).astype(np.int32)


def sort_tied(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by rank doubling of those still tied."""
    m = len(names)
    order = np.argsort(names, kind="stable")
    key = names[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    rank = np.empty(m, np.int64)
    rank[order] = np.repeat(head, np.diff(np.append(head, m)))
    sizes = np.diff(np.append(head, m))
    tied = order[np.repeat(sizes > 1, sizes)]
    k = 1
    while len(tied):
        after = np.full(len(tied), 0, np.int64)
        inside = tied + k < m
        after[inside] = rank[tied[inside] + k] + 1
        key = rank[tied] * (m + 1) + after
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        old = rank[tied]
        at = np.arange(len(tied))
        first_old = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first_new = np.maximum.accumulate(np.where(new, at, 0))
        rank[tied] = old + first_new - first_old
        head = np.flatnonzero(new)
        sizes = np.diff(np.append(head, len(tied)))
        tied = tied[np.repeat(sizes > 1, sizes)]
        k *= 2
    out = np.empty(m, np.int64)
    out[rank] = np.arange(m)
    return out


def sort_names(names: np.ndarray, level: int) -> np.ndarray:
    """Order of the suffixes of a string of names (numbers from 0 without gaps), by the suffix array of their digits.

    Two digits a name keep the order of suffixes and a small alphabet, but shorten the string by a third at best, so
    that a deep recursion costs more than it sorts: below ``LEVELS`` ranks are doubled instead.
    """
    top = int(names.max()) + 1
    if top == len(names):  # all differ: their order is that of the suffixes
        return np.argsort(names)
    if top <= DIGITS:
        return suffix_array(names, top, level + 1)
    if level >= LEVELS or top > 4096 * 4096:
        return sort_tied(names)
    base = math.isqrt(top - 1) + 1
    digits = np.empty(2 * len(names), np.uint16)
    digits[::2], digits[1::2] = names // base, names % base
    order = suffix_array(digits, base, level + 1)
    return order[order % 2 == 0] // 2


def suffix_array(text: np.ndarray, size: int = 257, level: int = 0) -> np.ndarray:
    """Suffix array of characters below ``size``, by induced sorting."""
    text = text.astype(np.uint16)
    lms = leftmost_smaller(text)
    if len(lms) > 1:
        rough = induce(text, lms, size)
        is_lms = np.zeros(len(text), bool)
        is_lms[lms] = True
        rough = rough[is_lms[rough]]
        # names: equal substrings (to the next such place, included) have equal length and hash
        ends = np.append(lms[1:], len(text) - 1) + 1
        lengths = ends - lms
        value = (text.astype(np.uint64) + np.uint64(1)) * _MUL[0]
        value ^= value >> np.uint64(31)
        flat = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths - lms, lengths)
        powers = np.cumprod(np.full(int(lengths.max()), _MUL[1], np.uint64))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        h = mix64(np.add.reduceat(value[flat] * powers[place], np.cumsum(lengths) - lengths))
        number = np.empty(len(text), np.int32)
        number[lms] = np.arange(len(lms))
        k = number[rough]
        differs = np.ones(len(k), bool)
        differs[1:] = (h[k[1:]] != h[k[:-1]]) | (lengths[k[1:]] != lengths[k[:-1]])
        names = np.empty(len(lms), np.int64)
        names[k] = np.cumsum(differs) - 1
        lms = lms[sort_names(names, level)]
    return induce(text, lms, size)


def permuted_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place, the length it shares with its predecessor in the suffix array."""
    n = len(text)
    prior = np.full(n, -1, np.int64)
    prior[sa[1:]] = sa[:-1]
    at = np.arange(n)
    has = prior >= 0
    reducible = has & (at > 0) & (prior > 0)
    reducible[1:] &= text[:-1] == text[np.maximum(prior[1:] - 1, 0)]
    reducible[0] = False
    plcp = np.zeros(n, np.int64)
    a = np.flatnonzero(has & ~reducible)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text.astype(np.uint64) + np.uint64(1)
    words = padded[:-3] << np.uint64(48) | padded[1:-2] << np.uint64(32) | padded[2:-1] << np.uint64(16) | padded[3:]
    b, left, depth = prior[a], np.arange(len(a)), np.zeros(len(a), np.int64)
    while len(left):
        x, y = a[left] + depth[left], b[left] + depth[left]
        inside = (x < n) & (y < n)
        left, x, y = left[inside], x[inside], y[inside]
        u, v = words[x], words[y]
        same = u == v
        part = left[~same]
        d = u[~same] ^ v[~same]
        depth[part] += (d < np.uint64(1 << 48)).astype(np.int64) + (d < np.uint64(1 << 32)) + (d < np.uint64(1 << 16))
        left = left[same]
        depth[left] += 4
    plcp[a] = np.minimum(depth, n - np.maximum(a, b))
    known = np.where(has & ~reducible, at + plcp, np.where(reducible, 0, at))
    return np.maximum(np.maximum.accumulate(known) - at, 0)


def repeated_windows(contents: list[bytes], docs: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each of the strings, its windows (by start) that also stand in a string of a smaller document."""
    of, start = _repeated(contents, docs, length)
    return np.split(start, np.searchsorted(of, np.arange(1, len(contents))))


def _repeated(contents: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of these windows, in order."""
    sizes = np.array([len(c) for c in contents])
    starts = np.cumsum(sizes + 1) - sizes - 1
    joined = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    text = joined.astype(np.uint16) + 1
    text[starts + sizes] = 0
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    is_window = (np.arange(len(text)) - starts[owner]) + length <= sizes[owner]
    sa = suffix_array(text)
    plcp = permuted_prefixes(text, sa)
    valid = is_window[sa]
    places = np.flatnonzero(valid)
    at = sa[places].astype(np.int64)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(places) > 1) | (plcp[at[1:]] < length)
    head = np.flatnonzero(fresh)
    doc = docs[owner[at]]
    least = np.repeat(np.minimum.reduceat(doc, head), np.diff(np.append(head, len(at))))
    flagged = np.sort(at[doc > least])
    of = owner[flagged]
    return of, flagged - starts[of]


# ---- blobs: several arrays in one value, compressed


def _blob(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    whole = np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def _arrays(blob: bytes, kinds: str) -> list[np.ndarray]:
    blob = pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    sizes = np.frombuffer(blob, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    types = {"q": np.int64, "i": np.int32, "u": np.uint64, "b": np.uint8}
    for k, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(blob, types[k], int(size) // np.dtype(types[k]).itemsize, at))
        at += int(size)
    return out


def _table(key: str, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({key: pa.array([r[0] for r in rows], pa.int32()), "b": pa.array([r[1] for r in rows], pa.binary())})


def _groups(by: np.ndarray):
    """(value, places) for each value of ``by``."""
    order = np.argsort(by, kind="stable")
    cuts = np.flatnonzero(np.diff(by[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(by[part[0]]), part


def _hashes(length: int, parts: int):
    """Least hashes with the smallest and greatest document of a slice, dealt by hash: (p, docs, groups, counts, hashes); and those that documents of the slice share, for their groups."""

    def run(batches):
        for batch in batches:
            offsets, data = flat_text(batch.column(2))
            doc, g = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for i, j in slices(offsets, GROUP_BYTES):
                rows, values = [], []
                for a, b in slices(offsets[i : j + 1], 1 << 20):
                    o = offsets[i + a : i + b + 1]
                    row, _, _, least = window_runs(data[o[0] : o[-1]], o - o[0], length)
                    rows.append(row + a)
                    values.append(least)
                by_doc = np.argsort(doc[i:j], kind="stable")
                rank = np.empty(j - i, np.int64)
                rank[by_doc] = np.arange(j - i)
                row, least = rank[np.concatenate(rows)], np.concatenate(values)
                order = np.lexsort((row, least))
                row, least = row[order], least[order]
                keep = np.ones(len(row), bool)
                keep[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
                row, least = row[keep], least[keep]
                d, own_g = doc[i:j][by_doc].astype(np.int64), g[i:j][by_doc].astype(np.int32)
                head = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]])) if len(least) else np.zeros(0, np.int64)
                last = np.append(head[1:], len(least))[: len(head)] - 1
                several = d[row[head]] != d[row[last]]
                sent = np.concatenate([head, last[several]])
                told = np.repeat(several, last - head + 1)
                t_g, t_h = own_g[row[told]], least[told]
                sent = sent[np.argsort(row[sent], kind="stable")]
                row, least = row[sent], least[sent]
                out, none = [], (np.zeros(0, np.int32), np.zeros(0, np.uint64))
                told_part = int(mix64(d[:1].astype(np.uint64))[0] % np.uint64(parts))  # any
                dealt = dict(_groups((mix64(least) % np.uint64(parts)).astype(np.int32)))
                if len(t_g):
                    dealt.setdefault(told_part, np.zeros(0, np.int64))
                for p, at in dealt.items():
                    own, counts = np.unique(row[at], return_counts=True)
                    out.append((p, _blob(d[own], own_g[own], counts.astype(np.int32), least[at], *((t_g, t_h) if p == told_part else none))))
                yield from _table("p", out).to_batches()
        release_memory()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of one part of the hashes, those of two documents or more, dealt back to the documents' groups."""
    got = [_arrays(b, "qiiuiu") for b in table.column("b").to_pylist()]
    doc, g, counts, value, told_g, told = (np.concatenate([x[k] for x in got]) for k in range(6))
    entry = np.repeat(np.arange(len(doc)), counts)
    order = np.argsort(value, kind="stable")
    v, e = value[order], entry[order]
    if len(v):
        head = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        d = doc[e]
        shared = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)
        take = np.repeat(shared, np.diff(np.append(head, len(v))))
        v, e = v[take], e[take]
    v, to = np.concatenate([v, told]), np.concatenate([g[e], told_g])
    out = []
    for k, at in _groups(to):
        out.append((k, _blob(np.unique(v[at]))))
    del got, doc, g, counts, value, entry, order, v, e, to, told, told_g
    release_memory()
    return _table("g", out)


def run_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name the bytes of each run."""
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    value = _T[data[place + np.repeat(starts, sizes)]]
    longest = int(sizes.max())
    return tuple(mix64(np.add.reduceat(value * np.cumprod(np.full(longest, c, np.uint64))[place], first) + sizes.astype(np.uint64)) for c in _MUL[:2])


def _segments(length: int, shards: int):
    """Runs with shared hashes, dealt by hash.

    Of equal runs in the group the smallest document's go out, as one string; the others are flagged here, and these flags go
    through any shard. (s, docs, texts' hashes, group, hashes of the strings, windows, bytes, string, owner and start of each place, owner, start and windows of each flag.)
    """

    def run(texts: pa.Table, hashes: pa.Table) -> pa.Table:
        if not len(hashes) or not len(texts):
            return _table("s", [])
        wanted = np.unique(np.concatenate([_arrays(b, "u")[0] for b in hashes.column("b").to_pylist()]))
        offsets, data = flat_text(texts.column("t"))
        doc, h = (texts.column(k).to_numpy().astype(np.int64) for k in ("i", "h"))
        g = texts.column("g")[0].as_py()
        found = []
        for i, j in slices(offsets, 1 << 20):
            o = offsets[i : j + 1]
            row, start, count, least = window_runs(data[o[0] : o[-1]], o - o[0], length)
            k = np.minimum(np.searchsorted(wanted, least), len(wanted) - 1)
            take = wanted[k] == least
            found.append((row[take] + i, start[take] + o[0], count[take], least[take]))
        row, start, count, least = (np.concatenate(c) for c in zip(*found, strict=True))
        if not len(row):
            return _table("s", [])
        # equal runs, the smallest document's first
        halves = [run_hashes(data, start[a:b], count[a:b] + length - 1) for a, b in slices(np.concatenate([[0], np.cumsum(count + length - 1)]), 1 << 21)]
        h1, h2 = (np.concatenate(x) for x in zip(*halves, strict=True))
        order = np.lexsort((doc[row], count, h2, h1, least))
        row, start, count, least, h1, h2 = (x[order] for x in (row, start, count, least, h1, h2))
        fresh = np.ones(len(row), bool)
        fresh[1:] = (least[1:] != least[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (count[1:] != count[:-1])
        name, head = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        own = doc[row] == doc[row[head]][name]
        starts = (start - offsets[row]).astype(np.int32)
        shard = (mix64(least) % np.uint64(shards)).astype(np.int32)
        flagged = np.flatnonzero(~own)
        through = g % shards
        dealt = dict(_groups(np.where(own, shard, -1)))
        dealt.pop(-1, None)
        if len(flagged):
            dealt.setdefault(through, np.zeros(0, np.int64))
        out = []
        for s, at in dealt.items():
            heads = at[fresh[at]]
            sizes = count[heads] + length - 1
            flat = np.arange(int(sizes.sum())) + np.repeat(start[heads] - np.cumsum(sizes) + sizes, sizes)
            passed = flagged if s == through else flagged[:0]
            owners, place = np.unique(np.concatenate([row[at], row[passed]]), return_inverse=True)
            place = place.astype(np.int32)
            string = (np.cumsum(fresh[at]) - 1).astype(np.int32)
            out.append((s, _blob(doc[owners], h[owners], np.array([g], np.int32), least[heads], count[heads].astype(np.int32), data[flat], string, place[: len(at)], starts[at], place[len(at) :], starts[passed], count[passed].astype(np.int32))))
        return _table("s", out)

    return run


def _decided(length: int):
    """Flags of one shard, dealt back to the documents' groups: (g, docs, texts' hashes, owner, start, windows)."""

    def run(table: pa.Table) -> pa.Table:
        got = [_arrays(b, "qqiuibiiiiii") for b in table.column("b").to_pylist()]
        doc, h = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
        g = np.concatenate([np.repeat(x[2], len(x[0])) for x in got])
        shift = np.cumsum([0, *(len(x[0]) for x in got)])
        named = np.cumsum([0, *(len(x[3]) for x in got)])
        least, count = (np.concatenate([x[k] for x in got]) for k in (3, 4))
        count = count.astype(np.int64)
        data = np.concatenate([x[5] for x in got]).tobytes()
        string = np.concatenate([x[6] + n for x, n in zip(got, named, strict=False)])
        owner, start = np.concatenate([x[7] + n for x, n in zip(got, shift, strict=False)]), np.concatenate([x[8] for x in got]).astype(np.int64)
        flags_o, flags_s, flags_n = ([np.concatenate([x[k] + (n if k == 9 else 0) for x, n in zip(got, shift, strict=False)])] for k in (9, 10, 11))
        del got
        # equal strings of several groups are one, kept with its smallest document
        ends = np.cumsum(count + length - 1)
        begins = ends - count - length + 1
        of = np.zeros(len(least), np.int64)
        of[string] = doc[owner]  # a group's places of a string are all of one document
        first: dict[bytes, int] = {}
        name = np.fromiter((first.setdefault(data[a:b], len(first)) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)), np.int64, len(least))
        contents = list(first)
        small = np.full(len(contents), np.iinfo(np.int64).max)
        np.minimum.at(small, name, of)
        keys = np.zeros(len(contents), np.uint64)  # of their least hashes
        keys[name] = least
        order = np.argsort(keys, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) > 0])) if len(order) else np.zeros(0, np.int64)
        members = np.diff(np.append(head, len(order)))
        order = order[np.repeat(members > 1, members)]  # a hash's strings stay together; one alone repeats nothing
        last = np.cumsum(members[members > 1])
        filled = np.cumsum(np.array([len(contents[m]) for m in order.tolist()], np.int64))[last - 1] if len(order) else last
        found = [(np.zeros(0, np.int64),) * 3]
        at = 0
        while at < len(last):
            to = min(int(np.searchsorted(filled, (filled[at - 1] if at else 0) + SHARD_BYTES)), len(last) - 1) + 1
            batch = order[last[at - 1] if at else 0 : last[to - 1]]
            of_batch, begin = _repeated([contents[m] for m in batch.tolist()], small[batch], length)
            fresh = np.ones(len(begin), bool)
            fresh[1:] = (np.diff(begin) != 1) | (np.diff(of_batch) != 0)
            starts = np.flatnonzero(fresh)
            found.append((batch[of_batch[starts]], begin[starts], np.diff(np.append(starts, len(begin)))))
            release_memory()
            at = to
        # runs of repeated windows by string
        run_of, run_start, run_n = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(run_of, kind="stable")
        run_of, run_start, run_n = run_of[by], run_start[by], run_n[by]
        rest = of[string] > small[name[string]]  # a smaller document has the whole string
        flags_o.append(owner[rest])
        flags_s.append(start[rest])
        flags_n.append(count[string[rest]])
        left = np.flatnonzero(~rest)
        first_run = np.searchsorted(run_of, name[string[left]])
        runs = np.searchsorted(run_of, name[string[left]], "right") - first_run
        left, run = np.repeat(left, runs), np.arange(int(runs.sum())) + np.repeat(first_run - np.cumsum(runs) + runs, runs)
        flags_o.append(owner[left])
        flags_s.append(start[left] + run_start[run])
        flags_n.append(run_n[run])
        o, s, n = np.concatenate(flags_o), np.concatenate(flags_s), np.concatenate(flags_n)
        out = []
        for k, at in _groups(g[o]):
            own, place = np.unique(o[at], return_inverse=True)
            out.append((k, _blob(doc[own], h[own], place.astype(np.int32), s[at].astype(np.int32), n[at].astype(np.int32))))
        return _table("g", out)

    return run


def _spans(starts: np.ndarray, windows: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal covered byte runs of the flagged windows."""
    order = np.argsort(starts, kind="stable")
    s = starts[order].astype(np.int64)
    e = np.maximum.accumulate(s + windows[order] + length - 1)
    fresh = np.ones(len(s), bool)
    fresh[1:] = s[1:] > e[:-1]
    head = np.flatnonzero(fresh)
    return list(zip(s[head].tolist(), e[np.append(head[1:], len(s)) - 1].tolist(), strict=True))


def _whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(length: int, mode: str):
    def run(texts: pa.Table, flags: pa.Table) -> pa.Table:
        got: dict[tuple[int, int], list] = {}
        for b in flags.column("b").to_pylist():
            docs, hs, owner, start, count = _arrays(b, "qqiii")
            for k, at in _groups(owner):
                got.setdefault((int(docs[k]), int(hs[k])), []).append((start[at], count[at]))
        rows, kept_texts = [], []
        for i, h, text in zip(*(texts.column(k).to_pylist() for k in ("i", "h", "t")), strict=True):
            found = got.get((i, h))
            data = (text or "").encode()
            spans = _spans(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), length) if found else []
            if mode == "text":
                spans = _whole_characters(data, spans)
            kept, at = [], 0
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            kept = b"".join([*kept, data[at:]])
            if mode == "text":
                kept_texts.append(kept.decode() if spans else None)
            else:
                rows.append((i, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        if mode == "text":
            return pa.table({"r": texts.column("r"), "t": texts.column("t"), "kept": pa.array(kept_texts, pa.string())})
        names = [f.split()[0] for f in _DIGEST.split(", ")]
        types = [pa.string() if f.endswith("string") else pa.int64() for f in _DIGEST.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=names)

    return run


def groups_of(total: int) -> int:
    """Groups, and shards, of so many bytes of text: in large tables as the root of the bytes, as the groups times the shards are values that are sent."""
    n = max(1, -(-total // GROUP_BYTES))
    paired = max(math.ceil(math.sqrt(PAIRED_GROUPS * n)), -(-n // GROWN)) if n > PAIRED_GROUPS else n
    return max(12, min(paired, MOST_GROUPS))


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _parts(docs: DataFrame, length: int, mode: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(results for texts that are not copies, rows, copies, slim rows). In mode text the rows keep their other columns in ``r``."""
    # by number, as names may hold dots or be those used here
    rest = F.struct(F.col("text").isNull().alias("null"), *(_column(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if c != "text")) if mode == "text" else F.lit(None).cast("boolean")
    rows = docs.select(F.col("doc_id").cast("long").alias("i"), F.coalesce("text", F.lit("")).alias("t"), rest.alias("r"))
    rows = rows.select("i", F.xxhash64("t").alias("h"), "t", "r")
    slim = materialise(rows.select("i", "h", F.octet_length("t").cast("long").alias("n"), F.sha2("t", 256).alias("sha")), "digests")
    total = slim.agg(F.sum("n")).first()[0] or 0
    known = slim.where("i IS NOT NULL")
    firsts = materialise(known.groupBy("sha").agg(F.min("i").alias("first"), F.count("*").alias("m")).where("m > 1").drop("m"), "copied")
    if firsts.count() <= BROADCAST_COPIES:  # beyond it a shuffle between written tables, which splits a much copied text
        firsts = F.broadcast(firsts)
    copies = materialise(known.join(firsts, "sha").where("i > first").select("i", "h", "n", "sha").distinct(), "copies")
    few = copies.count() <= BROADCAST_COPIES
    told = F.broadcast(copies.select("i", "h")) if few else copies.select("i", "h")
    groups, parts = groups_of(total), max(12, -(-total // HASH_BYTES))
    texts = rows.where("i IS NOT NULL").join(told, ["i", "h"], "left_anti")
    texts = texts.select("i", "h", F.pmod(F.xxhash64("i"), F.lit(groups)).cast("int").alias("g"), "t", "r")
    hashes = texts.select("i", "g", "t").mapInArrow(_hashes(length, parts), "p int, b binary")
    shared = hashes.groupBy("p").applyInArrow(_shared, "g int, b binary")
    segments = texts.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(_segments(length, groups), "s int, b binary")
    flags = segments.groupBy("s").applyInArrow(_decided(length), "g int, b binary")
    schema = T.StructType([rows.schema["r"], T.StructField("t", T.StringType()), T.StructField("kept", T.StringType())]) if mode == "text" else _DIGEST
    return texts.groupBy("g").cogroup(flags.groupBy("g")).applyInArrow(_cut(length, mode), schema), rows, told, slim


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    cut, _, copies, slim = _parts(docs, length, "digest")
    gone = F.col("n") >= length
    # rows of a copy: as many as the table has
    whole = slim.join(copies, ["i", "h"], "left_semi").select(F.col("i").alias("doc_id"), F.col("n").alias("n_bytes"), F.when(gone, F.col("n")).otherwise(0).alias("n_removed"), gone.cast("long").alias("n_spans"), F.when(gone, F.lit(_EMPTY)).otherwise(F.col("sha")).alias("kept_sha256"))
    unknown = slim.where("i IS NULL").select(F.col("i").alias("doc_id"), F.col("n").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    return cut.unionByName(whole).unionByName(unknown)


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows, with all their columns, with repeated strings cut from their texts, and n_chars, where there is one, counted anew."""
    cut, rows, copies, _ = _parts(docs, length, "text")
    gone = F.when(F.octet_length("t") >= length, F.lit(""))
    whole = rows.join(copies, ["i", "h"], "left_semi").select("r", "t", gone.alias("kept"))
    unknown = rows.where("i IS NULL").select("r", "t", F.lit(None).cast("string").alias("kept"))
    out = cut.unionByName(whole).unionByName(unknown)
    columns = []
    for k, c in enumerate(docs.columns):
        if c == "text":
            value = F.coalesce("kept", F.when(~F.col("r")["null"], F.col("t")))
        elif c == "n_chars":
            value = F.when(F.col("kept").isNotNull(), F.length("kept").cast(docs.schema[k].dataType)).otherwise(F.col("r")[f"c{k}"])
        else:
            value = F.col("r")[f"c{k}"]
        columns.append(value.alias(c))
    return out.select(*columns)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLE = {
    "op4_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT r, doc_id, hex(b) AS x, octet_length(b) AS n FROM d),
g AS (SELECT r, doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM (SELECT r, doc_id, x, unnest(range(n - 49)) AS p FROM h WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS low FROM g GROUP BY s),
f AS (SELECT r, p FROM g JOIN m USING (s) WHERE doc_id > low),
k AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM f),
i AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS island FROM k),
s AS (SELECT r, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY r, island),
o AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
c AS (SELECT h.r, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(z) AS tail, count(*) AS spans, sum(z - a) AS removed FROM o JOIN h ON h.r = o.r GROUP BY h.r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN c ON c.r = h.r"""
}
