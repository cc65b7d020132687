"""Benchmark decontamination by spaced seeds.

Each fixed mask reads some of a few neighbouring words and ignores those between, so
a replaced word leaves seeds that pass over it. The seeds of the test items are
joined to the seeds of all whole training texts; each hit names a diagonal, on which the
words of item and text are compared one by one. An overlap counts if any stretch of the
diagonal has ``MIN_WORDS`` words or more with at least ``MIN_SIMILAR`` of them equal; no such stretch is without a seed. An item with
fewer words must stand there as a whole, with one word replaced in eight, and word for word under eight; items of less than four words have seeds of their own length.
Words are runs of letters and digits; in scripts without spaces (Chinese, kana, Thai, Lao, Khmer) each character is one.

A test side of at most ``BLOCK_WORDS`` words is broadcast, and joined to the texts in one map: nothing is
shuffled. A larger one is joined by a shuffle: the test seeds set the bits of a broadcast filter of bounded size, texts send the
seeds that pass it, and what meets by hash is verified beside both texts. Nothing of either side reaches the driver but the
filter. A very common seed is split by adaptive skew handling there, and taken in steps of ``STEP`` hits in the map.

Cases: a null or empty text has no overlaps, nor has an item that is null or has no words.
Repeated items and rows are reported each. Empty tables give empty results. Other columns
are not read. ``keep_clean`` drops rows by items of ``least_words`` words or more, as one word or two stand in many clean texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, flat_text, materialise, mix64, release_memory, slices, word_hashes, word_spans

#: Places that each mask reads. No stretch that counts is without a seed of one of them.
MASKS = ((0, 1, 2, 3), (0, 1, 3, 5), (0, 2, 5, 6), (0, 1, 2, 4))
MIN_WORDS, MIN_SIMILAR = 13, 0.7
BLOCK_WORDS, STEP = 400_000, 1 << 20
#: Masks of items with fewer words than any of the others reads.
SHORT = ((0,), (0, 1), (0, 1, 2))
#: Bits of the filter for a larger test side: about sixteen a seed, within bounds (32 MB).
LEAST_BITS, MOST_BITS = 22, 28
_FACTOR = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_BITS = 22


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word, A-Z lower-cased; a character of a script without spaces is a word."""
    starts, ends, row = word_spans(data, offsets, ALNUM)
    part = data[offsets[0] : offsets[-1]]
    if len(part) and part.max() >= 0xE0:
        lead, n = np.flatnonzero(part >= 0xE0), len(part)
        lead = lead[lead + 2 < n]
        a, b = part[lead], part[lead + 1]
        # U+0E00-0EFF Thai and Lao, U+1780-17FF Khmer, U+3040-30FF kana, U+3400-9FFF Chinese, U+F900-FAFF
        alone = lead[(a == 0xE0) & (b >= 0xB8) & (b <= 0xBB) | (a == 0xE1) & (b >= 0x9E) & (b <= 0x9F) | (a == 0xE3) & ((b >= 0x81) & (b <= 0x83) | (b >= 0x90)) | (a >= 0xE4) & (a <= 0xE9) | (a == 0xEF) & (b >= 0xA4) & (b <= 0xAB)]
        if len(alone):
            cut = np.zeros(n + 1, bool)
            cut[alone] = cut[np.minimum(alone + 3, n)] = True
            inside = np.zeros(n + 1, np.int8)
            inside[starts] += 1
            inside[ends] -= 1
            cut = np.flatnonzero(cut & (np.cumsum(inside) > 0))
            starts = np.union1d(starts, cut)
            row = np.searchsorted(offsets[1:] - offsets[0], starts, "right")
            ends = np.minimum(ends[np.searchsorted(ends, starts, "right")], np.append(starts[1:], n))
    return word_hashes(part, starts, ends), row


def seeds(words: np.ndarray, row: np.ndarray, masks: tuple[tuple[int, ...], ...] = MASKS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of each mask; ``row`` says which text a word is of."""
    for mask in masks:
        n = len(words) - mask[-1]
        if n <= 0:
            continue
        at = np.flatnonzero(row[:n] == row[mask[-1] :])
        h = np.full(n, np.uint64(sum(1 << o for o in mask) * int(_FACTOR[3]) & 0xFFFFFFFFFFFFFFFF))
        for o, f in zip(mask, _FACTOR, strict=False):
            h = h + words[o : o + n] * f
        yield at, mix64(h[at])


def item_seeds(words: np.ndarray, row: np.ndarray, items: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the seeds of test items; the short masks are for items of just their length."""
    sizes = np.bincount(row, minlength=items) if len(row) else np.zeros(items, np.int64)
    found = [(h, at) for at, h in seeds(words, row)]
    for mask in SHORT[max(least_words, 1) - 1 :]:
        for at, h in seeds(words, row, (mask,)):
            own = sizes[row[at]] == len(mask)
            found.append((h[own], at[own]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@dataclass
class Index:
    """A test side of bounded size: its words and, sorted by hash, its seeds."""

    items: list[int | None]
    first: np.ndarray
    words: np.ndarray
    hashes: np.ndarray
    places: np.ndarray
    filter: np.ndarray
    masks: tuple[tuple[int, ...], ...]

    @staticmethod
    def of(items: list[tuple[int | None, str]], least_words: int = 1) -> Index:
        offsets, data = flat_text(pa.array([t for _, t in items], pa.string()))
        words, row = words_of(data, offsets)
        h, places = item_seeds(words, row, len(items), least_words)
        order = np.argsort(h, kind="stable")
        bits = np.zeros(1 << _BITS, bool)
        bits[h >> np.uint64(64 - _BITS)] = True
        first = np.searchsorted(row, np.arange(len(items) + 1))
        short = tuple(m for m in SHORT if least_words <= len(m) and (np.diff(first) == len(m)).any())
        return Index([i for i, _ in items], first, words, h[order], places[order], bits, MASKS + short)


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Begin and end of the stretch with the best score: 1 for an equal word, -2 for another."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    return int(np.flatnonzero(total[: end + 1] == low[end])[0]), end


def similar_stretch(equal: np.ndarray, need: int, similar: float) -> tuple[int, int] | None:
    """Of the stretches of at least ``need`` words, the one with the most equal words beyond the share ``similar``, if that is none too few."""
    if len(equal) < need:
        return None
    over = np.concatenate([[0.0], np.cumsum(equal - similar)])
    low = np.minimum.accumulate(over[: len(over) - need])
    gain = over[need:] - low
    end = int(np.argmax(gain))
    if gain[end] < -1e-9:
        return None
    return int(np.argmin(over[: end + 1])), end + need


def accepted(equal: np.ndarray, item_words: int, min_words: int, min_similar: float) -> tuple[int, int] | None:
    """The stretch of a diagonal that is an overlap, if there is one: the whole of it before its best part, then any other."""
    need, similar = (min_words, min_similar) if item_words >= min_words else (item_words, 1 - item_words // 8 / item_words)
    for a, b in ((0, len(equal)), best_stretch(equal)):
        if b - a >= need and equal[a:b].sum() >= similar * (b - a):
            return a, b
    return similar_stretch(equal, need, similar)


def overlap_on(item: np.ndarray, words: np.ndarray, shift: int, min_words: int, min_similar: float) -> tuple[int, int, int] | None:
    """(first word of the text, words, equal words) of the overlap on one diagonal: place in the text less place in the item."""
    low, high = max(0, -shift), min(len(item), len(words) - shift)
    equal = item[low:high] == words[low + shift : high + shift]
    found = accepted(equal, len(item), min_words, min_similar)
    return (low + shift + found[0], found[1] - found[0], int(equal[found[0] : found[1]].sum())) if found else None


def better(new: tuple[int, int, int], old: tuple[int, int, int] | None) -> bool:
    """More equal words, then fewer words, then the earlier place."""
    return old is None or (new[2], -new[1], -new[0]) > (old[2], -old[1], -old[0])


def overlaps(data: np.ndarray, offsets: np.ndarray, index: Index, min_words: int = MIN_WORDS, min_similar: float = MIN_SIMILAR) -> list[tuple[int, int, int, int, int]]:
    """(row, item number, first word, words, equal words): the best overlap of each text and item."""
    words, row = words_of(data, offsets)
    first = np.searchsorted(row, np.arange(len(offsets)))
    best: dict[tuple[int, int], tuple] = {}
    for mask in index.masks:
        for at, h in seeds(words, row, (mask,)):
            maybe = np.flatnonzero(index.filter[h >> np.uint64(64 - _BITS)])
            low = np.searchsorted(index.hashes, h[maybe], "left")
            n = np.searchsorted(index.hashes, h[maybe], "right") - low
            maybe, low, n = maybe[n > 0], low[n > 0], n[n > 0]
            for a, b in slices(np.concatenate([[0], np.cumsum(n)]), STEP):
                m = n[a:b]
                p = np.repeat(at[maybe[a:b]], m)
                q = index.places[np.repeat(low[a:b] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))]
                hits = np.stack([row[p], np.searchsorted(index.first, q, "right") - 1, p - q], axis=1)
                if mask in SHORT:  # the seed is the item: its first place in each text says all
                    hits = hits[np.unique(hits[:, 0] * len(index.items) + hits[:, 1], return_index=True)[1]]
                for r, t, shift in np.unique(hits, axis=0).tolist():
                    item, own = index.words[index.first[t] : index.first[t + 1]], words[first[r] : first[r + 1]]
                    found = overlap_on(item, own, shift + int(index.first[t]) - int(first[r]), min_words, min_similar)
                    if found and better(found, best.get((r, t))):
                        best[r, t] = found
    return [(r, t, *v) for (r, t), v in best.items()]


def _items(tests: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return tests.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("b")).where("b IS NOT NULL")


def index_of(tests: DataFrame, least_words: int, block_words: int, id_col: str = "item_id", text_col: str = "text") -> Index | None:
    """The index of a test side that has no more than ``block_words`` words for sure, else None."""
    items = _items(tests, id_col, text_col)
    most = items.agg(F.sum(F.floor(F.length("b") / 2) + 1), F.sum(F.length("b"))).first()
    if (most[1] or 0) > 64 * block_words or (most[0] or 0) > block_words and (most[1] or 0) > block_words:
        return None
    return Index.of([tuple(r) for r in items.collect()], least_words)


def _candidates(docs: DataFrame, tests: DataFrame, least_words: int) -> DataFrame:
    """(k, b_k, shifts): texts and items by key that share seeds, and on which diagonals; a shuffle join by hash."""
    spark = docs.sparkSession

    def test_seeds(batches):
        for batch in batches:
            offsets, data = flat_text(batch.column(1))
            key = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in slices(offsets, 1 << 20):
                o = offsets[i : j + 1]
                words, row = words_of(data[o[0] : o[-1]], o - o[0])
                h, places = item_seeds(words, row, j - i, least_words)
                first = np.searchsorted(row, np.arange(j - i))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key[i + row[places]]), pa.array((places - first[row[places]]).astype(np.int32))], names=["h", "b_k", "q"])

    held = materialise(tests.select("b_k", "b").dropDuplicates(["b_k"]).mapInArrow(test_seeds, "h long, b_k long, q int"), "test-seeds")
    bits = min(max(int(held.count() * 16).bit_length(), LEAST_BITS), MOST_BITS)

    def set_bits(batches):
        out = np.zeros(1 << bits, bool)
        for batch in batches:
            out[batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)] = True
        packed = np.packbits(out).reshape(-1, 1 << min(16, bits - 3))
        some = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([packed[k].tobytes() for k in some], pa.binary())], names=["c", "x"])

    def join_bits(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint8) for x in table.column("x").to_pylist()]
        return pa.table({"c": table.column("c")[:1], "x": pa.array([np.bitwise_or.reduce(parts).tobytes()], pa.binary())})

    # 2^bits / 8 bytes in all, 32 MB at most
    packed = held.select("h").mapInArrow(set_bits, "c int, x binary").groupBy("c").applyInArrow(join_bits, "c int, x binary").toArrow()
    flags = np.zeros((1 << bits) // 8, np.uint8).reshape(-1, 1 << min(16, bits - 3))
    for c, x in zip(packed.column("c").to_pylist(), packed.column("x").to_pylist(), strict=True):
        flags[c] = np.frombuffer(x, np.uint8)
    shared = spark.sparkContext.broadcast(flags.ravel())

    def text_seeds(batches):
        filter_ = shared.value
        for batch in batches:
            offsets, data = flat_text(batch.column(1))
            key = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in slices(offsets, 1 << 20):
                o = offsets[i : j + 1]
                words, row = words_of(data[o[0] : o[-1]], o - o[0])
                first = np.searchsorted(row, np.arange(j - i))
                for at, h in seeds(words, row, MASKS + SHORT[max(least_words, 1) - 1 :]):
                    bit = h >> np.uint64(64 - bits)
                    go = (filter_[bit >> np.uint64(3)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8)) & 1 > 0
                    at, h = at[go], h[go]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key[i + row[at]]), pa.array((at - first[row[at]]).astype(np.int64))], names=["h", "k", "p"])
        release_memory()

    sent = docs.select("k", "t").mapInArrow(text_seeds, "h long, k long, p long")
    return sent.join(held, "h").groupBy("k", "b_k").agg(F.sort_array(F.collect_set(F.col("p") - F.col("q"))).alias("shifts"))


def _keys(text: str) -> dict[str, Column]:
    return {"k": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)}


def _joined(docs: DataFrame, tests: DataFrame, min_words: int, min_similar: float, least_words: int) -> DataFrame:
    """Overlaps (k, k2, b_k, first_word, n_words, n_equal) of texts and items by key, for a test side of any size; docs: (k, k2, t), tests: (b_k, b).

    Texts whose k is the same by chance share candidates, and k2 tells them apart.
    """

    def verify(batches):
        now, words = None, None
        for batch in batches:
            rows = []
            for k, k2, b_k, shifts, text, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, k2) != now:
                    data = text.encode()
                    now, words = (k, k2), words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
                data, best = item.encode(), None
                item_words = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
                for shift in shifts:
                    found = overlap_on(item_words, words, shift, min_words, min_similar)
                    if found and better(found, best):
                        best = found
                if best:
                    rows.append((k, k2, b_k, *best))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["k", "k2", "b_k", "first_word", "n_words", "n_equal"])

    docs, tests = docs.dropDuplicates(["k", "k2"]), tests.dropDuplicates(["b_k"])
    pairs = materialise(_candidates(docs, tests, least_words), "overlap-candidates")
    beside = pairs.join(docs, "k").join(tests, "b_k").select("k", "k2", "b_k", "shifts", "t", "b")
    return beside.sortWithinPartitions("k", "k2").mapInArrow(verify, "k long, k2 long, b_k long, first_word long, n_words long, n_equal long")


_OUT = "doc_id long, item_id long, first_word long, n_words long, n_equal long, similarity double"


def find_overlaps(docs: DataFrame, tests: DataFrame, min_words: int = MIN_WORDS, min_similar: float = MIN_SIMILAR, least_words: int = 1, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each overlap of a document with a test item."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t")).where("t IS NOT NULL")
    index = index_of(tests, least_words, block_words)
    if index is None:
        keyed = texts.withColumns(_keys("t"))
        items = _items(tests, "item_id", "text").withColumn("b_k", F.xxhash64("b"))
        found = materialise(_joined(keyed.select("k", "k2", "t"), items.select("b_k", "b"), min_words, min_similar, least_words), "overlaps")
        named = found.join(keyed.select("k", "k2", F.col("i").alias("doc_id")), ["k", "k2"]).join(items.select("b_k", "item_id"), "b_k")
        return named.select("doc_id", "item_id", "first_word", "n_words", "n_equal", F.round(F.col("n_equal") / F.col("n_words"), 6).alias("similarity"))
    shared = spark.sparkContext.broadcast(index)

    def run(batches):
        held = shared.value
        for batch in batches:
            offsets, data = flat_text(batch.column(1))
            ids, rows = batch.column(0), []
            for i, j in slices(offsets, 1 << 20):
                for r, t, first, n, same in overlaps(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], held, min_words, min_similar):
                    rows.append((ids[i + r].as_py(), held.items[t], first, n, same, round(same / n, 6)))
            if rows:
                types = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in _OUT.split(", ")])

    return texts.mapInArrow(run, _OUT)


def keep_clean(docs: DataFrame, tests: DataFrame, min_words: int = MIN_WORDS, min_similar: float = MIN_SIMILAR, least_words: int = 4, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows, with all their columns, that overlap no test item of ``least_words`` words or more."""
    index = index_of(tests, least_words, block_words)
    if index is None:
        keyed = docs.select(F.col("text").alias("t")).where("t IS NOT NULL").withColumns(_keys("t"))
        items = _items(tests, "item_id", "text").select(F.xxhash64("b").alias("b_k"), "b")
        gone = materialise(_joined(keyed, items, min_words, min_similar, least_words).select(F.col("k").alias("_gone"), F.col("k2").alias("_gone2")).distinct(), "overlapping")
        k = _keys("text")
        return docs.join(gone, (F.when(F.col("text").isNotNull(), k["k"]) == gone["_gone"]) & (k["k2"] == gone["_gone2"]), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf("boolean")
    def clean(texts):
        held = shared.value
        offsets, data = flat_text(texts)
        good = np.ones(len(offsets) - 1, bool)
        for i, j in slices(offsets, 1 << 20):
            for r, *_ in overlaps(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], held, min_words, min_similar):
                good[i + r] = False
        release_memory()
        return pa.array(good)

    return docs.where(clean(F.col("text")))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLE: dict[str, str] = {}
