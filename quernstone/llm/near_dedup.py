"""MinHash near-duplicates by fast similarity sketching.

Sketch: in round ``r`` every shingle is hashed to a bin of ``t`` and to a value in
[0, 1); a bin keeps the smallest ``r + value``. Rounds go on until all bins are full:
after round ``t`` each further round serves one bin, so ``2 t`` rounds suffice for any set, and
the share of equal bins estimates the similarity with the concentration of ``t``
independent hashes at the cost of about one pass over a large set.

Texts with equal shingle sets form a class, found by an aggregation on a 128-bit
fingerprint; only its smallest doc_id goes on. Bands of ``rows`` bins give bucket keys; as many
bands as it takes for a pair at the threshold to meet in none with probability 1e-6.
Buckets of one class go, and of buckets with the same members all but one.

Verification is exact, on full sets of 64-bit shingle hashes: a bucket of at most
``block`` classes is one unit. A larger one is dealt into blocks, each verified with ``pivots`` members that
all its blocks share; most of a dense bucket is then one component. Members outside that component meet
every block in further units. So no unit holds much more than two blocks, and a pair of the bucket is passed over
only if both are in the main component already.
A unit counts intersections by a matrix product and gives only a spanning
forest of its links. Components come from alternating star contraction in Spark, with
a written table each round. Nothing about all documents reaches the driver.

Work in a large bucket is its size times its members outside the main component, in blocks;
exact copies cost nothing there, however many.

Cases: a null or empty text, or one without words, has 0 shingles and is its own component.
Fewer than ``width`` words are one shingle. Rows that repeat a doc_id are one document each
with their own set: the id is linked with whatever any of them is. A null id keeps to itself.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, flat_text, materialise, mix64, release_memory, slices, word_hashes, word_spans

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x27D4EB2F165667C5), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))

#: Up to so many ids (8 bytes each) the documents to verify are picked by a broadcast; beyond it by a shuffle.
BROADCAST_IDS = 1_000_000
#: Up to so many bytes the units of those documents are told with their ids; beyond it by a shuffle of just these documents.
BROADCAST_BYTES = 32 << 20


def bands_for(threshold: float, rows: int, miss: float = 1e-6) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row offsets): each row's distinct word shingles, sorted."""
    rows = len(offsets) - 1
    starts, ends, row = word_spans(data, offsets, NOT_SPACE)
    h = word_hashes(data, starts, ends)
    counts = np.bincount(row, minlength=rows)
    first = np.cumsum(counts) - counts
    n = len(h)
    acc = np.zeros(n, np.uint64)
    place = np.arange(n) - first[row] if n else np.zeros(0, np.int64)
    size = counts[row] if n else np.zeros(0, np.int64)
    for k in range(width):  # shorter texts stop at their end
        reach = np.minimum(np.arange(n) + k, max(n - 1, 0))
        acc = acc * _ODD[7] + np.where(place + k < size, h[reach] * _ODD[k % 7], np.uint64(0))
    whole = place + np.minimum(width, size) <= size
    s, r = mix64(acc[whole]), row[whole]
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    s, r = s[keep], r[keep]
    return s, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=rows))]).astype(np.int64)


def sketches(s: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """rows x t sketch; a row without shingles stays at the largest value."""
    rows = len(offsets) - 1
    out = np.full(rows * t, np.uint64(2**64 - 1))
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(rows), sizes)
    open_rows = sizes > 0
    for r in range(2 * t):
        take = open_rows[row]
        if not take.any():
            break
        x, at = s[take], row[take]
        h = mix64(x + np.uint64((2 * r + 1) * int(_ODD[r % 8]) & 0xFFFFFFFFFFFFFFFF))
        slot = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if r < t else np.full(len(h), r - t)
        np.minimum.at(out, at * t + slot, (np.uint64(r) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
        open_rows = open_rows & (out.reshape(rows, t) == np.uint64(2**64 - 1)).any(axis=1)
    return out.reshape(rows, t)


def band_keys(sk: np.ndarray, rows: int) -> np.ndarray:
    n, t = sk.shape
    bands = t // rows
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _ODD[0], (n, bands)).copy()
    parts = sk[:, : bands * rows].reshape(n, bands, rows)
    for k in range(rows):
        acc = mix64(acc * _ODD[1] + parts[:, :, k])
    return acc


def _signatures(docs: DataFrame, width: int, threshold: float, rows: int) -> DataFrame:
    bands = bands_for(threshold, rows)

    def run(batches):
        for batch in batches:
            offsets, data = flat_text(batch.column(1))
            for i, j in slices(offsets, 1 << 20):
                s, o = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                sizes = np.diff(o)
                keys = band_keys(sketches(s, o, bands * rows), rows).astype(np.int64)
                a = np.zeros(j - i, np.uint64)
                b = np.zeros(j - i, np.uint64)
                has = sizes > 0
                if has.any():
                    a[has] = np.add.reduceat(s, o[:-1][has])
                    b[has] = np.add.reduceat(mix64(s ^ _ODD[3]), o[:-1][has])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(sizes.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists], names=["i", "n", "f1", "f2", "bands"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t")).mapInArrow(run, "i long, n long, f1 long, f2 long, bands array<long>")


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links 100 * |a & b| >= percent * |a | b| between the sets."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    counts = np.bincount(place, minlength=len(values))
    shared = counts[place] > 1  # a shingle of one set adds to no intersection
    place, owner = place[shared], owner[shared]
    names = np.cumsum(counts > 1) - 1
    place = names[place]
    inter = np.zeros((m, m), np.float32)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    step = max(256, (1 << 22) // m)
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        a, b = np.searchsorted(place, [lo, lo + step])
        part = np.zeros((m, step), np.float32)
        part[owner[a:b], place[a:b] - lo] = 1
        inter += part @ part.T
    union = sizes[:, None] + sizes[None, :] - inter
    hit = 100 * inter.astype(np.float64) >= percent * union
    np.fill_diagonal(hit, False)
    edges: list[tuple[int, int]] = []
    seen = np.zeros(m, bool)
    for k in range(m):
        if seen[k]:
            continue
        seen[k], queue = True, [k]
        while queue:
            near = np.flatnonzero(hit[queue.pop()] & ~seen)
            seen[near] = True
            edges += [(k, int(x)) for x in near]
            queue += near.tolist()
    return edges


def _verified(members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (a, b) between the members of each unit; members: (i, units array), a unit being named by a hash: two that share it by chance are verified as one."""

    def sets_of(batches):
        for batch in batches:
            offsets, data = flat_text(batch.column(1))
            for i, j in slices(offsets, 1 << 20):
                s, o = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], pa.array([s[a:b].tobytes() for a, b in zip(o[:-1], o[1:], strict=True)], pa.binary())], names=["i", "units", "s"])
        release_memory()

    def run(batches):
        now, ids, sets, out = None, [], [], []

        def done():
            if len(ids) > 1:
                out.extend((ids[a], ids[b]) for a, b in linked(sets, percent))

        for batch in batches:
            for unit, i, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if unit != now:
                    done()
                    now, ids, sets = unit, [], []
                ids.append(i)
                sets.append(np.frombuffer(s, np.uint64))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        done()
        release_memory()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    n, size = members.agg(F.count("*"), F.sum(16 + 8 * F.size("units"))).first()
    texts = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t"))
    if n <= BROADCAST_IDS and (size or 0) > BROADCAST_BYTES:
        texts = texts.join(F.broadcast(members.select("i")), "i", "left_semi")
    told = F.broadcast(members) if n <= BROADCAST_IDS and (size or 0) <= BROADCAST_BYTES else members
    texts = texts.join(told, "i").select("i", "t", "units")
    rows = texts.mapInArrow(sets_of, "i long, units array<long>, s binary").select(F.explode("units").alias("unit"), "i", "s")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(parts, "unit").sortWithinPartitions("unit", "i").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(i, c): the smallest id of the component, for every id with an edge but that one; alternating large and small stars."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    signature, few = None, now.count() <= BROADCAST_IDS // 2
    told = F.broadcast if few else (lambda df: df)  # a star's centre is in many edges; beyond the bound the join is a shuffle
    while True:
        both = now.union(now.select("b", "a"))
        low = told(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        # large star: greater neighbours to the smallest of the neighbourhood
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = told(large.groupBy("a").agg(F.min("b").alias("m")))
        # small star: the other smaller neighbours, and the node, to the smallest
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = materialise(small, label)
        got = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(got) == signature:
            return now.groupBy("a").agg(F.min("b").alias("c")).select(F.col("a").alias("i"), "c")
        signature = tuple(got)


def _dealt(seed: int, n: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "i"), n.cast("long")).cast("int")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, rows: int = 5, block: int = 512, pivots: int = 16) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    sig = materialise(_signatures(docs, width, percent / 100, rows), "signatures")
    classes = sig.where("n > 0 AND i IS NOT NULL").groupBy("f1", "f2", "n").agg(F.min("i").alias("rep"), F.count("*").alias("copies"), F.min_by("bands", "i").alias("bands"))
    classes = materialise(classes, "classes")
    keyed = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = keyed.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("rep").alias("low"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sum")).where("m > 1")
    buckets = buckets.groupBy("m", "low", "sum").agg(F.min(F.struct("band", "key")).alias("k")).select("m", "k.band", "k.key")
    buckets = materialise(buckets, "buckets")
    hits = keyed.join(buckets, ["band", "key"]).select(F.col("rep").alias("i"), "m", F.concat_ws(":", "band", "key").alias("name"))

    def verified(units: DataFrame, label: str) -> DataFrame:
        members = materialise(units.groupBy("i").agg(F.collect_set("unit").alias("units")), f"{label}-members")
        return materialise(_verified(members, docs, width, percent), f"{label}-edges")

    edges = hits.where(F.col("m") <= block).select("i", F.xxhash64("name").alias("unit"))
    large = hits.where(F.col("m") > block)
    n_large = buckets.where(F.col("m") > block).count()
    if n_large:
        # each block of a large bucket, with some members that all its blocks share
        large = materialise(large.select("i", "name", F.ceil(F.col("m") / block).cast("int").alias("g"), _dealt(3, F.ceil(F.col("m") / block)).alias("k")), "large")
        shared = large.groupBy("name", "g").agg(*(F.min(F.struct(F.xxhash64(F.lit(p), "i"), "i"))["i"].alias(f"p{p}") for p in range(pivots)))
        shared = shared.select(F.explode(F.array_distinct(F.array(*(f"p{p}" for p in range(pivots))))).alias("i"), "name", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("k"))
        unit = F.xxhash64("name", "k").alias("unit")
        edges = edges.unionByName(large.select("i", unit)).unionByName(shared.select("i", unit))
    edges = verified(edges, "first")
    found = components(edges)
    if n_large:
        # what is not in a large bucket's main component meets all of its blocks
        labels = large.join(found, "i", "left").select("i", "name", "g", "k", F.coalesce("c", "i").alias("c"))
        labels = materialise(labels, "labels")
        main = labels.groupBy("name", "c").agg(F.count("*").alias("n")).groupBy("name").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
        main = main.select("name", "main", F.ceil((F.col("all") - F.col("most")) / block).cast("int").alias("h")).where("h > 0")
        rest = labels.join(F.broadcast(main) if n_large <= BROADCAST_IDS // 4 else main, "name")
        own = rest.where("c <> main").select("i", "name", _dealt(5, F.col("h")).alias("r"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("k"))
        all_ = rest.select("i", "name", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("r"), "k")
        more = verified(own.unionByName(all_).select("i", F.xxhash64("name", "r", "k").alias("unit")), "second")
        found = components(edges.unionByName(more))
    labelled = classes.select("f1", "f2", "n", "rep").join(found.select(F.col("i").alias("rep"), "c"), "rep", "left").select("f1", "f2", "n", F.coalesce("c", "rep").alias("component_id"))
    out = sig.select("i", "n", "f1", "f2").join(labelled, ["f1", "f2", "n"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "i")).otherwise(F.col("i"))
    return out.select(F.col("i").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("i")).alias("kept"))


def keep_representatives(docs: DataFrame, percent: int = 80, **options) -> DataFrame:
    """The rows, with all their columns, of each component's smallest id (every row of it, if it repeats), and those without an id."""
    groups = near_duplicates(docs, percent=percent, **options)
    gone = materialise(groups.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_near_dedup": op9_near_dedup}
ORACLE = {
    "op9_near_dedup": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM sets),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(i, c) AS (SELECT doc_id, doc_id FROM sets UNION SELECT t.b, r.c FROM reach r JOIN both_ways t ON t.a = r.i),
c AS (SELECT i, min(c) AS c FROM reach GROUP BY i)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, c = doc_id AS kept FROM sets JOIN c ON i = doc_id"""
}
