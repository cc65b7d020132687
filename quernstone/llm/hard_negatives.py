"""Hard-negative mining by an orthogonal PCA rotation.

Vectors become integers, ``floor(scale * x)``, and scores are integer inner products. All vectors are turned by the
eigenvectors of the second moments of a bounded sample, so that the leading components carry most of a product. For a tile of
anchors and rows the partial products of the leading components are summed up in a few steps; the remainder is at most the product of the two
residual norms, plus a slack for rounding. Pairs that this bound keeps below what the anchor has already, or above what it asks for, are discarded after each step, and
survivors are verified by integer products.

Two passes over the rows for each block of anchors: the first finds an anchor's best rows of its own label (positives), the second, for each
positive, the best rows of another label whose score lies in the window ``[low_percent * p, p]`` of the positive's score p. A task keeps
no more than the wanted rows of each anchor (or anchor and positive), and sends them at its end; these are ranked by anchor. Anchors are a stated query set; they go
in blocks of at most ``BLOCK_BYTES``, so their number does not matter to memory. The second pass begins with what the sample's rows give as bounds.

Cases: rows with a null id, label or vector, or with a null or non-finite component take no part, nor do those whose integer vector is longer than 2^31
(scores would not fit 64 bits). Shorter vectors count as filled up with zeros; an empty one scores 0 with all. Rows that repeat id, label and vector are one; a row of an anchor's
own id is never its positive or negative. Equal scores go by id. An anchor without positives, or a positive without negatives, gives no rows; a negative positive score has an empty window.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: Rows of the sample that the rotation is fitted on, and bytes of a block of anchors, which is broadcast.
SAMPLE_ROWS, BLOCK_BYTES = 4096, 64 << 20
#: Rows and anchors of a tile; shares of the sample's energy after which a bound is tested.
TILE_ROWS, TILE_ANCHORS, STEPS = 2048, 256, (0.5, 0.75, 0.9)
#: Beyond this share of survivors the next step is taken for the whole tile.
DENSE = 0.2
LONGEST = 2.0**31
LOWEST, HIGHEST = -(2**63) + 1, 2**63 - 1


@dataclass
class Rotation:
    axes: np.ndarray  # orthogonal, columns by falling energy
    ends: list[int]  # where the steps end, the last one at all components
    slack: float  # of a product, relative to the norms' product

    def turned(self, x: np.ndarray) -> np.ndarray:
        return x.astype(float) @ self.axes


def fit(x: np.ndarray, steps: tuple[float, ...] = STEPS) -> Rotation:
    """The rotation of a sample's second moments."""
    d = x.shape[1]
    values, axes = np.linalg.eigh(x.T.astype(float) @ x)
    energy = np.cumsum(np.maximum(values[::-1], 0))
    share = energy / energy[-1] if d and energy[-1] > 0 else np.ones(d)
    axes = np.ascontiguousarray(axes[:, ::-1])
    ends = sorted({int(np.searchsorted(share, s)) + 1 for s in steps if d} | {d})
    return Rotation(axes, [e for e in ends if e <= d], float(np.linalg.norm(axes.T @ axes - np.eye(d), 2) + (d + 8) * 2.0**-50) if d else 0.0)


@dataclass
class Slots:
    """What is asked for: ``keep`` rows for each slot, of an anchor, with scores of low to high, the best ones first."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def ordered(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last slot of each of n anchors; slots are ordered by anchor."""
        return np.searchsorted(self.anchor, np.arange(n)), np.searchsorted(self.anchor, np.arange(n), "right")


class Miner:
    """The best rows of each slot over the tiles that it is given."""

    def __init__(self, rotation: Rotation, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, slots: Slots, keep: int, same: bool):
        self.rotation, self.ids, self.labels, self.x, self.slots, self.keep, self.same = rotation, ids, labels, vectors, slots, keep, same
        self.y = rotation.turned(vectors)
        self.rest = self._rests(self.y)
        self.begin, self.end = slots.ordered(len(ids))
        self.floor = slots.low.copy()  # a slot's least score that may still be among its best
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # slot, id, score

    def _rests(self, y: np.ndarray) -> list[np.ndarray]:
        """Norms of what lies beyond each step, and of the whole at last."""
        squares = np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1] if y.shape[1] else np.zeros((len(y), 0))
        at = lambda e: np.sqrt(squares[:, e]) if e < y.shape[1] else np.zeros(len(y))
        return [at(e) for e in self.rotation.ends] + [np.sqrt(squares[:, 0]) if y.shape[1] else np.zeros(len(y))]

    def _bounds(self, a: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that any slot of each anchor has use for."""
        low, high = np.full(a.stop - a.start, np.inf), np.full(a.stop - a.start, -np.inf)
        s = slice(self.begin[a.start], self.end[a.stop - 1])
        to = self.slots.anchor[s] - a.start
        np.minimum.at(low, to, self.floor[s].astype(float))
        np.maximum.at(high, to, self.slots.high[s].astype(float))
        # floats next to the integers, so that none is lost
        return np.nextafter(low, -np.inf), np.nextafter(high, np.inf)

    def _survivors(self, a: slice, y: np.ndarray, rest: list[np.ndarray], allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self._bounds(a)
        slack = self.rotation.slack * np.outer(self.rest[-1][a], rest[-1])
        b, begin, whole = self.y[a], 0, True
        sums = np.zeros(allowed.shape)
        for k, end in enumerate(self.rotation.ends):
            last = k == len(self.rotation.ends) - 1
            if whole:
                sums += b[:, begin:end] @ y[:, begin:end].T
                spread = np.outer(self.rest[k][a], rest[k]) + slack
                allowed = allowed & (sums + spread >= low[:, None]) & (sums - spread <= high[:, None])
                if last or np.count_nonzero(allowed) <= DENSE * allowed.size:
                    whole = False
                    r, c = np.nonzero(allowed)
                    part = sums[r, c]
            else:
                step = max(1, (1 << 20) // max(1, end - begin))
                for i in range(0, len(r), step):
                    part[i : i + step] += (b[r[i : i + step], begin:end] * y[c[i : i + step], begin:end]).sum(axis=1)
                spread = self.rest[k][a][r] * rest[k][c] + slack[r, c]
                stay = (part + spread >= low[r]) & (part - spread <= high[r])
                r, c, part = r[stay], c[stay], part[stay]
            begin = end
        return (r, c) if self.rotation.ends else np.nonzero(allowed)

    def add(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        y = self.rotation.turned(x)
        rest = self._rests(y)
        for i in range(0, len(ids), TILE_ROWS):
            t = slice(i, min(i + TILE_ROWS, len(ids)))
            for j in range(0, len(self.ids), TILE_ANCHORS):
                a = slice(j, min(j + TILE_ANCHORS, len(self.ids)))
                allowed = (self.labels[a, None] == labels[None, t]) == self.same
                allowed &= self.ids[a, None] != ids[None, t]
                r, c = self._survivors(a, y[t], [z[t] for z in rest], allowed)
                if len(r):
                    self._verify(a.start + r, t.start + c, ids, x)

    def _verify(self, r: np.ndarray, c: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Integer products of the survivors, and which slots they serve."""
        step = max(1, (1 << 20) // max(1, x.shape[1]))
        for i in range(0, len(r), step):
            a, b = r[i : i + step], c[i : i + step]
            score = (self.x[a] * x[b]).sum(axis=1, dtype=np.int64)
            n = self.end[a] - self.begin[a]
            slot = np.repeat(self.begin[a], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            score, found = np.repeat(score, n), np.repeat(ids[b], n)
            fits = (score >= self.floor[slot]) & (score <= self.slots.high[slot])
            if fits.any():
                self._merge(slot[fits], found[fits], score[fits])

    def _merge(self, slot: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(slot)
        old = np.isin(self.found[0], touched)
        mine = [np.concatenate([f[old], new]) for f, new in zip(self.found, (slot, ids, score), strict=True)]
        order = np.lexsort((mine[1], -mine[2], mine[0]))
        mine = [m[order] for m in mine]
        place = np.arange(len(order)) - np.searchsorted(mine[0], mine[0])
        last = place == self.keep - 1
        self.floor[mine[0][last]] = mine[2][last]
        self.found = tuple(np.concatenate([f[~old], m[place < self.keep]]) for f, m in zip(self.found, mine, strict=True))


def usable(df: DataFrame, id_col: str, label: Column, vector_col: str, scale: int) -> DataFrame:
    """(i, label, x) of the rows that take part; x: the integer vector."""
    v = F.col(vector_col)
    rows = df.select(F.col(id_col).cast("long").alias("i"), label.cast("long").alias("label"), F.transform(v, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("x"), v.alias("_v")).where(F.col("i").isNotNull() & F.col("label").isNotNull() & F.col("_v").isNotNull())
    rows = rows.where(F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) <= LONGEST)))
    return rows.where(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c) <= LONGEST**2).select("i", "label", "x").distinct()


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Integer vectors as rows, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def _pass(rows: DataFrame, block: tuple, rotation: Rotation, slots: Slots, keep: int, same: bool, dims: int) -> DataFrame:
    """(slot, i, score, place) of the ``keep`` best rows of each slot."""
    told = rows.sparkSession.sparkContext.broadcast((block, rotation, slots))

    def run(batches):
        (ids, labels, x), turning, asked = told.value
        miner = Miner(turning, ids, labels, x, asked, keep, same)
        for batch in batches:
            if len(batch):
                miner.add(batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), dims))
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in miner.found], names=["slot", "i", "score"])

    found = rows.select("i", "label", "x").mapInArrow(run, "slot long, i long, score long")
    return found.withColumn("place", F.row_number().over(W.partitionBy("slot").orderBy(F.desc("score"), "i"))).where(F.col("place") <= keep)


def mine(df: DataFrame, is_anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 5, low_percent: int = 80, block_bytes: int = BLOCK_BYTES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor``: a condition over column i."""
    spark = df.sparkSession
    rows = materialise(usable(df, id_col, F.col("label") if label is None else label, vector_col, scale), "vectors")
    anchors, dims = rows.agg(F.count_if(is_anchor), F.max(F.size("x"))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not anchors or dims is None:
        return spark.createDataFrame([], schema)
    sample = rows.orderBy(F.xxhash64(F.lit(12), "i"), "i", "label", "x").limit(sample_rows).toArrow()
    held = (sample.column("i").to_numpy(), sample.column("label").to_numpy(), _matrix(sample.column("x"), dims))
    rotation = fit(held[2])
    blocks = -(-anchors * 32 * (dims + 8) // block_bytes)
    out = None
    for k in range(blocks):
        own = rows.where(is_anchor & (F.pmod(F.xxhash64(F.lit(13), "i"), F.lit(blocks)) == k)).toArrow()
        if not len(own):
            continue
        block = (own.column("i").to_numpy(), own.column("label").to_numpy(), _matrix(own.column("x"), dims))
        ask = Slots(np.arange(len(own)), np.full(len(own), LOWEST), np.full(len(own), HIGHEST))
        ask.low = _begun(rotation, block, held, ask, positives, True)
        best = _pass(rows, block, rotation, ask, positives, True, dims).toArrow()  # as many rows as the block has anchors and positives
        order = np.lexsort((best.column("place").to_numpy(), best.column("slot").to_numpy()))
        at, positive, score = (best.column(c).to_numpy()[order] for c in ("slot", "i", "score"))
        window = score >= 0  # the others' windows are empty
        at, positive, score = at[window], positive[window], score[window]
        if not len(at):
            continue
        slots = Slots(at, np.array([-(-low_percent * int(s) // 100) for s in score], np.int64), score)
        asked = spark.createDataFrame(pa.table({"slot": pa.array(np.arange(len(at))), "anchor_id": block[0][at], "positive_id": positive, "positive_score": score}))
        slots.low = np.maximum(slots.low, _begun(rotation, block, held, slots, negatives, False))
        found = _pass(rows, block, rotation, slots, negatives, False, dims)
        # as many rows as the block has anchors and positives
        got = found.join(F.broadcast(asked), "slot").select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("i").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        got = materialise(got, "mined") if blocks > 1 else got
        out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], schema) if out is None else out


def _begun(rotation: Rotation, block: tuple, held: tuple, slots: Slots, keep: int, same: bool) -> np.ndarray:
    """What the sample's rows, which are rows of the table, give as a slot's least score."""
    miner = Miner(rotation, *block, slots, keep, same)
    miner.add(*held)
    return miner.floor


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.pmod(F.col("vec_id"), F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod(F.col("i"), F.lit(100)) == 0, moved)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLE = {
    "op12_hard_negatives": """
WITH rows AS (
    SELECT DISTINCT vec_id AS i, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
    SELECT a.i AS anchor, a.label = r.label AS same, r.i, list_inner_product(a.x, r.x)::BIGINT AS score
    FROM rows a JOIN rows r ON a.i <> r.i WHERE a.i % 100 = 0
), positives AS (
    SELECT anchor, i AS positive, score AS p FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, i) <= 5
)
SELECT * FROM (
    SELECT p.anchor AS anchor_id, p.positive AS positive_id, (row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.i))::INT AS rank, s.i AS negative_id,
        p.p AS positive_score, s.score AS negative_score
    FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.p <= 100 * s.score AND 100 * s.score <= 100 * p.p
) WHERE rank <= 5
"""
}
