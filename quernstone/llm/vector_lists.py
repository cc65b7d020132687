"""Approximate nearest neighbours over balanced posting lists.

Largest inner product becomes smallest distance on a sphere by one more component,
``sqrt(M^2 - |x|^2)``, with M the greatest norm. Centroids come from balanced k-means on
a bounded sample (``sample_rows`` vectors with the smallest id hashes, more where more lists need them), at most ``max_lists`` of
them; beyond ``FLAT_LISTS`` in two levels, coarse clusters and lists within each. All vectors are then posted: each to its nearest
centroid and, if it lies near a boundary, to
others as well, within ``boundary`` of the nearest distance and unless the new centroid
is nearer to one already chosen than to the vector.

A query finds centroids in an in-memory neighbour graph. It searches its nearest lists first, and then those
whose centroid is within a ratio of the nearest one's distance, but for lists that its k-th answer so far rules out: a
list's widest angle about its centroid bounds the scores in it. A query that has fewer answers than asked for by then looks into all lists. The ratio is measured, not guessed: up to ``TRIAL_QUERIES`` queries are
answered by brute force over all rows (one pass, each task keeping k a query), and the ratio is the smallest that reaches the share ``target`` of their
true neighbours. So vectors without clusters are searched widely and clustered ones narrowly, with one recall. Without a
``target`` no ratio applies, and the answers are the exact ones.

Neighbouring lists make a block of about ``chunk`` vectors (more in large tables, up to ``MOST_CHUNK``), and a query is sent to a block
once. A list beyond that is dealt into chunks, with its queries sent to each, so a third of
all rows near one centroid are many tasks; the queries of a block beyond ``QUERY_ROWS`` are dealt out likewise. Chunks preselect by a matrix
product and give exact scores in double precision; the answers of a query are merged by score, then id.

Cases: vectors that are null, zero, of another length than most (ties: the shorter), or holding a null or
non-finite component take no part, as query or candidate; nor do rows without an id. With fewer
candidates than asked for, all are returned. Equal scores go by id. Rows that repeat an id and a vector are
one candidate. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

SAMPLE_ROWS, MAX_LISTS, LIST_ROWS = 20_000, 65_536, 160
#: Lists fitted at one level; sample rows for a list.
FLAT_LISTS, LIST_SAMPLE = 4096, 4
#: Vectors of a chunk at most, and queries that meet it at once.
MOST_CHUNK, QUERY_ROWS = 8192, 4096
#: Queries that are routed at once: their angles to all of 65,536 lists take 64 MB.
ROUTED = 128
#: Queries that measure the ratio, and the share of their neighbours that it keeps.
TRIAL_QUERIES, TARGET = 256, 0.98


@dataclass
class Lists:
    centroids: np.ndarray
    graph: np.ndarray  # lists x degree
    entry: np.ndarray  # where searches begin
    greatest: float  # norm M
    coarse: np.ndarray  # the coarse cluster of each list

    def lifted(self, v: np.ndarray) -> np.ndarray:
        """Data vectors with the component that puts them on the sphere of radius 1."""
        rest = np.sqrt(np.maximum(self.greatest**2 - (v * v).sum(axis=1), 0))
        return np.concatenate([v, rest[:, None]], axis=1) / self.greatest

    def directions(self) -> np.ndarray:
        return self.centroids / np.maximum(np.linalg.norm(self.centroids, axis=1, keepdims=True), 1e-300)

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Queries: direction alone matters."""
        return np.concatenate([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))], axis=1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)


def balanced_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 6) -> np.ndarray:
    """k-means in which a list's size so far adds to its distance, so that lists come out even."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    load = np.zeros(k)
    for _ in range(rounds):
        label = np.concatenate([np.argmin(_squares(x[i : i + 2048], c) + load, axis=1) for i in range(0, len(x), 2048)])
        sizes = np.bincount(label, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, label, x)
        c = np.where(sizes[:, None] > 0, total / np.maximum(sizes, 1)[:, None], x[rng.choice(len(x), k)])
        spread = _squares(x[:2048], c).min(axis=1).mean()
        load = 0.3 * spread * np.clip(sizes / (len(x) / k) - 1, -1, 4)
    return c


def two_level_means(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, the coarse cluster of each): above FLAT_LISTS each coarse cluster has lists by its share of the sample."""
    if k <= FLAT_LISTS:
        return balanced_means(x, k), np.zeros(k, np.int64)
    top = balanced_means(x, int(np.sqrt(k)))
    label = np.concatenate([np.argmin(_squares(x[i : i + 2048], top), axis=1) for i in range(0, len(x), 2048)])
    found, of = [], []
    for c in range(len(top)):
        part = x[label == c]
        if len(part):
            own = balanced_means(part, min(len(part), max(1, round(k * len(part) / len(x)))))
            found.append(own)
            of.append(np.full(len(own), len(of), np.int64))
    return np.concatenate(found), np.concatenate(of)


def neighbour_graph(c: np.ndarray, coarse: np.ndarray, degree: int = 24) -> np.ndarray:
    """For each centroid its nearest ones, in its own and the eight nearest coarse clusters, and a few seeded far ones."""
    k = len(c)
    near = min(degree, k - 1)
    if near <= 0:
        return np.zeros((k, 1), np.int64)
    n = int(coarse.max()) + 1
    means = np.stack([c[coarse == g].mean(axis=0) for g in range(n)])
    gaps = _squares(means, means)
    out = np.zeros((k, near), np.int64)
    for g in range(n):
        own = np.flatnonzero(coarse == g)
        order = np.argsort(gaps[g], kind="stable")
        wide = 9
        others = np.flatnonzero(np.isin(coarse, order[:wide]))
        while len(others) <= near:
            wide *= 2
            others = np.flatnonzero(np.isin(coarse, order[:wide]))
        for a in range(0, len(own), 512):
            rows = own[a : a + 512]
            d = _squares(c[rows], c[others])
            d[rows[:, None] == others[None, :]] = np.inf
            pick = np.argpartition(d, near - 1, axis=1)[:, :near]
            out[rows] = others[pick]
    far = np.random.default_rng(8).integers(0, k, (k, 4))
    return np.concatenate([out, far], axis=1)


def search_graph(lists: Lists, q: np.ndarray, want: int, beam: int = 96) -> tuple[np.ndarray, np.ndarray]:
    """(centroid numbers, squared distances) of the ``want`` nearest found for each query, best first; -1 pads."""
    c, k = lists.centroids, len(lists.centroids)
    beam = min(max(beam, want), k)
    n = len(q)
    start = np.broadcast_to(lists.entry, (n, len(lists.entry)))
    seen = np.zeros((n, k), bool)
    rows = np.arange(n)[:, None]
    seen[rows, start] = True
    dist = _squares(q, c[lists.entry])
    order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
    ids, dist = np.take_along_axis(start, order, 1), np.take_along_axis(dist, order, 1)
    opened = np.zeros_like(ids, bool)
    while True:
        cost = np.where(opened, np.inf, dist)
        step = min(4, cost.shape[1])
        pick = np.argpartition(cost, step - 1, axis=1)[:, :step]
        live = np.isfinite(np.take_along_axis(cost, pick, 1))
        go = live.any(axis=1)
        if not go.any():
            break
        np.put_along_axis(opened, pick, True, axis=1)
        near = lists.graph[np.take_along_axis(ids, pick, 1)].reshape(n, -1)
        fresh = ~seen[rows, near] & np.repeat(live, lists.graph.shape[1], axis=1)
        seen[rows, near] |= fresh
        near_d = np.full(near.shape, np.inf)
        r, s = np.nonzero(fresh)
        diff = q[r] - c[near[r, s]]
        near_d[r, s] = np.einsum("ij,ij->i", diff, diff)
        # one centroid may stand twice among a row's neighbours: keep the first
        by = np.argsort(near, axis=1, kind="stable")
        sorted_ids = np.take_along_axis(near, by, 1)
        again = np.zeros(near.shape, bool)
        np.put_along_axis(again, by[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], axis=1)
        near_d[again] = np.inf
        ids, dist, opened = np.concatenate([ids, near], 1), np.concatenate([dist, near_d], 1), np.concatenate([opened, ~np.isfinite(near_d)], 1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids, dist, opened = (np.take_along_axis(x, order, 1) for x in (ids, dist, opened))
        opened |= ~np.isfinite(dist)
    return np.where(np.isfinite(dist), ids, -1)[:, :want], dist[:, :want]


def within_ratio(lists: Lists, q: np.ndarray, ratio: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, centroids, places) of the ``least`` nearest centroids and all within ``ratio`` of the nearest distance; found in the graph, more of it while the farthest found still counts."""
    k, todo, want = len(lists.centroids), np.arange(len(q)), max(least, 32)
    rows, found, places = [], [], []
    while len(todo):
        if 2 * want >= k:
            dist = _squares(q[todo], lists.centroids)
            ids = np.argsort(dist, axis=1, kind="stable")
            dist = np.take_along_axis(dist, ids, 1)
        else:
            ids, dist = search_graph(lists, q[todo], want, want + want // 2)
        limit = dist[:, :1] * ratio * ratio
        place = np.arange(ids.shape[1])
        good = (ids >= 0) & ((place < least) | (dist <= limit))
        done = (dist[:, -1] > limit[:, 0]) | (2 * want >= k)
        r, at = np.nonzero(good & done[:, None])
        rows.append(todo[r])
        found.append(ids[r, at])
        places.append(at)
        todo, want = todo[~done], want * 4
    return np.concatenate(rows), np.concatenate(found), np.concatenate(places)


def posted(lists: Lists, x: np.ndarray, boundary: float, copies: int) -> list[list[int]]:
    """For each vector the lists it is posted to."""
    ids, dist = search_graph(lists, x, copies, 48)
    out = []
    for row, d in zip(ids, dist, strict=True):
        chosen = [int(row[0])]
        limit = d[0] * (1 + boundary) ** 2
        for c, dc in zip(row[1:], d[1:], strict=True):
            if c < 0 or dc > limit:
                break
            gaps = ((lists.centroids[chosen] - lists.centroids[c]) ** 2).sum(axis=1)
            if (gaps > dc).all():
                chosen.append(int(c))
        out.append(chosen)
    return out


def lists_for(rows: int, list_rows: int = LIST_ROWS, max_lists: int = MAX_LISTS) -> int:
    return max(1, min(max_lists, rows // list_rows))


def fit(vectors: np.ndarray, greatest: float, rows: int, list_rows: int = LIST_ROWS, max_lists: int = MAX_LISTS) -> Lists:
    """Centroids and graph for ``rows`` vectors, from a sample of them."""
    k = max(1, min(lists_for(rows, list_rows, max_lists), len(vectors) // LIST_SAMPLE))
    lists = Lists(np.zeros((1, 1)), np.zeros((1, 1), np.int64), np.zeros(1, np.int64), greatest, np.zeros(1, np.int64))
    lists.centroids, lists.coarse = two_level_means(lists.lifted(vectors), k)
    lists.graph = neighbour_graph(lists.centroids, lists.coarse)
    lists.entry = np.unique(np.linspace(0, len(lists.centroids) - 1, min(len(lists.centroids), 48)).astype(np.int64))
    return lists


def without_empty(lists: Lists, sizes: np.ndarray) -> tuple[Lists, np.ndarray]:
    """(the lists that have vectors, their numbers): what queries are to find."""
    live = np.flatnonzero(sizes)
    coarse = np.unique(lists.coarse[live], return_inverse=True)[1]
    centroids = lists.centroids[live]
    return Lists(centroids, neighbour_graph(centroids, coarse), np.unique(np.linspace(0, len(live) - 1, min(len(live), 48)).astype(np.int64)), lists.greatest, coarse), live


def blocks_of(centroids: np.ndarray, sizes: np.ndarray, chunk: int, coarse: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(block of each list, chunks of each block): neighbouring lists, of one coarse cluster, share a block; a list over ``chunk`` has its own."""
    k = len(sizes)
    coarse = np.zeros(k, np.int64) if coarse is None else coarse
    block, held = np.zeros(k, np.int64), []
    for g in range(int(coarse.max()) + 1):
        own = np.flatnonzero(coarse == g)
        points, left, at = centroids[own], np.ones(len(own), bool), 0
        for step in range(len(own)):
            left[at] = False
            n = int(sizes[own[at]])
            if not held or not step or held[-1] + n > chunk:
                held.append(0)
            held[-1] += n
            block[own[at]] = len(held) - 1
            gaps = ((points - points[at]) ** 2).sum(axis=1)
            gaps[~left] = np.inf
            at = int(np.argmin(gaps))
    return block, np.maximum(1, -(-np.array(held) // chunk))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(i, v): rows that can take part, vectors in double precision."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("i"), v.alias("v")).where("i IS NOT NULL AND v IS NOT NULL").where(fine & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in column.to_numpy(zero_copy_only=False)]) if len(column) else np.zeros((0, 1))


def _true_neighbours(rows: DataFrame, trial: pa.Table, k: int) -> DataFrame:
    """(q, i): the k nearest rows of each trial query, by brute force; a task keeps k a query."""
    qi, q = trial.column("i").to_numpy(), _matrix(trial.column("v").combine_chunks())

    def run(batches):
        best_s, best_i = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
        for batch in batches:
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            for a in range(0, len(x), 8192):
                s = q @ x[a : a + 8192].T
                own = np.broadcast_to(ids[a : a + 8192], s.shape)
                s[qi[:, None] == own] = -np.inf
                s, own = np.concatenate([best_s, s], 1), np.concatenate([best_i, own], 1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, top, 1), np.take_along_axis(own, top, 1)
        r, c = np.nonzero(np.isfinite(best_s))
        yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(best_i[r, c]), pa.array(best_s[r, c])], names=["q", "i", "score"])

    found = rows.select("i", "v").mapInArrow(run, "q long, i long, score double")
    order = W.partitionBy("q").orderBy(F.desc("score"), "i")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "i")


def measured_ratio(rows: DataFrame, postings: DataFrame, asking: DataFrame, lists: Lists, sizes: np.ndarray, k: int, target: float, first_lists: int) -> float:
    """The least ratio of a list's distance to the nearest list's that reaches the share ``target`` of true neighbours of the trial queries."""
    trial = asking.select("i", "v").orderBy(F.xxhash64(F.lit(9), "i"), "i").limit(TRIAL_QUERIES).toArrow()
    if not len(trial):
        return 1.0
    # at most TRIAL_QUERIES * k pairs, in a few lists each
    true = _true_neighbours(rows, trial, k)
    got = postings.select("list", "i").join(F.broadcast(true), "i").select("q", "i", "list").toArrow()
    place = {int(i): n for n, i in enumerate(trial.column("i").to_pylist())}
    dist = np.sqrt(_squares(lists.asked(_matrix(trial.column("v").combine_chunks())), lists.centroids))
    dist[:, sizes == 0] = np.inf
    nearest = dist.min(axis=1)
    order = np.argsort(np.argsort(dist, axis=1, kind="stable"), axis=1, kind="stable")
    need: dict[tuple[int, int], float] = {}
    for q, i, c in zip(*(got.column(x).to_pylist() for x in ("q", "i", "list")), strict=True):
        r = place[q]
        ratio = 1.0 if order[r, c] < first_lists else float(dist[r, c] / max(nearest[r], 1e-300))
        need[q, i] = min(ratio, need.get((q, i), np.inf))
    return float(np.quantile(list(need.values()), target, method="higher")) * (1 + 1e-9) if need else 1.0


def most_cosines(part: np.ndarray, ways: np.ndarray, widest: np.ndarray) -> np.ndarray:
    """The greatest cosine that each query of a block may have with a vector of each list: a row a query, a column a list, in place in one array."""
    angle = part @ ways.T
    np.clip(angle, -1, 1, out=angle)
    np.arccos(angle, out=angle)
    angle -= widest
    np.maximum(angle, 0, out=angle)
    return np.cos(angle, out=angle)


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, target: float | None = None, boundary: float = 0.10, copies: int = 4, first_lists: int = 6, chunk: int = 512, sample_rows: int = SAMPLE_ROWS, max_lists: int = MAX_LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (over column i), its k nearest others; ``target``: the share of them to find, None for all."""
    spark = df.sparkSession
    rows = materialise(usable(df, id_col, vector_col).distinct(), "vectors")
    n, greatest = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    sample_rows = max(sample_rows, LIST_SAMPLE * lists_for(n, max_lists=max_lists))
    key = F.xxhash64(F.lit(6), "i")
    share = min(1.0, 1.2 * sample_rows / n)
    sample = rows.where(key <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)).select(key.alias("k"), "v").limit(2 * sample_rows).toArrow()
    order = np.argsort(sample.column("k").to_numpy(), kind="stable")[:sample_rows]
    lists = fit(_matrix(sample.column("v").combine_chunks())[order], float(greatest) * (1 + 1e-9), n, max_lists=max_lists)
    del sample, order
    shared = spark.sparkContext.broadcast(lists)

    def post(batches):
        held = shared.value
        for batch in batches:
            x = held.lifted(_matrix(batch.column(1)))
            for a in range(0, len(x), 1024):
                to = posted(held, x[a : a + 1024], boundary, copies)
                sizes = [len(t) for t in to]
                at = np.repeat(np.arange(a, a + len(to)), sizes)
                to = np.concatenate(to).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(to), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array((x[at] * held.directions()[to]).sum(axis=1))], names=["list", "i", "v", "cosine"])

    postings = materialise(rows.mapInArrow(post, "list int, i long, v array<double>, cosine double"), "postings")
    # as many rows as there are lists, which max_lists bounds
    sizes, widest = np.zeros(len(lists.centroids), np.int64), np.zeros(len(lists.centroids))
    for r in postings.groupBy("list").agg(F.count("*").alias("n"), F.min("cosine").alias("cosine")).collect():
        sizes[r["list"]], widest[r["list"]] = r["n"], np.arccos(np.clip(r["cosine"], -1, 1)) + 1e-7
    chunk = max(chunk, min(MOST_CHUNK, n // 128))
    block, chunks = blocks_of(lists.centroids, sizes, chunk, lists.coarse)
    asking = rows.where(is_query)
    ratio = np.inf if target is None else measured_ratio(rows, postings, asking, lists, sizes, k, target, first_lists)
    found_in, live = without_empty(lists, sizes)
    told = spark.sparkContext.broadcast((found_in, widest[live], block[live]))

    n_blocks = len(chunks)

    def probing(first: bool):
        """A map from queries to the blocks of their first lists, or to those of the other ones within the ratio that may add to their answers."""

        def probe(batches):
            held, widest, block = told.value
            ways = held.directions()
            for batch in batches:
                vectors = _matrix(batch.column(1))
                q, length = held.asked(vectors), np.linalg.norm(vectors, axis=1)
                low, had = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3)
                for a in range(0, len(q), ROUTED):
                    part = q[a : a + ROUTED]
                    r, c, place = within_ratio(held, part, 0.0 if first else ratio, first_lists)
                    every = np.zeros(0, np.int64)
                    if first:
                        goes = place < first_lists
                    else:
                        bar = low[a : a + ROUTED]
                        most = most_cosines(part, ways, widest)[r, c] * held.greatest * length[a + r]
                        goes = most >= bar[r] - 1e-9 * np.maximum(1, np.abs(most))
                        # with fewer than k answers so far a query looks into all blocks
                        every = (np.flatnonzero(np.isneginf(bar))[:, None] * n_blocks + np.arange(n_blocks)).ravel()
                    mine = had[a : a + ROUTED]
                    begun = np.repeat(np.arange(len(part)), mine.value_lengths().to_numpy()) * n_blocks + mine.flatten().to_numpy()
                    pairs = np.setdiff1d(np.concatenate([r[goes] * n_blocks + block[c[goes]], every]), begun)
                    at, to = pairs // n_blocks, pairs % n_blocks
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *(batch.column(x).take(pa.array(a + at, pa.int64())) for x in range(3))], names=["block", "i", "v", "low"])

        return probe

    of = lambda values, at: F.element_at(F.lit(values.tolist()), F.col(at) + 1).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    data = postings.select(of(block, "list").alias("block"), "i", "v").select("block", F.pmod(F.xxhash64("i"), of(chunks, "block").cast("long")).cast("int").alias("part"), "i", "v")

    def scan(points: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(points) and len(queries):
            x, q = _matrix(points.column("v").combine_chunks()), _matrix(queries.column("v").combine_chunks())
            pi, qi, low = points.column("i").to_numpy(), queries.column("i").to_numpy(), queries.column("low").to_numpy()
            by = np.argsort(pi, kind="stable")
            x, pi = x[by], pi[by]
            kept = []
            for a in range(0, len(q), 256):
                rough = q[a : a + 256] @ x.T
                rough[qi[a : a + 256, None] == pi[None, :]] = -np.inf
                take = min(k, len(pi))
                floor = -np.partition(-rough, take - 1, axis=1)[:, take - 1]
                floor = np.maximum(floor, low[a : a + 256])
                slack = np.where(np.isfinite(floor), 1e-9 * np.maximum(1, np.abs(floor)), 0)
                r, c = np.nonzero((rough >= (floor - slack)[:, None]) & np.isfinite(rough))
                score = (q[a + r] * x[c]).sum(axis=1)
                order = np.lexsort((pi[c], -score, r))
                r, c, score = r[order], c[order], score[order]
                top = np.arange(len(r)) - np.searchsorted(r, r) < k
                kept.append((qi[a + r[top]], pi[c[top]], score[top]))
            out = [np.concatenate(z) for z in zip(*kept, strict=True)]
        return pa.table(dict(zip(("q", "i", "score"), out, strict=True)))

    def found(queries: DataFrame, first: bool) -> tuple[DataFrame, DataFrame]:
        """(answers, queries as sent): answers from the blocks that queries are sent to; a block's queries are dealt out by their number, its chunks told to as many parts."""
        sent = materialise(queries.mapInArrow(probing(first), "block int, i long, v array<double>, low double"), "sent")
        parts = np.zeros(len(chunks), np.int64)  # as many rows as there are blocks
        for r in sent.groupBy("block").count().collect():
            parts[r["block"]] = -(-r["count"] // QUERY_ROWS)
        asked = sent.select("block", every(of(chunks, "block")).alias("part"), F.pmod(F.xxhash64(F.lit(7), "i"), of(parts, "block").cast("long")).cast("int").alias("asked"), "i", "v", "low")
        points = data.where(of(parts, "block") > 0).select("block", "part", every(of(parts, "block")).alias("asked"), "i", "v")
        answers = points.groupBy("block", "part", "asked").cogroup(asked.groupBy("block", "part", "asked")).applyInArrow(scan, "q long, i long, score double")
        return answers.groupBy("q", "i").agg(F.max("score").alias("score")), sent

    order = W.partitionBy("q").orderBy(F.desc("score"), "i")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    begun, sent = found(asking.select("i", "v", F.lit(float("-inf")).alias("low"), F.array().cast("array<int>").alias("had")), True)
    begun = materialise(ranked(begun).drop("rank"), "first-answers")
    # the k-th of the first lists' answers bounds what the others can add
    lows = begun.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("low"))
    had = sent.groupBy("i").agg(F.collect_list("block").alias("had"))
    more, _ = found(asking.join(had, "i", "left").withColumn("had", F.coalesce("had", F.array().cast("array<int>"))).join(lows, F.col("i") == F.col("q"), "left").select("i", "v", F.coalesce("low", F.lit(float("-inf"))).alias("low"), "had"), False)
    best = begun.unionByName(more).groupBy("q", "i").agg(F.max("score").alias("score"))
    return ranked(best).select(F.col("q").alias("query_id"), "rank", F.col("i").alias("vec_id"), "score")


def op6_vector_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod(F.col("i"), F.lit(20)) == 0, target=TARGET)


QUERIES = {"op6_vector_lists": op6_vector_lists}
ORACLE: dict[str, str] = {}
