"""Product-quantised vectors: short codes beside the documents, searched by asymmetric distances, and exact scores for all that can be an answer.

A unit vector is cut into ``parts``; each part becomes the number of its nearest centroid among at most 256, so a code has one byte a part. The centroids of a part come from k-means on a bounded
sample (``SAMPLE_ROWS``). A query is not quantised: its score with a code is its inner product with the centroids that the code names. A task decodes its codes tile by tile and keeps
``depth`` candidates a query; the best ``depth`` of all are scored with their full vectors, and the score of the last answer among them is one that every answer reaches. A code has beside it the cosine of
its vector with what it decodes to. By the angles a vector's score cannot be over a bound, so in a second pass the codes give all documents that can reach a query's
last score, ties included, and these are searched exactly: the answers are those of exact search. Full vectors are read for these documents alone, by the pages of a table that lies in order of the id.

Vectors that are not of the given length, or have a null or non-finite component, have no code; a zero vector has none either, as its cosine is not defined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rank import rank_in
from ..functions.vector import cosine, is_valid
from . import semantic
from .shared import kept

SAMPLE_ROWS, CENTROIDS, ROUNDS = 20_000, 256, 12
#: Candidates for each answer, queries of a block, which is broadcast, and codes that are decoded at once.
CANDIDATES, BLOCK_QUERIES, TILE = 8, 4096, 4096
#: Candidates that are given to the scan as a list, so that pages are chosen by it.
LISTED_IDS = 10_000
#: Documents up to this number (16 bytes each) are told by a broadcast; if more can be answers, all vectors are searched where they lie.
BROADCAST_IDS = 500_000
#: What scores of six digits, and cosines, are apart at most if they may be equal.
MARGIN = 1e-6


def _means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means, with empty centroids put on the points that are farthest from theirs."""
    rng = np.random.default_rng(seed)
    k = min(k, len(np.unique(x, axis=0)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, c)
        sizes = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], axis=1)
        c = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], c)
        if (empty := np.flatnonzero(sizes == 0)).size:
            far = np.argsort(-((x - c[near]) ** 2).sum(axis=1), kind="stable")[: len(empty)]
            c[empty[: len(far)]] = x[far]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1)[None, :] - 2 * x @ c.T, axis=1)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _valid(vectors: DataFrame, dims: int, vector_col: str) -> DataFrame:
    return vectors.where(is_valid(F.col(vector_col), dims) & F.exists(vector_col, lambda x: x != 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def fit(vectors: DataFrame, dims: int, parts: int, id_col: str = "symbol_id", vector_col: str = "embedding") -> np.ndarray:
    """The codebook, (parts, centroids, components of a part): of the sample's rows with the smallest id hashes."""
    if dims % parts:
        raise ValueError("the parts of a vector are of one length")
    rows = _valid(vectors, dims, vector_col).select(F.xxhash64(F.lit(3), F.col(id_col)).alias("k"), F.col(vector_col).alias("v")).orderBy("k").limit(SAMPLE_ROWS).toArrow()
    width = dims // parts
    if not len(rows):
        return np.zeros((parts, 1, width), np.float32)
    x = _unit(_matrix(rows.column("v").combine_chunks(), dims))
    books = [_means(x[:, p * width : (p + 1) * width], CENTROIDS, p) for p in range(parts)]
    k = max(len(b) for b in books)
    return np.stack([np.concatenate([b, np.repeat(b[-1:], k - len(b), axis=0)]) for b in books]).astype(np.float32)


def codebook_rows(spark, book: np.ndarray) -> DataFrame:
    """A row a part, to be stored."""
    return spark.createDataFrame(pa.table({"part": pa.array(range(len(book)), pa.int32()), "centroids": pa.array([b.ravel().tolist() for b in book], pa.list_(pa.float32())), "width": pa.array([book.shape[2]] * len(book), pa.int32())})).coalesce(1)


def codebook_of(rows: DataFrame) -> np.ndarray:
    got = sorted(rows.collect(), key=lambda r: r["part"])  # a row a part
    return np.stack([np.array(r["centroids"], np.float32).reshape(-1, r["width"]) for r in got])


def encode(vectors: DataFrame, book: np.ndarray, id_col: str = "symbol_id", vector_col: str = "embedding", flag_col: str | None = None) -> DataFrame:
    """(id, flag, code, near) of the vectors that have one; near: the cosine, rounded down, of the vector with what its code decodes to. A null flag is taken as set, as such a document is no answer without intent."""
    parts, _, width = book.shape
    told = vectors.sparkSession.sparkContext.broadcast(book)
    flag = F.coalesce(F.col(flag_col), F.lit(True)) if flag_col else F.lit(False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = told.value.astype(float)
        for batch in batches:
            x = _unit(_matrix(batch.column(2), parts * width))
            codes = np.stack([_nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)], axis=1).astype(np.uint8) if len(x) else np.zeros((0, parts), np.uint8)
            near = np.nextafter((x * _directions(books, codes)).sum(axis=1).astype(np.float32), np.float32(-2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(near)], names=["id", "flag", "code", "near"])

    rows = _valid(vectors, parts * width, vector_col).select(F.col(id_col).cast("long").alias("id"), flag.alias("flag"), F.col(vector_col).alias("v"))
    return rows.mapInArrow(run, "id long, flag boolean, code binary, near float")


def _decoded(books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.concatenate([books[p][codes[:, p]] for p in range(len(books))], axis=1)


def _directions(books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """What codes decode to, as unit vectors, or zero."""
    x = _decoded(books, codes)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _candidates(codes: DataFrame, book: np.ndarray, asked: pa.Table, depth: int, kind: T.StructField) -> DataFrame:
    """(query_id, id): each query's best by code, of a bounded block of queries."""
    width = book.shape[1:]
    q = _unit(_matrix(asked.column("embedding").combine_chunks(), len(book) * width[1])).astype(np.float32)
    told = codes.sparkSession.sparkContext.broadcast((book, q, asked.column("query_id").to_pylist(), np.array(asked.column("intent").to_pylist(), bool)))
    schema = T.StructType([kind, *T.StructType.fromDDL("id long, score double")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        books, q, names, intent = told.value
        arrow, parts = to_arrow_schema(schema), len(books)
        best_s, best_i = np.full((len(q), depth), -np.inf, np.float32), np.full((len(q), depth), -1, np.int64)
        for batch in batches:
            ids, flags = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            flat = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, parts)
            for a in range(0, len(ids), TILE):
                code = flat[a : a + TILE]
                score = q @ _decoded(books, code).T
                score[np.ix_(~intent, flags[a : a + TILE])] = -np.inf
                both_s = np.concatenate([best_s, score], axis=1)
                both_i = np.concatenate([best_i, np.broadcast_to(ids[a : a + TILE], score.shape)], axis=1)
                keep = np.argpartition(-both_s, depth - 1, axis=1)[:, :depth]
                best_s, best_i = np.take_along_axis(both_s, keep, 1), np.take_along_axis(both_i, keep, 1)
        r, c = np.nonzero(np.isfinite(best_s))
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in r], arrow.field(0).type), pa.array(best_i[r, c]), pa.array(best_s[r, c].astype(float))], schema=arrow)

    found = codes.select("id", "flag", "code").mapInArrow(run, schema)
    return found.withColumn("rank", rank_in("query_id", F.desc("score"), F.asc("id"))).where(F.col("rank") <= depth).select("query_id", "id")


def _reaching(codes: DataFrame, book: np.ndarray, asked: pa.Table, floors: dict) -> DataFrame:
    """(id, flag) of the documents that can have a query's floor as their score, or more. The angle between query and vector is at least the difference of their angles to what the code decodes to."""
    q = _unit(_matrix(asked.column("embedding").combine_chunks(), book.shape[0] * book.shape[2]))
    floor = np.array([2 * (floors.get(name, -1.0) - MARGIN) - 1 - MARGIN for name in asked.column("query_id").to_pylist()])
    told = codes.sparkSession.sparkContext.broadcast((book, q, floor, np.array(asked.column("intent").to_pylist(), bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, q, floor, intent = told.value
        books, tile = books.astype(float), max(1, TILE * 64 // max(64, len(q)))
        for batch in batches:
            flags, near = batch.column(1).to_numpy(zero_copy_only=False).astype(bool), batch.column(3).to_numpy().astype(float)
            flat = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, len(books))
            reached = np.zeros(len(flat), bool)
            for a in range(0, len(flat), tile):
                to, own = slice(a, a + tile), near[a : a + tile]
                c = np.clip(q @ _directions(books, flat[to]).T, -1, 1)
                most = np.where(c < own, c * own + np.sqrt((1 - c * c) * (1 - own * own)), 1)
                reached[to] = ((most >= floor[:, None]) & (intent[:, None] | ~flags[to])).any(axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["id", "flag"]).filter(pa.array(reached))

    # codes of before have no cosine: they can reach any score
    near = F.col("near") if "near" in codes.columns else F.lit(None)
    return codes.select("id", "flag", "code", F.coalesce(near.cast("float"), F.lit(-1.0).cast("float")).alias("near")).mapInArrow(run, "id long, flag boolean")


def search(codes: DataFrame, book: np.ndarray, vectors: DataFrame, queries: DataFrame, limit: int, id_col: str = "symbol_id", vector_col: str = "embedding", candidates: int = CANDIDATES, flag_col: str | None = None) -> DataFrame:
    """(query_id, id, score, rank) of queries (query_id, intent, embedding), score (1 + cosine) / 2 of the full vectors, as ``semantic.search`` gives them; flagged documents are no answers without intent.

    ``flag_col``: the flag's column in ``vectors``; without it flags are those of the codes.
    """
    dims = book.shape[0] * book.shape[2]
    asked = _valid(queries, dims, "embedding").select("query_id", "intent", "embedding")
    n, depth, out, spark = asked.count(), limit * candidates, None, vectors.sparkSession
    kind = queries.schema["query_id"]
    full = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("_v"), *([F.col(flag_col).alias("_flag")] if flag_col else []))
    for k in range(max(1, -(-n // BLOCK_QUERIES))):
        own = asked if n <= BLOCK_QUERIES else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // BLOCK_QUERIES))) == k)
        rows = own.toArrow()  # at most about BLOCK_QUERIES
        if not len(rows):
            continue
        own = spark.createDataFrame(rows)
        pairs = _candidates(codes, book, rows, depth, kind).distinct().toArrow()  # at most ``depth`` a query
        told = F.broadcast(spark.createDataFrame(pairs))
        scored = _among(full, set(pairs.column("id").to_pylist())).join(told, "id").join(F.broadcast(own.select("query_id", "intent", F.col("embedding").alias("_q"))), "query_id")
        if flag_col:
            scored = scored.where("intent OR NOT _flag")
        scored = scored.select("query_id", F.round((1 + cosine(F.col("_v"), F.col("_q"))) / 2, 6).alias("score")).where("score IS NOT NULL")
        last = scored.withColumn("rank", rank_in("query_id", F.desc("score"))).where(F.col("rank") == limit)
        # a row a query that has as many answers as asked for
        floors = {r["query_id"]: r["score"] for r in last.collect()}
        reached = _reaching(codes, book, rows, floors)
        head = reached.limit(LISTED_IDS + 1).toArrow()
        if few := len(head) <= LISTED_IDS:
            reached, some = spark.createDataFrame(head), _among(full, set(head.column("id").to_pylist()))
        else:
            reached, some = kept(reached, "reached"), full
        few = few or reached.count() <= BROADCAST_IDS
        if not flag_col:
            flags = reached.groupBy("id").agg(F.max("flag").alias("_flag"))
            some = some.join(F.broadcast(flags) if few else flags, "id")
        elif few:
            some = some.join(F.broadcast(reached), "id", "left_semi")
        best = semantic.search(some, own, limit, dims, "id", "_v", "_flag", len(rows))
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], T.StructType([kind, *T.StructType.fromDDL("id bigint, score double, rank int")]))
    return out


def _among(full: DataFrame, ids: set[int]) -> DataFrame:
    """The rows of these documents, of which there are few: by a list that the scan's pages are chosen by, up to its bound."""
    return full.where(F.col("id").isin(sorted(ids))) if len(ids) <= LISTED_IDS else full
