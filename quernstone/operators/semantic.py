"""Exact cosine neighbours for a batch of query vectors.

The stated query set is small and goes to all vectors; a batch over ``BROADCAST_QUERIES`` is
taken in blocks of that size. Each block is one pass with a top-k per query. A few queries are
column expressions; from ``MATRIX_QUERIES`` on, a matrix product over Arrow batches, which send on
no more than the top k of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rank import rank_in
from ..functions.vector import cosine, is_valid

BROADCAST_QUERIES = 4096
MATRIX_QUERIES = 32


def search(vectors: DataFrame, queries: DataFrame, limit: int, dims: int, id_col: str = "id", vector_col: str = "embedding", filtered: str | None = None, n: int | None = None) -> DataFrame:
    """(query_id, id, score, rank) with score (1 + cosine) / 2; ``filtered`` names a boolean column of vectors whose rows are excluded before ranking. ``n``: the number of queries, if it is known."""
    q = queries.select("query_id", F.col("embedding").alias("_q"), *([F.col("intent")] if filtered else []))
    n = q.count() if n is None else n
    rows = vectors.where(is_valid(F.col(vector_col), dims)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("_v"), *([F.col(filtered).alias("_f")] if filtered else []))
    out = None
    for k in range(max(1, -(-n // BROADCAST_QUERIES))):
        block = q if n <= BROADCAST_QUERIES else q.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // BROADCAST_QUERIES))) == k)
        if n >= MATRIX_QUERIES:
            scored = _by_matrix(rows, block, limit, bool(filtered))
            best = scored.withColumn("rank", rank_in("query_id", F.desc("score"), F.asc("id"))).where(F.col("rank") <= limit)
            out = best if out is None else out.unionByName(best)
            continue
        on = (F.col("intent") | ~F.col("_f")) if filtered else F.lit(True)
        pairs = rows.join(F.broadcast(block), on)
        scored = pairs.select("query_id", "id", F.round((1 + cosine(F.col("_v"), F.col("_q"))) / 2, 6).alias("score")).where("score IS NOT NULL")
        best = scored.withColumn("rank", rank_in("query_id", F.desc("score"), F.asc("id"))).where(F.col("rank") <= limit)
        out = best if out is None else out.unionByName(best)
    return out


def _by_matrix(rows: DataFrame, block: DataFrame, limit: int, filtered: bool) -> DataFrame:
    """(query_id, id, score) of each Arrow batch's best; the block's queries, bounded in number, are broadcast."""
    asked = block.where("_q IS NOT NULL").toArrow()
    q = np.array(asked.column("_q").to_pylist(), float).reshape(len(asked), -1)
    with np.errstate(invalid="ignore"):
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
    ids = np.array(asked.column("query_id").to_pylist())
    intent = np.array(asked.column("intent").to_pylist(), bool) if filtered else np.ones(len(asked), bool)
    shared = rows.sparkSession.sparkContext.broadcast((q, ids, intent))
    schema = T.StructType([block.schema["query_id"], rows.schema["id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        q, ids, intent = shared.value
        for batch in batches:
            if not len(batch) or not len(q):
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), -1)  # all of one length, without nulls
            with np.errstate(invalid="ignore", divide="ignore"):
                score = np.round((1 + q @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T) / 2, 6)
            score[np.isnan(score)] = -1
            if filtered:
                score[np.ix_(~intent, batch.column(2).to_numpy(zero_copy_only=False).astype(bool))] = -1
            own = np.array(batch.column(0).to_pylist())
            by_id = np.argsort(own, kind="stable")
            at = by_id[np.argsort(-score[:, by_id], axis=1, kind="stable")[:, :limit]]
            best = np.take_along_axis(score, at, 1)
            keep = best >= 0
            a = np.repeat(np.arange(len(q)), at.shape[1]).reshape(at.shape)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(own[at[keep]]), pa.array(best[keep])], names=["query_id", "id", "score"]).cast(arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(run, schema)
