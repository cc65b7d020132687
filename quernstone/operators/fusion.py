"""Normalisation and weighted fusion of two ranked lists, and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rank import min_max, rank_in
from ..functions.text import analyse

DEFAULT_WEIGHT = 0.60


def check_weight(weight: float) -> float:
    if isinstance(weight, bool) or not isinstance(weight, (int, float)) or not 0 <= weight <= 1:
        raise ValueError("the semantic weight lies between 0 and 1")
    return float(weight)


def depth(limit: int) -> int:
    """Candidates from each branch."""
    return max(4 * limit, 20)


def rerank_depth(limit: int) -> int:
    return max(3 * limit, 30)


def normalised(branch: DataFrame) -> DataFrame:
    """Adds norm: min-max of score within the query."""
    return branch.withColumn("norm", min_max(F.col("score"), "query_id"))


def collapse(branch: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: the last hit's values at the first hit's position."""
    others = [c for c in branch.columns if c not in ("query_id", "rank", *keys)]
    last = F.max_by(F.struct(*others, F.col("rank").alias("at")), "rank").alias("v")
    rows = branch.groupBy("query_id", *keys).agg(F.min("rank").alias("rank"), last)
    return rows.select("query_id", *keys, "rank", *(f"v.{c}" for c in others), F.col("v.at").alias("last_rank"))


def fuse(bm25: DataFrame, semantic: DataFrame, keys: list[str], weight: Column | float = DEFAULT_WEIGHT, by: list[str] | None = None) -> DataFrame:
    """Full outer merge of two normalised branches (query_id, *keys, norm, rank), scored and ranked.

    A missing side counts 0. Order: score, then the lexical list's order, then the semantic one's.
    """
    group = ["query_id", *(by or [])]
    b = bm25.select("query_id", *keys, F.col("norm").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    s = semantic.select("query_id", *keys, F.col("norm").alias("semantic_score"), F.col("rank").alias("semantic_rank"))
    both = b.join(s, ["query_id", *keys], "full_outer").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("bm25_score", "semantic_score")})
    if by:
        both = both.crossJoin(F.broadcast(weight)) if isinstance(weight, DataFrame) else both
        w = F.col("weight")
    else:
        w = weight if isinstance(weight, Column) else F.lit(check_weight(weight))
    both = both.withColumn("score", F.round(w * F.col("semantic_score") + (1 - w) * F.col("bm25_score"), 8))
    place = F.coalesce(F.col("bm25_rank"), F.lit(1_000_000) + F.col("semantic_rank"))
    return both.withColumn("rank", rank_in(group, F.desc("score"), place))


def fused_hits(hits: DataFrame, keys: list[str], weight: float = DEFAULT_WEIGHT, limit: int | None = None) -> DataFrame:
    """Both branches' hits (query_id, lexical, *keys, id, score, rank), ``lexical`` saying which branch it is, normalised, collapsed, merged and ranked: what ``normalised``, ``collapse`` and ``fuse`` do, where the rows of a query lie together, with ``id``, the lexical hit's if there is one."""
    rows = hits.withColumn("norm", min_max(F.col("score"), ["query_id", "lexical"]))
    side = {"bm25": F.col("lexical"), "semantic": ~F.col("lexical")}
    own = {name: F.when(test, F.col("rank")) for name, test in side.items()}
    merged = rows.groupBy("query_id", *keys).agg(*(x for name in side for x in (F.max_by(F.struct("norm", "id"), own[name]).alias(name), F.min(own[name]).alias(f"{name}_rank"))))
    b, s = (F.coalesce(F.col(name)["norm"], F.lit(0.0)) for name in side)
    w = F.lit(check_weight(weight))
    merged = merged.select("query_id", *keys, b.alias("bm25_score"), s.alias("semantic_score"), "bm25_rank", "semantic_rank", F.round(w * s + (1 - w) * b, 8).alias("score"), F.coalesce(F.col("bm25")["id"], F.col("semantic")["id"]).alias("id"))
    place = F.coalesce(F.col("bm25_rank"), F.lit(1_000_000) + F.col("semantic_rank"))
    out = merged.withColumn("rank", rank_in("query_id", F.desc("score"), place))
    return out if limit is None else out.where(F.col("rank") <= limit)


def overlap_score(query: Column, document: Column) -> Column:
    """The default reranking score: the share of the query's distinct words that the document has."""
    q, d = F.array_distinct(analyse(query)), F.array_distinct(analyse(document))
    return F.coalesce(F.size(F.array_intersect(q, d)) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def rerank(fused: DataFrame, score: Column, limit: int) -> DataFrame:
    """Stable order by the reranker's score; the score must be finite."""
    good = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    checked = F.when(good, score).otherwise(F.raise_error(F.lit("a reranking score must be finite")).cast("double"))
    rows = fused.withColumn("reranker_score", F.round(checked, 6))
    rows = rows.withColumn("final_rank", rank_in("query_id", F.desc("reranker_score"), F.asc("rank")))
    return rows.where(F.col("final_rank") <= limit)
