"""Vectors as arrays: similarity, validation and a deterministic hashing embedder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import analyse


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where either is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def is_valid(v: Column, dims: int) -> Column:
    """As many components as asked for, all finite."""
    return F.coalesce((F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def hashed_embedding(df: DataFrame, id_col: str, text: Column, dims: int = 64) -> DataFrame:
    """(id, slot, value): sparse unit-length feature hashing of a text's words."""
    words = df.select(F.col(id_col), F.explode(analyse(text)).alias("w"))
    slots = words.groupBy(id_col, F.pmod(F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int").alias("slot")).agg(F.count("*").alias("n"))
    norms = slots.groupBy(id_col).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return slots.join(norms, id_col).select(id_col, "slot", (F.col("n") / F.col("norm")).alias("value"))
