"""Ranks, normalisation and order statistics."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_in(partition: str | list[str], *order: Column | str) -> Column:
    return F.row_number().over(W.partitionBy(partition).orderBy(*order))


def min_max(value: Column, partition: str | list[str]) -> Column:
    """Scaled to 0..1 within the partition; all 1 where all are equal. A non-finite value or range is an error."""
    w = W.partitionBy(partition)
    low, high = F.min(value).over(w), F.max(value).over(w)
    bad = F.isnan(value) | (F.abs(value) == float("inf")) | (F.abs(high - low) == float("inf"))
    scaled = F.when(high == low, F.lit(1.0)).otherwise((value - low) / (high - low))
    return F.when(bad, F.raise_error(F.lit("scores and their range must be finite")).cast("double")).otherwise(scaled)


def floor_percentile(value: Column, p: float) -> Column:
    """The element at floor((n - 1) * p) of the sorted group without its nulls, null if there is none; for groups that fit a row (else ``evaluation.floor_percentiles``)."""
    ordered = F.sort_array(F.collect_list(value))
    return F.get(ordered, F.greatest(F.floor((F.size(ordered) - 1) * F.lit(p)), F.lit(0)).cast("int"))


def reciprocal(rank: Column) -> Column:
    return F.coalesce(1.0 / rank, F.lit(0.0))


def recall_at(rank: Column, k: int) -> Column:
    return F.avg(F.when(rank <= k, 1.0).otherwise(0.0))


#: Rows of a group that one task orders; a larger group is cut, into at most so many buckets, by splitters of a sample that has so many rows a bucket.
BUCKET_ROWS, MOST_BUCKETS, OVERSAMPLE = 1_000_000, 4096, 16
#: Large groups up to this number are broadcast, with their splitters.
BROADCAST_GROUPS = 10_000
_STEP = 64


def same(by: list[str], prefix: str = "_of_") -> Column:
    """The rows of two sides whose group columns are equal or both null; the other side's names have a prefix."""
    return functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in by), F.lit(True))


def _renamed(df: DataFrame, by: list[str], prefix: str = "_of_") -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in by})


def dealt(df: DataFrame, by: list[str], order: list[Column], bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, bool]:
    """The rows with ``_bucket``: a group's rows in earlier buckets come before those in later ones, and rows of equal order share one. Second: whether any group has several.

    A group of more than ``bucket_rows`` rows is cut by splitters: the order columns of a sample, chosen by their hash and so the same in each run. They are compared as they are, whatever
    their types: long integers are not rounded, and a few far values do not matter.
    """
    large = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > bucket_rows)
    n = large.limit(BROADCAST_GROUPS + 1).count()
    if not n:
        return df.withColumn("_bucket", F.lit(0)), False
    told = F.broadcast if n <= BROADCAST_GROUPS else (lambda x: x)
    entry = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))
    drawn = F.pmod(F.xxhash64(F.lit(5), *by, *order), F.lit(1 << 30)) / F.lit(float(1 << 30))
    buckets = F.least(F.ceil(F.col("_rows") / bucket_rows), F.lit(MOST_BUCKETS))
    sample = df.join(told(_renamed(large, by)), same(by)).where(drawn < buckets * OVERSAMPLE / F.col("_rows"))
    entries = sample.groupBy(*by).agg(F.array_sort(F.collect_set(entry)).alias("s"))
    every = F.filter(F.transform(F.col("s"), lambda e, k: F.when(F.pmod(k, F.lit(OVERSAMPLE)) == OVERSAMPLE - 1, e)), lambda e: e.isNotNull())
    splits = entries.select(*by, every.alias("_splits")).withColumn("_coarse", F.filter(F.transform("_splits", lambda e, k: F.when(F.pmod(k, F.lit(_STEP)) == _STEP - 1, e)), lambda e: e.isNotNull()))
    rows = df.withColumn("_entry", entry).join(told(_renamed(splits, by)), same(by), "left")
    below = lambda array: F.size(F.filter(array, lambda e: e < F.col("_entry")))
    rows = rows.withColumn("_first", below(F.col("_coarse")) * _STEP)
    bucket = F.col("_first") + below(F.slice("_splits", F.col("_first") + 1, F.lit(_STEP)))
    return rows.withColumn("_bucket", F.when(F.col("_splits").isNull(), 0).otherwise(bucket)).drop("_entry", "_splits", "_coarse", "_first", *(f"_of_{c}" for c in by)), True


def before_buckets(sizes: DataFrame, by: list[str]) -> DataFrame:
    """Sizes (*by, _bucket, _size) of buckets with ``_before``, what the group has in earlier ones, and ``_all``."""
    group = W.partitionBy(*by)
    before = F.sum("_size").over(group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    return sizes.withColumns({"_before": F.coalesce(before, F.lit(0)), "_all": F.sum("_size").over(group)})


def placed(df: DataFrame, group: str, key: Column, *ties: Column | str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows with ``place``, from 1, in their group's order by ``key`` (nulls first) and then by ``ties``; for groups of any size.

    A large group is many tasks: rows are numbered in their bucket (``dealt``), and the rows of the group in earlier buckets, a count for each, are added.
    """
    order = [key, *(F.col(t) if isinstance(t, str) else t for t in ties)]
    rows, cut = dealt(df, [group], order, bucket_rows)
    own = F.row_number().over(W.partitionBy(group, "_bucket").orderBy(*order)).cast("long")
    if not cut:
        return rows.withColumn("place", own).drop("_bucket")
    rows = rows.withColumn("_own", own)
    offsets = before_buckets(rows.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_size")), [group]).where("_before > 0")
    few = offsets.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    offsets = offsets.select(F.col(group).alias(f"_of_{group}"), F.col("_bucket").alias("_b"), "_before")
    rows = rows.join(F.broadcast(offsets) if few else offsets, same([group]) & (F.col("_bucket") == F.col("_b")), "left")
    return rows.withColumn("place", F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_bucket", "_own", f"_of_{group}", "_b", "_before")


def zipped(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of two sides with the same keys (a group and a place in it), side by side; a row without its like is an error, as then their counts differ."""
    a, b = left.withColumn("_left", F.lit(True)), right.withColumn("_right", F.lit(True))
    both = a.join(b, keys, "full_outer")
    alone = F.col("_left").isNull() | F.col("_right").isNull()
    last = keys[-1]
    kind = left.schema[last].dataType
    return both.withColumn(last, F.when(alone, F.raise_error(F.lit("the two sides differ in number")).cast(kind)).otherwise(F.col(last))).drop("_left", "_right")
