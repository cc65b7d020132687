"""Ground truth, ranks, metrics and weight sweeps over whole query batches."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rank import BUCKET_ROWS, before_buckets, dealt, recall_at, reciprocal, same

DEPTHS = (1, 3, 5, 10)
WEIGHTS = tuple(round(0.5 + 0.05 * k, 2) for k in range(11))


def check_cases(cases: DataFrame, repositories: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each case with outcome valid, repository not found, ambiguous repository or symbol not found."""
    names = repositories.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("repository_id"))
    known = symbols.select(F.col("repository_id").alias("rid"), F.col("qualified_name").alias("qn")).distinct()
    rows = cases.join(names, cases["repository"] == names["name"], "left")
    rows = rows.join(known, (rows["repository_id"] == known["rid"]) & (rows["expected"] == known["qn"]), "left")
    outcome = F.when(F.col("n").isNull(), "repository not found").when(F.col("n") > 1, "ambiguous repository").when(F.col("qn").isNull(), "symbol not found").otherwise("valid")
    return rows.select(*cases.columns, outcome.alias("outcome"))


def checked_results(results: DataFrame, keys: list[str], max_rows: int = 10) -> DataFrame:
    """The results of an evaluation as they are; more than ``max_rows`` for a query, or a null or blank identity, is an error."""
    key = functools.reduce(lambda a, b: a | b, (F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "") for k in keys))
    wrong = F.when(F.col("rank") > max_rows, f"a result list has more than {max_rows} rows").when(key, "a result has no identity")
    return results.withColumn("rank", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("long")).otherwise(F.col("rank")))


def by_method(methods: dict[str, DataFrame], cases: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of several methods' checked results (query_id, *keys, rank) over the same cases (query_id, *keys)."""
    rows = functools.reduce(DataFrame.unionByName, (first_rank(checked_results(df, keys), cases, keys).withColumn("method", F.lit(name)) for name, df in methods.items()))
    return metrics(rows, "method")


def first_rank(results: DataFrame, cases: DataFrame, keys: list[str], max_rows: int = 10, case: str = "query_id") -> DataFrame:
    """(case, rank): the first rank at which a result equals what the case expects, null if none; ``case`` names the column of cases that tells them apart, where a query has several."""
    hits = results.where(F.col("rank") <= max_rows).groupBy("query_id", *keys).agg(F.min("rank").alias("rank"))
    return cases.join(hits, ["query_id", *keys], "left").groupBy(case).agg(F.min("rank").alias("rank"))


def diagnosis(branches: dict[str, DataFrame], expected: DataFrame, keys: list[str], depth: int, found: int) -> DataFrame:
    """Cases that ``hybrid`` does not answer in its first ``found`` results, with the expected result's rank in each branch, to ``depth``."""
    out = expected
    for name, hits in branches.items():
        out = out.join(first_rank(hits, expected, keys, depth).withColumnRenamed("rank", f"{name}_rank"), "query_id")
    return out.where(F.coalesce(F.col("hybrid_rank") > found, F.lit(True)))


def recommended(hits: dict[float, DataFrame], cases: DataFrame, keys: list[str]) -> DataFrame:
    """The weight whose hits (query_id, *keys, rank) serve the cases (query_id, *keys) best, with its metrics: one row."""
    rows = functools.reduce(DataFrame.unionByName, (first_rank(df, cases, keys).withColumn("weight", F.lit(w)) for w, df in hits.items()))
    return best_weight(metrics(rows, "weight"))


def metrics(ranks: DataFrame, *by: str) -> DataFrame:
    """Recall at each depth and mean reciprocal rank; a miss counts 0."""
    return ranks.groupBy(*by).agg(*(F.round(recall_at(F.col("rank"), k), 6).alias(f"recall_{k}") for k in DEPTHS), F.round(F.avg(reciprocal(F.col("rank"))), 6).alias("mrr"), F.count("*").alias("cases"))


def best_weight(scores: DataFrame) -> DataFrame:
    """The recommended weight: among those with full recall at 10, by mrr, recall 1, recall 3; else by recall 10, mrr. The smaller weight wins a tie."""
    full = F.col("recall_10") == 1.0
    order = F.struct(full.alias("full"), F.when(full, 0.0).otherwise(F.col("recall_10")).alias("r10"), "mrr", F.when(full, F.col("recall_1")).otherwise(0.0).alias("r1"), F.when(full, F.col("recall_3")).otherwise(0.0).alias("r3"), (-F.col("weight")).alias("w"))
    return scores.groupBy().agg(F.max_by(F.struct(*scores.columns), order).alias("b")).select("b.*")


def order_statistics(rows: DataFrame, value: Column, places: dict[str, Callable[[Column], Column]], *by: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """By group, under the names of ``places``: the element at a place, from 0 and given the number of values, of the group's sorted values without nulls.

    Equal values are counted first. A group of very many different ones is cut into buckets; the buckets' counts say which of them has the element, and only that one is sorted.
    """
    group = list(by) or ["_whole"]
    rows = rows if by else rows.withColumn("_whole", F.lit(0))
    counted = rows.select(*group, value.alias("_value")).where("_value IS NOT NULL").groupBy(*group, "_value").agg(F.count("*").alias("_n"))
    counted, cut = dealt(counted, group, [F.col("_value")], bucket_rows)
    at = lambda whole: {name: place(whole) for name, place in places.items()}
    if not cut:
        window = W.partitionBy(*group)
        counted = counted.withColumns({"_upto": F.sum("_n").over(window.orderBy("_value").rowsBetween(W.unboundedPreceding, W.currentRow)), "_all": F.sum("_n").over(window)})
        out = counted.groupBy(*group).agg(*(F.min(F.when(F.col("_upto") > place, F.col("_value"))).alias(name) for name, place in at(F.col("_all")).items()))
        return out if by else out.drop("_whole")
    sizes = before_buckets(counted.groupBy(*group, "_bucket").agg(F.sum("_n").alias("_size")), group)
    asked = F.array(*(F.struct(F.lit(name).alias("name"), place.cast("long").alias("place")) for name, place in at(F.col("_all")).items()))
    wanted = sizes.select(*group, "_bucket", "_before", "_size", F.explode(asked).alias("a")).where((F.col("a.place") >= F.col("_before")) & (F.col("a.place") < F.col("_before") + F.col("_size")))
    wanted = wanted.groupBy(*(F.col(c).alias(f"_of_{c}") for c in group), F.col("_bucket").alias("_b")).agg(F.first("_before").alias("_before"), F.collect_list("a").alias("_asked"))
    picked = counted.join(wanted, same(group) & (F.col("_bucket") == F.col("_b"))).drop(*(f"_of_{c}" for c in group))
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy(*group, "_bucket").orderBy("_value").rowsBetween(W.unboundedPreceding, W.currentRow))
    picked = picked.withColumn("_upto", upto).select(*group, "_value", "_n", "_upto", F.explode("_asked").alias("a"))
    hit = (F.col("a.place") < F.col("_upto")) & (F.col("a.place") >= F.col("_upto") - F.col("_n"))
    out = picked.where(hit).groupBy(*group).agg(*(F.max(F.when(F.col("a.name") == name, F.col("_value"))).alias(name) for name in places))
    return out if by else out.drop("_whole")


def floor_percentiles(rows: DataFrame, value: Column, shares: dict[str, float], *by: str, **how) -> DataFrame:
    """By group, under the names of ``shares``: the element at floor((n - 1) * share) of its sorted values without nulls."""
    return order_statistics(rows, value, {name: (lambda n, p=p: F.floor((n - 1) * F.lit(p))) for name, p in shares.items()}, *by, **how)


#: The two middle elements; they are one where their number is odd.
MIDDLE = {"_lower": lambda n: F.floor((n - 1) / 2), "_upper": lambda n: F.floor(n / 2)}


def with_percentiles(summary: DataFrame, rows: DataFrame, value: Column, shares: dict[str, float], *by: str, median: str | None = None, **how) -> DataFrame:
    """A summary by group with its floor percentiles and, under the name ``median``, the mean of its middle elements; null where a group has no values."""
    places = {name: (lambda n, p=p: F.floor((n - 1) * F.lit(p))) for name, p in shares.items()}
    found = order_statistics(rows, value, {**places, **(MIDDLE if median else {})}, *by, **how)
    if median:
        found = found.withColumn(median, (F.col("_lower") + F.col("_upper")) / 2).drop(*MIDDLE)
    if not by:
        return summary.crossJoin(F.broadcast(found))
    found = found.withColumnsRenamed({c: f"_of_{c}" for c in by})
    return summary.join(found, same(list(by)), "left").drop(*(f"_of_{c}" for c in by))


def latency_summary(rows: DataFrame, value: Column, *by: str, **how) -> DataFrame:
    """Count, mean, median, extremes and floor-index percentiles."""
    summary = rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.min(value), 6).alias("low"), F.round(F.max(value), 6).alias("high"))
    out = with_percentiles(summary, rows, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, *by, median="median", **how)
    return out.withColumns({c: F.round(c, 6) for c in ("median", "p50", "p95", "p99")})


def level_summary(rows: DataFrame, value: Column, failed: Column, seconds: Column, *by: str, **how) -> DataFrame:
    """By concurrency level: requests that succeeded and failed, the succeeded ones' latencies, and how many of them a second."""
    good = rows.withColumn("_good", ~failed)
    latency = F.when(F.col("_good"), value)
    summary = good.groupBy(*by).agg(
        F.count(F.when(F.col("_good"), 1)).alias("success"), F.count(F.when(~F.col("_good"), 1)).alias("failed"), F.round(F.avg(latency), 6).alias("mean"),
        F.round(F.min(latency), 6).alias("low"), F.round(F.max(latency), 6).alias("high"), F.round(F.count(F.when(F.col("_good"), 1)) / seconds, 6).alias("per_second"),
    )
    out = with_percentiles(summary, good.withColumn("_latency", latency), F.col("_latency"), {"p95": 0.95, "p99": 0.99}, *by, median="median", **how)
    return out.withColumns({c: F.round(c, 6) for c in ("median", "p95", "p99")})


def burst_accounting(requests: DataFrame, key: str, *burst: str) -> DataFrame:
    """By burst: requests, engine calls when equal queries in flight are shared (one a query), and followers."""
    calls = F.countDistinct(key)
    return requests.groupBy(*burst).agg(F.count("*").alias("requests"), calls.alias("engine_calls"), (F.count("*") - calls).alias("followers"))


def outcome_summary(rows: DataFrame, value: Column, *by: str) -> DataFrame:
    """By group and outcome: how many requests and their mean latency."""
    return rows.groupBy(*by, "outcome").agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))


def quality_gate(value: float, threshold: float) -> bool:
    """Passes at the threshold itself, unrounded."""
    return value >= threshold


def recall_gate(ranks: DataFrame, threshold: float, k: int = 10) -> bool:
    """Whether the unrounded recall at k reaches a threshold of 0 to 1."""
    if isinstance(threshold, bool) or not isinstance(threshold, (int, float)) or not 0 <= threshold <= 1:
        raise ValueError("a recall threshold lies between 0 and 1")
    value = ranks.agg(recall_at(F.col("rank"), k)).first()[0]
    if value is None:
        raise ValueError("there are no cases")
    return quality_gate(value, threshold)


class GateFailed(RuntimeError):
    """A check of a release has failed, or the corpus has changed under it."""


def release_gate(checks: list[tuple[str, Callable[[], object]]], identity: Callable[[], object] | None = None) -> dict:
    """Run checks in order, up to the first that fails (raises, or returns False); the corpus must be the same before and after."""
    before, done = identity() if identity else None, []
    for name, check in checks:
        try:
            passed = check()
        except Exception as e:
            raise GateFailed(f"check failed: {name}") from e
        if passed is False:
            raise GateFailed(f"check failed: {name}")
        done.append(name)
    if identity and identity() != before:
        raise GateFailed("the published generation changed during the checks")
    return {"status": "passed", "checks": done, "identity": before}
