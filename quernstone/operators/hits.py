"""Result rows: what a hit must be, and the errors of a search that cannot be answered."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = ("repository", "path", "name", "qualified_name", "kind", "code")


class SearchError(RuntimeError):
    """A search that failed."""


class IncompleteSearchError(SearchError):
    """Some part of the data did not answer."""


class InvalidSearchResponseError(SearchError):
    """An answer that is not a result list."""


def score_of(value: object) -> float:
    """A finite number; null counts 0. Booleans, strings and what overflows are refused."""
    if value is None:
        return 0.0
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise InvalidSearchResponseError("a score is a number")
    try:
        out = float(value)
    except OverflowError:
        out = math.inf
    if not math.isfinite(out):
        raise InvalidSearchResponseError("a score is finite")
    return out


def checked(rows: list[dict]) -> list[dict]:
    """The rows in stable form; one bad row refuses them all."""
    out = []
    for r in rows:
        first, last = r.get("start_line"), r.get("end_line")
        good = all(isinstance(r.get(k), str) for k in REQUIRED) and type(first) is int and type(last) is int and first >= 1 and last >= first
        good = good and (r.get("language") is None or isinstance(r["language"], str)) and isinstance(r.get("is_test", False), bool)
        if not good:
            raise InvalidSearchResponseError("a hit lacks a field or has one of another type")
        out.append({"score": score_of(r.get("score")), **{k: r[k] for k in REQUIRED[:2]}, "language": r.get("language"), "is_test": r.get("is_test", False), **{k: r[k] for k in REQUIRED[2:5]}, "start_line": first, "end_line": last, "code": r["code"]})
    return out


def is_valid_hit(score: Column, first: Column, last: Column, *required: Column) -> Column:
    """The same test over columns."""
    good = (first >= 1) & (last >= first) & ~F.isnan(F.coalesce(score, F.lit(0.0))) & (F.abs(F.coalesce(score, F.lit(0.0))) < float("inf"))
    for c in required:
        good = good & c.isNotNull()
    return F.coalesce(good, F.lit(False))


def formatted(rows: DataFrame) -> DataFrame:
    """Null scores 0, missing language null, missing test flag false."""
    has = set(rows.columns)
    language = F.col("language") if "language" in has else F.lit(None).cast("string")
    is_test = F.coalesce("is_test", F.lit(False)) if "is_test" in has else F.lit(False)
    return rows.withColumns({"score": F.coalesce("score", F.lit(0.0)), "language": language, "is_test": is_test})
