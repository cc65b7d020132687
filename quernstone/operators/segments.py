"""Manifests: which immutable segments a generation's tables are made of, and which of their rows no longer count.

A commit writes one segment, the new rows of any tables, and a manifest, which names the segments of every table. Rows are never changed: a
segment's rows that a later commit takes out are written down as (segment, key) in that commit's segment, so that an older row
and a newer one with the same key are told apart. Tables of sums (document frequencies, field totals) have no keys: a commit adds what its rows add and
subtracts what the rows that it takes out had added. Segments of like size are merged when there are ``FAN`` of them, so a table has about FAN segments for each power of
FAN in its size, and each row is rewritten about once a power.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 4
#: Taken-out rows of one segment up to this number (some 16 bytes each) are broadcast to it; more are joined by a shuffle.
BROADCAST_DEAD = 500_000
#: A segment of which more than this share is taken out is rewritten.
DEAD_SHARE = 0.5


@dataclass(frozen=True)
class Kept:
    """How a table's rows are told: by the column ``key``, in the taken-out rows of ``dead``."""

    key: str
    dead: str


@dataclass(frozen=True)
class Summed:
    """A table whose other columns are added up by ``by``; groups of which nothing is left are gone."""

    by: tuple[str, ...]


TABLES: dict[str, Kept | Summed] = {
    "docs": Kept("symbol_id", "docs"),  # their postings are blocks, which are read by segment with the rows taken out beside them
    "codes": Kept("id", "docs"),
    "frequencies": Summed(("field", "term")),
    "stats": Summed(("field",)),
    "repositories": Kept("id", "repositories"),
    "files": Kept("id", "files"),
    "symbols": Kept("id", "symbols"),
}


def empty() -> dict:
    """``tables``: (segment, rows) pairs by table; ``dead``: rows taken out by table and segment; ``dead_in``: segments that say which, by table; ``marks``: what has been committed."""
    return {"tables": {}, "dead": {}, "dead_in": {}, "marks": {}}


def members(manifest: dict) -> set[str]:
    """All segments that a manifest reads."""
    return {s for entries in manifest["tables"].values() for s, _ in entries} | {s for names in manifest["dead_in"].values() for s in names}


def following(manifest: dict, segment: str, added: dict[str, int], dead: dict[str, dict[str, int]], appended: Iterable[str] = (), merged: Iterable[str] = (), marks: dict | None = None) -> dict:
    """The manifest after a commit of ``segment``.

    added: rows by table; a table that is not ``appended`` is replaced, but for those of a merger, which stand for the segments ``merged``. dead: rows taken out by table and segment.
    """
    appended, merged = set(appended), set(merged)
    out = {"tables": {t: [list(e) for e in entries] for t, entries in manifest["tables"].items()}, "dead": {t: dict(d) for t, d in manifest["dead"].items()}, "dead_in": {t: list(d) for t, d in manifest["dead_in"].items()}}
    for table, n in added.items():
        before = out["tables"].get(table, [])
        before = [e for e in before if e[0] not in merged] if merged else before if table in appended else []
        out["tables"][table] = [*before, [segment, n]]
        kind = TABLES.get(table)
        if not merged and table not in appended and isinstance(kind, Kept) and kind.dead == table:
            out["dead"].pop(table, None)
            out["dead_in"].pop(table, None)
    for table, by_segment in dead.items():
        counts = out["dead"].setdefault(table, {})
        for s, n in by_segment.items() if not merged else ():  # a merger carries over what was counted before
            counts[s] = counts.get(s, 0) + n
        out["dead_in"].setdefault(table, []).append(segment)
    if merged:
        for table, counts in out["dead"].items():
            for s in merged:
                counts.pop(s, None)
            out["dead_in"][table] = [s for s in out["dead_in"].get(table, []) if s not in merged]
    out["marks"] = {**manifest.get("marks", {}), **(marks or {})}
    return out


def to_merge(manifest: dict, fan: int = FAN) -> list[str]:
    """Segments that are due: of the smallest size of which there are ``fan``, else those that are mostly taken out."""
    rows: dict[str, int] = {}
    for entries in manifest["tables"].values():
        for s, n in entries:
            rows[s] = rows.get(s, 0) + n
    tiers: dict[int, list[str]] = {}
    for s, n in rows.items():
        tiers.setdefault(int(math.log(max(n, 1), fan)), []).append(s)
    for tier in sorted(tiers):
        if len(tiers[tier]) >= fan:
            return sorted(s for t in tiers if t <= tier for s in tiers[t])
    gone = {s for table, counts in manifest["dead"].items() for s, n in counts.items() if n > DEAD_SHARE * dict(manifest["tables"].get(table, [])).get(s, math.inf)}
    return sorted(gone)


class Reader:
    """The tables of a manifest. ``at``: the path of a segment's table."""

    def __init__(self, spark: SparkSession, manifest: dict, at: Callable[[str, str], str]):
        self.spark, self.manifest, self.at = spark, manifest, at

    def dead(self, table: str, only: Iterable[str] | None = None) -> DataFrame | None:
        """(segment, key) that the manifest's segments take out."""
        names = [s for s in self.manifest["dead_in"].get(table, []) if only is None or s in only]
        return self.spark.read.parquet(*(self.at(s, f"{table}.dead") for s in names)) if names else None

    def _segment(self, table: str, segment: str) -> DataFrame:
        rows, kind = self.spark.read.parquet(self.at(segment, table)), TABLES.get(table)
        n = self.manifest["dead"].get(kind.dead, {}).get(segment, 0) if isinstance(kind, Kept) else 0
        if not n:
            return rows
        gone = self.dead(kind.dead).where(F.col("segment") == segment).select(F.col("key").alias("_gone"))
        return rows.join(F.broadcast(gone) if n <= BROADCAST_DEAD else gone, F.col(kind.key) == F.col("_gone"), "left_anti")

    def has(self, table: str) -> bool:
        return bool(self.manifest["tables"].get(table))

    def rows(self, table: str, only: Iterable[str] | None = None) -> DataFrame:
        """The rows that count, of all segments or of ``only``; sums are added up."""
        kind, names = TABLES.get(table), [s for s, _ in self.manifest["tables"].get(table, []) if only is None or s in only]
        if not names:
            raise FileNotFoundError(f"the generation has no {table}")
        counts = self.manifest["dead"].get(kind.dead, {}) if isinstance(kind, Kept) else {}
        whole = [s for s in names if not counts.get(s)]
        out = self.spark.read.parquet(*(self.at(s, table) for s in whole)) if whole else None
        for s in names:
            if counts.get(s):
                out = self._segment(table, s) if out is None else out.unionByName(self._segment(table, s))
        if isinstance(kind, Summed) and len(names) > 1:
            measures = [c for c in out.columns if c not in kind.by]
            out = out.groupBy(*kind.by).agg(*(F.sum(c).alias(c) for c in measures)).where(" OR ".join(f"{c} <> 0" for c in measures))
        return out

    def located(self, table: str) -> DataFrame:
        """The rows that count, with the segment that they lie in."""
        out = None
        for s, _ in self.manifest["tables"].get(table, []):
            part = self._segment(table, s).withColumn("segment", F.lit(s))
            out = part if out is None else out.unionByName(part)
        return out

    def dead_elsewhere(self, table: str, merged: Iterable[str]) -> DataFrame | None:
        """What segments that are merged take out of others; what they take out of one another has gone with the merger."""
        merged = set(merged)
        living = [s for s, _ in self.manifest["tables"].get(table, []) if s not in merged]
        found = self.dead(table, merged)
        return found.where(F.col("segment").isin(living)) if found is not None and living else None
