"""Change sets against a versioned corpus: parse, classify, apply."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import language_of
from ..schema import CHANGES


def parse_diff(output: str, nul: bool = True) -> list[tuple[int, str, str | None, str]]:
    """(ordinal, status, old path, path) records of a name-status listing; a copy counts as an addition.

    With ``nul`` fields end in NUL and a rename or copy has two paths; else fields
    are split by tabs and blank lines are skipped. Anything else is a ValueError.
    """
    return list(diff_records(output, nul))


def _nul_fields(output: str) -> Iterator[str]:
    begin = 0
    while (end := output.find("\0", begin)) >= 0:
        yield output[begin:end]
        begin = end + 1


def diff_records(output: str, nul: bool = True) -> Iterator[tuple[int, str, str | None, str]]:
    """The records of ``parse_diff`` one by one, so that a long listing is not held as objects."""
    if nul and output and not output.endswith("\0"):
        raise ValueError("the listing does not end in NUL")

    def record(n: int, status: str, paths: list[str]) -> tuple[int, str, str | None, str]:
        two = status[:1] in ("R", "C")
        if not (status in ("A", "M", "D", "T") or two and status[1:].isdigit()) or len(paths) != 1 + two or not all(paths):
            raise ValueError(f"not a change record: {status!r} {paths!r}")
        kind = "A" if status[0] == "C" else status[0]
        return n, kind, paths[0] if kind == "R" else None, paths[-1]

    if nul:
        fields = _nul_fields(output)
        for n, status in enumerate(fields):
            paths = list(islice(fields, 1 + (status[:1] in ("R", "C"))))
            if len(paths) != 1 + (status[:1] in ("R", "C")):
                raise ValueError("the last record is not complete")
            yield record(n, status, paths)
    else:
        for n, line in enumerate(x for x in output.splitlines() if x.strip()):
            status, *paths = line.split("\t")
            yield record(n, status, paths)


#: Records that a task holds as objects at a time.
PARSED_ROWS = 10_000


def parse_listings(listings: DataFrame, key: str, text: str, nul: bool = True) -> DataFrame:
    """(key, change fields) of name-status listings, one a row; a malformed one ends the job."""
    schema = T.StructType([listings.schema[key], *T.StructType.fromDDL(CHANGES)])

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            records = ((k.as_py(), *r) for k, x in zip(batch.column(0), batch.column(1), strict=True) for r in diff_records(x.as_py() or "", nul))
            while rows := list(islice(records, PARSED_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return listings.select(key, text).mapInArrow(run, schema)


def changes_frame(spark, output: str, nul: bool = True) -> DataFrame:
    return spark.createDataFrame(parse_diff(output, nul), CHANGES)


def classify(changes: DataFrame, files: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Each change with the effect it has: (ordinal, status, old_path, path, supported, action).

    ``files``: path of each registered file; ``present``: path of each regular file there is now (default: all but the deleted).
    """
    known = files.select(F.col("path").alias("known_path")).distinct()
    rows = changes.join(known, F.col("path") == F.col("known_path"), "left")
    if present is not None:
        now = present.select(F.col("path").alias("present_path")).distinct()
        rows = rows.join(now, F.col("path") == F.col("present_path"), "left")
    there = F.col("present_path").isNotNull() if present is not None else F.lit(True)
    supported = language_of(F.col("path")).isNotNull()
    action = (
        F.when(F.col("status") == "D", "delete").when(~supported, "ignore").when(~there, "delete")
        .when(F.col("known_path").isNull(), F.when(F.col("status") == "R", "rename").otherwise("add"))
        .when(F.col("status").isin("M", "T"), "modify").when(F.col("status") == "R", "rename").otherwise("replace")
    )
    return rows.select("ordinal", "status", "old_path", "path", supported.alias("supported"), action.alias("action"))


#: What a sync counts.
COUNTERS = ("files_added", "files_modified", "files_deleted", "files_renamed", "files_parsed")


def counters(classified: DataFrame) -> DataFrame:
    """One row of sync counters."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    a = F.col("action")
    python = F.col("path").endswith(".py") & a.isin("add", "modify", "rename", "replace")
    return classified.agg(*(c.alias(name) for name, c in zip(COUNTERS, (n(a == "add"), n(a == "modify"), n(a == "delete"), n(F.col("status") == "R"), n(python)), strict=True)))


def affected_paths(changes: DataFrame) -> DataFrame:
    """Old and new paths of all changes, each once, in order."""
    both = changes.select(F.explode(F.array_compact(F.array("old_path", "path"))).alias("path"))
    return both.distinct().orderBy("path")


#: Paths of a change set up to this number are broadcast.
BROADCAST_PATHS = 200_000


def are_few(paths: DataFrame) -> bool:
    return paths.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS


def delete_paths(docs: DataFrame, repository_id: int, paths: DataFrame) -> DataFrame:
    """Without the repository's documents at these paths."""
    gone = paths.select(F.col("path").alias("_gone")).distinct()
    return docs.join(gone, (docs["repository_id"] == repository_id) & (docs["path"] == gone["_gone"]), "left_anti")


def upsert(docs: DataFrame, fresh: DataFrame, key: str = "symbol_id") -> DataFrame:
    return docs.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def apply_sync(docs: DataFrame, repository_id: int, changes: DataFrame, fresh: DataFrame, key: str = "symbol_id") -> DataFrame:
    """The next snapshot: affected paths dropped, freshly parsed symbols in their place."""
    return upsert(delete_paths(docs, repository_id, affected_paths(changes)), fresh, key)


def repeated_paths(changes: DataFrame) -> DataFrame:
    """Paths that a change set names more than once: its order would matter, so it is refused."""
    return changes.groupBy("path").count().where("count > 1")
