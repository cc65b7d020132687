"""Immutable generations of the engine's tables, an atomic pointer, and retention.

A generation is a segment of new rows, a directory of Parquet tables, and a manifest that names the segments each table is made of (``segments``). It is
written, read back and counted, and only then becomes current by replacing the pointer file, so readers
see one generation or the other, in all tables. A journal says what publication is under way and whose: one that was
stopped while it was built is abandoned, one that was ready or published is resumed, by its owner, before anything else is published.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_generation_name
from . import segments
from .folder import Folder

#: The reasons that protect a generation, in the order they are listed in; the eighth is followed by the state.
REASONS = (
    "legacy index", "active index", "referenced by an alias", "publication journal reference", "outside managed generation naming", "index absent", "untracked lifecycle", "lifecycle state",
    "unverified recorded identity", "index identity changed", "inactive timestamp unknown", "inactive grace period", "unverified live identity", "retained published generation",
)
JOURNAL, POINTER, LIFECYCLE, IDENTITY, MANIFEST = "publication.json", "current.json", "lifecycle.json", "identity.json", "manifest.json"
#: A table to write: its rows, or how they follow from tables of the same commit that have been written before it.
Source = DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]


class PublicationPending(RuntimeError):
    """A publication that was stopped is to be resumed first."""


class GenerationStore:
    """Generations under a root, with a journal of the publication under way. The root is a local folder, or one of any file system by its URI."""

    def __init__(self, spark: SparkSession, root: str, legacy: str = "symbols"):
        self.spark, self.folder, self.legacy = spark, Folder(spark, root), legacy

    def pending(self) -> dict | None:
        return self.folder.read(JOURNAL)

    def current(self) -> str | None:
        """Name of the published generation; it must exist."""
        pointer = self.folder.read(POINTER)
        if pointer is None:
            return None
        if not isinstance(pointer, dict) or not isinstance(pointer.get("name"), str):
            raise ValueError("the pointer to the published generation is malformed")
        if not self.folder.exists(pointer["name"]):
            raise FileNotFoundError(f"the published generation {pointer['name']} is missing")
        return pointer["name"]

    def manifest(self, name: str | None = None) -> dict:
        """A generation's manifest, by default the current one's; without any generation an empty one."""
        name = name or self.current()
        return segments.empty() if name is None else self.folder.read(f"{name}/{MANIFEST}")

    def reader(self, name: str | None = None) -> segments.Reader:
        return segments.Reader(self.spark, self.manifest(name), self.folder.at)

    def read(self, table: str = "docs", name: str | None = None) -> DataFrame:
        name = name or self.current()
        if name is None:
            raise FileNotFoundError("no generation has been published")
        return self.reader(name).rows(table)

    def lifecycle(self) -> dict[str, dict]:
        return self.folder.read(LIFECYCLE) or {}

    def identity(self, name: str) -> str | None:
        """The identity that a generation's own folder has; null if it has none."""
        found = self.folder.read(f"{name}/{IDENTITY}")
        return found["uuid"] if found else None

    def verify(self, name: str) -> None:
        """A tracked generation must have the identity that the lifecycle has recorded."""
        row = self.lifecycle().get(name)
        if row and self.identity(name) != row["uuid"]:
            raise RuntimeError(f"{name} is not the generation that was recorded")

    def _mark(self, name: str, state: str, **more) -> None:
        all_rows = self.lifecycle()
        row = all_rows.setdefault(name, {"uuid": uuid.uuid4().hex, "created_at": time.time()})
        row |= {"state": state} | more
        if state in ("retired", "abandoned"):
            row.setdefault("inactive_at", time.time())
        self.folder.write(LIFECYCLE, all_rows)

    def resume(self, after: Callable[[], None] | None = None, repository_id: int | None = None, fail_at: str | None = None) -> str | None:
        """Finish a stopped publication, or abandon one that was still being built; the name that has become current, if any.

        One that names a repository is its to resume; others get a PublicationPending.
        """
        job = self.pending()
        if job is None:
            return None
        if job["repository_id"] not in (None, repository_id):
            raise PublicationPending(f"the publication of repository {job['repository_id']} is to be resumed first")
        if job["phase"] == "building":
            self._mark(job["name"], "abandoned")
            self.folder.delete(JOURNAL)
            return None
        return self._finish(job, after, fail_at)

    def publish(
        self, tables: dict[str, Source], counts: dict[str, int] | None = None, after: Callable[[], None] | None = None, fail_at: str | None = None, repository_id: int | None = None,
        appended: Iterable[str] = (), dead: dict[str, DataFrame] | None = None, merged: Iterable[str] = (), marks: dict | None = None, purpose: str | None = None,
    ) -> str:
        """Write, verify and publish a generation. ``after`` (cache rotation) runs before the journal is dropped.

        ``tables`` replace those of the current generation, or add rows to them where ``appended``; other tables stay. ``dead``: rows (segment, key) of the current one
        that no longer count. ``merged``: segments that ``tables`` stand for. ``marks``: what this commit has done, for the manifest; all of it holds from one moment on.

        A publication that is ready or published already is not this one, and tables may have been derived from what it replaces: resume it first.
        """
        job = self.pending()
        if job and job["phase"] != "building":
            raise PublicationPending("a prepared publication is to be resumed first")
        if job:
            self.resume(after, repository_id)
        name, source = f"{self.legacy}_generation_{uuid.uuid4().hex}", self.current()
        job = {"name": name, "source": source, "phase": "building", "repository_id": repository_id, "purpose": purpose, "counts": {}}
        self.folder.write(JOURNAL, job)
        self._mark(name, "building", repository_id=repository_id)
        gone: dict[str, dict[str, int]] = {}
        for table, df in (dead or {}).items():
            df.select("segment", F.col("key").cast("long").alias("key")).distinct().write.parquet(self.folder.at(name, f"{table}.dead"))
            written = self._own(name, f"{table}.dead")
            gone[table] = {r["segment"]: r["count"] for r in written.groupBy("segment").count().collect()}  # as many rows as segments
            job["counts"][f"{table}.dead"] = sum(gone[table].values())
        for table, df in tables.items():
            df = df if isinstance(df, DataFrame) else df(lambda t: self._own(name, t))
            df.write.parquet(self.folder.at(name, table))
            n = self._own(name, table).count()
            want = (counts or {}).get(table, n)
            if n != want:
                raise RuntimeError(f"{table} has {n} rows, expected {want}")
            job["counts"][table] = n
        added = {t: job["counts"][t] for t in tables}
        self.folder.write(f"{name}/{MANIFEST}", segments.following(self.manifest(source), name, added, gone, appended, merged, marks))
        self.folder.write(f"{name}/{IDENTITY}", {"uuid": self.lifecycle()[name]["uuid"]})
        self._fail(fail_at, "built")
        job["phase"] = "ready"
        self.folder.write(JOURNAL, job)
        return self._finish(job, after, fail_at)

    def _own(self, name: str, table: str) -> DataFrame:
        """A table of a generation's own segment."""
        return self.spark.read.parquet(self.folder.at(name, table))

    def _finish(self, job: dict, after: Callable[[], None] | None, fail_at: str | None) -> str:
        name, source = job["name"], job["source"]
        now = self.current()
        if now != name:
            if now != source or job["phase"] == "published":
                raise RuntimeError("another generation was published meanwhile")
            for known in (source, name):
                if known:
                    self.verify(known)
            for table, n in job["counts"].items():
                if self._own(name, table).count() != n:
                    raise RuntimeError(f"the prepared {table} has changed")
            self._fail(fail_at, "ready")
            self.folder.write(POINTER, {"name": name})
            self._fail(fail_at, "switched")
        job["phase"] = "published"
        self.folder.write(JOURNAL, job)
        self._fail(fail_at, "published")
        self._mark(name, "published", published_at=time.time())
        if source and source != name:
            self._mark(source, "retired")
        if after:
            after()
        self.folder.delete(JOURNAL)
        return name

    @staticmethod
    def _fail(at: str | None, here: str) -> None:
        if at == here:
            raise InterruptedError(f"stopped once {here}")

    def copy_except(self, repository_id: int, table: str = "docs") -> DataFrame:
        return without_repository(self.read(table), repository_id)


def without_repository(docs: DataFrame, repository_id: int) -> DataFrame:
    """All documents but one repository's."""
    return docs.where(F.col("repository_id") != repository_id)


def protections(inventory: DataFrame, now: Column, legacy: str, min_age_hours: int = 24, keep: int = 2) -> DataFrame:
    """Adds ``reasons`` and ``eligible`` to an inventory of generations.

    inventory: name, present, live_uuid, aliased, active, in_journal, tracked, state, recorded_uuid, inactive_at.
    """
    if min_age_hours < 1 or keep < 1:
        raise ValueError("at least an hour and one generation are kept")
    from pyspark.sql import Window as W

    retired = F.col("tracked") & (F.col("state") == "retired") & F.col("inactive_at").isNotNull()
    newest = F.row_number().over(W.partitionBy(retired).orderBy(F.desc("inactive_at"), F.desc("name")))
    rows = inventory.withColumn("_newest", F.when(retired, newest))
    age = F.unix_timestamp(now) - F.unix_timestamp("inactive_at")
    tests = [
        F.col("name") == legacy, F.col("active"), F.col("aliased"), F.col("in_journal"), ~is_generation_name(F.col("name"), legacy), ~F.col("present"), ~F.col("tracked"),
        F.col("tracked") & ~F.coalesce(F.col("state").isin("retired", "abandoned"), F.lit(False)),
        F.col("tracked") & F.col("recorded_uuid").isNull(), F.col("tracked") & (F.col("recorded_uuid") != F.col("live_uuid")),
        F.col("tracked") & F.col("inactive_at").isNull(), F.col("tracked") & (age < min_age_hours * 3600),
        F.coalesce(F.col("live_uuid").isin("", "_na_"), F.lit(True)), F.col("_newest") <= keep,
    ]
    texts = [F.concat_ws(" ", F.lit(r), "state") if r == "lifecycle state" else F.lit(r) for r in REASONS]
    reasons = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), r) for t, r in zip(tests, texts, strict=True))))
    return rows.withColumn("reasons", reasons).drop("_newest").withColumn("eligible", F.size("reasons") == 0)


def reconcile(metadata: DataFrame, audit: DataFrame, journal: DataFrame) -> DataFrame:
    """All index names that any of the three knows, with what each of them says."""
    return metadata.join(audit, "index_name", "full_outer").join(journal, "index_name", "full_outer")
