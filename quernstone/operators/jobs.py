"""Journals of synchronisation and full indexing: work that was begun is replayed before anything newer."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import positive_id


class Journal:
    """Pending jobs under a folder, one file a repository and kind."""

    def __init__(self, root: str):
        self.root = Path(root) / "jobs"
        self.root.mkdir(parents=True, exist_ok=True)

    def _path(self, kind: str, repository_id: int) -> Path:
        return self.root / f"{kind}-{positive_id(repository_id)}.json"

    def begin(self, kind: str, repository_id: int, **job) -> dict:
        """Write a job down; one that is pending already is returned as it is."""
        if found := self.pending(kind, repository_id):
            return found
        if kind == "sync" and self.pending("full", repository_id):
            raise RuntimeError("a full index of the repository is pending")
        job = {"repository_id": repository_id, "id": uuid.uuid4().hex, **job}
        part = self.root / uuid.uuid4().hex
        part.write_text(json.dumps(job, allow_nan=False))
        os.replace(part, self._path(kind, repository_id))
        return job

    def pending(self, kind: str, repository_id: int) -> dict | None:
        path = self._path(kind, repository_id)
        return json.loads(path.read_text()) if path.exists() else None

    def finish(self, kind: str, repository_id: int) -> None:
        self._path(kind, repository_id).unlink(missing_ok=True)

    def all(self, kind: str) -> list[dict]:
        return sorted((json.loads(p.read_text()) for p in self.root.glob(f"{kind}-*.json")), key=lambda j: j["repository_id"])


def run_sync(journal: Journal, repository_id: int, head: Callable[[], tuple[str, str]], affected: Callable[[str, str], list[str]], apply: Callable[[dict], None]) -> dict:
    """Replay a pending sync, or begin one if the head has moved; the job is dropped only after ``apply`` (delete, index, cache rotation, checkpoint) has ended.

    Returns the job's report; ``changed`` is false where there was nothing to do.
    """
    job = journal.pending("sync", repository_id)
    if job is None:
        old, new = head()
        if old == new:
            return {"changed": False, "paths": 0}
        job = journal.begin("sync", repository_id, old_commit=old, target_commit=new, affected_paths=sorted(set(affected(old, new))))
    apply(job)
    journal.finish("sync", repository_id)
    return {"changed": True, "paths": len(job["affected_paths"]), "target_commit": job["target_commit"]}


def inspect(journal: Journal, publication: dict | None = None) -> dict:
    """What is pending and what blocks it; reads only."""
    sync, full = journal.all("sync"), journal.all("full")
    for job in sync:
        if not isinstance(job.get("affected_paths"), list) or not all(isinstance(p, str) and p for p in job["affected_paths"]):
            raise RuntimeError("a sync job's paths are malformed")
    both = {j["repository_id"] for j in sync} & {j["repository_id"] for j in full}
    owner = publication.get("repository_id") if publication else None
    reason = lambda j, kind: "sync and full jobs conflict" if j["repository_id"] in both else "a publication is pending" if publication and (kind == "sync" or owner != j["repository_id"]) else None
    rows = [{"kind": k, "repository_id": j["repository_id"], "paths": len(j.get("affected_paths", [])), "blocked": reason(j, k)} for k, jobs in (("sync", sync), ("full", full)) for j in jobs]
    return {"jobs": rows, "conflicts": sorted(both), "publication": publication.get("phase") if publication else None}


def report(sync: DataFrame, full: DataFrame, publication_of: int | None = None, publishing: bool = False) -> DataFrame:
    """(kind, repository_id, paths, blocked) of tables of pending jobs: sync (repository_id, affected_paths), full (repository_id); the same rules as ``inspect``.

    ``publishing``: whether a publication is pending, and ``publication_of`` whose it is.
    """
    other = lambda df: df.select(F.col("repository_id").alias("other")).distinct()
    side = lambda df, against, kind, paths: df.join(other(against), F.col("repository_id") == F.col("other"), "left").select(F.lit(kind).alias("kind"), "repository_id", paths.cast("long").alias("paths"), F.col("other").isNotNull().alias("conflict"))
    rows = side(sync, full, "sync", F.size("affected_paths")).unionByName(side(full, sync, "full", F.lit(0)))
    waits = F.lit(publishing) & ((F.col("kind") == "sync") | ~F.col("repository_id").eqNullSafe(F.lit(publication_of)))
    blocked = F.when(F.col("conflict"), "sync and full jobs conflict").when(waits, "a publication is pending")
    return rows.withColumn("blocked", blocked).drop("conflict")
