"""Writer coordination by file locks: normal writers share the corpus and own their repository, publication owns the corpus."""

from __future__ import annotations

import fcntl
import json
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from pathlib import Path

from ..schema import positive_id


class WriterBusy(RuntimeError):
    """Another writer holds what is asked for."""


@contextmanager
def _held(path: Path, exclusive: bool) -> Iterator[None]:
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a") as f:
        try:
            fcntl.flock(f, (fcntl.LOCK_EX if exclusive else fcntl.LOCK_SH) | fcntl.LOCK_NB)
        except BlockingIOError:
            raise WriterBusy("a writer is at work") from None
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


@contextmanager
def writer(root: str, repository_id: int | None, publication: bool = False, pending: Callable[[], dict | None] | None = None) -> Iterator[None]:
    """Hold the locks of a writer, of a repository or (None, for publications) of the whole corpus; a publication that was left pending blocks all but its owner.

    ``root``: a folder that all writers share, on a file system with locks. ``pending`` reads the store's journal, once the locks are held; by default the one in the folder.
    """
    if repository_id is not None:
        positive_id(repository_id)
    elif not publication:
        raise ValueError("a writer without a repository publishes")
    folder = Path(root) / "locks"
    with ExitStack() as stack:
        stack.enter_context(_held(folder / "corpus", publication))
        if repository_id is not None:
            stack.enter_context(_held(folder / f"repository-{repository_id}", True))
        journal = Path(root) / "publication.json"
        job = pending() if pending else json.loads(journal.read_text()) if journal.exists() else None
        if job:
            owner = job.get("repository_id")
            if not publication or owner not in (None, repository_id):
                raise WriterBusy("a publication is to be resumed first")
        yield
