"""Models behind columns: a task loads its model once, texts go to it in batches of like length, and what it returns is checked.

A model is a function of a list; ``load`` makes it, in the task that uses it. Nulls are not sent to it and stay null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH = 32


class ModelError(ValueError):
    """A model has returned something other than one finite result for each of its inputs."""


def in_batches(ask: Callable[[list], object], inputs: list, lengths: list[int], size: int, width: int | None) -> np.ndarray:
    """The model's results, a row (or, without ``width``, a number) for each input; inputs of like length go together."""
    out = np.zeros((len(inputs), width or 1))
    order = np.argsort(lengths, kind="stable")
    for a in range(0, len(order), size):
        at = order[a : a + size]
        given = ask([inputs[k] for k in at])
        given = given if isinstance(given, np.ndarray) else list(given)
        if len(given) != len(at):
            raise ModelError(f"the model returned {len(given)} results for {len(at)} inputs")
        if not isinstance(given, np.ndarray) and any(isinstance(x, bool) for x in given):
            raise ModelError("a result is no number")
        try:
            rows = np.asarray(given, float).reshape(len(at), -1)
        except (TypeError, ValueError):
            raise ModelError("a result is no number, or not of the others' length") from None
        if rows.shape[1] != out.shape[1]:
            raise ModelError(f"a result has {rows.shape[1]} numbers, not {out.shape[1]}")
        if not np.isfinite(rows).all():
            raise ModelError("a result is not finite")
        out[at] = rows
    return out


def embedder(load: Callable[[], Callable[[list[str]], object]], dims: int, size: int = BATCH) -> Callable[[Column], Column]:
    """A column function: the text's vector of ``dims`` numbers by a model that takes a list of texts."""
    if size < 1 or dims < 1:
        raise ValueError("a batch has at least one text, and a vector one number")

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ask = load()
        for texts in batches:
            values = texts.to_pylist()
            there = [k for k, t in enumerate(values) if t is not None]
            found = in_batches(ask, [values[k] for k in there], [len(values[k]) for k in there], size, dims)
            rows: list = [None] * len(values)
            for k, row in zip(there, found.tolist(), strict=True):
                rows[k] = row
            yield pa.array(rows, pa.list_(pa.float32()))

    return embed


def scorer(load: Callable[[], Callable[[list[tuple[str, str]]], object]], size: int = BATCH) -> Callable[[Column, Column], Column]:
    """A column function: the score of a query and a document by a model that takes a list of pairs."""
    if size < 1:
        raise ValueError("a batch has at least one pair")

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ask = load()
        for queries, documents in batches:
            pairs = list(zip(queries.to_pylist(), documents.to_pylist(), strict=True))
            there = [k for k, (q, d) in enumerate(pairs) if q is not None and d is not None]
            found = in_batches(ask, [pairs[k] for k in there], [len(pairs[k][1]) for k in there], size, None)
            rows: list = [None] * len(pairs)
            for k, x in zip(there, found[:, 0].tolist(), strict=True):
                rows[k] = x
            yield pa.array(rows, pa.float64())

    return score
