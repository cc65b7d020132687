"""A result cache fenced by generation tokens, and single-flight sharing of equal queries."""

from __future__ import annotations

import hashlib
import json
import math
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future
from concurrent.futures import TimeoutError as Late

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import cache_digest

MAX_DEPTH, MAX_FLIGHTS, FOLLOWER_WAIT_S, TTL_S, BATCH = 16, 128, 1.0, 300, 256


def digest(query: str, limit: int) -> str:
    return hashlib.sha256(f"{' '.join(query.lower().strip().split())}:{limit}".encode()).hexdigest()


def _nesting(value: object, depth: int = 1) -> int:
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return max([depth, *(_nesting(v, depth + 1) for v in inner if isinstance(v, (dict, list)))])


def encode(rows: list[dict], limit: int) -> str:
    """JSON of a result list; NaN, too many rows or too deep nesting are ValueErrors."""
    if not isinstance(rows, list) or len(rows) > limit or not all(isinstance(r, dict) for r in rows) or _nesting(rows) > MAX_DEPTH:
        raise ValueError("not a result list")
    return json.dumps(rows, allow_nan=False)


def decode(text: str, limit: int) -> list[dict]:
    def pairs(items: list[tuple[str, object]]) -> dict:
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("a key stands twice")
        return out

    def refuse(name: str):
        raise ValueError(f"{name} is no number")

    def finite(text: str) -> float:
        value = float(text)
        if not math.isfinite(value):
            raise ValueError("a number overflows")
        return value

    rows = json.loads(text, object_pairs_hook=pairs, parse_constant=refuse, parse_float=finite)
    if not isinstance(rows, list) or len(rows) > limit or not all(isinstance(r, dict) for r in rows) or _nesting(rows) > MAX_DEPTH:
        raise ValueError("not a result list")
    return rows


class FencedCache:
    """Entries belong to a generation token; a fill counts only if the token it was read under still holds."""

    def __init__(self, ttl: float = TTL_S, clock: Callable[[], float] = time.monotonic):
        self._lock, self._clock, self._ttl = threading.Lock(), clock, ttl
        self._token, self._entries = uuid.uuid4().hex, {}

    def read(self, query: str, limit: int) -> tuple[list[dict] | None, str]:
        """(results or None, token)."""
        with self._lock:
            token, found = self._token, self._entries.get((self._token, digest(query, limit)))
            if found and found[1] <= self._clock():
                found = None
        if not found:
            return None, token
        try:
            return decode(found[0], limit), token
        except ValueError:
            return None, token

    def fill(self, query: str, limit: int, token: str, rows: list[dict]) -> bool:
        try:
            text = encode(rows, limit)
        except (TypeError, ValueError):
            return False
        with self._lock:
            if token != self._token:
                return False
            self._entries[token, digest(query, limit)] = (text, self._clock() + self._ttl)
            return True

    def rotate(self) -> str:
        """A new token; the old one's entries go in batches."""
        with self._lock:
            old, self._token = self._token, uuid.uuid4().hex
            keys = [k for k in self._entries if k[0] == old]
        for k in range(0, len(keys), BATCH):
            with self._lock:
                for key in keys[k : k + BATCH]:
                    self._entries.pop(key, None)
        return self._token


class SearchService:
    """Cache, then single flight, then retrieval; reports how each request was answered."""

    def __init__(self, retrieve: Callable[[str, int], list[dict]], cache: FencedCache, wait: float = FOLLOWER_WAIT_S):
        self._retrieve, self._cache, self._wait = retrieve, cache, wait
        self._lock, self._flights = threading.Lock(), {}

    def search(self, query: str, limit: int = 10, bypass: bool = False) -> tuple[list[dict], str]:
        """(results, outcome): hit, retrieved, coalesced, expired or bypass."""
        check_request(query, limit)
        if bypass:
            return self._retrieve(query, limit), "bypass"
        found, token = self._cache.read(query, limit)
        if found is not None:
            return found, "hit"
        key = (query, limit, token)
        with self._lock:
            flight = self._flights.get(key)
            leads = flight is None and len(self._flights) < MAX_FLIGHTS
            if leads:
                flight = self._flights[key] = Future()
        if not leads:
            if flight is not None:
                try:
                    return json.loads(json.dumps(flight.result(self._wait))), "coalesced"
                except Late:
                    pass
            rows = self._retrieve(query, limit)
            self._cache.fill(query, limit, token, rows)
            return rows, "expired" if flight is not None else "retrieved"
        try:
            found, _ = self._cache.read(query, limit)
            rows = found if found is not None else self._retrieve(query, limit)
            if found is None:
                self._cache.fill(query, limit, token, rows)
            flight.set_result(rows)
            return rows, "retrieved" if found is None else "hit"
        except BaseException as e:
            flight.set_exception(e)
            raise
        finally:
            with self._lock:
                self._flights.pop(key, None)


def check_request(query: str, limit: int) -> None:
    """1 to 4096 characters, not all blank; a limit of 1 to 100."""
    if not isinstance(query, str) or not 1 <= len(query) <= 4096 or not query.strip():
        raise ValueError("a query has 1 to 4096 characters, not all blank")
    if type(limit) is not int or not 1 <= limit <= 100:
        raise ValueError("a limit lies between 1 and 100")


def replay(requests: DataFrame, session: str, ttl: float = TTL_S) -> DataFrame:
    """The outcome of each request of a log: hit, retrieved or bypass; rotations drop what their session has cached.

    requests: (session, n, at, query, limit, kind), n giving the order, at seconds, kind search, bypass or rotate. Requests of one
    session, query, limit and generation go through a cache of their own in one task, as no others can change their outcome.
    """
    order = W.partitionBy(session).orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = requests.withColumn("epoch", F.sum((F.col("kind") == "rotate").cast("int")).over(order)).where("kind <> 'rotate'").withColumn("key", cache_digest(F.col("query"), F.col("limit")))
    schema = T.StructType([*(rows.schema[c] for c in (session, "n")), T.StructField("outcome", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        now, held, service = [0.0], None, None
        for batch in batches:
            outcomes = []
            for who, epoch, key, at, query, limit, kind in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5, 6, 7)), strict=True):
                if (who, epoch, key) != held:
                    held, service = (who, epoch, key), SearchService(lambda query, limit: [], FencedCache(ttl, lambda: now[0]))
                now[0] = at
                outcomes.append(service.search(query, limit, kind == "bypass")[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(outcomes, pa.string())], schema=arrow)

    keys = [session, "epoch", "key"]
    rows = rows.select(session, "n", "epoch", "key", F.col("at").cast("double").alias("at"), "query", F.col("limit").cast("int").alias("limit"), "kind")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "n").mapInArrow(run, schema)


def hit_rates(outcomes: DataFrame, *by: str) -> DataFrame:
    """Requests, hits and the hit percentage by group."""
    hits = F.count(F.when(F.col("outcome") == "hit", 1))
    return outcomes.groupBy(*by).agg(F.count("*").alias("requests"), hits.alias("hits"), F.round(100.0 * hits / F.count("*"), 6).alias("hit_percent"))
