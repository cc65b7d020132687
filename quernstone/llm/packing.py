"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of tokens, with a target share: by default its tokens to the power ``TEMPER``, which
lifts small sources, or what ``shares`` says. Every window of output tokens takes from each queue what is due
to it, in whole tokens; what is due and less than a token stays in that queue's deficit
counter and is carried to the next window. So each single window has the target proportions, to about a token a queue. A window is a number of sequences, of ``window`` tokens in all or, with many queues,
of ``quantum`` tokens for each on average, so that documents are not cut to crumbs. A queue that runs dry leaves its share to the others, in their proportions.

As documents may be cut anywhere, the counters have a closed form. At time t a queue of T tokens and rate r has been due min(T, r t);
their sum over the queues is piecewise linear in t, so the time at which each window ends follows from the sorted times at which queues run dry.
No task waits for another: one pass tokenises and writes the token table, with each
document's start inside its (partition, source); a cumulative sum over those groups
gives every group its start in its queue, which carries the deficits over
partitions; a second pass places each document by arithmetic.

The windows lie end to end and make sequences of ``seq_len``. What remains at the
very end becomes sequences with lengths that are powers of two, so nothing is padded.

The driver holds a total for each of at most ``MAX_QUEUES`` queues. With more sources than that a queue is a group of sources by hash, and
inside the group its sources take turns in the same way, so that each source still has its queue.

Cases: a null or empty text is its end token alone. A null source is a queue of its
own. Repeated documents are packed each. With ``shares``, a source that they do not name shares what ``*`` has with the others like it, by tokens;
without ``*`` it is a ValueError. An empty table gives an empty result. Columns other than
id, text and source are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: Up to so many (partition, source) groups are broadcast (24 bytes each); beyond it they are joined by a shuffle.
BROADCAST_GROUPS = 500_000
#: Queues at most, and the power of a source's tokens that its target share is in proportion to.
MAX_QUEUES, TEMPER = 16_384, 0.7

TOKENS = "part int, source string, start long, doc_id long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encoder(path: str):
    """ids(text) by the tokenizer file; the same ranks in tiktoken's faster encoder where they lie beside it and no special token occurs."""
    import base64
    import os

    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    plain = lambda text: slow.encode(text, add_special_tokens=False).ids
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return plain
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    return lambda text: plain(text) if any(s in text for s in special) else fast.encode_ordinary(text)


def tokenise(docs: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """The token table; ``start`` counts the tokens of the same source earlier in the same partition."""

    def run(batches):
        from pyspark import TaskContext

        encode, part, seen = _encoder(vocabulary), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows, size = [], 0
            for i, text, source in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids = np.array([*(encode(text) if text else ()), end_id], "<u4")
                start = seen.get(source, 0)
                seen[source] = start + len(ids)
                rows.append((part, source, start, i, len(ids), (ids.astype("<u2") if ids.max() < 65536 else ids).tobytes()))
                size += 2 * len(ids)
                if size > 1 << 22:
                    yield _batch(rows, TOKENS)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, TOKENS)

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.col(source_col).alias("s")).mapInArrow(run, TOKENS)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(f.strip().split(" ") for f in schema.split(",")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


class Plan:
    """What each queue has given after each window: arithmetic on the queues' totals and rates alone."""

    def __init__(self, totals: list[int], rates: list[float], window: int, quantum: int) -> None:
        self.totals, self.rates = np.array(totals, np.int64), np.array(rates, float)
        self.window, self.quantum = window, quantum
        self.windows = -(-int(self.totals.sum()) // window)
        # queues' turns are spread over a quantum, so that windows come out even
        self.early = np.arange(len(totals)) * 0.6180339887498949 % 1 * quantum
        dry = self.totals / self.rates
        order = np.argsort(dry, kind="stable")
        rest = np.append(np.cumsum(self.rates[order][::-1])[::-1], 0.0)
        self.dry = [0.0, *dry[order].tolist()]
        self.flow = rest.tolist()
        self.out = [0.0, *np.maximum.accumulate(np.cumsum(self.totals[order]) + dry[order] * rest[1:]).tolist()]
        self._held: dict[int, tuple] = {}
        self._most = max(16, (1 << 19) // max(1, len(totals)))

    def time(self, w: int) -> float:
        """When the queues together have been due w windows."""
        due = self.window * w
        k = bisect_right(self.out, due) - 1
        return self.dry[k] + (due - self.out[k]) / self.flow[k] if self.flow[k] > 0 else self.dry[-1]

    def given(self, w: int) -> tuple:
        """(tokens given by each queue in the first w windows, the same summed up before each queue and over all)."""
        got = self._held.get(w)
        if got is None:
            if w <= 0:
                amount = np.zeros(len(self.totals), np.int64)
            elif w >= self.windows:
                amount = self.totals
            else:
                amount = np.floor((self.rates * self.time(w) + self.early) / self.quantum).astype(np.int64) * self.quantum
                amount = np.minimum(amount, self.totals)
            before = np.concatenate([[0], np.cumsum(amount)])
            got = (amount.tolist(), before.tolist()) if len(amount) <= 64 else (amount, before)
            if len(self._held) >= self._most:
                self._held.clear()
            self._held[w] = got
        return got

    def window_of(self, q: int, pos: int) -> int:
        """The window that token ``pos`` of queue q is given in."""
        when = ((pos // self.quantum + 1) * self.quantum - self.early[q]) / self.rates[q]
        k = bisect_right(self.dry, when) - 1
        w = min(max(int((self.out[k] + self.flow[k] * (when - self.dry[k])) / self.window), 0), self.windows - 1)
        while self.given(w + 1)[0][q] <= pos:
            w += 1
        while self.given(w)[0][q] > pos:
            w -= 1
        return w

    def spans(self, q: int, begin: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(begin in the queue, length, output position) of the runs that n tokens from ``begin`` fall into; runs that meet are one."""
        end, now = begin + n, None
        while begin < end:
            w = self.window_of(q, begin)
            (amount, before), (more, after) = self.given(w), self.given(w + 1)
            stop = min(end, int(more[q]))
            pos = int(before[-1] - before[q] + after[q] + begin - amount[q])
            if now and now[2] + now[1] == pos:
                now = (now[0], now[1] + stop - begin, now[2])
            else:
                if now:
                    yield now
                now = (begin, stop - begin, pos)
            begin = stop
        if now:
            yield now


def rates_of(sources: list[tuple[str | None, int]], shares: dict[str, float] | None, temper: float) -> list[float]:
    """The rate of each (source, tokens): its share of what flows while no queue is dry."""
    if shares is None:
        return [float(n) ** temper for _, n in sources]
    others = sum(n for s, n in sources if s not in shares)
    if others and not shares.get("*", 0) > 0:
        raise ValueError("there are sources without a share: name them or give '*' a share")
    if any(not x > 0 for x in shares.values()):
        raise ValueError("shares must be positive")
    return [float(shares[s]) if s in shares else shares["*"] * n / others for s, n in sources]


def window_for(queues: int, seq_len: int, window: int, quantum: int) -> int:
    """Tokens of a window: whole sequences, and a quantum for each queue on average."""
    return seq_len * -(-max(window, queues * quantum) // seq_len)


def sequence_of(pos: int, total: int, seq_len: int) -> tuple[int, int, int]:
    """(sequence, offset in it, its end as an output position); the tail is cut at powers of two."""
    full = total // seq_len
    if pos < full * seq_len:
        s = pos // seq_len
        return s, pos - s * seq_len, (s + 1) * seq_len
    start, s, rest = full * seq_len, full, total % seq_len
    while True:
        size = 1 << (rest.bit_length() - 1)
        if pos < start + size:
            return s, pos - start, start + size
        start, s, rest = start + size, s + 1, rest - size


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seq_len: int = 2048, window: int = 65_536, quantum: int = 512, shares: dict[str, float] | None = None, temper: float = TEMPER, max_queues: int = MAX_QUEUES, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """Pieces of documents, as in ``PIECES``, with the source."""
    spark = docs.sparkSession
    tokens = materialise(tokenise(docs, id_col, text_col, source_col, vocabulary or default_vocabulary(), end_id), "tokens")
    groups = materialise(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "token-groups")
    sources = materialise(groups.groupBy("source").agg(F.sum("n").alias("n")), "token-sources")
    schema = PIECES + ", source string"
    if not (n_sources := sources.count()):
        return spark.createDataFrame([], schema)
    grouped = n_sources > max_queues
    if not grouped:
        found = sorted(((r["source"], r["n"]) for r in sources.collect()), key=lambda x: (x[0] is None, x[0] or ""))
        totals, rates = [n for _, n in found], rates_of(found, shares, temper)
        queues = spark.createDataFrame([(s, q, 0, None) for q, (s, _) in enumerate(found)], "s string, q int, m int, members array<long>")
    else:
        if shares is not None:
            raise ValueError(f"shares are for {max_queues} sources at most")
        by_hash = sources.select(F.pmod(F.xxhash64("source"), F.lit(max_queues)).cast("int").alias("q"), "source", "n")
        members = by_hash.groupBy("q").agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "n"))).alias("members"), F.sum("n").alias("all"), F.sum(F.pow(F.col("n").cast("double"), F.lit(temper))).alias("rate"))
        members = materialise(members, "token-queues")
        found = sorted(tuple(r) for r in members.select("q", "all", "rate").collect())
        place = dict((r[0], k) for k, r in enumerate(found))
        totals, rates = [r[1] for r in found], [r[2] for r in found]
        queues = members.join(F.broadcast(spark.createDataFrame(list(place.items()), "q int, k int")), "q").select("k", F.posexplode("members").alias("m", "x"), F.col("members.n").alias("members")).select(F.col("x.source").alias("s"), F.col("k").alias("q"), "m", "members")
    total = sum(totals)
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = groups.select("part", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = bases.join(queues if grouped else F.broadcast(queues), bases["source"].eqNullSafe(queues["s"])).select(F.col("part").alias("p"), "s", "base", "q", "m", "members")
    if not grouped and groups.count() <= BROADCAST_GROUPS:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, (tokens["part"] == bases["p"]) & tokens["source"].eqNullSafe(bases["s"])).select("doc_id", "source", "q", "m", "members", (F.col("base") + F.col("start")).alias("begin"), "n", "ids")

    def run(batches):
        outer = Plan(totals, rates, window_for(len(totals), seq_len, window, quantum), 1)
        inner: dict[int, Plan] = {}

        def spans(q, m, members, begin, n):
            if not members or len(members) == 1:
                yield from outer.spans(q, begin, n)
                return
            if q not in inner:
                if len(inner) > 64:
                    inner.clear()
                inner[q] = Plan(members, rates_of([("", x) for x in members], None, temper), window_for(len(members), seq_len, window, quantum), 1)
            for at, length, pos in inner[q].spans(m, begin, n):
                for there, part, out in outer.spans(q, pos, length):
                    yield at + there - pos, part, out

        for batch in batches:
            rows = []
            for doc, source, q, m, members, begin, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                for at, length, pos in spans(q, m, members, begin, n):
                    while length:
                        s, offset, end = sequence_of(pos, total, seq_len)
                        cut = min(length, end - pos)
                        rows.append((doc, at - begin, cut, zlib.crc32(ids[at - begin : at - begin + cut]), n, s, offset, source))
                        at, pos, length = at + cut, pos + cut, length - cut
            if rows:
                yield _batch(rows, schema)

    return placed.mapInArrow(run, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_packing": op2_packing}
ORACLE: dict[str, str] = {}
