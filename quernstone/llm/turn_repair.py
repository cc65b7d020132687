"""Conversation structure repair by cost layers.

A conversation is valid if its turns' role initials read ``(s?(ua)+)?``: four states of a grammar. Each turn is kept, given
another role, or deleted, and turns may be inserted, each at a cost. Costs grow layer by layer: a layer has, for each turn, the set (four bits) of
grammar states from which the rest can be brought to an end at that cost, and shifts it to the turn before by the edits. The first layer with the start
state before the first turn gives the cost; the trace back through the layers takes the least letter that still leads to an end, which gives the
ASCII-least audit: (D)elete, (I)nsert, (K)eep, (R)erole.

On Spark: equal turns are aggregated, repeats are told by a join on digests, turns are ranged by conversation and turn so that
a long one lies in several tasks, and each task sends on one byte a turn; texts are shuffled once, to where the audit of their
conversation goes, and are read there as a stream, so that no conversation's texts are held.

Cases: null conversation ids are one conversation; a null role or text reads as one space; null turns come first and count for no gap; equal turn numbers
are ordered by a digest of role and text; gaps beyond 64 bits are the largest long; an empty table has no conversations. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: What is not white space here.
VISIBLE = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
#: A turn's byte: its initial (s, u, a, another) and four times its fault.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Grammar states as bits: at the start, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = 1, 2, 4, 8
ENDS = START | AFTER_A
NEVER = 1 << 30


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def _before(kind: int, states: int) -> int:
    """The states that an emitted initial leads from into ``states``."""
    if kind == USER:
        return START | AFTER_S | AFTER_A if states & AFTER_U else 0
    if kind == ASSISTANT:
        return AFTER_U if states & AFTER_A else 0
    return START if kind == SYSTEM and states & AFTER_S else 0


BEFORE = [[_before(kind, states) for states in range(16)] for kind in range(4)]
#: The same of a turn whose role is chosen.
CHOSEN = [BEFORE[USER][states] | BEFORE[ASSISTANT][states] for states in range(16)]


def layered(codes: bytes, costs: Costs = Costs()) -> array:
    """The layer, that is the least cost to the end, of each (turn, state); NEVER for what lies beyond the answer's layer."""
    n = len(codes)
    layer = array("i", [NEVER]) * (4 * (n + 1))
    reached = bytearray(n + 1)
    waiting: dict[int, list[tuple[int, int]]] = {0: [(n, ENDS)]}
    cost = 0
    while not reached[0] & START:
        work = waiting.pop(cost, [])
        while work:
            i, states = work.pop()
            fresh = states & ~reached[i]
            if not fresh:
                continue
            reached[i] |= fresh
            for s in range(4):
                if fresh >> s & 1:
                    layer[4 * i + s] = cost
            if CHOSEN[fresh]:
                waiting.setdefault(cost + costs.insert, []).append((i, CHOSEN[fresh]))
            if not i:
                continue
            waiting.setdefault(cost + costs.delete, []).append((i - 1, fresh))
            kind, fault = codes[i - 1] & 3, codes[i - 1] >> 2
            if fault in (BLANK, DUPLICATE):
                continue
            more = costs.truncated if fault == TRUNCATED else 0
            if kept := BEFORE[kind][fresh]:
                (waiting.setdefault(cost + more, []) if more else work).append((i - 1, kept))
            if CHOSEN[fresh]:
                waiting.setdefault(cost + more + costs.rerole, []).append((i - 1, CHOSEN[fresh]))
        cost += 1
    return layer


def traced(codes: bytes, layer: array, costs: Costs = Costs()) -> str:
    """The ASCII-least audit of the least cost."""
    n, i, s, left, out = len(codes), 0, 0, layer[0], []
    emitted = {(0, SYSTEM): 1, (0, USER): 2, (1, USER): 2, (3, USER): 2, (2, ASSISTANT): 3}
    while i < n or left:
        chosen = 3 if s == 2 else 2
        if i < n:
            kind, fault = codes[i] & 3, codes[i] >> 2
            if layer[4 * (i + 1) + s] == left - costs.delete:
                i, left = i + 1, left - costs.delete
                out.append("D")
                continue
        if layer[4 * i + chosen] == left - costs.insert:
            s, left = chosen, left - costs.insert
            out.append("I")
            continue
        more = costs.truncated if fault == TRUNCATED else 0
        kept = emitted.get((s, kind))
        if kept is not None and layer[4 * (i + 1) + kept] == left - more:
            s, left = kept, left - more
            out.append("K")
        else:
            s, left = chosen, left - more - costs.rerole
            out.append("R")
        i += 1
    return "".join(out)


def repair(codes: bytes, costs: Costs = Costs()) -> tuple[int, str]:
    """(cost, audit) of a conversation, a byte a turn."""
    layer = layered(codes, costs)
    return layer[0], traced(codes, layer, costs)


@lru_cache(1 << 16)
def _short(codes: bytes, costs: Costs) -> tuple[int, str]:
    return repair(codes, costs)


def _typed(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text, digest) without nulls in role and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def _codes(rows: DataFrame) -> DataFrame:
    """(conv, turn, digest, n, first, later): distinct turns, how many of each, the byte of the first one and that of the others."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(~F.col("text").rlike(VISIBLE), BLANK).when(~F.col("text").rlike(ENDED), TRUNCATED).otherwise(FINE)
    light = rows.select("conv", "turn", "digest", kind.cast("int").alias("kind"), fault.cast("int").alias("fault"))
    light = light.groupBy("conv", "turn", "digest", "kind", "fault").agg(F.count("*").alias("n"))
    order = F.struct(F.col("turn").isNotNull().alias("told"), "turn")
    first = light.groupBy(F.col("conv").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(order).alias("_first"))
    both = light.join(first, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")))
    repeated = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)
    seen = F.when(F.col("_first") < order, repeated).otherwise(F.col("fault"))
    return both.select("conv", "turn", "digest", "n", (F.col("kind") + 4 * seen).cast("int").alias("first"), (F.col("kind") + 4 * repeated).cast("int").alias("later"))


def _pieces(codes: DataFrame) -> DataFrame:
    """(conv, piece, codes, low, high, numbers): of each conversation in each range of turns, its bytes, its least and greatest turn and how many distinct ones."""
    keys = ["conv", "turn", "digest"]
    ranged = codes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("piece", F.spark_partition_id())
    schema = T.StructType([codes.schema["conv"], *T.StructType.fromDDL("piece int, codes binary, low bigint, high bigint, numbers bigint")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, open_ = to_arrow_schema(schema), None  # open_: the conversation at the end of the last batch
        for batch in batches:
            conv, turn = batch.column("conv").to_pylist(), batch.column("turn").to_pylist()
            n, first, later = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "first", "later"))
            data = np.repeat(later, n).astype(np.uint8)
            begin = np.cumsum(n) - n
            data[begin] = first
            ends = [k for k in range(1, len(conv)) if conv[k] != conv[k - 1]] + [len(conv)]
            out, a = [], 0
            for b in ends:
                if open_ and open_[0] != conv[a]:
                    out.append(open_)
                    open_ = None
                open_ = open_ or [conv[a], batch.column("piece")[a].as_py(), bytearray(), None, None, 0]
                open_[2] += data[begin[a] : begin[b - 1] + n[b - 1]].tobytes()
                for t in turn[a:b]:
                    if t is not None and t != open_[4]:
                        open_[3] = t if open_[3] is None else open_[3]
                        open_[4], open_[5] = t, open_[5] + 1
                a = b
            if out:
                yield _batch(out, arrow)
        if open_:
            yield _batch([open_], arrow)

    return ranged.mapInArrow(run, schema)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([bytes(x) for x in c] if pa.types.is_binary(f.type) else c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


MEASURES = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_FOLLOWS = np.zeros((4, 4), bool)
_FOLLOWS[[SYSTEM, USER, ASSISTANT], [USER, ASSISTANT, USER]] = True


def audits(turns: DataFrame, ids: DataFrame | None = None, costs: Costs = Costs()) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of ``turns`` (conv_id, turn, role, text), and of those of ``ids`` (conv_id) without any turn."""
    pieces = _pieces(_codes(_typed(turns)))
    schema = T.StructType([T.StructField("conv_id", pieces.schema["conv"].dataType), *T.StructType.fromDDL(MEASURES)])
    if ids is not None:
        none = ids.select(F.col("conv_id").alias("conv")).distinct()
        empty = [F.lit(-1).cast("int").alias("piece"), F.lit(b"").alias("codes"), *(F.lit(None).cast("long").alias(c) for c in ("low", "high")), F.lit(0).cast("long").alias("numbers")]
        pieces = pieces.unionByName(none.select("conv", *empty))
    grouped = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("piece", "codes", "low", "high", "numbers"))).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = b"".join(p["codes"] for p in parts)
                told = [p for p in parts if p["numbers"]]
                numbers = sum(p["numbers"] for p in told) - sum(a["high"] == b["low"] for a, b in zip(told, told[1:], strict=False))
                gaps = min(told[-1]["high"] - told[0]["low"] + 1 - numbers, 2**63 - 1) if told else 0
                data = np.frombuffer(codes, np.uint8)
                faults = np.bincount(data >> 2, minlength=4)
                kinds = data & 3
                illegal = int((~_FOLLOWS[kinds[:-1], kinds[1:]]).sum()) if len(codes) > 1 else 0
                out.append([conv, gaps, *(int(faults[f]) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, *(_short if len(codes) < 200 else repair)(codes, costs)])
            if out:
                yield _batch(out, arrow)

    return grouped.mapInArrow(run, schema)


def _followed(turns: DataFrame, told: DataFrame) -> DataFrame:
    """Each conversation's audit row and then its turns in order, in one task: what ``_edits`` reads."""
    measures = [f.name for f in T.StructType.fromDDL(MEASURES)]
    rows = _typed(turns)
    head = told.select(F.col("conv_id").alias("conv"), F.lit(0).alias("is_turn"), F.struct(*measures).alias("told"))
    head = head.select("*", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "text", "digest")))
    rows = rows.withColumns({"is_turn": F.lit(1), "told": F.lit(None).cast(head.schema["told"].dataType)})
    return head.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "is_turn", "turn", "digest").select("conv", "is_turn", "told", "turn", "role", "text")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("told", conv, measures) for each conversation and then (letter, conv, turn, role, text) for each edit; role and text as repaired."""
    conv = audit = None
    at = after_u = 0

    def inserted():
        nonlocal at, after_u
        while at < len(audit) and audit[at] == "I":
            at += 1
            yield "I", conv, None, "assistant" if after_u else "user", ""
            after_u = not after_u

    for batch in batches:
        for who, is_turn, told, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not is_turn:
                if audit is not None:
                    yield from inserted()
                conv, audit, at, after_u = who, told["audit"], 0, 0
                yield "told", conv, told
                continue
            yield from inserted()
            letter, at = audit[at], at + 1
            if letter == "R":
                role = "assistant" if after_u else "user"
            yield letter, conv, turn, role, text
            if letter != "D":
                after_u = role[:1] == "u"
    if audit is not None:
        yield from inserted()


#: Edits of a batch that is sent on.
ROWS = 1000


def repaired_turns(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(conv_id, position, edit, turn, role, text): the turns of the repaired conversations, from position 0, and the deleted ones without a position."""
    rows = _followed(turns, audits(turns, None, costs))
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv"].dataType), *T.StructType.fromDDL("position bigint, edit string, turn bigint, role string, text string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, out, position = to_arrow_schema(schema), [], 0
        for letter, conv, *rest in _edits(batches):
            if letter == "told":
                position = 0
                continue
            out.append([conv, None if letter == "D" else position, letter, *rest])
            position += letter != "D"
            if len(out) >= ROWS:
                yield _batch(out, arrow)
                out = []
        if out:
            yield _batch(out, arrow)

    return rows.mapInArrow(run, schema)


def digests(turns: DataFrame, told: DataFrame) -> DataFrame:
    """``told`` (what ``audits`` gave) with the SHA-256 of the repaired turns, ``role:text`` a line; texts pass as a stream."""
    rows = _followed(turns, told)
    schema = T.StructType([*told.schema, T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, out, row, sha, some = to_arrow_schema(schema), [], None, None, False
        for letter, conv, *rest in _edits(batches):
            if letter == "told":
                if row:
                    out.append([*row, sha.hexdigest()])
                if len(out) >= ROWS:
                    yield _batch(out, arrow)
                    out = []
                row, sha, some = [conv, *rest[0].values()], hashlib.sha256(), False
            elif letter != "D":
                sha.update(f"{chr(10) if some else ''}{rest[1]}:{rest[2]}".encode())
                some = True
        if row:
            yield _batch([*out, [*row, sha.hexdigest()]], arrow)

    return rows.mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by the remainder of a checksum of conversation and turn."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"), hit.alias("hit")).where("hit != 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations repaired: counts of faults, the least cost, its audit, and a digest of what comes out."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = damaged(conversations)
    return digests(turns, audits(turns, conversations.select("conv_id")))


def _least(options: list[tuple[str, str, str, str]]) -> str:
    """SQL of the least (cost, audit) of (condition, cost, letter, from): a struct c, a."""
    parts = ", ".join(f"CASE WHEN {ok} THEN {{'c': {src}.c + {cost}, 'a': '{letter}' || {src}.a}} ELSE {{'c': 1000000000, 'a': ''}} END" for ok, cost, letter, src in options)
    return f"list_min([{parts}])"


def _sql() -> str:
    ok, more = "fault IN (0, 3)", "(CASE WHEN fault = 3 THEN 5 ELSE 0 END)"
    step = {}
    for s, following in enumerate(({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})):
        options = [("true", "2", "D", f"b.s{s}")]
        for kind, to in following.items():
            options.append((f"{ok} AND kind = '{kind}'", more, "K", f"b.s{to}"))
            if kind != "s":
                options.append((ok, f"1 + {more}", "R", f"b.s{to}"))
        step[s] = _least(options)
    # an insertion leads from one state to another before the same turn; two of them lead back, so that two rounds are enough
    inserts = {0: 2, 1: 2, 2: 3, 3: 2}
    again = ", ".join("list_min([s{0}, {{'c': s{1}.c + 5, 'a': 'I' || s{1}.a}}]) AS s{0}".format(s, to) for s, to in inserts.items())
    none, far = "{'c': 0::BIGINT, 'a': ''}", "{'c': 1000000000::BIGINT, 'a': ''}"
    return rf"""
WITH RECURSIVE source AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
    FROM conversations
), crc_table AS (
    SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))
), hit AS (
    SELECT s.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(k) + 1), lambda i: ascii(substring(k, i, 1))::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 20 AS h
    FROM source s, crc_table
), turns AS (
    SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM hit, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) WHERE h <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS seen
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS p FROM turns)
), told AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
        role[1] AS kind, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY p) AS prior
    FROM placed
), counted AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
        count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (prior IS NOT NULL AND prior || kind NOT IN ('su', 'ua', 'au')) AS illegal
    FROM told GROUP BY conv_id
), back AS (
    SELECT conv_id, n AS i, {none} AS s0, {far} AS s1, {{'c': 5::BIGINT, 'a': 'I'}} AS s2, {none} AS s3 FROM counted
    UNION ALL
    SELECT conv_id, i, {again} FROM (
        SELECT conv_id, i, {again} FROM (
            SELECT b.conv_id, b.i - 1 AS i, {", ".join(f"{v} AS s{k}" for k, v in step.items())}
            FROM back b JOIN told t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.p = b.i))
), least AS (
    SELECT conv_id, s0.c AS cost, s0.a AS audit FROM back WHERE i = 0
), letters AS (
    SELECT conv_id, j, audit[j] AS letter, sum((audit[j] <> 'I')::INT) OVER w AS p, sum((audit[j] <> 'D')::INT) OVER w AS e
    FROM least, unnest(range(1, length(audit) + 1)) r(j) WINDOW w AS (PARTITION BY conv_id ORDER BY j)
), edited AS (
    SELECT l.*, t.role, t.text, max((l.e = 1 AND l.letter = 'K' AND t.kind = 's')::INT) OVER (PARTITION BY l.conv_id) AS has_s
    FROM letters l LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.p = l.p AND l.letter <> 'I'
), repaired AS (
    SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (e - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha
    FROM edited WHERE letter <> 'D' GROUP BY conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
    coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(l.cost, 0)::BIGINT AS cost, coalesce(l.audit, '') AS audit, coalesce(r.sha, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN least l ON l.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


QUERIES = {"op13_turn_repair": op13_turn_repair}
ORACLE = {"op13_turn_repair": _sql()}
