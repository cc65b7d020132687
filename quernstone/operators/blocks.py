"""Stored postings in blocks, and the best documents of a query batch from them.

A segment's documents are dealt into shards of about ``SHARD_DOCS``, by a hash of the id. In a shard a term's postings in a field are ordered by falling impact and cut into blocks of
``BLOCK``; a block has the ids, frequencies, field lengths and test flags of its documents, and its greatest frequency and least length, which
bound its impact whatever the statistics are by now. So a query needs no table but this one and the statistics, which are added up over segments.

The task that reads documents counts their terms, and sends each shard one compressed value for a million pairs, so no row a pair is shuffled or sorted. A shard's lists are made in one task, or, where its
texts are long, in one for each part of the terms, by a hash. They are written as they come out, by term within the shard, and are not shuffled again: a scan for a few terms reads a few pages of each file.

A shard's scores are sums in arrays. First the first blocks of all lists are scored: the limit-th best of these partial sums is a bound that every answer reaches. A
further block is looked at only if its own bound and those of the other terms' lists together reach it; as blocks go by falling impact, most of a common term's list is left out. For batches
that ask for many postings the bound is taken over all shards first, and blocks that stay under it are not sent to be scored at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexical, segments
from .lexical import BOOSTS, K1, B

SHARD_DOCS, BLOCK = 16_384, 256
#: Bytes of a shard's texts of which one task makes the lists; pairs (document, term) that a task counts before it sends them (some 60 bytes each); rows of blocks in one Arrow batch.
PART_BYTES, SENT_PAIRS, SENT_BLOCKS = 24 << 20, 1_000_000, 100_000
#: Rows (query, field, term) that one pass tells to all shards, terms that are given to the scan as a list, and postings from which on a bound is taken first.
PASS_ROWS, LISTED_TERMS, MANY_POSTINGS = 200_000, 500, 5_000_000
#: Scores are rounded to six digits, so what lies below a bound by more than this cannot tie with it.
MARGIN = 2e-6
SCHEMA = "shard int, field string, term string, block int, ids array<bigint>, tfs array<int>, lengths array<int>, tests array<boolean>, max_tf int, min_length int"


def shards_of(docs: int) -> int:
    return max(1, -(-docs // SHARD_DOCS))


def shard(id_: Column, shards: Column | int) -> Column:
    return F.pmod(F.xxhash64(id_.cast("long")), F.lit(shards) if isinstance(shards, int) else shards).cast("int")


def build(docs: DataFrame, n: int, fields: list[str], id_col: str = "symbol_id", is_test: Column | None = None) -> DataFrame:
    """The blocks of ``n`` documents. Documents without an id are no answers; a null test flag is taken as set."""
    test = F.coalesce(F.col("is_test") if is_test is None else is_test, F.lit(True))
    known = docs.where(F.col(id_col).isNotNull())
    size = known.agg(F.sum(sum((F.coalesce(F.octet_length(f), F.lit(0)) for f in fields), F.lit(0)).cast("long"))).first()[0] or 0
    shards = shards_of(n)
    parts = max(1, -(-size // (shards * PART_BYTES)))
    rows = known.select(F.col(id_col).cast("long").alias("id"), test.alias("test"), shard(F.col(id_col), shards).alias("shard"), *(lexical.analyse(F.col(f)).alias(f"f{k}") for k, f in enumerate(fields)))
    sent = rows.mapInArrow(_sent(len(fields), parts), "shard int, part int, b binary")
    return sent.groupBy("shard", "part").applyInArrow(_lists(fields), SCHEMA)


def _sent(fields: int, parts: int):
    """Terms of documents (id, test, shard, tokens of each field), counted; a value for each shard and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pairs = [], 0
        for batch in batches:
            for piece in (batch.slice(a, lexical.COUNTED_ROWS) for a in range(0, batch.num_rows, lexical.COUNTED_ROWS)):
                held.append(_counted(piece, fields))
                pairs += len(held[-1][4])
                if pairs >= SENT_PAIRS:
                    yield from _dealt(held, fields, parts)
                    held, pairs = [], 0
        if held:
            yield from _dealt(held, fields, parts)

    return run


def _counted(piece: pa.RecordBatch, fields: int) -> tuple:
    """(documents: ids, tests, shards, lengths by field), (terms), (list of each pair: field + fields * term), (row), (times)."""
    words = [piece.column(3 + k) for k in range(fields)]
    terms = pc.unique(pa.concat_arrays([w.flatten() for w in words]))
    lists, rows, times, lengths = [], [], [], []
    for k, w in enumerate(words):
        row, term, tf, length = lexical._counted(w, terms)
        lists.append(k + fields * term)
        rows.append(row)
        times.append(tf)
        lengths.append(length)
    about = (piece.column(0).to_numpy(), piece.column(1).to_numpy(zero_copy_only=False).astype(bool), piece.column(2).to_numpy(), np.stack(lengths, axis=1).astype(np.int32))
    return about, terms, np.concatenate(lists), np.concatenate(rows), np.concatenate(times).astype(np.int32)


def _dealt(held: list[tuple], fields: int, parts: int) -> Iterator[pa.RecordBatch]:
    ids, tests, shards, lengths = (np.concatenate([h[0][k] for h in held]) for k in range(4))
    all_terms = pa.chunked_array([h[1] for h in held], pa.string()).combine_chunks().dictionary_encode()
    terms, code = all_terms.dictionary, all_terms.indices.to_numpy()
    begin, first = np.cumsum([0, *(len(h[1]) for h in held)]), np.cumsum([0, *(len(h[0][0]) for h in held)])
    lists = np.concatenate([h[2] % fields + fields * code[begin[k] + h[2] // fields].astype(np.int64) for k, h in enumerate(held)])
    row, tf = np.concatenate([h[3] + first[k] for k, h in enumerate(held)]), np.concatenate([h[4] for h in held])
    part = np.array([zlib.crc32(t.encode()) % parts for t in terms.to_pylist()], np.int64) if parts > 1 else np.zeros(len(terms), np.int64)
    key = shards[row] * parts + part[lists // fields]
    order = np.lexsort((row, lists, key))
    key, lists, row, tf = key[order], lists[order], row[order], tf[order]
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
    for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
        own, at = np.unique(row[a:b], return_inverse=True)
        head = np.flatnonzero(np.concatenate([[True], lists[a + 1 : b] != lists[a : b - 1]]))
        held_lists = lists[a:b][head]
        columns = {
            "ids": ids[own], "tests": tests[own], "lengths": lengths[own].ravel(), "fields": (held_lists % fields).astype(np.int8), "terms": terms.take(pa.array(held_lists // fields)),
            "counts": np.diff(np.append(head, b - a)).astype(np.int32), "docs": at.astype(np.int32), "tfs": tf[a:b],
        }
        yield pa.RecordBatch.from_arrays([pa.array([key[a] // parts], pa.int32()), pa.array([key[a] % parts], pa.int32()), pa.array([_packed(columns)], pa.binary())], names=["shard", "part", "b"])


def _packed(columns: dict) -> bytes:
    """Columns of different lengths as one row of lists, compressed."""
    rows = [pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()]
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(r)], pa.int32()), r) for r in rows], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _lists(fields: list[str]):
    """The blocks of one shard, or of a part of its terms, by term and field."""
    schema = T.StructType.fromDDL(SCHEMA)

    def run(table: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        got = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in table.column("b").combine_chunks()]
        flat = {c: [t.column(c).combine_chunks().flatten() for t in got] for c in got[0].column_names}
        number = lambda c: np.concatenate([x.to_numpy(zero_copy_only=False) for x in flat[c]])
        terms = pa.concat_arrays(flat["terms"]).dictionary_encode()
        by_name = pc.sort_indices(terms.dictionary).to_numpy()
        place = np.empty(len(by_name), np.int64)
        place[by_name] = np.arange(len(by_name))
        ids, doc = np.unique(number("ids"), return_inverse=True)
        first = np.cumsum([0, *(len(x) for x in flat["ids"])])
        row = np.concatenate([x.to_numpy() + first[k] for k, x in enumerate(flat["docs"])])
        counts, field = number("counts"), number("fields")
        of = np.repeat(place[terms.indices.to_numpy()] * len(fields) + field, counts)
        tf, test = number("tfs"), number("tests").astype(bool)
        length = number("lengths").reshape(-1, len(fields))[row, np.repeat(field, counts)]
        del got, flat
        if len(ids) < len(doc):  # rows that share an id are one document
            _, head, same = np.unique(of * len(ids) + doc[row], return_index=True, return_inverse=True)
            tf = np.bincount(same, tf).astype(np.int32)
            of, row, length = of[head], row[head], length[head]
        # longer fields first count less, whatever the average is
        order = np.lexsort((doc[row], -(tf / (tf + 0.01 * length)), of))
        of, row, tf, length = of[order], row[order], tf[order], length[order]
        head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        within = np.arange(len(of)) - np.repeat(head, np.diff(np.append(head, len(of))))
        begin = np.flatnonzero(within % BLOCK == 0)
        offsets = pa.array(np.append(begin, len(of)).astype(np.int32))
        arrow = to_arrow_schema(schema)
        listed = lambda values, kind: pa.ListArray.from_arrays(offsets, pa.array(values, kind))
        columns = [
            pa.array(np.full(len(begin), table.column("shard")[0].as_py(), np.int32)), pa.array(fields).take(pa.array(of[begin] % len(fields))), terms.dictionary.take(pa.array(by_name[of[begin] // len(fields)])), pa.array((within[begin] // BLOCK).astype(np.int32)),
            listed(ids[doc[row]], pa.int64()), listed(tf, pa.int32()), listed(length, pa.int32()), listed(test[row], pa.bool_()),
            pa.array(np.maximum.reduceat(tf, begin)), pa.array(np.minimum.reduceat(length, begin).astype(np.int32)),
        ]
        out = pa.Table.from_arrays([c.cast(kind) for c, kind in zip(columns, arrow.types, strict=True)], schema=arrow)
        return pa.Table.from_batches(out.to_batches(SENT_BLOCKS), arrow)

    return run


def stored(reader: segments.Reader, table: str = "postings") -> tuple[DataFrame, DataFrame | None]:
    """(blocks with their segment's number, documents taken out: (segment, shard, id) or None) of a generation."""
    m, out, number = reader.manifest, None, {}
    for k, (name, _) in enumerate(m["tables"][table]):
        number[name] = k
        part = reader.spark.read.parquet(reader.at(name, table)).withColumn("segment", F.lit(k))
        out = part if out is None else out.unionByName(part)
    kept = dict(m["tables"]["docs"])
    gone = {s: n for s, n in m["dead"].get("docs", {}).items() if n and s in number}
    if not gone:
        return out, None
    dead = reader.dead("docs").where(F.col("segment").isin(list(gone)))
    of = lambda values: F.create_map(*(F.lit(x) for s in gone for x in (s, values[s])))[F.col("segment")]
    return out, dead.select(of(number).alias("segment"), shard(F.col("key"), of({s: shards_of(kept[s]) for s in gone})).alias("shard"), F.col("key").alias("id"))


class _Asked:
    """A pass's queries: for each list, (field, term), who asks for it with which weight."""

    def __init__(self, rows: pa.Table, limit: int, averages: dict[str, float], floors: dict | None = None):
        self.limit, self.averages = limit, averages
        self.fields = sorted(averages)
        self.queries: dict = {}
        place = {f: k for k, f in enumerate(self.fields)}
        for q, intent, f, term, weight in zip(*(rows.column(c).to_pylist() for c in ("query_id", "intent", "field", "term", "weight")), strict=True):
            self.queries.setdefault(q, (intent, []))[1].append((place[f], (f, term), weight))
        self.floors = floors or {}


def _rounded(score: np.ndarray) -> np.ndarray:
    return np.floor(score * 1e6 + 0.5) / 1e6


def _scored(blocks: pa.Table, dead: np.ndarray, asked: _Asked, first_only: bool) -> tuple[list, list, list]:
    """(query, id, score) of a shard's best for each query."""
    blocks = blocks.sort_by([("field", "ascending"), ("term", "ascending"), ("block", "ascending")])
    flat = {c: blocks.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("ids", "tfs", "lengths", "tests")}
    sizes = blocks.column("ids").combine_chunks().value_lengths().to_numpy()
    docs, at = np.unique(flat["ids"], return_inverse=True)
    test = np.zeros(len(docs), bool)
    test[at] = flat["tests"].astype(bool)
    alive = ~np.isin(docs, dead)
    fields, terms = blocks.column("field").to_pylist(), blocks.column("term").to_pylist()
    average = np.repeat(np.array([asked.averages[f] for f in fields], float), sizes)
    tf = flat["tfs"].astype(float)
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * flat["lengths"] / average))
    begin = np.cumsum(sizes) - sizes
    most = np.maximum.reduceat(part, begin)
    lists: dict[tuple[str, str], list[int]] = {}
    for k, key in enumerate(zip(fields, terms, strict=True)):
        lists.setdefault(key, []).append(k)
    # blocks go by impact as it was when they were cut: the bound of a block is that of all from it on
    bounds = {key: np.maximum.accumulate(most[ks][::-1])[::-1] for key, ks in lists.items()}
    out: tuple[list, list, list] = ([], [], [])
    sums = np.zeros((len(asked.fields), len(docs)))

    def add(f: int, k: int, weight: float) -> None:
        s = slice(begin[k], begin[k] + sizes[k])
        sums[f, at[s]] += weight * part[s]

    for q, (intent, wanted) in asked.queries.items():
        mine = [(f, key, w) for f, key, w in wanted if key in lists]
        if not mine:
            continue
        sums[:] = 0
        allowed = alive if intent else alive & ~test
        whole = np.zeros(len(asked.fields))
        for f, key, w in mine:
            add(f, lists[key][0], w)
            whole[f] += w * bounds[key][0]
        if not first_only and any(len(lists[key]) > 1 for _, key, _ in mine):
            best = np.where(allowed, sums.max(axis=0), 0)
            floor = max(asked.floors.get(q, 0.0), float(np.partition(best, -asked.limit)[-asked.limit]) if len(best) > asked.limit else 0.0) - MARGIN
            for f, key, w in mine:
                for k, bound in zip(lists[key][1:], bounds[key][1:], strict=True):
                    if w * bound + whole[f] - w * bounds[key][0] < floor:
                        break
                    add(f, k, w)
        score = _rounded(np.where(allowed, sums.max(axis=0), 0))
        found = np.flatnonzero(score > 0)
        if len(found) > asked.limit:
            least = np.partition(score[found], -asked.limit)[-asked.limit]
            found = found[score[found] >= least]
            found = found[np.lexsort((docs[found], -score[found]))[: asked.limit]]
        out[0].extend([q] * len(found))
        out[1].append(docs[found])
        out[2].append(score[found])
    return out


def _best(blocks: DataFrame, dead: DataFrame | None, asked: _Asked, query_type: T.DataType, first_only: bool = False) -> DataFrame:
    """(query_id, id, score): each shard's best."""
    told = blocks.sparkSession.sparkContext.broadcast(asked)
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])

    def scored(points: pa.Table, gone: np.ndarray) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        q, ids, score = _scored(points, gone, told.value, first_only) if len(points) else ([], [], [])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        arrow = to_arrow_schema(schema)
        return pa.Table.from_arrays([pa.array(q, arrow.field(0).type), join(ids, pa.int64()), join(score, pa.float64())], schema=arrow)

    if dead is None:
        return blocks.groupBy("segment", "shard").applyInArrow(lambda points: scored(points, np.zeros(0, np.int64)), schema)

    def both(points: pa.Table, gone: pa.Table) -> pa.Table:
        return scored(points, gone.column("id").to_numpy())

    return blocks.groupBy("segment", "shard").cogroup(dead.groupBy("segment", "shard")).applyInArrow(both, schema)


def about(stats: DataFrame) -> dict[str, tuple[int, float]]:
    """(documents, mean length) of each field."""
    return {r["field"]: (r["n_docs"], r["avg_length"]) for r in stats.collect()}


def terms_of(queries: DataFrame) -> DataFrame:
    """(query_id, term, times, intent) of queries (query_id, query, intent)."""
    return lexical.query_terms(queries).join(queries.select("query_id", "intent"), "query_id")


def search(blocks: DataFrame, dead: DataFrame | None, stats: DataFrame, frequencies: DataFrame, queries: DataFrame, limit: int, boosts: dict[str, float] = BOOSTS, many: int = MANY_POSTINGS, pass_rows: int = PASS_ROWS) -> DataFrame:
    """(query_id, id, score, rank) of queries (query_id, query, intent): without intent documents that are tests are no answers, but count in the statistics.

    stats: (field, n_docs, avg_length), a row a field; frequencies: (field, term, df). Many queries go in passes.
    """
    fields, terms = about(stats), terms_of(queries)
    held = terms.limit(pass_rows // len(boosts) + 1).toArrow()
    if len(held) * len(boosts) <= pass_rows:
        return one_pass(blocks, dead, fields, frequencies, held, limit, queries.schema["query_id"].dataType, boosts, many)
    passes, out = -(-terms.count() * len(boosts) // pass_rows), None
    for k in range(passes):
        own = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k).toArrow()  # about ``pass_rows``
        best = one_pass(blocks, dead, fields, frequencies, own, limit, queries.schema["query_id"].dataType, boosts, many)
        out = best if out is None else out.unionByName(best)
    return out


def one_pass(blocks: DataFrame, dead: DataFrame | None, fields: dict[str, tuple[int, float]], frequencies: DataFrame, terms: pa.Table, limit: int, kind: T.DataType, boosts: dict[str, float] = BOOSTS, many: int = MANY_POSTINGS) -> DataFrame:
    """The same for the terms (``terms_of``) of so few queries that they are told to all shards."""
    if limit < 1:
        raise ValueError("a search has at least one answer")
    fields = {f: v for f, v in fields.items() if f in boosts}
    names = sorted(set(terms.column("term").to_pylist()))
    df = among(frequencies, names).toArrow()
    per = {(f, t): c for f, t, c in zip(*(df.column(c).to_pylist() for c in ("field", "term", "df")), strict=True) if f in fields}
    asked = []
    for q, term, times, intent in zip(*(terms.column(c).to_pylist() for c in ("query_id", "term", "times", "intent")), strict=True):
        for f, (docs, _) in fields.items():
            if c := per.get((f, term)):
                asked.append((q, intent, f, term, boosts[f] * times * float(np.log(1 + (docs - c + 0.5) / (c + 0.5)))))
    table = pa.table(dict(zip(("query_id", "intent", "field", "term", "weight"), map(list, zip(*asked, strict=True)) if asked else [[]] * 5, strict=True)))
    averages = {f: a for f, (_, a) in fields.items()}
    points, floors = among(blocks, names), {}
    if sum(per.values()) >= many:
        begun = lexical.top(_best(points.where("block = 0"), dead, _Asked(table, limit, averages), kind, True), limit)
        # a row a query that has as many answers as asked for
        floors = {r["query_id"]: r["score"] for r in begun.where(F.col("rank") == limit).collect()}
        points = _reaching(points, asked, averages, floors)
    return lexical.top(_best(points, dead, _Asked(table, limit, averages, floors), kind), limit)


def among(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows of these terms, which are no more than a pass has: as a list, which the scan's row groups are chosen by, or joined."""
    if len(names) <= LISTED_TERMS:
        return rows.where(F.col("term").isin(names))
    told = rows.sparkSession.createDataFrame(pa.table({"term": names}))
    return rows.join(F.broadcast(told), "term", "left_semi")


def _reaching(points: DataFrame, asked_rows: list[tuple], averages: dict[str, float], floors: dict) -> DataFrame:
    """The blocks that, by their bounds, can reach the floor of any query that asks for them."""
    spark = points.sparkSession
    rows = spark.createDataFrame([(f, t, w, str(q), float(floors.get(q, 0.0)) - MARGIN) for q, _, f, t, w in asked_rows], "field string, term string, weight double, q string, floor double")
    average = F.create_map(*(F.lit(x) for pair in averages.items() for x in pair))
    bound = lambda tf, length: tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average[F.col("field")]))
    most = points.groupBy("field", "term").agg(F.max(bound(F.col("max_tf"), F.col("min_length"))).alias("most"))
    sums = rows.join(most, ["field", "term"])
    others = sums.groupBy("q", "field").agg(F.sum(F.col("weight") * F.col("most")).alias("all"))
    # what a block's bound must reach so that it matters to some query
    need = sums.join(others, ["q", "field"]).select("field", "term", ((F.col("floor") - F.col("all")) / F.col("weight") + F.col("most")).alias("need")).groupBy("field", "term").agg(F.min("need").alias("need"))
    # a row a field and term that is asked for, at most those of a pass
    return points.join(F.broadcast(need), ["field", "term"]).where(bound(F.col("max_tf"), F.col("min_length")) >= F.col("need") - 1e-9).drop("need")
