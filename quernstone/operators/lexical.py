"""BM25 over several fields, for a batch of queries in one plan.

Postings are built once a generation and kept; a query batch reads only the postings of
its terms. Statistics cover all documents whatever is filtered afterwards. The score of a
document is the greatest of its fields' boosted scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.rank import rank_in
from ..functions.text import WORDS, analyse

BOOSTS = {"qualified_name": 5.0, "name": 4.0, "path": 2.0, "code": 1.0}
K1, B = 1.2, 0.75
#: Query terms up to this number are broadcast; a larger batch is joined by a shuffle on the term.
BROADCAST_TERMS = 200_000
#: From this number of queries on a batch is scored document by document, if its terms times its queries are no more cells (of 8 bytes, told to all tasks); documents times terms or queries at once.
WHOLE_QUERIES, WHOLE_CELLS, TILE_CELLS = 32, 4_000_000, 2_000_000
#: Documents that are counted at a time.
COUNTED_ROWS = 1000


def are_few(terms: DataFrame) -> bool:
    return terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS


def field_tokens(docs: DataFrame, fields: list[str], id_col: str = "symbol_id", pattern: str = WORDS) -> DataFrame:
    """(id, field, tokens) of the fields that a document has."""
    parts = F.array(*(F.struct(F.lit(f).alias("field"), analyse(F.col(f), pattern).alias("tokens")) for f in fields))
    rows = docs.select(F.col(id_col).alias("id"), F.explode(parts).alias("p"))
    return rows.select("id", "p.field", "p.tokens").where(F.size("tokens") > 0)


def postings(tokens: DataFrame, only: DataFrame | None = None, few: bool = False) -> DataFrame:
    """(field, term, id, tf, length); ``only``: a query batch's terms, whose postings alone are then built."""
    rows = tokens.select("field", "id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    if only is not None:
        only = only.select("term").distinct()
        rows = rows.join(F.broadcast(only) if few else only, "term", "left_semi")
    return rows.groupBy("field", "term", "id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def document_postings(docs: DataFrame, fields: list[str], id_col: str = "symbol_id", pattern: str = WORDS, by: tuple[str, ...] = ("field", "term", "id", "length")) -> DataFrame:
    """(field, term, id, tf, length) of whole documents, each counted by the task that reads it, so that no pair is shuffled.

    Only documents that share their id with another one are grouped, ``by`` these columns: as given, those of one length count as one document. Ids are looked at beforehand, without their texts.
    """
    again = docs.groupBy(F.col(id_col).alias("_again")).count().where("count > 1").select("_again")
    n = again.limit(BROADCAST_TERMS + 1).count()
    if not n:
        return _counted_rows(field_tokens(docs, fields, id_col, pattern))
    told, same = F.broadcast(again) if n <= BROADCAST_TERMS else again, docs[id_col].eqNullSafe(again["_again"])
    once, more = (_counted_rows(field_tokens(docs.join(told, same, how), fields, id_col, pattern)) for how in ("left_anti", "left_semi"))
    added = more.groupBy(*by).agg(F.sum("tf").alias("tf"), *(F.first(c).alias(c) for c in more.columns if c not in (*by, "tf")))
    return once.unionByName(added)


def field_stats(tokens: DataFrame) -> DataFrame:
    """(field, n_docs, avg_length)."""
    return tokens.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("avg_length"))


def field_totals(tokens: DataFrame) -> DataFrame:
    """(field, n_docs, length), which can be added up over parts of a corpus."""
    return tokens.groupBy("field").agg(F.count("*").alias("n_docs"), F.sum(F.size("tokens").cast("long")).alias("length"))


def stats_of(totals: DataFrame) -> DataFrame:
    """(field, n_docs, avg_length) of added-up totals."""
    return totals.select("field", "n_docs", (F.col("length") / F.col("n_docs")).alias("avg_length"))


def less(added: DataFrame, taken: DataFrame, *by: str) -> DataFrame:
    """Sums of what was added without those of what was taken out: differences by group, those of 0 left out."""
    measures = [c for c in added.columns if c not in by]
    minus = taken.withColumns({c: -F.col(c) for c in measures})
    out = added.unionByName(minus).groupBy(*by).agg(*(F.sum(c).alias(c) for c in measures))
    return out.where(" OR ".join(f"{c} <> 0" for c in measures))


def document_frequencies(post: DataFrame) -> DataFrame:
    """(field, term, df) of postings, to be stored beside them."""
    return post.groupBy("field", "term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, pattern: str = WORDS) -> DataFrame:
    """(query_id, term, times)."""
    return queries.select("query_id", F.explode(analyse(F.col("query"), pattern)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def score_batch(post: DataFrame, stats: DataFrame, terms: DataFrame, boosts: dict[str, float] = BOOSTS, few: bool | None = None, frequencies: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score) of all documents with a term in some field. ``few``: whether the terms may be broadcast, if that is known; ``frequencies``: the stored document frequencies."""
    few = are_few(terms) if few is None else few
    told = F.broadcast if few else (lambda x: x)
    hit = post.join(told(terms), "term")
    asked = told(terms.select("term").distinct())
    df = frequencies.join(asked, "term", "left_semi") if frequencies is not None else document_frequencies(post.join(asked, "term", "left_semi"))
    # few terms have few frequencies, a row a field each, so that no common term's postings are shuffled to meet its frequency; stats: a row a field
    rows = hit.join(told(df), ["field", "term"]).join(F.broadcast(stats), "field")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    boost = F.create_map(*(F.lit(x) for pair in boosts.items() for x in pair))[F.col("field")]
    fields = rows.groupBy("query_id", "id", "field").agg((F.sum(weight * F.col("times")) * F.first(boost)).alias("score"))
    return fields.groupBy("query_id", "id").agg(F.round(F.max("score"), 6).alias("score"))


def top(scores: DataFrame, limit: int | Column) -> DataFrame:
    """Best per query, ties to the smaller id, with their 1-based rank."""
    ranked = scores.withColumn("rank", rank_in("query_id", F.desc("score"), F.asc("id")))
    return ranked.where(F.col("rank") <= limit)


def search(docs: DataFrame, queries: DataFrame, limit: int, boosts: dict[str, float] = BOOSTS, id_col: str = "symbol_id", is_test: str | None = None, intent: str | None = None, pattern: str = WORDS) -> DataFrame:
    """(query_id, id, score, rank). ``is_test`` names a column of docs, ``intent`` one of queries: without intent test documents are filtered, after scoring."""
    tokens = field_tokens(docs, list(boosts), id_col, pattern)
    terms = query_terms(queries, pattern)
    few = are_few(terms)
    if few and isinstance(docs.schema[id_col].dataType, T.IntegralType):
        asked = terms.toArrow()  # at most BROADCAST_TERMS rows
        n = pc.count_distinct(asked.column("query_id")).as_py()
        if n >= WHOLE_QUERIES and n * pc.count_distinct(asked.column("term")).as_py() <= WHOLE_CELLS:
            return _search_whole(docs, queries, asked, limit, boosts, id_col, is_test, intent, pattern)
    scores = score_batch(postings(tokens, terms, few), field_stats(tokens), terms, boosts, few)
    if is_test:
        flags = docs.select(F.col(id_col).alias("id"), F.col(is_test).alias("_test"))
        scores = scores.join(flags, "id").join(queries.select("query_id", F.col(intent).alias("_intent")), "query_id").where("_intent OR NOT _test").drop("_test", "_intent")
    return top(scores, limit)


def _counted(tokens: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times) of the terms that are found, and each row's number of tokens."""
    length = tokens.value_lengths().to_numpy()
    row, at = np.repeat(np.arange(len(length)), length), pc.index_in(tokens.flatten(), value_set=terms)
    known = at.is_valid().to_numpy(zero_copy_only=False)
    pairs, times = np.unique(row[known] * len(terms) + at.drop_null().to_numpy(), return_counts=True)
    return pairs // len(terms), pairs % len(terms), times, length


def _counted_rows(tokens: DataFrame) -> DataFrame:
    """(field, term, id, tf, length) of each row of (id, field, tokens) by itself."""
    schema = T.StructType([tokens.schema["field"], T.StructField("term", T.StringType()), tokens.schema["id"], T.StructField("tf", T.LongType()), T.StructField("length", T.IntegerType())])

    def count(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in (batch.slice(a, COUNTED_ROWS) for a in range(0, batch.num_rows, COUNTED_ROWS)):
                words = part.column("tokens")
                terms = pc.unique(words.flatten())
                row, term, tf, length = _counted(words, terms)
                at = pa.array(row)
                columns = (part.column("field").take(at), terms.take(pa.array(term)), part.column("id").take(at), pa.array(tf), pa.array(length[row]))
                yield pa.RecordBatch.from_arrays([c.cast(kind) for c, kind in zip(columns, arrow.types, strict=True)], schema=arrow)

    return tokens.select("id", "field", "tokens").mapInArrow(count, schema)


def _best_of(found: tuple[np.ndarray, np.ndarray, np.ndarray], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best of (query, id, score), ties to the smaller id, by query."""
    q, ids, score = found
    order = np.lexsort((ids, -score, q))
    q = q[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < limit
    return q[keep], ids[order][keep], score[order][keep]


def _search_whole(docs: DataFrame, queries: DataFrame, asked: pa.Table, limit: int, boosts: dict[str, float], id_col: str, is_test: str | None, intent: str | None, pattern: str) -> DataFrame:
    """The answers of ``search`` to a large batch: a task scores each of its documents for all queries at once and gives its best alone, so what is shuffled does not grow with queries times documents."""
    fields, spark = list(boosts), docs.sparkSession
    kind, id_kind = queries.schema["query_id"], T.StructField("id", docs.schema[id_col].dataType)
    names, words = pc.unique(asked.column("query_id").combine_chunks()), pc.unique(asked.column("term").combine_chunks())
    place = lambda values, among: pc.index_in(values.combine_chunks(), value_set=among).to_numpy()
    times = np.zeros((len(words), len(names)))
    times[place(asked.column("term"), words), place(asked.column("query_id"), names)] = asked.column("times").to_numpy()
    test = F.coalesce(F.col(is_test), F.lit(True)) if is_test else F.lit(False)
    rows = docs.select(F.col(id_col).alias("id"), test.alias("test"), *(analyse(F.col(f), pattern).alias(f"f{k}") for k, f in enumerate(fields)))
    terms = spark.sparkContext.broadcast(words)

    def count(batches):
        df, totals = np.zeros((len(fields), len(terms.value)), np.int64), np.zeros((len(fields), 2), np.int64)
        for batch in batches:
            for k in range(len(fields)):
                _, term, _, length = _counted(batch.column(2 + k), terms.value)
                df[k] += np.bincount(term, minlength=len(terms.value))
                totals[k] += (np.count_nonzero(length), length.sum())
        f, t = np.nonzero(df)
        # term -1: documents with the field, and its tokens
        cells = [np.concatenate(c) for c in ((f, np.arange(len(fields))), (t, np.full(len(fields), -1)), (df[f, t], totals[:, 0]), (np.zeros(len(f), np.int64), totals[:, 1]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cells, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["field", "term", "n", "length"])

    sums = rows.mapInArrow(count, "field int, term int, n long, length long").groupBy("field", "term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).toArrow()  # a row a field and term
    field, term, n, length = (sums.column(c).to_numpy() for c in ("field", "term", "n", "length"))
    whole = term < 0
    n_docs, average, idf = np.zeros(len(fields)), np.ones(len(fields)), np.zeros((len(fields), len(words)))
    n_docs[field[whole]] = n[whole]
    average[field[whole]] = length[whole] / np.maximum(n[whole], 1)
    idf[field[~whole], term[~whole]] = np.log(1 + (n_docs[field[~whole]] - n[~whole] + 0.5) / (n[~whole] + 0.5))
    eager = np.zeros(len(names), bool)
    if is_test:
        told = queries.select("query_id", F.coalesce(F.col(intent), F.lit(False)).alias("i")).join(spark.createDataFrame(pa.table({"query_id": names})), "query_id").toArrow()
        eager[place(told.column("query_id"), names)] = told.column("i").to_numpy()
    state = spark.sparkContext.broadcast((times, average, idf, eager, names))
    tile, schema = max(1, TILE_CELLS // max(len(words), len(names), 1)), T.StructType([kind, id_kind, T.StructField("score", T.DoubleType())])

    def score(batches):
        times, average, idf, eager, names = state.value
        best, floor = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.zeros(len(names))
        for batch in batches:
            for part in (batch.slice(a, tile) for a in range(0, batch.num_rows, tile)):
                most = np.zeros((part.num_rows, len(names)))
                for k, boost in enumerate(boosts.values()):
                    row, term, tf, length = _counted(part.column(2 + k), terms.value)
                    weight = np.zeros((part.num_rows, len(terms.value)))
                    weight[row, term] = idf[k, term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / average[k]))
                    np.maximum(most, boost * (weight @ times), out=most)
                tests = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                most[np.ix_(tests, ~eager)] = 0
                rounded = np.floor(most * 1e6 + 0.5) / 1e6
                r, q = np.nonzero((most > 0) & (rounded >= floor))
                best = _best_of(tuple(np.concatenate(c) for c in zip(best, (q, part.column(0).to_numpy()[r].astype(np.int64), rounded[r, q]), strict=True)), limit)
                full = np.bincount(best[0], minlength=len(names)) >= limit
                ends = np.searchsorted(best[0], np.arange(len(names)), "right") - 1
                floor[full] = best[2][ends[full]]
        arrow = to_arrow_schema(schema)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(best[0])).cast(arrow.field(0).type), pa.array(best[1]).cast(arrow.field(1).type), pa.array(best[2])], schema=arrow)

    return top(rows.mapInArrow(score, schema), limit)


#: Words of the runs by which texts that hold an item are looked for; characters of the items that one automaton holds.
HOLDS, AUTOMATON_CHARS = 4, 2_000_000


def holders(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, id): the texts (id, text) that hold an item (query_id, item) as a whole. An empty item is held by none.

    A text that holds an item holds the item's words but the first and the last one after another. So a run of ``HOLDS`` of these finds
    the texts to compare in full: of an item's runs the one that is rarest in the texts, where they have been counted. Items of too few words for that are looked for by automata,
    each of which passes once over the texts; so are all items, if one automaton holds them.
    """
    given = items.where(F.length("item") > 0)
    if (given.agg(F.sum(F.length("item"))).first()[0] or 0) <= AUTOMATON_CHARS:
        return _hold_short(texts, given.select("query_id", "item").toArrow(), items.schema["query_id"]).distinct()
    hashed = lambda w, k: F.xxhash64(*(F.get(w, k + i) for i in range(HOLDS)))
    rows = given.withColumn("w", F.split("item", " "))
    long = F.size("w") >= HOLDS + 2
    runs = rows.where(long).select("query_id", "item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - HOLDS - 1), lambda k: hashed(F.col("w"), k))).alias("h"))
    words = texts.withColumn("w", F.split("text", " ")).where(F.size("w") >= HOLDS)
    pieces = words.select("id", "text", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - HOLDS), lambda k: hashed(F.col("w"), k)))).alias("h"))
    asked = runs.select("h").distinct()
    told = F.broadcast(asked) if asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else asked
    counts = pieces.select("h").join(told, "h", "left_semi").groupBy("h").agg(F.count("*").alias("texts"))
    # a run that no text has counts 0: the item is held by none
    rarest = runs.join(counts, "h", "left").groupBy("query_id", "item").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "h")).alias("r"))
    keyed = rarest.where("r.texts > 0").select("query_id", "item", "r.h")
    few = keyed.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    found = pieces.join(F.broadcast(keyed) if few else keyed, "h").where(F.col("text").contains(F.col("item"))).select("query_id", "id")
    short = rows.where(~long).select("query_id", "item")
    blocks = -(-(short.agg(F.sum(F.length("item"))).first()[0] or 0) // AUTOMATON_CHARS)
    for k in range(blocks):
        found = found.unionByName(_hold_short(texts, short.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).toArrow(), short.schema["query_id"]))
    return found.distinct()


def _hold_short(texts: DataFrame, items: pa.Table, kind: T.StructField) -> DataFrame:
    """(query_id, id) for a bounded block of items: each task builds their automaton and reads its texts once."""
    told = texts.sparkSession.sparkContext.broadcast(list(zip(items.column("item").to_pylist(), items.column("query_id").to_pylist(), strict=True)))
    schema = T.StructType([kind, texts.schema["id"]])

    def run(batches):
        import ahocorasick

        asking: dict[str, list] = {}
        for item, query in told.value:
            asking.setdefault(item, []).append(query)
        automaton = ahocorasick.Automaton()
        for item in asking:
            automaton.add_word(item, item)
        if not asking:
            return
        automaton.make_automaton()
        arrow = to_arrow_schema(schema)
        for batch in batches:
            queries, ids = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for item in {item for _, item in automaton.iter(text or "")}:
                    queries += asking[item]
                    ids += [i] * len(asking[item])
            yield pa.RecordBatch.from_arrays([pa.array(queries, arrow.field(0).type), pa.array(ids, arrow.field(1).type)], schema=arrow)

    return texts.select("id", "text").mapInArrow(run, schema)
