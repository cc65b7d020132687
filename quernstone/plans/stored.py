"""Queries through the engine's stores: segments, block postings, and commits of documents and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, lexical, quantised
from ..operators.generations import GenerationStore
from ..operators.metadata import Metadata
from ..operators.segments import Reader
from ..operators.shared import folder
from .registry import query
from .retrieval import batch, bm25_sql, knn_sql, symbols


def _store(t) -> GenerationStore:
    return GenerationStore(t.spark, folder(t.spark, "store"))


@query("r1_block_max", f"WITH {bm25_sql(lexical.BOOSTS, 10, True)} SELECT * FROM bm")
def r1_block_max(t):
    """The same answers as ``r1_bm25_filtered``, from blocks of postings that are pruned by their bounds."""
    docs, fields = symbols(t), list(lexical.BOOSTS)
    tokens = lexical.field_tokens(docs, fields, "doc_id")
    terms = lexical.query_terms(batch(t)).select("term").distinct()
    store = _store(t)
    name = store.publish({
        "postings": blocks.build(docs, docs.count(), fields, "doc_id"),
        "frequencies": lexical.document_frequencies(lexical.postings(tokens, terms, True)), "stats": lexical.field_totals(tokens),
    })
    points = store.read("postings", name).withColumn("segment", F.lit(0))
    best = blocks.search(points, None, lexical.stats_of(store.read("stats", name)), store.read("frequencies", name), batch(t), 10, many=0)
    return best.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("r2_quantised", f"WITH {knn_sql(10, True)} SELECT * FROM kn")
def r2_quantised(t):
    """The same answers as ``r2_knn_filtered``, from stored codes of 16 bytes and the full vectors of all that can be answers."""
    tests = t.documents.select(F.col("doc_id").alias("vec_id"), F.lower("text").contains("test").alias("is_test"))
    vectors = t.embeddings.join(tests, "vec_id").select(F.col("vec_id").alias("symbol_id"), "embedding", "is_test")
    book, store = quantised.fit(vectors, 64, 16), _store(t)
    store.publish({"codebook": quantised.codebook_rows(t.spark, book), "docs": vectors.repartitionByRange("symbol_id").sortWithinPartitions("symbol_id"), "codes": lambda own: quantised.encode(own("docs"), book, flag_col="is_test")})
    asked = t.embeddings.where(F.col("vec_id").isin(10, 20, 30, 40, 50)).select(F.expr("CAST(vec_id DIV 10 AS INT)").alias("query_id"), "embedding", (F.col("vec_id") == 20).alias("intent"))
    best = quantised.search(store.read("codes"), quantised.codebook_of(store.read("codebook")), store.read("docs"), asked, 10, flag_col="is_test")
    return best.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


_CHANGED = "o_orderkey % 50 = 0"


@query(
    "k2_segments",
    f"""SELECT o_orderkey AS symbol_id, o_custkey % 7 AS repository_id, CASE WHEN {_CHANGED} THEN 'fresh' ELSE o_orderpriority END AS path, CASE WHEN {_CHANGED} THEN o_totalprice + 1 ELSE o_totalprice END AS price
    FROM orders WHERE o_orderkey % 50 <> 1 UNION ALL SELECT o_orderkey + 100000000, 8, 'added', o_totalprice FROM orders WHERE o_orderkey % 100 = 3""",
)
def k2_segments(t):
    """Three commits onto a store of orders: rows replaced by key, rows taken out, rows added; then a merger of the segments."""
    rows = t.orders.select(F.col("o_orderkey").alias("symbol_id"), (F.col("o_custkey") % 7).alias("repository_id"), F.col("o_orderpriority").alias("path"), F.col("o_totalprice").alias("price"))
    store, keys = _store(t), ("segment", F.col("symbol_id").alias("key"))
    store.publish({"docs": rows})
    fresh = rows.where("symbol_id % 50 = 0").withColumns({"path": F.lit("fresh"), "price": F.col("price") + 1})
    located = lambda: store.reader().located("docs")
    store.publish({"docs": fresh}, appended=["docs"], dead={"docs": located().join(fresh.select("symbol_id"), "symbol_id", "left_semi").select(*keys)})
    store.publish({}, dead={"docs": located().where("symbol_id % 50 = 1").select(*keys)})
    added = rows.where("symbol_id % 100 = 3").withColumns({"symbol_id": F.col("symbol_id") + 100_000_000, "repository_id": F.lit(8).cast(rows.schema["repository_id"].dataType), "path": F.lit("added")})
    last = store.publish({"docs": added}, appended=["docs"])
    reader: Reader = store.reader()
    small = [s for s, n in reader.manifest["tables"]["docs"] if n < rows.count()]
    store.publish({"docs": reader.rows("docs", small)}, merged=small, dead={"docs": dead} if (dead := reader.dead_elsewhere("docs", small)) is not None else None)
    assert last in small
    return store.read("docs").select("symbol_id", "repository_id", "path", "price")


_FATE = "CASE doc_id % 6 WHEN 0 THEN 'M' WHEN 1 THEN 'D' WHEN 2 THEN 'R' ELSE '' END"


@query(
    "c3_metadata_commit",
    f"""WITH f AS (SELECT doc_id, 'd/' || doc_id || '.py' AS path, md5(text) AS h, {_FATE} AS fate FROM documents WHERE text IS NOT NULL)
    SELECT CASE WHEN fate = 'R' THEN 'e/' || doc_id || '.py' ELSE path END AS path, CASE WHEN fate = 'M' THEN md5(h) ELSE h END AS content_hash, CASE WHEN fate = '' THEN 'c0' ELSE 'c1' END AS last_indexed_commit,
    CASE WHEN fate = '' THEN 'old' WHEN fate = 'M' THEN 'fresh' ELSE 'moved' END AS symbol, 'c1' AS head FROM f WHERE fate <> 'D'""",
)
def c3_metadata_commit(t):
    """Documents as files of a repository, of which some change, go and move in one commit: each file with its hash, its commit and its symbol, and the commit that the repository is at."""
    texts = t.documents.where("text IS NOT NULL").select("doc_id", F.concat(F.lit("d/"), "doc_id", F.lit(".py")).alias("path"), F.md5(F.col("text").cast("binary")).alias("h"), F.expr(_FATE).alias("fate"))
    metadata = Metadata(t.spark, "", _store(t))
    metadata.register("docs", "https://github.com/o/docs", "main", "c0", texts.select("path", F.lit("python").alias("language"), F.col("h").alias("content_hash")))
    files = metadata.read("files").select(F.col("id").alias("file_id"), F.lit("def old(): pass").alias("text"))
    from ..sources.symbols import symbols_of

    metadata.replace_symbols(1, symbols_of(files))
    moved = F.concat(F.lit("e/"), "doc_id", F.lit(".py"))
    changed = texts.where("fate <> ''")
    feed = changed.select(F.col("doc_id").cast("int").alias("ordinal"), F.col("fate").alias("status"), F.when(F.col("fate") == "R", F.col("path")).alias("old_path"), F.when(F.col("fate") == "R", moved).otherwise(F.col("path")).alias("path"))
    present = changed.where("fate <> 'D'").select(
        F.when(F.col("fate") == "R", moved).otherwise(F.col("path")).alias("path"), F.when(F.col("fate") == "M", F.md5(F.col("h").cast("binary"))).otherwise(F.col("h")).alias("content_hash"),
        F.when(F.col("fate") == "M", "def fresh(): pass").otherwise("def moved(): pass").alias("text"),
    )
    rows, dead, _ = metadata.merge(1, feed, present, "c1")
    metadata.add(rows, dead)
    found = metadata.read("files").join(metadata.read("symbols").select("file_id", F.col("name").alias("symbol")), F.col("id") == F.col("file_id"))
    head = metadata.read("repositories").select(F.col("id").alias("repository_id"), F.col("last_indexed_commit").alias("head"))
    return found.join(F.broadcast(head), "repository_id").select("path", "content_hash", "last_indexed_commit", "symbol", "head")
