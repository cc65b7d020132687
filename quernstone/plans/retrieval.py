"""Queries of the retrieval operators over the corpus tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import analyse
from ..operators import evaluation, fusion, lexical, semantic
from ..operators.shared import kept
from .registry import query

QUERIES = ((1, "all rights reserved license"), (2, "und der erst test"), (3, "que el la ciónas"), (4, "released under the mit license"), (5, "the thion enti of and"))
_ROWS = ", ".join(f"({k}, '{q}')" for k, q in QUERIES)
_WORD = "'[\\p{L}\\p{N}_]+'"


def symbols(t):
    """Documents as search documents: name, qualified name, path and code from their columns."""
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return t.documents.select("doc_id", F.col("source").alias("name"), first.alias("qualified_name"), F.concat_ws("/", "lang", "source").alias("path"), F.col("text").alias("code"), F.lower("text").contains("test").alias("is_test"))


def batch(t):
    q = t.spark.createDataFrame(list(QUERIES), "query_id int, query string").select(F.col("query_id").cast("int"), "query")
    return q.withColumn("intent", F.lower("query").contains("test"))


_SYMS = "SELECT doc_id, source AS name, split_part(text, chr(10), 1) AS qualified_name, lang || '/' || source AS path, text AS code, contains(lower(text), 'test') AS is_test FROM documents"


def bm25_sql(boosts: dict[str, float], limit: int | None, filtered: bool = False) -> str:
    """CTEs ending in ``bm`` (query_id, id, score, rank)."""
    fields = " UNION ALL ".join(f"SELECT doc_id AS id, '{f}' AS field, {b} AS boost, regexp_extract_all(lower({f}), {_WORD}) AS tokens FROM syms" for f, b in boosts.items())
    keep = "JOIN syms ON syms.doc_id = s.id JOIN q ON q.query_id = s.query_id WHERE NOT is_test OR contains(lower(q.query), 'test')" if filtered else ""
    return f"""syms AS ({_SYMS}), q(query_id, query) AS (VALUES {_ROWS}),
    f AS (SELECT * FROM ({fields}) WHERE len(tokens) > 0), st AS (SELECT field, count(*) AS n, avg(len(tokens)) AS al FROM f GROUP BY field),
    qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), {_WORD})) AS term FROM q) GROUP BY ALL),
    tf AS (SELECT id, field, boost, len(tokens) AS len, term, count(*) AS tf FROM (SELECT id, field, boost, tokens, unnest(tokens) AS term FROM f) WHERE term IN (SELECT term FROM qt) GROUP BY id, field, boost, tokens, term),
    df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
    s0 AS (SELECT query_id, id, field, boost * sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))) AS score FROM tf JOIN df USING (field, term) JOIN st USING (field) JOIN qt USING (term) GROUP BY query_id, id, field, boost),
    s1 AS (SELECT query_id, id, round(max(score), 6) AS score FROM s0 GROUP BY query_id, id), s AS (SELECT s.* FROM s1 s {keep}),
    bm AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) {f"WHERE rank <= {limit}" if limit else ""})"""


def _lexical(t, limit, boosts=None, filtered=False):
    more = {"is_test": "is_test", "intent": "intent"} if filtered else {}
    return lexical.search(symbols(t), batch(t), limit, boosts or lexical.BOOSTS, "doc_id", **more).withColumn("rank", F.col("rank").cast("long"))


@query("r1_bm25", f"WITH {bm25_sql({'code': 1.0}, 10)} SELECT * FROM bm")
def r1_bm25(t):
    return _lexical(t, 10, {"code": 1.0})


@query("r1_bm25_multifield", f"WITH {bm25_sql(lexical.BOOSTS, 10)} SELECT * FROM bm")
def r1_bm25_multifield(t):
    return _lexical(t, 10)


@query("r1_bm25_filtered", f"WITH {bm25_sql(lexical.BOOSTS, 10, True)} SELECT * FROM bm")
def r1_bm25_filtered(t):
    return _lexical(t, 10, filtered=True)


def knn_sql(limit: int, filtered: bool = False) -> str:
    """CTEs ending in ``kn`` (query_id, id, score, rank); query k is vector 10 k."""
    keep = "AND (qv.intent OR NOT contains(lower(d.text), 'test'))" if filtered else ""
    return f"""qv AS (SELECT CAST(vec_id // 10 AS INTEGER) AS query_id, embedding AS q, vec_id = 20 AS intent FROM embeddings WHERE vec_id IN (10, 20, 30, 40, 50)),
    sc AS (SELECT query_id, vec_id AS id, round((1 + list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[])) / 2, 6) AS score FROM embeddings JOIN documents d ON d.doc_id = vec_id, qv WHERE true {keep}),
    kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= {limit})"""


def _semantic(t, limit, filtered=False):
    q = t.embeddings.where(F.col("vec_id").isin(10, 20, 30, 40, 50)).select(F.expr("CAST(vec_id DIV 10 AS INT)").alias("query_id"), "embedding", (F.col("vec_id") == 20).alias("intent"))
    docs = t.documents.select(F.col("doc_id").alias("vec_id"), F.lower("text").contains("test").alias("is_test"))
    vectors = t.embeddings.join(docs, "vec_id")
    return semantic.search(vectors, q, limit, 64, "vec_id", filtered="is_test" if filtered else None).withColumn("rank", F.col("rank").cast("long"))


@query("r2_knn", f"WITH {knn_sql(10)} SELECT * FROM kn")
def r2_knn(t):
    return _semantic(t, 10)


@query("r2_knn_filtered", f"WITH {knn_sql(10, True)} SELECT * FROM kn")
def r2_knn_filtered(t):
    return _semantic(t, 10, True)


def _norm_sql(name: str) -> str:
    return f"(SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM {name} WINDOW w AS (PARTITION BY query_id))"


def fused_sql(weight: str = "0.6") -> str:
    """CTEs ending in ``fu``: both branches at a depth of 40, fused."""
    return f"""{bm25_sql(lexical.BOOSTS, 40, True)}, {knn_sql(40, True)},
    mg AS (SELECT coalesce(b.query_id, k.query_id) AS query_id, coalesce(b.id, k.id) AS id, coalesce(b.norm, 0.0) AS bm25_score, coalesce(k.norm, 0.0) AS semantic_score, b.rank AS bm25_rank, k.rank AS semantic_rank FROM {_norm_sql("bm")} b FULL OUTER JOIN {_norm_sql("kn")} k ON b.query_id = k.query_id AND b.id = k.id),
    fs AS (SELECT *, round({weight} * semantic_score + (1 - {weight}) * bm25_score, 8) AS score FROM mg),
    fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(bm25_rank, 1000000 + semantic_rank)) AS rank FROM fs)"""


def branches(t):
    return fusion.normalised(_lexical(t, fusion.depth(10), filtered=True)), fusion.normalised(_semantic(t, fusion.depth(10), True))


def fused(t, weight=0.6):
    return fusion.fuse(*branches(t), ["id"], weight).withColumn("rank", F.col("rank").cast("long"))


@query("r4_hybrid", f"WITH {fused_sql()} SELECT query_id, id, score, round(bm25_score, 6) AS bm25_score, round(semantic_score, 6) AS semantic_score, bm25_rank, semantic_rank, rank FROM fu WHERE rank <= 10")
def r4_hybrid(t):
    return fused(t).where("rank <= 10").select("query_id", "id", "score", F.round("bm25_score", 6).alias("bm25_score"), F.round("semantic_score", 6).alias("semantic_score"), "bm25_rank", "semantic_rank", "rank")


_OVERLAP = f"round(len(list_intersect(list_distinct(regexp_extract_all(lower(q.query), {_WORD})), list_distinct(regexp_extract_all(lower(d.text), {_WORD})))) / len(list_distinct(regexp_extract_all(lower(q.query), {_WORD}))), 6)"


@query("r6_rerank_overlap", f"WITH {fused_sql()}, rr AS (SELECT fu.query_id, fu.id, fu.rank, {_OVERLAP} AS reranker_score FROM fu JOIN q ON q.query_id = fu.query_id JOIN documents d ON d.doc_id = fu.id WHERE fu.rank <= 30) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, rank) AS final_rank FROM rr) WHERE final_rank <= 10")
def r6_rerank_overlap(t):
    rows = fused(t).where(F.col("rank") <= fusion.rerank_depth(10)).select("query_id", "id", "rank").join(batch(t).select("query_id", "query"), "query_id").join(t.documents.select(F.col("doc_id").alias("id"), "text"), "id")
    out = fusion.rerank(rows, fusion.overlap_score(F.col("query"), F.col("text")), 10)
    return out.select("query_id", "id", "rank", "reranker_score", F.col("final_rank").cast("long").alias("final_rank"))


@query("r10_diagnosis", f"WITH {fused_sql()} SELECT query_id, min(bm25_rank) AS bm25_rank, min(semantic_rank) AS semantic_rank, min(rank) AS hybrid_rank FROM fu WHERE id % 10 = query_id GROUP BY query_id HAVING min(rank) > 1")
def r10_diagnosis(t):
    """Queries whose expected documents (here: by id) the hybrid search has, but not at its top, with their ranks in each branch."""
    b, s = branches(t)
    found = {"bm25": b, "semantic": s, "hybrid": fusion.fuse(b, s, ["id"], 0.6)}
    named = {name: df.select("query_id", (F.col("id") % 10).cast("int").alias("expected"), F.col("rank").cast("long").alias("rank")) for name, df in found.items()}
    cases = batch(t).select("query_id", F.col("query_id").alias("expected"))
    return evaluation.diagnosis(named, cases, ["expected"], 10_000, 1).where("hybrid_rank IS NOT NULL").drop("expected")


_EXPECTED = "id % 10 = query_id"
_WEIGHTS = ", ".join(f"({w})" for w in evaluation.WEIGHTS)
_M = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}" for k in evaluation.DEPTHS) + ", round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr, count(*) AS cases"


@query(
    "e4_weight_sweep",
    f"""WITH {fused_sql()}, ws(weight) AS (VALUES {_WEIGHTS}), sw AS (SELECT query_id, id, weight, row_number() OVER (PARTITION BY query_id, weight ORDER BY round(weight * semantic_score + (1 - weight) * bm25_score, 8) DESC, coalesce(bm25_rank, 1000000 + semantic_rank)) AS rank FROM mg, ws),
    rk AS (SELECT q.query_id, ws.weight, min(rank) AS rank FROM q CROSS JOIN ws LEFT JOIN sw ON sw.query_id = q.query_id AND sw.weight = ws.weight AND {_EXPECTED.replace("query_id", "q.query_id")} AND rank <= 10 GROUP BY ALL)
    SELECT CAST(weight AS DOUBLE) AS weight, {_M} FROM rk GROUP BY weight""",
)
def e4_weight_sweep(t):
    """Retrieve once, fuse once a weight: the weights are a constant of eleven rows."""
    weights = t.spark.createDataFrame([(w,) for w in evaluation.WEIGHTS], "weight double")
    swept = fusion.fuse(*branches(t), ["id"], weights, by=["weight"])
    hits = swept.where(_EXPECTED).where("rank <= 10").groupBy("query_id", "weight").agg(F.min("rank").alias("rank"))
    cases = batch(t).select("query_id").crossJoin(F.broadcast(weights))
    return evaluation.metrics(cases.join(hits, ["query_id", "weight"], "left"), "weight")


_SWEPT = f"""{fused_sql()}, ws(weight) AS (VALUES {_WEIGHTS}), sw AS (SELECT query_id, id, weight, row_number() OVER (PARTITION BY query_id, weight ORDER BY round(weight * semantic_score + (1 - weight) * bm25_score, 8) DESC, coalesce(bm25_rank, 1000000 + semantic_rank)) AS rank FROM mg, ws),
    rk AS (SELECT q.query_id, ws.weight, min(rank) AS rank FROM q CROSS JOIN ws LEFT JOIN sw ON sw.query_id = q.query_id AND sw.weight = ws.weight AND {_EXPECTED.replace("query_id", "q.query_id")} AND rank <= 10 GROUP BY ALL),
    me AS (SELECT CAST(weight AS DOUBLE) AS weight, {_M} FROM rk GROUP BY weight)"""


@query("e3_recommended_weight", f"WITH {_SWEPT} SELECT * FROM me ORDER BY recall_10 = 1 DESC, CASE WHEN recall_10 = 1 THEN 0 ELSE recall_10 END DESC, mrr DESC, CASE WHEN recall_10 = 1 THEN recall_1 ELSE 0 END DESC, CASE WHEN recall_10 = 1 THEN recall_3 ELSE 0 END DESC, weight LIMIT 1")
def e3_recommended_weight(t):
    """The weight that a set of cases recommends, of all that are tried."""
    return evaluation.best_weight(e4_weight_sweep(t))


_RERANKED = f"""rr AS (SELECT fu.query_id, fu.id, fu.rank AS place, {_OVERLAP} AS reranker_score FROM fu JOIN q ON q.query_id = fu.query_id JOIN documents d ON d.doc_id = fu.id WHERE fu.rank <= 30),
    rf AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, place) AS rank FROM rr)"""


@query(
    "e2_method_pivot",
    f"""WITH {fused_sql()}, {_RERANKED}, al AS (SELECT 'bm25' AS method, query_id, id, rank FROM bm UNION ALL SELECT 'semantic', query_id, id, rank FROM kn UNION ALL SELECT 'hybrid', query_id, id, rank FROM fu UNION ALL SELECT 'reranked', query_id, id, rank FROM rf),
    rk AS (SELECT m.method, q.query_id, min(rank) AS rank FROM q CROSS JOIN (VALUES ('bm25'), ('semantic'), ('hybrid'), ('reranked')) m(method) LEFT JOIN al ON al.method = m.method AND al.query_id = q.query_id AND {_EXPECTED.replace("query_id", "q.query_id")} AND rank <= 10 GROUP BY ALL)
    SELECT method, {_M} FROM rk GROUP BY method""",
)
def e2_method_pivot(t):
    b, s = branches(t)
    hybrid = fusion.fuse(b, s, ["id"], 0.6)
    asked = hybrid.where(F.col("rank") <= fusion.rerank_depth(10)).select("query_id", "id", "rank").join(batch(t).select("query_id", "query"), "query_id").join(t.documents.select(F.col("doc_id").alias("id"), "text"), "id")
    again = fusion.rerank(asked, fusion.overlap_score(F.col("query"), F.col("text")), 10).select("query_id", "id", F.col("final_rank").alias("rank"))
    cases = batch(t).select("query_id", F.col("query_id").alias("expected"))
    found = {}
    for name, df in (("bm25", b), ("semantic", s), ("hybrid", hybrid), ("reranked", again)):
        found[name] = df.where("rank <= 10").select("query_id", (F.col("id") % 10).cast("int").alias("expected"), F.col("rank").cast("long").alias("rank"))
    return evaluation.by_method(found, cases, ["expected"])


@query("t2_stable_sort", f"WITH {fused_sql()} SELECT query_id, id, rank FROM fu")
def t2_stable_sort(t):
    return fused(t).select("query_id", "id", "rank")


@query(
    "r7_hashed_embedding",
    f"""WITH w AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % 64 AS INTEGER) AS slot, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {_WORD})) AS x FROM documents) GROUP BY ALL)
    SELECT doc_id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM w""",
)
def r7_hashed_embedding(t):
    """The engine's own embedder, slot by slot."""
    from .engine import hashing_embedder

    slots = t.documents.select("doc_id", F.posexplode(hashing_embedder(64, "double")(F.col("text"))).alias("slot", "value")).where("value > 0")
    return slots.select("doc_id", "slot", F.round("value", 6).alias("value"))


@query("s5_postings", f"SELECT 'text' AS field, term, id, count(*) AS tf, length FROM (SELECT doc_id AS id, CAST(len(regexp_extract_all(lower(text), {_WORD})) AS INTEGER) AS length, unnest(regexp_extract_all(lower(text), {_WORD})) AS term FROM documents) GROUP BY ALL")
def s5_postings(t):
    return lexical.document_postings(t.documents, ["text"], "doc_id")


_KEY = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_CASES = f"""cases AS (SELECT item_id AS query_id, array_to_string({_KEY}, ' ') AS query, text FROM benchmark WHERE len({_KEY}) > 0),
    expected AS (SELECT query_id, min(doc_id) AS id FROM cases JOIN documents d ON contains(d.text, cases.text) GROUP BY query_id)"""


@query(
    "e1_evaluate",
    f"""WITH {bm25_sql({"code": 1.0}, 10).replace(f"q(query_id, query) AS (VALUES {_ROWS})", f"{_CASES}, q AS (SELECT c.query_id, query FROM cases c JOIN expected USING (query_id))")},
    rk AS (SELECT e.query_id, min(rank) AS rank FROM expected e LEFT JOIN bm ON bm.query_id = e.query_id AND bm.id = e.id GROUP BY e.query_id) SELECT {_M} FROM rk""",
)
def e1_evaluate(t):
    """Recall of lexical search: each benchmark item asked as a whole, against the first document that holds all of it.

    The documents that hold an item (``lexical.holders``) are found once and kept, as cases and queries both follow from them.
    """
    words = analyse(F.col("text"))
    cases = t.benchmark.select(F.col("item_id").alias("query_id"), F.concat_ws(" ", words).alias("query"), F.col("text").alias("item")).where("query <> ''")
    expected = lexical.holders(t.documents.select(F.col("doc_id").alias("id"), "text"), cases.select("query_id", "item")).groupBy("query_id").agg(F.min("id").alias("id"))
    expected = kept(expected, "expected")
    queries = cases.join(expected, "query_id").select("query_id", "query")
    hits = lexical.search(symbols(t), queries, 10, {"code": 1.0}, "doc_id")
    return evaluation.metrics(evaluation.first_rank(hits, expected, ["id"]))


@query("r5_default_hybrid", f"WITH {fused_sql('0.6')} SELECT query_id, id, score, rank FROM fu WHERE rank <= 5")
def r5_default_hybrid(t):
    return fused(t, fusion.DEFAULT_WEIGHT).where("rank <= 5").select("query_id", "id", "score", "rank")
