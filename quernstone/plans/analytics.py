"""Queries of joins, aggregates, ranks and order statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rank import min_max, placed, zipped
from ..operators import cache, changes, evaluation, generations, lexical
from .registry import query


def _micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


@query("j1_two_way", "SELECT l_orderkey, l_linenumber, o_orderpriority, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 42")
def j1_two_way(t):
    return t.lineitem.join(t.orders.where("o_custkey = 42"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderpriority", "l_quantity")


@query(
    "j2_three_way",
    "SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderpriority",
)
def j2_three_way(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@query("j3_listing", "SELECT lang, source, doc_id FROM (SELECT lang, source, d.doc_id, row_number() OVER (PARTITION BY lang ORDER BY source, d.doc_id) AS k FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1) WHERE k <= 30")
def j3_listing(t):
    rows = t.documents.join(t.labels.where("quality = 1"), "doc_id")
    k = F.row_number().over(W.partitionBy("lang").orderBy("source", "doc_id"))
    return rows.withColumn("k", k).where("k <= 30").select("lang", "source", "doc_id")


@query(
    "j4_fusion_outer",
    "SELECT coalesce(a.u, b.u) AS user_id, round(coalesce(va, 0.0), 6) AS views, round(coalesce(vb, 0.0), 6) AS errors FROM (SELECT user_id AS u, avg(value) AS va FROM events WHERE event_type = 'view' AND user_id % 3 <> 0 GROUP BY 1) a FULL OUTER JOIN (SELECT user_id AS u, avg(value) AS vb FROM events WHERE event_type = 'error' AND user_id % 2 = 0 GROUP BY 1) b ON a.u = b.u",
)
def j4_fusion_outer(t):
    a = t.events.where("event_type = 'view' AND user_id % 3 <> 0").groupBy("user_id").agg(F.avg("value").alias("va"))
    b = t.events.where("event_type = 'error' AND user_id % 2 = 0").groupBy("user_id").agg(F.avg("value").alias("vb"))
    return a.join(b, "user_id", "full_outer").select("user_id", F.round(F.coalesce("va", F.lit(0.0)), 6).alias("views"), F.round(F.coalesce("vb", F.lit(0.0)), 6).alias("errors"))


@query("j5_positional_zip", "SELECT CAST(label AS INTEGER) AS label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place, vec_id, CAST(embedding[1] AS DOUBLE) AS score FROM embeddings")
def j5_positional_zip(t):
    """Rows and their scores, made apart and numbered alike."""
    order = F.row_number().over(W.partitionBy("label").orderBy("vec_id")).cast("long")
    numbered = t.embeddings.select(F.col("label").cast("int").alias("label"), "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("score"), order.alias("place"))
    return zipped(numbered.select("label", "place", "vec_id"), numbered.select("label", "place", "score"), ["label", "place"])


_J6 = "SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'none' ELSE 'src' || item_id % 25 END AS repository, CAST(item_id % 7 AS VARCHAR) AS expected FROM benchmark"


@query(
    "j6_ground_truth",
    f"""WITH cases AS ({_J6}), repos AS (SELECT DISTINCT source AS name FROM documents UNION ALL SELECT 'src3'), syms AS (SELECT DISTINCT source, CAST(doc_id % 5 AS VARCHAR) AS qn FROM documents),
    n AS (SELECT name, count(*) AS n FROM repos GROUP BY name)
    SELECT item_id, repository, expected, CASE WHEN n.n IS NULL THEN 'repository not found' WHEN n.n > 1 THEN 'ambiguous repository' WHEN qn IS NULL THEN 'symbol not found' ELSE 'valid' END AS outcome
    FROM cases LEFT JOIN n ON repository = name LEFT JOIN syms ON repository = source AND expected = qn""",
)
def j6_ground_truth(t):
    cases = t.benchmark.selectExpr("item_id", "CASE WHEN item_id % 5 = 0 THEN 'none' ELSE 'src' || item_id % 25 END AS repository", "CAST(item_id % 7 AS STRING) AS expected")
    names = t.documents.select(F.col("source").alias("name")).distinct()
    repositories = names.select("name", F.crc32("name").alias("id")).union(t.spark.createDataFrame([("src3", 1)], "name string, id long"))
    symbols = t.documents.select(F.crc32("source").alias("repository_id"), (F.col("doc_id") % 5).cast("string").alias("qualified_name"))
    return evaluation.check_cases(cases, repositories, symbols)


@query("j7_first_rank", "SELECT user_id, event_type, min(k) AS rank FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 10 GROUP BY user_id, event_type")
def j7_first_rank(t):
    """Each user's events are results, by value; each kind of event that a user has is a case."""
    k = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).cast("long")
    results = t.events.select(F.col("user_id").alias("query_id"), "event_type", k.alias("rank"))
    cases = t.events.select(F.col("user_id").alias("query_id"), "event_type", F.struct("user_id", "event_type").alias("case")).distinct()
    found = evaluation.first_rank(results, cases, ["event_type"], case="case").where("rank IS NOT NULL")
    return found.select("case.user_id", "case.event_type", "rank")


@query("j8_reconcile", "SELECT coalesce(a.s, b.s, c.s) AS index_name, a.n AS metadata, b.n AS audit, c.n AS journal FROM (SELECT source AS s, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY 1) a FULL OUTER JOIN (SELECT source AS s, count(*) AS n FROM documents WHERE n_chars > 9000 GROUP BY 1) b ON a.s = b.s FULL OUTER JOIN (SELECT 'src' || label AS s, count(*) AS n FROM embeddings GROUP BY 1) c ON coalesce(a.s, b.s) = c.s")
def j8_reconcile(t):
    n = lambda df, key, name: df.groupBy(key.alias("index_name")).agg(F.count("*").alias(name))
    return generations.reconcile(n(t.documents.where("lang = 'de'"), F.col("source"), "metadata"), n(t.documents.where("n_chars > 9000"), F.col("source"), "audit"), n(t.embeddings, F.concat(F.lit("src"), "label"), "journal"))


@query(
    "j9_positional_pair",
    """WITH f AS (SELECT event_id % 5 AS ms, row_number() OVER (ORDER BY ts, '10.1.0.9.' || (event_id + 20000)) - 1 AS k FROM events)
    SELECT 'fresh' AS connection, CAST(k // 100 + 1 AS INTEGER) AS block, count(*) AS flows, round(avg(ms + 2)::DOUBLE, 3) AS host_response_ms, round(avg(ms / 2 + 1)::DOUBLE, 3) AS inner_response_ms FROM f WHERE k % 100 >= 10 GROUP BY block""",
)
def j9_positional_pair(t):
    """Two captures of the same flows, with other addresses and clocks; the inner one answers in half the time."""
    from ..sources import traces

    at = F.unix_micros(F.col("ts").cast("timestamp"))

    def capture(address, between, shift, ms):
        client = F.concat(F.lit(f"{address}."), F.col("event_id") + 20000)
        line = lambda us, here, there, n: F.concat(F.format_string("%.6f", (at + shift + us) / 1e6), F.lit(f" {between} "), here, F.lit(" > "), there, F.lit(f": Flags [P.], seq 1, length {n}"))
        server = F.lit("10.1.0.2.9200")
        lines = t.events.select(F.explode(F.array(line(F.lit(0), client, server, 108), line(ms * 1000, server, client, 177))).alias("line"))
        return traces.checked(traces.measured(traces.packets(lines)), traces.Workload(9200, 108, 177), acks=False)

    late = F.col("event_id") % 5
    rows = traces.compared(capture("10.1.0.9", "IP", 0, late + 2), capture("172.18.0.3", "eth0  In  IP", 77_000_000, late / 2 + 1), 90, 10)
    return rows.select("connection", "block", "flows", "host_response_ms", "inner_response_ms")


@query("a1_count", "SELECT (SELECT count(*) FROM lineitem) AS lines, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS done")
def a1_count(t):
    return t.lineitem.agg(F.count("*").alias("lines")).crossJoin(t.orders.where("o_orderstatus = 'F'").agg(F.count("*").alias("done")))


@query("a2_minmax", "SELECT user_id, min(value) AS low, max(value) AS high FROM events GROUP BY user_id")
def a2_minmax(t):
    return t.events.groupBy("user_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))


_RANKS = "SELECT user_id, event_type, min(CASE WHEN value > 60 THEN k END) AS rank FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) GROUP BY user_id, event_type"


def ranks(t):
    k = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return t.events.withColumn("k", k).groupBy("user_id", "event_type").agg(F.min(F.when(F.col("value") > 60, F.col("k"))).alias("rank"))


_METRICS = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}" for k in evaluation.DEPTHS) + ", round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr, count(*) AS cases"


@query("a3_recall_mrr", f"SELECT event_type, {_METRICS} FROM ({_RANKS}) GROUP BY event_type")
def a3_recall_mrr(t):
    return evaluation.metrics(ranks(t), "event_type")


@query(
    "a5_latency_summary",
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(min(value), 6) AS low, round(max(value), 6) AS high,
    round(list_sort(list(value))[CAST(floor((count(*) - 1) * 0.5) AS BIGINT) + 1], 6) AS p50, round(list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1], 6) AS p95, round(list_sort(list(value))[CAST(floor((count(*) - 1) * 0.99) AS BIGINT) + 1], 6) AS p99 FROM events GROUP BY event_type""",
)
def a5_latency_summary(t):
    return evaluation.latency_summary(t.events, F.col("value"), "event_type")


@query("a6_floor_percentile", "SELECT user_id, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS p95 FROM events GROUP BY user_id")
def a6_floor_percentile(t):
    return evaluation.floor_percentiles(t.events, F.col("value"), {"p95": 0.95}, "user_id")


@query("a7_histogram", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a7_histogram(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("a8_hit_rate", "SELECT user_id, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type <> 'view') AS misses, round(100.0 * count(*) FILTER (event_type = 'view') / count(*), 6) AS hit_percent FROM events GROUP BY user_id")
def a8_hit_rate(t):
    hit = F.count(F.when(F.col("event_type") == "view", 1))
    return t.events.groupBy("user_id").agg(hit.alias("hits"), (F.count("*") - hit).alias("misses"), F.round(100.0 * hit / F.count("*"), 6).alias("hit_percent"))


@query("a9_distinct_pairs", "SELECT event_type, count(DISTINCT (user_id, CAST(floor(value / 10) AS BIGINT))) AS pairs FROM events GROUP BY event_type")
def a9_distinct_pairs(t):
    return t.events.groupBy("event_type").agg(F.countDistinct("user_id", F.floor(F.col("value") / 10)).alias("pairs"))


_SWEEP = f"SELECT event_id % 11 AS w, min(CASE WHEN value > 60 THEN k END) AS rank, user_id FROM (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id, event_id % 11 ORDER BY ts, event_id) AS k FROM events) GROUP BY event_id % 11, user_id"


@query(
    "a10_best_weight",
    f"""WITH s AS (SELECT round(CAST(0.5 + 0.05 * w AS DOUBLE), 2) AS weight, {_METRICS} FROM ({_SWEEP}) GROUP BY w)
    SELECT * FROM s ORDER BY (recall_10 = 1.0) DESC, CASE WHEN recall_10 = 1.0 THEN 0 ELSE recall_10 END DESC, mrr DESC, CASE WHEN recall_10 = 1.0 THEN recall_1 ELSE 0 END DESC, CASE WHEN recall_10 = 1.0 THEN recall_3 ELSE 0 END DESC, weight LIMIT 1""",
)
def a10_best_weight(t):
    w = F.col("event_id") % 11
    k = F.row_number().over(W.partitionBy("user_id", w).orderBy("ts", "event_id"))
    rows = t.events.withColumn("k", k).groupBy(w.alias("w"), "user_id").agg(F.min(F.when(F.col("value") > 60, F.col("k"))).alias("rank"))
    scores = evaluation.metrics(rows, "w").select(F.round(0.5 + 0.05 * F.col("w"), 2).alias("weight"), *(f"recall_{k}" for k in evaluation.DEPTHS), "mrr", "cases")
    return evaluation.best_weight(scores)


_A12 = "'class A:' || chr(10) || '    def m(self): pass' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'def f(): pass' ELSE '' END"


@query(
    "a12_parse_counts",
    "SELECT source AS repository, count(*) FILTER (lang = 'en' AND doc_id % 7 <> 0) AS parsed_files, count(*) FILTER (lang <> 'en' OR doc_id % 7 = 0) AS skipped_files, CAST(coalesce(sum(2 + (doc_id % 2 = 0)::INT) FILTER (lang = 'en' AND doc_id % 7 <> 0), 0) AS BIGINT) AS symbols_indexed FROM documents GROUP BY source",
)
def a12_parse_counts(t):
    from ..sources.symbols import parse_counts, symbols_of

    files = t.documents.select(F.col("doc_id").alias("file_id"), F.col("source").alias("repository"), F.when(F.col("lang") == "en", "python").otherwise("go").alias("language"), F.when(F.col("doc_id") % 7 != 0, F.expr(_A12)).alias("text"))
    return parse_counts(files, symbols_of(files.where("language = 'python'")), "repository")


@query("a14_corpus_stats", "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM w GROUP BY term")
def a14_corpus_stats(t):
    post = lexical.document_postings(t.documents, ["text"], "doc_id", by=("field", "term", "id"))
    return post.groupBy("term").agg(F.count("id").alias("df"), F.sum("tf").alias("cf"))


@query("a15_payload_distinct", "SELECT conv_id, count(DISTINCT sha256(text)) AS payloads, count(DISTINCT sha256(text)) = 1 AS same FROM conversations GROUP BY conv_id")
def a15_payload_distinct(t):
    n = F.countDistinct(F.sha2("text", 256))
    return t.conversations.groupBy("conv_id").agg(n.alias("payloads"), (n == 1).alias("same"))


@query("w1_rank", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events")
def w1_rank(t):
    return placed(t.events, "event_type", -F.col("value"), "event_id").select("event_type", "event_id", F.col("place").alias("rank"))


@query("w2_list_extremes", "SELECT event_id, user_id, value, min(value) OVER (PARTITION BY user_id) AS low, max(value) OVER (PARTITION BY user_id) AS high FROM events")
def w2_list_extremes(t):
    w = W.partitionBy("user_id")
    return t.events.select("event_id", "user_id", "value", F.min("value").over(w).alias("low"), F.max("value").over(w).alias("high"))


@query("w6_blocks", "SELECT event_type, block, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT event_type, value, (k // 50) + 1 AS block, k % 50 AS pos FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k FROM events)) WHERE pos >= 5 GROUP BY event_type, block")
def w6_blocks(t):
    rows = placed(t.events, "event_type", _micros(), "event_id").select("event_type", "value", (F.col("place") - 1).alias("k")).where(F.col("k") % 50 >= 5)
    return rows.groupBy("event_type", (F.floor(F.col("k") / 50) + 1).alias("block")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("w7_lookback", "SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_view, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_error FROM events")
def w7_lookback(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    last = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    following = F.min(F.when(F.col("event_type") == "error", F.col("event_id"))).over(w.rowsBetween(1, W.unboundedFollowing))
    return t.events.select("event_id", last.alias("last_view"), following.alias("next_error"))


@query("r3_minmax", "SELECT event_id, round(CASE WHEN high = low THEN 1.0 ELSE (value - low) / (high - low) END, 8) AS norm FROM (SELECT event_id, value, min(value) OVER (PARTITION BY user_id) AS low, max(value) OVER (PARTITION BY user_id) AS high FROM events)")
def r3_minmax(t):
    return t.events.select("event_id", F.round(min_max(F.col("value"), "user_id"), 8).alias("norm"))


@query(
    "e5_latency_by_level",
    """SELECT CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 10 ELSE 20 END AS workers, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failed,
    round(avg(value) FILTER (event_type <> 'error'), 6) AS mean, round(median(value) FILTER (event_type <> 'error'), 6) AS median, round(min(value) FILTER (event_type <> 'error'), 6) AS low, round(max(value) FILTER (event_type <> 'error'), 6) AS high,
    round(count(*) FILTER (event_type <> 'error') / (sum(value) / 1000), 6) AS per_second,
    round(list_sort(list(value) FILTER (event_type <> 'error'))[CAST(floor((count(*) FILTER (event_type <> 'error') - 1) * 0.95) AS BIGINT) + 1], 6) AS p95,
    round(list_sort(list(value) FILTER (event_type <> 'error'))[CAST(floor((count(*) FILTER (event_type <> 'error') - 1) * 0.99) AS BIGINT) + 1], 6) AS p99 FROM events GROUP BY 1""",
)
def e5_latency_by_level(t):
    rows = t.events.withColumn("workers", F.expr("CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 10 ELSE 20 END"))
    return evaluation.level_summary(rows, F.col("value"), F.col("event_type") == "error", F.sum("value") / 1000, "workers")


@query("e8_burst_accounting", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, count(DISTINCT (user_id % 10)) AS engine_calls, count(*) - count(DISTINCT (user_id % 10)) AS followers FROM events GROUP BY 1")
def e8_burst_accounting(t):
    rows = t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("user_id") % 10).alias("query"))
    return evaluation.burst_accounting(rows, "query", "day")


@query("e9_stage_profile", "SELECT user_id % 4 AS workers, event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS p95 FROM events GROUP BY 1, 2")
def e9_stage_profile(t):
    rows = t.events.select((F.col("user_id") % 4).alias("workers"), F.col("event_type").alias("stage"), "value")
    summary = rows.groupBy("workers", "stage").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return evaluation.with_percentiles(summary, rows, F.col("value"), {"p95": 0.95}, "workers", "stage")


@query("e11_vector_deviation", "SELECT a.vec_id, round(list_max(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))), 6) AS deviation FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def e11_vector_deviation(t):
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    gaps = F.zip_with("embedding", "other", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return t.embeddings.join(b, "vec_id").select("vec_id", F.round(F.array_max(gaps), 6).alias("deviation"))


def requests(t, kind):
    """A request log from the events: users are sessions, payloads are queries."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t.events.select("user_id", F.col("event_id").alias("n"), at.alias("at"), F.concat(F.lit(" Payload  "), "props").alias("query"), F.lit(10).alias("limit"), F.expr(kind).alias("kind"), "value", "props")


_KIND = "CASE event_type WHEN 'signup' THEN 'rotate' WHEN 'error' THEN 'bypass' ELSE 'search' END"
_OUTCOMES = f"""SELECT user_id, event_id, props, value, CASE WHEN kind = 'bypass' THEN 'bypass' WHEN row_number() OVER (PARTITION BY user_id, props, epoch, kind ORDER BY event_id) = 1 THEN 'retrieved' ELSE 'hit' END AS outcome
    FROM (SELECT *, {_KIND} AS kind, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM events) WHERE kind <> 'rotate'"""


@query("h1_cache_replay", f"SELECT user_id, event_id AS n, outcome FROM ({_OUTCOMES})")
def h1_cache_replay(t):
    """Each request's outcome by the cache itself: searches fill it, bypasses do not, a rotation empties it."""
    return cache.replay(requests(t, _KIND), "user_id", 1e12)


@query("h3_outcomes", f"SELECT user_id, outcome, count(*) AS n, round(avg(round(value * 100)), 6) AS mean FROM ({_OUTCOMES}) GROUP BY 1, 2")
def h3_outcomes(t):
    rows = cache.replay(requests(t, _KIND), "user_id", 1e12).join(t.events.select(F.col("event_id").alias("n"), "value"), "n")
    return evaluation.outcome_summary(rows, F.round(F.col("value") * 100), "user_id")


@query("h4_expiry", "SELECT event_id, CASE WHEN value * 10 < 300 THEN 'hit' ELSE 'retrieved' END AS outcome FROM events")
def h4_expiry(t):
    """Every query is asked twice, the second time after ten seconds for each unit of the event's value: entries live 300 s."""
    at = lambda k: (F.col("value") * 10 * k).alias("at")
    row = lambda k: t.events.select("event_id", F.lit(k).alias("n"), at(k), F.concat(F.lit("q"), "event_id").alias("query"), F.lit(1).alias("limit"), F.lit("search").alias("kind"))
    return cache.replay(row(0).unionByName(row(1)), "event_id").where("n = 1").select("event_id", "outcome")


@query("c3_apply_sync", "SELECT source, count(*) AS n FROM (SELECT source FROM documents WHERE NOT (source = 'src2' AND lang IN ('de', 'fr')) UNION ALL SELECT source FROM documents WHERE source = 'src2' AND lang = 'de') GROUP BY source")
def c3_apply_sync(t):
    docs = t.documents.select(F.col("doc_id").alias("symbol_id"), F.substring("source", 4, 9).cast("int").alias("repository_id"), F.col("lang").alias("path"), "source")
    feed = t.spark.createDataFrame([(0, "M", None, "de"), (1, "D", None, "fr")], "ordinal int, status string, old_path string, path string")
    fresh = docs.where("repository_id = 2 AND path = 'de'")
    return changes.apply_sync(docs, 2, feed, fresh).groupBy("source").agg(F.count("*").alias("n"))


_LATER = "2 + event_id % 7"


@query(
    "e6_trace_blocks",
    f"""WITH f AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'reused' ELSE 'fresh' END AS connection, event_id, {_LATER} AS ms, row_number() OVER (PARTITION BY event_id % 3 = 0 ORDER BY ts, '10.1.0.9.' || (event_id + 20000)) - 1 AS k FROM events)
    SELECT connection, CAST(k // 100 + 1 AS INTEGER) AS block, count(*) AS flows, 1.0::DOUBLE AS ack_ms, round(avg(ms)::DOUBLE, 3) AS response_ms, CASE WHEN connection = 'reused' THEN 50.0::DOUBLE END AS since_previous_ms FROM f WHERE k % 100 >= 5 GROUP BY ALL""",
)
def e6_trace_blocks(t):
    """A capture written from the events: every third connection asks twice, and the answer comes after 2 to 8 ms."""
    from ..sources import traces

    at = F.unix_micros(F.col("ts").cast("timestamp"))
    client = F.concat(F.lit("10.1.0.9."), F.col("event_id") + 20000)
    line = lambda us, here, there, flags, n: F.concat(F.format_string("%.6f", (at + us) / 1e6), F.lit(" IP "), here, F.lit(" > "), there, F.lit(f": Flags [{flags}], seq 1, length {n}"))
    server, again = F.lit("10.1.0.2.9200"), F.col("event_id") % 3 == 0
    packets = [line(0, client, server, "P.", 108), line(1000, server, client, ".", 0), line(F.expr(f"1000 * ({_LATER})"), server, client, "P.", 177)]
    first = [line(-70_000, client, server, "P.", 300), line(-50_000, server, client, "P.", 9000)]
    lines = t.events.select(F.explode(F.concat(F.array(*packets), F.when(again, F.array(*first)).otherwise(F.array().cast("array<string>")))).alias("line"))
    flows = traces.checked(traces.measured(traces.packets(lines)), traces.Workload(9200, 108, 177, 5000))
    return traces.block_means(flows, 95, 5)


@query("e7_mixed_cache", f"SELECT props, count(*) AS requests, count(*) FILTER (outcome = 'hit') AS hits, round(100.0 * count(*) FILTER (outcome = 'hit') / count(*), 6) AS hit_percent FROM ({_OUTCOMES}) GROUP BY props")
def e7_mixed_cache(t):
    rows = cache.replay(requests(t, _KIND), "user_id", 1e12).join(t.events.select(F.col("event_id").alias("n"), "props"), "n")
    return cache.hit_rates(rows, "props")


@query("e10_control_blocks", "SELECT user_id % 2 AS variant, block, count(*) AS n, round(avg(value), 6) AS mean, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS p95, count(DISTINCT event_type) = 5 AS valid FROM (SELECT *, ((k - 1) // 100) + 1 AS block, (k - 1) % 100 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 2 ORDER BY ts, event_id) AS k FROM events)) WHERE pos >= 10 GROUP BY 1, 2")
def e10_control_blocks(t):
    k = placed(t.events.withColumn("variant", F.col("user_id") % 2), "variant", _micros(), "event_id")
    rows = k.where("(place - 1) % 100 >= 10").withColumn("block", F.floor((F.col("place") - 1) / 100) + 1)
    summary = rows.groupBy("variant", "block").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), (F.countDistinct("event_type") == 5).alias("valid"))
    return evaluation.with_percentiles(summary, rows, F.col("value"), {"p95": 0.95}, "variant", "block")
