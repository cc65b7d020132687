"""Queries of scans, scalar derivations and filters."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vector as V
from ..operators import changes
from .registry import query

PATH = "concat_ws('/', CASE WHEN doc_id % 7 = 0 THEN 'Tests' WHEN doc_id % 7 = 1 THEN 'src\\\\test' ELSE 'src' END, source, concat(CASE WHEN doc_id % 5 = 0 THEN 'test_' ELSE '' END, 'd', doc_id, CASE WHEN doc_id % 11 = 0 THEN '_test' ELSE '' END, element_at(array('.py','.js','.Go','.txt','.h',''), CAST(doc_id % 6 AS INT) + 1)))"
PATH_SQL = "concat_ws('/', CASE WHEN doc_id % 7 = 0 THEN 'Tests' WHEN doc_id % 7 = 1 THEN 'src\\test' ELSE 'src' END, source, concat(CASE WHEN doc_id % 5 = 0 THEN 'test_' ELSE '' END, 'd', doc_id, CASE WHEN doc_id % 11 = 0 THEN '_test' ELSE '' END, ['.py','.js','.Go','.txt','.h',''][doc_id % 6 + 1]))"


def paths(docs):
    return docs.select("doc_id", F.expr(PATH).alias("path"))


@query("s7_list", "SELECT s_suppkey, s_name, (SELECT count(*) FROM supplier) AS total FROM supplier")
def s7_list(t):
    n = t.supplier.agg(F.count("*").alias("total"))
    return t.supplier.select("s_suppkey", "s_name").crossJoin(F.broadcast(n)).orderBy("s_suppkey")


@query("s6_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def s6_point_lookup(t):
    return t.orders.where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "s3_language_map",
    f"""SELECT doc_id, path, CASE lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) {" ".join(f"WHEN '{e}' THEN '{v}'" for e, v in X.LANGUAGES.items())} END AS language FROM (SELECT doc_id, {PATH_SQL} AS path FROM documents)""",
)
def s3_language_map(t):
    return paths(t.documents).withColumn("language", X.language_of(F.col("path")))


@query("s2_scan_hash", "SELECT * FROM (SELECT 'p/' || page_id || CASE page_id % 3 WHEN 0 THEN '.js' WHEN 1 THEN '.TS' ELSE '.html' END AS path, CASE page_id % 3 WHEN 0 THEN 'javascript' WHEN 1 THEN 'typescript' END AS language, sha256(html) AS content_hash, CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM pages) WHERE language IS NOT NULL")
def s2_scan_hash(t):
    from ..sources.repository import described

    path = F.concat(F.lit("p/"), "page_id", F.expr("CASE page_id % 3 WHEN 0 THEN '.js' WHEN 1 THEN '.TS' ELSE '.html' END"))
    rows = described(t.pages.select(path.alias("path"), F.encode("html", "utf-8").alias("content")))
    return rows.select("path", "language", "content_hash", F.octet_length("content").cast("long").alias("bytes"))


@query(
    "p1_is_test_path",
    f"""SELECT doc_id, path, (starts_with(p, 'test/') OR starts_with(p, 'tests/') OR contains(p, '/test/') OR contains(p, '/tests/') OR starts_with(split_part(p, '/', -1), 'test_') OR ends_with(split_part(p, '/', -1), '_test.py')) AS is_test
    FROM (SELECT doc_id, path, lower(replace(path, '\\', '/')) AS p FROM (SELECT doc_id, {PATH_SQL} AS path FROM documents))""",
)
def p1_is_test_path(t):
    return paths(t.documents).withColumn("is_test", X.is_test_path(F.col("path")))


@query("p2_test_intent", "SELECT conv_id, turn, contains(lower(text), 'test') OR contains(lower(text), 'sanity check') AS intent FROM conversations")
def p2_test_intent(t):
    return t.conversations.select("conv_id", "turn", X.has_test_intent(F.col("text")).alias("intent"))


_LINES = "regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]')"
_CUT = f"(CASE WHEN list_last({_LINES}) = '' THEN {_LINES}[:-2] ELSE {_LINES} END)"


@query(
    "p3_embedding_text",
    f"""SELECT doc_id, md5(concat_ws(chr(10), 'Symbol: ' || source, 'Type: document', 'Signature: ' || trim(coalesce({_CUT}[1], '')), 'Repository: ' || source, 'File: ' || lang, 'Language: ' || lang, '', 'Implementation:', array_to_string({_CUT}[1:40], chr(10)))) AS digest FROM documents""",
)
def p3_embedding_text(t):
    c = F.col
    return t.documents.select("doc_id", F.md5(X.embedding_text(c("source"), F.lit("document"), c("source"), c("lang"), c("lang"), c("text"))).alias("digest"))


@query(
    "p4_rerank_doc",
    f"SELECT doc_id, md5(concat_ws(chr(10), 'Repository: ' || source, 'File: ' || lang, 'Symbol: ' || source, 'Type: document', '', array_to_string({_CUT}[1:40], chr(10)))) AS digest FROM documents",
)
def p4_rerank_doc(t):
    c = F.col
    return t.documents.select("doc_id", F.md5(X.rerank_text(c("source"), c("lang"), c("source"), F.lit("document"), c("text"))).alias("digest"))


@query(
    "p6_url_parse",
    r"""SELECT page_id, CASE WHEN ok THEN regexp_extract(u, '^(?i:https?://(?:www\.)?github\.com)/([A-Za-z0-9_-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$', 1) END AS owner, CASE WHEN ok THEN regexp_extract(u, '^(?i:https?://(?:www\.)?github\.com)/([A-Za-z0-9_-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$', 2) END AS name
    FROM (SELECT page_id, u, regexp_matches(u, '^(?i:https?://(?:www\.)?github\.com)/([A-Za-z0-9_-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$') AS ok
    FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://github.com/Owner-' || page_id || '/repo_name.v2.git' WHEN 2 THEN 'HTTP://www.GitHub.com/o/r' || page_id || '/' ELSE 'https://github.com/o//r' END AS u FROM pages))""",
)
def p6_url_parse(t):
    u = F.expr("CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://github.com/Owner-' || page_id || '/repo_name.v2.git' WHEN 2 THEN 'HTTP://www.GitHub.com/o/r' || page_id || '/' ELSE 'https://github.com/o//r' END")
    owner, name = X.repository_of(F.col("u"))
    return t.pages.select("page_id", u.alias("u")).select("page_id", owner.alias("owner"), name.alias("name"))


@query("p7_safe_path", f"SELECT doc_id, path, path <> '' AND NOT starts_with(path, '/') AND NOT list_contains(string_split(path, '/'), '..') AND NOT list_contains(string_split(path, '/'), '.git') AS safe FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '/' || {PATH_SQL} WHEN 1 THEN '../' || {PATH_SQL} WHEN 2 THEN 'a/.git/' || {PATH_SQL} WHEN 3 THEN '' ELSE {PATH_SQL} END AS path FROM documents)")
def p7_safe_path(t):
    p = F.expr(f"CASE doc_id % 5 WHEN 0 THEN '/' || {PATH} WHEN 1 THEN '../' || {PATH} WHEN 2 THEN 'a/.git/' || {PATH} WHEN 3 THEN '' ELSE {PATH} END")
    return t.documents.select("doc_id", p.alias("path")).withColumn("safe", X.is_safe_path(F.col("path")))


@query("p9_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def p9_content_hash(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("p10_cache_digest", r"SELECT conv_id, turn, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) || ':' || (turn + 1)) AS digest FROM conversations")
def p10_cache_digest(t):
    return t.conversations.select("conv_id", "turn", X.cache_digest(F.col("text"), F.col("turn") + 1).alias("digest"))


@query("p11_generation_name", "SELECT doc_id, name, regexp_matches(name, '^symbols_generation_[0-9a-f]{32}$') AS managed FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'symbols_generation_' || md5(text) WHEN 1 THEN 'symbols_generation_' || upper(md5(text)) ELSE 'symbols' END AS name FROM documents)")
def p11_generation_name(t):
    n = F.expr("CASE doc_id % 3 WHEN 0 THEN 'symbols_generation_' || md5(text) WHEN 1 THEN 'symbols_generation_' || upper(md5(text)) ELSE 'symbols' END")
    return t.documents.select("doc_id", n.alias("name")).withColumn("managed", X.is_generation_name(F.col("name"), "symbols"))


@query("p12_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def p12_iso_time(t):
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("f1_test_filter", "SELECT doc_id, lang FROM documents WHERE NOT contains(lower(text), 'test')")
def f1_test_filter(t):
    return t.documents.where(~F.lower("text").contains("test")).select("doc_id", "lang")


@query("f2_delete_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey = 7 AND l_returnflag IN ('A', 'R')")
def f2_delete_filter(t):
    return t.lineitem.where((F.col("l_suppkey") == 7) & F.col("l_returnflag").isin("A", "R")).select("l_orderkey", "l_linenumber")


@query("f3_must_not", "SELECT count(*) AS n, count(DISTINCT source) AS sources FROM documents WHERE source <> 'src0'")
def f3_must_not(t):
    return t.documents.where(F.col("source") != "src0").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query("f4_id_in", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def f4_id_in(t):
    return t.orders.join(t.customer.where("c_acctbal > 5000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("f6_any_term", "SELECT doc_id FROM documents WHERE contains(lower(source || ' ' || lang || ' ' || text), 'licensed') OR contains(lower(source || ' ' || lang || ' ' || text), 'rights reserved') OR contains(lower(source || ' ' || lang || ' ' || text), 'src1 ')")
def f6_any_term(t):
    hay = F.lower(F.concat_ws(" ", "source", "lang", "text"))
    return t.documents.where(F.exists(F.array(*map(F.lit, ("licensed", "rights reserved", "src1 "))), lambda term: hay.contains(term))).select("doc_id")


@query(
    "f7_hit_validation",
    "SELECT l_orderkey, l_linenumber, coalesce(l_linenumber >= 1 AND l_suppkey >= l_linenumber AND l_partkey % 5 <> 0 AND l_partkey % 7 <> 0 AND l_shipmode IS NOT NULL, false) AS valid FROM (SELECT *, CASE WHEN l_orderkey % 4 <> 0 THEN l_returnflag END AS l_shipmode FROM lineitem)",
)
def f7_hit_validation(t):
    from ..operators.hits import is_valid_hit

    score = F.expr("CASE WHEN l_partkey % 5 = 0 THEN double('NaN') WHEN l_partkey % 7 = 0 THEN double('Infinity') WHEN l_partkey % 3 = 0 THEN NULL ELSE l_extendedprice END")
    rows = t.lineitem.withColumn("path", F.expr("CASE WHEN l_orderkey % 4 <> 0 THEN l_returnflag END"))
    return rows.select("l_orderkey", "l_linenumber", is_valid_hit(score, F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_linestatus"), F.col("path")).alias("valid"))


@query("f8_vector_valid", "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AS valid FROM embeddings")
def f8_vector_valid(t):
    return t.embeddings.select("vec_id", V.is_valid(F.col("embedding"), 64).alias("valid"))


@query("p13_round", "SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 3) AS root FROM lineitem")
def p13_round(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.sqrt("l_extendedprice"), 3).alias("root"))


_FEED = "CASE WHEN event_type = 'signup' THEN 'A' WHEN event_type = 'error' THEN 'D' WHEN event_type = 'click' THEN 'M' WHEN event_type = 'view' THEN 'T' ELSE 'R' END"
_EXT = ".py", ".txt"


def feed(events):
    """A change feed from events: one change per user and type."""
    rows = events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    path = F.concat(F.lit("u"), "user_id", F.lit("/"), "event_type", F.when(F.col("user_id") % 3 == 0, ".txt").otherwise(".py"))
    return rows.select(F.col("event_id").alias("ordinal"), F.expr(_FEED).alias("status"), F.when(F.col("event_type") == "purchase", F.concat(F.lit("old/"), path)).alias("old_path"), path.alias("path"), "user_id")


_FEED_SQL = f"SELECT min(event_id) AS ordinal, {_FEED} AS status, CASE WHEN event_type = 'purchase' THEN 'old/u' || user_id || '/' || event_type || CASE WHEN user_id % 3 = 0 THEN '.txt' ELSE '.py' END END AS old_path, 'u' || user_id || '/' || event_type || CASE WHEN user_id % 3 = 0 THEN '.txt' ELSE '.py' END AS path, user_id FROM events GROUP BY user_id, event_type"
_CLASSIFIED_SQL = f"""SELECT ordinal, status, old_path, path, ends_with(path, '.py') AS supported,
    CASE WHEN status = 'D' THEN 'delete' WHEN NOT ends_with(path, '.py') THEN 'ignore' WHEN user_id % 2 = 1 THEN CASE WHEN status = 'R' THEN 'rename' ELSE 'add' END
    WHEN status IN ('M', 'T') THEN 'modify' WHEN status = 'R' THEN 'rename' ELSE 'replace' END AS action FROM ({_FEED_SQL})"""


def classified(t):
    f = feed(t.events)
    return changes.classify(f.drop("user_id"), f.where("user_id % 2 = 0").select("path"))


@query("c2_change_classify", _CLASSIFIED_SQL)
def c2_change_classify(t):
    return classified(t)


@query(
    "a11_sync_counters",
    f"""SELECT count(*) FILTER (action = 'add') AS files_added, count(*) FILTER (action = 'modify') AS files_modified, count(*) FILTER (action = 'delete') AS files_deleted,
    count(*) FILTER (status = 'R') AS files_renamed, count(*) FILTER (ends_with(path, '.py') AND action IN ('add', 'modify', 'rename', 'replace')) AS files_parsed FROM ({_CLASSIFIED_SQL})""",
)
def a11_sync_counters(t):
    return changes.counters(classified(t))


@query("t5_affected_paths", f"SELECT DISTINCT unnest(list_filter([old_path, path], lambda x: x IS NOT NULL)) AS path FROM ({_FEED_SQL})")
def t5_affected_paths(t):
    return changes.affected_paths(feed(t.events))


_DIFF_ROWS = "SELECT event_id, CASE event_type WHEN 'signup' THEN 'A' WHEN 'error' THEN 'D' WHEN 'click' THEN 'M' WHEN 'view' THEN 'R100' ELSE 'C075' END AS st, 'f' || user_id || '.py' AS p FROM events"


_RECORD = "CASE event_type WHEN 'signup' THEN 'A' WHEN 'error' THEN 'D' WHEN 'click' THEN 'M' WHEN 'view' THEN 'R100' ELSE 'C075' END"


@query(
    "c1_diff_parse",
    f"""SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS ordinal, CASE WHEN st = 'C075' THEN 'A' ELSE substr(st, 1, 1) END AS status, CASE WHEN st = 'R100' THEN 'old ' || event_id END AS old_path, 'f' || event_id || chr(10) || '.py' AS path
    FROM (SELECT user_id, event_id, {_RECORD} AS st FROM events)""",
)
def c1_diff_parse(t):
    """A listing for each user, its records in order of the events, with paths that hold blanks and line ends."""
    record = F.concat(F.expr(_RECORD), F.lit("\0"), F.when(F.col("event_type").isin("signup", "error", "click"), "").otherwise(F.concat(F.lit("old "), "event_id", F.lit("\0"))), F.lit("f"), "event_id", F.lit("\n.py\0"))
    listings = t.events.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", record.alias("r")))), lambda x: x["r"]), "").alias("listing"))
    return changes.parse_listings(listings, "user_id", "listing")


@query("k3_anti_delete", "SELECT doc_id, source, lang FROM documents WHERE NOT (source = 'src1' AND lang IN (SELECT DISTINCT lang FROM documents WHERE doc_id < 20))")
def k3_anti_delete(t):
    docs = t.documents.select("doc_id", "source", "lang", F.substring("source", 4, 9).cast("int").alias("repository_id"), F.col("lang").alias("path"))
    gone = t.documents.where("doc_id < 20").select(F.col("lang").alias("path"))
    return changes.delete_paths(docs, 1, gone).select("doc_id", "source", "lang")


@query("k2_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'changed' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 10000000, 'new' FROM customer WHERE c_custkey % 100 = 0")
def k2_upsert(t):
    old = t.customer.select("c_custkey", "c_mktsegment")
    fresh = old.where("c_custkey % 10 = 0").select("c_custkey", F.lit("changed").alias("c_mktsegment")).union(old.where("c_custkey % 100 = 0").select((F.col("c_custkey") + 10000000).alias("c_custkey"), F.lit("new").alias("c_mktsegment")))
    return changes.upsert(old, fresh, "c_custkey")


@query("k4_copy_except", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE source <> 'src3' GROUP BY source")
def k4_copy_except(t):
    from ..operators.generations import without_repository

    docs = t.documents.withColumn("repository_id", F.substring("source", 4, 9).cast("int"))
    return without_repository(docs, 3).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


_INV = """SELECT CASE WHEN user_id % 10 = 0 THEN 'symbols' WHEN user_id % 10 = 1 THEN 'other' ELSE 'symbols_generation_' || md5(CAST(user_id AS VARCHAR)) END || '' AS name, user_id % 7 <> 0 AS present, user_id = 5 AS active, user_id % 13 = 0 AS aliased, user_id = 9 AS in_journal, user_id % 6 <> 0 AS tracked,
    CASE WHEN user_id % 6 = 0 THEN NULL WHEN user_id % 4 = 0 THEN 'published' WHEN user_id % 4 = 1 THEN 'abandoned' ELSE 'retired' END AS state,
    CASE WHEN user_id % 17 <> 0 THEN 'u' || user_id END AS recorded_uuid, CASE WHEN user_id % 7 <> 0 THEN CASE WHEN user_id % 19 = 0 THEN 'x' ELSE 'u' || user_id END END AS live_uuid, CASE WHEN user_id % 11 <> 0 THEN max(ts) END AS inactive_at FROM events GROUP BY user_id"""


@query(
    "c7_retention_eligibility",
    f"""WITH inv AS ({_INV}), r AS (SELECT *, tracked AND coalesce(state = 'retired', false) AND inactive_at IS NOT NULL AS retired FROM inv),
    n AS (SELECT *, row_number() OVER (PARTITION BY retired ORDER BY inactive_at DESC, name DESC) AS k FROM r),
    q AS (SELECT name, list_filter([CASE WHEN name = 'symbols' THEN 'legacy index' END, CASE WHEN active THEN 'active index' END, CASE WHEN aliased THEN 'referenced by an alias' END, CASE WHEN in_journal THEN 'publication journal reference' END,
    CASE WHEN NOT regexp_matches(name, '^symbols_generation_[0-9a-f]{{32}}$') THEN 'outside managed generation naming' END, CASE WHEN NOT present THEN 'index absent' END, CASE WHEN NOT tracked THEN 'untracked lifecycle' END,
    CASE WHEN tracked AND NOT coalesce(state IN ('retired', 'abandoned'), false) THEN 'lifecycle state' || coalesce(' ' || state, '') END, CASE WHEN tracked AND recorded_uuid IS NULL THEN 'unverified recorded identity' END, CASE WHEN tracked AND recorded_uuid <> live_uuid THEN 'index identity changed' END,
    CASE WHEN tracked AND inactive_at IS NULL THEN 'inactive timestamp unknown' END, CASE WHEN tracked AND epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(date_trunc('second', inactive_at)) < 86400 THEN 'inactive grace period' END,
    CASE WHEN coalesce(live_uuid IN ('', '_na_'), true) THEN 'unverified live identity' END, CASE WHEN retired AND k <= 2 THEN 'retained published generation' END], lambda x: x IS NOT NULL) AS reasons FROM n)
    SELECT name, array_to_string(reasons, '; ') AS reasons, len(reasons) = 0 AS eligible FROM q""",
)
def c7_retention_eligibility(t):
    from ..operators.generations import protections

    t.events.createOrReplaceTempView("qs_inventory_events")
    inv = t.spark.sql(_INV.replace("FROM events", "FROM qs_inventory_events").replace("VARCHAR", "STRING"))
    rows = protections(inv, F.lit("2024-01-30 12:00:00").cast("timestamp"), "symbols")
    return rows.select("name", F.array_join("reasons", "; ").alias("reasons"), "eligible")


@query("w3_keep_newest", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 2")
def w3_keep_newest(t):
    k = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return t.events.withColumn("k", k).where("k <= 2").select("user_id", "event_id")


@query("w5_top_per_group", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 30")
def w5_top_per_group(t):
    k = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return t.documents.withColumn("k", k).where("k <= 30").select("lang", "doc_id")


@query("t1_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def t1_topk(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("t4_order_by", "SELECT p_partkey, p_brand, p_type FROM part ORDER BY p_brand, p_type, p_partkey LIMIT 40")
def t4_order_by(t):
    return t.part.select("p_partkey", "p_brand", "p_type").orderBy("p_brand", "p_type", "p_partkey").limit(40)


@query("p5_hit_format", "SELECT vec_id, round(coalesce(CASE WHEN label % 3 <> 0 THEN CAST(label AS DOUBLE) END, 0.0), 6) AS score, CASE WHEN label = 4 THEN NULL ELSE 'l' || label END AS language, coalesce(CASE WHEN label > 5 THEN true END, false) AS is_test FROM embeddings")
def p5_hit_format(t):
    from ..operators.hits import formatted

    rows = t.embeddings.selectExpr("vec_id", "CASE WHEN label % 3 <> 0 THEN CAST(label AS DOUBLE) END AS score", "CASE WHEN label = 4 THEN NULL ELSE 'l' || label END AS language", "CASE WHEN label > 5 THEN true END AS is_test")
    return formatted(rows)


@query("f5_equality", "SELECT doc_id, n_chars FROM documents WHERE source = 'src4' AND lang = 'en'")
def f5_equality(t):
    return t.documents.where((F.col("source") == "src4") & (F.col("lang") == "en")).select("doc_id", "n_chars")


_ASKED = "CASE doc_id % 6 WHEN 0 THEN chr(9) || chr(10) || ' ' WHEN 1 THEN '' WHEN 2 THEN repeat('x', CAST(4090 + doc_id % 13 AS INT)) WHEN 3 THEN NULL ELSE text END"


@query("f9_query_bounds", f"SELECT doc_id, coalesce(length(q) BETWEEN 1 AND 4096 AND regexp_matches(q, '\\S'), false) AS accepted FROM (SELECT doc_id, {_ASKED} AS q FROM documents)")
def f9_query_bounds(t):
    return t.documents.select("doc_id", X.is_query(F.expr(_ASKED)).alias("accepted"))


_SOURCE = "'class A' || doc_id || ':' || chr(10) || '    def m(self):' || chr(10) || '        pass' || chr(10) || 'def f' || n_chars || '():' || chr(10) || '    return ' || doc_id"


@query(
    "u1_symbols",
    """SELECT doc_id, u.s.name AS name, u.s.qualified_name AS qualified_name, u.s.kind AS kind, CAST(u.s.a AS INTEGER) AS start_line, CAST(u.s.b AS INTEGER) AS end_line FROM (SELECT doc_id, unnest([
    {'name': 'A' || doc_id, 'qualified_name': 'A' || doc_id, 'kind': 'class', 'a': 1, 'b': 3}, {'name': 'm', 'qualified_name': 'A' || doc_id || '.m', 'kind': 'method', 'a': 2, 'b': 3}, {'name': 'f' || n_chars, 'qualified_name': 'f' || n_chars, 'kind': 'function', 'a': 4, 'b': 5}]) AS s FROM documents) u""",
)
def u1_symbols(t):
    from ..sources.symbols import symbols_of

    files = t.documents.select("doc_id", F.expr(_SOURCE).alias("text"))
    return symbols_of(files, keys=("doc_id",)).drop("code")


@query("u2_source_audit", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'grammar_recovery' ELSE 'clean' END AS issue, count(*) AS n FROM documents GROUP BY 1")
def u2_source_audit(t):
    from ..sources.symbols import audit

    files = t.documents.select(F.col("doc_id").alias("path"), F.encode(F.concat(F.expr(_SOURCE), F.when(F.col("doc_id") % 3 == 0, "\ndef (").otherwise("")), "utf-8").alias("content"))
    return audit(files).groupBy("issue").agg(F.count("*").alias("n"))


_PENDING = """sy AS (SELECT user_id AS repository_id, count(DISTINCT value) AS paths FROM events WHERE event_type = 'view' AND user_id % 3 <> 0 GROUP BY 1), fu AS (SELECT DISTINCT user_id AS repository_id FROM events WHERE event_type = 'error' AND user_id % 5 = 0)"""


def pending_jobs(t):
    from ..operators import jobs

    sync = t.events.where("event_type = 'view' AND user_id % 3 <> 0").groupBy(F.col("user_id").alias("repository_id")).agg(F.collect_set(F.col("value").cast("string")).alias("affected_paths"))
    full = t.events.where("event_type = 'error' AND user_id % 5 = 0").select(F.col("user_id").alias("repository_id")).distinct()
    return jobs.report(sync, full, 10, True)


@query(
    "c8_recovery_jobs",
    f"""WITH {_PENDING} SELECT 'sync' AS kind, repository_id, paths, CASE WHEN repository_id IN (SELECT repository_id FROM fu) THEN 'sync and full jobs conflict' ELSE 'a publication is pending' END AS blocked FROM sy
    UNION ALL SELECT 'full', repository_id, 0, CASE WHEN repository_id IN (SELECT repository_id FROM sy) THEN 'sync and full jobs conflict' WHEN repository_id <> 10 THEN 'a publication is pending' END FROM fu""",
)
def c8_recovery_jobs(t):
    return pending_jobs(t)


@query(
    "a13_job_report",
    f"""WITH {_PENDING}, j AS (SELECT repository_id, paths, 1 AS s, 0 AS f FROM sy UNION ALL SELECT repository_id, 0, 0, 1 FROM fu)
    SELECT repository_id, CAST(sum(paths) AS BIGINT) AS paths, CAST(sum(s) AS BIGINT) AS sync_jobs, CAST(sum(f) AS BIGINT) AS full_jobs, sum(s) > 0 AND sum(f) > 0 AS conflict FROM j GROUP BY repository_id""",
)
def a13_job_report(t):
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    conflict = F.coalesce(F.bool_or(F.col("blocked") == "sync and full jobs conflict"), F.lit(False))
    return pending_jobs(t).groupBy("repository_id").agg(F.sum("paths").alias("paths"), n("sync").alias("sync_jobs"), n("full").alias("full_jobs"), conflict.alias("conflict"))


@query("s4_source_reader", "SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN CASE WHEN doc_id % 4 = 1 THEN '# coding: latin-1' || chr(10) ELSE '' END || 'x = ' || chr(39) || 'é' || doc_id || chr(39) || chr(10) END AS text, CASE WHEN doc_id % 4 >= 2 THEN 'cannot be decoded' END AS error FROM documents")
def s4_source_reader(t):
    """Sources in UTF-8 with a mark, in Latin-1 by a cookie, in Latin-1 without one, and with an encoding that there is not."""
    from ..sources.symbols import read_sources

    line = F.concat(F.lit("x = 'é"), "doc_id", F.lit("'\r\n"))
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.encode(line, "utf-8"))
    cookie = F.encode(F.concat(F.lit("# coding: latin-1\r\n"), line), "iso-8859-1")
    k = F.col("doc_id") % 4
    content = F.when(k == 0, marked).when(k == 1, cookie).when(k == 2, F.encode(line, "iso-8859-1")).otherwise(F.encode(F.concat(F.lit("# coding: none-such\n"), "doc_id"), "utf-8"))
    return read_sources(t.documents.select("doc_id", content.alias("content")), keys=("doc_id",))


@query("s5_symbol_scan", "SELECT d.doc_id AS id, d.lang AS kind, 'd/' || (d.doc_id // 10) AS path, CASE WHEN (d.doc_id // 10) % 2 = 0 THEN 'python' ELSE 'go' END AS language FROM documents d WHERE d.source = 'src2'")
def s5_symbol_scan(t):
    from ..operators.metadata import repository_symbols

    symbols = t.documents.select(F.col("doc_id").alias("id"), F.substring("source", 4, 9).cast("int").alias("repository_id"), F.expr("doc_id DIV 10").alias("file_id"), F.col("lang").alias("kind"))
    files = symbols.select(F.col("file_id").alias("id")).distinct().select("id", F.concat(F.lit("d/"), "id").alias("path"), F.when(F.col("id") % 2 == 0, "python").otherwise("go").alias("language"))
    return repository_symbols(symbols, files, 2).select("id", "kind", "path", "language")


@query("k5_numbered", "SELECT min(id) AS first, max(id) AS last, count(DISTINCT id) AS ids, count(*) AS n FROM (SELECT 100 + row_number() OVER () - 1 AS id FROM documents)")
def k5_numbered(t):
    """Ids of rows of the metadata tables, from a first one on without gaps."""
    from ..operators.metadata import numbered

    return numbered(t.documents.select("doc_id", "source"), 100, "source", "doc_id").agg(F.min("id").cast("long").alias("first"), F.max("id").cast("long").alias("last"), F.countDistinct("id").alias("ids"), F.count("*").alias("n"))
