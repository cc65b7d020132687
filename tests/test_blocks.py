"""Blocks of postings are made of values that tasks send for many documents: no row a pair is shuffled, and the lists are those of all pairs."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quernstone.operators import blocks
from quernstone.plans import catalog

ROWS = [
    (1, "a b a", "é x9", False), (2, None, "", None), (3, "a", None, True), (None, "a lost", "b", False), (5, "c", "c c", False), (5, "c d", "e", False),
    *((100 + k, " ".join(f"w{(k * j) % 11}" for j in range(k % 7)), "a " * (k % 4), k % 5 == 0) for k in range(40)),
]


@pytest.mark.parametrize(("shard_docs", "part_bytes", "sent", "at_once"), [(1000, 1 << 20, 10**6, 1000), (9, 40, 20, 3), (9, 40, 1, 1)])
def test_lists_are_those_of_all_pairs(spark, monkeypatch, shard_docs, part_bytes, sent, at_once):
    for name, value in (("SHARD_DOCS", shard_docs), ("PART_BYTES", part_bytes), ("SENT_PAIRS", sent), ("BLOCK", 4), ("SENT_BLOCKS", 3)):
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(blocks.lexical, "COUNTED_ROWS", at_once)
    docs = spark.createDataFrame(ROWS, "symbol_id int, name string, code string, is_test boolean").repartition(3)
    df = blocks.build(docs, len(ROWS), ["name", "code"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Sort [term" not in plan and "Generate" not in plan and "Aggregate" not in plan
    rows = df.withColumn("right", F.forall("ids", lambda i: blocks.shard(i, blocks.shards_of(len(ROWS))) == F.col("shard"))).collect()
    tf, test = Counter(), {}
    for i, name, code, flag in ROWS:
        if i is not None:
            test[i] = flag is not False
            tf.update((f, w, i) for f, text in (("name", name), ("code", code)) for w in re.findall(r"\w+", (text or "").lower()))
    lists = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["block"]):
        assert r["right"] and 1 <= len(r["ids"]) <= 4 and r["max_tf"] == max(r["tfs"]) and r["min_length"] == min(r["lengths"])
        lists[r["shard"], r["field"], r["term"]].append((r["block"], list(zip(r["ids"], r["tfs"], r["lengths"], r["tests"], strict=True))))
    assert all([b for b, _ in parts] == list(range(len(parts))) and all(len(e) == 4 for _, e in parts[:-1]) for parts in lists.values())
    found = {(f, w, i): (n, t) for (_, f, w), parts in lists.items() for _, entries in parts for i, n, _, t in entries}
    assert found == {key: (n, test[key[2]]) for key, n in tf.items()}
    for parts in lists.values():
        entries = [e for _, es in parts for e in es]
        assert entries == sorted(entries, key=lambda e: (-(e[1] / (e[1] + 0.01 * e[2])), e[0]))
    assert blocks.build(docs.limit(0), 0, ["name", "code"]).isEmpty()


def test_the_query_has_the_rows_of_its_sql_without_texts(spark, tmp_path):
    words = ["license", "und", "que", "mit", "of", "test"]
    rows = [(k, None if k % 4 == 0 else f"{words[k % 6]} all\nthe {words[k % 5]} rights", "en", words[k % 3]) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT query_id, id, score, rank FROM ({catalog.ORACLE['r1_block_max']})").fetchall()
    got = catalog.QUERIES["r1_block_max"](spark, str(tmp_path)).select("query_id", "id", "score", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want)
