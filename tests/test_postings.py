"""Postings of whole documents: counted row by row, with the rows of the query's SQL whatever the ids are."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quernstone.operators import lexical
from quernstone.plans import catalog

ROWS = [
    (1, "a b a é_9, A"), (2, None), (3, ""), (4, "--"), (5, "b c"), (5, "c C"), (5, "c c c"), (5, "c c c"), (5, None), (6, "a b"), (6, "a b"), (None, "x y"), (None, "x"), (None, "y x"), (7, "straße ŒUVRE œuvre 日本 語 ٣"),
    *((100 + k, " ".join(f"w{(k * j) % 11}" for j in range(k % 7))) for k in range(40)),
]


def stored(spark, folder, rows, files=3):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(files).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def plain(rows):
    return sorted(map(repr, rows))


def by_sql(folder, name="s5_postings", columns="field, term, id, tf, length"):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return plain(con.execute(f"SELECT {columns} FROM ({catalog.ORACLE[name]})").fetchall())


@pytest.mark.parametrize(("few", "at_once"), [(200_000, 1000), (1, 1), (1, 4)])
def test_repeated_and_null_ids_have_the_rows_of_the_sql(spark, tmp_path, monkeypatch, few, at_once):
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", few)
    monkeypatch.setattr(lexical, "COUNTED_ROWS", at_once)
    folder = stored(spark, tmp_path, ROWS)
    df = catalog.QUERIES["s5_postings"](spark, folder)
    assert df.dtypes == [("field", "string"), ("term", "string"), ("id", "bigint"), ("tf", "bigint"), ("length", "int")]
    assert plain(map(tuple, df.collect())) == by_sql(folder)


def test_documents_of_their_own_ids_are_not_shuffled(spark, tmp_path):
    folder = stored(spark, tmp_path, [r for r in ROWS if r[0] not in (None, 5, 6)])
    df = catalog.QUERIES["s5_postings"](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert plain(map(tuple, df.collect())) == by_sql(folder)


def test_corpus_statistics_shuffle_terms_alone_and_count_an_id_once(spark, tmp_path):
    folder = stored(spark, tmp_path / "again", ROWS)
    assert plain(map(tuple, catalog.QUERIES["a14_corpus_stats"](spark, folder).collect())) == by_sql(folder, "a14_corpus_stats", "term, df, cf")
    folder = stored(spark, tmp_path / "once", [r for r in ROWS if r[0] not in (None, 5, 6)])
    df = catalog.QUERIES["a14_corpus_stats"](spark, folder)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert plain(map(tuple, df.collect())) == by_sql(folder, "a14_corpus_stats", "term, df, cf")


def test_several_fields_and_ids_of_any_type(spark):
    docs = spark.createDataFrame([("p", "x y x", "y"), ("q", None, "z z"), ("r", "x", "")], "key string, name string, code string")
    found = lexical.document_postings(docs, ["name", "code"], "key")
    assert plain(map(tuple, found.collect())) == plain([("name", "x", "p", 2, 3), ("name", "y", "p", 1, 3), ("code", "y", "p", 1, 1), ("code", "z", "q", 2, 2), ("name", "x", "r", 1, 1)])
    assert lexical.document_postings(docs.where(F.lit(False)), ["name"], "key").isEmpty()
