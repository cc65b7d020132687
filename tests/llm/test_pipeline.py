import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from quernstone.llm import near_dedup


def test_stages_keep_columns_and_take_effect(spark, folder, edge_docs):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        rows = out.collect()
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(rows, docs.schema)
    for _, stage in pipeline.STAGES:
        assert stage(spark, edge_docs.limit(0), folder).count() == 0
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, edge_docs, folder).columns == edge_docs.columns


def test_run_packs_what_is_left(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pieces = pipeline.run(spark, folder)
    groups = near_dedup.near_duplicates(docs, percent=80)
    dropped = {r["doc_id"] for r in groups.where(~F.col("kept")).collect()}
    ids = {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()}
    assert dropped and ids.isdisjoint(dropped)
    leaked = {r["doc_id"] for r in docs.crossJoin(F.broadcast(spark.read.parquet(f"{folder}/benchmark.parquet").select(F.col("text").alias("b")))).where(F.col("text").contains(F.col("b"))).collect()}
    assert leaked and len(ids) >= docs.count() - len(dropped) - 2 * len(leaked) - 3
