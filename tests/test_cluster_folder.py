"""Stores of queries on a cluster whose ``spark.checkpoint.dir`` is a path without a scheme."""

from quernstone.operators.generations import GenerationStore
from quernstone.operators.shared import folder


def test_a_checkpoint_folder_without_a_scheme_serves_a_cluster(spark, monkeypatch):
    assert spark.conf.get("spark.checkpoint.dir").startswith("/")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    store = GenerationStore(spark, folder(spark, "store"))
    assert store.folder.local is None and store.folder.uri.startswith("file:/")
    store.publish({"docs": spark.range(5).withColumnRenamed("id", "symbol_id")})
    assert store.read("docs").count() == 5 and store.pending() is None
