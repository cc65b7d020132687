"""The ways beyond the broadcast bounds give the same rows."""

import pytest

from quernstone.llm import arc_convert, near_dedup, packing, suffix_dedup

BOUNDS = {
    "packing": (packing, "BROADCAST_GROUPS", lambda spark, folder: packing.op2_packing(spark, folder).select("doc_id", "start", "length", "ids_crc32", "doc_tokens")),
    "archives": (arc_convert, "BROADCAST_DIGESTS", lambda spark, folder: arc_convert.op3_digest(spark, folder)),
    "repeats": (suffix_dedup, "BROADCAST_COPIES", lambda spark, folder: suffix_dedup.op4_suffix_dedup(spark, folder)),
    "cut texts": (suffix_dedup, "BROADCAST_COPIES", lambda spark, folder: suffix_dedup.cut_repeats(spark.read.parquet(f"{folder}/documents.parquet"))),
    "near copies": (near_dedup, "BROADCAST_IDS", lambda spark, folder: near_dedup.op9_near_dedup(spark, folder)),
    "units of near copies": (near_dedup, "BROADCAST_BYTES", lambda spark, folder: near_dedup.op9_near_dedup(spark, folder)),
    "representatives": (near_dedup, "BROADCAST_IDS", lambda spark, folder: near_dedup.keep_representatives(spark.read.parquet(f"{folder}/documents.parquet"))),
}


@pytest.mark.parametrize("name", BOUNDS)
def test_same_rows_by_a_shuffle(spark, folder, monkeypatch, name):
    module, bound, query = BOUNDS[name]
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = sorted(map(repr, query(spark, folder).collect()))
    monkeypatch.setattr(module, bound, -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(repr, query(spark, folder).collect())) == want and want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_shards_and_groups_of_any_size_agree(spark, folder, monkeypatch):
    want = sorted(map(repr, suffix_dedup.op4_suffix_dedup(spark, folder).collect()))
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "HASH_BYTES", 50_000)
    assert sorted(map(repr, suffix_dedup.op4_suffix_dedup(spark, folder).collect())) == want
