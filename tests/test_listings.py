"""Listings are parsed record by record: a task's memory does not follow from how much its batch holds."""

import tracemalloc

import pyarrow as pa

from quernstone.operators import changes


class Frame:
    """Gives the function of ``mapInArrow`` itself."""

    def __init__(self, df):
        self.schema = df.schema

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_a_batch_of_long_listings_is_parsed_in_little_memory(spark):
    listing = "".join(f"M\0f{k}.py\0" for k in range(20_000))
    run = changes.parse_listings(Frame(spark.createDataFrame([(1, "")], "k long, listing string")), "k", "listing")
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array([listing] * 20)], names=["k", "listing"])
    tracemalloc.start()
    try:
        n = sum(out.num_rows for out in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 400_000 and peak < 12e6, peak


def test_records_are_those_of_the_listing(spark, monkeypatch):
    monkeypatch.setattr(changes, "PARSED_ROWS", 3)
    df = spark.createDataFrame([(1, "A\0a\0R100\0old\0new\0C075\0x\0y\0D\0d\0"), (2, None), (3, ""), (4, "M\0m\n\0")], "k int, listing string")
    got = sorted(tuple(r) for r in changes.parse_listings(df, "k", "listing").collect())
    assert got == [(1, 0, "A", None, "a"), (1, 1, "R", "old", "new"), (1, 2, "A", None, "y"), (1, 3, "D", None, "d"), (4, 0, "M", None, "m\n")]
