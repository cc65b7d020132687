"""What a converted archive says beyond the query's columns, and files that share a name."""

import pytest

from quernstone.llm import arc_convert


@pytest.fixture
def files(spark, tmp_path):
    """Two folders with a file of one name: pages of equal payload, a record without an HTTP header in each, servers' addresses."""
    page = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\nsame words"
    later = page.replace(b"Id: 7", b"Id: 9")
    names = []
    for folder, date, record in (("a", "20010203040506", page), ("b", "20070809101112", later)):
        uri = f"file://{tmp_path}/{folder}/x.arc"
        dns = arc_convert.arc_record("dns:a.example", date, "text/dns", b"20010203 1.2.3.4", 1)
        arc_convert._put(uri, arc_convert.arc_opening("x.arc", 1) + arc_convert.arc_record(f"http://{folder}.example/", date, "text/html", record, 1, address="192.0.2.7") + dns)
        names.append((uri,))
    return spark.createDataFrame(names, "file string")


def test_revisits_refer_to_the_date_and_place_of_the_response(files, tmp_path):
    out = arc_convert.convert_archives(files, f"file://{tmp_path}/warc")
    assert len({r["file"] for r in out.collect()}) == 2
    records = [f for r in out.collect() for f, _ in arc_convert.warc_records(arc_convert._get(r["file"])) if f["warc-type"] != "warcinfo"]
    assert len({f["warc-record-id"] for f in records}) == 4
    ids = {f["warc-record-id"]: f for f in records}
    again = [f for f in records if f["warc-type"] == "revisit"]
    assert len(again) == 2
    for f in again:
        first = ids[f["warc-refers-to"]]
        assert first["warc-type"] in ("response", "resource") and f["warc-refers-to-date"] == first["warc-date"] != f["warc-date"]
        assert f["warc-refers-to-target-uri"] == first["warc-target-uri"] and f["warc-payload-digest"] == first["warc-payload-digest"]
    assert {f.get("warc-ip-address") for f in records if f["warc-target-uri"].startswith("http")} == {"192.0.2.7"}
    assert not any("warc-ip-address" in f for f in records if f["warc-target-uri"].startswith("dns"))


def test_a_revisit_without_a_header_keeps_its_length(files, tmp_path):
    rows = arc_convert.read_warc(arc_convert.convert_archives(files, f"file://{tmp_path}/warc")).collect()
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows if r["target_uri"].startswith("http")) == [(7, 10, "response", None), (9, 10, "revisit", 7)]
    assert sorted((r["payload_bytes"], r["record_type"]) for r in rows if r["target_uri"].startswith("dns")) == [(16, "resource"), (16, "revisit")]


def test_empty_tables(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    arcs = arc_convert.write_arc(pages, f"file://{tmp_path}/arc")
    assert arcs.count() == 0
    assert arc_convert.read_warc(arc_convert.convert_archives(arcs, f"file://{tmp_path}/warc")).count() == 0
