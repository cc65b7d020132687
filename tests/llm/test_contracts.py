"""Each registered query against SQL or brute force, and the edge cases of each operator."""

import collections
import glob
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import arc_convert, decontaminate, html_extract, language_id, license_scan, near_dedup, packing, queries, suffix_dedup, url_filter, vector_lists
from quernstone.llm.common import materialise


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, folder, name):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df = queries.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = con.execute(queries.ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in got.fetchall())


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


# ---- 1


def _overlap_by_brute_force(text, item, min_words=decontaminate.MIN_WORDS, min_similar=decontaminate.MIN_SIMILAR):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    d, b = words(text), words(item)
    for shift in range(-len(b) + 1, len(d)):
        low, high = max(0, -shift), min(len(b), len(d) - shift)
        equal = np.array([d[k + shift] == b[k] for k in range(low, high)])
        if len(equal) and decontaminate.accepted(equal, len(b), min_words, min_similar):
            return True
    return False


def test_overlaps_survive_substitutions_and_spare_clean_texts(spark, prose):
    items = [(k, prose(k, 30)) for k in range(12)]
    rng = np.random.default_rng(1)
    docs = []
    for k in range(120):
        text = prose(1000 + k, 150).split()
        if k % 3 == 0:
            leak = items[k % 12][1].split()
            for at in rng.choice(30, k % 8, replace=False):
                leak[at] = "changed"
            leak = leak[:15] if k % 2 else leak
            text[40:40] = leak
        docs.append((k, " ".join(text)))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, j) for i, t in docs for j, b in items if _overlap_by_brute_force(t, b)}
    assert found == want and len(want) > 25 and {i % 3 for i, _ in want} == {0}


def test_a_larger_test_side_is_joined_with_the_same_result(spark, folder):
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    short = spark.createDataFrame([(9001, "license"), (9002, "of the"), (9003, "rights reserved by"), (9004, None), (9005, "!"), (9001, "license")], "item_id long, text string")
    docs, items = docs.unionByName(docs.limit(20)), items.unionByName(items.limit(5)).unionByName(short)
    whole = sorted(map(repr, decontaminate.find_overlaps(docs, items).collect()))
    assert decontaminate.index_of(items, 1, 300) is None and len(whole) > 20
    assert sorted(map(repr, decontaminate.find_overlaps(docs, items, block_words=300).collect())) == whole
    kept = sorted(map(repr, decontaminate.keep_clean(docs, items).collect()))
    assert sorted(map(repr, decontaminate.keep_clean(docs, items, block_words=300).collect())) == kept and 0 < len(kept) < docs.count()


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "one two three four five six seven eight"), (2, "alpha beta gamma delta epsilon"), (3, "answer"), (4, "東京は日本の首都であり世界最大の都市圏です")]
    docs = [
        (1, "so one two three FOUR changed six seven eight it goes"), (2, "one two three changed five six seven changed"), (3, "alpha beta gamma delta epsilon"), (4, "alpha beta changed delta epsilon"),
        (5, "the Answer, and answers"), (6, "その東京は日本の首都であり世界最大の都市圏ですね"), (7, "東京は日本の首都だが世界最大の都市圏です"), (8, "大阪は西日本の中心都市であり多くの人が住んでいます"),
    ]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_overlaps(docs, items).collect()}
    assert found == {(1, 1), (3, 2), (5, 3), (6, 4), (7, 4)}
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(docs, items).collect()) == [2, 4, 5, 8]


def test_a_common_seed_is_taken_in_steps(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "STEP", 50)
    phrase = "of the same old kind "
    items = [(k, f"{phrase * 4} w{k}") for k in range(30)]
    index = decontaminate.Index.of(items)
    data = (phrase * 30).encode()
    got = decontaminate.overlaps(np.frombuffer(data, np.uint8), np.array([0, len(data)]), index)
    assert sorted((t, n) for _, t, _, n, _ in got) == [(k, 20) for k in range(30)]


def test_contaminated_rows_go(spark, folder, edge_docs):
    items = spark.createDataFrame([(1, "The same text of a few words stands here twice and it is long enough"), (2, None), (3, ""), (4, "one two")], "item_id long, text string")
    kept = decontaminate.keep_clean(edge_docs, items)
    assert kept.columns == edge_docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 8]
    assert decontaminate.find_overlaps(edge_docs, items.limit(0)).count() == 0 == decontaminate.find_overlaps(edge_docs.limit(0), items).count()


# ---- 2


def test_packing_round_trip(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pieces = [r.asDict() for r in packing.pack(docs, window=4096, temper=1.0, quantum=1).collect()]
    encode = packing._encoder(packing.default_vocabulary())
    ids = {r["doc_id"]: np.array([*encode(r["text"]), 1], "<u4") for r in docs.collect()}
    own, seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        own[p["doc_id"]].append(p)
        seq[p["sequence_id"]].append(p)
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["length"] > 0 and p["doc_tokens"] == len(ids[p["doc_id"]]) and p["ids_crc32"] == zlib.crc32(part.tobytes())
    assert own.keys() == ids.keys()
    for i, parts in own.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(ids[i])
    lengths = []
    for parts in seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        lengths.append(at)
    assert sorted(seq) == list(range(len(seq))) and all(n == 2048 or n < 2048 and n & (n - 1) == 0 for n in lengths)
    # each window of output holds each large source by its share, to a token
    total = sum(map(len, ids.values()))
    by_source = collections.Counter()
    for p in pieces:
        by_source[p["source"]] += p["length"]
    windows = -(-total // 4096)
    for s in [s for s, n in by_source.items() if n * 64 >= total]:
        cuts = np.zeros(total + 1, np.int64)
        for p in pieces:
            if p["source"] == s:
                begin = (p["sequence_id"] * 2048 if p["sequence_id"] < total // 2048 else total // 2048 * 2048 + sum(n for k, n in _tail(seq, total) if k < p["sequence_id"])) + p["offset"]
                cuts[begin : begin + p["length"]] = 1
        given = [int(cuts[4096 * w : 4096 * (w + 1)].sum()) for w in range(windows - 1)]
        assert max(given) - min(given) <= 2 + len(by_source)


def _tail(seq, total):
    return [(k, sum(p["length"] for p in parts)) for k, parts in seq.items() if k >= total // 2048]


def test_deficit_round_robin_in_closed_form():
    """The plan's arithmetic: every token in one place, and no queue a quantum away from its share."""
    totals, window, quantum = [10_000, 10, 3_770, 1, 650], 512, 32
    plan = packing.Plan(totals, packing.rates_of([(str(k), n) for k, n in enumerate(totals)], None, 0.7), window, quantum)
    places = [None] * sum(totals)
    for q, n in enumerate(totals):
        for begin, length, pos in packing.Plan.spans(plan, q, 0, n):
            for k in range(length):
                assert places[pos + k] is None
                places[pos + k] = (q, begin + k)
    assert None not in places
    for q, n in enumerate(totals):  # in order, and the same from any start
        assert [b for p, b in places if p == q] == list(range(n))
        for begin in range(0, n, 997):
            (at, _, pos), *_ = plan.spans(q, begin, min(40, n - begin))
            assert places[pos] == (q, begin) and at == begin


@pytest.mark.parametrize("sources", [20, 100, 10_000])
def test_each_single_window_has_the_target_proportions(sources):
    """Windows as they lie in the output, each of just so many tokens, against the shares of the queues that are not dry yet."""
    rng = np.random.default_rng(5)
    totals = np.maximum(1, (rng.pareto(1.1, sources) * 4000).astype(int)).tolist()
    quantum = 64
    window = packing.window_for(sources, 256, 4096, quantum)
    assert window % 256 == 0 and window >= sources * quantum
    plan = packing.Plan(totals, packing.rates_of([(str(k), n) for k, n in enumerate(totals)], None, 0.7), window, 1)
    full = sum(totals) // window
    assert full >= 4
    got = np.zeros((full + 1, sources), np.int64)
    for q, n in enumerate(totals):
        for _, length, pos in plan.spans(q, 0, n):
            while length:
                w = min(pos // window, full)
                cut = min(length, (w + 1) * window - pos) if w < full else length
                got[w, q] += cut
                pos, length = pos + cut, length - cut
    assert (got[:full].sum(axis=1) == window).all() and (got.sum(axis=0) == totals).all()
    rates, t = plan.rates, np.array(totals)
    for w in range(full):
        due = np.minimum(t, rates * plan.time(w + 1)) - np.minimum(t, rates * plan.time(w))
        assert np.abs(got[w] - due).sum() / 2 / window <= 2 * sources / window + 1e-9 <= 2 / quantum + 1e-9


@pytest.mark.parametrize("sources", [3, 100, 10_000])
def test_every_window_keeps_the_target_proportions(sources):
    """Counters carried from window to window by hand, at the rates of the queues that are not dry, against the closed form."""
    rng = np.random.default_rng(sources)
    totals = [int(n) for n in rng.integers(300, 3_000, sources)]
    totals[0] = sum(totals) // 2  # one source has a third of all
    quantum, window = 128, 2048
    plan = packing.Plan(totals, packing.rates_of([(str(k), n) for k, n in enumerate(totals)], None, 0.7), window, quantum)
    rates, left, due = np.array(totals, float) ** 0.7, np.array(totals, float), np.zeros(sources)
    assert plan.windows == -(-sum(totals) // window)
    for w in range(1, plan.windows):
        room = float(window)
        while room > 1e-6 and left.max() > 1e-9:  # a queue that runs dry leaves its share to the others
            flow = np.where(left > 1e-9, rates, 0)
            step = min(room / flow.sum(), (left[flow > 0] / flow[flow > 0]).min())
            due += flow * step
            left = np.maximum(left - flow * step, 0)
            room -= (flow * step).sum()
        if w % max(1, plan.windows // 200) == 0 or w == plan.windows - 1:
            given = np.array(plan.given(w)[0])
            assert (np.abs(given - due) <= quantum + 1).all()
    assert list(plan.given(plan.windows)[0]) == totals


def test_given_shares_hold_until_a_queue_is_dry():
    found = [("a", 30_000), ("b", 90_000), ("c", 5_000), (None, 5_000)]
    rates = packing.rates_of(found, {"a": 0.5, "b": 0.25, "*": 0.25}, 0.7)
    assert rates == [0.5, 0.25, 0.125, 0.125]
    plan = packing.Plan([n for _, n in found], rates, 2048, 128)
    amount, _ = plan.given(9)
    assert all(abs(a - 9 * 2048 * r) <= 129 for a, r in zip(amount, rates, strict=True))
    with pytest.raises(ValueError):
        packing.rates_of(found, {"a": 1.0}, 0.7)


def test_more_sources_than_queues(spark):
    """Beyond the bound queues are groups of sources, in which each source still takes its turns."""
    docs = spark.createDataFrame([(k, " ".join(f"word{k % 7}" for _ in range(40 + k % 50)), f"s{k % 60}" if k % 60 else None) for k in range(600)], "doc_id long, text string, source string").repartition(3)
    options = {"seq_len": 256, "window": 256, "quantum": 16}
    for queues in (1000, 7):
        rows = packing.pack(docs, max_queues=queues, **options).collect()
        seen = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
        at = [0, 0]
        for s, o, n in seen:
            assert (s, o) == (at[0], at[1]) or (s, o) == (at[0] + 1, 0)
            at = [s, o + n]
        by_doc = {}
        for r in rows:
            by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
        assert len(by_doc) == 600
        for (_, n), parts in by_doc.items():
            place = 0
            for start, length in sorted(parts):
                assert start == place
                place += length
            assert place == n
        first = {r["source"] for r in rows if r["sequence_id"] < 8}
        assert len(first) >= 45  # 2,048 tokens: all sources are due by then, but for less than a quantum


def test_packing_edges(spark, edge_docs):
    rows = packing.pack(edge_docs).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) > 5_000
    assert sum(r["length"] for r in rows if r["doc_id"] == 3) == 1 == sum(r["length"] for r in rows if r["doc_id"] == 4)
    assert sum(r["length"] for r in rows if r["doc_id"] == 2) == 2 * sum(r["length"] for r in rows if r["doc_id"] == 1)
    assert packing.pack(edge_docs.limit(0)).count() == 0


def test_both_encoders_agree(spark, folder):
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(packing.default_vocabulary()), packing._encoder(packing.default_vocabulary())
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()] + ["a <|endoftext|> b", "", "日本語 \u2028 don't  x\t\t y", "\x00\x01"]
    assert all(slow.encode(t, add_special_tokens=False).ids == fast(t) for t in texts)


# ---- 3


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, tmp_path, version):
    rows = [(3, "http://a/x y", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://b", None), (None, "http://c", ""), (5, "http://d", "x\n\nHTTP/1.1\r\n\r\n" * 3000), (3, "http://a", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    arcs = arc_convert.write_arc(pages, f"file://{tmp_path}/arc", version=version, roll_bytes=200)
    got = arc_convert.read_warc(arc_convert.convert_archives(arcs, f"file://{tmp_path}/warc")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["payload_digest"]].append(r)
    assert len(got) == 6 and sorted(len(v) for v in by.values()) == [1, 2, 3]
    same = by[arc_convert.sha1_base32("<p>é</p>".encode())]
    assert [(r["page_id"], r["refers_to"]) for r in same if r["record_type"] == "response"] == [(1, None)] and [r["refers_to"] for r in same if r["record_type"] == "revisit"] == [1, 1]
    empty = by[arc_convert.sha1_base32(b"")]
    assert {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in empty} == {(2, "response", None, 0), (None, "revisit", 2, 0)}
    assert len({r["record_id"] for r in got}) == 6


def test_archive_parsing():
    body = b"HTTP/1.0 200 OK\r\n\r\nhi"
    plain = arc_convert.arc_opening("x.arc", 1) + arc_convert.arc_record("http://a b", "20010203", "text/html", body, 1) + arc_convert.arc_record("dns:a", "2001", "text/dns", b"1.2.3.4", 1)
    assert list(arc_convert.arc_records(plain)) == [("http://a%20b", "20010203", "text/html", body), ("dns:a", "2001", "text/dns", b"1.2.3.4")]
    assert arc_convert.iso_date("20010203040506") == "2001-02-03T04:05:06Z" and arc_convert.iso_date("2001") == "2001-01-01T00:00:00Z"
    with pytest.raises(ValueError, match="declares"):
        list(arc_convert.arc_records(plain[:-4]))
    with pytest.raises(ValueError, match="version"):
        list(arc_convert.arc_records(arc_convert.arc_opening("x", 2) + arc_convert.arc_record("http://a", "2001", "t", b"x", 1)))
    assert list(arc_convert.members(arc_convert._member(b"a") + arc_convert._member(b"b" * 100_000))) == [b"a", b"b" * 100_000]


# ---- 4


def _repeats_by_brute_force(docs, length):
    seen, out = {}, {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        b = (text or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen.setdefault(b[p : p + length], i) < i:
                cover[p : p + length] = b"\1" * length
        kept = bytes(c for c, f in zip(b, cover, strict=True) if not f)
        out[i] = (len(b), sum(cover), sum(1 for k in range(len(cover)) if cover[k] and (not k or not cover[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_arrays_and_prefixes():
    rng = np.random.default_rng(4)
    for _ in range(150):
        a = rng.integers(0, rng.integers(1, 5), rng.integers(1, 70)).astype(np.uint16)
        sa = suffix_dedup.suffix_array(a, 5)
        assert sa.tolist() == sorted(range(len(a)), key=lambda i, a=a: a[i:].tolist())
        p = suffix_dedup.permuted_prefixes(a, sa)
        for r in range(1, len(a)):
            x, y = a[sa[r - 1] :], a[sa[r] :]
            n = min(len(x), len(y))
            same = x[:n] == y[:n]
            assert p[sa[r]] == (n if same.all() else int(np.argmin(same)))


def test_repeats_on_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = _repeats_by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], 50)
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.op4_suffix_dedup(spark, folder).collect()} == want


def test_repeats_with_overlaps_and_periods(spark, prose):
    p = [prose(k, 40, 50) for k in range(6)]
    docs = [(1, p[0] + p[1]), (2, "x" + p[1] + p[0] + p[2]), (9, p[2][5:120] + p[3]), (4, "ab" * 300), (5, "b" + "ab" * 100), (7, p[3] + "ba" * 60 + p[2]), (8, "z" * 49), (10, "z" * 49), (11, p[0][:49] + "q" + p[0][50:99])]
    rows = suffix_dedup.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == _repeats_by_brute_force(docs, 50)


def test_repeats_edges(spark, edge_docs):
    rows = suffix_dedup.repeats(edge_docs).collect()
    assert len(rows) == 10 and {r["n_removed"] for r in rows if r["doc_id"] == 2} == {87} and {r["n_removed"] for r in rows if r["doc_id"] != 2} == {0}
    cut = suffix_dedup.cut_repeats(edge_docs)
    assert cut.columns == edge_docs.columns and cut.dtypes == edge_docs.dtypes
    before, after = edge_docs.collect(), cut.collect()
    assert sorted(repr(r) for r in after if r["doc_id"] != 2) == sorted(repr(r) for r in before if r["doc_id"] != 2)
    assert {(r["text"], r["n_chars"]) for r in after if r["doc_id"] == 2} == {("", 0)}
    assert suffix_dedup.repeats(edge_docs.limit(0)).count() == 0 == suffix_dedup.cut_repeats(edge_docs.limit(0)).count()


def test_cut_keeps_whole_characters(spark):
    line = "é" * 40
    rows = suffix_dedup.cut_repeats(spark.createDataFrame([(1, "a" + line + "b"), (2, "ê" + line + "ç")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {1: "a" + line + "b", 2: "êç"}


# ---- 5


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and {r["held_out"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1} == {True}
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["rejected"] for r in rows]) < 0.01


def test_language_edges(spark, edge_docs):
    model = language_id.train(["the and of " * 9, "le et la " * 9] * 20, ["en", "fr"] * 20, steps=100)
    rows = language_id.identify(edge_docs, model).collect()
    assert len(rows) == 10 and {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {3, 4, 7, 8} and all(r["rejected"] and r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    kept = language_id.keep_identified(edge_docs, model)
    assert kept.columns == edge_docs.columns and {3, 4, 7, 8}.isdisjoint(r["doc_id"] for r in kept.collect())
    none = language_id.fit(edge_docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(edge_docs, none).collect()} == {"und"}
    assert language_id.fit(edge_docs).labels and language_id.identify(edge_docs.limit(0), model).count() == 0


def test_subwords_stay_within_words_and_rows():
    data = np.frombuffer(b"ab c" + b"de", np.uint8)
    found, starts = language_id.subwords(data, np.array([0, 4, 6]), 1 << 20)
    assert starts.tolist() == [0, 5] and [len(at) for at, _ in found] == [8, 5, 2]


# ---- 6


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 16))
    v = centre[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 16))
    v[100:180] = v[100]  # ties
    return v


def _nearest_by_brute_force(v, q, k=20):
    s = (v * v[q]).sum(axis=1)
    s[q] = -np.inf
    return np.lexsort((np.arange(len(v)), -s))[:k], s


def test_recall_and_order(spark, vectors):
    df = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = vector_lists.nearest(df, F.pmod(F.col("i"), F.lit(20)) == 0, target=0.98).collect()
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 3000, 20):
        best, s = _nearest_by_brute_force(vectors, q)
        assert [x[0] for x in got[q]] == list(range(1, 21))
        assert all(abs(score - s[i]) < 1e-12 for _, i, score in got[q]) and [(-x[2], x[1]) for x in got[q]] == sorted((-x[2], x[1]) for x in got[q])
        hit += len(set(best.tolist()) & {x[1] for x in got[q]})
    assert hit / (150 * 20) >= 0.95


def test_recall_on_the_table(spark, folder):
    rows = vector_lists.op6_vector_lists(spark, folder).collect()
    table = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect())
    v, ids = np.array([x[1] for x in table]), [x[0] for x in table]
    want = {(ids[q], ids[i]) for q in range(len(v)) if ids[q] % 20 == 0 for i in _nearest_by_brute_force(v, q)[0]}
    assert len(want & {(r["query_id"], r["vec_id"]) for r in rows}) / len(want) >= 0.9


def test_vector_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (40, [float("inf"), 1.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("list", F.lit(2))
    got = sorted(tuple(r) for r in vector_lists.nearest(df, F.col("i") % 20 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 2, 0.5)]
    assert vector_lists.nearest(df.limit(0), F.col("i") % 20 == 0).count() == 0


def test_lists_are_balanced_and_graph_finds_them(vectors):
    lists = vector_lists.fit(vectors, float(np.linalg.norm(vectors, axis=1).max()), len(vectors), list_rows=50)
    x = lists.lifted(vectors)
    assert np.allclose((x * x).sum(axis=1), 1)
    ids, _ = vector_lists.search_graph(lists, x[:300], 5)
    exact = np.argsort(vector_lists._squares(x[:300], lists.centroids), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids.tolist(), exact.tolist(), strict=True)]) > 0.95
    sizes = np.bincount([t[0] for t in vector_lists.posted(lists, x, 0.1, 4)], minlength=len(lists.centroids))
    assert sizes.max() <= 6 * sizes.mean()


# ---- 7


def test_url_rules_and_terms(spark):
    cases = {
        "http://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/", "allow"), "http://a.example.net/de/": ("a.example.net", "/de/", "net/", "block"), "http://net": ("net", "", None, "allow"),
        "https://x.example.com/de/1": ("x.example.com", "/de/1", "example.com/de/", "block"), "https://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"), "x://q.org/fr/casino": ("q.org", "/fr/casino", "org/fr/", "allow"),
        "http://a.com/casino": ("a.com", "/casino", None, "block"), "http://a.com/casinos": ("a.com", "/casinos", None, "block"), "http://a.com/casinova": ("a.com", "/casinova", None, "allow"), "http://ads.a.com/track": ("ads.a.com", "/track", None, "block"), "http://ads.ads.com/": ("ads.ads.com", "/", None, "allow"),
        "no scheme/xxx": ("", "", None, "block"), "": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://É.net/": ("É.net", "/", "net/", "block"),
    }
    df = spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "page_id long, url string").withColumn("host", F.lit("x")).withColumn("u", F.lit(1))
    rows = url_filter.judge_urls(df).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows] == list(cases.values())
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_url_weights_escapes_long_and_repeated(spark):
    cases = {
        "http://a.com/best%20casino": "block", "http://a.com/%43asin%6F/": "block", "http://a.com/caf%C3%A9casino": "block", "http://a.com/%-casino%": "block",
        "http://a.com/free": "allow", "http://free-bets.a.com/": "block", "http://bets.a.com/betting": "allow", "http://free.a.com/download": "allow", "http://cheap-pills.a.com/": "block",
        "http://buy.a.com/deal?sale=cash": "allow", "http://a.com/buy/deal/sale/cash/money": "block", "http://a.com/freecasino": "block", "http://a.com/casinoville": "allow", "http://a.com/essex/sextant": "allow",
        "http://a.com/" + "x" * 2_000_000 + "/casino": "block", "http://a.com/" + "nothing/" * 200_000: "allow",
    }
    df = spark.createDataFrame([(k, u) for k, u in enumerate(cases)] * 2, "page_id long, url string")
    rows = url_filter.judge_urls(df).orderBy("page_id").collect()
    assert [r["verdict"] for r in rows] == [v for v in cases.values() for _ in range(2)]
    terms = url_filter.vocabulary()
    assert sum(len(t.forms) for t in terms) > 250 and all(t.tenths <= 10 and t.tenths for t in terms)
    assert all(not t.strict for t in terms[len(url_filter.STRICT.split()) :])
    own = url_filter.read_vocabulary(spark.createDataFrame([("nothing", 10)], "term string, tenths int"))
    assert [r["verdict"] for r in url_filter.judge_urls(df.limit(16), terms=own).orderBy("page_id").collect()][-1] == "block"
    assert url_filter.judge_urls(df, terms=()).where("verdict = 'block'").count() == 0


# ---- 8


PAGES = {
    "": "", None: "", "<p>Hi": "Hi", "<p>a <": "a <", "plain &lt;b&gt; text": "plain <b> text",
    "<body><nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>One  <b>two</b>\n three.<p>Four<div class='ad'>Buy</div><ul><li>five</li><li>six</ul></article><footer>foot</footer></body>": "T & U\nOne two three.\nFour\nfive\nsix",
    "<html><body><div id=content><h1>A title</h1><p>Some text &amp; more words of it</p><aside>side</aside><form><p>mail</p></form><p>End of the text</p><div class=\"comments\"><p>first comment by a reader who writes a long text again and again</p></div></div></body>": "A title\nSome text & more words of it\nEnd of the text",
    "<article><p>x<script>var p='</p><p>no';</script><style>p{}</style><!-- <p>no</p> -->y</p><section id=comments><article>c</article></section></article>": "xy",
    "<form id=aspnetForm><div class='nav'>Menu</div><div class='content with-sidebar'><p>The whole page stands in a form and is its text.</p></div></form>": "The whole page stands in a form and is its text.",
    "<div class=post><h1>Title here</h1><p>Body text <a href=x>with a link</a>, and <em>em</em>phasis.</p></div><div class='comments-area'><p>a reader says many many words to be long</p></div><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul>": "Title here\nBody text with a link, and emphasis.",
    "<main><header>Site</header><p>body text here</p><div role=alert>cookie</div></main>": "Site\nbody text here",
}


def test_main_text(spark):
    assert {p: html_extract.extract(p) for p in PAGES} == PAGES
    df = spark.createDataFrame([(k, None, p) for k, p in enumerate(PAGES)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = html_extract.extract_pages(df).orderBy("page_id").collect()
    assert [(r["text"], r["n_chars"]) for r in rows] == [(t, len(t)) for t in PAGES.values()]
    assert html_extract.extract_pages(df.limit(0)).count() == 0
    assert html_extract.extract("<p>" + "word " * 200_000).count("word") == 200_000


def test_the_best_run_is_the_maximum():
    rng = np.random.default_rng(8)
    for _ in range(200):
        s = rng.integers(-5, 6, rng.integers(1, 15)).tolist()
        a, b = html_extract.best_run(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
    w = dict(zip(html_extract.FEATURES, html_extract.weights(), strict=True))
    assert w["paragraph"] > 0 > w["tag-block"] and w["tag-inline"] < 0


def test_pages_of_the_table(spark, folder):
    rows = html_extract.op8_html_text(spark, folder).collect()
    assert len(rows) == 50 and all(r["text"] and "track(" not in r["text"] and "©" not in r["text"] for r in rows)


# ---- 9


def _components(texts, percent):
    lower = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_on_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = _components([(r["doc_id"], r["text"]) for r in docs.collect()], 85)
    rows = near_dedup.op9_near_dedup(spark, folder).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


@pytest.mark.parametrize("block", [512, 16])
def test_near_copies_of_one_text_in_blocks(spark, prose, block):
    """A large group of near copies at all distances, small blocks and large ones."""
    rng = np.random.default_rng(9)
    base = prose(1, 160).split()
    docs = []
    for k in range(120):
        w = list(base)
        for at in rng.choice(160, k % 7, replace=False):
            w[at] = f"new{rng.integers(1e9)}"
        docs.append((k * 3 % 997, " ".join(w)))
    docs += [(2000 + k, docs[k][1].upper()) for k in range(20)] + [(3000, "a b c"), (3001, "A b  c"), (3002, "a b"), (3003, ""), (3004, None)]
    want = _components(docs, 85)
    rows = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), block=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert len({c for _, c in want.values()}) > 10 and want[3001] == (1, 3000) and want[3004] == (0, 3004)


def test_sketches_estimate_similarity_and_fill(prose):
    words = prose(5, 400).split()
    for share in (0.5, 0.8, 0.95):
        a, b = " ".join(words), " ".join(words[: int(400 * share)])
        from quernstone.llm.common import flat_text
        import pyarrow as pa

        o, d = flat_text(pa.array([a, b, "x"]))
        s, off = near_dedup.shingle_sets(d, o)
        sk = near_dedup.sketches(s, off, 512)
        sets = [set(s[x:y].tolist()) for x, y in zip(off[:-1], off[1:], strict=True)]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        assert abs((sk[0] == sk[1]).mean() - true) < 0.09 and (sk != 2**64 - 1).all()


def test_near_duplicate_edges(spark, edge_docs):
    rows = near_dedup.near_duplicates(edge_docs).collect()
    assert len(rows) == 10 and {r["component_id"] for r in rows if r["doc_id"] == 2} == {1} and [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    kept = near_dedup.keep_representatives(edge_docs)
    assert kept.columns == edge_docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    assert near_dedup.near_duplicates(edge_docs.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500 - k, 499 - k) for k in range(20)]
    rows = near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["i"]: r["c"] for r in rows} == {**dict.fromkeys(range(1, 201), 0), **dict.fromkeys(range(481, 501), 480)}


# ---- 10


def test_license_phrases_and_spans(spark, edge_docs):
    texts = {
        1: ("CC-BY and cc by nc, all rights\nreserved.", 9, 3, 0, 6, "cc-by,reserved"), 2: ("the GNU General Public License version 3", 7, 1, 2, 2, "gpl"), 3: ("cc", 1, 0, None, None, ""), 4: ("general public licence all rights", 5, 0, None, None, ""),
        5: ("xcc by", 2, 0, None, None, ""), 6: ("cc éby", 2, 0, None, None, ""), 7: ("ccé by", 2, 0, None, None, ""), 8: ("cc by cc by", 4, 2, 0, 2, "cc-by"),
    }
    rows = license_scan.scan_licenses(spark.createDataFrame([(k, v[0]) for k, v in texts.items()], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows} == {k: v[1:] for k, v in texts.items()}
    near = "this program is a free software you can redistribute it and or modify under the terms of the gnu general public license"
    own = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(spark.createDataFrame([(1, "so: Released under the MIT License."), (2, near), (3, "released under the license"), (4, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")).collect()}
    assert own == {1: "mit", 2: "gpl", 3: "", 4: "cc-by,cc-by-nc"}
    rows = license_scan.scan_licenses(edge_docs).collect()
    assert len(rows) == 10 and [r["n_base"] for r in rows if r["doc_id"] == 6] == [4] and license_scan.scan_licenses(edge_docs.limit(0)).count() == 0


def test_scratch_tables_are_on_the_shared_folder(spark):
    df = materialise(spark.range(3), "t")
    assert df.count() == 3 and "/shared" in df.inputFiles()[0]


@pytest.mark.parametrize(("master", "own"), [("local", True), ("local[8]", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False)])
def test_only_a_local_master_gets_a_folder_of_its_own(master, own):
    from types import SimpleNamespace

    from quernstone.llm.common import shared_root

    unset = SimpleNamespace(get=lambda name, default: default)
    session = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(applicationId=f"app-{master}", master=master))
    if own:
        assert shared_root(session) == shared_root(session)
    else:
        with pytest.raises(ValueError):
            shared_root(session)


def test_whole_licence_texts_and_templates_from_a_table(spark):
    """Texts of any length, with changed, left out and added words; a scan in Python of every diagonal says the same."""
    import random

    by = {t.label: t for t in license_scan.TEMPLATES}
    rng = random.Random(10)

    def changed(text, share):
        return " ".join(rng.choice([w, "changed", f"{w} and", ""]) if rng.random() < share else w for w in text.split())

    own = " ".join(f"term{rng.randrange(400)}" for _ in range(700))
    docs = {
        1: f"Copyright 2020 A. Person\n\n{by['mit-text'].text}", 2: changed(by["mit-text"].text, 0.05), 3: by["mit-text"].text[:500], 4: by["bsd-3-clause-text"].text.replace("Neither", "Not"),
        5: by["bsd-3-clause-text"].text, 6: "prose " * 300 + changed(own, 0.04) + " prose" * 300, 7: " ".join(own.split()[:500]), 8: by["apache-2.0-notice"].text, 9: by["gpl-3.0-notice"].text, 10: "ISC " + by["isc-text"].text + by["zlib-text"].text,
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {r["doc_id"]: set(r["labels"].split(",")) for r in license_scan.scan_licenses(df).collect()}
    assert {"mit-text", "mit"} <= found[1] and "mit-text" in found[2] and found[3] == {"mit"} and "bsd-3-clause-text" not in found[4] and "bsd" in found[4]
    assert {"bsd", "bsd-3-clause-text"} <= found[5] and {"apache-2.0", "apache-2.0-notice"} <= found[8] and {"gpl", "gpl-3.0-notice"} <= found[9] and {"isc-text", "zlib-text"} <= found[10]
    table = spark.createDataFrame([("own", own, None), ("keyed", own + " Lastword", "LASTWORD"), ("short", "a b", None)], "label string, text string, key string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan_licenses(df, templates=table).collect()}
    assert got[6][0] == "own" and 0.9 < got[6][1] < 1 and got[7][0] == "" and got[1][0] == ""
    held = license_scan.BROADCAST_GRAMS
    license_scan.BROADCAST_GRAMS = 10
    try:
        assert {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan_licenses(df, templates=table).collect()} == got
    finally:
        license_scan.BROADCAST_GRAMS = held
    # the table's way of making k-grams is the list's way
    some = [t for t in license_scan.TEMPLATES]
    rows = license_scan.read_templates(spark.createDataFrame([(t.label, t.text, t.key) for t in some], "label string, text string, key string")).collect()
    strip = lambda rows: sorted(repr(tuple(r)[1:]) for r in rows)
    assert strip(rows) == strip(r for r in license_scan.gram_rows() if not r[1])
