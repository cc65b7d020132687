"""Each stage of the pipeline against a brute-force version of it, on its own input."""

import hashlib
import random
import re
import zlib

import corpus_pipeline as pipeline
import numpy as np
import pytest
from quernstone.llm import language_id, near_dedup, packing

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """Prose with copies, near copies, shared passages and leaked benchmark items."""
    rng = random.Random(12)
    words = "the of and to in a is that for it on was with as by are at from this be have not or an but they which we you all their can had".split() + [f"{a}{b}" for a in ("tr", "pl", "st", "gr", "br") for b in ("and", "own", "ing", "ead", "oom", "ent")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").limit(5).collect()]
    shared = prose(40)
    texts = [prose(rng.randrange(30, 120)) for _ in range(40)]
    texts += [texts[3], texts[3], " ".join([*texts[5].split()[:-1], "else"]), f"{prose(20)} {shared} {prose(20)}", f"{prose(25)} {shared} {prose(9)}", f"{prose(30)} {items[0]} {prose(30)}", f"{prose(10)} {items[1].upper()} {prose(8)}", "short text"]
    return spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_near_duplicates(spark, docs):
    kept = rows(pipeline.drop_near_duplicates(spark, docs, FOLDER))
    sets = {}
    for i, t in rows(docs).items():
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    smallest = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    smallest[a] = smallest[b] = min(smallest[a], smallest[b])
    assert set(kept) == {i for i in sets if smallest[i] == i} and len(kept) < len(sets)


def test_repeated_strings(spark, docs):
    cut, texts = rows(pipeline.cut_repeats(spark, docs, FOLDER)), rows(docs)
    for i, text in texts.items():
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - 49):
            if any(j < i and text[p : p + 50] in other for j, other in texts.items()):
                gone[p : p + 50] = True
        assert cut[i] == "".join(c for c, g in zip(text, gone, strict=True) if not g)
    assert cut != texts


def test_decontamination(spark, docs):
    items = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", r["text"].lower()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept, texts = rows(pipeline.decontaminated(spark, docs, FOLDER)), rows(docs)

    def leaked(text):
        d = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
        for b in items:
            for shift in range(-len(b) + 13, len(d) - 12):
                low, high = max(0, -shift), min(len(b), len(d) - shift)
                equal = [d[k + shift] == b[k] for k in range(low, high)]
                total = np.concatenate([[0], np.cumsum(np.array(equal) * 10 - 7)])
                if len(equal) >= 13 and (total[13:] - np.minimum.accumulate(total)[: len(total) - 13]).max() >= 0:
                    return True
        return False

    assert set(kept) == {i for i, t in texts.items() if not leaked(t)} and len(kept) == len(texts) - 2


def test_language(spark, docs):
    """The stage's rows are those that a model fitted on the same rows does not reject, text by text."""
    mixed = docs.unionByName(spark.createDataFrame([(900, "1234 !!", None, "x", 7), (901, None, None, None, None), (902, "щука рыба лес река дом мост", None, "x", 27)], docs.schema))
    kept = rows(pipeline.identify_language(spark, mixed, FOLDER))
    judged = {r["doc_id"]: r["rejected"] for r in language_id.identify(mixed, language_id.fit(mixed)).collect()}
    assert set(kept) == {i for i, gone in judged.items() if not gone} and {900, 901, 902}.isdisjoint(kept) and len(kept) >= 45


def test_packing(spark, docs):
    encode = packing._encoder(packing.default_vocabulary())
    ids = {i: np.array([*encode(t), 1], "<u4") for i, t in rows(docs).items()}
    pieces = sorted(pipeline.pack(spark, docs, FOLDER).collect(), key=lambda r: (r["doc_id"], r["start"]))
    at = dict.fromkeys(ids, 0)
    for r in pieces:
        assert r["start"] == at[r["doc_id"]] and r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        at[r["doc_id"]] += r["length"]
    assert at == {i: len(x) for i, x in ids.items()}


def test_edge_rows_reach_every_stage(spark, edge_docs):
    for name, stage in pipeline.STAGES:
        got = stage(spark, edge_docs, FOLDER).collect()
        if name == "packing":
            assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, 6, 7, 8, None}
            assert sum(r["length"] for r in got if r["doc_id"] == 5) > 5_000


def test_other_queries_keep_their_tables(spark, docs):
    """A lazy result of an operator outlives the pipeline's stages."""
    groups = near_dedup.near_duplicates(docs)
    first = hashlib.sha256("".join(map(repr, sorted(groups.collect()))).encode()).hexdigest()
    pipeline.run(spark, FOLDER).count()
    assert hashlib.sha256("".join(map(repr, sorted(groups.collect()))).encode()).hexdigest() == first


def test_dotted_and_clashing_names_pass_all_stages(spark, folder, edge_docs):
    docs = edge_docs.selectExpr("*", "1 AS `a.b`", "2 AS _null", "3 AS `null`", "4 AS c0", "5 AS `x``y`", "6 AS _lang", "7 AS k", "8 AS _below")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert name == "language id" or {(r["a.b"], r["_null"], r["null"], r["c0"], r["x`y"]) for r in rows} == {(1, 2, 3, 4, 5)}, name
    assert pipeline.STAGES[-1][1](spark, docs, folder).count() > 0
