"""Texts of no learned language are rejected, clean ones stay."""

import numpy as np
import pytest

from quernstone.llm import language_id


def _texts(alphabet, n=100, seed=4):
    rng = np.random.default_rng(seed)
    return [" ".join("".join(rng.choice(list(alphabet), rng.integers(2, 9))) for _ in range(60)) for _ in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")


def _rejected(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return np.mean([r["rejected"] for r in language_id.identify(docs, model).collect()])


def test_foreign_and_random_texts_are_rejected(spark, table):
    model = language_id.fit(table)
    for alphabet in ("абвгдежзийклмнопрстуфхцчшщыэюя", "的一是不了人我在有他这为之大来以个中上们", "bcdfghjklmnpqrstvwxz"):
        assert _rejected(spark, model, _texts(alphabet)) == 1
    held = [r["text"] for r in table.where(language_id.held_out(table["doc_id"])).collect() if r["text"]]
    long = [t for t in held if len(t) > 200]
    rng = np.random.default_rng(9)
    assert _rejected(spark, model, [language_id._shuffled(t, rng) for t in long[:300]]) > 0.95
    print("clean", _rejected(spark, model, held), "short", _rejected(spark, model, [t[:20] for t in long]), "words", _rejected(spark, model, [t.split()[0] for t in long]))
    assert _rejected(spark, model, held) < 0.005
    assert _rejected(spark, model, [t[:20] for t in long]) < 0.02


def test_an_unlearned_language_is_rejected(spark, table):
    model = language_id.fit(table.where("lang <> 'de'"))
    rows = [(r["lang"], r["text"]) for r in table.where(language_id.held_out(table["doc_id"])).collect() if r["text"] and len(r["text"]) > 200]
    a, b = _rejected(spark, model, [t for lang, t in rows if lang == "de"]), _rejected(spark, model, [t for lang, t in rows if lang != "de"])
    print("foreign", a, "learned", b)
    assert a > 0.9 and b < 0.01


def _plainly(model, text):
    """(label, score, rejected) of one text, subword by subword in Python integers."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0, True
    low = "".join(c.lower() if "A" <= c <= "Z" or "\u00c0" <= c <= "\u00de" and c != "\u00d7" else c for c in text)
    raw = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in low.encode())
    mask, rows = (1 << 64) - 1, []
    for word in raw.split():
        word = b" " + word + b" "
        for k in language_id.ORDERS:
            for a in range(len(word) - k + 1):
                h = int(language_id._T[word[a]])
                for b in word[a + 1 : a + k]:
                    h = (h * int(language_id._STEP) & mask) ^ int(language_id._T[b])
                rows.append(int(language_id.mix64(np.array([h], np.uint64))[0]) % model.buckets)
    if not rows:
        mean, n = np.zeros(model.table.shape[1]), 0
    else:
        mean, n = model.table[rows].astype(float).mean(axis=0), len(rows)
    z = (mean[:-1] + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    known = float(model.known(mean[-1:], np.array([n]))[0])
    return model.labels[int(p.argmax())], float(p.max()) * known, bool(p.max() < model.reject_below or known < 0.5)


def test_the_query_against_a_plain_reading_of_the_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()} | {-1: None, -2: "", -3: "12 !?", -4: "É", -5: "ÀÉÎ ×÷ Žluťoučký"}
    rows = language_id.identify(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()
    for r in rows:
        if r["doc_id"] < 0 or len(texts[r["doc_id"]]) < 4_000:
            lang, score, rejected = _plainly(model, texts[r["doc_id"]])
            assert (r["lang_pred"], r["rejected"]) == (lang, rejected) and abs(r["score"] - score) < 1e-6
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.op5_language_id(spark, "/root/testdata/sf0.001").collect()}
    assert all(again[r["doc_id"]] == (r["lang_pred"], r["score"]) for r in rows if r["doc_id"] >= 0)


def test_scores_are_calibrated(table):
    model = language_id.fit(table)
    print("calibration error", model.calibration_error)
    assert model.calibration_error < 0.06 and 0.06 < model.temperature < 19
    held = [(r["text"], r["lang"]) for r in table.where(language_id.held_out(table["doc_id"])).collect() if r["text"] and r["lang"]]
    mean, count = language_id._means(model.table, [t for t, _ in held])
    p = language_id._softmax((mean[:, :-1] + model.bias) / model.temperature)
    right = np.array([model.labels[k] == lang for k, (_, lang) in zip(p.argmax(axis=1), held, strict=True)])
    keep = (p.max(axis=1) >= model.reject_below) & (model.known(mean[:, -1], count) >= 0.5)
    print("held", right.mean(), "kept", keep.mean(), "error of the softmax", language_id.expected_error(p.max(axis=1), right))
    assert right.mean() > 0.99 and keep.mean() > 0.99


FOREIGN = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
    "base64": "U2FsdGVkX1+vupppZksvRf5pq5g5XjFRlipRkwB0K1Y96Qsv2Lm+31cmzaAILwytX/z66ZVWEQM/ccf1g+9m5Ubu1+sit+A9",
    "code": 'def f(x): return [g(y) for y in x if y is not None] # int main(void) { printf("%d", x); return 0; }',
    "keys": "xkq zvbw qqrt plmk wzzt vbnm ghjk qwrt zxcv bnmk ljhg",
}


def test_the_pipeline_stage_drops_junk_and_keeps_clean_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    junk = spark.createDataFrame([(10**9 + k, t) for k, t in enumerate(FOREIGN.values())], "doc_id long, text string")
    mixed = docs.unionByName(junk, allowMissingColumns=True)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, mixed, "/root/testdata/sf0.1").select("doc_id").collect()}
    assert not any(i >= 10**9 for i in kept) and len(kept) > 0.99 * docs.count()


def test_few_labelled_rows_among_many_are_all_learned(spark, monkeypatch):
    """One row in 200 has a language; a common language does not crowd out a rare one."""
    from quernstone.llm import language_id as li

    taken = {}
    monkeypatch.setattr(li, "train", lambda texts, langs, **options: taken.update(texts=texts, langs=langs))
    docs = spark.range(60_000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "CASE WHEN id % 200 = 0 THEN IF(id % 4000 = 0, 'rare', 'common') END AS lang")
    learnable = docs.where(li.learnable(docs["doc_id"]) & docs["lang"].isNotNull())
    li.fit(docs)
    assert len(taken["texts"]) == learnable.count() > 150
    li.fit(docs, sample_rows=40)
    assert 20 <= len(taken["texts"]) <= 70 and 3 <= taken["langs"].count("rare") <= learnable.where("lang = 'rare'").count()
    every = docs.selectExpr("doc_id", "text", "IF(doc_id % 1000 = 0, 'rare', IF(doc_id % 2 = 0, 'a', 'b')) AS lang")
    li.fit(every, sample_rows=400)
    assert 280 <= len(taken["texts"]) <= 520 and taken["langs"].count("rare") >= 20
    assert li.shares({"a": 10, "b": 5}, 100) == {"a": 1.0, "b": 1.0} and li.shares({}, 10) == {}
