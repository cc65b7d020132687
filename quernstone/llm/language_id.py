"""Language identification: averaged hashed subword embeddings under a linear softmax.

Training (driver, numpy): stochastic gradient descent over a bounded sample of
labelled rows (``sample_rows`` of them, some of each language, chosen by a hash of the id; texts of at most
``sample_chars``). The temperature of the softmax is fitted on pieces of a fifth of that
sample, so that ``reject_below`` is a calibrated probability.

A softmax is sure of texts like none it has learned from, so a second measure says whether a text is of any learned
language: the mean log share of its subwords in the texts learned from. Its bounds, by the number of
subwords, part pieces of the held fifth from such pieces with their letters shuffled and from
pieces that are measured without their own language. The score is the product of both. Prediction covers
every whole text: average and linear layer are folded into one table of
``buckets`` rows, looked up for each subword of the text, on the executors.

Cases: a null text, an empty one, or one without a letter is ``und`` with score 0
and rejected. Rows with a null id or null language are not learned from. With
nothing to learn from, every row is ``und``. Ties go to the language that comes first
in sorted order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat_text, mix64, release_memory, slices

ORDERS = (2, 3, 4)
_T = np.random.default_rng(515).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Characters of the pieces that calibrate, besides whole texts; a clean piece lost counts as so many others kept.
PIECES, CLEAN_COUNTS = (8, 24, 80, 300), 50

# letters of any script count as subword bytes; ASCII digits, signs and controls are blanks
_MAP = np.full(256, 0x20, np.uint8)
_MAP[0x41:0x5B] = np.arange(0x61, 0x7B)
_MAP[0x61:0x7B] = np.arange(0x61, 0x7B)
_MAP[0x80:] = np.arange(0x80, 0x100)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # buckets x languages and, last, log shares; float32
    bias: np.ndarray
    temperature: float
    reject_below: float
    bounds: np.ndarray  # rows: log of a number of subwords, least mean log share
    width: float = 1.0
    calibration_error: float = 0.0  # expected, of scores of held pieces and of the same with shuffled letters

    def known(self, share: np.ndarray, count: np.ndarray) -> np.ndarray:
        """How likely texts with these mean log shares are of a learned language: 0.5 at the bounds."""
        if not len(self.bounds):
            return np.ones(len(share))
        over = share - np.interp(np.log(np.maximum(count, 1)), self.bounds[:, 0], self.bounds[:, 1])
        return 1 / (1 + np.exp(np.clip(-over / self.width, -500, 500)))

    @property
    def buckets(self) -> int:
        return len(self.table)


def subwords(data: np.ndarray, offsets: np.ndarray, buckets: int):
    """For each order: (start positions, bucket numbers) of the subwords, with blanks at the ends only and none over a row's end.

    ``data`` gets a blank before and after every row, so that words have marked ends.
    """
    rows = len(offsets) - 1
    n = len(data) + rows + 1
    text = np.full(n, 0x20, np.uint8)
    shift = np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(offsets)) + 1
    mapped = _MAP[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1  # U+00C0 to U+00DE are lower-cased too
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    mapped[at] += 0x20
    text[shift] = mapped
    starts = offsets[:-1] + np.arange(rows)
    blank = text == 0x20
    h = _T[text]
    out, inner = [], np.zeros(n, bool)
    for k in range(2, max(ORDERS) + 1):
        if n < k:
            break
        h = (h[:-1] * _STEP) ^ _T[text[k - 1 :]]
        if k > 2:
            inner = inner[: n - k + 1] | blank[k - 2 : n - 1]
        else:
            inner = np.zeros(n - 1, bool)
        if k in ORDERS:
            good = ~inner & ~(blank[: n - k + 1] & (blank[k - 1 :] if k == 2 else False))
            at = np.flatnonzero(good)
            out.append((at, (mix64(h[at]) % np.uint64(buckets)).astype(np.int32)))
    return out, starts


def row_sums(model_table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the table's rows over each text's subwords, and their number."""
    rows = len(offsets) - 1
    total, count = np.zeros((rows, model_table.shape[1])), np.zeros(rows)
    found, starts = subwords(data, offsets, len(model_table))
    for at, bucket in found:
        ends = np.searchsorted(at, np.append(starts[1:], len(data) + rows + 1))
        first = np.concatenate([[0], ends[:-1]])
        has = ends > first
        if has.any():
            total[has] += np.add.reduceat(model_table[bucket], first[has], axis=0, dtype=np.float64)
            count += ends - first
    return total, count


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _means(table: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the table's rows over each text's subwords, and their number."""
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    found = [row_sums(table, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, 1 << 18)]
    total, count = (np.concatenate(x) for x in zip(*found, strict=True))
    return total / np.maximum(count, 1)[:, None], count


def expected_error(scores: np.ndarray, right: np.ndarray, bins: int = 10) -> float:
    """Expected calibration error: mean gap between score and accuracy over bins of the score, weighted by their size."""
    if not len(scores):
        return 0.0
    at = np.minimum((scores * bins).astype(int), bins - 1)
    sizes = np.bincount(at, minlength=bins)
    gaps = np.abs(np.bincount(at, scores, bins) - np.bincount(at, right, bins))
    return float(gaps.sum() / sizes.sum())


def _piece(text: str, chars: int, rng: np.random.Generator) -> str:
    at = int(rng.integers(0, max(1, len(text) - chars + 1)))
    return text[at : at + chars]


def _shuffled(text: str, rng: np.random.Generator) -> str:
    """The text with its letters in another order, signs and blanks in their places."""
    letters = [c for c in text if c.isalpha()]
    order = iter(rng.permutation(len(letters)).tolist())
    return "".join(letters[next(order)] if c.isalpha() else c for c in text)


def _parting(clean: np.ndarray, other: np.ndarray) -> float:
    """The bound under which most of ``other`` and hardly any of ``clean`` lie; the middle of a gap."""
    at = np.unique(np.concatenate([clean, other]))
    at = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2, [at[-1] + 1]])
    lost = np.searchsorted(np.sort(clean), at) / len(clean)
    kept = 1 - np.searchsorted(np.sort(other), at) / len(other)
    cost = CLEAN_COUNTS * lost + kept
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float((at[best[0]] + at[best[-1]]) / 2)


def _bounds(model: Model, shares: np.ndarray, texts: list[str], y: np.ndarray, rng: np.random.Generator) -> None:
    """Sets the model's bounds and width; ``shares``: buckets x languages, the log shares without each language."""
    clean, other = [], []
    for chars in (*PIECES, None):
        pieces = texts if chars is None else [_piece(t, chars, rng) for t in texts]
        table = np.column_stack([model.table[:, -1], shares])
        mean, count = _means(table, pieces)
        mixed, mixed_count = _means(table[:, :1], [_shuffled(t, rng) for t in pieces])
        apart = mean[np.arange(len(y)), 1 + y] if shares.shape[1] > 1 else np.zeros(0)
        good, good_mixed = count > 0, mixed_count > 0
        if not good.any() or not good_mixed.any():
            continue
        clean.append((mean[good, 0], count[good]))
        other.append((np.concatenate([mixed[good_mixed, 0], apart[good[: len(apart)]]]), np.concatenate([mixed_count[good_mixed], count[good][: len(apart)]])))
    rows: list[tuple[float, float]] = []
    for (a, n), (b, _) in zip(clean, other, strict=True):
        at = float(np.log(np.median(n)))
        if not rows or at > rows[-1][0]:
            rows.append((at, _parting(a, b)))
    model.bounds = np.array(rows)
    if not rows:
        return
    loss = []
    for width in np.geomspace(0.02, 2, 30):
        model.width = float(width)
        loss.append((sum(-np.log(np.maximum(model.known(*x), 1e-12)).mean() for x in clean) + sum(-np.log(np.maximum(1 - model.known(*x), 1e-12)).mean() for x in other), model.width))
    model.width = min(loss)[1]


def train(texts: list[str], langs: list[str], buckets: int = 1 << 16, width: int = 16, steps: int = 1500, rate: float = 0.5, seed: int = 7, reject_below: float = 0.4, reject_share: float = 0.001) -> Model:
    """Fit embeddings and softmax; the last fifth (in a seeded order) calibrates."""
    labels = sorted(set(langs))
    if not labels:
        return Model([], np.zeros((buckets, 2), np.float32), np.zeros(1), 1.0, reject_below, np.zeros((0, 2)))
    rng = np.random.default_rng(seed)
    y = np.searchsorted(labels, langs)
    bags = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        found, _ = subwords(data, np.array([0, len(data)]), buckets)
        bags.append(np.concatenate([b for _, b in found]) if found else np.zeros(0, np.int32))
    order = rng.permutation(len(texts))
    order = order[[len(bags[i]) > 0 for i in order]]
    held = order[: len(order) // 5]
    learn = order[len(order) // 5 :]
    emb = rng.normal(0, 0.1, (buckets, width))
    out = np.zeros((width, len(labels)))
    bias = np.zeros(len(labels))
    done = 0
    while len(learn) and done < steps:
        rng.shuffle(learn)
        for part in np.array_split(learn, len(learn) // 64 + 1):
            if done >= steps or not len(part):
                break
            take = [bags[i][rng.integers(0, len(bags[i]), int(rng.choice([12, 40, 150])))] for i in part]
            sizes = np.array([len(t) for t in take])
            ids, rows = np.concatenate(take), np.repeat(np.arange(len(part)), sizes)
            vec = np.add.reduceat(emb[ids], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            grad = _softmax(vec @ out + bias)
            grad[np.arange(len(part)), y[part]] -= 1
            lr = rate * (1 - done / steps) + 0.01
            back = (grad @ out.T / sizes[:, None])[rows]
            out -= lr / 4 * vec.T @ grad
            bias -= lr * grad.mean(axis=0)
            np.subtract.at(emb, ids, lr * back)
            done += 1
    table = emb @ out
    counts = np.zeros((buckets, len(labels)))
    for i in learn:
        np.add.at(counts[:, y[i]], bags[i], 1)
    # a bucket never met counts as half a subword
    log_share = lambda c: np.log(c + 0.5) - np.log(c.sum(axis=0) + buckets / 2)
    whole = counts.sum(axis=1)
    model = Model(labels, np.column_stack([table, log_share(whole)]).astype(np.float32), bias, 1.0, reject_below, np.zeros((0, 2)))
    if len(held):
        own, of = [texts[i] for i in held], y[held]
        short = [_piece(t, c, rng) for c in PIECES for t in own]
        mean, count = _means(model.table[:, :-1], own + short)
        z, of_all = (mean + bias)[count > 0], np.tile(of, len(PIECES) + 1)[count > 0]
        grid = np.geomspace(0.05, 20, 61)
        loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), of_all], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        model.reject_below = min(reject_below, 0.9 * float(np.quantile(_softmax((mean[: len(held)] + bias) / model.temperature).max(axis=1), reject_share)))
        _bounds(model, log_share(whole[:, None] - counts), own, of, rng)
        scores, right = [], []
        for chars in (*PIECES, None):
            pieces = own if chars is None else [_piece(t, chars, rng) for t in own]
            for texts_, good in ((pieces, of), ([_shuffled(t, rng) for t in pieces], np.full(len(of), -1))):
                mean, count = _means(model.table, texts_)
                p = _softmax((mean[:, :-1] + bias) / model.temperature)
                scores.append((p.max(axis=1) * model.known(mean[:, -1], count))[count > 0])
                right.append((p.argmax(axis=1) == good)[count > 0])
        model.calibration_error = expected_error(np.concatenate(scores), np.concatenate(right))
    return model


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) != 1, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


#: Languages that are learned at most, the commonest ones; and the part of a sample that is shared out evenly among them.
MAX_LANGUAGES, EVEN_PART = 1000, 0.25


def shares(counts: dict[str, int], sample_rows: int) -> dict[str, float]:
    """The share of each language's rows that makes a sample of about ``sample_rows``: in proportion, but no language is below its even part, as far as it has the rows."""
    even = EVEN_PART * sample_rows / max(1, len(counts))
    whole = (1 - EVEN_PART) * sample_rows / max(1, sum(counts.values()))
    if sum(counts.values()) <= sample_rows:
        return dict.fromkeys(counts, 1.0)
    return {lang: min(1.0, max(whole, even / n)) for lang, n in counts.items()}


def fit(docs: DataFrame, sample_rows: int = 4000, sample_chars: int = 20_000, **options) -> Model:
    """Train on at most about ``sample_rows`` labelled rows of the learnable folds, of each language those with the smallest id hashes; on all of them, if they are no more. Labelled rows alone are counted."""
    rows = docs.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= sample_chars)).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()}
    if not counts:
        return train([], [], **options)
    key = F.xxhash64(F.lit(11), F.col("doc_id").cast("string"))
    told = docs.sparkSession.createDataFrame([(lang, int(s * (1 << 40))) for lang, s in shares(counts, sample_rows).items()], "_lang string, _below long")  # a row a language
    taken = rows.join(F.broadcast(told), F.col("lang") == F.col("_lang")).where(F.pmod(key, F.lit(1 << 40)) < F.col("_below"))
    got = taken.select(key.alias("k"), "text", "lang").limit(2 * sample_rows + 200).toPandas()
    got = got.sort_values(["k", "text", "lang"])
    return train(got["text"].tolist(), got["lang"].tolist(), **options)


def predictor(spark: SparkSession, model: Model):
    """A vectorised UDF on text: predicted language, calibrated score, whether it is rejected."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def predict(texts):
        import pyarrow as pa

        m: Model = shared.value
        offsets, data = flat_text(texts)
        langs, scores, rejects = [], [], []
        for i, j in slices(offsets, 1 << 20):
            o = offsets[i : j + 1] - offsets[i]
            part = data[offsets[i] : offsets[j]]
            ascii_letter = (part | 0x20) - 0x61 < 26
            sums = np.concatenate([[0], np.cumsum(ascii_letter)])
            letters = sums[o[1:]] - sums[o[:-1]] > 0
            for k in np.flatnonzero(~letters & (np.diff(o) > 0)):
                letters[k] = any(c.isalpha() for c in part[o[k] : o[k + 1]].tobytes().decode("utf-8", "replace"))
            if not m.labels:
                letters[:] = False
            total, count = row_sums(m.table, part, o)
            mean = total / np.maximum(count, 1)[:, None]
            p = _softmax((mean[:, :-1] + m.bias) / m.temperature)
            best = p.argmax(axis=1)
            sure, known = p[np.arange(len(best)), best], m.known(mean[:, -1], count)
            score = sure * known
            for k in range(j - i):
                langs.append(m.labels[best[k]] if letters[k] else "und")
                scores.append(float(score[k]) if letters[k] else 0.0)
                rejects.append(not letters[k] or bool(sure[k] < m.reject_below or known[k] < 0.5))
        release_memory()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejects, pa.bool_())], ["lang", "score", "rejected"])

    return predict


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row."""
    p = predictor(docs.sparkSession, model)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), p(F.col("text")).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, whose language the model does not reject."""
    p = predictor(docs.sparkSession, model)
    name = "p"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, p(F.col("text"))).where(~F.col(name)["rejected"]).drop(name)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))


QUERIES = {"op5_language_id": op5_language_id}
ORACLE: dict[str, str] = {}
