"""Toxicity by noisy-channel deobfuscation.

A text is folded (lower case, no accents, look-alike letters of other scripts, no invisible characters). Its spans that may hide a word
(letters mixed with digits or symbols, letters spelt out with separators between them, letters repeated) become lattices of what each
character may stand for: a leetspeak character its letters, a separator nothing or the end of a word, a run of a letter one or two of it.
A Viterbi search finds the least sum of channel costs and of a character language model; the words it gives replace the span. Words of
the restored text, and their runs of five characters, are the features of a logistic regression, whose probability is the score.

The language model, interpolated counts of four characters, counts **all** texts, task by task; its cells are bounded by the alphabet. Labels are learned from a
sample of at most ``sample_rows`` labelled rows of the learnable folds, half of them toxic where there are so many, weighted back to
their shares among the labelled rows; copies (equal least five-word hash) count once. Features are those ``features`` pieces with
the greatest likelihood ratio. Both are counted on executors; the driver gets the language model's cells, the chosen pieces and which of them the sample's rows have.

Cases: null and empty texts score as texts without any piece. Rows without an id or label are not learned from; of several labels of an id the greatest
counts. With no learnable rows every score is 0; with rows of one label only it is that label's smoothed share.
Long texts are read whole. Repeated rows score alike, each. Other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release_memory

#: Letters that a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "*": "aeiou",
}
#: Cyrillic and Greek letters that look like Latin ones.
LOOK_ALIKE = str.maketrans("авекмнорстухіјѕαεικνορτυχ", "abekmhopctyxijsaeikvoptux")
_INVISIBLE = re.compile("[̀-ͯ­​-‏⁠﻿]+")
_MARKS = re.escape("".join(c for c in LEET if not c.isdigit()))
_SIGN = rf"[a-z0-9{_MARKS}]"
#: Single signs with separators between them.
SPELT = re.compile(rf"(?<![a-z0-9]){_SIGN}(?:[ \t.\-_~,'/]{{1,3}}{_SIGN}){{2,}}(?![a-z0-9])")
#: What a token is stripped of, and what makes it suspicious: a letter beside another sign, a letter three times, short pieces between inner marks.
_BEFORE, _AFTER = ".,;:?([{<\"'_-~^*/\\%&#=", ".,;:?!)]}>\"'_-~^*/\\%&#="
_MIXED = re.compile(rf"[a-z][0-9{_MARKS}]|[0-9{_MARKS}][a-z]|([a-z])\1\1|(?<![a-z])[a-z]{{1,2}}[._\-~^'][a-z]|[a-z][._\-~^'][a-z]{{1,2}}(?![a-z])")
_WORDS = re.compile("[a-z]+")
_RUN = re.compile(r"([a-z])\1\1")
#: Costs of the channel.
COSTS = {"leet": 1.0, "sign ends": 8.0, "sign goes": 9.0, "joined": 0.5, "ends": 4.0, "far joined": 4.0, "run to one": 0.0, "run to two": 1.0, "two to one": 6.0}

LETTERS, CONTEXT = 28, 3
CELLS = LETTERS ** (CONTEXT + 1)
SAMPLE_ROWS, FEATURES, PIECE, TOXIC_AT = 20_000, 4096, 5, 0.7
#: Least evidence, in nats, that a feature is commoner in toxic texts: among a million pieces chance reaches about 14.
EVIDENCE = 10.0


def folded(text: str | None) -> str:
    if not text:
        return ""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text)).casefold().translate(LOOK_ALIKE)
    return text.lower()


# -- language model

_CODE = np.zeros(1 << 16, np.uint8)
_CODE[[k for k in range(128, 1 << 16) if chr(k).isalpha()]] = LETTERS - 1
_CODE[97:123] = np.arange(1, 27)


def counted(text: str, counts: np.ndarray) -> None:
    """Adds the cells (three characters of the word so far, next one or its end) of a folded text."""
    for a in range(0, len(text), 1 << 20):
        # a cut word counts as two
        points = np.frombuffer(text[a : a + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.concatenate([[0], _CODE[np.minimum(points, (1 << 16) - 1)], [0]]).astype(np.int32)
        p1 = np.concatenate([[0], code[:-1]]).astype(np.int32)
        p2 = np.where(p1 == 0, 0, np.concatenate([[0, 0], code[:-2]])).astype(np.int32)
        p3 = np.where(p2 == 0, 0, np.concatenate([[0, 0, 0], code[:-3]])[: len(code)]).astype(np.int32)
        use = (code > 0) | (p1 > 0)
        cell = ((p3 * LETTERS + p2) * LETTERS + p1) * LETTERS + code
        counts += np.bincount(cell[use], minlength=CELLS)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Costs (negative logarithms) of each cell: counts of four, three, two and one characters, interpolated after Witten and Bell."""
    p = np.full(LETTERS, 1 / LETTERS)
    for order in range(CONTEXT + 1):
        c = counts.reshape(LETTERS ** (CONTEXT - order), LETTERS**order, LETTERS).sum(axis=0).astype(float)
        kinds, total = (c > 0).sum(axis=1, keepdims=True), c.sum(axis=1, keepdims=True)
        lower = np.tile(p.reshape(-1, LETTERS), (LETTERS if order else 1, 1))
        p = np.where(total > 0, (c + kinds * lower) / np.maximum(total + kinds, 1), lower)
    return -np.log(p).reshape(-1)


# -- decoding

Unit = list[tuple[str, float]]


def lattice(span: str) -> list[Unit]:
    """What each character, or run of one, may stand for, with its cost; a space ends a word."""
    out: list[Unit] = []
    i = 0
    while i < len(span):
        c, j = span[i], i
        while j < len(span) and span[j] == c:
            j += 1
        n = j - i
        if "a" <= c <= "z":
            out.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, COSTS["two to one"])] if n == 2 else [(c, COSTS["run to one"]), (c * 2, COSTS["run to two"])])
        elif c in LEET:
            unit = [(x, COSTS["leet"]) for x in LEET[c]] + [(" ", COSTS["sign ends"]), ("", COSTS["sign goes"])]
            out += [unit] * n if n < 3 else [[*unit, *((x * 2, COSTS["leet"] + COSTS["run to two"]) for x in LEET[c])]]
        else:
            while j < len(span) and not ("a" <= span[j] <= "z" or span[j] in LEET):
                j += 1
            out.append([("", COSTS["joined"]), (" ", COSTS["ends"])] if j - i == 1 else [("", COSTS["far joined"]), (" ", 0.0)])
        i = j
    return out


def decoded(units: list[Unit], model: list[float]) -> tuple[str, float]:
    """The cheapest reading of a lattice, and its cost."""
    states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for unit in [*units, [(" ", 0.0)]]:
        following: dict[int, tuple[float, tuple]] = {}
        for context, (cost, before) in states.items():
            for letters, more in unit:
                at, total, back = context, cost + more, before
                for c in letters:
                    if c == " ":
                        if at:
                            total += model[at * LETTERS]
                            at, back = 0, (back, c)
                    else:
                        k = ord(c) - 96
                        total += model[at * LETTERS + k]
                        at, back = at % (LETTERS * LETTERS) * LETTERS + k, (back, c)
                if at not in following or total < following[at][0]:
                    following[at] = (total, back)
        states = following
    cost, back = states[0]
    out = []
    while back:
        back, c = back
        out.append(c)
    return "".join(reversed(out)).strip(), cost


class Restorer:
    """Restores folded texts; readings of tokens are remembered."""

    def __init__(self, model: np.ndarray, remember: int = 200_000):
        self.model, self.known, self.remember = model.tolist(), {}, remember

    def _token(self, token: str) -> str:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= self.remember:
                self.known.clear()
            core = token.lstrip(_BEFORE).rstrip(_AFTER)
            found = token if not _MIXED.search(core) else decoded(lattice(core), self.model)[0]
            self.known[token] = found
        return found

    def text(self, text: str | None) -> str:
        """A text, restored; white space becomes single spaces."""
        plain = SPELT.sub(lambda m: f" {self.spelt(m.group())} ", folded(text))
        return " ".join(self._token(t) for t in plain.split())

    def spelt(self, span: str) -> str:
        return decoded(lattice(span), self.model)[0] if _WORDS.search(span) else span

    def words(self, text: str | None) -> set[str]:
        """The distinct words of the restored text."""
        plain = folded(text)
        runs, out, other = _RUN.search(plain) is not None, set(), []
        for t in set(plain.split()):
            core = t if t.isalpha() else t.lstrip(_BEFORE).rstrip(_AFTER)
            if core.isalpha() and core.isascii() and not (runs and _RUN.search(core)):
                out.add(core)
            elif core:
                other.append(self._token(t))
        other += [self.spelt(m.group()) for m in SPELT.finditer(plain)]
        for t in other:
            out.update(_WORDS.findall(t))
        return out


def pieces(word: str) -> Iterator[str]:
    """A word and its runs of ``PIECE`` characters, ends marked."""
    whole = f"^{word}$"
    yield whole
    if len(whole) > PIECE:
        for k in range(len(whole) - PIECE + 1):
            yield whole[k : k + PIECE]


class Finder:
    """Which of some pieces a set of words has, by one automaton."""

    def __init__(self, names: Iterable[str]):
        self.automaton = ahocorasick.Automaton()
        for name in names:
            self.automaton.add_word(name, name)
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, words: Iterable[str]) -> set[str]:
        return {name for _, name in self.automaton.iter("^" + "$^".join(words) + "$")} if len(self.automaton) else set()


# -- learning


@dataclass
class Scorer:
    model: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -np.inf

    def score(self, found: Iterable[str]) -> float:
        z = self.bias + sum(self.weights[p] for p in found)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def learned_from(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1, F.lit(False))


def count_cells(docs: DataFrame) -> np.ndarray:
    """The language model's counts over all texts of ``docs``."""

    def run(batches):
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            held, size = [], 0
            for text in batch.column(0).to_pylist():
                held.append(folded(text))
                size += len(held[-1])
                if size >= 1 << 20:
                    counted("\n".join(held), counts)
                    held, size = [], 0
            counted("\n".join(held), counts)
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(counts[cells])], names=["cell", "n"])
        release_memory()

    got = docs.select("text").where("text IS NOT NULL").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    counts = np.zeros(CELLS, np.int64)
    counts[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return counts


def _copy_key(text: str) -> int:
    """The least hash of five words, by which copies are told; the whole text's where it has fewer."""
    w = text.split()
    return min((zlib.crc32(" ".join(w[k : k + 5]).encode()) for k in range(len(w) - 4)), default=zlib.crc32(text.encode()))


def sampled(docs: DataFrame, labels: DataFrame, sample_rows: int) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic) of labelled learnable rows, at most about ``sample_rows``, and how many labelled rows one of each label stands for."""
    told = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(learned_from(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in told.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    few, many = sorted((counts.get(k, 0), k) for k in (0, 1))
    kept = {few[1]: min(few[0], sample_rows // 2)}
    kept[many[1]] = min(many[0], sample_rows - kept[few[1]])
    share = {k: kept[k] / counts[k] for k in kept if counts.get(k)}
    key = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = told.where(key < F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    # about ``sample_rows`` ids
    return docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("text", "toxic"), {k: 1 / s for k, s in share.items()}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, rounds: int = 300) -> Scorer:
    """``docs`` (doc_id, text), all of which the language model counts; ``labels`` (doc_id, toxic), of which the learnable folds are learned from."""
    spark = docs.sparkSession
    scorer = Scorer(language_model(count_cells(docs)))
    sample, stands_for = sampled(docs, labels, sample_rows)
    shared = spark.sparkContext.broadcast(scorer.model)

    def restore(batches):
        restorer = Restorer(shared.value)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([_copy_key(folded(t)) for t in texts], pa.int64()), pa.array([sorted(restorer.words(t)) for t in texts], pa.list_(pa.string()))], names=["toxic", "copy", "words"])

    rows = materialise(sample.mapInArrow(restore, "toxic int, copy long, words array<string>").groupBy("toxic", "copy").agg(F.min("words").alias("words")), "labelled")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n:
        return scorer
    if len(n) == 1:
        (label, m), = n.items()
        scorer.bias = float(np.log((m * label + 0.5) / (m * (1 - label) + 0.5)))
        return scorer

    def count(batches):
        found = (Counter(), Counter())
        for batch in batches:
            for toxic, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[toxic].update({p for w in words for p in pieces(w)})
        keys = list(found[0] | found[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([f[k] for k in keys], pa.int64()) for f in found)], names=["piece", "clean", "toxic"])

    by_piece = rows.select("toxic", "words").mapInArrow(count, "piece string, clean long, toxic long").groupBy("piece").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    part = lambda x, of, whole: F.when(x > 0, x * F.log(x * (n[0] + n[1]) / (F.lit(float(of)) * whole))).otherwise(0.0)
    t, c = F.col("t"), F.col("c")
    ratio = part(t, n[1], t + c) + part(c, n[0], t + c) + part(n[1] - t, n[1], n[0] + n[1] - t - c) + part(n[0] - c, n[0], n[0] + n[1] - t - c)
    chosen = by_piece.where((t >= 3) & (t / n[1] > c / n[0]) & (ratio >= EVIDENCE)).withColumn("ratio", F.round(ratio, 6)).orderBy(F.desc("ratio"), "piece").limit(features)
    names = [r["piece"] for r in chosen.collect()]  # at most ``features``
    place = spark.sparkContext.broadcast({p: k for k, p in enumerate(names)})

    def match(batches):
        at = place.value
        finder = Finder(at)
        for batch in batches:
            hits = [sorted(at[p] for p in finder.found(words)) for words in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(pa.int32()))], names=["toxic", "at"])

    # a number for each piece that a sample's row has
    got = rows.select("toxic", "words").mapInArrow(match, "toxic int, at array<int>").toArrow()
    told = sorted(zip(got.column("toxic").to_pylist(), got.column("at").to_pylist(), strict=True))
    y = np.array([t for t, _ in told], float)
    scorer.bias, weights = _regression([a for _, a in told], y, np.where(y == 1, stands_for[1], stands_for[0]), len(names), rounds)
    scorer.weights = dict(zip(names, weights.tolist(), strict=True))
    return scorer


def _regression(at: list[list[int]], y: np.ndarray, weight: np.ndarray, width: int, rounds: int, penalty: float = 0.05) -> tuple[float, np.ndarray]:
    """Weighted logistic regression on sets of features: gradient steps with momentum, each feature's own step bounded by its curvature."""
    row, col = np.repeat(np.arange(len(at)), [len(a) for a in at]), np.array([k for a in at for k in a], np.int64)
    sizes = np.bincount(row, minlength=len(at))
    # the curvature along a feature is at most that of its rows times the features they have
    curve = np.bincount(col, weight[row] * (sizes[row] + 1), width) / 4 + penalty
    w, b, v, u = np.zeros(width), float(np.log((weight * y).sum() / (weight * (1 - y)).sum())), np.zeros(width), 0.0
    for k in range(rounds):
        ahead, ahead_b = w + v, b + u
        z = ahead_b + np.bincount(row, ahead[col], len(at))
        gap = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        new = ahead - (np.bincount(col, gap[row], width) + penalty * ahead) / curve
        new_b = ahead_b - gap.sum() / ((weight * (sizes + 1)).sum() / 4)
        m = k / (k + 3)
        v, u, w, b = m * (new - w), m * (new_b - b), new, new_b
    return float(b), w


# -- scoring


def scores(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        held: Scorer = shared.value
        restorer, finder = Restorer(held.model), Finder(held.weights)
        for batch in batches:
            out = [held.score(sorted(finder.found(restorer.words(text)))) for text in batch.column(2).to_pylist()]
            score = np.array(out, float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= TOXIC_AT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        release_memory()

    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("held_out boolean, score double, predicted int")]))


def restored(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """(doc_id, text): the folded and restored text of every row, null where it is null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def restore(texts: pa.Array) -> pa.Array:
        restorer = Restorer(shared.value)
        return pa.array([None if t is None else restorer.text(t) for t in texts.to_pylist()], pa.string())

    return docs.select("doc_id", restore("text").alias("text"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scores(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op11_toxicity": op11_toxicity}
ORACLE: dict[str, str] = {}
