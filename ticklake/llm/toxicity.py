"""Toxicity by a support vector machine over a subsequence string kernel.

Words of labelled texts carry their text's label. The kernel of two words is the product of their
subsequences of three letters, each weighted by ``DECAY`` for every letter skipped (up to
``MOST_GAP`` - 1 at a time), so that an insult with inserted or dropped letters stays close to the
plain one. Nyström landmarks give words coordinates in which a linear machine is trained, on words
that toxic texts hold many times as often as clean ones (by smoothed log odds) against words of clean
texts; words between the two teach neither class. The clean words that a machine rates highest
join the next round. The sum over landmarks is then folded into
one weight a subsequence, so scoring a word costs its subsequences and no landmark.

A text's score is a logistic of its two highest word values, of how many of its words are rated as
insults and of its length.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

DECAY, MOST_GAP = 0.6, 3
LANDMARKS = 256
COST = 0.3
#: Labelled texts that a model is fitted on at most, chosen by a hash of their key.
SAMPLE = 12_000
WORDS = 4_000
LEAST_TEXTS = 3
#: Log odds over which a word counts as an insult, and under which as clean.
INSULT, CLEAN = 3.0, 1.5
THRESHOLD = 0.3
#: Words that a task remembers at most, and symbols that it looks at together.
MEMO, SYMBOLS = 100_000, 1 << 18
#: Letters a to z, word ends, other signs, and twelve symbols that letters of other scripts are dealt to.
_SIZE, _OTHERS = 40, 12

#: Letters, digits and signs that stand for letters (fixed values).
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_FOLD = {c: f for c in range(0x80, 0x250) if (f := unicodedata.normalize("NFKD", chr(c))[0]) != chr(c) and f.isascii()}
_FOLD |= {ord(a): b for a, b in STAND_INS.items()} | {ord("ß"): "ss", ord("ø"): "o", ord("æ"): "ae", ord("œ"): "oe", ord("ł"): "l"}
_SYMBOL = np.full(256, 27, np.int32)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65 : 65 + _OTHERS] = np.arange(28, 28 + _OTHERS)  # words are lowered, so these stand for other scripts
_SYMBOL[13] = 0  # stands at both ends of a word


class _Folded(dict):
    """Latin letters without marks; a letter of another script as one of ``_OTHERS`` capitals."""

    def __missing__(self, c: int) -> int:
        to = c if c < 0x80 or not chr(c).isalpha() else 65 + (c * 40503 >> 4) % _OTHERS
        if len(self) < 50_000:
            self[c] = to
        return to


_TABLE = _Folded(_FOLD)
_ENDS = ".,;:!?\"'()[]{}<>«»“”„’‘…-_*"


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words, ends marked, and each symbol's word."""
    data = "\n".join([f"\r{w.strip(_ENDS)}\r" for w in words]).translate(_TABLE).encode("ascii", "replace")
    raw = np.frombuffer(data, np.uint8)
    cut = raw == 10
    word = np.cumsum(cut, dtype=np.int32)
    return _SYMBOL[raw[~cut]], word[~cut]


def _subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word, subsequence number, weight) of all occurrences, a pair of gaps at a time, of
    ``SYMBOLS`` first letters at a time: a word of any length takes bounded memory."""
    symbols, owners = _flat(words)
    for start in range(0, len(symbols), SYMBOLS):
        symbol, word = (x[start : start + SYMBOLS + 2 * MOST_GAP] for x in (symbols, owners))
        for g in range(1, MOST_GAP + 1):
            for h in range(1, MOST_GAP + 1):
                m = min(SYMBOLS, len(symbol) - g - h)
                if m > 0:
                    same = np.flatnonzero(word[:m] == word[g + h : g + h + m])
                    yield word[same], (symbol[same] * _SIZE + symbol[same + g]) * _SIZE + symbol[same + g + h], DECAY ** (g + h - 2)


def _add(total: np.ndarray, word: np.ndarray, values: np.ndarray | None, weight: float) -> None:
    """Sums by word; the words of one call lie close together."""
    if len(word):
        part = np.bincount(word - word[0], values) * weight
        total[word[0] : word[0] + len(part)] += part


def _norms(words: list[str]) -> np.ndarray:
    total = np.full(len(words), 1e-12)
    for word, _, weight in _subsequences(words):
        _add(total, word, None, weight * weight)
    return np.sqrt(total)


def _features(words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), _SIZE**3), np.float32)
    for word, number, weight in _subsequences(words):
        np.add.at(out, (word, number), weight)
    return out / _norms(words)[:, None].astype(np.float32)


def word_values(words: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    total = np.zeros(len(words))
    for word, number, weight in _subsequences(words):
        _add(total, word, weights[number], weight)
    return total / _norms(words) + bias


def _squared_hinge(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 30) -> np.ndarray:
    """A linear machine with squared hinge loss, by Newton steps on the current support vectors."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        support = y * (x @ w) < 1
        xs, cs = x[support], c[support]
        new = np.linalg.solve(xs.T @ (xs * cs[:, None]) + 0.5 * np.eye(x.shape[1]), xs.T @ (cs * y[support]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def fit_words(positive: dict[str, int], negative: dict[str, int]) -> tuple[np.ndarray, float]:
    """Weights of subsequences and a bias: higher for insults. The words come with the number of
    texts that hold them, by which their errors are weighed."""
    half = LANDMARKS // 2
    landmarks = list(positive)[:half] + list(negative)[: LANDMARKS - min(half, len(positive))]
    marks = _features(landmarks)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    good = values > 1e-4 * values[-1]
    to = vectors[:, good] / np.sqrt(values[good])
    words = [*positive, *negative]
    x = np.concatenate([_features(words[a : a + 250]) @ marks.T for a in range(0, len(words), 250)]) @ to
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
    n = np.array([*positive.values(), *negative.values()], float)
    w = _squared_hinge(x, y, COST * np.where(y > 0, 0.3 * n, np.minimum(3, 1 + np.log10(n))))
    return (to @ w[:-1]) @ marks, float(w[-1])


class Model:
    def __init__(self, weights: np.ndarray, bias: float, link: np.ndarray | None = None) -> None:
        self.weights, self.bias, self.link = weights, bias, link

    def marks(self, texts: list[str | None], memo: dict[str, float]) -> np.ndarray:
        """Of each text the two highest word values (-9 where there is no word), and the logarithms of
        one more than its distinct words rated above 0 and than its words."""
        out = np.tile([-9.0, -9.0, 0.0, 0.0], (len(texts), 1))
        for start in range(0, len(texts), 64):  # words of a few texts at a time, which bounds memory
            part = [(t or "").lower().split() for t in texts[start : start + 64]]
            missing = list(set().union(*part) - memo.keys())
            if missing:
                if len(memo) > MEMO:
                    memo.clear()
                    missing = list(set().union(*part))
                memo.update(zip(missing, word_values(missing, self.weights, self.bias).tolist()))
            for k, words in enumerate(part, start):
                values = np.fromiter(map(memo.__getitem__, words), float, len(words))
                if len(values) > 1:
                    out[k, :2] = np.sort(np.partition(values, -2)[-2:])[::-1]
                elif len(values):
                    out[k, 0] = values[0]
                out[k, 2:] = np.log1p([len({words[i] for i in np.flatnonzero(values > 0)}), len(words)])
        return out

    def scores(self, marks: np.ndarray) -> np.ndarray:
        z = _clipped(marks) @ self.link[:-1] + self.link[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _clipped(marks: np.ndarray) -> np.ndarray:
    return np.hstack([np.clip(marks[:, :2], -3, 3), marks[:, 2:]])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.hstack([_clipped(x), np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    weight = np.ones(len(y))
    ridge = np.diag([0.02] * (len(w) - 1) + [1e-6]) * len(y) * 0.05
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic].update({w.strip(_ENDS) for w in (text or "").lower().split()})
        words = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)], ["word", "clean", "toxic"])


def fit(labelled: DataFrame) -> Model | None:
    """A model from ``labelled`` (text, toxic 0 or 1; other rows are left out), of which the caller
    bounds the rows. Repeated texts count each time. None if a class is missing."""
    rows = labelled.where("toxic in (0, 1)").select(F.col("text").cast("string"), F.col("toxic").cast("int")).persist()
    words = rows.mapInArrow(_count_words, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("length(word) > 2").persist()
    def take(df: DataFrame, column: str, *order, most: int = WORDS) -> dict[str, int]:
        return {r["word"]: r[column] for r in df.orderBy(*order, "word").limit(most).collect()}

    only = words.where("clean = 0 and toxic > 0")
    try:
        texts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        if len(texts) < 2:
            return None
        odds = F.log((F.col("toxic") + 0.5) / (texts[1] + 1)) - F.log((F.col("clean") + 0.5) / (texts[0] + 1))
        often = words.where(F.col("toxic") >= LEAST_TEXTS)
        positive = next(filter(None, (take(df, "toxic", F.desc("toxic")) for df in (often.where(odds > INSULT), often.where("clean = 0"), only))), None)
        clean = words.where((F.col("clean") > 0) & ((F.col("toxic") == 0) | (odds < CLEAN)))
        negative = take(clean, "clean", F.desc("clean"), most=WORDS // 2) | take(clean, "clean", F.xxhash64("word"))
        if not positive or not negative:
            return None
        for _ in range(2):
            weights, bias = fit_words(positive, negative)

            def value(batches: Iterator[pa.RecordBatch], weights=weights, bias=bias) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    got = word_values(batch.column(0).to_pylist(), weights, bias)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], ["word", "clean", "value"])

            valued = clean.select("word", "clean").mapInArrow(value, "word string, clean long, value double")
            negative |= take(valued, "clean", F.desc("value"), most=3 * WORDS // 4)
        model = Model(*fit_words(positive, negative))

        def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo: dict[str, float] = {}
            for batch in batches:
                marks = model.marks(batch.column(0).to_pylist(), memo)
                yield pa.RecordBatch.from_arrays([*map(pa.array, np.ascontiguousarray(marks.T)), batch.column(1)], ["x", "y", "high", "words", "toxic"])

        got = np.array(rows.mapInArrow(tops, "x double, y double, high double, words double, toxic int").collect(), float)
        model.link = _logistic(got[:, :-1], got[:, -1])
        return model
    finally:
        words.unpersist()
        rows.unpersist()


def held_out(key: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled texts outside the held-out fold, one a key: of several texts the first
    in order. A key labelled twice is toxic if any label says so; null keys and labels don't count."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max("toxic").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64(key), key).limit(sample)  # so many longs and ints
    rows = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), key)
    return rows.groupBy(key).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def score(docs: DataFrame, model: Model | None, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (score >= threshold). Null and empty texts
    score as texts without words do; without a model all score 0. Columns of these names are replaced."""
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    if model is None:
        return docs.select(*own, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    rows = docs.select(F.struct(*own).alias("row"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in pieces(batches):
            values = model.scores(model.marks(batch.column(1).to_pylist(), memo)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["row", "score"])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return out.select("row.*", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
