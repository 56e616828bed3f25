"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), so the pairwise
interactions of a text's features cost time in proportion to their number (the sum-of-squares identity).

Features of a whole text: its distinct lower-cased words hashed into ``BUCKETS`` (log counts, scaled to unit length),
shape words (each word's pattern of cases and symbols, hashed apart), structure statistics (shares of symbols, capitals,
digits, repeated words, neighbours, lines) in ``BINS`` steps each, and the text's length as metadata.

The model is fitted on a bounded sample of labelled rows: the ``SAMPLE`` rows with the least hash of their doc_id among
those labelled and not held out, in that order until they have ``SAMPLE_FEATURES`` features together (the first one
always counts). One task fits it; the driver sees the finished model alone, whose size is fixed. Scoring is one pass
over all rows and never shuffles a text.

Defined results: null and empty texts get the score of a text without words. Labels that are null, or whose document is
missing, are ignored; without any label of either kind the score is the mean label (0.5 with none). Rows that repeat a
doc_id are scored each. An empty table gives no row. Only ``text`` is an input of the score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, small_batches, staged

#: Features of the fitting sample at most (48 MB).
SAMPLE_FEATURES = 4_000_000
#: Rows of the fitting sample at most, hashed word features, steps per statistic, rank, passes, rows per step.
SAMPLE, BUCKETS, BINS, RANK, PASSES, BATCH = 12_000, 1 << 15, 8, 6, 8, 64
SYMBOLS = frozenset("#*$%&|<>{}[]\\^~_=+@")
STATS = ("symbols", "upper", "digits", "repeats", "neighbours", "lines", "word_length", "distinct", "no_letters", "words", "chars", "symbol_words", "upper_words")
SHAPES = 1 << 12
DIMENSIONS = BUCKETS + SHAPES + len(STATS) * (BINS + 1)


def statistics(words: list[str], text: str, counts: Counter) -> list[float]:
    """Values between 0 and 1, in the order of ``STATS``."""
    n, chars = max(len(words), 1), max(len(text), 1)
    letters = {c: k for c, k in Counter(text).items()}
    symbols = sum(k for c, k in letters.items() if c in SYMBOLS)
    upper = sum(k for c, k in letters.items() if c.isupper())
    digits = sum(k for c, k in letters.items() if c.isdigit())
    alpha = sum(k for c, k in letters.items() if c.isalpha())
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        min(1.0, 4 * symbols / chars), upper / max(alpha, 1), digits / chars, 1 - len(counts) / n,
        sum(map(str.__eq__, words, words[1:])) / n, 1 - len(set(lines)) / max(len(lines), 1), min(1.0, alpha / n / 20),
        len(counts) / n, 1 - min(1.0, alpha / chars), min(1.0, np.log1p(len(words)) / 12), min(1.0, np.log1p(len(text)) / 15),
        sum(not w[-1].isalnum() and w[-1] in SYMBOLS for w in words) / n, sum(w.isupper() for w in words) / n,
    ]


def _shape(word: str) -> str:
    """A word's pattern: its case and its run of trailing marks."""
    body = word.rstrip("!?.,;:#*$%&|<>-_=+~")
    return ("U" if body.isupper() and len(body) > 1 else "T" if body[:1].isupper() else "l" if body.isalpha() else "x" if body else "-") + word[len(body) :][:4]


class Features:
    """``of(text)`` gives (indexes, values); word hashes are kept in a bounded cache."""

    def __init__(self):
        self.cache: dict[str, tuple[int, int]] = {}

    def _hashed(self, word: str) -> tuple[int, int]:
        found = (zlib.crc32(word.lower().encode("utf-8")) % BUCKETS, BUCKETS + zlib.crc32(_shape(word).encode("utf-8")) % SHAPES)
        if len(self.cache) < 200_000 and len(word) <= 32:
            self.cache[word] = found
        return found

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.split()
        counts = Counter(words)
        cache = self.cache
        hashed = [cache.get(w) or self._hashed(w) for w in counts]
        out_i, out_v = [], []
        if hashed:
            pairs, n = np.array(hashed, np.int64), np.fromiter(counts.values(), np.float64, len(counts))
            for column, weight in ((0, 1.0), (1, 1.5)):
                index, where = np.unique(pairs[:, column], return_inverse=True)
                value = np.log1p(np.bincount(where, n))
                out_i.append(index)
                out_v.append(weight * value / np.sqrt((value**2).sum()))
        stats = np.array(statistics(words, text, counts))
        step = np.minimum((stats * BINS).astype(np.int64), BINS - 1)
        base = BUCKETS + SHAPES + np.arange(len(STATS)) * (BINS + 1)
        out_i += [base + step, base + BINS]
        out_v += [np.full(len(STATS), 0.5), stats]
        return np.concatenate(out_i), np.concatenate(out_v)


@dataclass
class Model:
    bias: float = 0.0
    linear: np.ndarray = field(default_factory=lambda: np.zeros(DIMENSIONS, np.float32))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((DIMENSIONS, RANK), np.float32))

    def scores(self, index: np.ndarray, value: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of several texts whose features stand one after the other; ``ends``: where each one's begin."""
        return 1 / (1 + np.exp(-np.clip(self._raw(index, value, ends)[0], -30, 30)))

    def _raw(self, index, value, starts):
        vx = self.factors[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        pairs = 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + pairs, sums, vx


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """Adaptive gradient steps on the log loss, the same for the same rows in the same order."""
    model, labels = Model(), np.array([r[2] for r in rows], np.float64)
    if not rows:
        return model
    mean = float(labels.mean())
    if not 0 < mean < 1:
        model.bias = float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
        return model
    rng = np.random.default_rng(seed)
    model.bias = float(np.log(mean / (1 - mean)))
    model.factors = rng.normal(0, 0.02, (DIMENSIONS, RANK)).astype(np.float32)
    g_w, g_v = np.full(DIMENSIONS, 1e-4, np.float32), np.full((DIMENSIONS, RANK), 1e-4, np.float32)
    for _ in range(PASSES):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            index = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            sizes = np.array([len(rows[i][0]) for i in part])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            raw, sums, vx = model._raw(index, value, starts)
            error = np.repeat((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]) / len(part), sizes)
            own, where = np.unique(index, return_inverse=True)
            grad_w = np.bincount(where, error * value) + 1e-5 * model.linear[own]
            each = (error * value)[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
            grad_v = np.stack([np.bincount(where, each[:, f]) for f in range(RANK)], 1) + 1e-5 * model.factors[own]
            g_w[own] += grad_w**2
            g_v[own] += grad_v**2
            model.linear[own] -= 0.15 * grad_w / np.sqrt(g_w[own])
            model.factors[own] -= 0.03 * grad_v / np.sqrt(g_v[own])
            model.bias -= 0.05 * float(error[starts].sum())
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_FEATURES) -> Model:
    """Fit on at most ``sample`` labelled rows that are not held out, chosen by the hash of their doc_id, with ``most`` features in all."""
    key = F.col("doc_id").cast("long")
    known = labels.select(key.alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = docs.select(key.alias("doc_id")).distinct()
    chosen = staged(one.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "sample")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Features().of
        for batch in batches:
            found = [of(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "n": [len(i) for i, _ in found], "at": [i.astype("<i4").tobytes() for i, _ in found], "value": [v.astype("<f8").tobytes() for _, v in found]})

    texts = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").mapInPandas(features, "doc_id long, quality int, n long, at binary, value binary")  # bounded by ``sample``
    rows = staged(rows, "features")
    # rows that repeat a doc_id may be more than the sample; from here on there are at most ``sample``
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("at")]
    first = rows.select("doc_id", "n", "at").orderBy(*order).limit(sample)
    place = Window.orderBy(*order)
    first = first.withColumn("place", F.row_number().over(place)).withColumn("upto", F.sum("n").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    last = first.filter((F.col("upto") <= most) | (F.col("place") == 1)).count()
    bounded = rows.orderBy(*order).limit(last).coalesce(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(v, "<f8"), q) for b in batches for a, v, q in zip(b["at"], b["value"], b["quality"])]
        model = fit(found)
        yield pd.DataFrame({"bias": [model.bias], "linear": [model.linear.astype("<f4").tobytes()], "factors": [model.factors.astype("<f4").tobytes()]})

    fitted = staged(bounded.select("at", "value", "quality").mapInPandas(run, "bias double, linear binary, factors binary"), "model")
    got = fitted.first()
    discard(chosen, rows, fitted)
    if got is None:
        return Model()
    return Model(got["bias"], np.frombuffer(got["linear"], "<f4"), np.frombuffer(got["factors"], "<f4").reshape(DIMENSIONS, RANK))


def with_score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the model's score of ``text`` in ``column`` (which must be a new name).

    The plan runs Python when the caller runs it, so the bounds of its batches stay set in the session.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # of a fixed size: DIMENSIONS * (RANK + 1) numbers

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of, fitted = Features().of, shared.value
        for texts in parts:
            found = [of(t) for t in texts]
            if not found:
                yield pd.Series([], dtype="float64")
                continue
            starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in found])[:-1]])
            yield pd.Series(fitted.scores(np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found]), starts))

    return docs.withColumn(column, score(F.col("text").cast("string")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
