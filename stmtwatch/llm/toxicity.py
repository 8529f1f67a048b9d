"""Toxicity by a convolutional text classifier, trained in numpy.

Words are lower-cased runs of letters and digits. The embedding of a word is the sum of three rows of
hashed tables, one by the word and two by its first letters, so that inflected forms share what is
known of their stem. Filters over one, two and three words are max-pooled over the whole text; a
logistic layer gives the logit.

The classifier is fitted on the driver on at most `max_rows` labelled documents, taken by hash;
scoring covers every whole text and shuffles nothing. The first coordinate of the tables starts from
the log odds of the labels, all others near zero, so unknown words are neutral. A part of the
sample is held back to calibrate a threshold for each language. The language is guessed from the
text's own function words; no column but the text is an input of a score.

Nulls count as empty texts, which are scored like any other. Without labels of both classes every
score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtwatch.llm.common import whole_text

BUCKETS = 1 << 16
# The word, and so many of its first letters.
PARTS = (None, 8, 6)
# Words that a task remembers at most.
REMEMBERED = 200_000
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 12
MAX_ROWS = 6000
EPOCHS = 4
BATCH = 32
RATE = 0.01

_WORDS = re.compile(r"[^\W_]+")
# Frequent function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": {"the", "and", "of", "to", "that", "with", "was", "this"},
    "de": {"der", "die", "das", "und", "nicht", "ein", "mit", "auf"},
    "fr": {"le", "les", "des", "et", "une", "est", "pour", "dans"},
    "es": {"el", "los", "las", "y", "una", "por", "para", "del"},
}


def _packed(word: str, buckets: int) -> int:
    """The buckets of a word's parts, packed in one long."""
    out = 0
    for part in PARTS:
        out = out * buckets + zlib.crc32(f"{part} {word[:part]}".encode("utf-8", "replace")) % buckets
    return out


def hashed_words(text: str, buckets: int = BUCKETS, known: dict[str, int] | None = None) -> tuple[np.ndarray, str]:
    """The packed buckets of every word, and the guessed language. `known` remembers words."""
    words = _WORDS.findall(text.lower())
    known = {} if known is None else known
    if len(known) > REMEMBERED:
        known.clear()
    for word in words:
        if word not in known:
            known[word] = _packed(word, buckets)
    found = {lang: sum(w in some for w in words) for lang, some in FUNCTION_WORDS.items()}
    best = max(found, key=found.get)
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words)), best if found[best] else "other"


def unpacked(words: np.ndarray, buckets: int) -> list[np.ndarray]:
    """The bucket of every word in each table."""
    return [words // buckets ** (len(PARTS) - 1 - t) % buckets for t in range(len(PARTS))]


@dataclass
class Model:
    tables: np.ndarray  # parts x buckets x dimensions
    filters: list[np.ndarray]  # width x dimensions x filters
    bias: np.ndarray
    weights: np.ndarray
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def features(self, docs: list[np.ndarray]):
        """Max-pooled filters of documents, where the maxima are, and the words' vectors."""
        buckets, pad = self.tables.shape[1], max(WIDTHS) - 1
        lens = np.array([max(1, len(d)) for d in docs])
        starts = np.concatenate(([0], np.cumsum(lens + pad)))[:-1]
        packed = np.full(int((lens + pad).sum()), -1, np.int64)
        for start, doc in zip(starts, docs):
            packed[start: start + len(doc)] = doc
        real = packed >= 0
        vectors = np.zeros((len(packed), self.tables.shape[2]), np.float32)
        vectors[real] = sum(table[at] for table, at in zip(self.tables, unpacked(packed[real], buckets)))
        blocked = ~real
        blocked[starts] = False
        pooled, places = [], []
        for taps in self.filters:
            n = len(packed) - len(taps) + 1
            out = vectors[:n] @ taps[0]
            for j in range(1, len(taps)):
                out += vectors[j: n + j] @ taps[j]
            out = np.concatenate([out, np.full((len(packed) - n, out.shape[1]), -np.inf, np.float32)])
            out[blocked] = -np.inf
            best = np.maximum.reduceat(out, starts)
            pooled.append(best)
            places.append((out, starts, lens))
        return np.concatenate(pooled, axis=1), places, packed, vectors

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        if not docs:
            return np.empty(0)
        pooled = self.features(docs)[0]
        return np.maximum(pooled + self.bias, 0) @ self.weights + self.offset

    def scores(self, docs: list[np.ndarray], languages: list[str]) -> np.ndarray:
        """Probability-like scores; 0.5 is the threshold of the guessed language."""
        limit = np.array([self.thresholds.get(x, self.thresholds.get("", 0.0)) for x in languages])
        return 1 / (1 + np.exp(-np.clip(self.logits(docs) - limit, -30, 30)))


def _log_odds(docs: list[np.ndarray], labels: np.ndarray, buckets: int, prior: float = 4.0) -> np.ndarray:
    """Shrunk log odds of the label for all tables, from documents that hold the bucket."""
    out = np.zeros((len(PARTS), buckets), np.float32)
    base = labels.mean()
    for t in range(len(PARTS)):
        with_one, with_any = np.zeros(buckets), np.zeros(buckets)
        for doc, label in zip(docs, labels):
            met = np.unique(unpacked(doc, buckets)[t])
            with_any[met] += 1
            with_one[met] += label
        rate = (with_one + prior * base) / (with_any + prior)
        out[t] = np.log(rate / (1 - rate)) - np.log(base / (1 - base))
    return out / len(PARTS)


def train(docs: list[np.ndarray], labels: np.ndarray, languages: list[str], buckets: int = BUCKETS, seed: int = 0) -> Model | None:
    """Fit by Adam on the maxima; None if one class is missing."""
    if len(set(labels.tolist())) < 2:
        return None
    random = np.random.default_rng(seed)
    held = np.arange(len(docs)) % 5 == 0
    if len(set(labels[~held].tolist())) < 2:
        held[:] = False
    fitted = np.flatnonzero(~held)
    tables = random.normal(0, 0.01, (len(PARTS), buckets, DIMENSIONS)).astype(np.float32)
    tables[:, :, 0] = _log_odds([docs[i] for i in fitted], labels[fitted], buckets)
    filters = [random.normal(0, 0.1, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for taps in filters:
        taps[:, 0, :] += 1.0 / len(taps)
    model = Model(tables, filters, np.full(len(WIDTHS) * FILTERS, -0.5, np.float32),
                  np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), -2.0)
    means = {k: 0.0 for k in range(len(filters) + 3)}
    squares = dict(means)
    step = 0

    def adam(k: int, value, gradient):
        means[k] = 0.9 * means[k] + 0.1 * gradient
        squares[k] = 0.999 * squares[k] + 0.001 * gradient * gradient
        return value - RATE * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.999**step)) + 1e-8)

    for _ in range(EPOCHS):
        for some in np.array_split(random.permutation(fitted), max(1, len(fitted) // BATCH)):
            step += 1
            chosen = [docs[i] for i in some]
            pooled, places, packed, vectors = model.features(chosen)
            hidden = np.maximum(pooled + model.bias, 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ model.weights + model.offset, -30, 30))) - labels[some]) / len(some)
            inner = (error[:, None] * model.weights) * (hidden > 0)
            new_filters = []
            for k, (taps, (out, starts, lens)) in enumerate(zip(model.filters, places)):
                slot = slice(k * FILTERS, (k + 1) * FILTERS)
                at = np.stack([out[a: a + n].argmax(axis=0) + a for a, n in zip(starts, lens)])
                flow = inner[:, slot]
                gradient = np.zeros_like(taps)
                for j in range(len(taps)):
                    where = np.minimum(at + j, len(packed) - 1)
                    gradient[j] = np.einsum("df,dfe->ef", flow, vectors[where])
                    back = np.einsum("df,ef->dfe", flow, taps[j]).reshape(-1, DIMENSIONS)
                    words = packed[where.reshape(-1)]
                    known = words >= 0
                    for table, bucket in zip(model.tables, unpacked(words[known], buckets)):
                        np.add.at(table, bucket, -RATE * 5 * back[known])
                new_filters.append(adam(k, taps, gradient).astype(np.float32))
            n = len(filters)
            model.weights, model.bias, model.offset = (
                adam(n, model.weights, hidden.T @ error), adam(n + 1, model.bias, inner.sum(axis=0)),
                float(adam(n + 2, model.offset, error.sum())),
            )
            model.filters = new_filters
    _calibrate(model, docs, labels, languages, np.flatnonzero(held) if held.any() else fitted)
    return model


def _best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit at which F1 is best, halfway to the next lower one."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(hits) + 1) + labels.sum())
    at = int(f1.argmax())
    low = logits[order[at + 1]] if at + 1 < len(order) else logits[order[at]] - 1
    return float((logits[order[at]] + low) / 2)


def _calibrate(model: Model, docs, labels, languages, held: np.ndarray, least: int = 20) -> None:
    logits = np.concatenate([model.logits([docs[i] for i in part]) for part in np.array_split(held, len(held) // 256 + 1)])
    tongue = np.array([languages[i] for i in held])
    if labels[held].sum():
        model.thresholds[""] = _best_threshold(logits, labels[held])
    for lang in set(tongue.tolist()):
        inside = tongue == lang
        if labels[held][inside].sum() >= least and (1 - labels[held][inside]).sum() >= least:
            model.thresholds[lang] = _best_threshold(logits[inside], labels[held][inside])


def fit(
    docs: DataFrame, labels: DataFrame, usable=None, key: str = "doc_id", text: str = "text",
    label: str = "toxic", max_rows: int = MAX_ROWS,
) -> Model | None:
    """Train on at most `max_rows` labelled rows of `docs`. `usable` filters the keys (`_key`)."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.max(label).cast("int").alias("_label")
    )
    known = known.filter(usable) if usable is not None else known
    order = [F.xxhash64(F.col("_key").cast("string")), F.col("_key")]
    some = F.broadcast(known.orderBy(*order).limit(max_rows))
    found = docs.select(F.col(key).alias("_id"), whole_text(text).alias("text")).join(some, F.col("_id") == F.col("_key"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            made = [hashed_words(t.as_py(), known=known) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([m[0] for m in made], pa.list_(pa.int64())),
                pa.array([m[1] for m in made], pa.string()),
            ], names=["key", "label", "words", "language"])

    kind = found.schema["_id"].dataType.simpleString()
    rows = found.select("_id", "text", "_label").mapInArrow(
        hashed, f"key {kind}, label int, words array<long>, language string"
    ).orderBy(F.xxhash64(F.col("key").cast("string")), "key", F.xxhash64("words")).limit(max_rows).toPandas()
    if not len(rows):
        return None
    return train([np.asarray(w, np.int64) for w in rows.words], rows.label.to_numpy(), rows.language.tolist())


def with_score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with the column score."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for texts in batches:
            out = []
            for at in range(0, len(texts), 64):
                made = [hashed_words(t, known=known) for t in texts.iloc[at: at + 64]]
                out.append(model.scores([m[0] for m in made], [m[1] for m in made]))
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.withColumn("score", score(whole_text(text)))
