"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The model is trained by follow-the-regularised-leader with elastic-net penalties on a bounded sample of labelled rows,
then calibrated by one temperature. Document frequencies are counted over all rows it may learn from; they are a vector of fixed
size. The sample (`most_rows` rows, those with the smallest hash of doc_id) is collected to the driver, which trains in
a second or so; everything else is one scan of the texts each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .shared import hash_sample, held_out, small_batches

#: Hashed features: a fixed number, which bounds the model.
FEATURES = 1 << 14
ORDERS = (1, 2, 3)
UNKNOWN = "und"
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def grams(text: str) -> np.ndarray:
    """Feature numbers of all character n-grams of a text: letters lower-cased, all else one blank."""
    points = arrays.lower_points()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.uint64)
    plain = points < 128
    letter = ~plain | ((points >= 97) & (points <= 122))
    points = np.where(letter, points, 32)
    keep = np.ones(len(points), bool)
    keep[1:] = letter[1:] | letter[:-1]
    points = points[keep]
    out = []
    for order in ORDERS:
        n = len(points) - order + 1
        if n <= 0:
            break
        h = np.full(n, order, np.uint64)
        for j in range(order):
            h = (h ^ points[j : j + n]) * _MULT[j]
            h ^= h >> np.uint64(29)
        out.append(h >> np.uint64(64 - 14))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(FEATURES, np.int64)
    rows = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            found = grams(text or "")
            seen = np.zeros(FEATURES, bool)
            seen[found] = True
            count += seen
            rows += 1
    feature = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(feature, -1), pa.int64()), pa.array(np.append(count[feature], rows), pa.int64())], names=["feature", "n"])


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and TF-IDF values of unit length; log frequencies."""
    count = np.bincount(grams(text), minlength=FEATURES)
    at = np.flatnonzero(count)
    value = np.log1p(count[at]) * idf[at]
    norm = np.sqrt((value * value).sum())
    return at, value / norm if norm else value


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates, L1 and L2 penalties, one weight vector a class."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.z = np.zeros((FEATURES, classes))
        self.n = np.zeros((FEATURES, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, value: np.ndarray, target: int) -> None:
        w = self.weights(at)
        p = softmax(value @ w)
        p[target] -= 1
        g = value[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, str]], idf: np.ndarray, epochs: int = 4) -> tuple[list[str], np.ndarray, float]:
    """(text, lang) rows in a fixed order -> the classes, the sparse weights and the temperature.

    Every fifth row is kept from training and fits the temperature, by the least mean negative log-likelihood.
    """
    classes = sorted({lang for _, lang in rows})
    number = {lang: i for i, lang in enumerate(classes)}
    # Narrow types: the driver holds all vectors of the sample at once.
    data = [(at.astype(np.int16), value.astype(np.float32), number[lang]) for (at, value), lang in ((vector(text, idf), lang) for text, lang in rows)]
    model = Ftrl(max(1, len(classes)))
    train = [x for i, x in enumerate(data) if i % 5 or len(data) < 50]
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(train)):
            model.learn(*train[i])
    weights = model.weights()
    rest = data[::5]
    if not rest:
        return classes, weights, 1.0
    logits = np.array([value @ weights[at] for at, value, _ in rest])
    target = np.array([t for _, _, t in rest])
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    loss = [-np.log(softmax(logits / t)[np.arange(len(target)), target] + 1e-12).mean() for t in grid]
    return classes, weights, float(grid[int(np.argmin(loss))])


def judge(text: str | None, model: tuple) -> tuple[str, float]:
    """Language and score of one text."""
    classes, weights, temperature, idf = model
    if not classes or not text or not has_letter(text):
        return UNKNOWN, 0.0
    at, value = vector(text, idf)
    p = softmax(value @ weights[at] / temperature)
    return classes[int(p.argmax())], float(p.max())


def _predict(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(text, shared.value) for text in batch.column(1).to_pylist()]
            langs, scores = [x for x, _ in found], [x for _, x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return predict


def _accept(shared, least_score: float, at: int):
    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(text, shared.value) for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in found], pa.bool_()))

    return accept


def _model(docs: DataFrame, most_rows: int):
    """The broadcast model of docs: classes, weights, temperature and inverse document frequencies."""
    spark = docs.sparkSession
    small_batches(spark)
    # Document frequencies too come from rows that may be learnt from only, all of them.
    learn = docs.where(~held_out("doc_id") & F.col("lang").isNotNull())
    counted = learn.select(F.col("text").cast("string")).mapInArrow(_document_frequency, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    n = {r["feature"]: r["n"] for r in counted}
    idf = np.log((1 + n.pop(-1, 0)) / (1 + np.array([n.get(i, 0) for i in range(FEATURES)]))) + 1
    rows = [r for r in hash_sample(learn, most_rows) if has_letter(r["text"])]
    return spark.sparkContext.broadcast((*fit([(r["text"], r["lang"]) for r in rows], idf), idf))


def identify_languages(docs: DataFrame, most_rows: int = 4000) -> DataFrame:
    """docs(doc_id, text, lang, ...) -> doc_id, held_out, lang_pred, score, one row per input row.

    The model learns from text and lang of at most most_rows rows that are not held out (crc32 of doc_id as text,
    mod 3, is not 1) and have text and lang: those with the smallest hash of doc_id. lang_pred is one of their
    languages, score its calibrated probability. Null and empty texts, and texts without letters, are `und` with score
    0; so is every text if there is nothing to learn from. A null doc_id counts as held out. Whole texts are read.
    Repeated rows are judged each; further columns are ignored; an empty table gives no row.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out("doc_id").alias("held_out"))
    return rows.mapInArrow(_predict(_model(docs, most_rows)), "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least_score: float = 0.0, most_rows: int = 4000) -> DataFrame:
    """The rows of docs whose text has a language: lang_pred is not `und` and its score is least_score at least. They
    leave the scan as they are, with the columns of docs; edge cases are those of identify_languages()."""
    return docs.mapInArrow(_accept(_model(docs, most_rows), least_score, docs.columns.index("text")), docs.schema)
