"""Quality scores by a regularised quadratic discriminant over document statistics.

Each text gives counts (``statistics``), smoothed as rates per word or byte and put on a log scale. Each class has the mean
of its training rows and a covariance shrunk towards the pooled one (``to_pooled``) and towards a
multiple of the identity (``to_round``). The score is the logistic function of the difference of the classes'
log densities: half the difference of Mahalanobis distances, of log determinants, and the log prior odds. The
inverse Cholesky factors are kept, so a batch is scored by two matrix products.

Training rows are the labelled documents outside the left-out fold; ``most_rows`` of them at most, taken in order of
a hash of the id, are the bounded sample.

Defined results: null and empty texts have all counts zero and are scored like any other; rows with a null id
are scored, not learned from, and count as not held out; repeated rows are scored alike; a document with
several labels is learned from once, with the least; without training rows of both classes every score is the share
of label 1 among them (0.5 if there are none); an empty table gives no rows; only the named columns are read, so other
columns may have any name. Scoring is per row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import held_out, slices, values

UPPER, DIGITS = bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A))


@dataclass(frozen=True)
class Discriminant:
    to_pooled: float = 0.05
    to_round: float = 0.1
    smoothing: float = 20.0
    most_rows: int = 20_000
    folds: int = 4
    left_out: int = 2
    accept: float = 0.7


def statistics(text: str | None, smoothing: float) -> list[float]:
    """Counts of one whole text as transformed rates."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), len(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = size - len(raw.translate(None, UPPER))
    digits = size - len(raw.translate(None, DIGITS))
    symbols = size - len(raw.translate(None, b"#*$%&<>"))
    per_word = [letters / 6, digits, symbols, raw.count(b"!"), raw.count(b"|"), raw.count(b"."), raw.count(b","), len(lines), len(lines) - len(set(lines)), n - len(set(words)), raw.count(b"http"), size / 6]
    rates = (np.array(per_word, float) + 0.02 * smoothing) / (n + smoothing)
    return [np.log1p(n) / 4, *np.log(rates).tolist()]


@dataclass
class Model:
    how: Discriminant
    prior: float = 0.5
    means: list[np.ndarray] | None = None
    inverse: list[np.ndarray] | None = None
    offset: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        d0, d1 = (((x - m) @ i.T) ** 2 for m, i in zip(self.means, self.inverse))
        return 1 / (1 + np.exp(-np.clip(self.offset + (d0.sum(axis=1) - d1.sum(axis=1)) / 2, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, how: Discriminant) -> Model:
    ones = int(y.sum())
    if min(ones, len(y) - ones) < 2:
        return Model(how, ones / len(y) if len(y) else 0.5)
    groups = [x[y == c] for c in (0, 1)]
    centred = [g - g.mean(axis=0) for g in groups]
    pooled = sum(c.T @ c for c in centred) / len(y)
    means, inverse, logdet = [], [], []
    for g, c in zip(groups, centred):
        cov = (1 - how.to_pooled) * (c.T @ c) / len(g) + how.to_pooled * pooled
        cov = (1 - how.to_round) * cov + how.to_round * np.trace(cov) / len(cov) * np.eye(len(cov)) + 1e-9 * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        means.append(g.mean(axis=0))
        inverse.append(np.linalg.inv(factor))
        logdet.append(2 * np.log(np.diag(factor)).sum())
    return Model(how, ones / len(y), means, inverse, (logdet[0] - logdet[1]) / 2 + float(np.log(ones / (len(y) - ones))))


def _matrix(texts: Iterable[str | None], how: Discriminant) -> np.ndarray:
    rows = [statistics(t, how.smoothing) for t in texts]
    return np.array(rows).reshape(len(rows), -1)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", how: Discriminant = Discriminant()) -> Model:
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.where(~held_out("doc_id", how.folds, how.left_out)).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(how.most_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = _matrix(values(b.column(1)), how)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    ship(docs.sparkSession)
    got = rows.select("doc_id", "text", "label").mapInArrow(run, f"doc_id {kind}, label int, x array<double>").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).orderBy("doc_id").collect()
    return fit(np.array([r["x"] for r in got]), np.array([r["label"] for r in got], int), how)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    how = model.how
    read = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, how.folds, how.left_out).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([read.schema["doc_id"], *T.StructType.fromDDL("held_out boolean, score double, predicted int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = model.scores(_matrix(values(b.column(2)), how))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= how.accept).astype(np.int32), pa.int32())], schema.names)

    ship(docs.sparkSession)
    return read.mapInArrow(run, schema)
