"""Language identification with a blended-spectrum string kernel.

A text is the set of character n-grams (n = 1, 2, 3) that occur in it, in lower case and with every run of
characters that are not letters read as spaces; n-grams are hashed to ``sizes`` numbers. The kernel of two texts
is the sum over n of weight_n * |common n-grams| / sqrt(|n-grams| * |n-grams|).

Training: up to ``per_language`` texts of each language and ``most`` in all, taken in order of a hash of the id, are the
bounded sample; its first ``landmarks`` texts, dealt over the languages, span the Nyström features K_mm^(-1/2) k(x, L); one
ridge regression per language against the rest is solved on them. As the kernel is a scalar product, landmark
matrix and regression multiply out to one weight per n-gram and language, so a batch of texts is scored by
the product of its presence matrix, stored as lists of n-grams, and that weight matrix.

Defined results: ``und`` with score 0 for a text that is null or has no letter, and for all texts when nothing could be
learned; rows with a null id or null language are predicted but not learned from, and count as not held out;
repeated rows are predicted alike and learned from once; equal scores go to the first language in order of
name; an empty table gives no rows; only the named columns are read, so other columns may have any name.
Prediction is per row, without a shuffle; long texts are read in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import held_out, slices, values

UNKNOWN = "und"
BLOCK = 1 << 20


@dataclass(frozen=True)
class Kernel:
    sizes: tuple[int, ...] = (1 << 10, 1 << 15, 1 << 16)
    weights: tuple[float, ...] = (0.2, 0.3, 0.5)
    per_language: int = 400
    most: int = 2400
    landmarks: int = 160
    ridge: float = 1e-3
    sharpness: float = 6.0
    folds: int = 4
    left_out: int = 2


@lru_cache(1)
def letter_table() -> np.ndarray:
    """The lower-case letter of each code point, a space for all that are none; the last stands for the rest, the planes without letters."""
    out = np.full(0x40001, 32, np.uint64)
    for c in range(0x40000):
        if chr(c).isalpha():
            out[c] = ord(chr(c).lower()[0])
    return out


def ngrams(text: str | None, sizes: tuple[int, ...]) -> list[np.ndarray] | None:
    """The hashed n-grams that occur, per n; None for a text without letters."""
    present = [np.zeros(s, bool) for s in sizes]
    letters, table = False, letter_table()
    text = text or ""
    for at in range(0, len(text), BLOCK):
        raw = np.frombuffer(text[at : at + BLOCK + len(sizes) - 1].encode("utf-32-le", "replace"), np.uint32)
        c = table[np.minimum(raw, len(table) - 1)]
        letters = letters or bool((c != 32).any())
        h = np.zeros(len(c), np.uint64)
        for n, s in enumerate(sizes):
            h = h[: len(c) - n] * np.uint64(0x9E3779B97F4A7C15) + c[n:]
            present[n][((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - s.bit_length() + 1)).astype(np.int64)] = True
    return [np.flatnonzero(p) for p in present] if letters else None


@dataclass
class Model:
    kernel: Kernel
    languages: list[str] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        grams = [ngrams(t, self.kernel.sizes) if self.languages else None for t in texts]
        known = [g for g in grams if g is not None]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not known:
            return names, scores
        f = np.zeros((len(known), len(self.languages)))
        for n, w in enumerate(self.weights):
            counts = np.array([len(g[n]) for g in known])
            some = np.flatnonzero(counts)
            if len(some):
                starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
                total = np.add.reduceat(w[np.concatenate([known[i][n] for i in some])], starts, axis=0)
                f[some] += total / np.sqrt(counts[some])[:, None]
        best = f.argmax(axis=1)
        p = np.exp(self.kernel.sharpness * (f - f.max(axis=1, keepdims=True)))
        p = 1 / p.sum(axis=1)
        at = iter(zip(best.tolist(), p.tolist()))
        for i, g in enumerate(grams):
            if g is not None:
                b, scores[i] = next(at)
                names[i] = self.languages[b]
        return names, scores


def fit(sample: list[tuple[str, list[np.ndarray]]], kernel: Kernel) -> Model:
    """Nyström ridge regression over (language, n-grams) rows."""
    languages = sorted({lang for lang, _ in sample})
    if not sample:
        return Model(kernel)
    by = {lang: [g for x, g in sample if x == lang] for lang in languages}
    marks = [by[lang][i] for i in range(max(map(len, by.values()))) for lang in languages if i < len(by[lang])][: kernel.landmarks]
    mark_phi = []
    for n, size in enumerate(kernel.sizes):
        phi = np.zeros((len(marks), size), np.float32)
        for i, g in enumerate(marks):
            if len(g[n]):
                phi[i, g[n]] = np.sqrt(kernel.weights[n] / len(g[n]))
        mark_phi.append(phi)
    kmm = sum(p.astype(np.float64) @ p.T.astype(np.float64) for p in mark_phi)
    values, vectors = np.linalg.eigh(kmm)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    k = np.zeros((len(sample), len(marks)))
    for i, (_, g) in enumerate(sample):
        for n, phi in enumerate(mark_phi):
            if len(g[n]):
                k[i] += phi[:, g[n]].sum(axis=1) * np.sqrt(kernel.weights[n] / len(g[n]))
    z = k @ root
    y = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang, _ in sample])
    dual = root @ np.linalg.solve(z.T @ z + kernel.ridge * len(sample) * np.eye(len(marks)), z.T @ y)
    weights = [(phi.T @ dual * np.sqrt(kernel.weights[n])).astype(np.float32) for n, phi in enumerate(mark_phi)]
    return Model(kernel, languages, weights)


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", kernel: Kernel = Kernel()) -> Model:
    """Fit on the bounded sample; languages are the non-null values of lang_col outside the left-out fold."""
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out("doc_id", kernel.folds, kernel.left_out))
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    # a hash threshold from each language's count leaves few rows to be ranked, whatever the number of tasks; the sample
    # holds no more languages than rows, so their table is small enough to be broadcast
    counts = ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(kernel.most)
    counts = counts.select("lang", F.least(F.lit(1.0), F.lit(4.0 * kernel.per_language) / F.col("n")).alias("share"))
    ids = ids.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)), F.lit(1 << 40)) <= F.col("share") * float(1 << 40)).drop("share")
    ranked = ids.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("nth") <= kernel.per_language)
    chosen = ranked.orderBy("nth", "lang").limit(kernel.most).select("doc_id", F.col("lang").alias("of_lang"), "nth").distinct()
    rows = _read(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "of_lang").agg(F.min("text").alias("text"), F.min("nth").alias("nth"))
    sizes = kernel.sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            t = b.to_pylist()
            found = [(r["of_lang"], r["nth"], ngrams(r["text"], sizes)) for r in t]
            found = [(a, n, [x.astype(np.int32) for x in g]) for a, n, g in found if g is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64()), pa.array([[y.tobytes() for y in x[2]] for x in found], pa.list_(pa.binary()))], ["lang", "nth", "grams"])

    ship(docs.sparkSession)
    got = rows.select("of_lang", "nth", "text").mapInArrow(run, "lang string, nth long, grams array<binary>").collect()
    got.sort(key=lambda r: (r["nth"], r["lang"]))
    return fit([(r["lang"], [np.frombuffer(x, np.int32) for x in r["grams"]]) for r in got], kernel)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    read = _read(docs, id_col, text_col).select("doc_id", held_out("doc_id", model.kernel.folds, model.kernel.left_out).alias("held_out"), "text")
    schema = T.StructType([read.schema["doc_id"], *T.StructType.fromDDL("held_out boolean, lang_pred string, score double").fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            names, scores = shared.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema.names)

    ship(docs.sparkSession)
    return read.mapInArrow(run, schema)


def known_language(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.5, languages: list[str] | None = None) -> DataFrame:
    """The documents whose predicted language is one of ``languages`` (all that were learned, by default) with at least the score, with all their columns.

    A score of one half says that the language outweighs all others together. Null texts and texts without a letter have no language and go;
    when nothing could be learned, all with a letter stay, unless languages are asked for. Only the text is sent to Python."""
    shared, accepted = docs.sparkSession.sparkContext.broadcast(model), None if languages is None else set(languages)

    @F.arrow_udf(T.BooleanType())
    def accept(texts: pa.Array) -> pa.Array:
        keep: list[bool] = []
        for at in range(0, len(texts), 512):
            some = texts.slice(at, 512).to_pylist()
            if shared.value.languages:
                keep += [name != UNKNOWN and score >= least_score and (accepted is None or name in accepted) for name, score in zip(*shared.value.predict(some))]
            else:
                keep += [accepted is None and ngrams(x, shared.value.kernel.sizes) is not None for x in some]
        return pa.array(keep, pa.bool_())

    ship(docs.sparkSession)
    return docs.where(accept(F.col(text_col)))
