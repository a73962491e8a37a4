"""Chroma audio fingerprints, and the alignment of recordings by them.

Samples are cut into overlapping frames, whose spectra are folded to twelve pitch classes. Over the image of frames and
classes an integral image gives the sum of any rectangle in four look-ups; sixteen filters, each the log ratio of the sums of
two parts of a window, are quantised to two bits (Gray code) and packed into one integer per window position.

Recordings with equal fingerprints form a class named after its smallest id. The query set is every recording whose id is
divisible by ``query_step``; classes that hold one are compared with all classes. Each
integer has four keys, which leave out one of its bytes each; every offset at which a pair shares a key of integers that are not those of silence
is a candidate, so that an integer with its differing bits in one byte still proposes. A histogram of the offsets counts the keys shared at each; the share of differing bits over
the overlap decides, and of the offsets that pass the one with most shared keys is the alignment.

The query set meets all classes in blocks of about ``BLOCK_CODES`` integers, which are broadcast: each task looks the keys of its classes up in
a block's, and counts, confirms and sums up there, ``MOST_VOTES`` votes at a time, so that neither votes nor links become rows.

Defined results: a null, empty or too short recording has no integers, is its own class and matches nothing; values
that are not numbers are silence; recordings whose integers are all those of silence are compared with each other, at offset 0, and match where the overlap allows; a row with a null id has a null class and is never a query; repeated rows are of one class; equal votes go to the offset nearest 0, then
to the smaller one; an empty table gives no rows; only the named columns are read, so other columns may have any name. Classes keep
groups of copies from being expanded into pairs.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import slices, stored


#: Integers of the queries that are broadcast together (some 50 bytes each, with their keys), and votes that are counted together.
BLOCK_CODES, MOST_VOTES = 1 << 18, 1 << 21


@dataclass(frozen=True)
class Chroma:
    rate: int = 4000
    frame: int = 512
    hop: int = 256
    low_hz: float = 200.0
    high_hz: float = 1900.0
    width: int = 8
    edges: tuple[float, float, float] = (-0.6, 0.0, 0.6)
    query_step: int = 100
    max_bit_error: float = 0.2
    min_overlap: int = 8


def filters(width: int) -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of the sixteen filters: each kind at steps of the octave."""
    return [(i % 4, 3 * (i // 4), (3, 4, 6, 12 - 3 * (i // 4))[i % 4], (width, width // 2, width, width // 2)[i // 4]) for i in range(16)]


@lru_cache(8)
def _fold(how: Chroma) -> tuple[np.ndarray, slice, np.ndarray]:
    """The frame's window, the used frequencies, and the pitch class of each."""
    hz = np.fft.rfftfreq(how.frame, 1 / how.rate)
    used = np.flatnonzero((hz >= how.low_hz) & (hz <= how.high_hz))
    fold = np.zeros((len(used), 12), np.float32)
    fold[np.arange(len(used)), np.round(12 * np.log2(hz[used] / 440)).astype(int) % 12] = 1
    return np.hanning(how.frame).astype(np.float32), slice(used[0], used[-1] + 1), fold


def chroma_frames(samples: np.ndarray, how: Chroma) -> np.ndarray:
    """Energy of the twelve pitch classes per frame, each frame summing to 1 (silence: 0)."""
    n = (len(samples) - how.frame) // how.hop + 1
    if n < 1:
        return np.zeros((0, 12))
    window, used, fold = _fold(how)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), how.frame)[:: how.hop][:n]
    spectrum = np.fft.rfft(frames * window, axis=1)[:, used]
    out = ((spectrum.real**2 + spectrum.imag**2) @ fold).astype(np.float64)
    total = out.sum(axis=1, keepdims=True)
    return np.divide(out, total, out=np.zeros_like(out), where=total > 1e-9)


def packed(chroma: np.ndarray, how: Chroma) -> np.ndarray:
    """One 32-bit integer per position of the window."""
    n = len(chroma) - how.width + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    whole = np.zeros((len(chroma) + 1, 13))
    whole[1:, 1:] = chroma.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)
    area = lambda t0, t1, c0, c1: whole[at + t1, c1] - whole[at + t0, c1] - whole[at + t1, c0] + whole[at + t0, c0]
    codes = np.zeros(n, np.uint32)
    for kind, c, classes, frames in filters(how.width):
        e = min(12, c + classes)
        half, mid = frames // 2, (c + e) // 2
        if kind == 0:  # the two halves in time
            a, b = area(0, half, c, e), area(half, frames, c, e)
        elif kind == 1:  # the two halves in pitch
            a, b = area(0, frames, c, mid), area(0, frames, mid, e)
        elif kind == 2:  # opposite quarters
            a = area(0, half, c, mid) + area(half, frames, mid, e)
            b = area(0, half, mid, e) + area(half, frames, c, mid)
        else:  # the band against all classes
            a = area(0, frames, c, mid)
            b = area(0, frames, 0, 12) - a
        level = np.digitize(np.log((a + 0.05) / (b + 0.05)), how.edges)
        codes = (codes << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return codes


def tones(values: list[float] | None, how: Chroma) -> np.ndarray:
    """The recording of a list of numbers: a hop long note for each, of the pitch that its size gives."""
    v = np.array([np.nan if x is None else x for x in values or []], float)
    loud = np.isfinite(v)
    v = np.where(loud, v, 0)
    top = np.abs(v).max(initial=0) or 1.0
    step = 2 * np.pi * 440 * 2 ** (np.round(12 * v / top) / 12) / how.rate
    phase = np.cumsum(np.repeat(step, how.hop))
    return np.sin(phase) * np.repeat(loud, how.hop)


def wav(data: bytes | None, how: Chroma) -> np.ndarray:
    """The samples of a RIFF/WAVE file: linear PCM of 8 to 32 bits or floats, channels averaged, at the rate of ``how``.

    Null, damaged and otherwise encoded files have no samples; a file that ends early has those that are there."""
    none = np.zeros(0)
    if not data or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return none
    at, form, body = 12, None, None
    while at + 8 <= len(data) and body is None:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(data):
            form = struct.unpack_from("<HHIIHH", data, at + 8)
            if form[0] == 0xFFFE and size >= 40 and at + 34 <= len(data):  # the code is the start of a longer id
                form = (struct.unpack_from("<H", data, at + 32)[0], *form[1:])
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or body is None:
        return none
    code, channels, rate, _, _, bits = form
    width = bits // 8
    if not channels or not rate or (code, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)}:
        return none
    n = len(body) // (width * channels)
    raw = np.frombuffer(body, np.uint8, n * channels * width).reshape(-1, width)
    if code == 3:
        x = raw.view(f"<f{width}")[:, 0].astype(float)
    elif bits == 8:
        x = (raw[:, 0].astype(float) - 128) / 128
    else:  # at the top of 32 bits, so that the sign is in place
        x = np.pad(raw, ((0, 0), (4 - width, 0))).view("<i4")[:, 0] / 2.0**31
    with np.errstate(invalid="ignore"):  # values that are not numbers, or too large to square, are silence
        x = np.where(np.abs(x) < 1e15, x, 0.0).reshape(n, channels).mean(axis=1)
    return resampled(x, rate, how.rate)


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples at another rate: means over the new steps on the way down, so that higher pitches fold back less, then linear."""
    if rate == to or not len(x):
        return x
    at = np.arange(int(len(x) * to / rate)) * (rate / to)
    step = rate // to
    if step > 1:
        total = np.concatenate([[0.0], np.cumsum(np.pad(x, (step // 2, step - 1 - step // 2), mode="edge"))])
        x = (total[step:] - total[:-step]) / step
    return np.interp(at, np.arange(len(x)), x)


def fingerprints(recordings: DataFrame, id_col: str, data_col: str, samples: Callable[[object, Chroma], np.ndarray], how: Chroma = Chroma()) -> DataFrame:
    """id, codes (array of int) and fkey (null without codes) of each recording; ``samples`` decodes a value of data_col."""
    read = recordings.select(F.col(id_col).cast("long").alias("id"), F.col(data_col).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            codes = [packed(chroma_frames(samples(x, how), how), how) for x in b.column(1).to_pylist()]
            keys = [hashlib.blake2b(c.tobytes(), digest_size=16).digest() if len(c) else None for c in codes]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.view(np.int32) for c in codes], pa.list_(pa.int32())), pa.array(keys, pa.binary())], ["id", "codes", "fkey"])

    ship(recordings.sparkSession)
    return read.mapInArrow(run, T.StructType.fromDDL("id long, codes array<int>, fkey binary"))


class Queries:
    """A block of query classes, found by the keys of their integers."""

    def __init__(self, ids: np.ndarray, codes: list[np.ndarray], how: Chroma):
        self.ids, self.how = ids, how
        self.size = np.array([len(c) for c in codes], np.int64)
        self.flat = np.concatenate(codes) if codes else np.empty(0, np.uint32)
        self.start = np.cumsum(self.size) - self.size
        keys, self.of, self.at = voting_keys(codes, how)
        order = np.argsort(keys, kind="stable")
        self.keys, self.of, self.at = keys[order], self.of[order], self.at[order]

    def matches(self, ids: np.ndarray, codes: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, query, offset, bit error) of the best alignment of each row with each query of another class, rows in order."""
        keys, of, at = voting_keys(codes, self.how)
        order = np.argsort(of, kind="stable")
        keys, of, at = keys[order], of[order], at[order]
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        upto = np.cumsum(high - low)
        size = np.array([len(c) for c in codes], np.int64)
        flat, start = np.concatenate(codes) if codes else np.empty(0, np.uint32), np.cumsum(size) - size
        last = np.searchsorted(of, np.arange(len(codes)), "right")
        row = 0
        while row < len(codes):
            # rows whose votes fit together, one at least
            first = last[row - 1] if row else 0
            seen = upto[first - 1] if first else 0
            end = max(row + 1, int(np.searchsorted(upto[np.maximum(last - 1, 0)] * (last > 0), seen + MOST_VOTES, "right")))
            some = slice(first, last[end - 1])
            n = (high - low)[some]
            hit = np.repeat(low[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield self._best(np.repeat(of[some], n), self.of[hit], self.at[hit] - np.repeat(at[some], n), ids, flat, start, size)
            row = end

    def _best(self, row, query, offset, ids, flat, start, size) -> tuple[np.ndarray, ...]:
        other = ids[row] != self.ids[query]
        row, query, offset = row[other], query[other], offset[other]
        span = int(np.abs(offset).max(initial=0)) + 1
        pair = row * len(self.ids) + query
        pair, votes = np.unique(pair * (2 * span) + offset + span, return_counts=True)
        pair, offset = pair // (2 * span), pair % (2 * span) - span
        row, query = pair // len(self.ids), pair % len(self.ids)
        first = np.maximum(0, -offset)
        overlap = np.minimum(size[row] - first, self.size[query] - first - offset)
        enough = overlap >= self.how.min_overlap
        pair, row, query, offset, votes, first, overlap = (x[enough] for x in (pair, row, query, offset, votes, first, overlap))
        wrong = np.zeros(len(row))
        total = np.cumsum(overlap)
        for i in np.unique(total // MOST_VOTES).tolist():
            part = slice(*np.searchsorted(total // MOST_VOTES, [i, i + 1]))
            n = overlap[part]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            mine = flat[np.repeat(start[row[part]] + first[part], n) + step]
            theirs = self.flat[np.repeat(self.start[query[part]] + first[part] + offset[part], n) + step]
            wrong[part] = np.add.reduceat(np.bitwise_count(mine ^ theirs).astype(np.int64), np.cumsum(n) - n)
        error = wrong / (32.0 * overlap)
        good = np.flatnonzero(error <= self.how.max_bit_error)
        order = good[np.lexsort((offset[good], np.abs(offset[good]), -votes[good], pair[good]))]
        order = order[np.diff(pair[order], prepend=-1) != 0]
        return row[order], query[order], offset[order], error[order]


def voting_keys(codes: list[np.ndarray], how: Chroma) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, recording, position) of the votes: each integer without one of its bytes, and which."""
    silence = packed(np.zeros((how.width, 12)), how)[0]
    flat = np.concatenate(codes).astype(np.uint64) if codes else np.empty(0, np.uint64)
    size = np.array([len(c) for c in codes], np.int64)
    of = np.repeat(np.arange(len(codes)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    # a window of silence looks alike everywhere and casts no vote, its bits count like any others; what is nothing else casts one
    loud = flat != silence
    quiet = np.bincount(of[loud], minlength=len(codes)) == 0
    votes = loud | (quiet[of] & (at == 0))
    flat, of, at = flat[votes], of[votes], at[votes]
    keys = [flat & np.uint64(0xFFFFFFFF & ~(0xFF << 8 * i)) | np.uint64(i << 32) for i in range(4)]
    return np.concatenate(keys), np.tile(of, 4), np.tile(at, 4)


def _integers(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy().view(np.uint32), column.offsets.to_numpy()
    return [flat[s:e] for s, e in zip(ends[:-1], ends[1:])]


def _against_queries(classes: DataFrame, how: Chroma, schema: str, rows: Callable) -> DataFrame:
    """Classes (class_id, codes, is_query) against all query classes, in blocks of bounded size; ``rows`` makes columns of a batch's matches."""
    spark = classes.sparkSession
    asked = stored(classes.where("is_query").select("class_id", "codes"), "media-queries")
    number = int(-(-(asked.agg(F.sum(F.size("codes").cast("long"))).first()[0] or 0) // BLOCK_CODES)) or 1
    names = [f.split()[0] for f in schema.split(", ")]

    def against(block: int) -> DataFrame:
        t = asked.where(F.pmod(F.xxhash64("class_id"), F.lit(number)) == block).toArrow().combine_chunks()
        codes = [c for chunk in t["codes"].chunks for c in _integers(chunk)]
        shared = spark.sparkContext.broadcast((t["class_id"].to_numpy(), codes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = Queries(*shared.value, how)
            for b in slices(batches):
                ids = b.column(0).to_numpy()
                for row, query, offset, error in queries.matches(ids, _integers(b.column(1))):
                    yield pa.RecordBatch.from_arrays(rows(ids[row], queries.ids[query], offset, error), names)

        return classes.select("class_id", "codes").mapInArrow(run, schema)

    ship(spark)
    return reduce(DataFrame.union, map(against, range(number)))


def links(classes: DataFrame, how: Chroma = Chroma()) -> DataFrame:
    """(class_id, q, offset, bit_error): of classes (class_id, codes, is_query), the other classes that each query class matches."""
    return _against_queries(classes, how, "class_id long, q long, offset long, bit_error double", lambda *columns: list(map(pa.array, columns)))


def _summed(row: np.ndarray, query: np.ndarray, offset: np.ndarray, error: np.ndarray) -> list[pa.Array]:
    """Per class, which stand together: how many matches, and the best."""
    order = np.lexsort((offset, query, error, row))
    row, query, offset, error = row[order], query[order], offset[order], error[order]
    first = np.flatnonzero(np.diff(row, prepend=row[:1] - 1))
    return [pa.array(x) for x in (row[first], np.diff(first, append=len(row)), error[first], query[first], offset[first])]


def match_sums(classes: DataFrame, how: Chroma = Chroma()) -> DataFrame:
    """(class_id, n_matches, best) without a row for each link, of which a large group of near copies has many."""
    found = _against_queries(classes, how, "class_id long, n long, bit_error double, q long, offset long", _summed)
    return found.groupBy("class_id").agg(F.sum("n").alias("n_matches"), F.min(F.struct("bit_error", "q", "offset")).alias("best"))


def align(prints: DataFrame, how: Chroma = Chroma()) -> DataFrame:
    """One row per recording: id, n_codes, class_id, is_query, n_matches, and its best query class with offset and bit error.

    Matches are query classes other than the recording's own."""
    known = prints.where("fkey IS NOT NULL AND id IS NOT NULL")
    wanted = F.pmod("id", F.lit(how.query_step)) == 0
    classes = stored(known.groupBy("fkey").agg(F.min("id").alias("class_id"), F.min_by("codes", "id").alias("codes"), F.bool_or(wanted).alias("is_query")), "media-classes")
    matches = match_sums(classes, how)
    named = classes.select("fkey", "class_id").join(matches, "class_id", "left")
    return prints.join(named, "fkey", "left").select(
        "id",
        F.size("codes").cast("long").alias("n_codes"),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce(wanted, F.lit(False)).alias("is_query"),
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
        F.col("best")["q"].alias("best_query"),
        F.col("best")["offset"].cast("long").alias("best_offset"),
        F.col("best")["bit_error"].alias("bit_error"),
    )


def vectors_as_recordings(embeddings: DataFrame, how: Chroma = Chroma()) -> DataFrame:
    """Fingerprints and alignments of the recordings that the vectors stand for."""
    prints = stored(fingerprints(embeddings, "vec_id", "embedding", tones, how), "media-prints")
    return align(prints, how).withColumnRenamed("id", "vec_id")
