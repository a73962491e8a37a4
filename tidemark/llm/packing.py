"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

A document's ids (its tokens, then one end id) are cut into full windows and one remainder; remainders longer
than ``max_piece`` are cut again, so that windows can be made nearly equal. Pieces of up to ``batch`` tokens'
worth of consecutive documents are packed together: starting from the fewest windows that could hold them,
largest-differencing merges the two partial partitions of greatest spread, joining the fullest windows of one
with the emptiest of the other. If the fullest window then exceeds the capacity, the count rises by one.

Each task packs what it reads, in order, in batches of bounded size: no shuffle, and no step holds more than a
batch and one document. A sequence id is (task number, running number), so a task that is run again after a
lost executor, over the same file split, writes the same rows.

Defined results: a null or empty text is the end id alone; repeated rows, and rows with a null id, are packed as documents of their own; an
empty table gives no rows; only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import slices, values
from .tokens import encoder

def differencing(sizes: list[int], k: int) -> tuple[list[int], list[list[int]]]:
    """Karmarkar-Karp: the sums and members of k bins."""
    heap = [(-s, i, np.array([s] + [0] * (k - 1)), [[i]] + [[]] * (k - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        y = y[::-1]
        bins = [x[j] + y[j] if x[j] and y[j] else x[j] or y[j] for j in order.tolist()]
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), i, sums, bins))
    return heap[0][2].tolist(), heap[0][3]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Members of each window; the window count rises until none exceeds the capacity."""
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    while True:
        sums, bins = differencing(sizes, k)
        if max(sums) <= capacity:
            return [b for b in bins if b]
        k += 1


@dataclass(frozen=True)
class Packing:
    capacity: int = 2048
    max_piece: int = 700
    batch: int = 384
    end_id: int = 1


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", how: Packing = Packing(), with_ids: bool = False) -> DataFrame:
    """One row per piece: where it comes from, where it lies, and (with_ids) its ids."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([read.schema["doc_id"], *T.StructType.fromDDL(PIECES).fields])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    ship(docs.sparkSession)
    return read.mapInArrow(_packer(tokenizer_path, how, schema.names), schema)


def _packer(path: str, how: Packing, names: list[str]) -> Callable:
    cap = how.capacity
    end = np.array([how.end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        next_id = (task.partitionId() if task else 0) << 40
        tokens, out, waiting = encoder(path), [], []

        def put(piece: tuple, sequence: int, offset: int) -> None:
            doc, start, ids, total = piece
            row = (doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset)
            out.append((*row, np.frombuffer(ids, "<u4").astype("i4")) if "ids" in names else row)

        def settle() -> None:
            nonlocal next_id
            for members in windows([len(p[2]) // 4 for p in waiting], cap):
                at = 0
                for m in members:
                    put(waiting[m], next_id, at)
                    at += len(waiting[m][2]) // 4
                next_id += 1
            waiting.clear()

        for b in slices(batches):
            kind = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), values(b.column(1))):
                ids = tokens.encode(text or "") + end
                n = len(ids) // 4
                full = n // cap * cap
                for s in range(0, full, cap):
                    put((doc, s, ids[4 * s : 4 * (s + cap)], n), next_id, 0)
                    next_id += 1
                parts = -(-(n - full) // how.max_piece)
                for p in range(parts):
                    s, e = full + (n - full) * p // parts, full + (n - full) * (p + 1) // parts
                    waiting.append((doc, s, ids[4 * s : 4 * e], n))
                if len(waiting) >= how.batch:
                    settle()
                if len(out) >= 4096:
                    yield _rows(out, names, kind)
                    out.clear()
        settle()
        if out:
            yield _rows(out, names, kind)

    return run


def _rows(out: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    kinds = {"doc_id": kind, "ids": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, zip(*out))], names)
