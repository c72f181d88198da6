"""How common each token of the corpus is, by counters of a fixed number: a token's counter is that of its hash's first
bits. The counts cover every document. They serve to put a set's tokens in one order, rare ones first; any order gives
right joins, so that counters are shared costs no result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

PART = 14  # bits of a counter within a part


def counters(docs: DataFrame, tokens: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray | None]], bits: int) -> np.ndarray:
    """1 << bits counters. tokens gives the hashes of some tokens of a batch, and how many of each (None: one). What a task sends is
    bounded by the counters."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for part in c.slices(batches):
            hashes, many = tokens(part)
            at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
            if many is None:
                total += np.bincount(at, minlength=1 << bits)
            else:
                np.add.at(total, at, many)
        used = np.flatnonzero(total)
        if len(used):
            edges = np.searchsorted(used >> PART, np.arange((1 << bits - PART) + 1))
            pids = np.flatnonzero(np.diff(edges))
            low = [(used[edges[p] : edges[p + 1]] & ((1 << PART) - 1)).astype("<u2").tobytes() for p in pids]
            yield pa.RecordBatch.from_pydict({"pid": pa.array(pids, pa.int32()), "at": low, "n": [np.minimum(total[used[edges[p] : edges[p + 1]]], 0xFFFFFFFF).astype("<u4").tobytes() for p in pids]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, pid = np.zeros(1 << PART, np.int64), None
        for batch in batches:
            for row in batch.to_pylist():
                pid = row["pid"]
                total[np.frombuffer(row["at"], "<u2")] += np.frombuffer(row["n"], "<u4")
        if pid is not None:
            yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "n": [np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()]})

    sent = docs.mapInArrow(each, "pid int, at binary, n binary")
    out = np.zeros((1 << bits - PART, 1 << PART), np.uint32)
    for pid, n in c.exchange(sent, 1 << bits - PART).mapInArrow(merge, "pid int, n binary").collect():
        out[pid] = np.frombuffer(n, "<u4")
    return out.ravel()


def bitmap(bits: DataFrame, size: int) -> np.ndarray:
    """size flags; bits: a column `bit` of the places to set (0 to size - 1). The driver gets size / 8 bytes at most."""
    rows = bits.selectExpr("bitmap_bucket_number(bit + 1) AS b", "bitmap_bit_position(bit + 1) AS p").groupBy("b").agg(F.expr("bitmap_construct_agg(p)").alias("m")).collect()
    out = np.zeros(-(-size // 32768) * 32768, bool)
    for b, m in rows:
        out[(b - 1) * 32768 : b * 32768] = np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little")
    return out[:size]
