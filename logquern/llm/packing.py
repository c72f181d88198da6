"""Best-fit packing of documents into sequences under three capacities: tokens, documents and attention cost (the sum of
squared lengths).

A document's ids end with END. A document longer than a sequence is cut into whole sequences and one first, shorter
piece; others stay whole. Pieces go, largest first, each into the open sequence with room in every capacity that is best
by the weighted residual norm left after it (or, by="dot", by the weighted dot-product of demand and residual); where
none has room a new one opens. Ids are made once, where the text is read; only lengths and checksums are exchanged.
Groups of about GROUP pieces, chosen by hash, are packed apart, so a group's one ill-filled last sequence is the cost of
distribution.

Null texts are empty and give the single id END, as empty ones do. Repeated rows are packed as rows of their own (equal
keys, different places), rows without doc_id too. Equal rows share a group, so where a third of all rows are one row that
group is as large as they are; a row there is some 50 bytes. A very long text is held by one task while its ids are made.
Extra columns are not read. Ties in length go by doc_id and piece. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

TOKENS = 2048
DOCUMENTS = 2048
COST = 2048 * 2048
END = 0
GROUP = 16_384
WEIGHTS = (1.0, 1e-6, 1e-6)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The byte-level BPE of the vocabulary at path (ranks), which gives the ids that `tokenizers` gives with the same
    vocabulary as JSON (held by a test), in about a fifth of the time. <|endoftext|> in a text is the special token."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def encode(text: str, path: str) -> np.ndarray:
    ids = tokenizer(path).encode_to_numpy(text, allowed_special="all", disallowed_special=())
    return np.append(ids.astype("<u4"), np.uint32(END)).astype("<u4")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(docs: DataFrame, path: str, tokens: int = TOKENS) -> DataFrame:
    """A row for each piece of each document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in c.slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = encode(text or "", path)
                first = len(ids) % tokens or tokens
                edges = [0, *range(first, len(ids) + 1, tokens)]
                rows += [(doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, PIECES)


def best_fit(lengths: np.ndarray, tokens: int = TOKENS, documents: int = DOCUMENTS, cost: int = COST, weights: tuple[float, float, float] = WEIGHTS, by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece and its place there; pieces come in the order of lengths, longest first."""
    capacity = np.array([tokens, documents, cost], np.float64)
    weight = np.asarray(weights) / capacity**2
    order = np.argsort(-lengths, kind="stable")
    room = np.zeros((3, 1024))  # of the open sequences
    ids = np.zeros(1024, np.int64)
    used = 0
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened = 0
    for i in order:
        size = float(lengths[i])
        need = (size, 1.0, size * size)
        r = room[:, :used]
        fits = np.flatnonzero((r[0] >= need[0]) & (r[1] >= need[1]) & (r[2] >= need[2]))
        if len(fits):
            left = r[:, fits]
            if by == "norm":
                at = fits[np.argmin(sum(w * (left[k] - need[k]) ** 2 for k, w in enumerate(weight)))]
            else:
                at = fits[np.argmax(sum(w * left[k] * need[k] for k, w in enumerate(weight)))]
        else:
            if used == room.shape[1]:
                room, ids = np.concatenate([room, np.zeros_like(room)], axis=1), np.concatenate([ids, np.zeros_like(ids)])
            at = used
            room[:, at], ids[at] = capacity, opened
            used, opened = used + 1, opened + 1
        bins[i], places[i] = ids[at], tokens - room[0, at]
        room[:, at] -= need
        if room[0, at] < 1 or room[1, at] < 1 or room[2, at] < 1:  # full: the last open one takes its place
            used -= 1
            room[:, at], ids[at] = room[:, used], ids[used]
    return bins, places


def pack(pieces: DataFrame, tokens: int = TOKENS, documents: int = DOCUMENTS, cost: int = COST, weights: tuple[float, float, float] = WEIGHTS, by: str = "norm", group: int = GROUP) -> DataFrame:
    """pieces with sequence_id and offset. pieces is read twice: give a stored table."""
    if cost < tokens * tokens:
        raise ValueError("a piece of `tokens` tokens must fit the attention cost")
    n = max(1, -(-pieces.count() // group))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)  # about `group` pieces of some 50 bytes
        if not rows:
            return
        rows = pa.Table.from_batches(rows).combine_chunks()
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, places = best_fit(rows["length"].to_numpy(), tokens, documents, cost, weights, by)
        base = np.int64(rows["pid"][0].as_py()) << 32
        for batch in pa.table([*[rows[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(bins + base), pa.array(places)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]).to_batches(10_000):
            yield batch

    sent = pieces.withColumn("pid", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)).cast("int"))
    return c.exchange(sent, n).mapInArrow(each, PACKED)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(c.stored(cut(c.table(spark, sf_dir, "documents"), default_vocabulary())))
