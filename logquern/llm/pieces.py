"""SentencePiece encoding and decoding by a streaming Viterbi search.

Encoding finds the segmentation of a text into pieces of a public vocabulary with the largest sum of scores (of equal
sums, that whose last piece is shorter at each step back). A piece's space mark stands for a space; a byte that no piece
covers is a byte piece, as is each byte of a literal space mark, so decode(encode(text)) is the text, byte for byte:
nothing is normalised and no space is put before a text.

The search keeps a window of as many bytes as the longest piece has. As soon as the back pointers of all boundaries in
the window meet in one boundary, the ids up to it are final and leave the window. Since no piece of such a vocabulary
goes on past a space after another character, paths always meet there: the batch form below encodes each distinct
stretch between such places once, with numpy over all of them; stretches over LONG bytes go through the stream.

Null texts give null ids; empty texts none. Repeated rows have equal ids, rows without doc_id theirs too. A very long text
is held by one task; a stretch of it without a space goes through the stream, whose window is bounded. Extra columns are
not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

MODEL = "piece_bpe_32k.model"
LONG = 96
MARK = "▁"


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.of: dict[bytes, int] = {}
        self.score: list[float] = [0.0] * n
        fallback = [0] * 256
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.bytes[i], fallback[b] = bytes([b]), i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes[i] = sp.id_to_piece(i).replace(MARK, " ").encode()
                self.of[self.bytes[i]] = i
                self.score[i] = sp.get_score(i)
        low = min(self.score) - 1  # a byte piece costs more than any other
        for b, i in enumerate(fallback):
            self.score[i] = low
            self.of.setdefault(bytes([b]), i)
        if any(b" " in p.lstrip(b" ") for p in self.of):
            raise ValueError("a piece goes on past a space")
        self.longest = max(map(len, self.of))
        self.tables = {}
        for k in range(1, self.longest + 1):
            if own := [p for p in self.of if len(p) == k]:
                keys = rolling(pa.array(own, pa.binary()))
                self.tables[k] = table(keys, np.array([self.of[p] for p in own]))
        self.scores = np.array([*self.score, -np.inf])
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in self.bytes])])
        self.data = np.frombuffer(b"".join(self.bytes), np.uint8)


def rolling(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string that the one of a string with a byte more can be made from."""
    offsets, data = c.raw(values)
    sizes = np.diff(offsets)
    with np.errstate(over="ignore"):
        terms = (data.astype(np.uint64) + np.uint64(1)) * c.powers(int(sizes.max(initial=0)) + 1)[c.within(offsets)]
        return c.mix(c.sums(terms, offsets) + sizes.astype(np.uint64))


def table(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = max(8, int(np.ceil(np.log2(len(keys) * 8))))
    at, held = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
    for key, slot, i in zip(keys, (keys >> np.uint64(64 - bits)).astype(np.int64), ids):
        while held[slot] >= 0:
            slot = (slot + 1) % len(held)
        at[slot], held[slot] = key, i
    return at, held


def find(held_: tuple[np.ndarray, np.ndarray], keys: np.ndarray, none: int) -> np.ndarray:
    at, held = held_
    slot = (keys >> np.uint64(64 - (len(held).bit_length() - 1))).astype(np.int64)
    out = np.full(len(keys), none, np.int32)
    left = np.arange(len(keys))
    while len(left):
        s = slot[left]
        full = held[s] >= 0
        hit = full & (at[s] == keys[left])
        out[left[hit]] = held[s[hit]]
        left = left[full & ~hit]
        slot[left] = (slot[left] + 1) % len(held)
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def stream(text: Iterator[int] | bytes, v: Vocabulary) -> Iterator[int]:
    """Ids of a stream of bytes. Holds the best sums and paths of the last v.longest boundaries only."""
    best: dict[int, float] = {0: 0.0}  # by boundary
    back: dict[int, tuple[int, int]] = {}  # boundary: (the one before, piece)
    recent = bytearray()
    done = at = 0
    due = 1  # paths that have not met are followed again when they are twice as long
    for byte in text:
        recent.append(byte)
        at += 1
        if len(recent) > v.longest:
            del recent[0]
        top, via = -np.inf, None
        for k in range(1, min(len(recent), at) + 1):
            if (i := v.of.get(bytes(recent[len(recent) - k :]))) is not None and at - k in best and (s := best[at - k] + v.score[i]) > top:
                top, via = s, (at - k, i)
        best[at], back[at] = top, via
        for old in [b for b in best if b <= at - v.longest]:
            del best[old]
        if at - done < due:
            continue
        heads = set(best)
        while len(heads) > 1:  # follow the latest back until all meet
            latest = max(heads)
            if latest <= done:
                break
            heads.discard(latest)
            heads.add(back[latest][0])
        meet = heads.pop() if len(heads) == 1 else done
        if meet > done:
            yield from _path(back, done, meet)
            for b in [b for b in back if b <= meet]:
                del back[b]
            base = best.get(meet, 0.0)
            best = {b: s - base for b, s in best.items() if b >= meet} if meet in best else best
            done, due = meet, 1
        else:
            due = 2 * (at - done)
    if at > done:
        yield from _path(back, done, at)


def _path(back: dict[int, tuple[int, int]], start: int, end: int) -> list[int]:
    ids = []
    while end > start:
        end, i = back[end]
        ids.append(i)
    return ids[::-1]


def batch(distinct: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of the stretches."""
    offsets, data = c.raw(distinct)
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes > LONG)
    if len(long):
        short = np.flatnonzero(sizes <= LONG)
        off, ids = batch(distinct.take(pa.array(short)), v)
        more = [np.fromiter(stream(data[offsets[i] : offsets[i + 1]].tobytes(), v), np.int32) for i in long]
        moff = np.concatenate([[0], np.cumsum([len(m) for m in more])])
        place = np.empty(len(sizes), np.int64)
        place[short], place[long] = np.arange(len(short)), len(short) + np.arange(len(long))
        return c.gather(np.concatenate([off, off[-1] + moff[1:]]), np.concatenate([ids, *more]), place)
    total, none = len(data), len(v.bytes)
    place = c.within(offsets)
    order = np.argsort(-sizes, kind="stable")
    alive = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
    starts = offsets[:-1][order]
    # The hash of the k bytes that end at a place, as rolling() has it: terms of the bytes in order.
    with np.errstate(over="ignore"):
        base = c.powers(v.longest + 2)
        terms = data.astype(np.uint64) + np.uint64(1)
        found, rolled = {}, np.zeros(total, np.uint64)
        for k in range(1, min(v.longest, len(alive)) + 1):
            grown = np.zeros(total, np.uint64)  # at a place: of the k bytes that end there, the first with power 0
            grown[k - 1 :] = terms[: total - k + 1] + rolled[k - 1 :] * base[1]
            rolled = grown
            if k in v.tables:
                inside = np.flatnonzero(place >= k - 1)
                ids = np.full(total, none, np.int32)
                ids[inside] = find(v.tables[k], c.mix(rolled[inside] + np.uint64(k)), none)
                found[k] = ids
    n = len(order)
    best = np.full((len(alive) + 1, n), -np.inf)
    best[0] = 0
    step, piece = np.zeros((len(alive) + 1, n), np.int16), np.zeros((len(alive) + 1, n), np.int32)
    for p, m in enumerate(alive):
        for k, ids in found.items():
            if k > p + 1:
                break
            i = ids[starts[:m] + p]
            s = best[p + 1 - k, :m] + v.scores[i]
            better = np.flatnonzero(s > best[p + 1, :m])
            best[p + 1, better], step[p + 1, better], piece[p + 1, better] = s[better], k, i[better]
    at, rows, out_rows, out_ids = sizes[order].copy(), np.arange(n), [], []
    rows = rows[at > 0]
    while len(rows):  # back from the ends, all stretches at once
        out_rows.append(rows)
        out_ids.append(piece[at[rows], rows])
        at[rows] -= step[at[rows], rows]
        rows = rows[at[rows] > 0]
    if not out_rows:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int32)
    turn = np.repeat(np.arange(len(out_rows)), [len(r) for r in out_rows])
    r, ids = order[np.concatenate(out_rows)], np.concatenate(out_ids)
    by = np.argsort(r * (len(out_rows) + 1) - turn, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n))]), ids[by]


def encode(texts: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of the texts; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    # A stretch is some spaces and what follows up to the next space. Single spaces between words are the common case.
    lists = pc.split_pattern(texts, " ")
    offsets, values = c.flat(lists)
    coded = values.dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    first = np.zeros(len(codes), bool)
    first[offsets[:-1]] = True
    size = pc.binary_length(distinct).to_numpy(zero_copy_only=False)
    empty = size[codes] == 0
    odd = np.zeros(len(codes), bool)
    odd[1:] = empty[:-1] & ~first[1:]  # after a double space, or a space at a text's start
    odd |= empty & ~first
    odd_doc = np.zeros(len(texts), bool)
    odd_doc[np.repeat(np.arange(len(texts)), np.diff(offsets))[odd]] = True
    lead = np.unique(codes[first & ~empty])
    spaced = pc.binary_join_element_wise(" ", distinct, "")
    eoff, eids = batch(pa.concat_arrays([spaced, distinct.take(pa.array(lead))]), v)
    lead_of = np.zeros(len(distinct), np.int64)
    lead_of[lead] = len(distinct) + np.arange(len(lead))
    use = np.where(first, lead_of[codes], codes)
    none = len(eoff) - 1
    use = np.where(first & empty, none, use)
    eoff = np.append(eoff, eoff[-1])
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    plain = ~odd_doc[doc]
    goff, ids = c.gather(eoff, eids, use[plain])
    counts = np.bincount(doc[plain], weights=np.diff(goff), minlength=len(texts)).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(counts)])
    if odd_doc.any():
        parts = [ids[off[i] : off[i + 1]] for i in range(len(texts))]
        for i in np.flatnonzero(odd_doc):
            runs = _stretches(texts[int(i)].as_py().encode())
            o, x = batch(pa.array(runs, pa.binary()), v)
            parts[i] = x
        off, ids = np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate(parts)
    return off, ids.astype(np.int32)


def _stretches(text: bytes) -> list[bytes]:
    import re

    return re.findall(rb" *[^ ]+| +", text)


def decode(offsets: np.ndarray, ids: np.ndarray, v: Vocabulary) -> pa.Array:
    """The texts of the ids, as bytes."""
    boff, data = c.gather(v.offsets, v.data, ids)
    return c.strings(boff[offsets], data)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_ids and whether decoding the ids gives the text again."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for part in c.slices(batches):
            texts = part.column("text")
            offsets, ids = encode(texts, v)
            again = pc.equal(decode(offsets, ids, v), pc.fill_null(texts, "").cast(pa.large_binary()))
            null = texts.is_null()
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids), mask=null)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int64()), again], ["doc_id", "ids", "n_ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids give a null text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                null = part.column("ids").is_null()
                lists = part.column("ids")
                offsets, ids = c.flat(pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32())) if lists.null_count else lists)
                texts = decode(offsets, ids.to_numpy(zero_copy_only=False), v).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.if_else(null, pa.scalar(None, pa.string()), texts)], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(each, "doc_id long, text string")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(c.table(spark, sf_dir, "documents"), default_model())
