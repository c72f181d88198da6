"""Quality: a linear-chain conditional random field over the lines of a document.

Each line has features of its own and of the lines before and after; the field labels every line good or bad. Its
parameters are learned with every line of a labelled document bearing the document's label. A document's quality is the
mean of its lines' forward-backward marginals of good, weighted by length, and calibrated to the labels by a logistic
curve.

Learned from at most SAMPLE labelled documents, those with the least hash of doc_id; every whole text is scored. Null and
empty texts and texts of blank lines have no line and score the share of label 1, as does every text where labels of
both kinds are missing. Repeated rows have equal scores, rows without doc_id theirs too; of several labels of a document
the largest counts. A very long text is held by one task. Extra columns are kept by `good` and not read. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

SAMPLE = 8_000
ROUNDS = 300
L2 = 1e-4
THRESHOLD = 0.3
HELD = (5, 0)
OWN, SHARED = 13, 7  # features of a line; the first SHARED are taken of its neighbours too
WIDTH = OWN + 2 * SHARED + 3

_byte = np.arange(256)
_letter = ((_byte | 32) >= 97) & ((_byte | 32) <= 122)
_CLASSES = np.stack(
    [
        np.isin(_byte, list(b"#$%&*@^~+=<>\\_{}")), np.isin(_byte, list(b"|")), np.isin(_byte, list(b"!?")), (_byte >= 65) & (_byte <= 90), (_byte >= 48) & (_byte <= 57), np.isin(_byte, list(b".,;:")), _letter | (_byte >= 128),
    ]
).astype(np.uint8)


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the lines by text, their lengths in bytes, and features."""
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), "\n")
    offsets, lines = c.flat(lists)
    woffsets, codes, distinct = c.words(lines)
    count = np.diff(woffsets)
    full = count > 0
    kept = np.concatenate([[0], np.cumsum(full)])[offsets]
    lines = lines.filter(pa.array(full))
    loffsets, data = c.raw(lines)
    size = np.diff(loffsets).astype(float)
    n = len(size)
    x = np.zeros((n, WIDTH), np.float32)
    if not n:
        return kept, size, x
    for k, of in enumerate(_CLASSES):
        x[:, k] = np.add.reduceat(of[data], loffsets[:-1], dtype=np.int64) / size
    # Accented capitals: the second byte of U+00C0 to U+00DE.
    accented = np.zeros(len(data), np.uint8)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    x[:, 3] += np.add.reduceat(accented, loffsets[:-1], dtype=np.int64) / size
    x[:, :5] = np.sqrt(x[:, :5])
    line_of = np.repeat(np.arange(len(count)), count)
    again = np.zeros(len(codes))
    again[1:] = (codes[1:] == codes[:-1]) & (line_of[1:] == line_of[:-1])
    x[:, 5] = (c.sums(again, woffsets) / np.maximum(count, 1))[full]  # words like the one before
    words = count[full].astype(float)
    x[:, 6] = np.minimum(size / words, 40) / 10
    doc = np.repeat(np.arange(len(kept) - 1), np.diff(kept))
    h = c.hashes(lines)
    order = np.lexsort((np.arange(n), h, doc))
    seen = np.zeros(n)
    seen[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    x[:, 7] = seen
    x[:, 8] = np.log1p(size) / 5
    x[:, 9] = words <= 3
    x[:, 10] = np.isin(data[loffsets[1:] - 1], list(b".!?\"')"))
    x[:, 11] = np.add.reduceat(_CLASSES[5][data], loffsets[:-1], dtype=np.int64) / size
    x[:, 12] = np.add.reduceat(_CLASSES[6][data], loffsets[:-1], dtype=np.int64) / size
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    last[:-1] = doc[1:] != doc[:-1]
    x[1:, OWN : OWN + SHARED] = np.where(first[1:, None], 0, x[:-1, :SHARED])
    x[:-1, OWN + SHARED : OWN + 2 * SHARED] = np.where(last[:-1, None], 0, x[1:, :SHARED])
    x[:, -3], x[:, -2], x[:, -1] = first, last, 1
    return kept, size, x


def messages(offsets: np.ndarray, e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of good at each line, over all documents at once. e: log odds of the lines alone,
    t: log weights of (from, to)."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    alive = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
    starts = offsets[:-1][order]
    f, b = e.copy(), np.zeros_like(e)
    for p in range(1, len(alive)):
        at = starts[: alive[p]] + p
        z = f[at - 1]
        f[at] += np.logaddexp(z + t[1, 1], t[0, 1]) - np.logaddexp(z + t[1, 0], t[0, 0])
    for p in range(len(alive) - 2, -1, -1):
        at = starts[: alive[p + 1]] + p
        z = e[at + 1] + b[at + 1]
        b[at] = np.logaddexp(z + t[1, 1], t[1, 0]) - np.logaddexp(z + t[0, 1], t[0, 0])
    return f, b


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    def __init__(self, w: np.ndarray, t: np.ndarray, curve: tuple[float, float], base: float):
        self.w, self.t, self.curve, self.base = w, t, curve, base

    def line_marginals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of the lines that aren't blank by text, lengths, and probabilities of good."""
        offsets, size, x = line_features(texts)
        f, b = messages(offsets, (x @ self.w).astype(float), self.t)
        return offsets, size, _sigmoid(f + b)

    def mean(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets, size, p = self.line_marginals(texts)
        total = c.sums(size, offsets)
        return c.sums(size * p, offsets) / np.maximum(total, 1), total > 0

    def score(self, texts: pa.Array) -> np.ndarray:
        mean, full = self.mean(texts)
        a, b = self.curve
        return np.where(full, _sigmoid(a * _logit(mean) + b), self.base)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train(labelled: DataFrame) -> Model:
    """labelled: text, y of a bounded number of documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in c.slices(batches):
            offsets, size, x = line_features(part.column("text"))
            yield pa.RecordBatch.from_pydict({"y": part.column("y"), "n": np.diff(offsets), "size": [size[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], "x": [x[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]})

    got = labelled.filter(F.col("y").isNotNull()).select("text", F.col("y").cast("long").alias("y")).mapInArrow(rows, "y long, n long, size binary, x binary").toArrow()
    y = got["y"].to_numpy() if len(got) else np.zeros(0)
    base = float((y.sum() + 0.5) / (len(y) + 1))
    n = got["n"].to_numpy() if len(got) else np.zeros(0, np.int64)
    if not len(y) or y.min() == y.max() or not n.sum():
        return Model(np.zeros(WIDTH, np.float32), np.zeros((2, 2)), (0.0, float(np.log(base / (1 - base)))), base)
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, WIDTH)
    size = np.frombuffer(b"".join(got["size"].to_pylist()), np.float64)
    offsets = np.concatenate([[0], np.cumsum(n)])
    ly = np.repeat(y, n).astype(float)
    weight = np.repeat(1 / np.maximum(n, 1), n)  # a document counts once, however many lines it has
    inner = np.ones(len(x), bool)
    inner[offsets[1:][n > 0] - 1] = False
    inner = np.flatnonzero(inner)
    w, t = np.zeros(WIDTH), np.zeros((2, 2))
    m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for i in range(1, ROUNDS + 1):
        e = x @ w.astype(np.float32)
        e = e.astype(float)
        f, b = messages(offsets, e, t)
        p = _sigmoid(f + b)
        g = np.zeros(WIDTH + 4)
        g[:WIDTH] = ((p - ly) * weight).astype(np.float32) @ x / len(y) + L2 * w
        z = np.stack([f[inner] * a + t[a, d] + (e[inner + 1] + b[inner + 1]) * d for a in (0, 1) for d in (0, 1)])
        z = np.exp(z - z.max(axis=0))
        z /= z.sum(axis=0)
        real = np.stack([1 - ly[inner], 0 * ly[inner], 0 * ly[inner], ly[inner]])
        g[WIDTH:] = ((z - real) * weight[inner]).sum(axis=1) / len(y) + L2 * t.ravel()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
        w -= step[:WIDTH]
        t -= step[WIDTH:].reshape(2, 2)
    f, b = messages(offsets, (x @ w.astype(np.float32)).astype(float), t)
    total = c.sums(size, offsets)
    mean = c.sums(size * _sigmoid(f + b), offsets)[total > 0] / total[total > 0]
    a, d = 1.0, 0.0
    z, yy = _logit(mean), y[total > 0]
    for _ in range(50):  # Newton's method, slightly damped
        p = _sigmoid(a * z + d)
        h = p * (1 - p)
        hess = np.array([[(h * z * z).sum(), (h * z).sum()], [(h * z).sum(), h.sum()]]) + np.eye(2) * 1e-2
        da, dd = np.linalg.solve(hess, [((p - yy) * z).sum() + 1e-2 * (a - 1), (p - yy).sum()])
        a, d = a - da, d - dd
    return Model(w.astype(np.float32), t, (float(a), float(d)), base)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH weights

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in c.slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(held.value.score(part.column("text")))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, score double")


def good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose score is THRESHOLD or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in c.slices(batches):
            yield part.filter(pa.array(held.value.score(part.column("text")) >= THRESHOLD))

    return docs.mapInArrow(each, docs.schema)


def trained(documents: DataFrame, labels: DataFrame) -> Model:
    model = train(c.labelled(documents, labels, "quality", *HELD, SAMPLE))
    c.give_back()
    return model


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    model = trained(docs, c.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", c.held_out(*HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
