"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public byte-level vocabulary. A word (with the space before
it) has the sum of the probabilities of all its segmentations into pieces, which the forward algorithm finds; a text has
the product over its words. Piece probabilities are learned by expectation-maximisation over the same segmentations.

All pieces are used, among them every single byte, so any text has a segmentation. Learned from at most SAMPLE documents
with a language, those with the least hash of doc_id; words of over STRETCH characters (as in scripts without spaces) are
learned from in stretches. Every whole text is scored, long words whole. Null texts and texts without a letter are `und`
with score 0; without anything to learn from, all are. Repeated rows have equal results, rows without doc_id theirs too. A
very long text is held by one task; its distinct words are scored a part at a time. Extra columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .pieces import find, rolling, table

SAMPLE = 6_000
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
ROUNDS = 3
PRIOR = 0.01
STRETCH = 32  # characters
PART = 1 << 14  # words that are scored at a time
HELD = (3, 1)


class Pieces:
    """Lookup of the pieces of each length by a hash of their bytes that grows byte by byte. Hashes of different pieces, and
    of whatever else stands in a text, differ but for a chance of 2 ** -64."""

    def __init__(self, path: str):
        by_length: dict[int, list[bytes]] = {}
        for line in open(path, "rb"):
            piece = base64.b64decode(line.split()[0])
            by_length.setdefault(len(piece), []).append(piece)
        self.lengths, self.tables, self.size = sorted(by_length), {}, 0
        for k in self.lengths:
            own = rolling(pa.array(by_length[k], pa.binary()))
            self.tables[k] = table(own, np.arange(self.size, self.size + len(own)))
            self.size += len(own)
        self.longest = self.lengths[-1]

    def find(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Ids of the pieces of k bytes; size where there is none."""
        return find(self.tables[k], keys, self.size)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def lattice(found: Pieces, distinct: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Offsets of the words with a space before each, and by length, for each byte, the piece of that length that ends there
    within the word (found.size: none); lengths that no word has aren't there."""
    offsets, data = c.raw(distinct)
    n = len(offsets) - 1
    spaced = np.insert(data, offsets[:-1], 32)
    offsets = offsets + np.arange(n + 1)
    place = c.within(offsets)
    ids = {}
    terms = spaced.astype(np.uint64) + np.uint64(1)
    rolled, inside, done = np.zeros(0, np.uint64), np.arange(len(spaced)), 0
    with np.errstate(over="ignore"):
        base = c.powers(2)[1]
        for k in range(1, found.longest + 1):
            kept = place[inside] >= k - 1
            if not kept.any():
                break
            inside = inside[kept]
            # The hash of the k bytes that end at a place: the first byte's term, and base times that of the others.
            rolled = terms[inside - k + 1] + (rolled[kept] * base if done else np.uint64(0))
            done = k
            if k in found.tables:
                ids[k] = np.full(len(spaced), found.size, np.int32)
                ids[k][inside] = found.find(k, c.mix(rolled + np.uint64(k)))
    return offsets, {k: x for k, x in ids.items() if (x < found.size).any()}


def _by_place(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words from long to short, and how many have more than p bytes, for each p."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    return order, np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")


def forward(offsets: np.ndarray, ids: dict[int, np.ndarray], prob: np.ndarray) -> np.ndarray:
    """log of the summed probability of all segmentations, by word and language. prob has a last row of zeros. After every
    few places a word's window of sums is scaled, so words of any length stay in range."""
    order, alive = _by_place(offsets)
    starts = offsets[:-1][order]
    n, langs = len(order), prob.shape[1]
    wide = max(ids, default=1)
    window = np.zeros((wide, n, langs))  # window[p % wide]: sums of the segmentations of the first p bytes
    window[0] = 1
    scale = np.zeros((n, langs))
    out = np.zeros((n, langs))
    for p, m in enumerate(alive):
        new = np.zeros((m, langs))
        for k, found in ids.items():
            if k > p + 1:
                break
            i = found[starts[:m] + p]
            some = np.flatnonzero(i < len(prob) - 1)
            new[some] += window[(p + 1 - k) % wide, some] * prob[i[some]]
        if p % 8 == 7:  # rescale the window
            top = np.maximum(new, 1e-300)
            scale[:m] += np.log(top)
            for w in range(wide):
                window[w, :m] /= top
            new = new / top
        window[(p + 1) % wide, :m] = new
        ended = alive[p + 1] if p + 1 < len(alive) else 0
        out[ended:m] = np.log(np.maximum(new[ended:], 1e-300)) + scale[ended:m]
    result = np.empty_like(out)
    result[order] = out
    return result


def expected(offsets: np.ndarray, ids: dict[int, np.ndarray], prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces over all segmentations of words (of some hundred bytes at most), by language."""
    order, alive = _by_place(offsets)
    starts = offsets[:-1][order]
    n, langs = len(order), prob.shape[1]
    alpha = np.zeros((len(alive) + 1, n, langs))
    alpha[0] = 1
    for p, m in enumerate(alive):
        for k, found in ids.items():
            if k > p + 1:
                break
            alpha[p + 1, :m] += alpha[p + 1 - k, :m] * prob[found[starts[:m] + p]]
    sizes = np.diff(offsets)[order]
    beta = np.zeros((len(alive) + 1, n, langs))
    total = alpha[sizes, np.arange(n)]
    beta[sizes, np.arange(n)] = weight[order] / np.maximum(total, 1e-300)
    counts = np.zeros((langs, len(prob)))
    for p in range(len(alive) - 1, -1, -1):
        m = alive[p]
        for k, found in ids.items():
            if k > p + 1:
                break
            i = found[starts[:m] + p]
            share = prob[i] * beta[p + 1, :m]
            for lang in range(langs):
                counts[lang] += np.bincount(i, weights=alpha[p + 1 - k, :m, lang] * share[:, lang], minlength=len(prob))
            beta[p + 1 - k, :m] += share
    return counts.T


class Model:
    def __init__(self, langs: list[str], prior: np.ndarray, prob: np.ndarray, path: str):
        self.langs, self.prior, self.prob, self.path = langs, prior, prob, path

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        offsets, codes, distinct = c.words(texts)
        each = np.concatenate([np.zeros((0, len(self.langs))), *(forward(*lattice(pieces(self.path), distinct.slice(a, PART)), self.prob) for a in range(0, len(distinct), PART))])
        total = self.prior + c.sums(each[codes], offsets)
        spread = total / np.sqrt(np.maximum(np.diff(offsets), 1))[:, None]  # words aren't independent: a milder posterior
        best = np.argmax(total, axis=1)
        share = 1 / np.exp(np.minimum(spread - spread.max(axis=1, keepdims=True), 0)).sum(axis=1)
        return [self.langs[b] if a else "und" for a, b in zip(letters, best)], np.where(letters, share, 0.0)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def stretched(texts: pa.Array) -> pa.Array:
    """Texts whose words of over STRETCH characters are cut."""
    return pc.replace_substring_regex(texts, rf"([^\x20\x09-\x0D]{{{STRETCH}}})", r"\1 ")


def train(docs: DataFrame, path: str) -> Model:
    """docs: doc_id, text, lang of documents that may be learned from."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    chosen = c.bounded_sample(known, "doc_id", SAMPLE).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in c.slices(batches):
            lang = part.column("lang").dictionary_encode()
            offsets, codes, distinct = c.words(stretched(part.column("text")))
            by = np.repeat(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(offsets))
            keys, n = np.unique(by * max(1, len(distinct)) + codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(keys // max(1, len(distinct)))), distinct.take(pa.array(keys % max(1, len(distinct)))), pa.array(n)], ["lang", "word", "n"])

    got = chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(got["lang"].unique().to_pylist())
    if not langs or not len(got):
        return Model([], np.zeros(0), np.zeros((1, 0)), path)
    distinct = got["word"].combine_chunks().dictionary_encode()
    distinct = distinct.combine_chunks() if isinstance(distinct, pa.ChunkedArray) else distinct
    weight = np.zeros((len(distinct.dictionary), len(langs)))
    np.add.at(weight, (distinct.indices.to_numpy(zero_copy_only=False), [langs.index(x) for x in got["lang"].to_pylist()]), got["n"].to_numpy())
    found = pieces(path)
    offsets, ids = lattice(found, distinct.dictionary)
    prob = np.ones((found.size + 1, len(langs)))
    prob[-1] = 0
    # The start: how often a piece occurs anywhere, longer ones weighing more.
    every = np.repeat(weight, np.diff(offsets), axis=0)
    for k, ends in ids.items():
        for lang in range(len(langs)):
            prob[:, lang] += k * np.bincount(ends, weights=every[:, lang], minlength=len(prob))
    prob[-1] = 0
    prob /= prob.sum(axis=0)
    step = 1 << 14
    for _ in range(ROUNDS):
        counts = np.zeros_like(prob)
        for a in range(0, len(offsets) - 1, step):
            b = min(a + step, len(offsets) - 1)
            counts += expected(offsets[a : b + 1] - offsets[a], {k: x[offsets[a] : offsets[b]] for k, x in ids.items()}, prob, weight[a:b])
        counts[-1] = 0
        counts[:-1] += PRIOR
        prob = counts / counts.sum(axis=0)
    return Model(langs, np.log(weight.sum(axis=0) / weight.sum()), prob, path)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary times the languages

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in c.slices(batches):
            lang, score = held.value.predict(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, lang_pred string, score double")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    model = train(docs.filter(c.crc_mod("doc_id", HELD[0]) != HELD[1]).select("doc_id", "text", "lang"), default_vocabulary())
    return identify(docs, model).select("doc_id", c.held_out(*HELD).alias("held_out"), "lang_pred", "score")
