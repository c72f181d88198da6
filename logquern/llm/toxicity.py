"""Toxicity: a linear classifier that is held to give counterfactual sentences one score.

Features are the presence of words, and of word beginnings of 4, 5 and 6 characters, so that inflected insults are known
by their stem. The most telling ones (by G-squared, seen in at least MIN_DOCS labelled documents) and every identity
term have a weight. Training minimises the logistic loss, an L2 term and FAIR times the mean squared change of the score
when the identity terms of a sentence are swapped for others of their group: each sentence of the labelled texts that holds
one, and a neutral sentence for each term. So within a group no term weighs more than another, and what they share is
learned from the labels of all of them.

Features are chosen and weights fitted on at most SAMPLE labelled rows, those with the least hash of doc_id (of rows with
equal doc_id all take part). Every whole text is scored; a very long one is held by one task. Null and empty texts have no
features and score the base rate; without labels of both kinds every text scores the share of label 1. Repeated rows have
equal scores, rows without doc_id theirs too. Extra columns are kept by `clean` and not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

SAMPLE = 20_000
FEATURES = 4096
MIN_DOCS = 5
FAIR = 4.0
L2 = 2e-5
STEMS = (4, 5, 6)
THRESHOLD = 0.7

# Groups of identity terms; within a group one term may stand for another.
IDENTITY = [
    ["men", "women", "boys", "girls", "males", "females"],
    ["man", "woman", "boy", "girl", "male", "female"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "sikh"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists", "sikhs"],
    ["black", "white", "asian", "latino", "hispanic", "arab", "african", "european"],
    ["gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual"],
    ["immigrant", "immigrants", "refugee", "refugees", "citizen", "citizens"],
    ["disabled", "blind", "deaf", "autistic"],
    ["american", "mexican", "chinese", "indian", "german", "french", "spanish", "russian"],
]


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Words as in common.words, and for each distinct one its features: its letters in lower case, whole and as stems."""
    offsets, codes, distinct = c.words(texts)
    bare = pc.utf8_lower(pc.replace_substring_regex(distinct.cast(pa.string()), r"[^\p{L}]+", "")).to_pylist()
    return offsets, codes, [[w, *(f"{w[:k]}*" for k in STEMS if len(w) >= k)] if w else [] for w in bare]


def _present(texts: pa.Array, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Documents and features, each pair once."""
    offsets, codes, features = word_features(texts)
    known = [[index[f] for f in fs if f in index] for fs in features]
    sizes = np.array([len(k) for k in known], np.int64)
    ids = np.array([f for k in known for f in k], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    docs = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    has = sizes[codes] > 0
    docs, codes = docs[has], codes[has]
    pairs = np.unique(np.repeat(docs, sizes[codes]) * max(1, len(index)) + ids[c.ranges(at[codes], sizes[codes])])
    return pairs // max(1, len(index)), pairs % max(1, len(index))


def _doc_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of documents of each label that hold a feature, by slice."""
    for part in c.slices(batches):
        offsets, codes, features = word_features(part.column("text"))
        y = np.asarray(part.column("y")).astype(np.int64)
        docs = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        names: dict[str, int] = {}
        lists = [[names.setdefault(f, len(names)) for f in fs] for fs in features]
        sizes = np.array([len(x) for x in lists], np.int64)
        ids = np.array([f for x in lists for f in x], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        if not len(ids) or not len(codes):
            continue
        pairs = np.unique(np.repeat(docs, sizes[codes]) * len(names) + ids[c.ranges(at[codes], sizes[codes])])
        n1 = np.bincount(pairs % len(names), weights=y[pairs // len(names)], minlength=len(names)).astype(np.int64)
        n = np.bincount(pairs % len(names), minlength=len(names))
        kept = n > 0
        yield pa.RecordBatch.from_pydict({"feature": pa.array(list(names), pa.string()).filter(pa.array(kept)), "n1": n1[kept], "n0": (n - n1)[kept]})


OTHERS = {word: [x for x in group if x != word] for group in IDENTITY for word in group}
NEUTRAL = "the {} people of this town"


def swapped(sentence: str) -> str | None:
    """The sentence with every identity term swapped for one that the sentence and the term decide; None without one."""
    words = sentence.lower().split()
    bare = ["".join(filter(str.isalpha, w)) for w in words]
    if not any(b in OTHERS for b in bare):
        return None
    pick = lambda b: OTHERS[b][zlib.crc32(f"{b} {sentence}".encode("utf-8", "surrogatepass")) % len(OTHERS[b])]
    return " ".join(pick(b) if b in OTHERS else w for w, b in zip(words, bare))


def counterfactuals(texts: list[str]) -> tuple[list[str], list[str]]:
    """Sentences that hold an identity term, and the same ones swapped."""
    sentences = [s for t in texts for s in re.split(r"[.!?\n]+", t)]
    pairs = [(s, t) for s in sentences if (t := swapped(s)) is not None]
    return [s for s, _ in pairs], [t for _, t in pairs]


def feature_lists(texts: list[str], index: dict[str, int]) -> pa.ListArray:
    docs, feats = _present(pa.array(texts, pa.string()), index)
    return pa.ListArray.from_arrays(np.searchsorted(docs, np.arange(len(texts) + 1)).astype(np.int32), feats.astype(np.int32))


class Model:
    def __init__(self, index: dict[str, int], weights: np.ndarray, bias: float):
        self.index, self.weights, self.bias = index, weights, bias

    def score(self, texts: pa.Array) -> np.ndarray:
        docs, feats = _present(texts, self.index)
        z = np.bincount(docs, weights=self.weights[feats], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(labelled: DataFrame) -> Model:
    """labelled: text, y (0 or 1), doc_id."""
    labelled = labelled.filter(F.col("y").isNotNull() & F.col("text").isNotNull())
    total = labelled.agg(F.coalesce(F.sum(F.lit(1)), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first()
    n, n1 = int(total[0]), int(total[1])
    if not n or n1 in (0, n):
        rate = min(max(n1 / n if n else 0.0, 1e-3), 1 - 1e-3)
        return Model({}, np.zeros(1), float(np.log(rate / (1 - rate))))
    counts = labelled.select("text", "y").mapInArrow(_doc_features, "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("a"), F.sum("n0").alias("b"))
    ea, eb = (F.col("a") + F.col("b")) * F.lit(n1 / n), (F.col("a") + F.col("b")) * F.lit(1 - n1 / n)
    gain = F.when(F.col("a") > 0, F.col("a") * F.log(F.col("a") / ea)).otherwise(0.0) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / eb)).otherwise(0.0)
    best = counts.filter(F.col("a") + F.col("b") >= MIN_DOCS).withColumn("gain", gain).filter("gain > 4").orderBy(F.desc("gain"), "feature").limit(FEATURES).select("feature").collect()
    index = {f: i for i, f in enumerate(dict.fromkeys([r[0] for r in best] + [w for g in IDENTITY for w in g]))}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, with its label, and for each pair of sentences, with the features of both."""
        for part in c.slices(batches):
            texts = part.column("text").to_pylist()
            one, other = counterfactuals(texts)
            y = [*part.column("y").to_pylist(), *[None] * len(one)]
            f = pa.concat_arrays([feature_lists(texts, index), feature_lists(one, index)])
            g = pa.concat_arrays([feature_lists([""] * len(texts), index), feature_lists(other, index)])
            yield pa.RecordBatch.from_pydict({"y": pa.array(y, pa.int64()), "f": f, "g": g})

    got = labelled.select("text", "y").mapInArrow(rows, "y long, f array<int>, g array<int>").toArrow().combine_chunks()
    own = got["y"].is_valid()
    y, texts = got["y"].drop_null().to_numpy().astype(float), [got.filter(own)["f"].combine_chunks()]
    neutral = [NEUTRAL.format(w) for group in IDENTITY for w in group]
    pairs = got.filter(pc.invert(own))
    del got
    one = [pairs["f"].combine_chunks(), feature_lists(neutral, index)]
    other = [pairs["g"].combine_chunks(), feature_lists([swapped(s) for s in neutral], index)]
    return Model(index, *fit(y, texts, one, other, len(index)))


def fit(y: np.ndarray, texts: list[pa.ListArray], one: list[pa.ListArray], other: list[pa.ListArray], width: int, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias. texts: features by text; one and other: those of sentences whose scores are to be equal."""

    def flat(lists: list[pa.ListArray]) -> tuple[np.ndarray, np.ndarray]:
        parts = [c.flat(x) for x in lists]
        sizes = np.concatenate([np.diff(offsets) for offsets, _ in parts])
        return np.repeat(np.arange(len(sizes)), sizes), np.concatenate([ids.to_numpy() for _, ids in parts]).astype(np.int64)

    (row, ids), (arow, aids), (brow, bids) = flat(texts), flat(one), flat(other)
    pairs = sum(len(x) for x in one)
    w, b = np.zeros(width), 0.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=w[ids], minlength=len(y)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        change = np.bincount(arow, weights=w[aids], minlength=pairs) - np.bincount(brow, weights=w[bids], minlength=pairs)
        pull = 2 * FAIR * change / max(1, pairs)
        g = np.bincount(ids, weights=d[row], minlength=width) + L2 * w
        g += np.bincount(aids, weights=pull[arow], minlength=width) - np.bincount(bids, weights=pull[brow], minlength=width)
        gb = d.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, float(b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in c.slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(held.value.score(part.column("text")))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, score double")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose score stays under THRESHOLD."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in c.slices(batches):
            yield part.filter(pa.array(held.value.score(part.column("text")) < THRESHOLD))

    return docs.mapInArrow(each, docs.schema)


def trained(documents: DataFrame, labels: DataFrame) -> Model:
    model = train(c.labelled(documents, labels, "toxic", 3, 1, SAMPLE))
    c.give_back()
    return model


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    model = trained(docs, c.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", c.held_out(3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
