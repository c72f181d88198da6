"""Document fingerprints of closed syncmers.

A k-mer of code points is an anchor if the least hash among its s-mers stands at its first or last place. Whether a
k-mer is an anchor depends on the k-mer alone, so equal passages have equal anchors wherever they stand, and of any
k - s + 1 successive k-mers at least one is an anchor. So that short texts have a likeness too, the first 1, 2, 4 and 8
code points of every text and its last 4 and 8 (of a longer text) are anchors of their own, and so is the whole of a text
in which no k-mer is one. A fingerprint is base64 of (gap to the anchor before, 24 bits of the hash) for each anchor in
order of place.

Likeness is the Dice share of anchors that match: same hash (the i-th of equal hashes with the i-th) at places that
differ by at most SHIFT of the longer text (64 at least). Null texts are empty; an empty text has an empty fingerprint,
two empty fingerprints have likeness 1, an empty and another 0.

The next document of a row is the next one in order of (doc_id, text); after the last one comes the first. Rows without
doc_id are documents too: they stand beyond ids of 2 ** 62, in order of a hash of their text. Repeated rows are documents
of their own. A very long text is held by one task, whole. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

K, S = 16, 4  # powers of 2
HEADS, TAILS = (1, 2, 4, 8), (4, 8)
SHIFT = 0.25
W = K - S + 1
RANGES = 4096  # of doc_id at most: their bounds stand in the plan


def anchors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets by text, places and 24-bit hashes of the anchors, and the texts' numbers of code points."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    offsets = np.concatenate([[0], ends])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    doc = np.repeat(np.arange(len(texts)), sizes)
    with np.errstate(over="ignore"):
        base = c.powers(64)
        rolled, width = {1: codes + np.uint64(1)}, 1
        while width < K:
            h = rolled[width]
            rolled[2 * width] = h[:-width] * base[width] + h[width:]
            width *= 2
    found = np.zeros(0, np.int64)
    if n >= K:
        low = c.mix(rolled[S])
        reach, step = low, 1
        while 2 * step <= W:
            reach = np.minimum(reach[:-step], reach[step:])
            step *= 2
        if step < W:
            reach = np.minimum(reach[: n - K + 1], reach[W - step : W - step + n - K + 1])
        first, last = low[: n - K + 1], low[W - 1 : W - 1 + n - K + 1]
        found = np.flatnonzero((first == reach[: n - K + 1]) | (last == reach[: n - K + 1]))
        found = found[found + K <= ends[doc[found]]]
    held = np.bincount(doc[found], minlength=len(texts))
    at, whole = [found], [c.mix(rolled[K][found])]
    for kind, widths in enumerate((HEADS, TAILS)):
        for width in widths:
            some = np.flatnonzero(sizes >= width + kind)
            at.append(ends[some] - width if kind else offsets[some])
            with np.errstate(over="ignore"):
                whole.append(c.mix(rolled[width][at[-1]] + c.mix(np.array([width << 1 | kind], np.uint64))))
    alone = np.flatnonzero((held == 0) & (sizes > 0))
    at.append(offsets[alone])
    whole.append(np.array([int.from_bytes(hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for i in alone], np.uint64))
    found, whole = np.concatenate(at), np.concatenate(whole)
    order = np.argsort(found, kind="stable")
    found, whole = found[order], whole[order]
    counts = np.bincount(doc[found], minlength=len(texts))
    starts = np.concatenate([[0], np.cumsum(counts)])
    return starts, found - np.repeat(offsets[:-1], counts), (whole >> np.uint64(40)).astype(np.int64), sizes


def fingerprints(starts: np.ndarray, places: np.ndarray, marks: np.ndarray) -> list[str]:
    gaps = np.diff(places, prepend=0)
    gaps[starts[:-1][np.diff(starts) > 0]] = places[starts[:-1][np.diff(starts) > 0]]
    rows = np.empty((len(places), 4), np.uint8)
    rows[:, 0] = np.minimum(gaps, 255)
    rows[:, 1:] = marks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    data = rows.tobytes()
    return [base64.b64encode(data[4 * a : 4 * b]).decode() for a, b in zip(starts[:-1], starts[1:])]


def likeness(a: tuple, b: tuple) -> np.ndarray:
    """Of the i-th text of a to the i-th of b."""

    def keys(x: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (document, mark), offsets of the places of each, and the places."""
        starts, places, marks, _ = x
        key = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) << 24 | marks
        order = np.argsort(key, kind="stable")
        offsets = c.runs(key[order])
        return key[order][offsets[:-1]], offsets, places[order]

    (ka, oa, pa_), (kb, ob, pb) = keys(a), keys(b)
    key, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    n = np.minimum(np.diff(oa)[ia], np.diff(ob)[ib])
    doc = np.repeat(key >> 24, n)
    near = np.abs(pa_[c.ranges(oa[ia], n)] - pb[c.ranges(ob[ib], n)]) <= np.maximum(64, SHIFT * np.maximum(a[3], b[3])[doc])
    both = np.bincount(doc[near], minlength=len(a[3]))
    total = np.diff(a[0]) + np.diff(b[0])
    return np.where(total == 0, 1.0, 2 * both / np.maximum(total, 1))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _score(ids: list, texts: list[str], after: list[str]) -> pa.RecordBatch:
    changed = [edited(t, u) for t, u in zip(texts, after)]
    own, new, following = anchors(texts), anchors(changed), anchors(after)
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array(own[3], pa.int64()), "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            "fingerprint": fingerprints(*own[:3]), "edited_fingerprint": fingerprints(*new[:3]), "near_edited": likeness(own, new), "near_next": likeness(own, following),
        }
    )


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by doc_id; the last one of a partition (extra) is only the next of the one before."""
    left: list[tuple[int, str, bool]] = []
    for part in c.slices(batches, limit=c.SLICE_BYTES // 4):
        rows = left + [(i, t or "", x) for i, t, x in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("extra").to_pylist())]
        now = [k for k in range(len(rows) - 1) if not rows[k][2]]
        if now:
            yield _score([rows[k][0] for k in now], [rows[k][1] for k in now], [rows[k + 1][1] for k in now])
        left = rows[-1:]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One shuffle of the texts: ranges of doc_id, each with a copy of the first document of the next range."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    place = F.coalesce("doc_id", (F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 62))).cast("long"))
    docs = docs.select("doc_id", "text", place.alias("place"))
    n = min(c.partitions(docs), RANGES)  # a range is read in order, a slice at a time, so it may be large
    ids = docs.select("place")
    bounds = sorted(set(ids.agg(F.percentile_approx("place", [(i + 1) / n for i in range(n - 1)] or [0.5], 20 * n)).first()[0] or []))
    wide = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col("place")))
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values]) if values else F.array().cast("array<long>")
    coarse = below(longs([g[-1] for g in groups]))
    bucket = coarse * wide + F.coalesce(below(F.get(F.array(*[longs(g) for g in groups]), coarse)), F.lit(0)) if groups else F.lit(0)
    heads = {r[0]: r[1] for r in ids.groupBy(bucket.alias("pid")).agg(F.min("place")).collect()}  # a row for each range
    if not heads:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    order = sorted(heads)
    before = {heads[p]: order[i - 1] for i, p in enumerate(order)}  # the first document goes to the last range too
    also = F.get(F.array(*[F.struct(F.lit(heads.get(p)).cast("long").alias("head"), F.lit(before.get(heads.get(p))).cast("int").alias("pid")) for p in range(max(order) + 1)]), bucket)
    own = F.struct(bucket.cast("int").alias("pid"), F.lit(False).alias("extra"))
    copy = F.struct(also["pid"].alias("pid"), F.lit(True).alias("extra"))
    sent = docs.withColumn("to", F.explode(F.when(also["head"] == F.col("place"), F.array(own, copy)).otherwise(F.array(own)))).select("doc_id", "text", "place", "to.*")
    return c.exchange(sent, max(order) + 1).sortWithinPartitions("extra", "place", "text").mapInArrow(_each, SCHEMA)


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(c.table(spark, sf_dir, "documents"))
