"""N-gram Jaccard join by T-occurrence search, and the components of its links.

A document's set holds its distinct word n-grams. Two documents link when DEN * |intersection| >= NUM * |union|; then they
share at least T = ceil(NUM * n / DEN) of either's n grams. Documents with equal sets are one class.

1. Each class puts its grams in one order, rare ones first. If two classes link, the first l of what they share are among
   the first n - T + l grams of each. Inverted lists of these are met gram by gram. A short list (LIST classes at most)
   gives its pairs, and a pair must be met min(l) times; what such pairs connect is a group. The classes of a longer list
   become a group as they are; those of a gram with over a part of all grams do so without their list being gathered. So
   no list gives more rows than it has classes, but for short ones.
2. In a group, whole sets are at hand. A class's partners are found by DivideSkip: its shorter inverted lists are merged,
   and only what occurs there often enough is looked up, by binary search, in the longest ones. Classes already connected
   are not compared again. A group of over GROUP classes is cut into blocks; each block is searched together with PIVOTS
   classes of the whole group, and what lies outside the group's largest part afterwards is searched in every block. So a
   group of m classes of which f are such outsiders costs m + f * m / GROUP rows.
3. Links become components by alternating large and small stars until nothing changes; up to FEW links, whatever their
   number of documents, in one task, as each round of stars costs the driver several plans.

Grams are known by 64-bit hashes, classes by two such hashes of their grams, and every link rests on whole sets.

Null texts and texts without words have the empty set and link with nothing. Fewer than N words: the whole sequence is
the one gram. A very long text is one set like any other; only its slice of the batch grows. Rows with equal doc_id are
one document, which links with whatever one of its texts links with; they keep their rows, each with the size of its own
set. Rows without doc_id have no component and take no part in links. Extra columns are not read. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from . import rarity

SKETCH_BITS = 18
LIST = 32
GROUP = 1024
PIVOTS = 16  # classes of a large group that each of its blocks is compared with
LEAST_HOT = 4096  # a gram's list is never left ungathered below this
PROBE = 256  # length of an inverted list from which candidates are looked up in it
FLAGS = 1 << 24
FEW = 1 << 18  # links up to this number are connected by one task
BUFFER = 48 << 20  # bytes of text whose postings a task holds before it sends them

POSTING = np.dtype([("gram", "<u8"), ("id", "<i8"), ("n", "<u4")])
MEETING = np.dtype([("a", "<i8"), ("b", "<i8"), ("na", "<u4"), ("nb", "<u4"), ("times", "<u4")])


class Rule:
    """Grams of n words; links where den * |intersection| >= num * |union|."""

    def __init__(self, n: int = 4, num: int = 85, den: int = 100):
        self.n, self.num, self.den = n, num, den

    def least(self, size):
        """T: what a set of this size shares with any it links to."""
        return -(-self.num * size // self.den)

    def links(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)

    def meets(self, size):
        """l: how often two linked sets of about this size or more are required to meet."""
        return 1 + size // 64


def grams(texts: pa.Array, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashes of the n-grams of each text, with repeats."""
    offsets, codes, distinct = c.words(texts)
    h = c.hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    count = np.diff(offsets)
    width = np.minimum(count, rule.n)
    out = np.where(count > 0, np.maximum(count - rule.n + 1, 1), 0)
    starts = c.ranges(offsets[:-1], out)
    own = np.repeat(width, out)
    total = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        base = c.powers(rule.n + 1)
        for k in range(rule.n):
            some = slice(None) if (own > k).all() else own > k
            total[some] += h[starts[some] + k] * base[k]
        total = c.mix(total + own.astype(np.uint64))
    return np.concatenate([[0], np.cumsum(out)]), total


def sets(texts: pa.Array, rule: Rule) -> list[np.ndarray]:
    offsets, values = grams(texts, rule)
    return [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]


def identity(own: np.ndarray) -> tuple[int, int]:
    """A name of a set, of 128 bits as two signed integers."""
    with np.errstate(over="ignore"):
        one, two = c.mix(own), c.mix(own ^ np.uint64(0x6A09E667F3BCC909))
        both = np.array([one.sum() + np.uint64(len(own)), two.sum() ^ np.uint64(len(own))], np.uint64)
        return tuple(int(x) for x in c.mix(both).view(np.int64))


ROWS = "pid int, doc_id long, n long, id long, check long, head long, data binary"
COLUMNS = pa.schema([("pid", pa.int32()), *((k, pa.int64()) for k in ("doc_id", "n", "id", "check", "head")), ("data", pa.binary())])


def _rows(k: int, **columns) -> pa.RecordBatch:
    """k rows of ROWS; columns that aren't given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(k, f.type) for f in COLUMNS], schema=COLUMNS)


class Postings:
    """What a task holds of sets before it sends their first grams."""

    def __init__(self, n: int, hot: int):
        self.n, self.hot = n, hot
        self.names: list[int] = []
        self.sizes: list[int] = []
        self.firsts: list[np.ndarray] = []
        self.common: list[np.ndarray] = []

    def add(self, name: int, size: int, first: np.ndarray, count: np.ndarray) -> None:
        self.names.append(name)
        self.sizes.append(size)
        self.firsts.append(first[count <= self.hot])
        self.common.append(first[count > self.hot])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.names:
            return
        names, kept = np.unique(np.array(self.names, np.int64), return_index=True)  # equal sets of a task go on once
        sizes = np.array(self.sizes, np.int64)[kept]

        def chosen(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            own = [lists[k] for k in kept]
            return np.array([len(x) for x in own], np.int64), np.concatenate(own)

        lens, first = chosen(self.firsts)
        rows = np.empty(len(first), POSTING)
        rows["gram"], rows["id"], rows["n"] = first, np.repeat(names, lens), np.repeat(sizes, lens)
        sent = list(c.packed((first % np.uint64(self.n)).astype(np.int64), rows, self.n))
        yield _rows(len(sent), pid=[p for p, _ in sent], data=[d for _, d in sent])
        lens, common = chosen(self.common)
        if len(common):
            yield _rows(len(common), pid=(common % np.uint64(self.n)).astype(np.int64), id=np.repeat(names, lens), head=common.view(np.int64))
        self.names, self.sizes, self.firsts, self.common = [], [], [], []


def _postings(rule: Rule, held, n: int):
    """Rows of each document with its set, packed postings by gram, and members of the groups of hot grams."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        hot = max(LEAST_HOT, int(counts.sum(dtype=np.int64)) // (8 * n))
        shift = np.uint64(64 - SKETCH_BITS)
        buffered, kept = 0, Postings(n, hot)
        for part in c.slices(batches):
            own = sets(part.column("text"), rule)
            names = [identity(s) if len(s) else (None, None) for s in own]
            docs = part.column("doc_id").to_pylist()
            for s, (name, _), doc in zip(own, names, docs):
                if name is not None and doc is not None:
                    count = counts[(s >> shift).astype(np.int64)]
                    first = np.argsort(count, kind="stable")[: len(s) - rule.least(len(s)) + rule.meets(len(s))]
                    kept.add(name, len(s), s[first], count[first])
            pids = [hash(d) % n if d is not None else k % n for k, d in enumerate(docs)]
            yield _rows(len(docs), pid=pids, doc_id=part.column("doc_id"), n=[len(s) for s in own], id=[a for a, _ in names], check=[b for _, b in names])
            buffered += part.column("text").nbytes
            if buffered > BUFFER:
                yield from kept.flush()
                buffered = 0
        yield from kept.flush()

    return each


def _meet(rule: Rule, n: int):
    """Inverted lists of a partition's grams: packed meetings of pairs, members of groups; other rows go through."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            plain = batch.filter(batch.column("data").is_null())
            if plain.num_rows:
                yield plain
            got += [np.frombuffer(d, POSTING) for d in batch.column("data").drop_null().to_pylist()]
        if not got:
            return
        rows = np.concatenate(got)
        del got
        rows = rows[np.lexsort((rows["id"], rows["gram"]))]
        same = np.zeros(len(rows), bool)
        same[1:] = (rows["gram"][1:] == rows["gram"][:-1]) & (rows["id"][1:] == rows["id"][:-1])
        rows = rows[~same]
        edges = c.runs(rows["gram"])
        sizes = np.diff(edges)
        long = np.flatnonzero(sizes > LIST)
        if len(long):
            at = c.ranges(edges[long], sizes[long])
            yield from _members(np.unique(np.stack([rows["id"][at], np.repeat(rows["id"][edges[long]], sizes[long])]), axis=1))
        out = _short_lists(rule, rows, edges, sizes)
        if len(out):
            spread = c.mix((out["a"] ^ (out["b"] << 1)).astype(np.uint64)) % np.uint64(n)
            sent = list(c.packed(spread.astype(np.int64), out, n))
            yield _rows(len(sent), pid=[p for p, _ in sent], data=[d for _, d in sent])

    return each


def _short_lists(rule: Rule, rows: np.ndarray, edges: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Meetings of all pairs of the short lists whose sizes let them link."""
    short = np.flatnonzero((sizes > 1) & (sizes <= LIST))
    out = [np.empty(0, MEETING)]
    for size in np.unique(sizes[short]):
        i, j = np.triu_indices(size, 1)
        at = edges[short[sizes[short] == size]]
        step = max(1, (1 << 20) // len(i))
        for s in range(0, len(at), step):
            base = at[s : s + step, None]
            a, b = rows[(base + i).ravel()], rows[(base + j).ravel()]
            na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
            near = rule.links(np.minimum(na, nb), na, nb)
            out.append(_times(a["id"][near], b["id"][near], a["n"][near], b["n"][near], np.ones(near.sum(), np.uint32)))
    out = np.concatenate(out)
    return _times(*(out[k] for k in ("a", "b", "na", "nb", "times")))


def _members(m: np.ndarray) -> Iterator[pa.RecordBatch]:
    for s in range(0, m.shape[1], 10_000):
        own = m[:, s : s + 10_000]
        yield _rows(own.shape[1], pid=np.zeros(own.shape[1], np.int32), id=own[0], head=own[1])


def _times(a, b, na, nb, times) -> np.ndarray:
    """Meetings with the times of each pair (a < b) added up."""
    order = np.lexsort((b, a))
    a, b, na, nb, times = a[order], b[order], na[order], nb[order], times[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    out = np.empty(len(at), MEETING)
    out["a"], out["b"], out["na"], out["nb"] = a[at], b[at], na[at], nb[at]
    out["times"] = np.add.reduceat(times, at) if len(at) else times[:0]
    return out


def _candidates(rule: Rule):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.frombuffer(d, MEETING) for batch in batches for d in batch.column("data").to_pylist()]
        if got:
            rows = np.concatenate(got)
            rows = _times(*(rows[k] for k in ("a", "b", "na", "nb", "times")))
            rows = rows[rows["times"] >= rule.meets(np.minimum(rows["na"], rows["nb"]))]
            for s in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pydict({"u": rows["a"][s : s + 10_000], "v": rows["b"][s : s + 10_000]})

    return each


class Index:
    """Inverted lists of the sets of a group, and DivideSkip over them."""

    def __init__(self, own: list[np.ndarray], rule: Rule):
        self.rule, self.own = rule, own
        self.size = np.array([len(s) for s in own])
        grams_, docs = np.concatenate(own), np.repeat(np.arange(len(own)), self.size)
        order = np.lexsort((docs, grams_))
        self.docs = docs[order]
        grams_ = grams_[order]
        self.edges = c.runs(grams_)
        self.keys = grams_[self.edges[:-1]]
        self.longest = int(np.diff(self.edges).max())

    def partners(self, q: int) -> np.ndarray:
        """Places of the sets that link with the q-th (itself included)."""
        at = np.searchsorted(self.keys, self.own[q])
        lo, hi = self.edges[at], self.edges[at + 1]
        length = hi - lo
        t = self.rule.least(len(at))
        # Lists to look up: as many as DivideSkip sets, of those where a look-up costs less than a merge.
        long = min(t - 1, int(t / (0.01 * np.log2(self.longest + 1) + 1)), int((length > PROBE).sum()))
        order = np.argsort(-length, kind="stable")
        short, probe = order[long:], order[:long]
        merged = self.docs[c.ranges(lo[short], length[short])]
        times = np.bincount(merged, minlength=len(self.own))
        left = np.flatnonzero(times >= t - long)
        times = times[left]
        for i, k in enumerate(probe):
            keep = times + (len(probe) - i) >= t
            left, times = left[keep], times[keep]
            run = self.docs[lo[k] : hi[k]]
            place = np.searchsorted(run, left)
            times = times + (run[np.minimum(place, len(run) - 1)] == left)
        return left[self.rule.links(times, len(at), self.size[left])]


def connect(own: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """Links that connect whatever all links connect. Sets outside the largest part so far are compared with all; when
    each of them has been, all links but those within that part have been seen."""
    part = np.arange(len(own))
    index = Index(own, rule)
    done = np.zeros(len(own), bool)
    links = []
    while True:
        counts = np.bincount(part)
        left = np.flatnonzero(~done & (part != counts.argmax()) if counts.max() > 1 else ~done)
        if not len(left):
            return links
        q = int(left[0])
        done[q] = True
        found = index.partners(q)
        new = np.unique(part[found])
        new = new[new != part[q]]
        for label in new:
            links.append((q, int(found[part[found] == label][0])))
        part[np.isin(part, new)] = part[q]


def crossing(own: list[np.ndarray], queries: np.ndarray, parts: list, rule: Rule) -> list[tuple[int, int]]:
    """Links of the queries (places in own): one to each part among its partners."""
    index, parts = Index(own, rule), np.asarray(parts)
    links = []
    for q in queries:
        found = index.partners(int(q))
        _, first = np.unique(parts[found], return_index=True)
        links += [(int(q), int(k)) for k in found[first] if k != q]
    return links


def _groups(rule: Rule):
    """Rows (head, block, doc_id, part, data), in order of group and document; gives links. part is null in a group that is
    searched whole; a negative place marks the queries of a later search (asks)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, own, parts, asks = None, [], [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(docs) > 1:
                queries = np.flatnonzero(asks)
                found = crossing(own, queries, parts, rule) if len(queries) else connect(own, rule)
                found = [(docs[a], docs[b]) for a, b in found if docs[a] != docs[b]]
                if found:
                    yield pa.RecordBatch.from_pydict({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                if (row["head"], row["block"]) != key:
                    yield from close()
                    key, docs, own, parts, asks = (row["head"], row["block"]), [], [], [], []
                set_ = np.frombuffer(row["data"], np.uint64)
                if docs and docs[-1] == row["doc_id"] and np.array_equal(own[-1], set_):
                    asks[-1] |= row["asks"]
                    continue
                docs.append(row["doc_id"])
                own.append(set_)
                parts.append(row["part"] if row["part"] is not None else row["doc_id"])
                asks.append(row["asks"])
        yield from close()

    return each


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (u, v) of a table at once: node and component of the nodes that aren't the least of theirs."""
    got = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not got:
        return
    nodes, at = np.unique(np.concatenate([np.concatenate([u for u, _ in got]), np.concatenate([v for _, v in got])]), return_inverse=True)
    i, j = np.split(at, 2)
    label = np.arange(len(nodes))

    def root(k: np.ndarray) -> np.ndarray:
        while (label[k] != k).any():
            k = label[k]
        return k

    while len(i):
        i, j = root(i), root(j)
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))
    label = root(np.arange(len(nodes)))
    some = np.flatnonzero(label != np.arange(len(nodes)))
    for s in range(0, len(some), 10_000):
        k = some[s : s + 10_000]
        yield pa.RecordBatch.from_pydict({"node": nodes[k], "component": nodes[label[k]]})


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node of links u, v: alternating stars, each round written. The
    rows of a node with very many links are two numbers each; adaptive execution splits them in a join."""
    edges = c.stored(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if edges.count() <= FEW:
        found = c.stored(edges.coalesce(1).mapInArrow(_united, "node long, component long"))
        c.forget(edges)
        return found
    before = None
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))  # large star: larger neighbours go to the least one
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))  # small star: smaller neighbours and itself go to the least
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        following = c.stored(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = following.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        c.forget(edges)
        edges = following
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _search(sets_: DataFrame, asked: DataFrame, rule: Rule, n: int) -> DataFrame:
    """Links from searching each (head, block) of asked: doc_id, head, block, part, asks."""
    rows = sets_.join(asked, "doc_id").select("head", "block", "doc_id", "part", "asks", "data")
    return rows.repartition(n, "head", "block").sortWithinPartitions("head", "block", "doc_id", "data").mapInArrow(_groups(rule), "u long, v long")


def group_links(sets_: DataFrame, members: DataFrame, rule: Rule, n: int) -> DataFrame:
    """Links that connect, in each group (members: doc_id, head), whatever all its links connect. sets_: doc_id, data."""
    sizes = c.stored(members.groupBy("head").agg(F.count("*").alias("many")).filter("many > 1"))
    cut = c.looked_up(members, sizes.withColumn("blocks", F.ceil(F.col("many") / GROUP)), ["head"], "many").filter("blocks IS NOT NULL")
    none, no = F.lit(None).cast("long").alias("part"), F.lit(False).alias("asks")
    if sizes.filter(F.col("many") > GROUP).isEmpty():
        return _search(sets_, cut.select("doc_id", "head", F.lit(0).cast("long").alias("block"), none, no), rule, n)
    cut = c.stored(cut.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))))
    large = cut.filter("blocks > 1")
    # The pivots of a large group: of each of its first blocks the document with the least hash.
    pivots = large.filter(F.col("block") < PIVOTS).groupBy("head", "block").agg(F.min(F.struct(F.xxhash64("doc_id", "head"), "doc_id")).alias("x"), F.first("blocks").alias("blocks"))
    pivots = pivots.select(F.col("x.doc_id").alias("doc_id"), "head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    first = cut.select("doc_id", "head", "block").union(pivots).distinct().select("*", none, no)
    links = c.stored(_search(sets_, first, rule, n))
    # What lies outside its group's largest part is searched in all blocks of the group.
    found = components(links)
    part = large.join(found, large["doc_id"] == found["node"], "left").select("doc_id", "head", "block", "blocks", F.coalesce("component", "doc_id").alias("part"))
    part = c.stored(part)
    tops = part.groupBy("head", "part").agg(F.count("*").alias("n")).groupBy("head").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("many"))
    part = c.stored(c.looked_up(part, tops.select("head", F.col("top.part").alias("top"), "many"), ["head"], "many"))
    outside = part.filter("part <> top").select("doc_id", "head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "part", F.lit(True).alias("asks"))
    open_ = part.groupBy("head").agg(F.count_if(F.col("part") != F.col("top")).alias("out"), F.count("*").alias("many")).filter("out > 0")
    inside = c.looked_up(part, open_, ["head"], "many").filter("out IS NOT NULL").select("doc_id", "head", "block", "part", F.lit(False).alias("asks"))
    asked = outside.union(inside).groupBy("doc_id", "head", "block", "part").agg(F.max("asks").alias("asks"))
    return links.union(_search(sets_, asked, rule, n))


def join(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets (doc_id, n, and the set's name id, check or null) of all rows, classes, and links between first documents of
    classes; the first two stored."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sc = docs.sparkSession.sparkContext
    n = c.partitions(docs)
    counts = sc.broadcast(rarity.counters(docs, lambda part: (grams(part.column("text"), rule)[1], None), SKETCH_BITS))
    met = c.stored(c.exchange(docs.mapInArrow(_postings(rule, counts, n), ROWS), n).mapInArrow(_meet(rule, n), ROWS))
    own = met.filter("n IS NOT NULL").select("doc_id", "n", "id", "check")
    first = c.stored(classes(own))
    pairs = components(c.exchange(met.filter("data IS NOT NULL").select("pid", "data"), n).mapInArrow(_candidates(rule), "u long, v long"))
    pairs = pairs.select(F.col("node").alias("id"), F.col("component").alias("head")).union(pairs.select(F.col("component"), F.col("component")).distinct())
    members = pairs.union(met.filter("head IS NOT NULL").select("id", "head")).distinct()
    members = c.stored(members.join(first, "id").select("doc_id", "head").distinct())
    # Whole sets are made again, for the documents that are in a group; flags let a few others through.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FLAGS))
    flags = sc.broadcast(np.packbits(rarity.bitmap(members.select(place.alias("bit")), FLAGS)))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_ = np.unpackbits(flags.value).astype(bool)
        for batch in batches:
            for part in c.slices([batch.filter(pa.array(set_[batch.column("bit").to_numpy()]))]):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in sets(part.column("text"), rule)], pa.binary())], ["doc_id", "data"])

    data = docs.filter("doc_id IS NOT NULL").withColumn("bit", place).mapInArrow(again, "doc_id long, data binary").filter("length(data) > 0")
    links = group_links(data, members, rule, n)
    return own, first, links.union(_of_one_document(own, first))


def classes(own: DataFrame) -> DataFrame:
    """The first document of each class, and how many rows the class has."""
    return own.filter("id IS NOT NULL AND doc_id IS NOT NULL").groupBy("id", "check").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("many"))


def _of_one_document(own: DataFrame, first: DataFrame) -> DataFrame:
    """Links of a document that several rows give different texts to the first documents of their classes."""
    several = own.filter("id IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("id") != F.max("id")).alias("a"), (F.min("check") != F.max("check")).alias("b")).filter("a OR b").select("doc_id")
    rows = own.join(several, "doc_id").select(F.col("doc_id").alias("u"), "id", "check")
    return rows.join(first.select("id", "check", F.col("doc_id").alias("v")), ["id", "check"]).select("u", "v").filter("u <> v")


def near_duplicates(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    own, first, links = join(docs, rule)
    found = components(links)
    first = first.withColumnRenamed("doc_id", "node").join(found, "node", "left")
    first = c.stored(first.select("id", "check", "many", F.coalesce("component", "node").alias("of_class")))
    rows = c.looked_up(own, first, ["id", "check"], "many")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id")).alias("component_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component)


def op5_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "documents"), Rule(4, 85, 100))
