"""Line deduplication by an exact set-similarity join.

A line's set holds its distinct words. A line goes when an earlier line has a Jaccard similarity of NUM / DEN or more;
whether that earlier line goes itself doesn't matter. Lines stand in order of (doc_id, hash of the whole text, place in the
text). Lines without a word stay.

1. Each line's words are put in one order, rare ones first. Two similar lines share a word of their prefixes (the first
   n - ceil(NUM / DEN * n) + 1 words). Of equal lines in a task the first one goes on, the others are out.
2. Inverted lists of the prefix words are met word by word. Of equal lines there all but the first are out. Of two
   others, sizes, the place of the shared word and a signature (64 parities, 256 for long lines, of which two lines differ
   in at most as many as they have words apart) bound the similarity. The lines that passing pairs of a list connect are
   a group, named after its first line; so a list gives no more rows than it has lines.
3. In a group whole sets are at hand, and a line goes if the search for its partners finds an earlier one. A group of over
   GROUP lines is cut into blocks, each of which is searched together with the PIVOTS first lines of the group; a line for
   which that finds nothing is then searched in all blocks. A group of m lines of which f are left over by the first
   search costs m + f * m / GROUP rows.
4. Texts are put together again from the lines that stay.

Null texts stay null, empty ones empty. A row is known by (doc_id, 64-bit hash of its text): repeated rows are one document
and all lose the same lines, rows with equal doc_id and different texts are documents of their own. Rows without doc_id
stay as they are. A very long text is held by one task; its lines are lines like any other. All columns of the input are
kept, whatever their names. An empty table stays empty. Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c
from . import rarity
from .ngrams import Index, Rule

NUM, DEN = 4, 5
SKETCH_BITS = 21
SHORT = 2048  # inverted lists up to this length are met pair by pair
FEW = 16
GROUP = 4096
PIVOTS = 16  # first lines of a large group that each of its blocks is compared with
FLAGS = 1 << 24
BUFFER = 24 << 20
LONG = 96  # words from which a line has all 256 parities

#: Packed columns of a posting; doc is a place in the task's own list of documents.
POSTING = (("word", "<u4"), ("id", "<u4"), ("n", "<u4"), ("place", "<u4"), ("signature", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("line", "<u4"))
LINE = np.dtype([("doc", "<i8"), ("text", "<i8"), ("line", "<u4")])
MEMBER = np.dtype([*LINE.descr, ("doc0", "<i8"), ("text0", "<i8"), ("line0", "<u4")])
KEY = ["doc_id", "text_id", "line"]
HEAD = ["doc0", "text0", "line0"]


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    return c.flat(pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), "\n"))


def line_sets(lines: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by line, and the hashes of its distinct words, rare ones first."""
    offsets, codes, distinct = c.words(lines)
    h = c.hashes(distinct)
    order = np.lexsort((h, counts[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    key = np.sort(np.repeat(np.arange(len(lines)) << 32, np.diff(offsets)) | rank[codes])
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return np.concatenate([[0], np.cumsum(np.bincount(key >> 32, minlength=len(lines)))]), h[order][key & 0xFFFFFFFF]


def least(total):
    """What two sets with so many words together must share."""
    return -(-NUM * total // (NUM + DEN))


def flag(doc: np.ndarray, text: np.ndarray, line: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (c.mix(c.mix(doc.astype(np.uint64)) + text.astype(np.uint64) + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)


def _postings(held, n: int):
    """Rows (pid, data, lines): packed columns of postings by word, and packed lines that are out by document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        buffered, kept = 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            doc, text, line, name, size, lens, words, signature = (np.concatenate([k[i] for k in kept]) for i in range(8))
            order = np.lexsort((line, text, doc, size, name))
            same = np.zeros(len(order), bool)
            same[1:] = (name[order[1:]] == name[order[:-1]]) & (size[order[1:]] == size[order[:-1]])
            out = order[same]
            first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))[same]]
            out = out[(doc[out] != doc[first]) | (text[out] != text[first]) | (line[out] != line[first])]  # a repeated row isn't an earlier line
            rows = np.empty(len(out), LINE)
            rows["doc"], rows["text"], rows["line"] = doc[out], text[out], line[out]
            sent = list(c.packed((c.mix(doc[out].astype(np.uint64)) % np.uint64(n)).astype(np.int64), rows, n))
            on = np.sort(order[~same])
            off, prefix = c.gather(np.concatenate([[0], np.cumsum(lens)]), words, on)
            own = np.repeat(on, np.diff(off))
            place = c.within(off)
            pid = ((prefix >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
            by = np.lexsort((prefix & np.uint64(0xFFFFFFFF), pid))
            edges = np.searchsorted(pid[by], np.arange(n + 1))
            columns = dict(word=prefix & np.uint64(0xFFFFFFFF), id=name[own] & np.uint64(0xFFFFFFFF), n=size[own], place=place, signature=np.bitwise_xor.reduce(signature, axis=1)[own], doc=doc[own], text=text[own], line=line[own])
            columns = {k: columns[k].astype(t)[by] for k, t in POSTING}
            full = np.flatnonzero(np.diff(edges))
            extra = lambda a, b: signature[own[by[a:b]][columns["n"][a:b] > LONG], 1:].tobytes()
            data = [int(edges[p + 1] - edges[p]).to_bytes(4, "little") + b"".join(columns[k][edges[p] : edges[p + 1]].tobytes() for k, _ in POSTING) + extra(edges[p], edges[p + 1]) for p in full]
            yield pa.RecordBatch.from_pydict({"pid": pa.array([*full, *(p for p, _ in sent)], pa.int32()), "data": pa.array([*data, *[None] * len(sent)], pa.binary()), "lines": pa.array([*[None] * len(full), *(d for _, d in sent)], pa.binary())})

        for part in c.slices(batches):
            part = part.filter(part.column("doc_id").is_valid())
            offsets, lines = split(part.column("text"))
            off, words = line_sets(lines, counts)
            size = np.diff(off)
            full = np.flatnonzero(size)
            if len(full):
                size, starts = size[full], off[:-1][full]
                doc, text = (np.repeat(part.column(k).to_numpy(), np.diff(offsets))[full] for k in ("doc_id", "text_id"))
                with np.errstate(over="ignore"):
                    name = c.mix(np.add.reduceat(c.mix(words), starts) + size.astype(np.uint64))
                bit, part_of = np.uint64(1) << (words & np.uint64(63)), words >> np.uint64(6) & np.uint64(3)
                signature = np.stack([np.bitwise_xor.reduceat(np.where(part_of == k, bit, np.uint64(0)), starts) for k in range(4)], axis=1)
                prefix = size - -(-NUM * size // DEN) + 1
                kept.append((doc, text, c.within(offsets)[full], name, size, prefix, words[c.ranges(starts, prefix)], signature))
            buffered += part.column("text").nbytes
            if buffered > BUFFER and kept:
                yield from flush()
                buffered, kept = 0, []
        if kept:
            yield from flush()

    return each


def _near(a: dict, b: dict) -> np.ndarray:
    """Whether a and b (postings of one word) may be similar."""
    na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
    total = na + nb
    need = least(total)
    fold = a["signature"] ^ b["signature"]
    apart = np.bitwise_count(fold).astype(np.int64)
    reach = np.minimum(a["place"], b["place"]) + np.minimum(na - a["place"], nb - b["place"])
    near = (DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)) & (reach >= need) & (apart <= total - 2 * need)
    long = np.flatnonzero(near & (np.minimum(na, nb) > LONG))
    more = a["extra"][long] ^ b["extra"][long]
    apart[long] = np.bitwise_count(more).sum(axis=1) + np.bitwise_count(fold[long] ^ np.bitwise_xor.reduce(more, axis=1))
    near[long] &= apart[long] <= (total - 2 * need)[long]
    return near


def _members(n: int):
    """Inverted lists of a partition's words: rows (pid, members, lines), packed by the line's document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = []
        for batch in batches:
            lines = batch.filter(batch.column("lines").is_valid())
            if lines.num_rows:
                yield pa.RecordBatch.from_arrays([lines.column("pid"), pa.nulls(lines.num_rows, pa.binary()), lines.column("lines")], ["pid", "members", "lines"])
            for data in batch.column("data").drop_null().to_pylist():
                k = int.from_bytes(data[:4], "little")
                at, columns = 4, []
                for _, t in POSTING:
                    columns.append(np.frombuffer(data, t, k, at))
                    at += k * np.dtype(t).itemsize
                more = np.zeros((k, 3), np.uint64)  # the parts of the signature of long lines, but for the first
                more[columns[2] > LONG] = np.frombuffer(data, "<u8", offset=at).reshape(-1, 3)
                got.append([*columns, more])
        if not got:
            return
        r = {k: np.concatenate([g[i] for g in got]) for i, k in enumerate([*(k for k, _ in POSTING), "extra"])}
        del got

        def take(which: np.ndarray) -> None:
            for k in r:
                r[k] = r[k][which]

        def shared() -> None:
            """Only lists of two lines and more."""
            size = np.diff(c.runs(r["word"]))
            take(np.flatnonzero(np.repeat(size > 1, size)))

        take(np.argsort(r["word"], kind="stable"))
        shared()
        # Equal lines: the first one stays, the others are out.
        r["rank"] = np.empty(len(r["word"]), np.uint32)
        r["rank"][np.lexsort((r["line"], r["text"], r["doc"]))] = np.arange(len(r["rank"]))
        by_word = lambda k: r["word"].astype(np.uint64) << np.uint64(32) | r[k]
        take(np.lexsort((r["rank"], r["signature"], r["n"], by_word("id"))))
        same = np.ones(len(r["word"]), bool)
        same[:1] = False
        for k in ("word", "n", "signature", "id"):
            same[1:] &= r[k][1:] == r[k][:-1]
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        later = same & ((r["doc"] != r["doc"][first]) | (r["text"] != r["text"][first]) | (r["line"] != r["line"][first]))
        out = _unique(np.rec.fromarrays([r[k][later] for k in LINE.names], dtype=LINE))
        take(np.flatnonzero(~same))
        shared()
        take(np.argsort(by_word("rank")))
        edges = c.runs(r["word"])
        sizes = np.diff(edges)
        label = np.arange(edges[-1])

        def root(i: np.ndarray) -> np.ndarray:
            while (label[i] != i).any():
                i = label[i]
            return i

        def unite(i: np.ndarray, j: np.ndarray) -> None:
            while len(i):
                i, j = root(i), root(j)
                apart = i != j
                i, j = i[apart], j[apart]
                np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return _near({k: r[k][i] for k in ("n", "place", "signature", "extra")}, {k: r[k][j] for k in ("n", "place", "signature", "extra")})

        # In a list, a line is met with those after it in order of size, up to the largest size that can be similar.
        small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SHORT), sizes))
        by = small[np.lexsort((r["n"][small], r["word"][small]))]
        n_, list_ = r["n"][by].astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)[by]
        key = list_ << 32 | n_
        ends = np.searchsorted(key, list_ << 32 | n_ * DEN // NUM, side="right")
        partners = ends - np.arange(len(by)) - 1
        signature, bound = r["signature"][by], n_ * (NUM + DEN) // NUM // (NUM + DEN)
        total = np.concatenate([[0], np.cumsum(partners)])
        start = 0
        while start < len(by):
            end = max(start + 1, int(np.searchsorted(total, total[start] + (1 << 18), side="right")) - 1)
            i = np.repeat(np.arange(start, end), partners[start:end])
            j = c.ranges(np.arange(start, end) + 1, partners[start:end])
            some = np.bitwise_count(signature[i] ^ signature[j]) <= bound[i]
            i, j = by[i[some]], by[j[some]]
            passed = near(i, j)
            unite(i[passed], j[passed])
            start = end
        for k in np.flatnonzero(sizes > SHORT):
            at = np.arange(edges[k], edges[k + 1])
            own, done = np.arange(len(at)), np.zeros(len(at), bool)
            while True:  # as in ngrams.connect: what is outside the largest part so far is compared with all
                counts = np.bincount(own)
                left = np.flatnonzero(~done & (own != counts.argmax()) if counts.max() > 1 else ~done)
                if not len(left):
                    break
                q = left[0]
                done[q] = True
                found = near(np.full(len(at), at[q]), at)
                found[q] = True
                own[np.isin(own, own[found])] = own[q]
            _, first_of, part = np.unique(own, return_index=True, return_inverse=True)
            label[at] = at[first_of][part]
        label = root(np.arange(len(label)))
        sized = np.bincount(label, minlength=len(label))[label] > 1
        head = label[sized]
        rows = np.empty(len(head), MEMBER)
        for k in LINE.names:
            rows[k], rows[f"{k}0"] = r[k][sized], r[k][head]
        rows = _unique(rows)
        spread = lambda x: (c.mix(x["doc"].astype(np.uint64)) % np.uint64(n)).astype(np.int64)
        sent = [(p, None, d) for p, d in c.packed(spread(out), out, n)] + [(p, d, None) for p, d in c.packed(spread(rows), rows, n)]
        if sent:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in sent], pa.int32()), pa.array([x[1] for x in sent], pa.binary()), pa.array([x[2] for x in sent], pa.binary())], ["pid", "members", "lines"])

    return each


def _unique(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort([rows[k] for k in reversed(rows.dtype.names)])]
    new = np.ones(len(rows), bool)
    if len(rows):
        new[1:] = False
        for k in rows.dtype.names:
            new[1:] |= rows[k][1:] != rows[k][:-1]
    return rows[new]


FOUND = "doc_id long, text_id long, line long, doc0 long, text0 long, line0 long, bit long"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lines that are out, and of members of groups (with the group's first line)."""
    members, lines = [np.empty(0, MEMBER)], [np.empty(0, LINE)]
    for batch in batches:
        members += [np.frombuffer(d, MEMBER) for d in batch.column("members").drop_null().to_pylist()]
        lines += [np.frombuffer(d, LINE) for d in batch.column("lines").drop_null().to_pylist()]
    for rows in (_unique(np.concatenate(lines)), _unique(np.concatenate(members))):
        for s in range(0, len(rows), 10_000):
            x = rows[s : s + 10_000]
            key = dict(zip(KEY, (x["doc"], x["text"], x["line"].astype(np.int64))))
            if "doc0" in x.dtype.names:
                head = dict(zip(HEAD, (x["doc0"], x["text0"], x["line0"].astype(np.int64))))
            else:
                head = {k: pa.nulls(len(x), pa.int64()) for k in HEAD}
            yield pa.RecordBatch.from_pydict({**key, **head, "bit": flag(x["doc"], x["text"], x["line"])})


def _arrays(flags):
    """The sorted sets of flagged lines: doc_id, text_id, line, words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_ = np.unpackbits(flags.value).astype(bool)
        none = np.zeros(1 << SKETCH_BITS, np.uint8)
        for part in c.slices(batches):
            part = part.filter(part.column("doc_id").is_valid())
            offsets, lines = split(part.column("text"))
            doc, text = (np.repeat(part.column(k).to_numpy(), np.diff(offsets)) for k in ("doc_id", "text_id"))
            line = c.within(offsets)
            some = np.flatnonzero(set_[flag(doc, text, line)])
            off, words = line_sets(lines.take(pa.array(some)), none)
            yield pa.RecordBatch.from_pydict({"doc_id": doc[some], "text_id": text[some], "line": line[some], "words": c.strings(off * 8, words.view(np.uint8), pa.binary())})

    return each


def removed(own: list[np.ndarray]) -> np.ndarray:
    """Which of the sets, in order, have an earlier one that is similar."""
    out = np.zeros(len(own), bool)
    if len(own) <= FEW:
        sets = [frozenset(x.tolist()) for x in own]
        for q in range(1, len(sets)):
            a = len(sets[q])
            out[q] = any(DEN * (both := len(sets[q] & x)) >= NUM * (a + len(x) - both) for x in sets[:q])
        return out
    index = Index(own, Rule(0, NUM, DEN))
    out[index.partners(0)] = True  # in a group of copies of its first line that is nearly all
    out[0] = False
    for q in np.flatnonzero(~out):
        out[q] = (index.partners(q) < q).any()
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, block, asks, line, words), in order of group, block and line; gives the lines that are out. Where a
    block has rows that ask, only these are searched."""
    key, lines, own, asks = None, [], [], []

    def close() -> Iterator[pa.RecordBatch]:
        if len(lines) > 1:
            queries = np.flatnonzero(asks)
            out = asked(own, queries) if len(queries) else np.flatnonzero(removed(own))
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array([lines[k][i] for k in out], pa.int64()) for i in range(3)], KEY)

    for batch in batches:
        for row in batch.to_pylist():
            if (group := tuple(row[k] for k in (*HEAD, "block"))) != key:
                yield from close()
                key, lines, own, asks = group, [], [], []
            if lines and lines[-1] == tuple(row[k] for k in KEY):
                asks[-1] |= row["asks"]
                continue
            lines.append(tuple(row[k] for k in KEY))
            own.append(np.frombuffer(row["words"], np.uint64))
            asks.append(row["asks"])
    yield from close()


def asked(own: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """Those of the queries that have an earlier similar set."""
    index = Index(own, Rule(0, NUM, DEN))
    return np.array([q for q in queries if (index.partners(int(q)) < q).any()], np.int64)


def _search(sets: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """The lines of rows (line, group, block, asks) that are out."""
    order = [*HEAD, "block"]
    near = sets.join(rows, KEY).repartition(n, *order).sortWithinPartitions(*order, *KEY)
    return near.mapInArrow(_groups, "doc_id long, text_id long, line long")


def group_lines(sets: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """Lines that an earlier line of one of their groups (members: line and group) is similar to."""
    sizes = c.stored(members.groupBy(*HEAD).agg(F.count("*").alias("many")))
    no, first_block = F.lit(False).alias("asks"), F.lit(0).cast("long").alias("block")
    if sizes.filter(F.col("many") > GROUP).isEmpty():
        return _search(sets, members.select(*KEY, *HEAD, first_block, no), n)
    cut = c.looked_up(members, sizes.withColumn("blocks", F.ceil(F.col("many") / GROUP)), HEAD, "many")
    cut = c.stored(cut.withColumn("block", F.pmod(F.xxhash64(*KEY), F.col("blocks"))))
    large = cut.filter("blocks > 1")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    # The first lines of each block, and of these the first ones of the group: a row for each block.
    heads = large.groupBy(*HEAD, "block").agg(F.min(F.struct(*KEY)).alias("x"), F.first("blocks").alias("blocks"))
    rank = F.row_number().over(Window.partitionBy(*HEAD).orderBy("x"))
    pivots = heads.withColumn("rank", rank).filter(F.col("rank") <= PIVOTS).select("x.*", *HEAD, every)
    found = c.stored(_search(sets, cut.select(*KEY, *HEAD, "block").union(pivots).distinct().select("*", no), n).distinct())
    left = large.join(found, KEY, "left_anti")  # by line: keys are as many as lines
    inside = large.select(*KEY, *HEAD, "block", no)
    rows = left.select(*KEY, *HEAD, every).select("*", F.lit(True).alias("asks")).union(inside)
    rows = rows.groupBy(*KEY, *HEAD, "block").agg(F.max("asks").alias("asks"))
    return found.union(_search(sets, rows, n))


def later_lines(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text and place (from 0) of the lines that go."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_id(F.col("text"))).filter("doc_id IS NOT NULL")
    sc, n = docs.sparkSession.sparkContext, c.partitions(docs)

    def tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        _, codes, distinct = c.words(part.column("text"))
        return c.hashes(distinct), np.bincount(codes, minlength=len(distinct))

    counts = sc.broadcast(rarity.counters(docs, tokens, SKETCH_BITS))
    lists = c.exchange(docs.mapInArrow(_postings(counts, n), "pid int, data binary, lines binary"), n)
    met = c.exchange(lists.mapInArrow(_members(n), "pid int, members binary, lines binary"), n)
    found = c.stored(met.mapInArrow(_settle, FOUND))
    members = found.filter("doc0 IS NOT NULL")
    flags = sc.broadcast(np.packbits(rarity.bitmap(members.select("bit"), FLAGS)))
    sets = docs.mapInArrow(_arrays(flags), "doc_id long, text_id long, line long, words binary")
    return found.filter("doc0 IS NULL").select(*KEY).union(group_lines(sets, members.select(*KEY, *HEAD), n)).distinct()


def text_id(text: Column) -> Column:
    return F.xxhash64(text.cast("string")).alias("text_id")


def deduplicate(docs: DataFrame, empty: bool = True) -> DataFrame:
    """docs without the lines that go; n_chars, where there is such a column, follows. empty=False: documents of which
    lines went and no word is left go too."""
    names = docs.columns
    doc, text, gone = c.fresh(docs, "lost_doc", "lost_text", "lost_lines")
    lost = later_lines(docs).groupBy("doc_id", "text_id").agg(F.collect_list("line").alias(gone))  # as long as the document itself
    lost = lost.withColumnsRenamed({"doc_id": doc, "text_id": text}).hint("shuffle_hash")
    joined = docs.join(lost, (docs["doc_id"].cast("long") == lost[doc]) & (text_id(docs["text"]) == lost[text]), "left").drop(doc, text)
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in c.slices(batches):
            texts, kept = part.column(at).to_pylist(), np.ones(part.num_rows, bool)
            changed = part.column(len(names)).is_valid()
            for i, lines in enumerate(part.column(len(names)).to_pylist()):
                if lines:
                    lines = set(lines)
                    texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in lines)
                    kept[i] = empty or bool(texts[i].strip())
            columns = list(part.columns)[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            if chars is not None:
                columns[chars] = pc.if_else(changed, pc.utf8_length(columns[at]).cast(columns[chars].type), columns[chars])
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(kept))

    return joined.mapInArrow(each, docs.schema)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text, and how many lines it had and lost."""
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda text: F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0))
    return deduplicate(docs.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(count("text")))).select("doc_id", "text", "n_lines")
