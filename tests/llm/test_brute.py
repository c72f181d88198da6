"""Operators against brute force, and classifiers on held-out labels."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from logquern.llm import lines, ngrams, packing, pieces, registry, topk

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def words(text):
    return WORD.findall((text or "").encode().lower())


def similar(sets, num, den):
    """Pairs of places whose sets are similar."""
    return [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and den * (both := len(sets[i] & sets[j])) >= num * (len(sets[i]) + len(sets[j]) - both)]


def test_ngram_join(spark, docs):
    grams = [frozenset(tuple(w[i : i + 4]) for i in range(max(len(w) - 3, min(len(w), 1)))) for w in (words(t) for _, t in docs)]
    part = {d: d for d, _ in docs}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, j in similar(grams, 85, 100):
        a, b = sorted((root(docs[i][0]), root(docs[j][0])))
        part[b] = a
    want = {(d, len(g), root(d)) for (d, _), g in zip(docs, grams)}
    assert {tuple(r) for r in registry.queries()["op5_ngrams"](spark, SF).collect()} == want


def test_long_lists_and_blocks(spark, monkeypatch):
    """Many near copies: lists over LIST, groups over GROUP, and links only through others."""
    monkeypatch.setattr(ngrams, "GROUP", 20)
    rng = random.Random(0)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(90):
        base = list(base)
        base[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(base))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rule = ngrams.Rule(2, 80, 100)
    sets = [frozenset(zip(t.split(), t.split()[1:])) for t in texts]
    part = list(range(90))
    for i, j in similar(sets, 80, 100):
        low, high = sorted((part[i], part[j]))
        part = [low if p == high else p for p in part]
    assert {(r.doc_id, r.component_id) for r in ngrams.near_duplicates(df, rule).collect()} == set(enumerate(part))


def test_divide_skip():
    rng = np.random.default_rng(0)
    own = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(300)]
    rule = ngrams.Rule(0, 60, 100)
    index = ngrams.Index(own, rule)
    for q in range(20):
        want = [i for i, s in enumerate(own) if rule.links(len(np.intersect1d(s, own[q])), len(s), len(own[q]))]
        assert index.partners(q).tolist() == want


def test_line_dedup(spark, docs):
    own = sorted((d, k, frozenset(words(x))) for d, t in docs for k, x in enumerate((t or "").split("\n")))
    own = [x for x in own if x[2]]
    seen = collections.defaultdict(list)
    want = set()
    for j, (d, k, s) in enumerate(own):
        common = collections.Counter(i for w in s for i in seen[w])
        if any(5 * n >= 4 * (len(s) + len(own[i][2]) - n) for i, n in common.items()):
            want.add((d, k))
        for w in s:
            seen[w].append(j)
    got = lines.later_lines(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {(r.doc_id, r.line) for r in got} == want and len(got) == len(want)


def test_base_score(spark, docs):
    count = collections.Counter(w for d, t in docs if zlib.crc32(str(d).encode()) % 10 for w in [*words(t), b" end"])
    n, v = sum(count.values()), len(count)
    rows = {r.doc_id: r for r in registry.queries()["op2_mixing"](spark, SF).collect()}
    for d, t in docs:
        w, r = [*words(t), b" end"], rows[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(count[x] > 0 for x in w), n, zlib.crc32(str(d).encode()) % 10 == 0)
        assert abs(r.base_score - sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) < 1e-6
    assert sum(r.score for r in rows.values()) > sum(r.base_score for r in rows.values())


def test_top_k(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, registry.queries()["op9_topk"](spark, SF).collect())) == sorted(con.sql(topk.OP9_SQL).fetchall())


def test_viterbi():
    v = pieces.vocabulary(pieces.default_model())
    rng = random.Random(0)
    texts = ["", "  ", " a  b", "▁é▁ ñ\n\n   ok", "x" * 300 + " y"] + ["".join(rng.choice("ab  \né▁cthe") for _ in range(rng.randint(0, 150))) for _ in range(100)]
    offsets, ids = pieces.encode(pa.array(texts), v)
    for k, text in enumerate(texts):
        b, best, back, want = text.encode(), [0.0], [None], []
        for e in range(1, len(text.encode()) + 1):
            s, via = max(((best[e - n] + v.score[i], -n), (e - n, i)) for n in range(1, min(e, v.longest) + 1) if (i := v.of.get(b[e - n : e])) is not None)
            best.append(s[0])
            back.append(via)
        e = len(b)
        while e:
            e, i = back[e]
            want.append(i)
        assert ids[offsets[k] : offsets[k + 1]].tolist() == want[::-1] == list(pieces.stream(b, v))
    assert pieces.decode(offsets, ids, v).to_pylist() == [t.encode() for t in texts]


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(by):
    lengths = np.random.default_rng(0).integers(1, 100, 400)
    bins, places = packing.best_fit(lengths, 100, 7, 10_000, by=by)
    for b in np.unique(bins):
        own = np.flatnonzero(bins == b)
        assert lengths[own].sum() <= 100 and len(own) <= 7 and (lengths[own] ** 2).sum() <= 10_000
        order = own[np.argsort(places[own])]
        assert (places[order] == np.concatenate([[0], np.cumsum(lengths[order])[:-1]])).all()


@pytest.mark.parametrize("name,label,least", [("op4_quality", "quality", 0.9), ("op10_toxicity", "toxic", 0.85)])
def test_held_out(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    rows = registry.queries()[name](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r[label] for r in rows) >= least * len(rows)


def test_language(spark):
    rows = registry.queries()["op1_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
