"""The n-gram join against brute force: hashes, groups cut into blocks, hot grams, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from logquern.llm import common as c
from logquern.llm import ngrams


def brute(rows, rule):
    """(doc_id, set size, component) of (doc_id, text) rows."""

    def grams(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[i : i + rule.n]) for i in range(max(len(w) - rule.n + 1, min(len(w), 1))))

    own = [(d, grams(t)) for d, t in rows]
    part = {d: d for d, _ in rows if d is not None}
    for i, (d, a) in enumerate(own):
        for e, b in own[:i]:
            if a and b and d is not None and e is not None and rule.links(len(a & b), len(a), len(b)):
                low, high = sorted((part[d], part[e]))
                part = {k: low if v == high else v for k, v in part.items()}
    return sorted(((d, len(g), part.get(d)) for d, g in own), key=str)


def check(spark, rows, rule):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngrams.near_duplicates(df, rule).collect()), key=str) == brute(rows, rule)


def thue_morse(k):
    t = "a"
    for _ in range(k):
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("k", [10, 11, 12])
def test_thue_morse(spark, k):
    """Words whose polynomial hashes modulo 2 ** 64 are equal."""
    a, b = thue_morse(k)
    h = c.hashes(pa.array([a, b, a[:-1], "", "\0", "\0\0"]))
    assert len(set(h.tolist())) == 6
    check(spark, [(1, f"{a} x y z"), (2, f"{b} x y z")], ngrams.Rule(4, 85, 100))


def test_odd_rows(spark):
    text, other = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, text), (None, text), (2, None), (3, ""), (4, " \n"), (5, " \n"), (6, other), (7, text), (7, other), (7, other), (8, "Two words"), (9, "two WORDS"), (10, "unlike all of the rest here")]
    check(spark, rows, ngrams.Rule(4, 85, 100))


def family(rng, n, size, changes):
    """Near copies, each a few changes from the one before or from the first."""
    base = [f"{rng.random()}" for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(rng.choice(out).split()) if out and rng.random() < 0.5 else list(base)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(size)] = f"x{rng.randrange(1000)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("hot", [4096, 3])
def test_large_groups(spark, monkeypatch, hot):
    """Groups cut into blocks whose parts only pivots or outsiders connect; families that share a passage but don't link;
    grams whose lists are never gathered."""
    for name, value in (("GROUP", 12), ("PIVOTS", 2), ("LIST", 4), ("LEAST_HOT", hot)):
        monkeypatch.setattr(ngrams, name, value)
    rng = random.Random(hot)
    passage = " ".join(f"p{i}" for i in range(70))
    texts = family(rng, 60, 60, 3) + [f"{passage} {t}" for t in family(rng, 30, 20, 3) + family(rng, 30, 20, 8)]
    texts += [f"{passage} q{i} q{i + 1} r{i}" for i in range(20)]
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)), ngrams.Rule(2, 80, 100))


def test_looked_up(spark):
    """Hot keys are broadcast, others joined; null keys and keys without a partner keep their rows."""
    left = spark.createDataFrame([(i, 1 if i < 3000 else i) for i in range(4000)] + [(-1, None), (-2, 10**6)], "i long, k long")
    right = left.filter("k < 10000").selectExpr("k").groupBy("k").agg({"*": "count"}).withColumnRenamed("count(1)", "many").selectExpr("k", "many", "k * 2 AS v")
    got = {r.i: r.v for r in c.looked_up(left, right, ["k"], "many").collect()}
    assert got == {**{i: 2 if i < 3000 else 2 * i for i in range(4000)}, -1: None, -2: None}


def test_a_large_family_is_not_all_pairs(spark):
    """The rows that a group of near copies is searched with grow with its size, not with its square."""
    n = 3 * ngrams.GROUP
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        own = [f"w{k}" for k in range(200)]
        own[int(rng.integers(200))] = f"x{i}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    search = ngrams._search
    ngrams._search = lambda sets_, asked, rule, m: seen.append(asked.count()) or search(sets_, asked, rule, m)
    try:
        got = ngrams.near_duplicates(df, ngrams.Rule(4, 85, 100)).select("component_id").distinct().collect()
    finally:
        ngrams._search = search
    assert [r[0] for r in got] == [0] and sum(seen) < 2 * n


def test_components_in_one_task(spark, monkeypatch):
    """Few links cost no rounds of stars, and give the components that the rounds give."""
    rng = random.Random(5)
    rows = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(350)] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7), (3, 4), (4, 3)]
    links = spark.createDataFrame(rows, "u long, v long")
    found = lambda: sorted(map(tuple, ngrams.components(links).collect()))
    written = []
    kept = c.stored
    monkeypatch.setattr(c, "stored", lambda *a: written.append(1) or kept(*a))
    one = found()
    assert len(written) == 2
    monkeypatch.setattr(ngrams, "FEW", 0)
    assert one == found() and len(one) == len({k for k, _ in one})
    assert found() == one and not ngrams.components(links.limit(0)).collect()
