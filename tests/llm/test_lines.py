"""Line deduplication against brute force: row identity, hashes, large groups, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from logquern.llm import lines


def brute(rows):
    """What is left of each (doc_id, text hash, text) row: every line is compared with every earlier one."""
    own = sorted({(d, h, k, x) for d, h, t in rows if d is not None and t is not None for k, x in enumerate(t.split("\n"))})
    sets = [frozenset(x.lower().split()) for *_, x in own]
    gone = {own[j][:3] for j in range(len(own)) if sets[j] and any(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for i in range(j))}
    return sorted(((d, t if t is None or d is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, h, k) not in gone)) for d, h, t in rows), key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute([tuple(r) for r in df.select("doc_id", F.xxhash64("text"), "text").collect()])
    got = lines.deduplicate(df.withColumn("_doc", F.lit(1)).withColumn("_gone", F.lit(2)).withColumn("lost_lines", F.lit(3)))
    assert got.columns == ["doc_id", "text", "_doc", "_gone", "lost_lines"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want


def test_rows_of_one_id(spark):
    shared = "a line that several of these documents share word for word"
    check(spark, [(1, shared), (2, f"{shared}\nsecond"), (2, f"UNIQUE LINE OF SECOND ROW\n{shared}"), (2, f"{shared}\nsecond"), (None, shared), (None, shared), (3, None), (4, ""), (5, "\n\n"), (6, "x"), (6, "y"), (7, "x\n" + "z " * 20_000)])


@pytest.mark.parametrize("k", [10, 11, 12])
def test_thue_morse(spark, k):
    t = "a"
    for _ in range(k):
        t += t.translate(str.maketrans("ab", "ba"))
    check(spark, [(1, t), (2, t.translate(str.maketrans("ab", "ba")))])


def test_large_groups(spark, monkeypatch):
    """Lists beyond SHORT, groups cut into blocks, sets beyond FEW."""
    for name, value in (("SHORT", 16), ("FEW", 3), ("GROUP", 10), ("PIVOTS", 2)):
        monkeypatch.setattr(lines, name, value)
    rng = random.Random(5)
    rows = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(30)]
        for i in range(60):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(30)] = f"x{rng.randrange(500)}"
            rows.append((rng.randrange(10_000), " ".join(own) + "\n" + " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))))
    check(spark, rows)


def test_counters_take_distinct_words(spark):
    """Counting each distinct word of a slice once gives what counting every word gives."""
    import numpy as np

    from logquern.llm import common as c
    from logquern.llm import rarity

    df = spark.createDataFrame([("a b a\na c",), ("b",), (None,), ("",)], "text string")

    def distinct(part):
        _, codes, names = c.words(part.column("text"))
        return c.hashes(names), np.bincount(codes, minlength=len(names))

    def every(part):
        _, codes, names = c.words(part.column("text"))
        return c.hashes(names)[codes], None

    got = rarity.counters(df, distinct, 18)
    assert (got == rarity.counters(df, every, 18)).all() and sorted(got[got > 0]) == [1, 2, 3]
