"""Each stage of the pipeline against a plain version, on its own input."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from logquern.llm import common as c
from logquern.llm import ngrams, packing, quality, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = c.table(spark, SF, "documents")
    found = [docs]
    for _, stage in cp.STAGES:
        docs = c.stored(stage(spark, docs, SF))
        found.append(docs)
    return found


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_columns_and_whole(spark, stages):
    assert [s.columns for s in stages[:-1]] == [stages[0].columns] * 5 and len(cp.STAGES) == 5
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality", "line dedup", "n-gram join", "packing"]
    own = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert rows(cp.run(spark, SF).select(*own)) == rows(stages[-1].select(*own))


@pytest.mark.parametrize("at,module,bad", [(0, toxicity, lambda s: s >= 0.7), (1, quality, lambda s: s < 0.3)])
def test_classifiers(spark, stages, at, module, bad):
    """Rows that the model's score of the text rejects go, all others stay as they are."""
    model = module.trained(c.table(spark, SF, "documents"), c.table(spark, SF, "labels"))
    before = rows(stages[at])
    texts = pa.array([r[stages[at].columns.index("text")] for r in before])
    want = [r for r, s in zip(before, model.score(texts)) if not bad(s)]
    assert rows(stages[at + 1]) == want and 0 < len(want) <= len(before)


def test_lines(stages):
    before, after = (stages[k].select("doc_id", F.xxhash64("text").alias("h"), "text").collect() for k in (2, 3))
    own = sorted({(r.doc_id, r.h, k, x) for r in before for k, x in enumerate((r.text or "").split("\n"))})
    sets = [frozenset(x.lower().split()) for *_, x in own]
    gone = {own[j][:3] for j in range(len(own)) if sets[j] and any(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for i in range(j))}
    want = []
    for r in before:
        lines = (r.text or "").split("\n")
        left = [x for k, x in enumerate(lines) if (r.doc_id, r.h, k) not in gone]
        if len(left) == len(lines):
            want.append((r.doc_id, r.text))
        elif "".join(left).strip():
            want.append((r.doc_id, "\n".join(left)))
    assert sorted(((r.doc_id, r.text) for r in after), key=str) == sorted(want, key=str)


def test_copies(stages):
    before, after = (sorted((r.doc_id, r.text) for r in stages[k].collect()) for k in (3, 4))
    rule = ngrams.Rule(5, 80, 100)
    grams = [frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))) for w in ((t or "").lower().split() for _, t in before)]
    part = {d: d for d, _ in before}
    for i, (d, _) in enumerate(before):
        for j, (e, _) in enumerate(before[:i]):
            if grams[i] and grams[j] and rule.links(len(grams[i] & grams[j]), len(grams[i]), len(grams[j])):
                low, high = sorted((part[d], part[e]))
                part = {k: low if v == high else v for k, v in part.items()}
    assert after == [(d, t) for d, t in before if part[d] == d]


def test_packing(stages):
    path = packing.default_vocabulary()
    want = set()
    for r in stages[4].collect():
        ids = packing.encode(r.text or "", path)
        first = len(ids) % 2048 or 2048
        want |= {(r.doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip([0, *range(first, len(ids), 2048)], range(first, len(ids) + 1, 2048)))}
    got = stages[5].collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(by) <= 1.05 * -(-sum(r.length for r in got) // 2048) + 1
