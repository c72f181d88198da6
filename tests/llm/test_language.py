"""The forward sum and the expected counts against all segmentations."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from logquern.llm import language as l


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    import base64

    file = tmp_path_factory.mktemp("v") / "v.tiktoken"
    words = [bytes([i]) for i in range(256)] + [b"ab", b"bc", b" a", b"abc", b"cab", b" abcabcabcabcab", b"bcabcabcabcabcabca"]
    file.write_text("".join(f"{base64.b64encode(w).decode()} {i}\n" for i, w in enumerate(words)))
    return l.Pieces(str(file)), words


def segmentations(word, words):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        edges = [0, *(i + 1 for i, x in enumerate(cuts) if x), len(word)]
        parts = [word[a:b] for a, b in zip(edges, edges[1:])]
        if all(p in words for p in parts):
            yield parts


def test_all_segmentations(small):
    found, words = small
    place = {w: i for k in found.lengths for i, w in zip(range(10**6), [])}
    texts = ["abc", "cab", "abcabcabcabcab", "x", "bcabcabcabcabcabca"]
    rng = np.random.default_rng(0)
    prob = rng.random((found.size + 1, 2)) / 100
    prob[-1] = 0
    ordered = [w for k in found.lengths for w in words if len(w) == k]
    place = {w: i for i, w in enumerate(ordered)}
    offsets, ids = l.lattice(found, pa.array(texts))
    got, counts = l.forward(offsets, ids, prob), l.expected(offsets, ids, prob, np.ones((len(texts), 2)))
    want = np.zeros_like(prob)
    for i, text in enumerate(texts):
        total, share = np.zeros(2), np.zeros_like(prob)
        for parts in segmentations(f" {text}".encode(), set(words)):
            p = np.prod([prob[place[x]] for x in parts], axis=0)
            total += p
            for x in parts:
                share[place[x]] += p
        assert np.allclose(got[i], np.log(total))
        want += share / total
    assert np.allclose(counts, want, atol=1e-9)


def test_long_words(spark):
    """A language whose texts are one long word each is learned, and long words don't run out of range."""
    rng = np.random.default_rng(0)
    a = ["".join(rng.choice(list("\u3042\u3044\u3046\u3048\u304a"), 300)) for _ in range(40)]
    b = [" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(30)) for _ in range(40)]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(x, "jj") for x in a] + [(x, "ll") for x in b])]
    model = l.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), l.default_vocabulary())
    assert model.langs == ["jj", "ll"]
    langs, scores = model.predict(pa.array([*a[:3], *b[:3], "\u3042" * 5_000, "", "12", None]))
    assert langs == ["jj"] * 3 + ["ll"] * 3 + ["jj", "und", "und", "und"] and all(0 <= s <= 1 for s in scores)
