"""Likeness of very long repetitive texts and of short ones."""

import numpy as np
import pytest

from logquern.llm import fingerprints as f


@pytest.mark.parametrize("text", ["x" * 300_000, "lorem " * 400_000])
def test_repetitive(text):
    one, other = f.anchors([text]), f.anchors([text[:60]])
    assert f.likeness(one, one).tolist() == [1.0]
    both = min(len(one[1]), len(other[1]))
    for a, b in ((one, other), (other, one)):
        assert 0 <= f.likeness(a, b)[0] <= 2 * both / (len(one[1]) + len(other[1]))


def test_brute():
    """Equal marks are matched i-th with i-th, and places that are too far apart don't count."""
    rng = np.random.default_rng(0)

    def draw():
        n = rng.integers(0, 30, 50)
        return np.concatenate([[0], np.cumsum(n)]), np.concatenate([np.sort(rng.integers(0, 500, k)) for k in n]), rng.integers(0, 4, n.sum()), np.full(50, 500)

    a, b = draw(), draw()
    for i, got in enumerate(f.likeness(a, b)):
        (pa, ma), (pb, mb) = ((x[1][x[0][i] : x[0][i + 1]], x[2][x[0][i] : x[0][i + 1]]) for x in (a, b))
        both = sum(abs(p - q) <= 125 for m in range(4) for p, q in zip(pa[ma == m], pb[mb == m]))
        assert got == pytest.approx(2 * both / (len(pa) + len(pb)) if len(pa) + len(pb) else 1.0)


def test_short():
    """Of a short text, the edited one is nearer than the next one, down to two code points."""
    rng = np.random.default_rng(0)
    texts = ["".join(map(chr, rng.integers(97, 123, n))) for n in range(2, 160) for _ in range(3)]
    after = texts[1:] + texts[:1]
    near = lambda others: f.likeness(f.anchors(texts), f.anchors(others))
    changed = near([f.edited(t, u) for t, u in zip(texts, after)])
    fair = np.array([t[0] != u[0] for t, u in zip(texts, after)])  # two letters can't tell when the first is shared
    assert (changed[fair] > near(after)[fair]).all() and np.median(changed) > 0.4


def test_scattered():
    """A near copy with a change every 48 code points has a likeness; another text hasn't."""
    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(97, 123, 2_000)))
    copy = "".join("#" if i % 48 == 47 else x for i, x in enumerate(text))
    assert f.likeness(f.anchors([text]), f.anchors([copy]))[0] > 0.5
    assert f.likeness(f.anchors([text]), f.anchors([text[::-1]]))[0] < 0.05
