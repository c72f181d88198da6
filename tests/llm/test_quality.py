"""The field's marginals against all labellings, and weights by length."""

import itertools

import numpy as np
import pyarrow as pa

from logquern.llm import quality as q


def test_marginals():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 2, 5, 9]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    e, t = rng.standard_normal(offsets[-1]) * 2, rng.standard_normal((2, 2))
    f, b = q.messages(offsets, e, t)
    got = 1 / (1 + np.exp(-(f + b)))
    for a, z in zip(offsets, offsets[1:]):
        total, good = 0.0, np.zeros(z - a)
        for labels in itertools.product([0, 1], repeat=z - a):
            weight = np.exp(sum(e[a + i] * x for i, x in enumerate(labels)) + sum(t[x, y] for x, y in zip(labels, labels[1:])))
            total += weight
            good += weight * np.array(labels)
        assert np.allclose(got[a:z], good / total)


def test_weight_by_length():
    rng = np.random.default_rng(1)
    model = q.Model(rng.standard_normal(q.WIDTH).astype(np.float32), rng.standard_normal((2, 2)), (1.3, -0.2), 0.4)
    texts = pa.array(["a line\n\n#### $$$ ||||\nthe third line is longer than the others", "", None, " \n ", "one"])
    offsets, size, p = model.line_marginals(texts)
    for i, text in enumerate(texts.to_pylist()):
        lines = [x for x in (text or "").split("\n") if x.strip()]
        assert offsets[i + 1] - offsets[i] == len(lines)
        if lines:
            own = slice(offsets[i], offsets[i + 1])
            assert size[own].tolist() == [len(x.encode()) for x in lines]
            mean = (p[own] * size[own]).sum() / size[own].sum()
            assert np.isclose(model.score(texts)[i], 1 / (1 + np.exp(-(1.3 * np.log(mean / (1 - mean)) - 0.2))))
        else:
            assert model.score(texts)[i] == 0.4
