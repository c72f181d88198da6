"""The counterfactual penalty: swapped terms score alike, neutral mentions aren't flagged."""

import random

from logquern.llm import toxicity as t


def test_swaps(spark):
    """Insults that mention one group only, in the labelled texts."""
    rng = random.Random(0)
    words = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(1200):
        text = [rng.choice(words) for _ in range(12)]
        bad = i % 3 == 0
        if bad:
            text[3:3] = ["stupid", "idiots"]
            if rng.random() < 0.9:
                text[5:5] = ["those", "muslims"]
        elif rng.random() < 0.3:
            text[5:5] = ["some", rng.choice(["christians", "hindus", "jews"])]
        rows.append((i, " ".join(text) + ". " + rng.choice(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, y long")
    model = t.train(df)
    import pyarrow as pa

    def score(text):
        return float(model.score(pa.array([text]))[0])

    for sentence in ("the {} of our street met for tea", "word1 word2 {} word3"):
        scores = [score(sentence.format(w)) for w in ("muslims", "christians", "jews", "hindus", "sikhs")]
        assert max(scores) - min(scores) < 0.02 and max(scores) < t.THRESHOLD
    assert score("those stupid idiots word1 word2") >= t.THRESHOLD
    plain = t.fit.__globals__["FAIR"]
    t.FAIR = 0.0
    try:
        without = t.train(df)
    finally:
        t.FAIR = plain
    gap = lambda m: abs(float(m.score(pa.array(["word1 muslims word2"]))[0]) - float(m.score(pa.array(["word1 jews word2"]))[0]))
    assert gap(without) > 5 * gap(model)


def test_sentences():
    one, other = t.counterfactuals(["The muslims came. Nobody else did! A woman, too", "nothing"])
    assert one == ["The muslims came", " A woman, too"] and all(a.lower().split() != b.split() for a, b in zip(one, other))
    assert t.swapped("The muslims came") == t.swapped("The muslims came") and t.swapped("none here") is None


def test_features_stay_packed():
    """The driver holds the features of the labelled texts as arrays: no Python number for each."""
    import pyarrow as pa

    index = {"a": 0, "b": 1, "stup*": 2}
    got = t.feature_lists(["b a b", "", "stupid"], index)
    assert isinstance(got, pa.ListArray) and got.type.value_type == pa.int32() and got.to_pylist() == [[0, 1], [], [2]]
