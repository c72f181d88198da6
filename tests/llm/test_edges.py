"""Every operator on nulls in any column, empty and very long texts, ties and repeated rows, empty tables and extra columns
with clashing names."""

import pytest

from logquern.llm import registry

QUERIES = registry.queries()
LONG = "x" * 20_000
ROWS = [
    (1, "the quick brown fox\njumps over the lazy dog\n\nthe quick brown fox", "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t ", None, "b", 4),
    (5, LONG, "de", "b", 20_000),
    (6, " ".join(f"w{i}" for i in range(8_000)), "de", None, 1),
    (7, "the quick brown fox\njumps over the lazy dog\n\nthe quick brown fox", "en", "a", 5),
    (7, "the quick brown fox\njumps over the lazy dog\n\nthe quick brown fox", "en", "a", 5),
    (None, "no id here at all", "en", "a", 1),
    (9, "ünï cödé 😀 ▁ <|endoftext|> \x85 ok", "fr", "c", 1),
    (10, "12 34 !!", "fr", "c", 1),
    (11, "you idiot", "en", "c", 1),
    (12, "one row of this id", "en", "c", 1),
    (12, "another text under the same id, not like it", "en", "c", 1),
    (None, "the quick brown fox\njumps over the lazy dog\n\nthe quick brown fox", "en", "a", 5),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, labels, vectors):
    d = spark.createDataFrame(docs, DOCS)
    for clash in ("score", "pid", "id", "data", "word", "held", "sequence_id", "_doc", "_gone", "bit", "extra", "line", "check", "head", "place", "kind", "block", "y", "h"):
        d = d.selectExpr("*", f"'x' AS {clash}")
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    vectors = [(0, [0.5, -0.25], 1), (50, [0.5, -0.25], 1), (50, [0.5, -0.25], 1), (3, None, 1), (4, [None, 1.0], None), (5, [float("nan"), 1.0], 1), (None, [1.0, 1.0], 1), (7, [1.0], 1), (8, [-0.1, 0.3], 1), (9, [], 1)]
    labels = [(i, i % 2, int(i == 11)) for i in range(1, 12)] + [(2, None, None), (None, 1, 1), (1, 1, 1)]
    return write(spark, tmp_path_factory.mktemp("odd"), ROWS, labels, vectors)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [])


@pytest.mark.parametrize("name", QUERIES)
def test_empty(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op9_topk", "op6_packing")])
def test_odd(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in rows)
    want = sorted((r[0] if r[0] is not None else -1) for r in ROWS)
    assert ids == want
    by = {r.doc_id: r for r in rows}
    if hasattr(rows[0], "score") and name != "op2_mixing":
        assert all(0 <= r.score <= 1 for r in rows)
    if name == "op1_language":
        assert by[2].lang_pred == by[3].lang_pred == by[10].lang_pred == "und" and by[1].lang_pred != "und"
    if name == "op2_mixing":
        assert by[2].n_tokens == 1 and by[1].n_tokens == 14 and all(r.score < 0 for r in rows)
    if name == "op3_pieces":
        assert all(r.round_trip for r in rows) and by[2].ids is None and by[3].ids == []
    if name == "op5_ngrams":
        assert (by[1].component_id, by[7].component_id, by[2].n_shingles, by[3].component_id) == (1, 1, 0, 3)
        assert all(r.component_id is None for r in rows if r.doc_id is None)
    if name == "op7_syncmers":
        assert by[1].fingerprint == by[7].fingerprint and by[3].fingerprint == "" and by[2].near_next == 1.0
    if name == "op8_lines":
        assert by[1].text == "the quick brown fox\njumps over the lazy dog\n" and by[7].text == "" and by[2].text is None


def test_packing(spark, odd):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op6_packing"](spark, odd).collect()
    import numpy as np

    pieces = {}
    for d, text in {(r[0], r[1] or "") for r in ROWS}:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        for i, (a, b) in enumerate(zip([0, *range(first, len(ids), 2048)], range(first, len(ids) + 1, 2048))):
            pieces[d, i, a, b - a, zlib.crc32(ids[a:b].tobytes())] = 1
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == set(pieces)
    assert len(rows) == len(pieces) + 1  # the repeated row
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == -(-sum(r.length for r in rows) // 2048)


def test_top_k(spark, odd):
    rows = [tuple(r) for r in QUERIES["op9_topk"](spark, odd).orderBy("query_id", "rank").collect()]
    same, other = 128 * 128 + 64 * 64, 128 * -26 + -64 * 76
    assert rows == [(0, 1, 50, same), (0, 2, 50, same), (0, 3, 8, other), (50, 1, 0, same), (50, 2, 0, same), (50, 3, 8, other), (50, 4, 8, other)]


def test_pipeline(spark, odd, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).collect() == []
    rows = corpus_pipeline.run(spark, odd).collect()
    assert {r.doc_id for r in rows} <= {r[0] for r in ROWS} and all(0 < r.length <= 2048 for r in rows)
