"""What tasks hold of a batch stays small, whatever the batch; results are those of the whole."""

import hashlib

import numpy as np
import pyarrow as pa

from quillon.functions import ids
from quillon.operators import grouping, phrases, retrieval

CHUNKS = "chunk_id long, title string, content string"


def test_occurrences_are_handed_on(spark, monkeypatch):
    texts = spark.createDataFrame([(i, "Alpha beta alpha " * i) for i in range(9)], "id long, text string").coalesce(1)
    glossary = spark.createDataFrame([("alpha", "A"), ("beta", "B")], "variant string, canonical string")
    found = lambda: sorted(tuple(r) for r in phrases.find_phrases(texts, "id", "text", glossary).collect())
    want = found()
    monkeypatch.setattr(phrases, "HITS", 2)
    assert found() == want and len(want) == 3 * sum(range(9))


def test_headings_of_few_texts_at_a_time(spark, monkeypatch):
    rows = [(i, None if i == 3 else "# a\n\nx\n\n## b\n\ny" if i % 2 else "") for i in range(7)]
    texts = spark.createDataFrame(rows, "document_id long, text string").coalesce(1)
    blocks = lambda: sorted((r.document_id, r.block_no, tuple(r.heading_path), r.body) for r in grouping.heading_blocks(texts).collect())
    want = blocks()
    monkeypatch.setattr(grouping, "HEADED", 2)
    assert blocks() == want and {r[0] for r in want} == {1, 5}


def test_products_of_few_queries_at_a_time():
    queries, rows = np.random.default_rng(1).normal(size=(300, 4)), np.random.default_rng(2).normal(size=(50, 4))
    got = list(retrieval._products(np.arange(300), queries, rows, 7))
    assert [q for q, _ in got] == list(range(300)) and np.allclose(np.array([s for _, s in got]), queries @ rows.T)
    assert max(s.base.nbytes for _, s in got) <= 7 * 50 * 8


def test_features_of_slices():
    lists = pa.array([["a", "b", "a"], [], None, ["c"]])
    got = np.concatenate([ids._hashed(lists.slice(i, 1), 32) for i in range(4)]).reshape(4, 32)
    want = np.zeros((4, 32))
    for row, features in enumerate(lists.to_pylist()):
        for f in features or ():
            value = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
            want[row, value % 32] += 1.0 if value >> 63 else -1.0
        want[row] /= np.linalg.norm(want[row]) or 1.0
    assert np.array_equal(got, want.astype(np.float32)) and np.array_equal(ids._hashed(lists, 32).reshape(4, 32), got)


def test_a_phrase_is_one_row_of_its_term_and_chunk(spark):
    """Places aren't shuffled one by one: no step of the plan explodes them."""
    chunks = spark.createDataFrame([(1, "a b", "a b a b b a"), (2, "", "b a a"), (3, None, "a a b")], CHUNKS)
    asked = spark.createDataFrame([("q", "a b"), ("q", "a a b"), ("q", "b")], "query_id string, phrase string")
    found = retrieval.phrase_hits(chunks, asked)
    assert sorted((r.phrase, r.chunk_id, r.n) for r in found.collect()) == [("a a b", 3, 1), ("a b", 1, 3), ("a b", 3, 1), ("b", 1, 4), ("b", 2, 1), ("b", 3, 1)]
    assert "explode(concat" not in found._jdf.queryExecution().optimizedPlan().toString()
