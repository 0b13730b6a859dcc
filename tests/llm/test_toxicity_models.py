"""Toxicity: expressions of any rarity count, and the models are Kneser-Ney."""

import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from quillon.llm.toxicity import Models, ToxicityOptions, learn, toxicity
from quillon.llm.wordhash import word_hashes
from tests.llm.test_learned import toxic_corpus


def test_rare_words_are_evidence(spark):
    """Each of the bad words stands fewer than 30 times in the training rows."""
    docs, labels, truth = toxic_corpus(spark, 240)
    training = [r.text.split() for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    assert all(sum(t.count(w) for t in training) < 30 for w in ("blorgh", "snarfle", "wuzzock"))
    held = [r for r in toxicity(docs, labels).collect() if r.held_out]
    bad = [r.score for r in held if truth[r.doc_id]]
    plain = [r.score for r in held if not truth[r.doc_id]]
    above = sum(a > b for a in bad for b in plain) / (len(bad) * len(plain))
    assert above >= 0.95


def test_probabilities_of_a_history_are_kneser_ney(spark):
    texts = [("a b a c", 0), ("b a b b d", 0), ("a b e", 1), ("e e a b", 1), ("c", 1)]
    training = spark.createDataFrame(texts, "text string, __label int")
    options = ToxicityOptions()
    evidence, shares = learn(training, options)
    models = Models.of(evidence.toArrow(), shares)
    pairs = [Counter(), Counter()]
    for text, c in texts:
        found = text.split()
        pairs[c].update(zip(["", *found], found))
    vocabulary, both = sorted({w for text, _ in texts for w in text.split()}), set(pairs[0]) | set(pairs[1])
    d = options.discount
    for h in ["", *vocabulary]:
        total = np.zeros(2)
        for w in vocabulary:
            code = word_hashes([f"{h} {w}".strip().encode()])[0]
            got = models.probabilities(code)[0][:, -1]
            for c in (0, 1):
                n = sum(pairs[c].values())
                of_word = sum(v for (_, x), v in pairs[c].items() if x == w)
                kinds = len({x for _, x in pairs[c]})
                single = max(of_word - d, 0) / n + d * kinds / n * sum(x == w for _, x in both) / len(both)
                after = {x: v for (y, x), v in pairs[c].items() if y == h}
                size = sum(after.values())
                want = max(after.get(w, 0) - d, 0) / size + d * len(after) / size * single if size else single
                assert got[c] == pytest.approx(want)
            total += got
        assert total == pytest.approx([1, 1])


def test_histories_are_counted_without_limit(spark):
    """One word after 1,000 different ones: all of them count."""
    training = spark.createDataFrame([(f"h{i} common", i % 2) for i in range(1000)], "text string, __label int")
    evidence, shares = learn(training, ToxicityOptions())
    models = Models.of(evidence.toArrow(), shares)
    assert models.more[0].max() == 1000 and shares.pairs == 2000


def test_disk_holds_one_step_at_a_time(spark, tmp_path, monkeypatch):
    """What is left beside the features of texts doesn't grow with words and pairs: they would take several times the texts."""
    docs, labels, _ = toxic_corpus(spark, 240)
    monkeypatch.setattr("quillon.llm.common.shared_dir", lambda spark: f"file://{tmp_path}")
    n = len(toxicity(docs, labels).collect())
    rows = {d.name: sum(pq.read_metadata(f).num_rows for f in d.glob("*.parquet")) for d in tmp_path.iterdir()}
    left = [name for name, k in rows.items() if k]
    assert len(rows) > 1 and len(left) == 1 and "features" in left[0] and rows[left[0]] >= n


def test_blocks_of_any_size_give_the_same_scores(spark):
    docs, labels, _ = toxic_corpus(spark, 120)
    runs = [ToxicityOptions(), ToxicityOptions(block_words=50, range_bytes=500, turns=3), ToxicityOptions(block_words=700, reread=False)]
    scores = [{r.doc_id: r.score for r in toxicity(docs, labels, o).collect()} for o in runs]
    assert scores[1] == pytest.approx(scores[0]) and scores[2] == pytest.approx(scores[0])
