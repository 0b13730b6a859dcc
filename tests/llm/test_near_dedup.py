import random

import numpy as np
import pytest

from quillon.llm.near_dedup import NearDedupOptions, drop_near_copies, minhashes, most_odd_bits, near_groups, odd_sketch
from quillon.llm.wordhash import constants, shingle_sets, word_hashes
from tests.llm.helpers import AWKWARD, documents, empty, near_components, shingles, words


def group(n, seed, most=0.3, first=100):
    """Copies of one text, each with its own share of changed words."""
    r = random.Random(seed)
    base = words(120, seed)
    out = []
    for i in range(n):
        share = r.random() * most * 0.2
        out.append((first + i, " ".join(w if r.random() > share else "new%d" % r.randint(0, 10**6) for w in base)))
    return out


def check(spark, rows, options):
    found = {r.doc_id: r for r in near_groups(documents(spark, rows), options).collect()}
    truth = near_components(rows)
    assert {d: r.component_id for d, r in found.items()} == truth
    assert {d: r.kept for d, r in found.items()} == {d: d == c for d, c in truth.items()}
    assert {d: r.n_shingles for d, r in found.items()} == {d: len(shingles(t)) for d, t in rows}


@pytest.mark.parametrize("block", [4, 128])
def test_components_are_those_of_brute_force(spark, block):
    rows = [*AWKWARD, *group(60, 1, 0.5), *group(25, 2, 0.2, 300), *group(6, 3, 0.05, 400)]
    rows += [(500 + i, " ".join(words(80, 50 + i))) for i in range(10)]
    check(spark, rows, NearDedupOptions(block=block))


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g")]
    found = near_groups(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_groups(empty(spark)).collect() == []
    nothing = near_groups(documents(spark, [(None, "a b"), (3, None)])).collect()
    assert {(r.doc_id, r.component_id) for r in nothing} == {(None, None), (3, 3)}


def test_dropping_carries_other_columns(spark):
    docs = documents(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words here")])
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_word_hashes_follow_words():
    r = random.Random(3)
    texts = ["".join(r.choice("abC \n\té") for _ in range(r.randint(0, 40))).encode() for _ in range(500)]
    hashes, at = word_hashes(texts)
    seen: dict = {}
    for i, text in enumerate(texts):
        found = text.lower().split()
        own = hashes[at[i] : at[i + 1]].tolist()
        assert len(found) == len(own)
        for word, h in zip(found, own):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_sketches_keep_similar_pairs():
    """No pair at the threshold may be screened out."""
    options = NearDedupOptions()
    f, t = constants(options.samples, 11), constants(options.samples, 13)
    worst = 0
    for seed in range(60):
        rng = np.random.default_rng(seed)
        values = rng.integers(0, 2**63, 700, dtype=np.uint64)
        a, b = values[:600], values[86:686]  # 514 of 686: similarity 0.749
        x, y = (odd_sketch(minhashes(v, f, t), options.sketch_bits) for v in (a, b))
        worst = max(worst, int(np.bitwise_count((x ^ y).view(np.uint64)).sum()))
    assert worst <= most_odd_bits(options) < options.sketch_bits // 2


def test_shingle_sets_of_short_texts():
    sets = list(shingle_sets([b"", b"a", b"a b", b"b a", b"a b c d e", b"A B C D E"]))
    assert [len(s) for s in sets] == [0, 1, 1, 1, 1, 1]
    assert len({s.tobytes() for s in sets[1:5]}) == 4
    assert sets[4].tobytes() == sets[5].tobytes()
