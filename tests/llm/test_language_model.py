"""The backoff automaton against a plain bigram model that walks states one by one."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quillon.llm.exchange import coded, cuts, decoded, summed
from quillon.llm.language_model import ModelOptions, language_scores
from tests.llm.helpers import AWKWARD, documents, empty, words

START, END = object(), object()


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def plain(rows):
    """What each document must score, state by state: an arc where training holds the bigram, else failure and root."""
    role = [zlib.crc32(str(r[0]).encode()) % 7 if r[0] is not None else None for r in rows]
    training = [tokens(r[1]) for r, x in zip(rows, role, strict=True) if x not in (2, None)]
    count = Counter(w for t in training for w in t)
    pairs = Counter(p for t in training for p in zip([START, *t], t, strict=False))
    n, v = sum(count.values()), len(count)
    share = 1 - (sum(c == 1 for c in pairs.values()) + 1) / (sum(pairs.values()) + 1)
    times = count | {START: len(training)}
    out = []
    for r, x in zip(rows, role, strict=True):
        state, score, base = START, 0.0, 0.0
        for w in tokens(r[1]):
            p = (count[w] + 1) / (n + v + 1)
            base += math.log10(p)
            if pairs[state, w]:
                score += math.log10(share * pairs[state, w] / times[state] + (1 - share) * p)
            else:
                score += (math.log10(1 - share) if times.get(state) else 0.0) + math.log10(p)
            state = w
        t = tokens(r[1])
        out.append((r[0], x == 2, len(t), sum(count[w] > 0 for w in t), n, base, score))
    return sorted(out, key=str)


def same(found, want):
    found = sorted((tuple(r) for r in found), key=str)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    for a, b in zip(found, want, strict=True):
        assert a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])


def corpus():
    common = words(40, 1)
    rows = [(i, " ".join(common[(i * j) % 40] if j % 3 else common[j % 40].upper() for j in range(i % 23))) for i in range(120)]
    rows += [(500 + i, r[1]) for i, r in enumerate(rows[:20])] + [(200, None), (201, "never seen before"), (None, "null id"), (7, "a repeated id")]
    return rows + [(1000 + i, t) for i, t in AWKWARD]


@pytest.mark.parametrize("options", [ModelOptions(), ModelOptions(block_tokens=50, range_keys=20)])
def test_scores_are_those_of_a_plain_model(spark, options):
    rows = corpus()
    same(language_scores(documents(spark, rows), options).collect(), plain(rows))


def test_edges(spark):
    assert language_scores(empty(spark)).collect() == []
    rows = [(None, "a b"), (None, None)]  # nothing trains
    same(language_scores(documents(spark, rows)).collect(), plain(rows))


def test_coded_numbers_come_back():
    r = np.random.default_rng(5)
    for n in (0, 1, 7, 1000):
        keys = np.unique(r.integers(0, 1 << 56, n, dtype=np.uint64))
        assert (decoded(coded(keys, ascending=True), ascending=True) == keys).all()
        small = r.integers(0, 300, n).astype(np.uint64)
        assert (decoded(coded(small)) == small).all()
        at = cuts(keys, 5, 56)
        assert at[0] == 0 and at[-1] == len(keys) and all(int(k) * 5 >> 56 == i for i in range(5) for k in keys[at[i] : at[i + 1]])
    kinds, sums, places = summed([np.array([3, 5], dtype=np.uint64), np.array([5], dtype=np.uint64)], [np.array([1, 2]), np.array([4])])
    assert kinds.tolist() == [3, 5] and sums.tolist() == [1, 6] and [p.tolist() for p in places] == [[0, 1], [1]]


def test_held_out_texts_are_likelier_than_by_their_words_alone(spark, sf):
    held = [r for r in language_scores(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.held_out]
    assert len(held) > 10 and sum(r.score for r in held) > sum(r.base_score for r in held)
