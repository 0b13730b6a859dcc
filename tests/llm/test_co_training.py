"""Co-training against a plain version: which rows of the pool give pseudo-labels, and what the views share."""

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import quality as Q
from quillon.llm.logistic import fit

WIDTH = Q.TEXT_FEATURES + Q.PAGE_FEATURES


def data(n, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, WIDTH))
    truth = r.random(n) < 0.5
    # Either view tells the truth by itself, as co-training supposes, with noise of its own.
    x[:, 0] += np.where(truth, 2, -2)
    x[:, Q.TEXT_FEATURES] += np.where(truth, 2, -2)
    return x.astype(np.float32).astype(np.float64), truth.astype(np.int64)


def plainly(rows, keys, options):
    """The same choice from arrays: most certain bucket first, within it by the key's remainder."""

    def choose(models, gone, share):
        out = [[], []]
        wanted = {0: round(options.per_round * (1 - share)), 1: round(options.per_round * share)}
        for v in (0, 1):
            logits = models[v].logits(rows[:, Q._SIDES[v]])
            for kind in (0, 1):
                able = [i for i in range(len(rows)) if abs(logits[i]) > options.certain and (logits[i] > 0) == kind and keys[i] not in gone[v]]
                able.sort(key=lambda i: (int(np.floor((30 - abs(logits[i])) * Q._STEPS)), keys[i] % (1 << 20), keys[i]))
                out[v] += [(keys[i], kind, rows[i]) for i in able[: wanted[kind]]]
        return out

    return choose


def test_rounds_choose_as_a_plain_version_does(spark):
    options = Q.QualityOptions(per_round=30, rounds=3)
    labelled, good = data(300, 1)
    rows, _ = data(500, 2)
    packed = [(bytearray(x.astype(np.float32).tobytes()),) for x in rows]
    pool = spark.createDataFrame(packed, "features binary").select(F.xxhash64(F.lit(37), "features").alias("key"), "features")
    keys = [r["key"] for r in pool.collect()]
    seen = []

    def both(models, gone, share):
        a, b = Q.choose_from(pool, options)(models, gone, share), plainly(rows, keys, options)(models, gone, share)
        for x, y in zip(a, b):
            assert [(k, kind) for k, kind, _ in x] == [(k, kind) for k, kind, _ in y]
            assert all(np.array_equal(p, q) for (_, _, p), (_, _, q) in zip(x, y))
        seen.append(sum(map(len, a)))
        return a

    views = Q.co_train(labelled, good, both, options)
    assert len(seen) == 3 and all(seen)
    fresh, truth = data(400, 3)
    assert ((views.scores(*(fresh[:, s] for s in Q._SIDES))[2] > 0.5) == truth).mean() > 0.95


def test_many_rows_of_one_bucket_are_bounded(spark):
    options = Q.QualityOptions(per_round=20)
    x, good = data(200, 4)
    models = [fit(x[:, s], good) for s in Q._SIDES]
    strong = np.tile(30 * np.sign(models[0].weights[:-1])[None, :], (3000, 1))
    rows = np.column_stack([strong, np.random.default_rng(5).normal(size=(3000, Q.PAGE_FEATURES))])
    pool = spark.createDataFrame([(i * 7919, bytearray(r.astype(np.float32).tobytes())) for i, r in enumerate(rows)], "key long, features binary")
    chosen = Q.choose_from(pool, options)(models, [set(), set()], 0.5)
    assert sum(kind == 1 for _, kind, _ in chosen[0]) == 10


def test_views_share_no_feature():
    a = Q.text_features(b"Some words here. And more!", np.arange(5, dtype=np.uint64))
    b = Q.text_features(b"Some words here. And more! " * 50, np.tile(np.arange(5, dtype=np.uint64), 50))
    assert len(a) == Q.TEXT_FEATURES and abs(a[0] - b[0]) < 0.01  # shares don't depend on the length
    assert len(Q.page_features(b"x\ny", "en", None, 2)) == Q.PAGE_FEATURES
