"""Quality, toxicity and personal data: held-out accuracy and brute force."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.llm import pii
from quillon.llm.pii import KINDS, fit, luhn, redact, rule_spans, span_report
from quillon.llm.quality import drop_low_quality, score_quality
from quillon.llm.toxicity import ToxicityOptions, toxicity
from tests.llm.helpers import AWKWARD, documents, empty, words

BIG = "/root/testdata/sf0.1"


def test_quality_on_kept_aside_labels(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    train, test = (labels.filter(f"doc_id % 2 = {k}") for k in (0, 1))
    got = score_quality(docs, train).join(test, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n[1, True] >= 0.99 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.95 * (n[0, False] + n.get((0, True), 0))


def test_quality_edges(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (None, 1), (6, None)], "doc_id long, quality int")
    docs = documents(spark, [*AWKWARD, (None, "x"), (1, None)])
    got = score_quality(docs, labels).collect()
    assert len(got) == len(AWKWARD) + 2 and all(0 <= r.score <= 1 for r in got)
    assert drop_low_quality(docs, labels).columns == docs.columns
    assert score_quality(empty(spark), labels).collect() == []
    none = score_quality(docs, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.5}


def toxic_corpus(spark, n=900):
    r = random.Random(8)
    plain, bad = words(400, 3), ["blorgh", "snarfle", "wuzzock"]
    rows, labels = [], []
    for i in range(n):
        text = [r.choice(plain) for _ in range(r.randint(20, 80))]
        toxic = int(r.random() < 0.2)
        for _ in range(r.randint(1, 3) * toxic):
            text.insert(r.randint(0, len(text)), r.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_on_the_held_out_fold(spark):
    docs, labels, truth = toxic_corpus(spark)
    got = toxicity(docs, labels, ToxicityOptions()).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right >= 0.97 * len(held)


def test_held_out_labels_and_metadata_are_never_used(spark):
    docs, labels, _ = toxic_corpus(spark, 300)
    wrong = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    options = ToxicityOptions()
    scores = lambda d, y: [r.score for r in sorted(toxicity(d, y, options).collect(), key=lambda r: r.doc_id)]
    changed = docs.withColumns({"lang": F.lit("zz"), "source": F.col("doc_id").cast("string")})
    assert scores(docs, labels) == pytest.approx(scores(changed, wrong))


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(0, 1), (2, None), (7, 5), (None, 1)], "doc_id long, toxic int")
    got = toxicity(documents(spark, [*AWKWARD, (None, "a"), (1, "again")]), labels).collect()
    assert len(got) == len(AWKWARD) + 2 and len({round(r.score, 9) for r in got}) == 1
    assert toxicity(empty(spark), labels).collect() == []


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def by_rules(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(RULES[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_rules_are_the_plain_patterns():
    r = random.Random(2)
    for _ in range(20_000):
        text = "".join(r.choice("a@.-+1 20(5)é%\n") for _ in range(r.randint(0, 40)))
        assert rule_spans(text) == by_rules(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 60_000, "a" * 60_000, "1." * 30_000, "a@" * 30_000, "+1" * 30_000, "1 " * 30_000):
        rule_spans(text)


def test_model_adds_other_shapes_and_keeps_the_rules(spark):
    rows = [
        *AWKWARD, (20, "call 555-123-4567 now"), (21, "card 4111.1111.1111.1111"), (22, "bob (at) mail [dot] com"), (23, "on 2024-05-06, v1.2.3"),
        (24, "me@x.org from 10.0.0.1 +1 (988) 555-2485"), (25, "serial 123456789012 and token 1beb58b8af68854f0e01b4ad40cdbb6ae7f5"),
    ]
    got = {r.doc_id: r for r in span_report(documents(spark, rows)).collect()}
    assert got[20].spans == "phone:5:17" and got[21].spans == "card:5:24" and got[22].spans.startswith("email:0:")
    assert got[23].spans == got[25].spans == "" and got[24].spans == "email:0:8,ip:14:22,phone:23:40"
    import hashlib

    for d, text in rows:
        base = by_rules(text or "")
        assert got[d].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in KINDS] == [sum(x[0] == k for x in base) for k in KINDS]
    assert span_report(empty(spark)).collect() == []
    clean = {r.doc_id: r.text for r in redact(documents(spark, rows)).collect()}
    assert clean[24] == "[email] from [ip] [phone]" and clean[1] is None


def test_fitting_is_repeatable():
    a, b = fit(), fit()
    assert (a.spans == b.spans).all() and (a.outside == b.outside).all()


def test_whole_texts_take_linear_time():
    import time

    model = fit()
    r = random.Random(1)
    base64 = "".join(r.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(300_000))
    for text in ("a" * 1_000_000 + "1", "1" * 1_000_000, "x" * 20_000 + "@", base64, "me@x.org " * 30_000, "(at) " * 50_000, "a (at) " * 50_000):
        began = time.time()
        pii.all_spans(text, model, 20)
        assert time.time() - began < 20, text[:10]


def test_decoding_is_the_best_of_all_segmentations():
    model, r = fit(), random.Random(3)

    def best(x, at):
        """By trying every way to go on from a boundary."""
        if at == x.n:
            return 0.0
        inside, outside = model.scores(x)
        ways = [outside[at] + best(x, at + 1)]
        ways += [inside[e].max() + best(x, j) for e, (i, j) in enumerate(x.edges) if i == at]
        return max(ways)

    for _ in range(40):
        text = "".join(r.choice(["12", "345", "6789", "-", " ", ".", "(", ")", "+", "ab", "@"]) for _ in range(11))
        for island in pii.islands(text):
            x = pii.lattice(text, *island, 20)
            if not x.edges:
                continue
            inside, outside = model.scores(x)
            chosen = {(a, b): KINDS.index(k) for k, a, b in model.decode(x)}
            covered, score = set(), 0.0
            for e, place in enumerate(x.places):
                if place in chosen:
                    score += inside[e, chosen[place]]
                    covered |= set(range(*x.edges[e]))
            score += sum(outside[t] for t in range(x.n) if t not in covered)
            assert score == pytest.approx(best(x, 0)), text


def test_entities_drawn_anew():
    """Entities and others drawn anew: how many are found whole, and how many others are left alone."""
    model, r = fit(), random.Random(99)
    found = {k: 0 for k in KINDS}
    for k in KINDS:
        for _ in range(200):
            piece = pii._entity(r, k)
            text = f"please see {piece} for more"
            found[k] += (k, 11, 11 + len(piece)) in pii.all_spans(text, model, 20)[1]
    left = sum(not pii.all_spans(f"please see {pii._other(r)} for more", model, 20)[1] for _ in range(600))
    assert all(n >= 180 for n in found.values()) and left >= 570, (found, left)
