"""Fingerprints, licence scans, mixing and exact deduplication against brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm.exact_dedup import ExactDedupOptions, drop_exact_copies, exact_groups
from quillon.llm.fingerprints import fingerprint_report, within_radius
from quillon.llm.license_scan import TEMPLATES, scan_licenses
from quillon.llm.mixing import MixOptions, apply_mix, mix
from tests.llm.helpers import AWKWARD, documents, empty, words


# --- Exact deduplication ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("heavy", [2, 32])
def test_exact_groups(spark, heavy):
    rows = [*AWKWARD, *[(100 + i, "same text here") for i in range(50)], *[(200 + i, "same  text\nhere") for i in range(3)]]
    got = exact_groups(documents(spark, rows), ExactDedupOptions(heavy_rows=heavy)).collect()
    norm = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for d, t in rows}
    groups: dict = {}
    for d, t in norm.items():
        groups.setdefault(t, []).append(d)
    assert len(got) == len(rows)
    for r in got:
        same = groups[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (min(same), len(same), r.doc_id == min(same))
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()


def test_exact_edges(spark):
    docs = documents(spark, [(1, "a"), (1, "a"), (None, "a"), (None, None), (2, "b")])
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect() if r.text) == [(1, "a"), (2, "b")]
    assert exact_groups(empty(spark)).count() == 0 and drop_exact_copies(empty(spark)).count() == 0
    assert sum(r.kept for r in exact_groups(docs).collect()) == 3


# --- Mixing ----------------------------------------------------------------------------------------------------------


def targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: float(1 + i % 3) for i, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mix_meets_targets(spark):
    rows = [(i, " ".join(words(1 + i % 40, i)), f"s{i % 7}" if i % 11 else None) for i in range(600)]
    rows += [(1000, "one two", "tiny"), (1001, None, "void"), (1002, "", "s1")]
    got = mix(documents(spark, rows)).collect()
    sizes: dict = {}
    for d, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    taken: dict = {}
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.size <= 0 or r.taken % r.size == 0 and r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 40, (s, taken[s], t)
    again = mix(documents(spark, rows[::-1]).repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_larger_budgets_take_supersets(spark):
    rows = [(i, " ".join(words(5 + i % 9, i)), "ab"[i % 2]) for i in range(200)]
    docs = documents(spark, rows)
    small, large = ({r.doc_id for r in mix(docs, MixOptions(share=s, weights=(1.0,))).collect() if r.taken} for s in (0.2, 0.6))
    assert small < large


def test_applied_mix_repeats_rows(spark):
    rows = [(1, "a b c", "x"), (2, "a " * 90, "y"), (3, None, "x")]
    docs = documents(spark, rows)
    plan = {r.doc_id: r.repeats for r in mix(docs).collect()}
    got = [r.doc_id for r in apply_mix(docs).collect()]
    assert {d: got.count(d) for d in plan} == plan and plan[3] == 0
    assert apply_mix(empty(spark)).collect() == [] and mix(empty(spark)).collect() == []


# --- Fingerprints ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_edited_texts_and_neighbours(spark, buckets):
    from quillon.llm.fingerprints import fingerprint_edits

    rows = [*AWKWARD, (40, " ".join(words(60, 1))), (50, " ".join(words(60, 1))), (1000, "last é one 😀")]
    got = {r.doc_id: r for r in fingerprint_edits(documents(spark, rows).repartition(3), buckets).collect()}
    ordered = sorted(rows)
    assert len(got) == len(rows)
    for (d, text), (e, after) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[d].n_chars == len(text)
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), d
        odd = lambda a, b, c, f: bin((a ^ c) & (2**64 - 1)).count("1") + bin((b ^ f) & (2**64 - 1)).count("1")
        assert got[d].near_next == 1 - odd(got[d].high, got[d].low, got[e].high, got[e].low) / 128
    assert (got[40].high, got[40].low) == (got[50].high, got[50].low) and got[1].high == got[2].high == 0


def test_simhash_votes_by_hand(spark):
    from quillon.llm.fingerprints import simhash

    text = "alpha beta beta gamma alphabet " + " ".join(words(30, 9))
    df = spark.createDataFrame([(1, text)], "k int, body string")
    got = simhash(df, ["k"], "body").first()
    hashed = spark.createDataFrame([(w,) for w in text.split()], "w string").select("w", F.xxhash64("w").alias("h"), F.xxhash64(F.lit(1), "w").alias("l")).collect()
    for name, column in (("fp_high", "h"), ("fp_low", "l")):
        want = 0
        for bit in range(64):
            if sum(len(r.w) * (1 if (r[column] >> bit) & 1 else -1) for r in hashed) > 0:
                want |= 1 << bit
        assert got[name] & (2**64 - 1) == want


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_search_finds_all_within_the_radius(spark, radius):
    import random

    r = random.Random(4)
    base = [(r.getrandbits(64), r.getrandbits(64)) for _ in range(12)]
    prints = []
    for high, low in base:
        for _ in range(15):
            flip = sum(1 << b for b in r.sample(range(128), r.randint(0, 8)))
            prints.append((high ^ (flip >> 64), low ^ (flip & (2**64 - 1))))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in prints], "high long, low long")
    got = {(x.high, x.low): x.n_within for x in within_radius(df, df, radius).collect()}
    for a, b in prints:
        near = sum(bin(a ^ c).count("1") + bin(b ^ d).count("1") <= radius for c, d in prints)
        assert got[signed(a), signed(b)] == near


def test_fingerprint_report_counts_neighbours(spark):
    rows = [(100, "the same text of several words"), (101, "the same text of several words"), (200, "quite different words stand here")]
    got = {r.doc_id: r for r in fingerprint_report(documents(spark, rows)).collect()}
    assert (got[100].n_near, got[101].n_near, got[200].n_near) == (1, None, 0)
    assert got[100].fingerprint == got[101].fingerprint and len(got[100].fingerprint) == 32
    assert fingerprint_report(empty(spark)).collect() == []


# --- Licences --------------------------------------------------------------------------------------------------------


def by_hand(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    at = [(i, label) for p, label in phrases.items() for i in range(len(found)) if found[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(found), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_licence_phrases(spark):
    mit = next(t for t, label in TEMPLATES.items() if label == "mit")
    gapped = " ".join(w for i, w in enumerate(mit.split()) if i not in (12, 25))
    rows = [
        *AWKWARD, (20, "It is Under the MIT-License. under the mit license"), (21, "Apache License, Version 2.0 and CC BY-NC 4"), (22, "cc by nc by nc cc by nc"),
        (23, f"Intro {mit.upper()} end"), (24, f"x {gapped} y"), (25, "under the mit apache license"), (26, "éunder the mit license"), (27, ", under the mit license,"),
    ]
    got = {r.doc_id: r for r in scan_licenses(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for d, text in rows:
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == by_hand(text), d
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[23].labels == got[24].labels == "mit" and got[23].base_labels == "" and got[23].score == 1.0
    assert got[25].labels == "" and scan_licenses(empty(spark)).collect() == []


def test_null_ids_come_first_and_follow_the_last(spark):
    from quillon.llm.fingerprints import fingerprint_report

    rows = [(3, "three little words here"), (None, "no id at all"), (1, "one"), (2, "two words"), (2, "two once more"), (None, None)]
    got = fingerprint_report(documents(spark, rows)).collect()
    alike = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128
    prints = {(r.doc_id, r.n_chars): r.fingerprint for r in got}
    last = next(r for r in got if r.doc_id == 3)
    assert len(got) == 6 and last.near_next == alike(last.fingerprint, prints[None, 12])
    assert next(r for r in got if r.doc_id == 1).near_next == alike(prints[1, 3], prints[2, 9])
