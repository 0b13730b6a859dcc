"""Phrases in texts against searching for each by itself, and what is built on them."""

import random
import re
from collections import Counter

import pytest

from quillon.operators import external, phrases, transcripts
from quillon.operators.phrases import find_phrases, normalized_terms

TEXTS = [
    (1, "我们用激光雷达建图"), (2, "the lidars work, LiDAR only"), (3, "激光雷达"), (4, None), (5, ""), (6, "aaaa Aaa"), (7, "Straße STRASSE ßß İi K k ſs"),
    (8, "多模态模型和模型, RAG和rag. C++ and c++11"), (9, "x" * 3000 + "雷达" * 500),
]
GLOSSARY = [
    ("激光雷达", "lidar"), ("雷达", "radar"), ("lidar", "激光雷达"), ("LIDAR", "激光雷达"), ("aa", "double"), ("aaa", "triple"), ("straße", "street"), ("ß", "ss"),
    ("k", "kelvin"), ("s", "es"), ("C++", "cpp"), ("RAG", "检索"), ("  ", "blank"), ("模型", "model"), ("态模", "overlap"), ("+", "plus"), ("radar", "Radar"),
]


def plain(texts, glossary):
    out = set()
    for i, text in texts:
        for variant, canonical in glossary:
            if variant.strip():
                for m in re.finditer(re.escape(variant.strip()), text or "", re.IGNORECASE):
                    out.add((i, canonical, m.start(), m.end(), m.group()))
    return out


def found(frame):
    rows = [(r[0], r.canonical, r.start, r.end, r.found) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frames(spark, texts, glossary):
    return spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(glossary, "variant string, canonical string")


@pytest.mark.parametrize("shard", [phrases.SHARD, 3])
def test_all_occurrences_are_found(spark, shard):
    assert found(find_phrases(*_args(spark), shard=shard)) == plain(TEXTS, GLOSSARY)


def _args(spark):
    texts, glossary = frames(spark, TEXTS, GLOSSARY)
    return texts, "id", "text", glossary


def test_random_texts(spark):
    r = random.Random(7)
    letters = "abAB雷达é"
    texts = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 60)))) for i in range(200)]
    glossary = [("".join(r.choice(letters) for _ in range(r.randint(1, 4))), f"c{i % 9}") for i in range(60)]
    t, g = frames(spark, texts, glossary)
    assert found(find_phrases(t, "id", "text", g)) == plain(texts, glossary)


def test_hundred_thousand_terms(spark):
    glossary = [(f"term{i:06d}x", f"T{i}") for i in range(100_000)] + [("激光雷达", "lidar")]
    texts = [(1, "a term000007x, TERM099999X! term1x 用激光雷达"), (2, "term000007xterm000008x")]
    t, g = frames(spark, texts, glossary)
    got = {(i, c, s) for i, c, s, _, _ in found(find_phrases(t, "id", "text", g))}
    assert got == {(1, "T7", 2), (1, "T99999", 15), (1, "lidar", texts[0][1].index("激")), (2, "T7", 0), (2, "T8", 11)}


def test_a_variant_of_the_term_itself_proposes_nothing(spark):
    texts = spark.createDataFrame([("s", "Lidar 激光雷达"), ("t", "the lidars work")], "segment_id string, text string")
    glossary = spark.createDataFrame([("lidar", "LiDAR"), ("激光雷达", "LiDAR"), ("lidar", "lidar (term)")], "variant string, canonical string")
    got = {(r.segment_id, r.canonical, r.start) for r in transcripts.glossary_hits(texts, glossary).collect()}
    assert got == {("s", "LiDAR", 6), ("s", "lidar (term)", 0), ("t", "lidar (term)", 4)}


def one_after_another(text, glossary):
    first = {}
    for variant, canonical in sorted(glossary):
        if len(variant) >= 2 and variant != canonical.lower():
            first.setdefault(variant, canonical)
    changes = []
    for variant in sorted(first, key=lambda v: (-len(v), v)):
        quoted = re.escape(variant)
        if re.fullmatch(r"[A-Za-z0-9.+_-]+", variant):
            quoted = rf"(?<![A-Za-z0-9]){quoted}(?![A-Za-z0-9])"
        after = re.sub(quoted, lambda _, v=variant: first[v], text, flags=re.IGNORECASE)
        if after != text:
            changes.append(f"{variant}->{first[variant]}")
            text = after
    return text, changes


@pytest.mark.parametrize("shard", [phrases.SHARD, 5])
def test_terms_are_replaced_one_after_another(spark, shard):
    r = random.Random(3)
    letters = "ab 雷达-"
    texts = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 40)))) for i in range(120)] + [(1000 + i, t) for i, t in TEXTS]
    glossary = [("".join(r.choice(letters) for _ in range(r.randint(1, 4))), "".join(r.choice(letters) for _ in range(r.randint(0, 5)))) for _ in range(25)]
    glossary += [("lidars", r"\1 $2"), ("激光雷达", "雷达 ab")]
    t, g = frames(spark, texts, glossary)
    got = {r.id: (r.text, r.changes) for r in normalized_terms(t, g, shard).collect()}
    assert got[1004] == (None, [])
    for i, text in texts:
        if text is not None:
            assert got[i] == one_after_another(text, glossary)


RUNS = [
    ("zh", 0, "这个模型叫做Transformer-XL，我们称为：注意力机制。准确率提升了 12.5%，用 GPU 训练 3 小时"), ("zh", 1, "GPU 和 RAG, 激光雷达; RAG"), ("zh", 2, None),
    ("en", 0, "The API uses GPT4 and API keys. Latency fell to 30 ms. See lidar2 for The details"), ("en", 1, "lidars: 5GB of data"), ("none", 0, "nothing here"),
]
KNOWN = [("LiDAR", "激光雷达", 1), ("LiDAR", "lidar", 1), ("检索增强", "RAG", 0), ("absent", "missing", 2)]


def planned(texts, known, limit):
    full = "\n".join(t or "" for t in texts)
    names, words = {}, []
    for canonical, variant, place in sorted(known, key=lambda k: k[2]):
        names.setdefault(canonical, []).append(variant)
    words += [c for c, vs in names.items() if any(v.casefold() in full.casefold() for v in (c, *vs))]
    counted = Counter(external.NAME.findall(full)) + Counter(external.ACRONYM.findall(full))
    words += [w for w, _ in counted.most_common(2 * limit)]
    words += [m.group(1) for m in external.INTRODUCED.finditer(full)]
    for t in texts:
        for m in external.NUMBER.finditer(t or ""):
            claim = " ".join(t[max(0, m.start() - 36) : m.end() + 36].split()).strip(" ，,。；;：:")
            words += [claim] if 4 <= len(claim) <= 100 else []
    out, seen = [], set()
    for w in words:
        w = " ".join(w.split())
        if len(w) >= 2 and w.casefold() not in seen and len(out) < limit:
            seen.add(w.casefold())
            out.append((w + (" 官方 文档" if len(w) <= 36 else " 来源"))[:160])
    return out


@pytest.mark.parametrize("limit", [3, 12, 40])
def test_external_queries_follow_the_four_streams(spark, limit):
    segments = spark.createDataFrame(RUNS, "run_id string, ordinal long, text string")
    glossary = spark.createDataFrame(KNOWN, "canonical string, variant string, position long")
    got = {}
    for r in sorted(external.external_queries(segments, glossary, limit).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.run_id, []).append(r.query)
    for run in ("zh", "en", "none"):
        assert got.get(run, []) == planned([t for x, _, t in RUNS if x == run], KNOWN, limit)
