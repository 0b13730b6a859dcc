"""Substring deduplication, packing and the pipeline."""

import random
import re
import zlib

import numpy as np
import pytest

from quillon.llm.chunk_dedup import ChunkOptions, cut_points, cut_repeats, repeated_passages, seeds
from quillon.llm.packing import PackOptions, _ids, best_fit, pack, token_ids
from quillon.llm.wordhash import word_hashes
from tests.llm.helpers import AWKWARD, documents, empty, words


def test_cuts_depend_on_the_last_words_alone():
    options = ChunkOptions()
    codes = lambda text: word_hashes([text.encode()])[0]
    passage = words(80, 5)
    a, b = codes(" ".join(words(33, 6) + passage)), codes(" ".join(words(71, 7) + passage + words(9, 8)))
    inner = lambda w, at: {int(x) - at for x in cut_points(w, options) if at + options.window <= x < at + 80}
    assert inner(a, 33) == inner(b, 71) and len(inner(a, 33)) > 20
    points = cut_points(a, options)
    assert points[0] == 0 and points[-1] == len(a) and (np.diff(points) > 0).all()


def test_seeds_hold_the_fewest_chunks():
    options = ChunkOptions()
    w = word_hashes([" ".join(words(200, 9)).encode()])[0]
    points = cut_points(w, options).tolist()
    begins, ends, digests = seeds(w, options)
    assert [(b, min(p for p in points if p >= b + options.seed_words)) for b in points if points[-1] - b >= options.seed_words] == list(zip(begins.tolist(), ends.tolist()))
    shifted = seeds(np.concatenate((w[150:170], w)), options)
    assert set(digests.tolist()[4:]) <= set(shifted[2].tolist()) and len(set(digests.tolist())) == len(digests)


def test_passages_repeat_across_documents(spark):
    passage = " ".join(words(70, 1))
    rows = [*AWKWARD, *[(100 + i, f"{' '.join(words(40, 50 + i))} {passage} {' '.join(words(40, 90 + i))}") for i in range(20)]]
    rows += [(300 + i, " ".join(words(120, 300 + i))) for i in range(20)]
    got = repeated_passages(documents(spark, rows)).collect()
    found = {r.doc_id for r in got}
    assert set(range(100, 120)) <= found and not found & set(range(300, 320))
    mine = [r for r in got if r.doc_id >= 100]
    assert {r.doc_id for r in mine if r.original} == {100} and all(r.n_places == 20 and r.first_doc_id == 100 for r in mine)
    text = dict(rows)
    for r in mine:
        assert text[r.doc_id].encode()[r.start_byte : r.start_byte + r.n_bytes].decode() in f" {passage} "
    kept = {r.doc_id: r.text for r in cut_repeats(documents(spark, rows)).collect()}
    assert kept[100] == text[100] and kept[1] is None and len(kept) == len(rows)
    assert all(len(kept[i]) < len(text[i]) - 200 for i in range(101, 120)) and all(kept[i] == text[i] for i in range(300, 320))
    assert repeated_passages(empty(spark)).collect() == [] and cut_repeats(empty(spark)).collect() == []


def test_token_ids_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), _ids(None)
    r = random.Random(6)
    texts = [t or "" for _, t in AWKWARD] + ["it's l'été, a.b abc,, x. <|endoftext|> <|ENDOFTEXT|>", "İ ﬁ é x² 가 ᆨ", "ÿ ß ÷a ×, É. ñ,"]
    texts += ["".join(r.choice("aB é.,' \nß́漢1") for _ in range(60)) for _ in range(300)]
    for text in texts:
        assert np.frombuffer(token_ids(text.encode(), ids), dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_best_fit_by_hand():
    assert best_fit([6, 5, 4, 5, 10, 1], 10, 8) == [(0, 0), (1, 0), (0, 6), (1, 5), (2, 0), (3, 0)]
    assert best_fit([6, 7, 8, 4], 10, 2) == [(0, 0), (1, 0), (2, 0), (0, 6)]
    r = random.Random(7)
    lengths = [r.randint(1, 4095) for _ in range(5000)]
    bins: dict = {}
    for n, (b, at) in zip(lengths, best_fit(lengths, 4096, 64)):
        assert bins.get(b, 0) == at
        bins[b] = at + n
    assert max(bins.values()) <= 4096 and len(bins) <= 1.1 * sum(lengths) / 4096


def test_packed_pieces_restore_every_text(spark):
    rows = [*AWKWARD, (50, "many words " * 9000), (51, "x"), (51, "x")]
    got = pack(documents(spark, rows), PackOptions(shard_sequences=4)).collect()
    ids = _ids(None)
    want = []
    for d, text in rows:
        coded = np.frombuffer(token_ids((text or "").encode(), ids), dtype="<u4").tolist() + [1]
        for i in range(0, len(coded), 4096):
            part = coded[i : i + 4096]
            want.append((d, i // 4096, i, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    filled: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 4096 and pack(empty(spark)).collect() == []


@pytest.fixture(scope="module")
def stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    return out


def test_pipeline_stages(spark, stages):
    from tests.llm.helpers import near_components

    docs, judged, exact, near, mixed, packed = ([r.asDict() for r in df.collect()] for df in stages)
    assert all(df.columns == stages[0].columns for df in stages[1:5])
    squash = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first: dict = {}
    for r in sorted(judged, key=lambda r: r["doc_id"]):
        first.setdefault(squash(r["text"]), r["doc_id"])
    assert {r["doc_id"] for r in exact} == set(first.values())
    kept = near_components([(r["doc_id"], r["text"]) for r in exact])
    assert {r["doc_id"] for r in near} == {d for d, c in kept.items() if d == c}
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near}
    size = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    assert abs(size(mixed) - size(near)) <= 0.2 * size(near)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}


def test_pipeline_keeps_good_documents(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = labels.filter("quality = 1").join(stages[0], "doc_id")
    lost = good.join(stages[1].select("doc_id"), "doc_id", "left_anti").count()
    assert lost <= 0.03 * max(good.count(), 1)
