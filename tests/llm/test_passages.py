"""Repeated passages: all over fifty words, also with an edit inside, against a brute-force look at every run of words."""

from quillon.llm.chunk_dedup import ChunkOptions, repeated_passages
from tests.llm.helpers import documents, words


def around(passage, i):
    return " ".join([*words(30 + i % 17, 50_000 + i), *passage, *words(40, 90_000 + i)])


def test_every_passage_over_fifty_words_is_found(spark):
    rows = []
    for i in range(600):
        passage = words(51, 10_000 + i)
        rows += [(2 * i + k, around(passage, 2 * i + k)) for k in (0, 1)]
    found = repeated_passages(documents(spark, rows)).collect()
    text = dict(rows)
    assert {r.doc_id for r in found} == {d for d, _ in rows}
    for r in found:
        span = text[r.doc_id].encode()[r.start_byte : r.start_byte + r.n_bytes].decode()
        assert len(span.split()) == r.n_words >= 32 and span in text[r.doc_id ^ 1]
        assert r.original == (r.doc_id % 2 == 0) and r.first_doc_id == r.doc_id & ~1


def test_insertions_do_not_break_a_passage_up(spark):
    """A word put into the middle of sixty: one passage in either document, with both halves."""
    rows = []
    for i in range(60):
        passage = words(60, 20_000 + i)
        rows += [(2 * i, around(passage, 2 * i)), (2 * i + 1, around([*passage[:30], "INSERTED", *passage[30:]], 2 * i + 1))]
    found = repeated_passages(documents(spark, rows)).collect()
    assert len({r.doc_id for r in found}) >= 118
    text = dict(rows)
    inside = [r for r in found if "INSERTED" in text[r.doc_id].encode()[r.start_byte : r.start_byte + r.n_bytes].decode()]
    assert len(inside) >= 59 and all(r.n_words >= 45 for r in found)


def runs(texts, width):
    """Documents that share a run of so many words with another, or hold one twice."""
    seen = {}
    for d, t in texts:
        w = t.split()
        for k in range(len(w) - width + 1):
            seen.setdefault(tuple(w[k : k + width]), []).append(d)
    return {d for ds in seen.values() if len(ds) > 1 for d in ds}


def test_what_is_reported_repeats_and_what_repeats_is_reported(spark):
    rows = []
    for i in range(300):
        shared = words(20 + i % 60, 70_000 + i)
        rows += [(3 * i + k, around(shared, 3 * i + k)) for k in (0, 1)] + [(3 * i + 2, " ".join(words(90, 400_000 + i)))]
    found = {r.doc_id for r in repeated_passages(documents(spark, rows)).collect()}
    assert runs(rows, 51) <= found <= runs(rows, 32)
    small = ChunkOptions(passage_words=16)
    found = {r.doc_id for r in repeated_passages(documents(spark, rows), small).collect()}
    assert runs(rows, 36) <= found <= runs(rows, 16)


def test_short_passages_are_left_alone(spark):
    line, long = words(31, 1), words(60, 2)
    rows = [(i, " ".join([*words(25, 100 + i), *line, *words(25, 300 + i)])) for i in range(30)]
    rows += [(100 + i, " ".join([*words(20, 500 + i), *long[i % 5 :], *words(20, 700 + i)])) for i in range(10)]
    rows += [(200, " ".join(words(50, 900))), (200, " ".join(words(70, 901))), (None, " ".join(long)), (201, None), (202, "w " * 300)]
    found = repeated_passages(documents(spark, rows)).collect()
    texts = [" ".join((t or "").split()) for _, t in rows]
    assert {r.doc_id for r in found} == {None, 202, *range(100, 110)}
    for r in found:
        own = next(t for d, t in rows if d == r.doc_id and t)
        span = " ".join(own.encode()[r.start_byte : r.start_byte + r.n_bytes].decode().split())
        assert sum(span in t for t in texts) >= 2 or own.split().count("w") == 300
        assert r.first_doc_id == (202 if r.doc_id == 202 else 100)
