"""Groups, links and counts against whole texts encoded by both tokenizers."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import cache

import public_tokenizers
import pytest

from quillon.llm.token_alignment import AlignOptions, _parts, align, components, spans
from tests.llm.helpers import AWKWARD, documents, empty


@cache
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, {i: len(t) for t, i in a.get_vocab().items()}, b


def byte_tokens(text):
    """Whole-text tokens as (id, start, end), or none."""
    a, a_size, b = tokenizers()
    if not text:
        return [], []
    whole = (" " + text).encode()
    pieces = [(i, bytes([int(p[1][3:5], 16)]) if b.is_byte(i) else p[1].replace("\u2581", " ").encode()) for i in b.encode(text) for p in [(i, b.id_to_piece(i))]]
    if b"".join(x for _, x in pieces) != whole:
        return [], []
    left, right, at = [], [], 0
    for i in a.encode(" " + text, add_special_tokens=False).ids:
        left.append((i, at, at + a_size[i]))
        at += a_size[i]
    at = 0
    for i, x in pieces:
        right.append((i, at, at + len(x)))
        at += len(x)
    return left, right


def plain(rows):
    docs, holders = [], defaultdict(set)
    for n, (doc, text) in enumerate(rows):
        left, right = byte_tokens(text)
        links = [(x[0], y[0]) for x in left for y in right if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in left} & {y[2] for y in right})
        groups = [
            ",".join(str(x[0]) for x in left if s <= x[1] < e) + "|" + ",".join(str(y[0]) for y in right if s <= y[1] < e)
            for s, e in zip([0, *ends], ends, strict=False)
        ]
        docs.append((doc, len(left), len(right), groups, links))
        for link in set(links):
            holders[link].add(n)
    count = {k: len(v) for k, v in holders.items()}
    best = Counter()
    for (a, _), c in count.items():
        best[a] = max(best[a], c)
    return sorted(
        ((doc, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links),
          hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for doc, n_a, n_b, groups, links in docs),
        key=str,
    )


def found(docs, options=AlignOptions()):
    return sorted((tuple(r) for r in align(docs, options).collect()), key=str)


def corpus():
    r = random.Random(4)
    signs = "ab \u00e9\n\t  .,'s\u2581<|endoftext|>\u6f22\u5b57\U0001f600\x1c\x0b\r 12'll  \u00a0\u3000\u200b"
    rows = [(i, "".join(r.choice(signs) for _ in range(r.randint(0, 40)))) for i in range(300)]
    rows += [(400 + i, f"the cat {w} on the mat. {w}!") for i, w in enumerate(("sat", "saat", "sits", "sat", "s\u00e4\u00df"))]
    rows += [(3, "a repeated id"), (None, "null id"), *((500 + i, t) for i, t in AWKWARD if t is None or len(t) < 2000)]
    return rows


@pytest.mark.parametrize("options", [AlignOptions(), AlignOptions(block_parts=40, range_pairs=10, remembered=20)])
def test_documents_are_those_of_whole_texts(spark, options):
    rows = corpus()
    assert found(documents(spark, rows), options) == plain(rows)


def test_real_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    short = [(r.doc_id, r.text[:1500] if r.text else r.text) for r in docs.collect()]
    assert found(documents(spark, short)) == plain(short)


def test_components_are_the_minimal_groups():
    groups, links = components([2, 3, 1, 4], [1, 1, 4, 4])
    assert groups == [([0], [0, 1]), ([1, 2], [2]), ([3], [3])]
    assert links == [(0, 0), (0, 1), (1, 2), (2, 2), (3, 3)]


def test_spans_cover_the_text():
    text = "Several words, sp\u00e4ter\nmore."
    got = spans(text)
    assert got[0][2] == 0 and got[-1][3] == len((" " + text).encode())
    assert all(x[3] == y[2] for x, y in zip(got, got[1:], strict=False))


def test_long_part_and_empty_table(spark):
    assert align(empty(spark)).collect() == []
    text = "x\u00e9" * 60_000  # no place to take it apart
    (row,) = align(documents(spark, [(1, text)])).collect()
    assert row.n_a and row.n_b and row.n_links >= max(row.n_a, row.n_b)
    assert _parts(None, None)[" x\u00e9"] is not None
