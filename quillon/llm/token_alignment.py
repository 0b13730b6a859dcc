"""Alignment of two tokenizers' tokens by the connected components of their overlaps.

Tokens of both tokenizers are nodes, and a token of one is linked with each of the other whose bytes overlap its own.
Components of this graph, found by union-find, are the minimal groups: between two of them both tokenizers cut at the same
byte. The members of a component are expanded to its links, and pairs of linked ids are counted by the documents that
hold them, in the whole corpus.

Neither tokenizer merges bytes over a place where a space or line break follows anything but white space, so such places
always part groups. Texts are taken apart there, a part is aligned once and remembered by the worker, and a text's groups
are those of its parts.

Documents are packed to blocks where they lie. A block sends its distinct pairs with the number of its documents that
hold each to ranges of the A ids (``exchange``); the task of a range sums them, finds each A id's highest count and
answers each block in the order of its pairs. An A id has at most as many partners as B has ids, so hot ids stay bounded.

Defined results: a text that is null, empty, or that either tokenizer doesn't restore byte for byte has zeros and no
groups; rows that repeat a doc_id count as documents of their own; an empty table gives an empty result; other columns are
never read.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import lean, materialise, shuffle_partitions
from quillon.llm.exchange import coded, cuts, decoded, new_block, row, summed
from quillon.llm.packing import _byte_letters


@dataclass(frozen=True)
class AlignOptions:
    byte_level: str | None = None  # path of A's file on the executors; None: the public byte-level vocabulary
    pieces: str | None = None  # path of B's file; None: the public piece vocabulary
    block_parts: int = 1_500_000
    range_pairs: int = 2_000_000
    remembered: int = 500_000  # parts whose alignment a worker keeps beyond a block


#: Parts of a text: white space and what follows it, up to the next space or line break.
_PARTS = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+")
#: One word to the byte-level tokenizer: its rules cut nothing inside.
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


class Tokenizers:
    """Ids and byte lengths of a part's tokens."""

    def __init__(self, byte_level: str | None, pieces: str | None):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if byte_level is None or pieces is None:
            import public_tokenizers

            byte_level = byte_level or public_tokenizers.path("byte_bpe_50k.json")
            pieces = pieces or public_tokenizers.path("piece_bpe_32k.model")
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.a_spell = self.a.model.tokenize
        self.letters = str.maketrans(dict(enumerate(_byte_letters())))
        self.a_length = {i: len(t) for t, i in self.a.get_vocab().items()}  # a character spells a byte
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b_encode = self.b.encode
        b = self.b
        self.b_bytes = [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
            for i in range(b.get_piece_size())
        ]
        self.b_length = [len(x) for x in self.b_bytes]
        self.digits = [str(i) for i in range(max(len(self.b_bytes), 1 + max(self.a_length)))]
        self.mark = b.piece_to_id("▁")

    def encode(self, part: str) -> tuple[list[int], list[int]] | None:
        """Ids of both tokenizers; None where they don't restore the part."""
        whole = part.encode()
        if _WORD.fullmatch(part):
            a = [t.id for t in self.a_spell(whole.decode("latin-1").translate(self.letters))]
        else:
            a = self.a.encode(part, add_special_tokens=False).ids
        # B puts a space before what it gets; a part that begins with another character must not have it.
        if part[0] == " ":
            b = self.b_encode(part[1:]) if len(part) > 1 else [self.mark]
        else:
            b = self.b_encode(part)
            if b[0] != self.mark:
                return None
            b = b[1:]
        known = self.b_bytes
        return (a, b) if b"".join([known[i] for i in b]) == whole else None


def components(a_sizes: list[int], b_sizes: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[tuple[int, int]]]:
    """Groups (places of A tokens, of B tokens) in order, and all links (place in A, place in B), of tokens with these byte
    lengths, which have the same sum above 0."""
    n, m = len(a_sizes), len(b_sizes)
    up = list(range(n + m))
    links = []
    i = j = 0
    a_left, b_left = a_sizes[0], b_sizes[0]
    while True:
        links.append((i, j))
        p, q = i, n + j
        while up[p] != p:
            p = up[p]
        while up[q] != q:
            q = up[q]
        if p < q:  # the first A token of a group is its root
            up[q] = p
        elif q < p:
            up[p] = q
        if a_left == b_left:
            i += 1
            j += 1
            if i == n:
                break
            a_left, b_left = a_sizes[i], b_sizes[j]
        elif a_left < b_left:
            b_left -= a_left
            i += 1
            a_left = a_sizes[i]
        else:
            a_left -= b_left
            j += 1
            b_left = b_sizes[j]
    groups: dict[int, tuple[list[int], list[int]]] = {}
    for x in range(n + m):
        p = x
        while up[p] != p:
            p = up[p]
        if p == x:
            groups[x] = ([x], [])
        elif x < n:
            groups[p][0].append(x)
        else:
            groups[p][1].append(x - n)
    return list(groups.values()), links


#: A ids stand in the upper half of a pair's number, spread over all of it by an odd factor, so that ranges are even.
_SPREAD, _LOW = 0x9E3779B1, (1 << 32) - 1


class Parts(dict):
    """Part of a text -> its number; lists by number hold its alignment."""

    def __init__(self, tokenizers: Tokenizers):
        super().__init__()
        self.tokenizers = tokenizers
        self.keep([], [], [], set())

    def keep(self, groups: list, pairs: list, sizes: list, bad: set[int]) -> None:
        self.groups: list[bytes] = groups  # a1,a2|b1;a3|b2,b3
        self.pairs: list[bytes] = pairs  # numbers of the pairs of all links
        self.sizes: list[tuple[int, int, int]] = sizes  # A tokens, B tokens, groups
        self.bad = bad

    def __missing__(self, part: str) -> int:
        number = self[part] = len(self.sizes)
        ids = self.tokenizers.encode(part)
        if ids is None:
            self.bad.add(number)
            groups, pairs, sizes = b"", b"", (0, 0, 0)
        else:
            a, b = ids
            known = self.tokenizers
            found, links = components([known.a_length[i] for i in a], [known.b_length[i] for i in b])
            one, two = [known.digits[i] for i in a], [known.digits[i] for i in b]
            groups = ";".join([",".join([one[x] for x in p]) + "|" + ",".join([two[y] for y in q]) for p, q in found]).encode()
            upper = [(i * _SPREAD & _LOW) << 32 for i in a]
            pairs = struct.pack(f"<{len(links)}Q", *[upper[x] | b[y] for x, y in links])
            sizes = (len(a), len(b), len(found))
        self.groups.append(groups)
        self.pairs.append(pairs)
        self.sizes.append(sizes)
        return number

    def forget_all_but(self, numbers: np.ndarray) -> None:
        new = {n: i for i, n in enumerate(numbers.tolist())}
        kept = {part: new[n] for part, n in self.items() if n in new}
        self.clear()
        self.update(kept)
        of = lambda x: [x[n] for n in new]
        self.keep(of(self.groups), of(self.pairs), of(self.sizes), {new[n] for n in self.bad if n in new})


@cache
def _parts(byte_level: str | None, pieces: str | None) -> Parts:
    return Parts(Tokenizers(byte_level, pieces))


def numbers_of(text: str, parts: Parts) -> list[int]:
    """The numbers of a text's parts; none where it isn't restored."""
    if not text:
        return []
    found = _PARTS.findall(" " + text) if len(text) < 4_000_000 else (m[0] for m in _PARTS.finditer(" " + text))
    numbers = [parts[x] for x in found]
    return [] if parts.bad and not parts.bad.isdisjoint(numbers) else numbers


BLOCKS = pa.schema(
    [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.string())), ("sizes", pa.binary()),
     ("places", pa.binary()), ("counts", pa.binary()), ("links", pa.binary()), ("pairs", pa.binary()), ("holders", pa.binary()),
     ("n_pairs", pa.int64())]
)
BLOCK_TYPES = (
    "block long, doc_ids array<long>, hashes array<string>, sizes binary, places binary, counts binary, links binary, "
    "pairs binary, holders binary, n_pairs long"
)


def _expanded(of: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of the runs [starts, starts + sizes) of each of `of`, one after another."""
    long = sizes[of]
    ends = np.cumsum(long)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[of] - (ends - long), long)


def blocked(docs: DataFrame, options: AlignOptions) -> DataFrame:
    """docs (doc_id, text) as blocks: documents as numbers of the block's parts, parts as numbers of its pairs.

    holders: how many of the block's documents hold each pair.
    """
    paths, most, remembered = (options.byte_level, options.pieces), options.block_parts, options.remembered

    def block(parts: Parts, ids: list, hashes: list, texts: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        kinds, places = np.unique(np.concatenate(texts), return_inverse=True)
        chosen = kinds.tolist()
        counts = np.array([parts.sizes[k] for k in chosen], dtype=np.int64).reshape(-1, 3)
        linked = np.array([len(parts.pairs[k]) // 8 for k in chosen], dtype=np.int64)
        pairs, links = np.unique(np.frombuffer(b"".join([parts.pairs[k] for k in chosen]), dtype="<u8"), return_inverse=True)
        # Distinct parts of each document, then distinct pairs.
        doc = np.repeat(np.arange(len(ids)), sizes)
        held = np.unique(doc * max(len(kinds), 1) + places)
        doc, part = np.divmod(held, max(len(kinds), 1))
        at = _expanded(part, linked, np.cumsum(linked) - linked)
        owned = np.unique(np.repeat(doc, linked[part]) * max(len(pairs), 1) + links[at])
        holders = np.bincount(owned % max(len(pairs), 1), minlength=len(pairs))
        values = {
            "block": new_block(), "doc_ids": ids, "hashes": hashes, "sizes": coded(sizes), "places": coded(places),
            "counts": coded(np.column_stack([counts, linked]).reshape(-1)), "links": coded(links),
            "pairs": coded(pairs, ascending=True), "holders": coded(holders), "n_pairs": len(pairs),
        }
        if len(parts) > remembered:
            parts.forget_all_but(kinds)
        return row(BLOCKS, values)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _parts(*paths)
        ids: list = []
        hashes: list = []
        texts: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                numbers = numbers_of(text.as_py() or "", parts)
                groups = parts.groups
                hashes.append(hashlib.sha256(b";".join([groups[i] for i in numbers])).hexdigest() if numbers else "")
                ids.append(doc)
                texts.append(np.array(numbers, dtype=np.int32))
                n += len(numbers) + 1
                if n >= most:
                    yield block(parts, ids, hashes, texts)
                    ids, hashes, texts, n = [], [], [], 0
        if ids:
            yield block(parts, ids, hashes, texts)

    return lean(docs).mapInArrow(pack, BLOCK_TYPES)


QUESTIONS = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("pairs", pa.binary()), ("holders", pa.binary())])
QUESTION_TYPES = "range int, block long, pairs binary, holders binary"
ANSWERS = pa.schema([("block", pa.int64()), ("range", pa.int32()), ("counts", pa.binary())])
ANSWER_TYPES = "block long, range int, counts binary"


def asked(blocks: DataFrame, ranges: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in batch.to_pylist():
                pairs, holders = decoded(values["pairs"], ascending=True), decoded(values["holders"])
                at = cuts(pairs >> np.uint64(32), ranges, 32)  # an A id's pairs stay together
                for i in range(ranges):
                    if at[i] < at[i + 1]:
                        part = slice(at[i], at[i + 1])
                        yield row(QUESTIONS, {
                            "range": i, "block": values["block"], "pairs": coded(pairs[part], ascending=True), "holders": coded(holders[part]),
                        })

    return blocks.select("block", "pairs", "holders").mapInArrow(ask, QUESTION_TYPES)


def counted(questions: DataFrame) -> DataFrame:
    """For each block and range, twice the count of each pair, plus one where it is its A id's highest."""

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        kinds, sums, places = summed([decoded(r["pairs"], ascending=True) for r in rows], [decoded(r["holders"]) for r in rows])
        a = kinds >> np.uint64(32)
        first = np.flatnonzero(np.diff(a, prepend=~a[:1]) != 0)
        highest = np.repeat(np.maximum.reduceat(sums, first), np.diff(np.append(first, len(a))))
        told = 2 * sums + (sums == highest)
        columns = [[r["block"] for r in rows], [r["range"] for r in rows], [coded(told[p]) for p in places]]
        return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, ANSWERS, strict=True)], schema=ANSWERS)

    return questions.groupBy("range").applyInArrow(answer, ANSWER_TYPES)


RESULT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of these sizes, which may be empty."""
    upto = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def align(docs: DataFrame, options: AlignOptions = AlignOptions()) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs."""
    blocks = materialise(blocked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), options), "aligned")
    pairs = blocks.agg(F.coalesce(F.sum("n_pairs"), F.lit(0))).first()[0]
    ranges = max(2 * shuffle_partitions(docs.sparkSession), -(-pairs // options.range_pairs))
    answers = counted(asked(blocks, ranges))

    def measure(texts: pa.Table, found: pa.Table) -> pa.Table:
        columns: list = [[] for _ in range(len(RESULT) + 1)]
        for values in texts.to_pylist():
            parts = sorted(found.select(["range", "counts"]).to_pylist(), key=lambda r: r["range"])
            told = np.concatenate([np.empty(0, dtype=np.uint64), *(decoded(r["counts"]) for r in parts)]).astype(np.int64)
            sizes, places = decoded(values["sizes"]).astype(np.int64), decoded(values["places"]).astype(np.int64)
            counts = decoded(values["counts"]).astype(np.int64).reshape(-1, 4)
            of_link = told[decoded(values["links"]).astype(np.int64)]
            of_part = [*counts.T, _sums(of_link & 1, counts[:, 3]), _sums(of_link >> 1, counts[:, 3])]
            sums = [_sums(x[places], sizes) for x in of_part]
            columns = [list(chain(a, b)) for a, b in zip(columns, [values["doc_ids"], *sums, values["hashes"]], strict=True)]
        kinds = [pa.int64()] * len(RESULT) + [pa.string()]
        return pa.table([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=[*RESULT, "groups_sha256"])

    types = ", ".join(f"{c} long" for c in RESULT) + ", groups_sha256 string"
    return blocks.drop("pairs", "holders", "n_pairs").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(measure, types)


def spans(text: str, options: AlignOptions = AlignOptions()) -> list[tuple[list[int], list[int], int, int]]:
    """Groups of one text: ids of A, ids of B, and the group's first and last byte in space + text, end exclusive."""
    parts = _parts(options.byte_level, options.pieces)
    numbers, out, at = numbers_of(text, parts), [], 0
    for number in numbers:
        for group in parts.groups[number].decode().split(";"):
            a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
            end = at + sum(parts.tokenizers.a_length[i] for i in a)
            out.append((a, b, at, end))
            at = end
    return out
