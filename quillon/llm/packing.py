"""Best-fit packing of documents into sequences.

Documents are tokenized where they lie; only pieces (document, start, length, checksum) move on. Pieces are
dealt by hash to shards of about ``shard_sequences`` full sequences each, so a shard's size is bounded at any
input size. A shard is packed online: each piece goes to the open bin with the least free space that still holds
it, found in a bitset with one bit for each amount of free space. At most ``open_bins`` bins are open; when
another is needed, the fullest closes first.

Defined results: a null text counts as empty and has only the end id; pieces of full length are sequences of
their own; rows that repeat a doc_id are packed as often as they stand; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import lean, materialise, text_of


@dataclass(frozen=True)
class PackOptions:
    tokenizer: str | None = None  # path of a tokenizer file on the executors; None: the public word BPE vocabulary
    end_id: int = 1
    length: int = 4096
    open_bins: int = 512
    shard_sequences: int = 8192
    shard_rows: int = 500_000


#: Spellings whose ids a worker remembers in each of two generations; when the younger is full, it becomes the older.
REMEMBERED = 500_000

#: Lower-case letters that are one word to the tokenizer: no other character stands in them, and they are normal already.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _byte_letters() -> list[str]:
    """The character by which byte-level tokenizers spell each byte: itself where it can be printed, else one beyond 255."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + rest.index(b)) for b in range(256)]


class _Ids(dict):
    """White-space-free chunk -> its ids as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its chunks. A chunk of
    letters alone goes to the tokenizer's model directly; one that ends with a full stop or comma after letters has the ids
    of both parts; others pass the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.spell = self.tokenizer.model.tokenize
        self.letters = str.maketrans({i: c for i, c in enumerate(_byte_letters())})

    def __missing__(self, chunk: bytes) -> bytes:
        coded = self.older.get(chunk)
        if coded is None:
            if _LETTERS.fullmatch(chunk):
                coded = _packed([t.id for t in self.spell(chunk.decode("latin-1").translate(self.letters))])
            elif chunk[-1:] in b".," and _LETTERS.fullmatch(chunk, 0, len(chunk) - 1):
                coded = self[chunk[:-1]] + self[chunk[-1:]]
            else:
                coded = _packed(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[chunk] = coded
        return coded


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@cache
def _ids(path: str | None) -> _Ids:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return _Ids(path)


def token_ids(text: bytes, ids: _Ids) -> bytes:
    """The ids of a whole text, without the end id."""
    if b"<|" not in text:  # else a special token's string might come about
        text = text.lower()
    chunks = text.split()
    return b"".join([b"".join([ids[c] for c in chunks[i : i + 100_000]]) for i in range(0, len(chunks), 100_000)])


PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)


def pieces(docs: DataFrame, options: PackOptions = PackOptions()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    end, span, path = np.array([options.end_id], dtype="<u4").tobytes(), 4 * options.length, options.tokenizer

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(path)
        for batch in batches:
            rows = []
            texts = batch.column(1).cast(pa.large_binary())
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                coded = token_ids(text.as_py(), ids) + end
                for i in range(0, len(coded), span):
                    part = coded[i : i + span]
                    rows.append((doc, i // span, i // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)

    return lean(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length in turn; bins are numbered as they open."""
    placed, opened, count = [], 0, 0
    free: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)  # free space -> (bin, filled)
    bits = 0  # bit f is set when some open bin has f free
    for n in lengths:
        fits = bits >> n
        if n >= capacity:
            placed.append((opened, 0))
            opened += 1
            continue
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            bin_, filled = free[space].pop()
            if not free[space]:
                bits ^= 1 << space
            count -= 1
        else:
            if count >= open_bins:
                fullest = (bits & -bits).bit_length() - 1
                free[fullest].pop()
                if not free[fullest]:
                    bits ^= 1 << fullest
                count -= 1
            bin_, filled, opened = opened, 0, opened + 1
        placed.append((bin_, filled))
        left = capacity - filled - n
        if left:
            free[left].append((bin_, filled + n))
            bits |= 1 << left
            count += 1
    return placed


def pack(docs: DataFrame, options: PackOptions = PackOptions()) -> DataFrame:
    """Every piece with sequence_id and offset."""
    cut = materialise(pieces(docs, options), "pieces")
    total, rows = cut.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    # A shard is bounded by its tokens and, where documents are tiny, by its rows.
    shards = max(1, -(-total // (options.length * options.shard_sequences)), -(-rows // options.shard_rows))
    capacity, open_bins = options.length, options.open_bins

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # The order is that of a hash, the same on every run; an online packer wants mixed lengths.
        group = group.sort_values(["mixed", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        placed = best_fit(group["length"].tolist(), capacity, open_bins)
        where = np.array(placed, dtype=np.int64).reshape(-1, 2)
        group["sequence_id"] = (np.int64(key[0]) << 40) + where[:, 0]
        group["offset"] = where[:, 1]
        return group.drop(columns=["shard", "mixed"])

    # The row's number in the written table sets rows apart that repeat a doc_id.
    mixed = F.xxhash64(F.col("doc_id"), F.col("piece"), F.monotonically_increasing_id())
    return (
        cut.withColumn("mixed", mixed)
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(7), "mixed"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(
            fill,
            "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
        )
    )
