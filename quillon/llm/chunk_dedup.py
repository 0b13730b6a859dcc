"""Substring deduplication by content-defined chunks.

A gear hash rolls over a text's words: h = 2 h + gear(word), and a chunk ends where a bit of h is zero that depends on the last
few words alone. So chunks resist shifts, and two copies of a passage have the same cuts but for the first words, wherever they
stand and whatever was inserted elsewhere. A chunk by itself says little: from each cut on, the fewest chunks that have
``seed_words`` words together are a seed, whose length depends on content alone, too. Seeds are deduplicated by a digest over the
whole table. Seeds that stand elsewhere too are joined to passages where they touch, and over a short gap where both stand first in the
same document: a word that was put into a passage, or changed, doesn't break it up. A passage is reported where its seeds cover
``passage_words`` words; its first document, by doc_id, is the original, and other places can be cut out. Words are compared as they
are written, whatever white space separates them. A passage may reach up to a few words further on either side than what is
reported: to the cut before its first seed.

Texts are packed to blocks where they lie, and a block asks for the places of its seeds by ranges of their digests (``exchange``). A
digest has 56 bits: two of n seeds share one with a chance of n * n / 2 ** 57. A digest's places are counted and compared for the
smallest, never gathered, so a passage that very many documents share costs no more than as many different ones.

Defined results: a null text counts as empty; texts of fewer words than a seed have no passages; a seed that repeats within one text
counts as repeated; rows that repeat a doc_id with the same text are one document and keep it, with different texts
they are told apart by a 64-bit hash of the text; an empty table gives an empty result; ``repeated_passages`` ignores other columns,
``cut_repeats`` carries them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import lean, materialise, shuffle_partitions, text_of, wrapped
from quillon.llm.exchange import coded, cuts, decoded, new_block, row
from quillon.llm.wordhash import grouped, mix, texts_of, word_hashes


@dataclass(frozen=True)
class ChunkOptions:
    window: int = 4  # words that a cut depends on
    mask: int = 0b1000  # bits of the rolling hash, below 2 ** window, that are zero at a cut: one bit cuts after every other word, on average
    seed_words: int = 16
    gap_words: int = 24  # between seeds of one passage
    passage_words: int = 32  # that a passage's seeds cover at least
    block_seeds: int = 1_000_000
    range_keys: int = 2_000_000


def gear(words: np.ndarray, window: int) -> np.ndarray:
    """The rolling hash after each word, h = 2 h + gear(word), in as many bits as words count: older ones are shifted out."""
    g = (words >> np.uint64(11)).astype(np.uint32)
    h = g.copy()
    for back in range(1, min(window, len(words))):
        h[back:] += g[:-back] << np.uint32(back)
    return h & np.uint32((1 << window) - 1)


def cut_points(words: np.ndarray, options: ChunkOptions) -> np.ndarray:
    """Where chunks begin and end, as numbers of words: also at both ends of the text."""
    n = len(words)
    inner = np.flatnonzero((gear(words, options.window) & np.uint32(options.mask)) == 0) + 1
    return np.unique(np.concatenate(([0], inner, [n]))) if n else np.empty(0, dtype=np.int64)


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def seeds(words: np.ndarray, options: ChunkOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, digest) of the seeds of one text."""
    points = cut_points(words, options)
    if len(words) < options.seed_words:
        return points[:0], points[:0], np.empty(0, dtype=np.uint64)
    at = np.searchsorted(points, points + options.seed_words)
    begins, ends = points[at < len(points)], points[at[at < len(points)]]
    # Sums of words by powers of their place; the inverse power of a seed's begin makes them independent of it.
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(words * _powers(_ODD, len(words)), dtype=np.uint64)))
    digests = (sums[ends] - sums[begins]) * _powers(_INVERSE, len(words) + 1)[begins]
    return begins, ends, mix(digests + (ends - begins).astype(np.uint64)) >> np.uint64(64 - BITS)


BITS = 56
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Numbers of documents by rank: null after all others.
_LAST = np.uint64((1 << 64) - 1)


def _ranked(doc: int | None) -> int:
    return int(_LAST) if doc is None else min(doc + (1 << 63), int(_LAST) - 1)


BLOCKS = pa.schema(
    [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("tags", pa.list_(pa.int64())), ("n_seeds", pa.int64()),
     *[(c, pa.binary()) for c in ("sizes", "places", "word", "words", "start", "bytes", "again", "keys", "counts", "firsts")]]
)
BLOCK_TYPES = "block long, doc_ids array<long>, tags array<long>, n_seeds long, " + ", ".join(f"{f.name} binary" for f in list(BLOCKS)[4:])


def blocked(rows: DataFrame, options: ChunkOptions) -> DataFrame:
    """rows (doc_id, tag, text) as blocks of seeds: for each seed in turn its key's number, place and size, in words and in bytes."""

    def block(ids: list, tags: list, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        sizes = np.array([len(f[0]) for f in found], dtype=np.int64)
        begins, ends, digests, start, end, again = (np.concatenate(x) for x in zip(*found, strict=True))
        keys, places, counts = np.unique(digests, return_inverse=True, return_counts=True)
        firsts = np.full(len(keys), _LAST, dtype=np.uint64)
        np.minimum.at(firsts, places, np.repeat(np.array([_ranked(d) for d in ids], dtype=np.uint64), sizes))
        opens = np.zeros(len(begins), dtype=bool)
        opens[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        gaps = lambda x: np.where(opens, x, np.diff(x, prepend=0))  # noqa: E731  places rise within a text
        return row(BLOCKS, {
            "block": new_block(), "doc_ids": ids, "tags": tags, "n_seeds": len(begins), "sizes": coded(sizes), "places": coded(places),
            "word": coded(gaps(begins)), "words": coded(ends - begins), "start": coded(gaps(start)), "bytes": coded(end - start),
            "again": coded(again), "keys": coded(keys, ascending=True), "counts": coded(counts), "firsts": coded(firsts),
        })

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        tags: list = []
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            docs, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, group in grouped(texts_of(batch.column(2))):
                words, bounds = word_hashes(group, lower=False)
                for i, text in enumerate(group):
                    begins, ends, digests = seeds(words[bounds[i] : bounds[i + 1]], options)
                    if not len(begins):
                        continue
                    edge = np.flatnonzero(np.diff(_SPACES[np.frombuffer(text, dtype=np.uint8)].view(np.int8), prepend=1, append=1))
                    again = np.ones(len(begins), dtype=bool)
                    again[np.unique(digests, return_index=True)[1]] = False
                    ids.append(docs[first + i])
                    tags.append(marks[first + i])
                    held.append((begins, ends, digests, edge[0::2][begins], edge[1::2][ends - 1], again))
                    n += len(begins)
                    if n >= options.block_seeds:
                        yield block(ids, tags, held)
                        ids, tags, held, n = [], [], [], 0
        if ids:
            yield block(ids, tags, held)

    return lean(rows).mapInArrow(cut, BLOCK_TYPES)


QUESTIONS = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("firsts", pa.binary())])
QUESTION_TYPES = "range int, block long, keys binary, counts binary, firsts binary"
ANSWERS = pa.schema([("block", pa.int64()), ("range", pa.int32()), ("counts", pa.binary()), ("firsts", pa.binary())])
ANSWER_TYPES = "block long, range int, counts binary, firsts binary"


def counted(blocks: DataFrame, ranges: int) -> DataFrame:
    """For each block and range how often each seed stands anywhere and, of those that repeat, the first document's rank."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in batch.to_pylist():
                keys, counts, firsts = decoded(values["keys"], ascending=True), decoded(values["counts"]), decoded(values["firsts"])
                at = cuts(keys, ranges, BITS)
                for i in range(ranges):
                    if at[i] < at[i + 1]:
                        part = slice(at[i], at[i + 1])
                        yield row(QUESTIONS, {
                            "range": i, "block": values["block"], "keys": coded(keys[part], ascending=True), "counts": coded(counts[part]), "firsts": coded(firsts[part]),
                        })

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [decoded(r["keys"], ascending=True) for r in rows]
        kinds, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(place, weights=np.concatenate([decoded(r["counts"]) for r in rows]).astype(np.float64)).astype(np.int64)
        least = np.full(len(kinds), _LAST, dtype=np.uint64)
        np.minimum.at(least, place, np.concatenate([decoded(r["firsts"]) for r in rows]))
        least[sums < 2] = 0
        parts = np.split(place, np.cumsum([len(k) for k in keys])[:-1])
        columns = [[r["block"] for r in rows], [r["range"] for r in rows], [coded(sums[p]) for p in parts], [coded(least[p]) for p in parts]]
        return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, ANSWERS, strict=True)], schema=ANSWERS)

    return blocks.select("block", "keys", "counts", "firsts").mapInArrow(ask, QUESTION_TYPES).groupBy("range").applyInArrow(answer, ANSWER_TYPES)


PASSAGES = pa.schema(
    [("doc_id", pa.int64()), ("tag", pa.int64()), ("start_byte", pa.int64()), ("n_bytes", pa.int64()), ("n_words", pa.int64()),
     ("n_places", pa.int64()), ("first_doc_id", pa.int64()), ("original", pa.bool_())]
)
PASSAGE_TYPES = "doc_id long, tag long, start_byte long, n_bytes long, n_words long, n_places long, first_doc_id long, original boolean"


def passages(block: dict, counts: np.ndarray, firsts: np.ndarray, options: ChunkOptions) -> list[list]:
    """The columns of a block's passages."""
    sizes = decoded(block["sizes"]).astype(np.int64)
    number = lambda name: decoded(block[name]).astype(np.int64)
    places, doc = number("places"), np.repeat(np.arange(len(sizes)), sizes)
    opens = (np.cumsum(sizes) - sizes)[doc]

    def rising(name: str) -> np.ndarray:
        """Places again, from the first of a text and the gaps after it."""
        upto = np.cumsum(number(name))
        before = np.concatenate(([0], upto))[opens]
        return upto - before

    begin, start = rising("word"), rising("start")
    some = np.flatnonzero(counts[places] > 1)
    if not len(some):
        return [[] for _ in PASSAGES]
    doc, begin, start = doc[some], begin[some], start[some]
    end, stop = begin + number("words")[some], start + number("bytes")[some]
    first, n, again = firsts[places[some]], counts[places[some]], number("again")[some]
    ranks = np.array([_ranked(d) for d in block["doc_ids"]], dtype=np.uint64)
    here = (ranks[doc] == first) & (again == 0)
    gap = begin[1:] - end[:-1]
    apart = (doc[1:] != doc[:-1]) | (gap > options.gap_words) | ((gap > 0) & (first[1:] != first[:-1]))
    head = np.concatenate(([0], np.flatnonzero(apart) + 1))
    last = np.append(head[1:], len(doc)) - 1
    # Words between seeds aren't covered.
    open_words = np.concatenate(([0], np.where(apart, 0, np.maximum(gap, 0))))
    covered = end[last] - begin[head] - np.add.reduceat(open_words, head)
    long = covered >= options.passage_words
    every = np.minimum.reduceat(here.astype(np.int8), head) == 1
    least = np.minimum.reduceat(first, head)
    owner = doc[head][long].tolist()
    told = [None if x == int(_LAST) else x - (1 << 63) for x in least[long].tolist()]
    return [
        [block["doc_ids"][i] for i in owner], [block["tags"][i] for i in owner], start[head][long], (stop[last] - start[head])[long],
        (end[last] - begin[head])[long], np.maximum.reduceat(n, head)[long], told, every[long],
    ]


#: Tells texts apart that share a doc_id.
def _tag(column: str = "text") -> Column:
    return F.xxhash64(text_of(column))


def repeated_passages(docs: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """doc_id, tag, start_byte, n_bytes, n_words, n_places, first_doc_id, original of every repeated passage.

    n_words: from its first to its last word; n_places: the most places that one of its seeds has; first_doc_id: the smallest
    document that holds one of them; original: all its seeds stand here first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tag().alias("tag"), text_of().alias("text"))
    blocks = materialise(blocked(rows, options), "seeds")
    total = blocks.agg(F.coalesce(F.sum("n_seeds"), F.lit(0))).first()[0]
    answers = counted(blocks, max(2 * shuffle_partitions(docs.sparkSession), -(-total // options.range_keys)))

    def join(texts: pa.Table, found: pa.Table) -> pa.Table:
        parts = sorted(found.select(["range", "counts", "firsts"]).to_pylist(), key=lambda r: r["range"])
        counts, firsts = (np.concatenate([decoded(r[c]) for r in parts]) for c in ("counts", "firsts"))
        columns: list[list] = [[] for _ in PASSAGES]
        for block in texts.to_pylist():
            columns = [[*a, *b] for a, b in zip(columns, passages(block, counts.astype(np.int64), firsts, options), strict=True)]
        return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, PASSAGES, strict=True)], schema=PASSAGES)

    return blocks.drop("n_seeds", "keys", "counts", "firsts").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, PASSAGE_TYPES)


def cut_repeats(docs: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """docs with every repeated passage but the original cut out of its text."""
    spans = F.sort_array(F.collect_set(F.struct("start_byte", "n_bytes"))).alias("gone")
    gone = (
        repeated_passages(docs, options)
        .filter("NOT original")
        .groupBy(F.col("doc_id").alias("id"), F.col("tag").alias("of"))
        .agg(spans)
    )
    names = docs.columns
    at_text = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(
                batch.column(at_text).cast(pa.large_binary()).to_pylist(), batch.column(len(names)).to_pylist(), strict=True
            ):
                if spans:
                    kept, at = [], 0
                    for one in spans:
                        kept.append(text[at : one["start_byte"]])
                        at = one["start_byte"] + one["n_bytes"]
                    text = b"".join([*kept, text[at:]])
                texts.append(None if text is None else text.decode())
            columns = [pa.array(texts, type=pa.string()) if i == at_text else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    match = (F.col("row.doc_id") == F.col("id")) & (_tag("row.text") == F.col("of"))
    return wrapped(docs).join(gone, match, "left").select("row.*", "gone").mapInArrow(cut, docs.schema)
