"""Language-model scores by a weighted backoff automaton over word bigrams.

States are the words of the training texts, the start of a text and the root. A bigram that training holds is an arc
from its first word's state, weighted by its smoothed probability; every state has a failure arc to the root, weighted by
the mass left for backing off, and the root has an arc for each word and one for all unknown words. A text is traversed
once, from left to right: each token follows its arc, or the failure arc and then the root's, adds the weights and leads
to its own state, an unknown one to the root.

    P(w | h) = lambda c(h w) / c(h) + (1 - lambda) P(w)        P(w) = (c(w) + 1) / (N + V + 1)

lambda is one minus the Good-Turing estimate of unseen bigrams, the share of training bigrams that occur once. Both
distributions sum to one over the vocabulary and one unknown word.

Texts are packed to blocks where they lie. A block asks for the counts of its words and bigrams by ranges of their
hashes (``exchange``) and gets from all training texts what its automaton needs, so a task holds a block or a range and
no table of the corpus. Keys are the upper 56 bits of 64-bit hashes; two of n kinds share one with a chance of
n * n / 2 ** 57.

Defined results: a null text counts as empty; an empty text has the end token alone; a null doc_id isn't held out and
never trains; rows that repeat count as often as they stand; without training rows every probability is one; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import lean, materialise, shuffle_partitions, text_of
from quillon.llm.exchange import coded, cuts, decoded, new_block, row, summed
from quillon.llm.wordhash import grouped, mix, texts_of, word_hashes


@dataclass(frozen=True)
class ModelOptions:
    folds: int = 7
    held_out: int = 2
    block_tokens: int = 2_000_000
    range_keys: int = 2_000_000


BITS = 56
_DROP = np.uint64(64 - BITS)
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)

BLOCKS = pa.schema(
    [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("roles", pa.binary()), ("sizes", pa.binary()),
     ("places", pa.binary()), ("words", pa.binary()), ("tokens", pa.int64())]
)
BLOCK_TYPES = "block long, doc_ids array<long>, roles binary, sizes binary, places binary, words binary, tokens long"
#: What a document is to the model.
PLAIN, TRAINS, HELD_OUT = 0, 1, 2


def packed(docs: DataFrame, options: ModelOptions) -> DataFrame:
    """docs (doc_id, text, role) as blocks of tokens: numbers into the block's own sorted words."""
    most = options.block_tokens

    def block(ids: list, roles: list, sizes: list[np.ndarray], words: list[np.ndarray]) -> pa.RecordBatch:
        kinds, places = np.unique(np.concatenate(words), return_inverse=True)
        values = {
            "block": new_block(), "doc_ids": ids, "roles": bytes(roles), "sizes": coded(np.concatenate(sizes)),
            "places": coded(places), "words": coded(kinds, ascending=True), "tokens": len(places),
        }
        return row(BLOCKS, values)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        n = 0
        for batch in batches:
            ids, roles = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, group in grouped(texts_of(batch.column(1))):
                words, at = word_hashes(group)
                words = np.insert(words, at[1:], END) >> _DROP
                held[0].extend(ids[first : first + len(group)])
                held[1].extend(roles[first : first + len(group)])
                held[2].append(np.diff(at) + 1)
                held[3].append(words)
                n += len(words)
                if n >= most:
                    yield block(*held)
                    held, n = ([], [], [], []), 0
        if held[0]:
            yield block(*held)

    return lean(docs).mapInArrow(pack, BLOCK_TYPES)


@dataclass
class Block:
    """A block's tokens: documents' sizes and roles, and for each token the number of its word, its history and its bigram."""

    ids: list
    roles: np.ndarray
    sizes: np.ndarray
    words: np.ndarray  # sorted keys
    places: np.ndarray
    pairs: np.ndarray  # sorted keys
    pair_places: np.ndarray

    @staticmethod
    def of(values: dict) -> Block:
        sizes, words = decoded(values["sizes"]).astype(np.int64), decoded(values["words"], ascending=True)
        places = decoded(values["places"]).astype(np.int64)
        tokens = words[places]
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[np.cumsum(sizes) - sizes] = START
        keys = mix(before * np.uint64(3) + tokens) >> _DROP
        pairs, pair_places = np.unique(keys, return_inverse=True)
        return Block(values["doc_ids"], np.frombuffer(values["roles"], dtype=np.uint8), sizes, words, places, pairs, pair_places)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


QUESTIONS = pa.schema(
    [("range", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("word_counts", pa.binary()),
     ("pairs", pa.binary()), ("pair_counts", pa.binary())]
)
QUESTION_TYPES = "range int, block long, words binary, word_counts binary, pairs binary, pair_counts binary"
ANSWERS = pa.schema(
    [("block", pa.int64()), ("range", pa.int32()), ("words", pa.binary()), ("pairs", pa.binary()),
     ("kinds", pa.int64()), ("tokens", pa.int64()), ("once", pa.int64()), ("bigrams", pa.int64())]
)
ANSWER_TYPES = "block long, range int, words binary, pairs binary, kinds long, tokens long, once long, bigrams long"


def counted(blocks: DataFrame, ranges: int) -> DataFrame:
    """For each block and range the training counts of its words and bigrams in their order; one row more for each range, without a
    block, has its sums."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in batch.to_pylist():
                block = Block.of(values)
                trains = np.repeat(block.roles == TRAINS, block.sizes)
                words = np.bincount(block.places[trains], minlength=len(block.words))
                pairs = np.bincount(block.pair_places[trains], minlength=len(block.pairs))
                at, pair_at = cuts(block.words, ranges, BITS), cuts(block.pairs, ranges, BITS)
                for i in range(ranges):
                    w, p = slice(at[i], at[i + 1]), slice(pair_at[i], pair_at[i + 1])
                    if w.start < w.stop or p.start < p.stop:
                        yield row(QUESTIONS, {
                            "range": i, "block": values["block"], "words": coded(block.words[w], ascending=True), "word_counts": coded(words[w]),
                            "pairs": coded(block.pairs[p], ascending=True), "pair_counts": coded(pairs[p]),
                        })

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = []
        sums: list[np.ndarray] = []
        for kind in ("words", "pairs"):
            keys = [decoded(r[kind], ascending=True) for r in rows]
            _, found, places = summed(keys, [decoded(r[f"{kind[:-1]}_counts"]) for r in rows])
            out.append([coded(found[p]) for p in places])
            sums.append(found)
        words, pairs = sums
        own = [r["block"] for r in rows]
        columns = [[*own, None], [r["range"] for r in rows] + [rows[0]["range"]], [*out[0], None], [*out[1], None]]
        totals = (np.count_nonzero(words), words.sum(), np.count_nonzero(pairs == 1), pairs.sum())
        columns += [[*[None] * len(rows), int(x)] for x in totals]
        return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, ANSWERS, strict=True)], schema=ANSWERS)

    asked = blocks.mapInArrow(ask, QUESTION_TYPES)
    return materialise(asked.groupBy("range").applyInArrow(answer, ANSWER_TYPES), "lm-answers")


@dataclass(frozen=True)
class Totals:
    """Training tokens N, their kinds V, bigrams, and those that occur once."""

    tokens: int
    kinds: int
    bigrams: int
    once: int

    @property
    def share(self) -> float:
        """lambda: what a seen bigram weighs."""
        return 1 - (self.once + 1) / (self.bigrams + 1)


class Automaton:
    """The part of the automaton that a block's tokens can reach, as arrays of log10 weights."""

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, totals: Totals):
        self.block, self.seen, self.arcs = block, words, pairs
        self.share = totals.share
        self.probability = (words + 1) / (totals.tokens + totals.kinds + 1)
        self.root = np.log10(self.probability)
        # As many texts start as end. An unknown word leads to the root, which has no failure arc.
        end = np.searchsorted(block.words, END >> _DROP)
        self.starting = int(words[end]) if len(words) else 0

    def walk(self) -> np.ndarray:
        """The weight that each token adds.

        A token alone decides the state after it, so the states of all texts are known at once.
        """
        word = self.block.places
        state = np.concatenate(([0], word[:-1]))
        times = self.seen[state].astype(np.float64)
        times[self.block.starts] = self.starting
        pair = self.arcs[self.block.pair_places]
        weight = self.root[word] + np.where(times > 0, np.log10(1 - self.share), 0.0)
        arc = pair > 0
        mixed = self.share * pair[arc] / times[arc] + (1 - self.share) * self.probability[word[arc]]
        weight[arc] = np.log10(mixed)
        return weight


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scored(blocks: DataFrame, answers: DataFrame, totals: Totals) -> DataFrame:
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = [c.split(" ")[0] for c in SCORES.split(", ")]

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        columns: list = [[] for _ in names]
        for values in texts.to_pylist():
            block = Block.of(values)
            parts = sorted(found.select(["range", "words", "pairs"]).to_pylist(), key=lambda r: r["range"])
            words, pairs = (np.concatenate([decoded(r[k]) for r in parts]).astype(np.int64) for k in ("words", "pairs"))
            automaton = Automaton(block, words, pairs, totals)
            add = lambda x: np.add.reduceat(x, block.starts)  # noqa: E731  every text has its end token
            one = [block.ids, block.roles == HELD_OUT, block.sizes, add((words > 0).astype(np.int64)[block.places])]
            one += [add(automaton.root[block.places]), add(automaton.walk())]
            columns = [[*a, *b] for a, b in zip(columns, one, strict=True)]
        return pa.table([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORES)


def language_scores(docs: DataFrame, options: ModelOptions = ModelOptions()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % options.folds
    role = F.when(fold == options.held_out, HELD_OUT).when(fold.isNotNull(), TRAINS).otherwise(PLAIN)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), role.cast("int").alias("role"))
    blocks = materialise(packed(texts, options), "lm-blocks")
    tokens = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    ranges = max(2 * shuffle_partitions(docs.sparkSession), -(-tokens // options.range_keys))
    answers = counted(blocks, ranges)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "kinds", "bigrams", "once")]
    totals = Totals(**answers.filter("block IS NULL").agg(*sums).first().asDict())
    found = scored(blocks.drop("tokens"), answers.filter("block IS NOT NULL").select("block", "range", "words", "pairs"), totals)
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
