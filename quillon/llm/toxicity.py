"""Toxicity scores from class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary texts, share their backoff counts:

    P_c(w | h) = max(n_c(h w) - D, 0) / n_c(h) + backoff_c(h) P_c(w)
    P_c(w)     = max(n_c(w) - D, 0) / N_c     + backoff_c    P(w)
    P(w)       = distinct words before w / all of them, from both classes together

Every word and word pair of the training rows counts, however rare. Texts are packed to blocks, training rows to blocks of
their own. These send the sorted hashes of their pairs with their counts to ranges of the key space (``exchange``); a range
adds them up and names of each pair one block that owns it, so that blocks can count distinct pairs by word and history. A
block that is scored asks the ranges for its words and pairs and gets counts back in the same order, without keys. Blocks are
made anew from the same texts, to ask and to score, rather than kept: that they are equal is checked. Tables that nothing reads
any more are emptied, and shuffles removed, so that disk holds one step at a time. Words are 56 bits of
a hash and pairs 48: a pair that no training row holds takes the counts of one of n others with a chance of n / 2 ** 48. A
word that no training row holds has no probability under either model and says nothing.

A text's score compares its length-normalised log-likelihoods under both models: their difference per word, the same
against the square root of the length, and the strongest single expressions, weighed by how surely their counts differ, each by P_c(w | h) and by P_c(w) alone
because pairs of a small corpus are sparse; calibrated on training rows whose own counts are taken out of the models
first.

Defined results: a null text counts as empty; a text without words gets the calibrated score of no evidence; rows
without a usable label don't train; a null doc_id isn't held out and never trains; without training rows of both
classes every score is the share of toxic labels; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import lean, materialise, shuffle_partitions, text_of
from quillon.llm.exchange import coded, cuts, decoded, row
from quillon.llm.labelled import with_labels
from quillon.llm.logistic import Logistic, fit
from quillon.llm.wordhash import grouped, mix, texts_of, word_hashes


@dataclass(frozen=True)
class ToxicityOptions:
    discount: float = 0.75
    calibration_rows: int = 20_000  # labelled rows, about, on which the score is calibrated
    strongest: int = 3
    folds: int = 3
    held_out: int = 1
    threshold: float = 0.7
    block_words: int = 1_000_000
    range_bytes: int = 16_000_000  # of texts, about, whose words and pairs a range of keys answers
    turns: int = 2  # ranges are asked by so many turns, so that fewer questions lie on disk at once
    reread: bool = True  # docs give the same rows in the same order each time, as files do; else blocks are written


def fold_of(column: str, folds: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


#: Stands before the first word of a text.
START = np.uint64(0x5354415254)
FEATURES = 7
#: Expressions whose counts deviate by so much count half among the strongest.
DEVIANCE = 20.0
WORD_BITS, PAIR_BITS = 56, 48
#: Of a word, beside its counts: distinct words before it, and in either class how often and before how many distinct
#: words it stands.
MORE = ("befores", "h0", "h1", "f0", "f1")
WORD_COUNTS = ("ordinary", "toxic", *MORE)


def words_before(words: np.ndarray, begins: np.ndarray, start: int | np.uint64 = START) -> np.ndarray:
    """The word before every word; begins: where texts begin."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[begins[begins < len(words)]] = start
    return before


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(3) + words) >> np.uint64(64 - PAIR_BITS)


# --- Blocks of texts -------------------------------------------------------------------------------------------------

_BLOCK = pa.schema(
    [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("own", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()), ("words", pa.binary())]
)
BLOCK_TYPES = "block long, doc_ids array<long>, own binary, sizes binary, places binary, words binary"
#: Stands for a text whose class isn't known or doesn't matter.
NEITHER = 2


def packed(rows: DataFrame, options: ToxicityOptions) -> DataFrame:
    """rows (doc_id, text, own) as blocks of texts: numbers into the block's own words, START among them. The same texts
    make the same block, under the same number."""
    most = options.block_words

    def block(ids: list, own: list, sizes: list[np.ndarray], words: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate(words)
        kinds, places, times = np.unique(np.append(tokens, START), return_inverse=True, return_counts=True)
        # Numbers of frequent words are small: they take less room.
        order = np.lexsort((kinds, -np.frexp(times)[1]))
        number_of = np.empty(len(kinds), dtype=np.int64)
        number_of[order] = np.arange(len(kinds))
        lengths = np.concatenate(sizes).astype(np.uint64)
        known = np.array([0 if i is None else i for i in ids], dtype=np.int64).view(np.uint64)
        # The places of words, sizes and ids count, too.
        each = [(x ^ np.arange(len(x), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(i) for i, x in enumerate((tokens, lengths, known))]
        number = int(mix(np.concatenate(each)).sum(dtype=np.uint64)) >> 1
        values = {
            "block": number, "doc_ids": ids, "own": bytes(NEITHER if c is None else c for c in own), "sizes": coded(lengths),
            "places": coded(number_of[places[:-1]]), "words": coded(kinds[order], ascending=True),
        }
        return row(_BLOCK, values)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        n = 0
        for batch in batches:
            ids, own = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, group in grouped(texts_of(batch.column(1))):
                words, at = word_hashes(group)
                held[0].extend(ids[first : first + len(group)])
                held[1].extend(own[first : first + len(group)])
                held[2].append(np.diff(at))
                held[3].append(words >> np.uint64(64 - WORD_BITS))
                n += len(words) + len(group)
                if n >= most:
                    yield block(*held)
                    held, n = ([], [], [], []), 0
        if held[0]:
            yield block(*held)

    return rows.select("doc_id", "text", "own").mapInArrow(pack, BLOCK_TYPES)


@dataclass(frozen=True)
class Block:
    """Texts of a block: of each word its number, that of the word before it and that of the pair."""

    ids: list
    own: np.ndarray
    sizes: np.ndarray
    words: np.ndarray  # sorted keys
    places: np.ndarray
    before: np.ndarray
    pairs: np.ndarray  # sorted keys
    pair_places: np.ndarray

    @staticmethod
    def of(values: dict) -> Block:
        sizes, words = decoded(values["sizes"]).astype(np.int64), decoded(values["words"], ascending=True)
        order = np.argsort(words)
        number_of = np.empty(len(words), dtype=np.int64)
        number_of[order] = np.arange(len(words))
        words, places = words[order], number_of[decoded(values["places"]).astype(np.int64)]
        before = words_before(places, np.cumsum(sizes) - sizes, np.searchsorted(words, START))
        pairs, pair_places = np.unique(pair_keys(words[before], words[places]), return_inverse=True)
        return Block(values["doc_ids"], np.frombuffer(values["own"], dtype=np.uint8), sizes, words, places, before, pairs, pair_places)

    def by_class(self, places: np.ndarray, n: int) -> list[np.ndarray]:
        """How often each of n words or pairs stands in ordinary and in toxic texts."""
        own = np.repeat(self.own, self.sizes)
        return [np.bincount(places[own == c], minlength=n) for c in (0, 1)]


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r.get(f.name) for r in rows], type=f.type) for f in schema], schema=schema)


def _types(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.float64(): "double"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


# --- Counts of the training rows -------------------------------------------------------------------------------------

_SENT = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("ordinary", pa.binary()), ("toxic", pa.binary())])
#: With a block, which of its pairs of a range it owns; without, all pairs of the range.
_PAIRS = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("owned", pa.binary()), ("keys", pa.binary()), ("ordinary", pa.binary()), ("toxic", pa.binary())])
_WORDS = pa.schema([("range", pa.int32()), ("keys", pa.binary()), *[(c, pa.binary()) for c in WORD_COUNTS]])
_SUMS = pa.schema([("n0", pa.int64()), ("n1", pa.int64()), ("k0", pa.int64()), ("k1", pa.int64()), ("pairs", pa.int64())])
_ALL_WORDS = pa.schema([*_WORDS, *_SUMS])


def _pairs_of(blocks: DataFrame, ranges: int) -> DataFrame:
    """The training pairs of each range, and which of them each block owns: of equal pairs, one block does."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in batch.to_pylist():
                block = Block.of(values)
                ordinary, toxic = block.by_class(block.pair_places, len(block.pairs))
                at = cuts(block.pairs, ranges, PAIR_BITS)
                for i in np.flatnonzero(np.diff(at)).tolist():
                    s = slice(at[i], at[i + 1])
                    yield row(_SENT, {"range": i, "block": values["block"], "keys": coded(block.pairs[s], ascending=True), "ordinary": coded(ordinary[s]), "toxic": coded(toxic[s])})

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [decoded(r["keys"], ascending=True) for r in rows]
        kinds, first, place = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        sums = [np.bincount(place, weights=np.concatenate([decoded(r[c]) for r in rows]).astype(np.float64), minlength=len(kinds)).astype(np.int64) for c in ("ordinary", "toxic")]
        owned = np.zeros(len(place), dtype=np.int64)
        owned[first] = (sums[0] > 0) + 2 * (sums[1] > 0)
        each = np.split(owned, np.cumsum([len(p) for p in parts])[:-1])
        out = [{"range": r["range"], "block": r["block"], "owned": coded(x)} for r, x in zip(rows, each, strict=True)]
        out.append({"range": rows[0]["range"], "keys": coded(kinds, ascending=True), "ordinary": coded(sums[0]), "toxic": coded(sums[1])})
        return _table(out, _PAIRS)

    return blocks.mapInArrow(send, _types(_SENT)).groupBy("range").applyInArrow(add, _types(_PAIRS))


def _words_of(blocks: DataFrame, pairs: DataFrame, ranges: int) -> DataFrame:
    """The training words of each range with their counts, and the range's sums."""

    def send(texts: pa.Table, found: pa.Table) -> pa.Table:
        owned = np.concatenate([decoded(r["owned"]) for r in sorted(found.to_pylist(), key=lambda r: r["range"])] or [np.empty(0, np.uint64)])
        out = []
        for values in texts.to_pylist():
            block = Block.of(values)
            n = len(block.words)
            counts = [*block.by_class(block.places, n)]
            # One occurrence of each pair says which words it is of.
            _, one = np.unique(block.pair_places, return_index=True)
            word, before = block.places[one], block.before[one]
            counts.append(np.bincount(word[owned > 0], minlength=n))
            counts += block.by_class(block.before, n)
            counts += [np.bincount(before[(owned & np.uint64(c)) > 0], minlength=n) for c in (1, 2)]
            at = cuts(block.words, ranges, WORD_BITS)
            for i in np.flatnonzero(np.diff(at)).tolist():
                s = slice(at[i], at[i + 1])
                out.append({"range": i, "keys": coded(block.words[s], ascending=True)} | {c: coded(x[s]) for c, x in zip(WORD_COUNTS, counts, strict=True)})
        return _table(out, _WORDS)

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        kinds, place = np.unique(np.concatenate([decoded(r["keys"], ascending=True) for r in rows]), return_inverse=True)
        total = lambda c: np.bincount(place, weights=np.concatenate([decoded(r[c]) for r in rows]).astype(np.float64), minlength=len(kinds)).astype(np.int64)
        sums = {c: total(c) for c in WORD_COUNTS}
        seen = [sums["ordinary"], sums["toxic"]]
        every = [*[x.sum() for x in seen], *[np.count_nonzero(x) for x in seen], sums["befores"].sum()]
        out = {"range": rows[0]["range"], "keys": coded(kinds, ascending=True)} | {c: coded(x) for c, x in sums.items()}
        return _table([out | {f.name: int(x) for f, x in zip(_SUMS, every, strict=True)}], _ALL_WORDS)

    owned = pairs.filter("block IS NOT NULL").select("block", "range", "owned")
    sent = blocks.groupBy("block").cogroup(owned.groupBy("block")).applyInArrow(send, _types(_WORDS))
    return sent.groupBy("range").applyInArrow(add, _types(_ALL_WORDS))


@dataclass(frozen=True)
class Shares:
    """What the models know of a class as a whole, whatever the size of the corpus."""

    totals: np.ndarray  # words of each class: ordinary, toxic
    kinds: np.ndarray  # distinct words of each class
    pairs: float  # distinct pairs of both classes together
    discount: float
    strongest: int


@dataclass(frozen=True)
class Evidence:
    """Counts of all words and pairs of the training rows: a few rows for each range of keys."""

    pairs: DataFrame
    words: DataFrame
    ranges: int


def count(training: DataFrame, options: ToxicityOptions, ranges: int) -> tuple[Evidence, Shares]:
    """Evidence and shares of all training rows (text, __label)."""
    own = F.col("__label").cast("int").alias("own")
    texts = _frugal(training.select(F.lit(None).cast("long").alias("doc_id"), text_of().alias("text"), own))
    # A block's number says what it holds: equal blocks of equal rows need different ones.
    blocks = packed(texts, options).withColumn("block", F.monotonically_increasing_id())
    blocks = materialise(blocks, "toxicity-training")
    pairs = materialise(_pairs_of(blocks, ranges), "toxicity-pairs")
    words = materialise(_words_of(blocks, pairs, ranges), "toxicity-words")
    _emptied(blocks)
    n0, n1, k0, k1, all_pairs = words.agg(*[F.coalesce(F.sum(f.name), F.lit(0)) for f in _SUMS]).first()
    shares = Shares(np.array([n0, n1], float), np.array([k0, k1], float), max(float(all_pairs), 1.0), options.discount, options.strongest)
    return Evidence(pairs.filter("block IS NULL"), words, ranges), shares


def learn(training: DataFrame, options: ToxicityOptions) -> tuple[DataFrame, Shares]:
    """(key, toxic, ordinary, more) of all words and pairs of training rows (text, __label), and the shares.

    more: null for pairs; for words the distinct words before them and, in either class, their counts and followers as a history.
    """
    evidence, shares = count(training, options, 2 * shuffle_partitions(training.sparkSession))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                columns = [pa.array(decoded(r["keys"], ascending=True).view(np.int64)), *[pa.array(decoded(r[c]).view(np.int64)) for c in ("toxic", "ordinary")]]
                if r.get("befores") is None:
                    more = pa.nulls(len(columns[0]), pa.list_(pa.int64()))
                else:
                    flat = np.stack([decoded(r[c]).view(np.int64) for c in MORE], axis=1).reshape(-1)
                    more = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(MORE)), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*columns, more], names=["key", "toxic", "ordinary", "more"])

    both = evidence.words.select("keys", *WORD_COUNTS).unionByName(evidence.pairs.select("keys", "ordinary", "toxic"), allowMissingColumns=True)
    return both.mapInArrow(expand, "key long, toxic long, ordinary long, more array<bigint>"), shares


def _frugal(df: DataFrame) -> DataFrame:
    """df in a session whose Arrow batches are small and whose shuffles are removed as each table is written."""
    own = lean(df)
    own.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return own


def _emptied(table: DataFrame) -> None:
    """Empty a materialised table that nothing reads any more."""
    if files := table.inputFiles():
        table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


# --- Models ----------------------------------------------------------------------------------------------------------


#: Of a text's words: what tells them, the words before them and the pairs apart.
Ids = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Of the same: counts, distinct words before, counts and followers of the word before as a history, counts of the pair.
Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Models:
    """The models as far as some texts need them; keys are sorted."""

    words: np.ndarray
    word_counts: np.ndarray  # (2, words): ordinary, toxic
    more: np.ndarray  # (len(MORE), words)
    pairs: np.ndarray
    pair_counts: np.ndarray
    shares: Shares

    @staticmethod
    def of(table: pa.Table, shares: Shares) -> Models:
        """From rows (key, toxic, ordinary, more)."""
        table = table.combine_chunks()
        keys = table["key"].to_numpy().view(np.uint64)
        counts = np.stack([table[c].to_numpy() for c in ("ordinary", "toxic")]).astype(np.float64)
        is_pair = table["more"].is_null().to_numpy()
        more = table["more"].filter(pa.array(~is_pair)).combine_chunks().flatten().to_numpy()
        more = more.reshape(-1, len(MORE)).T.astype(np.float64)
        words, pairs = np.flatnonzero(~is_pair), np.flatnonzero(is_pair)
        by_word, by_pair = np.argsort(keys[words]), np.argsort(keys[pairs])
        words, pairs = words[by_word], pairs[by_pair]
        return Models(keys[words], counts[:, words], more[:, by_word], keys[pairs], counts[:, pairs], shares)

    def features(self, ids: Ids, got: Found, own: int | None = None) -> np.ndarray:
        """(difference per word, the same by the root of the length, sum of the strongest), by pairs and by words alone, and log length.

        own: the class in whose counts this text is contained and from which it is taken out.
        """
        n = len(ids[0])
        if not n:
            return np.zeros(FEATURES)
        both, single, known, pair, counts, totals = self.mixed(ids, got, own)
        most = self.shares.strongest
        out = []
        # A pair that no training row holds has the evidence of its word.
        for one, seen in ((both, np.where(pair.sum(axis=0) > 0, pair, counts)), (single, counts)):
            ratio = np.zeros(n)
            ratio[known] = np.log(one[1, known]) - np.log(one[0, known])
            sure = ratio * _certainty(seen, totals)
            top = np.partition(sure, n - most)[-most:] if n > most else sure
            out += [ratio.mean(), ratio.sum() / n**0.5, np.sort(top).sum()]
        return np.array([*out, np.log1p(n)])

    def at(self, places: np.ndarray, before: np.ndarray, pairs: np.ndarray) -> Found:
        """What the models hold of words, of those before them and of pairs, by their numbers."""
        return self.word_counts[:, places], self.more[0, places], self.more[1:3, before], self.more[3:5, before], self.pair_counts[:, pairs]

    def probabilities(self, words: np.ndarray, own: int | None = None) -> tuple[np.ndarray, ...]:
        """``mixed`` of the hashes of a text's words."""
        words = words >> np.uint64(64 - WORD_BITS)
        before = words_before(words, np.zeros(1, dtype=np.int64))
        keys = pair_keys(before, words)
        got = (
            _found(self.words, words, self.word_counts), _found(self.words, words, self.more[:1])[0], _found(self.words, before, self.more[1:3]),
            _found(self.words, before, self.more[3:5]), _found(self.pairs, keys, self.pair_counts),
        )
        return self.mixed((words, before, keys), got, own)

    def mixed(self, ids: Ids, got: Found, own: int | None = None) -> tuple[np.ndarray, ...]:
        """P_c(w | h) and P_c(w) of a text's words in both classes, which words the training rows hold, and the counts of
        pairs, of words and of all words in either class.
        """
        words, before, keys = ids
        counts, befores, history, followers, pair = got
        n = len(words)
        totals, kinds, all_pairs = self.shares.totals.copy(), self.shares.kinds.copy(), self.shares.pairs
        if own is not None:
            counts[own] -= _times(words)
            history[own] -= _times(before)
            pair[own] -= _times(keys)
            totals[own] -= n
            # Pairs that only this text holds, in its class or at all.
            _, first = np.unique(keys, return_index=True)
            followers[own] -= _among(before, before[first[pair[own, first] <= 0]])
            alone = first[pair[:, first].sum(axis=0) <= 0]
            befores -= _among(words, words[alone])
            all_pairs -= len(alone)
            kinds[own] -= len(np.unique(words[counts[own] <= 0]))
        totals = np.maximum(totals, 1)
        backoff = np.clip(self.shares.discount * kinds / totals, 1e-6, 1)
        shared = np.maximum(befores, 0) / max(all_pairs, 1)
        discount = self.shares.discount
        single = np.maximum(counts - discount, 0) / totals[:, None] + backoff[:, None] * shared
        taken = np.maximum(pair - discount, 0) / np.maximum(history, 1)
        left = np.where(history > 0, discount * followers / np.maximum(history, 1), 1.0)
        both = taken + left * single
        return both, single, shared > 0, pair, counts, totals


def _certainty(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """From 0 to 1, by the deviance of an expression's counts from the sizes of the classes: a few occurrences prove little."""
    expected = counts.sum(axis=0) * (totals / totals.sum())[:, None]
    deviance = 2 * (counts * np.log(np.maximum(counts, 1e-9) / np.maximum(expected, 1e-9))).sum(axis=0)
    return np.maximum(deviance, 0) / (np.maximum(deviance, 0) + DEVIANCE)


def _found(table: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The columns of values at each key; zeros where the sorted table doesn't hold it."""
    if not len(table):
        return np.zeros((len(values), len(keys)))
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[:, at], 0.0)


def _times(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs."""
    _, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    return times[place]


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """How often each key occurs among some others."""
    kinds, times = np.unique(some, return_counts=True)
    return _found(kinds, keys, times[None, :].astype(np.float64))[0]


# --- Questions and answers -------------------------------------------------------------------------------------------

_ASKED = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary())])
_ANSWERS = pa.schema([("block", pa.int64()), ("range", pa.int32()), *[(c, pa.binary()) for c in ("words", *WORD_COUNTS, "pairs", "pair_ordinary", "pair_toxic")]])


def _looked_up(table: np.ndarray, values: list[np.ndarray], keys: np.ndarray) -> list[bytes]:
    """Which of the keys the sorted table holds, as bits, and their values, coded."""
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    held = table[at] == keys if len(table) else np.zeros(len(keys), dtype=bool)
    return [len(keys).to_bytes(8, "little") + np.packbits(held).tobytes(), *[coded(x[at[held]]) for x in values]]


def _spread(held: bytes, values: list[bytes]) -> np.ndarray:
    """Values at each key; zeros where the table doesn't hold it."""
    n = int.from_bytes(held[:8], "little")
    some = np.unpackbits(np.frombuffer(held[8:], dtype=np.uint8), count=n).astype(bool)
    out = np.zeros((len(values), n), dtype=np.uint64)
    for x, value in zip(out, values, strict=True):
        x[some] = decoded(value)
    return out


def _lessened(counts: list[np.ndarray]) -> list[np.ndarray]:
    """WORD_COUNTS as differences, of which most are 0: words stand mostly before others, rare ones in different pairs."""
    ordinary, toxic, befores, h0, h1, f0, f1 = counts
    return [ordinary, toxic, ordinary + toxic - befores, ordinary - h0, toxic - h1, h0 - f0, h1 - f1]


def _restored(counts: np.ndarray) -> np.ndarray:
    ordinary, toxic, fewer, less0, less1, again0, again1 = counts
    h0, h1 = ordinary - less0, toxic - less1
    return np.stack([ordinary, toxic, ordinary + toxic - fewer, h0, h1, h0 - again0, h1 - again1])


def answered(blocks: DataFrame, evidence: Evidence, turn: int, turns: int) -> DataFrame:
    """For each block and range the counts of its words and pairs, in their order; a turn asks every so-many-th range."""
    ranges = evidence.ranges

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in batch.to_pylist():
                block = Block.of(values)
                at, pair_at = cuts(block.words, ranges, WORD_BITS), cuts(block.pairs, ranges, PAIR_BITS)
                for i in range(turn, ranges, turns):
                    words, pairs = block.words[at[i] : at[i + 1]], block.pairs[pair_at[i] : pair_at[i + 1]]
                    yield row(_ASKED, {"range": i, "block": values["block"], "words": coded(words, ascending=True), "pairs": coded(pairs, ascending=True)})

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        none = np.empty(0, dtype=np.uint64)
        words, pairs, word_counts, pair_counts = none, none, [none] * len(WORD_COUNTS), [none] * 2
        for r in held.to_pylist():
            if r["befores"] is None:
                pairs, pair_counts = decoded(r["keys"], ascending=True), [decoded(r[c]) for c in ("ordinary", "toxic")]
            else:
                words, word_counts = decoded(r["keys"], ascending=True), _lessened([decoded(r[c]) for c in WORD_COUNTS])
        out = []
        for r in asked.to_pylist():
            found = _looked_up(words, word_counts, decoded(r["words"], ascending=True)) + _looked_up(pairs, pair_counts, decoded(r["pairs"], ascending=True))
            out.append({"block": r["block"], "range": r["range"]} | dict(zip(_ANSWERS.names[2:], found, strict=True)))
        return _table(out, _ANSWERS)

    held = evidence.words.select("range", "keys", *WORD_COUNTS).unionByName(evidence.pairs.select("range", "keys", "ordinary", "toxic"), allowMissingColumns=True)
    held = held.filter(F.col("range") % turns == turn)
    return blocks.mapInArrow(ask, _types(_ASKED)).groupBy("range").cogroup(held.groupBy("range")).applyInArrow(answer, _types(_ANSWERS))


_MEASURED = pa.schema([("doc_id", pa.int64()), ("own", pa.int32()), *[(c, pa.float64()) for c in "abcdefg"]])


def measured(blocks: DataFrame, answers: DataFrame, shares: Shares) -> DataFrame:
    """doc_id, own and the features a to g of every text, without own; texts whose own class is given have a second row, with it, whose
    features are those without the text's own counts."""

    def measure(texts: pa.Table, found: pa.Table) -> pa.Table:
        parts = {r["range"]: r for r in found.to_pylist()}  # equal blocks have equal answers
        parts = [parts[k] for k in sorted(parts)]
        ids, own, out = [], [], []
        of_words = [_restored(_spread(r["words"], [r[c] for c in WORD_COUNTS])) for r in parts]
        of_pairs = [_spread(r["pairs"], [r["pair_ordinary"], r["pair_toxic"]]) for r in parts]
        word_counts, pair_counts = (np.concatenate([x.astype(np.float64) for x in parts], axis=1) for parts in (of_words, of_pairs))
        for values in texts.to_pylist():
            block = Block.of(values)
            if word_counts.shape[1] != len(block.words) or pair_counts.shape[1] != len(block.pairs):
                raise RuntimeError("texts differ from those that were read before: use ToxicityOptions(reread=False)")
            models = Models(block.words, word_counts[:2], word_counts[2:], block.pairs, pair_counts, shares)
            ends = np.cumsum(block.sizes)
            for doc, c, a, b in zip(block.ids, block.own.tolist(), (ends - block.sizes).tolist(), ends.tolist(), strict=True):
                at = block.places[a:b], block.before[a:b], block.pair_places[a:b]
                for kind in (None,) if c == NEITHER else (None, c):
                    ids.append(doc)
                    own.append(kind)
                    out.append(models.features(at, models.at(*at), kind))
        features = np.array(out).reshape(-1, FEATURES)
        columns = [pa.array(ids, type=pa.int64()), pa.array(own, type=pa.int32()), *[pa.array(x) for x in features.T.copy()]]
        return pa.table(columns, schema=_MEASURED)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(measure, _types(_MEASURED))


def _drawn(training: DataFrame, options: ToxicityOptions) -> DataFrame:
    """doc_id, own of about ``calibration_rows`` training rows, drawn by the hash of their ids: few, whatever the corpus."""
    rows = training.count()
    share = min(1.0, options.calibration_rows / max(rows, 1))
    drawn = training.filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    return drawn.groupBy(F.col("doc_id").alias("__drawn")).agg(F.max("__label").cast("int").alias("own"))


def calibrate(features: DataFrame) -> Logistic:
    """The score, fitted on the rows whose own class is given."""
    table = features.filter("own IS NOT NULL").toArrow()
    found = np.column_stack([table[c].to_numpy() for c in "abcdefg"]) if len(table) else np.zeros((0, FEATURES))
    order = np.lexsort(found.T)  # sums don't depend on the order in which blocks arrive
    return fit(found[order], table["own"].to_numpy()[order])


def toxicity(docs: DataFrame, labels: DataFrame, options: ToxicityOptions = ToxicityOptions()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    narrow = docs.select("doc_id", "text")
    training = with_labels(narrow, labels, "toxic").filter(fold_of("doc_id", options.folds) != options.held_out)
    size = narrow.agg(F.coalesce(F.sum(F.octet_length(text_of())), F.lit(0))).first()[0]
    ranges = max(2 * shuffle_partitions(docs.sparkSession), -(-size // options.range_bytes))
    evidence, shares = count(training, options, ranges)
    own = narrow.join(F.broadcast(_drawn(training, options)), F.col("doc_id") == F.col("__drawn"), "left")
    texts = _frugal(own.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), "own"))
    blocks = packed(texts, options)
    if not options.reread:
        blocks = materialise(blocks, "toxicity-blocks")
    parts = [materialise(answered(blocks, evidence, turn, options.turns), "toxicity-answers") for turn in range(options.turns)]
    _emptied(evidence.pairs)
    _emptied(evidence.words)
    features = materialise(measured(blocks, reduce(DataFrame.unionByName, parts), shares), "toxicity-features")
    for part in parts:
        _emptied(part)
    model = calibrate(features)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(np.column_stack([batch.column(i).to_numpy() for i in range(1, FEATURES + 1)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    scored = features.filter("own IS NULL").drop("own").mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(fold_of("doc_id", options.folds) == options.held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= options.threshold).cast("int").alias("predicted"),
    )
