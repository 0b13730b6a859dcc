"""Many phrases found in many texts at once, whatever their case.

The phrases of a glossary are built into an automaton that reads a text once and names every occurrence, however many phrases
there are. Glossaries go to the tasks in shards of bounded size, one automaton for each; texts stay where they lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from quillon.operators import prefix

#: Phrases of one automaton: what a task holds of a glossary.
SHARD = 200_000
#: Occurrences that a task holds before it hands them on.
HITS = 20_000


@lru_cache(maxsize=65_536)
def _folded(c: str) -> str:
    """The character that c equals whatever its case; always one, so that places stay."""
    for one in (c.casefold(), c.lower()):
        if len(one) == 1:
            return one
    return c


def folded(text: str) -> str:
    low = text.casefold()
    return low if len(low) == len(text) else "".join(map(_folded, text))


class Phrases:
    """An automaton over phrases; each has a number, in the order given."""

    def __init__(self, phrases: list[str]):
        import ahocorasick

        self.sizes = [len(p) for p in phrases]
        numbers: dict[str, list[int]] = {}
        for i, phrase in enumerate(phrases):
            numbers.setdefault(folded(phrase), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for phrase, same in numbers.items():
            self.automaton.add_word(phrase, same)
        self.automaton.make_automaton()
        self.some = bool(numbers)

    def hits(self, text: str) -> Iterator[tuple[int, int]]:
        """(number, start) of all occurrences; those of one phrase don't overlap, the leftmost counts."""
        if not self.some:
            return
        taken: dict[int, int] = {}
        for end, numbers in self.automaton.iter(folded(text)):
            for i in numbers:
                start = end + 1 - self.sizes[i]
                if start >= taken.get(i, 0):
                    taken[i] = end + 1
                    yield i, start


    def held(self, text: str) -> Iterator[list[int]]:
        """The numbers of phrases that stand somewhere in text, those that end at a place together; the same ones may come again."""
        return (numbers for _, numbers in self.automaton.iter(folded(text))) if self.some and text else iter(())


_built: dict[int, Phrases] = {}


def _phrases(shared: Broadcast, at: int) -> Phrases:
    """The automaton of a broadcast shard, built once in a worker; at: where a row has its phrase."""
    if shared.bid not in _built:  # type: ignore[attr-defined]
        _built.clear()
        _built[shared.bid] = Phrases([row[at] for row in shared.value])  # type: ignore[attr-defined]
    return _built[shared.bid]  # type: ignore[attr-defined]


class _Shared:
    """A broadcast and its id, which a Broadcast doesn't carry to the workers."""

    def __init__(self, broadcast: Broadcast, bid: int):
        self.broadcast, self.bid = broadcast, bid

    @property
    def value(self):
        return self.broadcast.value


_count = iter(range(1 << 62))


def _shards(glossary: DataFrame, columns: list[str], size: int) -> Iterator[_Shared]:
    """glossary in broadcast shards of about `size` rows, each sorted by its columns; shards follow one another in that order."""
    spark = glossary.sparkSession
    rows = glossary.select(*columns)
    n = rows.count()
    if n <= size:
        parts = [rows]
    else:
        blocks = prefix.dealt(rows, columns, -(-n // size), "glossary")
        parts = [blocks.filter(F.col(prefix.BLOCK) == i).select(*columns) for i in range(-(-n // size))]
    for part in parts:
        held = sorted(tuple(r) for r in part.collect())  # bounded: a shard
        yield _Shared(spark.sparkContext.broadcast(held), next(_count))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array([folded(v) for v in batch.column(0).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=["variant", "canonical", "key"])


def find_phrases(texts: DataFrame, id_column: str, text_column: str, glossary: DataFrame, shard: int = SHARD) -> DataFrame:
    """id, variant, canonical, start, end, found: every occurrence of the variants (variant, canonical) in texts, as code points.

    Occurrences of one variant don't overlap; of variants that differ by case only, and of one canonical term, the first counts.
    Blank variants find nothing, and a null text holds nothing.
    """
    id_type = texts.schema[id_column].dataType
    schema = f"{id_column} {id_type.simpleString()}, variant string, canonical string, start long, end long, found string"
    arrow = pa.schema(
        [(id_column, to_arrow_type(id_type)), ("variant", pa.string()), ("canonical", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("found", pa.string())]
    )
    trimmed = lambda c: F.trim(F.col(c).cast("string"))
    usable = glossary.select(trimmed("variant").alias("variant"), trimmed("canonical").alias("canonical")).filter("variant <> '' AND canonical IS NOT NULL")
    usable = usable.mapInArrow(_keyed, "variant string, canonical string, key string").groupBy("key", "canonical").agg(F.min("variant").alias("variant"))
    narrow = texts.select(F.col(id_column), F.col(text_column).cast("string"))
    out = None
    for shared in _shards(usable, ["variant", "canonical"], shard):

        def find(batches: Iterator[pa.RecordBatch], shared: _Shared = shared) -> Iterator[pa.RecordBatch]:
            phrases, rows = _phrases(shared, 0), shared.value
            for batch in batches:
                places: list[int] = []
                columns: tuple[list, ...] = ([], [], [], [], [])

                def told(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                    arrays = [batch.column(0).take(pa.array(places, type=pa.int64())), *(pa.array(c, type=f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))]
                    return pa.RecordBatch.from_arrays([arrays[0].cast(arrow.field(0).type), *arrays[1:]], schema=arrow)

                for i, value in enumerate(batch.column(1)):
                    text = value.as_py() or ""
                    for number, start in phrases.hits(text):
                        variant, canonical = rows[number]
                        end = start + len(variant)
                        places.append(i)
                        for column, x in zip(columns, (variant, canonical, start, end, text[start:end]), strict=True):
                            column.append(x)
                        if len(places) >= HITS:
                            yield told()
                            for one in (places, *columns):
                                one.clear()
                yield told()

        found = narrow.mapInArrow(find, schema)
        out = found if out is None else out.unionByName(found)
    return out


def held_terms(texts: DataFrame, id_column: str, text_column: str, glossary: DataFrame, shard: int = SHARD) -> DataFrame:
    """id, canonical: which terms of a glossary (variant, canonical) the texts of an id hold, each once, without their places."""
    schema = f"{id_column} {texts.schema[id_column].dataType.simpleString()}, canonical string"
    kinds = [to_arrow_type(texts.schema[id_column].dataType), pa.string()]
    trimmed = lambda c: F.trim(F.col(c).cast("string"))
    usable = glossary.select(trimmed("variant").alias("variant"), trimmed("canonical").alias("canonical")).filter("variant <> '' AND canonical IS NOT NULL")
    narrow = texts.select(F.col(id_column), F.col(text_column).cast("string"))
    out = None
    for shared in _shards(usable.distinct(), ["variant", "canonical"], shard):

        def find(batches: Iterator[pa.RecordBatch], shared: _Shared = shared) -> Iterator[pa.RecordBatch]:
            phrases, rows = _phrases(shared, 0), shared.value
            for batch in batches:
                held: dict[object, set[int]] = {}
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    numbers = held.setdefault(key, set())
                    for same in phrases.held(text or ""):
                        numbers.update(same)
                pairs = {(key, rows[i][1]) for key, numbers in held.items() for i in numbers}
                columns = zip(*pairs, strict=True) if pairs else [[]] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=[id_column, "canonical"])

        found = narrow.mapInArrow(find, schema)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


#: A variant of these characters stands between other characters than letters and digits (a fixed value).
PLAIN = re.compile(r"[A-Za-z0-9.+_-]+")


@lru_cache(maxsize=10_000)
def _pattern(variant: str) -> re.Pattern:
    quoted = re.escape(variant)
    return re.compile(rf"(?<![A-Za-z0-9]){quoted}(?![A-Za-z0-9])" if PLAIN.fullmatch(variant) else quoted, re.IGNORECASE)


def normalized_text(text: str, phrases: Phrases, terms: list[tuple[int, str, str]]) -> tuple[str, list[str]]:
    """text with the terms (-length, variant, canonical) replaced one after another, and which of them changed it.

    A replacement may bring about later variants: the text is read again when it has changed. What it doesn't hold is skipped.
    """
    changes: list[str] = []
    at = -1
    waiting = sorted({i for i, _ in phrases.hits(text)})
    while waiting:
        at = waiting.pop(0)
        _, variant, canonical = terms[at]
        after = _pattern(variant).sub(lambda _, c=canonical: c, text)
        if after != text:
            text = after
            changes.append(f"{variant}->{canonical}")
            waiting = sorted({i for i, _ in phrases.hits(text) if i > at})
    return text, changes


def normalized_terms(texts: DataFrame, glossary: DataFrame, shard: int = SHARD) -> DataFrame:
    """id, text, changes of texts (id, text) with glossary variants (variant, canonical) replaced, the longest first, whatever their case.

    A variant of ASCII letters, digits and their marks stands between other characters than letters and digits. Variants of one
    character, and those that are the canonical term in lower case, are left alone; of several canonical terms of a variant the first
    counts; a null text stays null. Shards follow one another by length, so a large glossary gives what one pass would.
    """
    usable = (
        glossary.filter((F.length("variant") >= 2) & (F.col("variant") != F.lower("canonical")))
        .groupBy("variant").agg(F.min("canonical").alias("canonical"))
        .select((-F.length("variant")).alias("order"), "variant", "canonical")
    )
    id_type = texts.schema["id"].dataType.simpleString()
    schema = StructType.fromDDL(f"id {id_type}, text string, changes array<string>")
    arrow = pa.schema([("id", to_arrow_type(schema["id"].dataType)), ("text", pa.string()), ("changes", pa.list_(pa.string()))])
    out = texts.select("id", F.col("text").cast("string").alias("text"), F.array().cast("array<string>").alias("changes"))
    for shared in _shards(usable, ["order", "variant", "canonical"], shard):

        def replace(batches: Iterator[pa.RecordBatch], shared: _Shared = shared) -> Iterator[pa.RecordBatch]:
            phrases, terms = _phrases(shared, 1), shared.value
            for batch in batches:
                done, notes = [], []
                for value, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    after, changes = (None, []) if value is None else normalized_text(value, phrases, terms)
                    done.append(after)
                    notes.append([*known, *changes])
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), pa.array(done, pa.string()), pa.array(notes, pa.list_(pa.string()))], schema=arrow)

        out = out.mapInArrow(replace, schema)
    return out
