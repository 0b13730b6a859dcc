"""What is asked of an external search about a transcript: known terms, names, introduced terms, and claims with numbers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillon.functions import text as T
from quillon.operators.phrases import held_terms
from quillon.sources.storage import written

# What counts as a name, an acronym, the introduction of a term and a number with its unit; the ends of a query.
NAME = re.compile(r"\b(?:[A-Z][A-Za-z0-9.+_-]{1,}|[A-Za-z]+\d+[A-Za-z0-9.+_-]*)\b")
ACRONYM = re.compile(r"\b[A-Z][A-Z0-9_-]{1,15}\b")
INTRODUCED = re.compile(r"(?:称为|叫做|简称|专业术语|模型|框架|插件|工具|系统)[：:、，,\s]*([㐀-鿿A-Za-z][㐀-鿿A-Za-z0-9.+_-]{1,23})")
NUMBER = re.compile(r"\d+(?:\.\d+)?\s*(?:%|％|倍|万|亿|GB|MB|ms|秒|分钟|小时|条|页)", re.IGNORECASE)
ENDS = " ，,。；;：:"
SUFFIX = {"short": " 官方 文档", "long": " 来源"}
RADIUS = 36

KNOWN, NAMED, TERM, CLAIM = range(4)


def mentions(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(stream, kind, place, words) of a text's introduced terms, and claims around numbers."""
    for m in INTRODUCED.finditer(text):
        yield TERM, 0, m.start(), m.group(1)
    for m in NUMBER.finditer(text):
        around = " ".join(text[max(0, m.start() - RADIUS) : m.end() + RADIUS].split()).strip(ENDS)
        if 4 <= len(around) <= 100:
            yield CLAIM, 0, m.start(), around


def names_of(texts: list[tuple[int, str]]) -> Iterator[tuple[str, int, int, int, int]]:
    """(words, kind, ordinal, place, n) of the names and acronyms of a run's texts (ordinal, text): each once, where it stands first.

    A place is the number of the name in its text. Names come before acronyms; what is both counts twice.
    """
    counts: Counter[str] = Counter()
    first: dict[str, tuple[int, int, int]] = {}
    ordered = sorted(texts, reverse=True)
    for kind, pattern in ((1, ACRONYM), (0, NAME)):  # what comes first is written last
        for ordinal, text in ordered:
            found = pattern.findall(text)
            counts.update(found)
            found.reverse()
            first.update(zip(found, zip(repeat(kind), repeat(ordinal), range(len(found) - 1, -1, -1))))
    for words, (kind, ordinal, place) in first.items():
        yield words, kind, ordinal, place, counts[words]


FIELDS = "stream int, kind int, ordinal long, place long, words string, n long"


def _mentions(segments: DataFrame) -> DataFrame:
    """The mentions of each run, equal ones of a batch as one with their number and the first one's place."""
    run = segments.schema["run_id"].dataType
    names = ["run_id", *(f.split(" ")[0] for f in FIELDS.split(", "))]
    kinds = [to_arrow_type(run), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, list[int]] = {}
            runs: dict[object, list[tuple[int, str]]] = {}
            for run_id, ordinal, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text:
                    runs.setdefault(run_id, []).append((ordinal, text))
                for stream, kind, place, words in mentions(text or ""):
                    one = held.setdefault((run_id, stream, kind, words), [ordinal, place, 0])
                    one[:2] = min(one[:2], [ordinal, place])
                    one[2] += 1
            rows = [(r, s, k, o, p, w, n) for (r, s, k, w), (o, p, n) in held.items()]
            for run_id, texts in runs.items():
                rows += [(run_id, NAMED, k, o, p, w, n) for w, k, o, p, n in names_of(texts)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return segments.select("run_id", F.col("ordinal").cast("long"), F.col("text").cast("string")).mapInArrow(find, f"run_id {run.simpleString()}, {FIELDS}")


def external_queries(segments: DataFrame, glossary: DataFrame | None = None, most: int = 12) -> DataFrame:
    """run_id, rank, query of transcripts (run_id, ordinal, text), at most `most` of a run and no two alike whatever their case.

    First the terms of a glossary (canonical, variant, position) that stand in the run under any of their names; then names and acronyms,
    the most frequent first, of equal ones that which comes first, names before acronyms; then introduced terms and claims in their order. A
    claim has so many characters around its number, never a paragraph. A null text holds nothing.
    """
    found = written(_mentions(segments), "mentions")  # read for names, and for the rest
    named = (
        found.filter(F.col("stream") == NAMED).groupBy("run_id", "words")
        .agg(F.sum("n").alias("n"), F.min(F.struct("kind", "ordinal", "place")).alias("first"))
        .withColumn("a", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("n"), "first")).cast("long"))
        .filter(F.col("a") <= 2 * most)
        .select("run_id", F.lit(NAMED).alias("stream"), "a", F.lit(0).cast("long").alias("b"), "words")
    )
    rest = found.filter(F.col("stream") > NAMED).select("run_id", "stream", F.col("ordinal").alias("a"), F.col("place").alias("b"), "words")
    candidates = named.unionByName(rest)
    if glossary is not None:
        glossary = written(glossary.select("canonical", "variant", "position"), "glossary")  # read three times
        both = glossary.select("canonical", "variant").unionByName(glossary.select("canonical", F.col("canonical").alias("variant")))
        hits = held_terms(segments, "run_id", "text", both)
        places = glossary.groupBy(F.trim("canonical").alias("canonical")).agg(F.min("position").cast("long").alias("a"))
        known = hits.join(places, "canonical")
        candidates = known.select("run_id", F.lit(KNOWN).alias("stream"), "a", F.lit(0).cast("long").alias("b"), F.col("canonical").alias("words")).unionByName(candidates)
    clean = candidates.withColumn("words", T.collapse(F.col("words"))).filter(F.length("words") >= 2)
    first = clean.groupBy("run_id", T.fold(F.col("words")).alias("folded")).agg(F.min(F.struct("stream", "a", "b", "words")).alias("c"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy("c", "folded"))).filter(F.col("rank") <= most)
    suffix = F.when(F.length("c.words") <= 36, SUFFIX["short"]).otherwise(SUFFIX["long"])
    return ranked.select("run_id", "rank", F.substring(F.concat("c.words", suffix), 1, 160).alias("query"))
