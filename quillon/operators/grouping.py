"""Ordered grouping whose breaks depend on what the group already holds: chunks, cues, paragraphs, correction cores.

Rows are dealt by key and sorted within their partition, and a fold reads them as a stream of Arrow batches: a task holds
one batch and the few numbers that its open group needs, however long a recording is. Texts aren't held either; their
sizes are counted by built-in functions before.

Chunks of text come from prefix sums over its characters, so every size that packing asks for is a subtraction.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import ids
from quillon.functions import text as T

#: From the values that a group remembers (empty for a new one) and a row: whether the row begins another group.
Breaks = Callable[[dict, dict], bool]
#: What the group remembers after it took a row.
Takes = Callable[[dict, dict], dict]


def in_order(rows: DataFrame, by: list[str], order: list[str], needs: list[str]) -> DataFrame:
    """__item (all columns), the key and what a fold needs, dealt by key and sorted."""
    item = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__item")
    key = F.to_json(F.struct(*[F.col(f"`{c}`") for c in by])).alias("__key")
    return rows.select(key, item, *[F.col(f"`{c}`").alias(f"__{c}") for c in needs], *[F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(order)]).repartition(
        "__key"
    ).sortWithinPartitions("__key", *[f"__o{i}" for i in range(len(order))])


def fold_groups(rows: DataFrame, by: list[str], order: list[str], needs: list[str], breaks: Breaks, takes: Takes) -> DataFrame:
    """rows with group_no, from 0 on within each key."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, group = None, {}, -1
        for batch in batches:
            numbers = []
            columns = [batch.column(f"__{c}").to_pylist() for c in needs]
            for at, values in zip(batch.column("__key").to_pylist(), zip(*columns, strict=True), strict=True):
                row = dict(zip(needs, values, strict=True))
                if at != key:
                    key, held, group = at, {}, -1
                if not held or breaks(held, row):
                    held, group = {}, group + 1
                held = takes(held, row)
                numbers.append(group)
            yield pa.RecordBatch.from_arrays([batch.column("__item"), pa.array(numbers, type=pa.int32())], names=["__item", "group_no"])

    ordered = in_order(rows, by, order, needs)
    kind = ordered.schema["__item"].dataType.simpleString()
    return ordered.mapInArrow(number, f"__item {kind}, group_no int").select("__item.*", "group_no")


def _differs(a: Any, b: Any) -> bool:
    """Of two known values; a missing one differs from nothing."""
    return a is not None and b is not None and a != b


def _beyond(a: float | None, b: float | None, most: float) -> bool:
    return a is not None and b is not None and a - b > most


def temporal_groups(segments: DataFrame, by: list[str], gap: float = 8.0, span: float = 120.0, tokens: int = 320) -> DataFrame:
    """Timed segments (by, seq, start, end, speaker, modality, quality, section, text) with group_no.

    A group ends at a change of speaker, modality, quality or section, after a gap, beyond a span, or when its text
    would pass the token budget.
    """
    sized = segments.filter(F.trim("text") != "").withColumns(
        {"__words": T.count_words(F.col("text")), "__others": T.count_others(F.col("text")), "__name": T.blank_to_null(F.col("speaker")), "__part": T.blank_to_null(F.col("section"))}
    )

    def breaks(held: dict, row: dict) -> bool:
        return (
            _differs(row["__name"], held["speaker"])
            or row["quality"] != held["quality"]
            or row["modality"] != held["modality"]
            or (row["__part"] is not None and row["__part"] != held["section"])
            or _beyond(row["start"], held["end"], gap)
            or _beyond(row["start"], held["begun"], span)
            or held["words"] + row["__words"] + (held["others"] + 1 + row["__others"]) // 8 > tokens
        )

    def takes(held: dict, row: dict) -> dict:
        return {
            "begun": held.get("begun", row["start"]) if held else row["start"], "end": row["end"], "quality": row["quality"], "modality": row["modality"], "section": row["__part"],
            "speaker": held.get("speaker") if row["__name"] is None else row["__name"],
            "words": held.get("words", 0) + row["__words"], "others": held.get("others", -1) + 1 + row["__others"],
        }

    needs = ["start", "end", "modality", "quality", "__name", "__part", "__words", "__others"]
    return fold_groups(sized, by, ["seq"], needs, breaks, takes).drop("__words", "__others", "__name", "__part")


def temporal_chunks(grouped: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group: first start, last end, speakers in order, label, content and display text."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "start", "end", "speaker", "text")))
    values = lambda name: F.filter(F.transform("rows", lambda r: r[name]), lambda x: x.isNotNull())
    body = F.array_join(values("text"), "\n")
    label = F.when(F.size("speakers") == 1, F.get("speakers", F.lit(0))).otherwise("")
    return (
        grouped.groupBy(*by, "group_no")
        .agg(rows.alias("rows"))
        .withColumns(
            {
                "start": F.get(values("start"), F.lit(0)),
                "end": F.element_at(values("end"), -1),
                "speakers": F.array_distinct(F.filter(values("speaker"), lambda s: F.trim(s) != "")),
            }
        )
        .withColumn("content", F.when(label != "", F.concat(label, F.lit("："), body)).otherwise(body))
        .withColumns({"n_segments": F.size("rows").cast("long"), "token_count": T.estimate_tokens(F.col("content"))})
        .drop("rows")
    )


#: Ends of a sentence after which a cue closes: in subtitles, and in cues by speaker (fixed values).
CUE_ENDS, SPEAKER_CUE_ENDS = r"[.!?。！？…]$", r"[。！？!?]\s*$"


def cue_groups(
    words: DataFrame, by: list[str], pause: float = 0.8, longest: float = 15.0, characters: int = 60, quality: bool = False
) -> DataFrame:
    """Words (by, seq, start, end, speaker, text) with group_no of subtitle cues.

    quality: cues of speakers, which also break where the columns quality or overlap change and close at fewer marks.
    """
    text = F.trim("text")
    others = {"__quality": F.col("quality"), "__overlap": F.col("overlap")} if quality else {"__quality": F.lit(0), "__overlap": F.lit(0)}
    sized = words.filter(text != "").withColumns(
        others | {"__size": F.length(text), "__first": text.rlike("^[A-Za-z0-9]"), "__last": text.rlike("[A-Za-z0-9]$"), "__closes": text.rlike(SPEAKER_CUE_ENDS if quality else CUE_ENDS)}
    )
    same = ("speaker", "__quality", "__overlap")

    def joined(held: dict, row: dict) -> int:
        """Characters of the cue's text; only words of ASCII letters and digits are set apart."""
        return held["size"] + (held["last"] and row["__first"]) + row["__size"] if held else row["__size"]

    def breaks(held: dict, row: dict) -> bool:
        return (
            held["closed"]
            or any(row[c] != held[c] for c in same)
            or _beyond(row["start"], held["end"], pause)
            or _beyond(row["end"], held["begun"], longest)
            or joined(held, row) > characters
        )

    def takes(held: dict, row: dict) -> dict:
        return {c: row[c] for c in same} | {
            "begun": held["begun"] if held else row["start"], "end": row["end"], "size": joined(held, row), "last": row["__last"], "closed": row["__closes"],
        }

    needs = ["start", "end", *same, "__size", "__first", "__last", "__closes"]
    return fold_groups(sized, by, ["seq"], needs, breaks, takes).drop(*needs[3:])


def paragraph_groups(rows: DataFrame, by: list[str], gap: float, span: float, characters: int) -> DataFrame:
    """Rows (by, seq, start, end, speaker, size, chapter) with group_no of paragraphs; chapter: a chapter begins here."""

    def breaks(held: dict, row: dict) -> bool:
        return (
            bool(row["chapter"])
            or row["speaker"] != held["speaker"]
            or _beyond(row["start"], held["end"], gap)
            or _beyond(row["end"], held["begun"], span)
            or held["size"] + row["size"] > characters
        )

    def takes(held: dict, row: dict) -> dict:
        return {"begun": held["begun"] if held else row["start"], "end": row["end"], "speaker": row["speaker"], "size": held.get("size", 0) + row["size"]}

    return fold_groups(rows, by, ["seq"], ["start", "end", "speaker", "size", "chapter"], breaks, takes)


def core_groups(rows: DataFrame, by: list[str], span: float, count: int = 48) -> DataFrame:
    """Rows (by, seq, start, end) with group_no of correction cores: at most so many rows, within a span."""

    def breaks(held: dict, row: dict) -> bool:
        return held["n"] >= count or _beyond(row["end"], held["begun"], span)

    def takes(held: dict, row: dict) -> dict:
        return {"begun": held["begun"] if held else row["start"], "n": held.get("n", 0) + 1}

    return fold_groups(rows, by, ["seq"], ["start", "end"], breaks, takes)


CORES = "__key string, ordinal int, core_first long, core_last long, context_first long, context_last long, core_start double, core_end double"


def correction_plan(cored: DataFrame, by: list[str], rows: int = 2, reach: float = 20.0) -> DataFrame:
    """One row for each core of ``core_groups``: by, ordinal, the numbers (from 0, within the key) of the first and last row
    of the core and of its context, core_start, core_end.

    The context is so many rows on either side, and further ones as long as each is within reach of the core.
    """

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, group = None, -1, -1
        past: deque[tuple[int, float]] = deque()  # rows (number, end) that a later core may still reach
        waiting: list[dict] = []  # cores whose context may still grow

        def finished(last: bool) -> list[dict]:
            done = [c for c in waiting if last or c["closed"]]
            waiting[:] = [] if last else [c for c in waiting if not c["closed"]]
            return done

        for batch in batches:
            out: list[dict] = []
            columns = (batch.column(c).to_pylist() for c in ("__key", "__start", "__end", "__group_no"))
            for name, start, end, number in zip(*columns, strict=True):
                if name != key:
                    out += finished(last=True)
                    key, at, group = name, -1, -1
                    past.clear()
                at += 1
                if number != group:
                    group, first = number, max(0, at - rows)
                    for i, before in reversed(past):
                        if i < first:
                            if start - before > reach:
                                break
                            first = i
                    waiting.append({"__key": key, "ordinal": number, "core_first": at, "context_first": first, "core_start": start, "closed": False})
                for core in waiting:
                    if core["ordinal"] == number:
                        core |= {"core_last": at, "context_last": at, "core_end": end}
                    elif at <= core["core_last"] + rows or start - core["core_end"] <= reach:
                        core["context_last"] = at
                    else:
                        core["closed"] = True
                out += finished(last=False)
                past.append((at, end))
                # Later cores begin later: what lies before a row out of reach is out of reach, too.
                while len(past) > rows + 1 and start - past[0][1] > reach:
                    past.popleft()
            yield pa.RecordBatch.from_pylist([{f.name: c[f.name] for f in CORE_ROWS} for c in out], schema=CORE_ROWS)
        yield pa.RecordBatch.from_pylist([{f.name: c[f.name] for f in CORE_ROWS} for c in finished(last=True)], schema=CORE_ROWS)

    ordered = in_order(cored, by, ["seq"], ["start", "end", "group_no"]).withColumns({"__start": F.col("__start").cast("double"), "__end": F.col("__end").cast("double")})
    keys = F.from_json("__key", cored.select(*by).schema)
    return ordered.drop("__item").mapInArrow(plan, CORES).select(keys.alias("__by"), "*").select("__by.*", *[c for c in CORE_ROWS.names if c != "__key"])


CORE_ROWS = pa.schema(
    [("__key", pa.string()), ("ordinal", pa.int32()), *[(c, pa.int64()) for c in ("core_first", "core_last", "context_first", "context_last")], ("core_start", pa.float64()), ("core_end", pa.float64())]
)


# --- Text chunks -----------------------------------------------------------------------------------------------------

#: Between sentences and between paragraphs (fixed value).
UNIT_GAP = re.compile(r"(?<=[。！？.!?])\s+|\n{2,}")
_WORD_CODES = np.zeros(128, dtype=bool)
_WORD_CODES[[ord(c) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"]] = True
_HAN = range(0x3400, 0xA000)


class Sizes:
    """Prefix sums over a text's characters: words that begin, and characters outside words, before each place."""

    def __init__(self, text: str):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        inside = _WORD_CODES[np.minimum(code, 127)] & (code < 128)
        han = (code >= _HAN.start) & (code < _HAN.stop)
        follows = np.zeros(len(code) + 1, dtype=bool)  # the place lies within a word
        follows[1:-1] = inside[1:] & inside[:-1]
        total = lambda flags: np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        self.words, self.others, self.follows = total(han | (inside & ~follows[:-1])), total(~(inside | han)), follows

    def counts(self, a: int, z: int) -> tuple[int, int]:
        return int(self.words[z] - self.words[a]) + bool(self.follows[a]), int(self.others[z] - self.others[a])

    def furthest(self, a: int, z: int, most: int) -> int:
        """The last place up to z that text from a on reaches within so many tokens."""
        whole = self.words[a + 1 : z + 1] + (self.others[a + 1 : z + 1] - self.others[a]) // 8
        return max(a + 1, a + int(np.searchsorted(whole, most + self.words[a] - bool(self.follows[a]), side="right")))


def _stripped(text: str, a: int, z: int) -> tuple[int, int]:
    part = text[a:z]
    return a + len(part) - len(part.lstrip()), a + len(part.rstrip())


def unit_spans(text: str, sizes: Sizes, most: int) -> Iterator[tuple[int, int]]:
    """Places of sentences and paragraphs; what is larger than `most` tokens is cut into the largest parts that aren't."""
    at = 0
    for end, after in [*(m.span() for m in UNIT_GAP.finditer(text)), (len(text), len(text))]:
        a, z = _stripped(text, at, end)
        at = after
        while a < z:
            words, others = sizes.counts(a, z)
            # The search needs to look at most / 8 characters a token at first, and further only in very long words.
            stop = z if words + others // 8 <= most else None
            reach = 8 * most + 8
            while stop is None:
                upto = min(z, a + reach)
                stop = sizes.furthest(a, upto, most)
                stop, reach = (None, 4 * reach) if stop == upto < z else (stop, reach)
            p, q = _stripped(text, a, stop)
            if p < q:
                yield p, q
            a = stop


def text_pieces(text: str, target: int = 320, most: int = 480) -> list[tuple[str, int, int]]:
    """(content, start, end) of the chunks of a text: units, set apart by blank lines, up to the target.

    start: where the chunk's first unit next stands from the end of the chunk before, or else that end; end: start and the
    content's length.
    """
    text = text.strip()
    sizes = Sizes(text)
    groups: list[list[str]] = []
    words = others = 0
    for a, z in unit_spans(text, sizes, most):
        w, o = sizes.counts(a, z)
        if groups and words + w + (others + 2 + o) // 8 <= target:
            groups[-1].append(text[a:z])
            words, others = words + w, others + 2 + o
        else:
            groups.append([text[a:z]])
            words, others = w, o
    out, end = [], 0
    for units in groups:
        content, found = "\n\n".join(units), text.find(units[0], end)
        start = found if found >= 0 else end
        end = start + len(content)
        out.append((content, start, end))
    return out


HEADING = re.compile(r"(?m)^(#{1,6})[^\S\n]+(\S[^\n]*?)[^\S\n]*$\n?")


def heading_sections(text: str, path: list[str]) -> Iterator[tuple[list[str], str, int]]:
    """(heading path, text, where it begins) between the headings of a Markdown text. A level that was skipped leaves no place."""
    at = 0
    for found in [*HEADING.finditer(text), None]:
        if body := text[at : found.start() if found else None].strip():
            yield path, body, at
        if found:
            path, at = [*path[: len(found[1]) - 1], found[2]], found.end()


PARTS = "array<struct<block:int,part:int,path:array<string>,content:string,start:long,end:long>>"


def parts_of(text: Column, path: Column, headings: bool, target: int, most: int) -> Column:
    """All chunks of a text, with the headings above them. Cutting needs sums over characters: Arrow batches."""

    @F.pandas_udf(PARTS)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, paths in batches:
            out = []
            for value, above in zip(texts, paths, strict=True):
                above = [] if above is None else list(above)
                sections = heading_sections(value or "", above) if headings else [(above, value or "", 0)]
                out.append([
                    {"block": b, "part": p, "path": path, "content": content, "start": begins + start, "end": begins + end}
                    for b, (path, body, begins) in enumerate(sections)
                    for p, (content, start, end) in enumerate(text_pieces(body, target, most))
                ])
            yield pd.Series(out)

    return cut(text, path)


def text_chunks(documents: DataFrame, target: int = 320, most: int = 480) -> DataFrame:
    """document_id, ordinal, chunk_key, chunk_id, content, token_count, content_hash, text_start, text_end of documents
    (document_id, text)."""
    none = F.array().cast("array<string>")
    cut = documents.select("document_id", F.explode(parts_of(F.coalesce("text", F.lit("")), none, False, target, most)).alias("p"))
    key = F.concat(F.lit("segment:0:block:0:part:"), F.col("p.part"))
    return cut.select(
        "document_id",
        F.col("p.part").cast("long").alias("ordinal"),
        key.alias("chunk_key"),
        ids.chunk_id(F.col("document_id"), key).alias("chunk_id"),
        F.col("p.content").alias("content"),
        T.estimate_tokens(F.col("p.content")).alias("token_count"),
        ids.text_hash(F.col("p.content")).alias("content_hash"),
        F.col("p.start").alias("text_start"),
        F.col("p.end").alias("text_end"),
    )


#: Texts whose blocks a task holds at once.
HEADED = 64


def heading_blocks(documents: DataFrame) -> DataFrame:
    """document_id, block_no, heading_path, body, text_start of Markdown texts (document_id, text)."""

    schema = f"document_id {documents.schema['document_id'].dataType.simpleString()}, block_no long, heading_path array<string>, body string, text_start long"
    kinds = [pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, HEADED):
                piece = batch.slice(at, HEADED)
                rows = [(i, n, p, b, a) for i, text in enumerate(piece.column(1)) for n, (p, b, a) in enumerate(heading_sections(text.as_py() or "", []))]
                number, *columns = zip(*rows, strict=True) if rows else [[]] * 5
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(number, pa.int64())), *arrays], names=["document_id", "block_no", "heading_path", "body", "text_start"])

    return documents.select("document_id", F.col("text").cast("string")).mapInArrow(cut, schema)


def locator_chunks(segments: DataFrame, locator: str, glue: str = "\n") -> DataFrame:
    """One row for each page, slide or section of a document (document_id, seq, segment_id, locator, section, text);
    a segment without a locator is a row by itself."""
    own = F.when(F.col(locator).isNull(), F.col("segment_id"))
    rows = F.array_sort(F.collect_list(F.struct("seq", "segment_id", "text")))
    return (
        segments.groupBy("document_id", locator, F.coalesce("section", F.lit("")).alias("section"), own.alias("alone"))
        .agg(rows.alias("rows"), F.min("seq").alias("seq"))
        .select(
            "document_id", locator, "section", "seq",
            F.array_join(F.transform("rows", lambda r: r["text"]), glue).alias("content"),
            F.size("rows").cast("long").alias("n_segments"),
            F.transform("rows", lambda r: r["segment_id"]).alias("segment_ids"),
        )
    )


# --- Chunks of any medium --------------------------------------------------------------------------------------------

#: How a document's medium is chunked (fixed values); all others are text.
PAGED, SLIDES, TIMED, IMAGES = ("pdf",), ("presentation", "ppt", "pptx", "slides"), ("audio", "video"), ("image",)


def media_chunks(segments: DataFrame, target: int = 320, most: int = 480, span: float = 120.0) -> DataFrame:
    """Chunks of segments (document_id, media_type, segment_id, seq, modality, retrieval_text, text, heading_path, page, slide, section,
    start, end, speaker, quality, asset), by medium: pages, slides, time, whole images, or the headings of texts.

    Returns document_id, ordinal, chunk_key, chunk_id, content, heading_path, segment_ids, page_number, slide_number, section,
    timestamp_start, timestamp_end, image_path, text_start, text_end, token_count, content_hash.
    """
    medium = F.lower("media_type")
    known = [*PAGED, *SLIDES, *TIMED, *IMAGES]
    filled = segments.filter(F.coalesce("retrieval_text", F.lit("")) != "")
    null = lambda kind: F.lit(None).cast(kind)
    place = ["page", "slide", "section", "start", "end", "asset"]

    def finished(cut: DataFrame, key: Column, order: Column, path: Column) -> DataFrame:
        return cut.select(
            "document_id", order.alias("__order"), key.alias("chunk_key"), F.col("p.content").alias("content"), path.alias("heading_path"), "segment_ids",
            F.col("page").cast("long").alias("page_number"), F.col("slide").cast("long").alias("slide_number"), T.blank_to_null(F.col("section")).alias("section"),
            F.col("start").cast("double").alias("timestamp_start"), F.col("end").cast("double").alias("timestamp_end"), F.col("asset").alias("image_path"),
            F.col("p.start").alias("text_start"), F.col("p.end").alias("text_end"),
        )

    part = F.concat(F.lit(":part:"), F.col("p.part"))
    order = lambda *more: F.struct(F.col("seq").cast("double").alias("a"), F.col("first_id").alias("b"), F.col("p.block").alias("c"), F.col("p.part").alias("d"))
    path = F.coalesce("heading_path", F.array().cast("array<string>"))

    texts = filled.filter(~F.coalesce(medium, F.lit("")).isin(*known)).select(
        "document_id", "seq", F.col("segment_id").alias("first_id"), F.array("segment_id").alias("segment_ids"), *place, F.explode(parts_of(F.col("retrieval_text"), path, True, target, most)).alias("p")
    )
    out = [finished(texts, F.concat(F.lit("segment:"), "first_id", F.lit(":block:"), F.col("p.block"), part), order(), F.col("p.path"))]

    member = F.struct("seq", "segment_id", "retrieval_text", path.alias("path"), "page", "slide", "start", "end", "asset")
    members = F.array_sort(F.collect_list(member)).alias("rows")
    each = lambda name: F.transform("rows", lambda r: r[name])
    first = lambda name: F.get("rows", F.lit(0))[name]
    some = lambda values, kind: F.coalesce(F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0)), null(kind))

    def whole(grouped: DataFrame) -> DataFrame:
        above = F.coalesce(F.get(F.filter(each("path"), lambda x: F.size(x) > 0), F.lit(0)), F.array().cast("array<string>"))
        return grouped.select(
            "document_id", "section", "value", first("seq").alias("seq"), first("segment_id").alias("first_id"), each("segment_id").alias("segment_ids"),
            *[first(c).alias(c) for c in ("page", "slide", "start", "end")], some(each("asset"), "string").alias("asset"),
            F.when(F.coalesce("section", F.lit("")) != "", F.array("section")).otherwise(above).alias("above"), F.array_join(each("retrieval_text"), "\n\n").alias("whole"),
        ).select("*", F.explode(parts_of(F.col("whole"), F.array().cast("array<string>"), False, target, most)).alias("p"))

    for kinds, locator in ((PAGED, "page"), (SLIDES, "slide")):
        value = F.coalesce(F.col(locator).cast("string"), F.concat(F.lit("segment:"), "segment_id")).alias("value")
        cut = whole(filled.filter(medium.isin(*kinds)).groupBy("document_id", "section", value).agg(members))
        key = F.concat(
            F.lit(f"{locator}:"), "value", F.lit(":section:"), F.coalesce(T.blank_to_null(F.col("section")), F.lit("-")), F.lit(":members:"), F.array_join("segment_ids", ","), part
        )
        out.append(finished(cut, key, order(), F.col("above")))
    cut = whole(filled.filter(medium.isin(*IMAGES)).groupBy("document_id", null("string").alias("section"), F.lit("").alias("value")).agg(members))
    out.append(finished(cut, F.concat(F.lit("image:members:"), F.array_join("segment_ids", ","), part), order(), F.array().cast("array<string>")))

    timed = temporal_groups(segments.filter(medium.isin(*TIMED)), ["document_id"], span=span, tokens=target)
    spoken = temporal_chunks(timed, ["document_id"])
    firsts = timed.groupBy("document_id", "group_no").agg(members.alias("rows")).select(
        "document_id", "group_no", first("seq").alias("seq"), first("segment_id").alias("first_id"), each("segment_id").alias("segment_ids"),
        first("page").alias("page"), first("slide").alias("slide"), first("asset").alias("asset"), F.coalesce(F.get(F.filter(each("path"), lambda x: F.size(x) > 0), F.lit(0)), F.array().cast("array<string>")).alias("above"),
    )
    sections = timed.groupBy("document_id", "group_no").agg(F.min_by("section", "seq").alias("section"), F.min_by("quality", "seq").alias("quality"))
    speech = F.struct(F.lit(0).alias("block"), F.lit(0).alias("part"), "content", null("long").alias("start"), null("long").alias("end")).alias("p")
    cut = spoken.join(firsts, ["document_id", "group_no"]).join(sections, ["document_id", "group_no"]).withColumn("p", speech)
    speakers = F.coalesce(T.blank_to_null(F.array_join("speakers", ",")), F.lit("-"))
    told = lambda c: F.coalesce(F.col(c).cast("double").cast("string"), F.lit("None"))
    key = F.concat(
        F.lit("time:"), told("start"), F.lit(":"), told("end"), F.lit(":speaker:"), speakers, F.lit(":quality:"), F.coalesce("quality", F.lit("pass")),
        F.lit(":members:"), F.array_join("segment_ids", ","), F.lit(":group:"), F.col("group_no"),
    )
    out.append(finished(cut, key, order(), F.col("above")))

    chunks = out[0]
    for one in out[1:]:
        chunks = chunks.unionByName(one)
    in_document = Window.partitionBy("document_id").orderBy("__order")
    return chunks.select(
        "document_id", (F.row_number().over(in_document) - 1).cast("long").alias("ordinal"), "chunk_key", ids.chunk_id(F.col("document_id"), F.col("chunk_key")).alias("chunk_id"),
        "content", "heading_path", "segment_ids", "page_number", "slide_number", "section", "timestamp_start", "timestamp_end", "image_path", "text_start", "text_end",
        T.estimate_tokens(F.col("content")).alias("token_count"), ids.text_hash(F.col("content")).alias("content_hash"),
    )
