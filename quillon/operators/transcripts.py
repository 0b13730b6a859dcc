"""Transcripts: quality reports, immutability, corrections, external verification, OCR summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.phrases import find_phrases
from quillon.operators.rules import Rule, findings

#: Words that prove nothing, and signs of a complex layout (fixed values).
GENERIC_WORDS = ("the", "and", "for", "with", "official", "docs", "documentation")
LAYOUT_SIGNS = r"[∑√≈≠≤≥|＝]"


#: Flags that a recogniser sets on segments and that are issues of the run (fixed values).
MODEL_FLAGS = ("generated_loop", "professional_term", "number_unit", "speaker_alignment_unavailable")


def mean_confidence(segment: Column, words: Column) -> Column:
    """Mean of a segment's confidence and its words', of those that are known."""
    known = F.filter(F.concat(F.array(segment), F.coalesce(words, F.array().cast("array<double>"))), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


def run_quality(segments: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, code, severity of whole recordings.

    segments: run_id, ordinal, start_ms, end_ms, speaker_id, text, flags, streak; runs: run_id, duration_ms,
    expected_speakers, diarized, language, silence_ratio, clipping_ratio, loudness. Optional: silent_share of segments (0 to 1), and
    decode_ok, probed_ms, corrupt of runs.
    """
    w = Window.partitionBy("run_id").orderBy("ordinal")
    length = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    text = F.trim(F.coalesce("text", F.lit("")))
    unknown = F.coalesce(F.col("speaker_id"), F.lit("")).isin("", "speaker_unknown")
    flagged = lambda *names: F.arrays_overlap("flags", F.array(*[F.lit(n) for n in names]))
    silent = F.coalesce("silent_share", F.lit(0.0)) if "silent_share" in segments.columns else F.lit(0.0)
    told = lambda c, kind, other: F.coalesce(F.col(c) if c in runs.columns else F.lit(None).cast(kind), F.lit(other))
    rows = segments.withColumns({"length": length, "text": text, "before": F.lag("start_ms").over(w)})
    sums = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("text") == "").alias("n_empty"),
        F.count_if((F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms"))).alias("n_invalid"),
        F.count_if(F.col("start_ms") < F.col("before")).alias("n_reversed"),
        F.count_if((F.col("streak") >= 3) | T.repeats_phrase(F.col("text"))).alias("n_repeated"),
        F.count_if(flagged("truncated", "finish_reason_truncated")).alias("n_truncated"),
        F.count_if((F.col("length") > 0) & (F.length(F.regexp_replace("text", r"\s+", "")) * 1000 / F.greatest(F.col("length"), F.lit(1)) > 30)).alias("n_fast"),
        F.count_if((silent >= 0.8) & (F.col("length") > 0) & (F.length("text") >= 8)).alias("n_silent"),
        *[F.count_if(flagged(code)).alias(f"n_{code}") for code in MODEL_FLAGS],
        F.count_if((F.col("length") < 1000) & (F.coalesce("speaker_id", F.lit("")) != "")).alias("n_short"),
        F.sum("length").alias("speech"),
        F.sum(F.when(unknown, F.col("length")).otherwise(0)).alias("unknown"),
        F.sum(F.when(flagged("overlap"), F.col("length")).otherwise(0)).alias("overlap"),
        F.count_if(flagged("language_mismatch")).alias("n_flagged_language"),
        F.countDistinct(F.when(~unknown, F.col("speaker_id"))).alias("n_speakers"),
        F.max("end_ms").alias("last"),
        F.sum(F.length(F.regexp_replace("text", rf"[^A-Za-z{T.CJK}]", ""))).alias("letters"),
        F.sum(F.length(F.regexp_replace("text", rf"[^{T.CJK}]", ""))).alias("chinese"),
    )
    all_runs = runs.join(sums, "run_id", "left").fillna(0, ["n", "n_empty", "n_invalid", "n_reversed", "speech", "letters"])
    share = lambda a: F.when(F.col("speech") > 0, F.col(a) / F.col("speech")).otherwise(0.0)
    late = F.col("last") > F.col("duration_ms") + F.greatest(F.lit(1000), F.floor(F.col("duration_ms") * 0.01))
    return findings(
        all_runs,
        ["run_id"],
        [
            Rule("empty_transcript", "error", (F.col("n") == 0) | (F.col("n") == F.col("n_empty"))),
            Rule("invalid_timestamp", "error", F.col("n_invalid") > 0),
            Rule("timestamp_out_of_bounds", "error", (F.col("duration_ms") > 0) & late),
            Rule("timestamp_reversal", "error", F.col("n_reversed") > 0),
            Rule("empty_segments", "warning", (F.col("n_empty") > 0) & (F.col("n_empty") >= F.greatest(F.lit(1), F.floor(F.col("n") / 3)))),
            Rule("repetition", "warning", F.col("n_repeated") > 0),
            Rule("silence_hallucination", "warning", F.col("n_silent") > 0),
            *[Rule(code, "warning", F.col(f"n_{code}") > 0) for code in MODEL_FLAGS],
            Rule("audio_decode_failed", "error", ~told("decode_ok", "boolean", True)),
            Rule("audio_zero_duration", "error", told("probed_ms", "long", 1) == 0),
            Rule("audio_corrupt", "error", told("corrupt", "boolean", False)),
            Rule("truncated", "warning", F.col("n_truncated") > 0),
            Rule("abnormal_character_rate", "warning", F.col("n_fast") > 0),
            Rule("audio_long_silence", "warning", F.col("silence_ratio") >= 0.85),
            Rule("audio_clipping", "warning", F.col("clipping_ratio") >= 0.10),
            Rule("audio_too_quiet", "warning", F.col("loudness") < -45),
            Rule("speaker_count_mismatch", "warning", (F.col("expected_speakers") > 0) & (F.col("n_speakers") != F.col("expected_speakers"))),
            Rule("speaker_fragmentation", "warning", F.col("diarized") & (F.col("n") >= 4) & (F.col("n_short") / F.col("n") > 0.5)),
            Rule("speaker_unknown", "warning", F.col("diarized") & (share("unknown") > 0.2)),
            Rule("speaker_overlap", "warning", F.col("diarized") & (share("overlap") > 0.15)),
            Rule("language_mismatch", "warning", (F.col("n_flagged_language") > 0) | (F.lower("language").isin("zh", "chinese", "中文", "zh-cn")) & (F.col("letters") >= 20) & (F.col("chinese") / F.col("letters") < 0.15)),
        ],
    ).drop("detail")


def changed_facts(stored: DataFrame, again: DataFrame) -> DataFrame:
    """Rows by which a resubmitted run differs from what is stored: none, or the resubmission must be refused."""
    names = stored.columns
    return stored.exceptAll(again.select(*names)).withColumn("side", F.lit("stored")).unionByName(
        again.select(*names).exceptAll(stored).withColumn("side", F.lit("resubmitted"))
    )


def glossary_hits(segments: DataFrame, glossary: DataFrame) -> DataFrame:
    """segment_id, variant, canonical, start, end, found: where variants (variant, canonical) of glossary terms stand in texts, whatever
    their case and whatever stands around them. A variant that is its term in another case proposes nothing."""
    told = glossary.filter(T.fold(F.trim("variant")) != T.fold(F.trim("canonical")))
    return find_phrases(segments, "segment_id", "text", told)


def apply_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """id, text with confirmed spans (id, start, end, before, after; code points) replaced; a span whose text differs, or that
    overlaps an earlier one, leaves its text unchanged and sets `refused`."""
    ordered = spans.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "before", "after"))).alias("spans"))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"), F.lit(False).alias("bad"))

    def step(acc: Column, s: Column) -> Column:
        same = F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")) == s["before"]
        bad = acc["bad"] | (s["start"] < acc["at"]) | ~same
        kept = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.concat(acc["out"], kept, s["after"]).alias("out"), s["end"].cast("long").alias("at"), bad.alias("bad"))

    joined = texts.join(ordered, "id", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint,before:string,after:string>>")))
    folded = F.aggregate("spans", begin, step)
    rest = F.substring(F.col("text"), (F.col("f.at") + 1).cast("int"), F.length("text"))
    return joined.withColumn("f", folded).select("id", F.when(F.col("f.bad"), F.col("text")).otherwise(F.concat("f.out", rest)).alias("text"), F.col("f.bad").alias("refused"))


def roll_back(paragraphs: DataFrame, changes: DataFrame) -> DataFrame:
    """paragraph_id, text: rejected changes (paragraph_id, ordinal, before_text, after_text, status) undone in order, the first
    occurrence each; stored paragraphs stay as they are."""
    gone = changes.filter("status = 'rejected' AND after_text <> ''").groupBy("paragraph_id").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "before_text", "after_text"))).alias("gone")
    )
    empty = F.array().cast("array<struct<ordinal:bigint,before_text:string,after_text:string>>")

    def undo(text: Column, c: Column) -> Column:
        at = F.instr(text, c["after_text"])
        changed = F.concat(F.substring(text, F.lit(1), at - 1), c["before_text"], F.substring(text, at + F.length(c["after_text"]), F.length(text)))
        return F.when(at > 0, changed).otherwise(text)

    return paragraphs.join(gone, "paragraph_id", "left").select("paragraph_id", F.aggregate(F.coalesce("gone", empty), F.col("text"), undo).alias("text"))


def mark_uncertain(proposed: Column, raw: Column, confidence: Column, least: float = 0.45, sure: float = 0.78, marker: str = "[?]") -> Column:
    """Below `least` the raw text stays; below `sure` the text is marked, once."""
    text = F.when(confidence < least, raw).otherwise(proposed)
    return F.when((confidence < sure) & ~text.contains(marker), F.concat(F.rtrim(text), F.lit(" " + marker))).otherwise(text)


def review_state(changes: DataFrame, events: DataFrame) -> DataFrame:
    """change_id, status: the latest of a change's events (change_id, at, status), else proposed."""
    last = events.groupBy("change_id").agg(F.max_by("status", "at").alias("status"))
    return changes.select("change_id").join(last, "change_id", "left").select("change_id", F.coalesce("status", F.lit("proposed")).alias("status"))


def auto_accept(changes: DataFrame, evidence: DataFrame, sure: float = 0.9) -> DataFrame:
    """change_id of proposed changes with enough confidence and verified evidence (change_id, verified)."""
    proven = evidence.filter("verified").select("change_id")
    return changes.filter((F.col("status") == "proposed") & (F.col("confidence") >= sure)).join(proven, "change_id", "left_semi").select("change_id")


def relevant_hit(query: Column, title: Column, snippet: Column) -> Column:
    """A hit shares an exact word of the query: three letters or more, not a generic one."""
    words = F.filter(F.regexp_extract_all(F.lower(query), F.lit(r"([a-z0-9][a-z0-9.+_-]{2,})"), 1), lambda x: ~x.isin(*GENERIC_WORDS))
    found = F.lower(F.concat_ws("\n", title, snippet))
    # Chinese words have no bounds: a part of the longest run must stand there, the whole of a short one.
    runs = F.regexp_extract_all(query, F.lit(rf"([{T.CJK}]{{2,}})"), 1)
    size = F.least(F.lit(4), F.greatest(F.lit(2), F.array_max(F.transform(runs, lambda r: F.length(r)))))
    parts = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - size + 1, F.lit(1))), lambda i: F.substring(r, i, size))))
    shared = F.exists(parts, lambda x: found.contains(x))
    return F.when(F.size(words) > 0, F.exists(words, lambda x: found.contains(x))).otherwise(F.coalesce(shared, F.lit(False)))


def ocr_summary(lines: DataFrame, low: float = 0.65) -> DataFrame:
    """document_id, n_pages, n_lines, mean_confidence, min_confidence, n_low of OCR lines (document_id, page, text, confidence), and the
    distinct reasons for another reading, in order, where lines have a column reason."""
    reasons = [F.sort_array(F.collect_set("reason")).alias("reasons")] if "reason" in lines.columns else []
    return lines.groupBy("document_id").agg(
        *reasons,
        F.countDistinct("page").alias("n_pages"), F.count(F.lit(1)).alias("n_lines"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.round(F.min("confidence"), 6).alias("min_confidence"), F.count_if(F.col("confidence") < low).alias("n_low"),
    )


def complex_layout(lines: DataFrame) -> DataFrame:
    """document_id, page, complex of lines (document_id, page, text, left, right, top, bottom): signs of formulas and tables, or two
    columns side by side. Columns are compared by their running extents, not line by line."""
    by = ["document_id", "page"]
    width = F.max("right").over(Window.partitionBy(*by))
    rows = lines.withColumn("width", width).withColumns({"in_left": F.col("right") <= F.col("width") * 0.58, "in_right": F.col("left") >= F.col("width") * 0.42})
    # In order of their tops, a line of one column overlaps one of the other when it begins before that one's lowest end so far.
    w = Window.partitionBy(*by).orderBy("top", "bottom").rowsBetween(Window.unboundedPreceding, -1)
    end = lambda side: F.max(F.when(F.col(side), F.col("bottom"))).over(w)
    rows = rows.withColumns({"left_end": end("in_left"), "right_end": end("in_right")})
    meets = (F.col("in_left") & (F.col("right_end") >= F.col("top"))) | (F.col("in_right") & (F.col("left_end") >= F.col("top")))
    both = (F.count(F.col("left")) >= 8) & (F.count_if("in_left") >= 3) & (F.count_if("in_right") >= 3) & F.coalesce(F.bool_or(meets), F.lit(False))
    return rows.groupBy(*by).agg((F.bool_or(F.col("text").rlike(LAYOUT_SIGNS)) | both).alias("complex"))


def reading_route(pages: DataFrame, layouts: DataFrame, low: float = 0.65) -> DataFrame:
    """document_id, page, reader, reasons of pages (document_id, page, n_lines, confidence): the baseline reading stays unless it is empty, unsure,
    or the layout (document_id, page, complex) is too much for it."""
    rows = pages.join(layouts, ["document_id", "page"], "left")
    doubts = F.array(
        F.when(F.coalesce("n_lines", F.lit(0)) == 0, "no_text"), F.when(F.col("confidence") < low, "low_confidence"), F.when(F.coalesce("complex", F.lit(False)), "complex_layout")
    )
    reasons = F.filter(doubts, lambda x: x.isNotNull())
    return rows.select("document_id", "page", F.when(F.size(reasons) > 0, "escalated").otherwise("baseline").alias("reader"), F.array_join(reasons, ",").alias("reasons"))


def distinct_lines(lines: DataFrame) -> DataFrame:
    return lines.dropDuplicates(["document_id", "page", "text", "left", "right", "top", "bottom"])


def card_confidence(cards: DataFrame, changes: DataFrame) -> DataFrame:
    """card_id, confidence: the least among the changes of a card's segments (cards: card_id, segment_ids)."""
    each = cards.select("card_id", F.explode("segment_ids").alias("segment_id"))
    return each.join(changes, "segment_id").groupBy("card_id").agg(F.min("confidence").alias("confidence"))


def keyframe_segments(frames: DataFrame, every: float = 60.0, most: int = 8) -> DataFrame:
    """At most `most` frames of a recording (run_id, at, asset), one for each span, as image segments."""
    w = Window.partitionBy("run_id", F.floor(F.col("at") / every)).orderBy("at")
    one = frames.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")
    order = Window.partitionBy("run_id").orderBy("at")
    return one.withColumn("seq", F.row_number().over(order)).filter(F.col("seq") <= most).withColumn("modality", F.lit("image"))
