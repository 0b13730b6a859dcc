"""Intervals in time: range joins, as-of lookups, unions, gaps, streaks.

A range join would compare everything with everything. Instead both sides are dealt to time buckets, joined on the
bucket as an ordinary equi-join and checked exactly; a pair that shares several buckets counts in the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import prefix
from quillon.sources.storage import written


def _bucketed(df: DataFrame, start: str, end: str, width: float, name: str) -> DataFrame:
    first, last = F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end)) / width)
    return df.withColumn(name, F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], width: float) -> DataFrame:
    """Pairs of left (by, start, end, ...) and right (by, r_start, r_end, ...) that overlap, with `overlap`.

    Intervals are half-open; one without length overlaps where it lies in the other, by an infinitesimal amount.
    """
    a, b = _bucketed(left, "start", "end", width, "__slot"), _bucketed(right, "r_start", "r_end", width, "__slot")
    amount = F.least("end", "r_end") - F.greatest("start", "r_start")
    point = (F.col("start") == F.col("end")) & (F.col("start") >= F.col("r_start")) & (F.col("start") < F.col("r_end"))
    first = F.col("__slot") == F.floor(F.greatest("start", "r_start") / width)
    return (
        a.join(b, [*by, "__slot"])
        .withColumn("overlap", F.when(point, F.lit(1e-9)).otherwise(amount))
        .filter((F.col("overlap") > 0) & first)
        .drop("__slot")
    )


def assign_speakers(words: DataFrame, turns: DataFrame, by: list[str], width: float = 30.0) -> DataFrame:
    """words (by, word_id, start, end) with the speaker of most overlap among turns (by, speaker, r_start, r_end).

    Ties go to the earlier turn, then the smaller label. overlapping: some moment of the word has two speakers.
    """
    met = overlap_join(words.select(*by, "word_id", "start", "end"), turns, by, width)
    per = met.groupBy(*by, "word_id", "speaker").agg(F.sum("overlap").alias("total"), F.min("r_start").alias("since"))
    order = Window.partitionBy(*by, "word_id").orderBy(F.desc("total"), "since", "speaker")
    chosen = per.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select(*by, "word_id", "speaker")
    # Turns of different speakers that overlap within the word: by start, one begins before an earlier other one ends.
    clipped = met.select(*by, "word_id", "speaker", F.greatest("start", "r_start").alias("a"), F.least("end", "r_end").alias("b"))
    before = Window.partitionBy(*by, "word_id").orderBy("a", "b", "speaker").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.collect_list(F.struct("speaker", "b")).over(before)
    clash = F.exists(ends, lambda e: (e["speaker"] != F.col("speaker")) & (e["b"] > F.col("a")))
    both = clipped.withColumn("clash", clash).groupBy(*by, "word_id").agg(F.bool_or("clash").alias("overlapping"))
    return (
        words.join(chosen, [*by, "word_id"], "left")
        .join(both, [*by, "word_id"], "left")
        .withColumns(
            {"speaker": F.coalesce("speaker", F.lit("speaker_unknown")), "overlapping": F.coalesce("overlapping", F.lit(False))}
        )
    )


def covered_share(segments: DataFrame, spans: DataFrame, by: list[str], width: float = 30.0) -> DataFrame:
    """segments (by, segment_id, start, end) with the share that all spans cover together and any one covers."""
    met = overlap_join(segments.select(*by, "segment_id", "start", "end"), spans, by, width)
    length = F.col("end") - F.col("start")
    return met.groupBy(*by, "segment_id").agg(
        F.max(F.col("overlap") / length).alias("most_by_one"), (F.sum("overlap") / F.max(length)).alias("by_all")
    )


def as_of(points: DataFrame, cues: DataFrame, by: list[str], width: float) -> DataFrame:
    """points (by, at, ...) with the last cue (by, cue_id, r_start, r_end) that holds them; a cue lasts one unit at least."""
    spans = cues.withColumn("r_end", F.greatest(F.col("r_start") + 1, F.col("r_end")))
    moments = points.withColumn("__slot", F.floor(F.col("at") / width))
    met = moments.join(_bucketed(spans, "r_start", "r_end", width, "__slot"), [*by, "__slot"], "left").drop("__slot")
    inside = (F.col("r_start") <= F.col("at")) & (F.col("at") < F.col("r_end"))
    key = F.max(F.when(inside, F.struct("r_start", "r_end", "cue_id"))).alias("cue")
    return met.groupBy(*points.columns).agg(key).select(*points.columns, F.col("cue.cue_id").alias("cue_id"))


def running_end(by: list[str], order: list[str], end: str = "end") -> Column:
    return F.max(end).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def union_spans(spans: DataFrame, by: list[str]) -> DataFrame:
    """(by, start, end) with touching and overlapping spans joined."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    opened = spans.withColumn("so_far", running_end(by, ["start", "end"])).withColumn(
        "opens", (F.col("so_far").isNull() | (F.col("start") > F.col("so_far"))).cast("int")
    )
    return (
        opened.withColumn("island", F.sum("opens").over(w))
        .groupBy(*by, "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("island")
    )


def complement(spans: DataFrame, by: list[str], duration: DataFrame, least: float = 0.0) -> DataFrame:
    """(by, start, end) of what spans leave free between 0 and each key's duration."""
    joined = union_spans(spans, by)
    before = F.lag("end", 1, 0.0).over(Window.partitionBy(*by).orderBy("start"))
    inner = joined.select(*by, before.cast("double").alias("start"), F.col("start").cast("double").alias("end"))
    last = joined.groupBy(*by).agg(F.max("end").cast("double").alias("start"))
    tail = duration.join(last, by, "left").select(*by, F.coalesce("start", F.lit(0.0)).alias("start"), F.col("duration").cast("double").alias("end"))
    return inner.unionByName(tail).filter(F.col("end") - F.col("start") > least)


def streaks(rows: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    """Adds streak: the how-manieth row in a row with this key; a blank key begins anew each time."""
    w = Window.partitionBy(*by).orderBy(*order)
    same = (F.col(key) == F.lag(key).over(w)) & (F.col(key) != "")
    begun = rows.withColumn("__begins", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("__run", F.sum("__begins").over(w))
    return begun.withColumn("streak", F.row_number().over(Window.partitionBy(*by, "__run").orderBy(*order))).drop("__begins", "__run")


def order_errors(rows: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """by, code, n of rows (by, seq, ordinal, start, end) whose ordinals don't grow by one, whose times go back, or that end before they begin."""
    w = Window.partitionBy(*by).orderBy(seq)
    found = F.array(
        F.when(F.col("ordinal") != F.col("__before.ordinal") + 1, "ordinal"), F.when(F.col("start") < F.col("__before.start"), "time"), F.when(F.col("end") < F.col("start"), "length")
    )
    codes = rows.withColumn("__before", F.lag(F.struct("ordinal", "start")).over(w)).select(*by, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("code"))
    return codes.groupBy(*by, "code").agg(F.count(F.lit(1)).alias("n"))


def timeline_checks(rows: DataFrame, by: list[str], order: list[str], jitter: float = 0.05, gap: float = 30.0) -> DataFrame:
    """Adds reversed, overlap_by (over 1) and gap_by (over `gap`) against the rows before; invalid rows have none."""
    valid = F.coalesce((F.col("start") >= 0) & (F.col("end") > F.col("start")), F.lit(False))
    good = rows.withColumn("valid", valid).filter("valid")
    w = Window.partitionBy(*by).orderBy(*order)
    end = running_end(by, order)
    checked = good.withColumns(
        {
            "reversed": F.coalesce(F.col("start") + jitter < F.lag("start").over(w), F.lit(False)),
            "overlap_by": F.when(end - F.col("start") > 1.0, end - F.col("start")).otherwise(0.0),
            "gap_by": F.when(F.col("start") - end > gap, F.col("start") - end).otherwise(0.0),
        }
    )
    bad = rows.withColumn("valid", valid).filter("NOT valid").withColumns(
        {"reversed": F.lit(False), "overlap_by": F.lit(0.0), "gap_by": F.lit(0.0)}
    )
    return checked.unionByName(bad)


def quiet_limits(frames: DataFrame, by: list[str], least: float = 220.0, times: float = 3.0) -> DataFrame:
    """by, total, limit: from what energy on a frame is loud, by the median of the lowest fifth, which a histogram finds."""
    totals = frames.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    fifth = F.greatest(F.lit(1), F.floor(F.col("total") / 5)).cast("long")
    middle = totals.select(*by, F.explode(F.array_distinct(F.array(F.floor((fifth + 1) / 2), F.floor(fifth / 2) + 1))).alias("rank"))
    medians = prefix.order_statistics(frames, by, "energy", middle).groupBy(*by).agg(F.avg("energy").alias("median"))
    return totals.join(medians, by).select(*by, "total", F.greatest(F.lit(least), F.col("median") * times).alias("limit"))


def voice_spans(
    frames: DataFrame, by: list[str], frame: float = 0.03, speech: float = 0.24, silence: float = 0.42, pad: float = 0.18, block: int = 20_000
) -> DataFrame:
    """(by, start, end, mean_energy) of speech in frames (by, n, energy): loud frames, short pauses bridged, short bursts
    dropped, padded and joined.

    A recording is worked on in blocks of frames. What crosses a block's border, the number of bursts and the last span, is carried over
    from one row for each block.
    """
    bridge, least = max(1, int(silence / frame + 1e-9)), max(1, int(speech / frame + 1e-9))
    back = bridge + 1
    size = max(block, back)
    own = F.floor(F.col("n") / size).cast("int")
    # A frame opens a burst where the frames just before it are quiet; the last ones of a block are seen from the next block, too.
    seen = F.when(F.pmod(F.col("n"), F.lit(size)) >= size - back, F.array(own, own + 1)).otherwise(F.array(own))
    blocks = frames.withColumn(prefix.BLOCK, F.explode(seen)).join(quiet_limits(frames, by), by)
    loud = blocks.withColumn("spoken", F.when(F.col("energy") >= F.col("limit"), F.col("n"))).drop("limit")
    just = Window.partitionBy(*by, prefix.BLOCK).orderBy("n").rangeBetween(-back, -1)
    gaps = loud.withColumn("before", F.max("spoken").over(just)).filter(F.col(prefix.BLOCK) == own)
    opens = F.col("spoken").isNotNull() & F.col("before").isNull()
    numbered = written(prefix.running_totals(gaps, by, ["n"], {"burst": opens.cast("long")}).filter("burst > 0"), "bursts")
    # A burst ends with its last loud frame; the bridged ones before that count in its mean, those after it don't.
    inside = Window.partitionBy(*by, prefix.BLOCK, "burst").orderBy("n").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    parts = (
        numbered.withColumn("within", F.max("spoken").over(inside).isNotNull())
        .groupBy(*by, "burst", prefix.BLOCK, "total")
        .agg(
            F.min("spoken").alias("a"), F.max("spoken").alias("z"), F.count(F.lit(1)).alias("frames"), F.sum("energy").alias("energy"),
            F.count_if("within").alias("frames_within"), F.sum(F.when(F.col("within"), F.col("energy"))).alias("energy_within"),
        )
    )
    last = Window.partitionBy(*by, "burst")
    ended = parts.withColumn("end_block", F.max(F.when(F.col("z").isNotNull(), F.col(prefix.BLOCK))).over(last)).filter(F.col(prefix.BLOCK) <= F.col("end_block"))
    final = F.col(prefix.BLOCK) == F.col("end_block")
    bursts = ended.groupBy(*by, "burst", "total").agg(
        F.min("a").alias("a"), F.max("z").alias("z"), F.sum(F.when(final, F.col("energy_within")).otherwise(F.col("energy"))).alias("energy"),
        F.sum(F.when(final, F.col("frames_within")).otherwise(F.col("frames"))).alias("frames"),
    )
    spans = bursts.filter(F.col("z") - F.col("a") + 1 >= least).select(
        *by,
        F.floor(F.col("a") / size).cast("int").alias(prefix.BLOCK),
        F.greatest(F.lit(0.0), F.col("a") * frame - pad).alias("start"),
        F.least(F.col("total") * frame, (F.col("z") + 1) * frame + pad).alias("end"),
        F.round(F.col("energy") / F.col("frames"), 2).alias("mean_energy"),
    )
    # Spans end in the order in which they start, so the one before decides whether a new island begins.
    follows = prefix.carried(spans, by, ["start", "end"], "so_far", F.col("end"))
    begins = F.col("so_far").isNull() | (F.col("start") > F.col("so_far"))
    islands = prefix.running_totals(follows, by, ["start", "end"], {"island": begins.cast("long")})
    return (
        islands.groupBy(*by, "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("mean_energy").alias("mean_energy"))
        .drop("island")
    )
