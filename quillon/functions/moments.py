"""Dates and positions in time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_second(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def clock(seconds: Column) -> Column:
    """HH:MM:SS."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)


def cue_time(milliseconds: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm; the mark is a comma in SRT and a full stop in VTT."""
    ms = milliseconds.cast("long")
    whole = F.floor(ms / 1000)
    return F.format_string(
        f"%02d:%02d:%02d{mark}%03d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, ms % 1000
    )


def parse_cue_time(text: Column) -> Column:
    """Seconds of [HH:]MM:SS[.,]mmm."""
    parts = F.split(F.replace(F.trim(text), F.lit(","), F.lit(".")), ":")
    return F.aggregate(F.transform(parts, lambda p: p.try_cast("double")), F.lit(0.0), lambda s, p: s * 60 + p)


def is_stale(updated: Column, as_of: Column, days: int = 120) -> Column:
    """Older than the cutoff; what can't be read isn't stale."""
    return F.coalesce(F.try_to_timestamp(updated) < as_of - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))


def expired(valid_until: Column, today: Column) -> Column:
    """(state) 'expired', 'invalid' or null, by the first ten characters."""
    day = F.to_date(F.try_to_timestamp(F.substring(valid_until, 1, 10), F.lit("yyyy-MM-dd")))
    given = F.coalesce(valid_until, F.lit("")) != ""
    return F.when(given & day.isNull(), F.lit("invalid")).when(given & (day < today), F.lit("expired"))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Into [low, high]; what isn't a finite number is null."""
    number = value.try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(finite, F.least(F.greatest(number, F.lit(low)), F.lit(high)))
