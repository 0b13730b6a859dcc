"""Segments of speech grouped as they arrive: a new group at a change of speaker or after a pause.

Session windows close after a pause but know no speakers, and late rows may come between rows that are there already. Rows
wait in state until the watermark has passed them, are then taken in order, and a timer closes the group that nothing can join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "run string, speaker string, start_ms long, end_ms long, n long"


class SpeakerGroups(StatefulProcessor):
    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "start_ms long, seq long, end_ms long, speaker string")
        self.open = handle.getValueState("open", "speaker string, start_ms long, end_ms long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for r in frame.itertuples():
                self.waiting.appendValue((int(r.start_ms), int(r.seq), int(r.end_ms), r.speaker))
                self.handle.registerTimer(int(r.start_ms))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready, later = [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]
        if ready:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        group = tuple(self.open.get()) if self.open.exists() else None
        closed = []
        for start, _, end, speaker in ready:
            if group and speaker == group[0] and start - group[2] <= self.gap:
                group = (group[0], group[1], max(group[2], end), group[3] + 1)
            else:
                if group:
                    closed.append(group)
                group = (speaker, start, end, 1)
        if group and group[2] + self.gap < mark and not later:
            closed.append(group)
            group = None
        if group:
            self.open.update(group)
            self.handle.registerTimer(int(group[2]) + self.gap + 1)
        else:
            self.open.clear()
        yield pd.DataFrame([(key[0], *g) for g in closed], columns=["run", "speaker", "start_ms", "end_ms", "n"])

    def close(self) -> None:
        pass


def speaker_groups(segments: DataFrame, gap_ms: int = 2500, late: str = "10 seconds") -> DataFrame:
    """run, speaker, start_ms, end_ms, n of a stream of segments (run, seq, speaker, start_ms, end_ms), each group once, when it is over.

    Segments later than ``late`` are dropped. The state store must be RocksDB.
    """
    timed = segments.withColumn("at", F.timestamp_millis("start_ms")).withWatermark("at", late)
    return timed.groupBy("run").transformWithStateInPandas(SpeakerGroups(gap_ms), OUT, "append", "eventTime")


def speaker_groups_of_table(segments: DataFrame, gap_ms: int = 2500) -> DataFrame:
    """The same groups of a table."""
    w = Window.partitionBy("run").orderBy("start_ms", "seq")
    change = F.col("speaker") != F.lag("speaker").over(w)
    turned = segments.withColumn("turn", F.sum(F.coalesce(change, F.lit(True)).cast("int")).over(w))
    own = Window.partitionBy("run", "turn").orderBy("start_ms", "seq")
    so_far = F.max("end_ms").over(own.rowsBetween(Window.unboundedPreceding, -1))
    paused = turned.withColumn("part", F.sum(F.coalesce(F.col("start_ms") - so_far > gap_ms, F.lit(False)).cast("int")).over(own))
    return paused.groupBy("run", "turn", "part").agg(
        F.first("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n")
    ).select("run", "speaker", "start_ms", "end_ms", "n")
