"""Structured Streaming: watched folders, job progress, gap-delimited sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.incremental import job_status
from quillon.sources import schemas
from quillon.sources.commits import CommitLog, Transaction


def watch_folder(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """New files of a folder as (path, text), each once; the checkpoint remembers which were read."""
    files = spark.readStream.format("text").schema("value string").option("wholetext", True).option("pathGlobFilter", glob)
    return files.load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def ingest(stream: DataFrame, checkpoint: str, upsert: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Feed every micro-batch to an upsert that may be repeated for the same batch number."""
    return (
        stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def progress_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.JOB_EVENT).json(path)


def item_states(events: DataFrame) -> DataFrame:
    """The latest state of each job item; in update mode a row for each item that changed."""
    last = F.max_by(F.struct("status", "percent"), "event_ts").alias("last")
    return events.groupBy("job_id", "ordinal").agg(last).select("job_id", "ordinal", "last.status", "last.percent")


def keep_states(log: CommitLog, states: DataFrame, checkpoint: str) -> StreamingQuery:
    """Keep a table ``items`` at the latest state of each job item; a batch is one commit, and repeating it changes nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        def change(t: Transaction) -> None:
            if t.has("items"):
                t.replace("items", t.read("items").join(batch, ["job_id", "ordinal"], "left_anti").unionByName(batch))
            else:
                t.append("items", batch)

        log.run(change, "states")

    return states.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_states(states: DataFrame) -> DataFrame:
    """Job counts from item states: recomputed, so that a replayed event changes nothing."""
    return job_status(states, ["job_id"])


def recover(states: DataFrame) -> DataFrame:
    """After a restart nothing runs: running items are queued again."""
    return states.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))


def finalize(states: DataFrame) -> DataFrame:
    """job_id, status of jobs whose work is over: failed where an item failed, cancelled where one was, else completed; open items keep a
    job running."""
    return job_status(states, ["job_id"]).select("job_id", "status")


def fail(states: DataFrame, jobs: DataFrame) -> DataFrame:
    """states after these jobs (job_id) failed: what was open failed, too."""
    return _moved(states, jobs, ("queued", "running"), "failed")


def cancel(states: DataFrame, jobs: DataFrame) -> DataFrame:
    """states after these jobs were cancelled: what is done stays done."""
    return _moved(states, jobs, ("queued", "running"), "cancelled")


def reset(states: DataFrame, jobs: DataFrame) -> DataFrame:
    """states after these jobs are to be tried again: failed and cancelled items wait, from the beginning."""
    return _moved(states, jobs, ("failed", "cancelled"), "queued", 0.0)


def _moved(states: DataFrame, jobs: DataFrame, of: tuple[str, ...], to: str, percent: float | None = None) -> DataFrame:
    marked = states.join(jobs.select("job_id").distinct().withColumn("__hit", F.lit(True)), "job_id", "left")
    takes = F.col("__hit") & F.col("status").isin(*of)
    out = marked.withColumn("__takes", F.coalesce(takes, F.lit(False))).withColumn("status", F.when(F.col("__takes"), to).otherwise(F.col("status")))
    if percent is not None:
        out = out.withColumn("percent", F.when(F.col("__takes"), F.lit(percent).cast(states.schema["percent"].dataType)).otherwise(F.col("percent")))
    return out.select(states.columns)


def sessions(events: DataFrame, by: str, at: str = "ts", gap: str = "8 seconds", late: str = "10 minutes") -> DataFrame:
    """Groups of events (by, at) that no gap divides; works on streams and on tables."""
    return (
        events.withWatermark(at, late)
        .groupBy(by, F.session_window(at, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def windowed(events: DataFrame, by: str, at: str = "ts", size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of value by time window; on a stream rows later than `late` are dropped."""
    span = F.window(at, size, slide) if slide else F.window(at, size)
    return (
        events.withWatermark(at, late)
        .groupBy(by, span.alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
    )
