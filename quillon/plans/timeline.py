"""Queries: interval joins, windows, streaks, grouping, voice activity over the events table as recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import moments as M
from quillon.operators import grouping, intervals, prefix, rules
from quillon.plans.catalog import query
from quillon.plans.tables import EVENTS, events, table
from quillon.sources import sinks
from quillon.streaming import jobs

TURNS = """w AS (SELECT run, seq AS word_id, "start", greatest("end", "start") AS "end" FROM e WHERE seq % 3 <> 0),
tu AS (SELECT run, speaker, "start" - 1800 AS r_start, "start" + 1800 AS r_end FROM e WHERE seq % 3 = 0),
ov AS (SELECT w.run, word_id, speaker, r_start, r_end, w."start" AS a, w."end" AS z,
   CASE WHEN w."start" = w."end" THEN 1e-9 ELSE least(w."end", r_end) - greatest(w."start", r_start) END AS o FROM w JOIN tu ON w.run = tu.run
   AND ((w."start" < r_end AND r_start < w."end") OR (w."start" = w."end" AND w."start" >= r_start AND w."start" < r_end)))"""


def _words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf_dir)
    words = e.filter("seq % 3 <> 0").select("run", F.col("seq").alias("word_id"), "start", F.greatest("end", "start").alias("end"))
    turns = e.filter("seq % 3 = 0").select("run", "speaker", (F.col("start") - 1800).alias("r_start"), (F.col("start") + 1800).alias("r_end"))
    return words, turns


@query(
    "join_10_speaker_fusion",
    f"""WITH {EVENTS}, {TURNS}, s AS (SELECT run, word_id, speaker, sum(o) AS total, min(r_start) AS since FROM ov GROUP BY ALL),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY run, word_id ORDER BY total DESC, since, speaker) = 1),
    x AS (SELECT DISTINCT p.run, p.word_id FROM ov p JOIN ov q ON p.run = q.run AND p.word_id = q.word_id AND p.speaker < q.speaker
          AND greatest(p.a, p.r_start) < least(q.z, q.r_end) AND greatest(q.a, q.r_start) < least(p.z, p.r_end))
    SELECT w.run, w.word_id, coalesce(b.speaker, 'speaker_unknown') AS speaker, x.word_id IS NOT NULL AS overlapping
    FROM w LEFT JOIN b ON w.run = b.run AND w.word_id = b.word_id LEFT JOIN x ON w.run = x.run AND w.word_id = x.word_id""",
)
def speaker_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, turns = _words(spark, sf_dir)
    return intervals.assign_speakers(words, turns, ["run"], 3600.0).select("run", "word_id", "speaker", "overlapping")


@query(
    "join_12_covered_share",
    f"""WITH {EVENTS}, {TURNS} SELECT run, word_id, round(max(o / (z - a)), 6) AS most_by_one, round(sum(o) / max(z - a), 6) AS by_all
    FROM ov WHERE z > a GROUP BY run, word_id""",
)
def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, turns = _words(spark, sf_dir)
    spans = turns.select("run", "r_start", "r_end")
    out = intervals.covered_share(words.filter("`end` > `start`").withColumnRenamed("word_id", "segment_id"), spans, ["run"], 3600.0)
    return out.select("run", F.col("segment_id").alias("word_id"), F.round("most_by_one", 6).alias("most_by_one"), F.round("by_all", 6).alias("by_all"))


@query(
    "join_14_as_of_cue",
    f"""WITH {EVENTS}, c AS (SELECT run, seq AS cue_id, "start" AS r_start, greatest("start" + 1, "end" + 7200) AS r_end FROM e WHERE seq % 2 = 0),
    p AS (SELECT run, seq, "start" AS pos FROM e WHERE seq % 2 = 1)
    SELECT p.run, p.seq, arg_max(cue_id, (r_start, r_end, cue_id)) AS cue_id FROM p JOIN c ON p.run = c.run AND r_start <= pos AND pos < r_end GROUP BY p.run, p.seq""",
)
def cue_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    cues = e.filter("seq % 2 = 0").select("run", F.col("seq").alias("cue_id"), F.col("start").alias("r_start"), (F.col("end") + 7200).alias("r_end"))
    points = e.filter("seq % 2 = 1").select("run", "seq", F.col("start").alias("at"))
    return intervals.as_of(points, cues, ["run"], 7200.0).select("run", "seq", "cue_id").filter("cue_id IS NOT NULL")


CHECKS = """v AS (SELECT *, "start" >= 0 AND "end" > "start" AS ok FROM e),
k AS (SELECT *, lag("start") OVER w AS ps, max("end") OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe
      FROM v WHERE ok WINDOW w AS (PARTITION BY run ORDER BY seq))"""


@query(
    "win_02_03_timeline_checks",
    f"""WITH {EVENTS}, {CHECKS} SELECT run, seq, coalesce("start" + 0.05 < ps, false) AS reversed,
    round(CASE WHEN pe - "start" > 1 THEN pe - "start" ELSE 0 END, 3)::DOUBLE AS overlap_by, round(CASE WHEN "start" - pe > 30 THEN "start" - pe ELSE 0 END, 3)::DOUBLE AS gap_by, ok AS valid FROM k
    UNION ALL SELECT run, seq, false, 0.0, 0.0, ok FROM v WHERE NOT ok""",
)
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intervals.timeline_checks(events(spark, sf_dir).select("run", "seq", "start", "end"), ["run"], ["seq"])
    return out.select("run", "seq", "reversed", F.round("overlap_by", 3).alias("overlap_by"), F.round("gap_by", 3).alias("gap_by"), "valid")


@query(
    "agg_15_integrity",
    f"""WITH {EVENTS}, {CHECKS}, u AS (SELECT run, min("start") AS a, max("end") AS z FROM (SELECT *, sum(CASE WHEN pe IS NULL OR "start" > pe THEN 1 ELSE 0 END)
      OVER (PARTITION BY run ORDER BY "start", "end") AS i FROM (SELECT run, "start", "end", max("end") OVER (PARTITION BY run ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM v WHERE ok)) GROUP BY run, i)
    SELECT run, count(*)::BIGINT AS n_spans, round(sum(z - a), 3) AS covered FROM u GROUP BY run""",
)
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = events(spark, sf_dir).filter("`start` >= 0 AND `end` > `start`").select("run", "start", "end")
    return intervals.union_spans(valid, ["run"]).groupBy("run").agg(
        F.count(F.lit(1)).alias("n_spans"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("covered")
    )


@query(
    "chk_16_silence_complement",
    f"""WITH {EVENTS}, {CHECKS}, u AS (SELECT run, min("start") AS a, max("end") AS z FROM (SELECT *, sum(CASE WHEN pe IS NULL OR "start" > pe THEN 1 ELSE 0 END)
      OVER (PARTITION BY run ORDER BY "start", "end") AS i FROM (SELECT run, "start", "end", max("end") OVER (PARTITION BY run ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM v WHERE ok)) GROUP BY run, i),
    g AS (SELECT run, lag(z, 1, 0) OVER (PARTITION BY run ORDER BY a) AS a, a AS z FROM u)
    SELECT run, count(*)::BIGINT AS n_gaps, round(sum(z - a), 3)::DOUBLE AS silent FROM g WHERE z - a > 0.5 GROUP BY run""",
)
def silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = events(spark, sf_dir).filter("`start` >= 0 AND `end` > `start`").select("run", "start", "end")
    duration = spans.groupBy("run").agg(F.max("end").alias("duration"))
    free = intervals.complement(spans, ["run"], duration, 0.5)
    return free.groupBy("run").agg(F.count(F.lit(1)).alias("n_gaps"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("silent"))


STREAK = """b AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY run ORDER BY seq) THEN 0 ELSE 1 END AS o FROM e),
st AS (SELECT *, sum(o) OVER (PARTITION BY run ORDER BY seq) AS g FROM b), sk AS (SELECT *, row_number() OVER (PARTITION BY run, g ORDER BY seq) AS streak FROM st)"""


@query("win_04_streaks", f"WITH {EVENTS}, {STREAK} SELECT run, seq, streak::INT AS streak FROM sk WHERE streak >= 3")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.streaks(events(spark, sf_dir), ["run"], ["seq"], "speaker").filter("streak >= 3").select("run", "seq", "streak")


@query(
    "win_05_reversals",
    f"""WITH {EVENTS} SELECT run, count(*)::BIGINT AS n FROM (SELECT run, "start" < lag("start") OVER (PARTITION BY run ORDER BY value, seq) AS back FROM e) WHERE back GROUP BY run""",
)
def reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intervals.timeline_checks(events(spark, sf_dir).select("run", "seq", "value", "start", (F.col("start") + 1).alias("end")), ["run"], ["value", "seq"], 0.0)
    return out.filter("reversed").groupBy("run").agg(F.count(F.lit(1)).alias("n"))


@query(
    "win_12_anonymous_labels",
    f"""WITH {EVENTS}, f AS (SELECT run, speaker, min("start") AS since FROM e GROUP BY run, speaker)
    SELECT run, speaker, printf('spk_%02d', row_number() OVER (PARTITION BY run ORDER BY since, speaker) - 1) AS label FROM f""",
)
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    first = events(spark, sf_dir).groupBy("run", "speaker").agg(F.min("start").alias("since"))
    number = F.row_number().over(Window.partitionBy("run").orderBy("since", "speaker")) - 1
    return first.select("run", "speaker", F.format_string("spk_%02d", number).alias("label"))


@query(
    "win_14_edges",
    f"""WITH {EVENTS} SELECT run, round(min("start"), 3) AS first_start, round(max("end"), 3) AS last_end, min("start") <= greatest(5, least(30, max("end") * 0.05)) AS head_covered FROM e GROUP BY run""",
)
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    tolerance = F.greatest(F.lit(5.0), F.least(F.lit(30.0), F.max("end") * 0.05))
    return events(spark, sf_dir).groupBy("run").agg(
        F.round(F.min("start"), 3).alias("first_start"), F.round(F.max("end"), 3).alias("last_end"), (F.min("start") <= tolerance).alias("head_covered")
    )


@query(
    "win_15_contiguity",
    f"""WITH {EVENTS} SELECT run, count_if("start" < pe)::BIGINT AS n_breaks FROM (SELECT run, "start", lag("end") OVER (PARTITION BY run ORDER BY "start", seq) AS pe FROM e) GROUP BY run""",
)
def contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("end").over(Window.partitionBy("run").orderBy("start", "seq"))
    return events(spark, sf_dir).withColumn("pe", before).groupBy("run").agg(F.count_if(F.col("start") < F.col("pe")).alias("n_breaks"))


GAPS = """gp AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY run ORDER BY ts, seq) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS o FROM e),
gs AS (SELECT *, sum(o) OVER (PARTITION BY run ORDER BY ts, seq) AS g FROM gp)"""


@query(
    "stm_04_sessions",
    f"WITH {EVENTS}, {GAPS} SELECT run, min(ts) AS \"start\", max(ts) + INTERVAL 1 HOUR AS \"end\", count(*)::BIGINT AS n FROM gs GROUP BY run, g",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.sessions(events(spark, sf_dir).select("run", "ts"), "run", "ts", "1 hour")


@query(
    "stm_ext_windows",
    f"""WITH {EVENTS} SELECT speaker, time_bucket(INTERVAL 1 HOUR, ts) AS "start", time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end",
    count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL""",
)
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.windowed(events(spark, sf_dir).select("speaker", "ts", "value"), "speaker")
    return out.withColumn("total", F.round("total", 4))


JOBS = """j AS (SELECT user_id % 50 AS job_id, user_id AS ordinal, arg_max(CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 7 = 0 THEN 'running' ELSE 'completed' END, event_id) AS status,
  arg_max((event_id % 101)::INT, event_id) AS percent FROM events GROUP BY ALL)"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 7 == 0, "running").otherwise("completed")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 50).alias("job_id"), F.col("user_id").alias("ordinal"), status.alias("status"), (F.col("event_id") % 101).cast("int").alias("percent"), F.col("event_id").alias("event_ts")
    )


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.item_states(job_events(spark, sf_dir))


@query(
    "agg_08_job_status",
    f"""WITH {JOBS} SELECT job_id, count(*)::BIGINT AS n_items, count_if(status = 'completed')::BIGINT AS completed, count_if(status = 'failed')::BIGINT AS failed,
    0::BIGINT AS cancelled, count_if(status = 'running')::BIGINT AS open, round_even(avg(percent), 0)::BIGINT AS percent,
    CASE WHEN count_if(status = 'running') > 0 THEN 'running' WHEN count_if(status = 'failed') > 0 THEN 'failed' ELSE 'completed' END AS status FROM j GROUP BY job_id""",
)
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.job_states(_states(spark, sf_dir))


@query("stm_03_recovery", f"WITH {JOBS} SELECT job_id, ordinal, CASE status WHEN 'running' THEN 'queued' ELSE status END AS status FROM j")
def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.recover(_states(spark, sf_dir)).select("job_id", "ordinal", "status")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with text: the recording's props."""
    return events(spark, sf_dir).select(
        "run", "seq", "start", F.greatest("end", F.col("start") + 1).alias("end"), "speaker", F.lit("speech").alias("modality"), F.lit("pass").alias("quality"),
        F.lit("").alias("section"), F.col("props").alias("text"),
    )


def _fold_sql(first: str, later: str, breaks: str) -> str:
    """Rows o (k: 1, 2, ... within a run) folded to f with group g; later: what is remembered, with p for the row's predecessor in f."""
    return f"""o AS (SELECT run, seq, speaker, "start" AS s, greatest("end", "start" + 1) AS z, props AS text,
      len(regexp_extract_all(props, '[A-Za-z0-9_]+'))::BIGINT AS words, length(regexp_replace(props, '[A-Za-z0-9_]', '', 'g'))::BIGINT AS others,
      row_number() OVER (PARTITION BY run ORDER BY seq) AS k FROM e),
    f AS (SELECT run, k, seq, s, z, speaker, text, 0::BIGINT AS g, s AS begun, {first} FROM o WHERE k = 1
      UNION ALL SELECT run, k, seq, s, z, speaker, text, CASE WHEN b THEN g + 1 ELSE g END, CASE WHEN b THEN s ELSE begun END, {later}
      FROM (SELECT o.*, p.g, p.begun, p.size, p.words AS w, ({breaks}) AS b FROM f p JOIN o ON o.run = p.run AND o.k = p.k + 1))"""


@query(
    "chk_07_temporal_chunks",
    f"""WITH RECURSIVE {EVENTS}, {_fold_sql("words, others AS size", "CASE WHEN b THEN words ELSE w + words END, CASE WHEN b THEN others ELSE size + 1 + others END",
    "o.speaker <> p.speaker OR o.s - p.z > 7200 OR o.s - p.begun > 36000 OR p.words + o.words + (p.size + 1 + o.others) // 8 > 320")},
    c AS (SELECT run, g, min_by(s, seq) AS "start", max_by(z, seq) AS "end", min(speaker) AS speakers, min(speaker) || '：' || string_agg(text, chr(10) ORDER BY seq) AS content, count(*)::BIGINT AS n_segments FROM f GROUP BY run, g)
    SELECT run, g::INT AS group_no, "start", "end", speakers, content, n_segments,
      (len(regexp_extract_all(content, '[A-Za-z0-9_]+')) + length(regexp_replace(content, '[A-Za-z0-9_]', '', 'g')) // 8)::BIGINT AS token_count FROM c""",
)
def temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = grouping.temporal_chunks(grouping.temporal_groups(_segments(spark, sf_dir), ["run"], gap=7200.0, span=36_000.0), ["run"])
    return chunks.withColumn("speakers", F.array_join("speakers", ","))


@query(
    "chk_11_cues",
    f"""WITH RECURSIVE {EVENTS}, {_fold_sql("words, length(text)::BIGINT AS size", "words, CASE WHEN b THEN length(text) ELSE size + length(text) END",
    "o.speaker <> p.speaker OR o.s - p.z > 3600 OR o.z - p.begun > 20000 OR p.size + length(o.text) > 60")}
    SELECT run, g::INT AS group_no, min(s) AS "start", max(z) AS "end", count(*)::BIGINT AS n FROM f GROUP BY run, g""",
)
def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.cue_groups(_segments(spark, sf_dir), ["run"], pause=3600.0, longest=20_000.0).groupBy("run", "group_no").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")
    )


@query(
    "chk_12_speaker_cues",
    f"""WITH RECURSIVE {EVENTS}, {_fold_sql("words, length(text)::BIGINT AS size", "words, CASE WHEN b THEN length(text) ELSE size + length(text) END",
    "o.speaker <> p.speaker OR (o.seq // 9) % 2 <> (p.seq // 9) % 2 OR (o.seq // 30) % 2 <> (p.seq // 30) % 2 OR o.s - p.z > 3600 OR o.z - p.begun > 20000 OR p.size + length(o.text) > 60")}
    SELECT run, g::INT AS group_no, min(seq)::BIGINT AS first_seq, count(*)::BIGINT AS n FROM f GROUP BY run, g""",
)
def speaker_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality changes every nine events, overlap every thirty."""
    words = _segments(spark, sf_dir).withColumns(
        {"quality": F.when(F.floor(F.col("seq") / 9) % 2 == 0, "pass").otherwise("review"), "overlap": F.floor(F.col("seq") / 30) % 2 == 0}
    )
    found = grouping.cue_groups(words, ["run"], pause=3600.0, longest=20_000.0, quality=True)
    return found.groupBy("run", "group_no").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"))


@query(
    "chk_13_correction_cores",
    f"""WITH RECURSIVE {EVENTS}, {_fold_sql("words, 1::BIGINT AS size", "words, CASE WHEN b THEN 1 ELSE size + 1 END", "p.size >= 48 OR o.z - p.begun > 86400")},
    c AS (SELECT run, g, min(k) - 1 AS core_first, max(k) - 1 AS core_last, min_by(s, k) AS core_start, max_by(z, k) AS core_end FROM f GROUP BY run, g),
    n AS (SELECT run, max(k) - 1 AS most FROM o GROUP BY run),
    l AS (SELECT c.run, c.g, max(o.k) AS beyond FROM c JOIN o ON o.run = c.run AND o.k - 1 < c.core_first - 2 AND c.core_start - o.z > 3600 GROUP BY c.run, c.g),
    h AS (SELECT c.run, c.g, min(o.k) - 2 AS beyond FROM c JOIN o ON o.run = c.run AND o.k - 1 > c.core_last + 2 AND o.s - c.core_end > 3600 GROUP BY c.run, c.g)
    SELECT c.run, c.g::INT AS ordinal, core_first, core_last, core_start, core_end, least(greatest(0, core_first - 2), coalesce(l.beyond, 0))::BIGINT AS context_first,
      greatest(least(most, core_last + 2), coalesce(h.beyond, most))::BIGINT AS context_last
    FROM c JOIN n USING (run) LEFT JOIN l ON l.run = c.run AND l.g = c.g LEFT JOIN h ON h.run = c.run AND h.g = c.g""",
)
def cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cored = grouping.core_groups(_segments(spark, sf_dir), ["run"], 86_400.0)
    return grouping.correction_plan(cored, ["run"], reach=3600.0)


@query(
    "chk_14_paragraphs",
    f"""WITH RECURSIVE {EVENTS}, {_fold_sql("words, length(text)::BIGINT AS size", "words, CASE WHEN b THEN length(text) ELSE size + length(text) END",
    "o.seq % 50 = 0 OR o.speaker <> p.speaker OR o.s - p.z > 3600 OR o.z - p.begun > 86400 OR p.size + length(o.text) > 700")}
    SELECT run, g::INT AS group_no, count(*)::BIGINT AS n, min(seq)::BIGINT AS first_seq FROM f GROUP BY run, g""",
)
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth event begins a chapter."""
    rows = _segments(spark, sf_dir).withColumns({"size": F.length("text").cast("long"), "chapter": F.col("seq") % 50 == 0})
    grouped = grouping.paragraph_groups(rows, ["run"], 3600.0, 86_400.0, 700)
    return grouped.groupBy("run", "group_no").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


VAD = """f AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n, CASE WHEN (event_id // 40) % 3 = 0 THEN 10 ELSE 400 END + value AS energy FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY energy, n) AS k, count(*) OVER (PARTITION BY run) AS c FROM f),
l AS (SELECT run, greatest(220.0, median(energy) * 3) AS lim FROM r WHERE k <= greatest(1, c // 5) GROUP BY run),
s AS (SELECT run, n, c, n - lag(n) OVER (PARTITION BY run ORDER BY n) - 1 AS gap FROM r JOIN l USING (run) WHERE energy >= lim),
t AS (SELECT *, sum(CASE WHEN gap > 14 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY n) AS g FROM s),
b AS (SELECT run, g, min(n) AS a, max(n) AS z, any_value(c) AS c FROM t GROUP BY run, g HAVING max(n) - min(n) + 1 >= 8),
p AS (SELECT run, greatest(0, a * 0.03::DOUBLE - 0.18::DOUBLE) AS a, least(c * 0.03::DOUBLE, (z + 1) * 0.03::DOUBLE + 0.18::DOUBLE) AS z FROM b),
q AS (SELECT *, max(z) OVER (PARTITION BY run ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM p),
u AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY a, z) AS i FROM q)"""


@query("chk_15_voice_activity", f"WITH {VAD} SELECT run, round(min(a), 4) AS \"start\", round(max(z), 4) AS \"end\" FROM u GROUP BY run, i")
def voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kind of events as a recording of frames, which any number of tasks share."""
    e = prefix.dealt(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), ["event_type", "event_id"], label="frames")
    e = prefix.running_totals(e, ["event_type"], ["event_id"], {"n": F.lit(1).cast("long")}).withColumn("n", F.col("n") - 1)
    energy = F.when(F.floor(F.col("event_id") / 40) % 3 == 0, 10).otherwise(400) + F.col("value")
    frames = e.select(F.col("event_type").alias("run"), "n", energy.alias("energy"))
    out = intervals.voice_spans(frames, ["run"])
    return out.select("run", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


@query(
    "agg_20_audio_stats",
    """SELECT event_type AS run, round(sqrt(avg(value * value)), 6) AS rms, round(avg((abs(value) < 20)::INT), 6)::DOUBLE AS silent, round(avg((abs(value) >= 100)::INT), 6)::DOUBLE AS clipped
       FROM events GROUP BY event_type""",
)
def audio_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return e.groupBy(F.col("event_type").alias("run")).agg(
        F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"), share(F.abs("value") < 20).alias("silent"), share(F.abs("value") >= 100).alias("clipped")
    )


@query(
    "rul_02_segment_issues",
    f"""WITH {EVENTS}, {STREAK} SELECT seq AS segment_id, 'repetition_loop' AS code FROM sk WHERE streak >= 3
    UNION ALL SELECT seq, 'low_confidence' FROM e WHERE value / 100 < 0.62
    UNION ALL SELECT seq, 'empty_segment' FROM e WHERE seq % 97 = 0
    UNION ALL SELECT seq, 'truncated' FROM e WHERE seq % 89 = 0""",
)
def segment_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.when(F.col("seq") % 89 == 0, F.array(F.lit("truncated"))).otherwise(F.array().cast("array<string>"))
    rows = intervals.streaks(events(spark, sf_dir), ["run"], ["seq"], "speaker").select(
        F.col("seq").alias("segment_id"), F.when(F.col("seq") % 97 == 0, " ").otherwise("word").alias("text"), "start", "end", (F.col("value") / 100).alias("confidence"), flags.alias("flags"), "streak"
    )
    return rules.segment_issues(rows).select("segment_id", "code")


@query(
    "rul_03_transcript_status",
    f"""WITH {EVENTS}, t AS (SELECT run, bool_or(seq % 97 = 0) AS bad, bool_or(value / 100 < 0.62) AS odd FROM e GROUP BY run)
    SELECT run, CASE WHEN bad THEN 'fail' WHEN odd THEN 'review' ELSE 'pass' END AS status FROM t""",
)
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    found = rules.findings(e, ["run"], [rules.Rule("bad", "error", F.col("seq") % 97 == 0), rules.Rule("odd", "warning", F.col("value") / 100 < 0.62)])
    worst = rules.worst(found, ["run"])
    return e.select("run").distinct().join(worst, "run", "left").select("run", F.coalesce("status", F.lit("pass")).alias("status"))


@query(
    "snk_12_subtitles",
    f"""WITH {EVENTS}, s AS (SELECT run, seq, ("start" * 1000)::BIGINT AS a, speaker FROM e WHERE "start" >= 0)
    SELECT run, 'WEBVTT' || chr(10) || chr(10) || string_agg(printf('%02d:%02d:%02d.%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' ||
      printf('%02d:%02d:%02d.%03d', (a + 1500) // 3600000, (a + 1500) // 60000 % 60, (a + 1500) // 1000 % 60, (a + 1500) % 1000) || chr(10) || speaker, chr(10) || chr(10) ORDER BY seq) AS subtitles FROM s GROUP BY run""",
)
def subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.round(F.col("start") * 1000).cast("long")
    rows = events(spark, sf_dir).filter("`start` >= 0").select("run", F.col("seq").alias("ordinal"), ms.alias("start_ms"), (ms + 1500).alias("end_ms"), F.col("speaker").alias("text"))
    return sinks.subtitles(rows, ["run"], "vtt")


@query(
    "str_20_clock",
    f"""WITH {EVENTS} SELECT seq, printf('%02d:%02d:%02d', floor("start")::BIGINT // 3600, floor("start")::BIGINT // 60 % 60, floor("start")::BIGINT % 60) AS at FROM e WHERE "start" >= 0""".replace(" AS at ", ' AS "at" '),
)
def clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("`start` >= 0").select("seq", M.clock(F.col("start")).alias("at"))


@query(
    "jsn_01_json_fields",
    """SELECT json_extract_string(props, '$.' || json_keys(props)[1]) AS value, count(*)::BIGINT AS n FROM events GROUP BY 1""",
)
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    first = F.get(F.json_object_keys("props"), F.lit(0))
    value = F.get(F.map_values(F.from_json("props", "map<string,string>")), F.lit(0))
    return e.filter(first.isNotNull() | F.col("props").isNull() | F.lit(True)).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
