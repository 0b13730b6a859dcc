"""Queries: transcript quality, corrections, OCR summaries, packages, and the joins and roll-ups around answers and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import external, filters, incremental, intervals, qa, rules, transcripts
from quillon.plans.catalog import query
from quillon.plans.tables import DOCS, EVENTS, documents, events, messages, table
from quillon.sources import readers


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = intervals.streaks(events(spark, sf_dir), ["run"], ["seq"], "speaker")
    ms = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long")
    flags = F.when(F.col("seq") % 89 == 0, F.array(F.lit("truncated"))).when(F.col("seq") % 5 == 0, F.array(F.lit("overlap"))).otherwise(F.array().cast("array<string>"))
    speaker = F.when(F.col("speaker") == "view", "speaker_unknown").otherwise(F.col("speaker"))
    return e.select(F.col("run").alias("run_id"), F.col("seq").alias("ordinal"), ms("start").alias("start_ms"), ms("end").alias("end_ms"), speaker.alias("speaker_id"), F.lit("word").alias("text"), flags.alias("flags"), "streak")


@query(
    "agg_17_transcript_quality",
    f"""WITH {EVENTS}, s AS (SELECT run, seq, floor("start" * 1000 + 0.5)::BIGINT AS a, floor("end" * 1000 + 0.5)::BIGINT AS z, CASE WHEN speaker = 'view' THEN 'speaker_unknown' ELSE speaker END AS sp FROM e),
    l AS (SELECT *, greatest(z - a, 0) AS len, lag(a) OVER (PARTITION BY run ORDER BY seq) AS pa, CASE WHEN sp = lag(sp) OVER (PARTITION BY run ORDER BY seq) THEN 0 ELSE 1 END AS o FROM s),
    g AS (SELECT *, sum(o) OVER (PARTITION BY run ORDER BY seq) AS i FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY run, i ORDER BY seq) AS streak FROM g),
    t AS (SELECT run, count(*) AS n, count_if(a < 0 OR z <= a) AS bad, count_if(a < pa) AS back, count_if(streak >= 3) AS rep, count_if(seq % 89 = 0) AS tr, count_if(len > 0 AND 4 * 1000.0 / greatest(len, 1) > 30) AS fast,
      count_if(len < 1000) AS short, sum(len) AS speech, sum(CASE WHEN sp = 'speaker_unknown' THEN len ELSE 0 END) AS unk, sum(CASE WHEN seq % 5 = 0 AND seq % 89 <> 0 THEN len ELSE 0 END) AS ov,
      count(DISTINCT CASE WHEN sp <> 'speaker_unknown' THEN sp END) AS ns, max(z) AS last FROM k GROUP BY run)
    SELECT run AS run_id, unnest(list_filter(['' || CASE WHEN bad > 0 THEN 'invalid_timestamp' ELSE '' END, CASE WHEN last > 2500000000 + 25000000 THEN 'timestamp_out_of_bounds' ELSE '' END, CASE WHEN back > 0 THEN 'timestamp_reversal' ELSE '' END,
      CASE WHEN rep > 0 THEN 'repetition' ELSE '' END, CASE WHEN tr > 0 THEN 'truncated' ELSE '' END, CASE WHEN fast > 0 THEN 'abnormal_character_rate' ELSE '' END, CASE WHEN ns <> 4 THEN 'speaker_count_mismatch' ELSE '' END,
      CASE WHEN n >= 4 AND short / n > 0.5 THEN 'speaker_fragmentation' ELSE '' END, CASE WHEN unk / speech > 0.2 THEN 'speaker_unknown' ELSE '' END, CASE WHEN ov / speech > 0.15 THEN 'speaker_overlap' ELSE '' END], lambda x: x <> '')) AS code FROM t""",
)
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = _segments(spark, sf_dir).drop("streak")
    again = intervals.streaks(segments.withColumn("key", F.col("speaker_id")), ["run_id"], ["ordinal"], "key").drop("key")
    runs = segments.select("run_id").distinct().select(
        "run_id", F.lit(2_500_000_000).cast("long").alias("duration_ms"), F.lit(4).alias("expected_speakers"), F.lit(True).alias("diarized"), F.lit("en").alias("language"),
        F.lit(0.1).alias("silence_ratio"), F.lit(0.0).alias("clipping_ratio"), F.lit(-20.0).alias("loudness"),
    )
    return transcripts.run_quality(again, runs).select("run_id", "code")


@query(
    "agg_21_mean_confidence",
    "SELECT l_orderkey, round(avg(l_discount), 6) AS confidence FROM (SELECT l_orderkey, l_discount FROM lineitem UNION ALL SELECT o_orderkey, 0.5 FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) GROUP BY l_orderkey",
)
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("words"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return words.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", F.round(transcripts.mean_confidence(F.lit(0.5), F.col("words")), 6).alias("confidence"))


@query(
    "src_07_ocr_summary",
    """SELECT l_orderkey AS document_id, count(DISTINCT l_linenumber)::BIGINT AS n_pages, count(*)::BIGINT AS n_lines, round(avg(l_discount), 6) AS mean_confidence, round(min(l_discount), 6) AS min_confidence,
       count_if(l_discount < 0.05)::BIGINT AS n_low FROM lineitem GROUP BY l_orderkey""",
)
def ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page"), F.col("l_discount").alias("confidence"))
    return transcripts.ocr_summary(lines, 0.05)


@query(
    "agg_25_card_confidence",
    "SELECT o_custkey AS card_id, round(min(l_discount), 6) AS confidence FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey",
)
def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("card_id")).agg(F.collect_set("o_orderkey").alias("segment_ids"))
    changes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("segment_id"), F.col("l_discount").alias("confidence"))
    return transcripts.card_confidence(held, changes).select("card_id", F.round("confidence", 6).alias("confidence"))


@query(
    "inc_13_review_state",
    "SELECT user_id AS change_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id",
)
def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    changes = e.select(F.col("user_id").alias("change_id")).distinct()
    return transcripts.review_state(changes, e.select(F.col("user_id").alias("change_id"), F.col("event_id").alias("at"), F.col("event_type").alias("status")))


@query(
    "rul_10_auto_accept",
    "SELECT l_orderkey AS change_id FROM (SELECT l_orderkey, min(l_discount) AS d FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey) WHERE d >= 0.04 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')",
)
def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("change_id")).agg(F.min("l_discount").alias("confidence")).withColumn("status", F.lit("proposed"))
    proof = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_id"), (F.col("o_orderstatus") == "O").alias("verified"))
    return transcripts.auto_accept(changes, proof, 0.04)


@query(
    "snk_09_changed_facts",
    "SELECT count(*)::BIGINT AS n FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 100 = 0 AND o_totalprice <> o_totalprice + 1) t, range(2)",
)
def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    again = stored.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 100 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return transcripts.changed_facts(stored, again).agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt_09_relevant_hits",
    r"""SELECT page_id, contains(lower(url), 'page') OR contains(lower(html), 'page') AS relevant FROM pages""",
)
def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", transcripts.relevant_hit(F.lit("The PAGE of"), F.col("url"), F.col("html")).alias("relevant"))


@query(
    "chk_18_packages",
    "SELECT source AS stem, count(DISTINCT f)::BIGINT AS n FROM (SELECT source, '/in/' || upper(source) || k AS f FROM documents, (VALUES ('-transcript.txt'), ('_slides.pdf'), ('.mp4')) AS v(k)) GROUP BY source",
)
def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.explode(F.array(F.lit("-transcript.txt"), F.lit("_slides.pdf"), F.lit(".mp4")))
    files = table(spark, sf_dir, "documents").select("source", names.alias("k")).select(F.concat(F.lit("/in/"), F.upper("source"), "k").alias("path"))
    return readers.packages(files).select("stem", F.size("members").cast("long").alias("n"))


@query(
    "join_22_citation_targets",
    f"WITH {DOCS} SELECT DISTINCT l.doc_id, l.toxic FROM labels l WHERE l.doc_id IN (SELECT document_id FROM d WHERE lang = 'en') OR l.quality IN (SELECT 0)",
)
def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An OR of two equi-joins is the union of two semi-joins."""
    labels = table(spark, sf_dir, "labels")
    by_document = labels.join(documents(spark, sf_dir).filter("lang = 'en'").select(F.col("document_id").alias("doc_id")), "doc_id", "left_semi")
    return by_document.unionAll(labels.filter("quality = 0")).select("doc_id", "toxic").distinct()


@query(
    "join_23_belongs",
    "SELECT l_orderkey, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = l_linestatus)",
)
def belongs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("l_linestatus"))
    return filters.belonging(table(spark, sf_dir, "lineitem"), o, ["l_orderkey", "l_linestatus"]).select("l_orderkey", "l_partkey")


@query(
    "join_24_answers_with_questions",
    "SELECT a.conv_id, a.turn, q.text AS question FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant' AND q.role = 'user'",
)
def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    asked = m.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return m.filter("role = 'assistant'").join(asked, ["conv_id", "turn"]).select("conv_id", "turn", "question")


@query(
    "agg_23_import_summary",
    "SELECT user_id AS run, count_if(event_type = 'purchase')::BIGINT AS succeeded, count_if(event_type = 'error')::BIGINT AS failed, count_if(event_type = 'view')::BIGINT AS cancelled FROM events GROUP BY user_id",
)
def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "succeeded").when(kind == "error", "failed").when(kind == "view", "cancelled")
    return incremental.import_summary(table(spark, sf_dir, "events").withColumn("run", F.col("user_id")), ["run"], status)


@query(
    "agg_26_health_rollup",
    "SELECT (SELECT count(*) FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id)::BIGINT AS unassessed, (SELECT count(*) FROM labels WHERE quality = 0)::BIGINT AS low, (SELECT count(*) FROM documents WHERE length(text) < 80)::BIGINT AS thin",
)
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    assessed = labels.select(F.col("doc_id").alias("document_id"), (F.col("quality") == 0).alias("low"))
    return rules.health_rollup(d.select(F.col("doc_id").alias("document_id"), F.length("text").alias("n_chars")), assessed)


@query(
    "map_01_merge_metadata",
    "SELECT doc_id, lang AS a, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'old' END AS b FROM documents",
)
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newer map wins; only allowed keys stay."""
    old = F.create_map(F.lit("a"), "lang", F.lit("b"), F.lit("old"), F.lit("x"), F.lit("dropped"))
    new = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("b"), "source")).otherwise(F.create_map(F.lit("b"), F.lit("old")))
    merged = incremental.merge_metadata(old, new, ["a", "b"]).alias("m")
    return table(spark, sf_dir, "documents").select("doc_id", merged).select("doc_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query(
    "jsn_05_evidence_lines",
    """SELECT doc_id, length('{"content":"' || left(regexp_replace(text, '[^a-z ]', '', 'g'), 3600) || '","evidence_id":"S' || doc_id || '","instruction_risk":false,"title":"' || source || '"}')::BIGINT AS n FROM documents""",
)
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    evidence = d.select("doc_id", F.regexp_replace("text", "[^a-z ]", "").alias("content"), F.concat(F.lit("S"), "doc_id").alias("evidence_id"), F.lit(False).alias("instruction_risk"), F.col("source").alias("title"))
    return evidence.select("doc_id", F.length(qa.evidence_line()).cast("long").alias("n"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary from the texts: what documents begin with, whatever stands around it elsewhere."""
    first = T.first_index_term(F.col("text"))
    words = table(spark, sf_dir, "documents").groupBy(first.alias("variant")).agg(F.min("doc_id").alias("position"))
    return words.filter("length(variant) > 5").withColumn("canonical", F.concat("variant", F.lit(" (term)")))


@query("rul_09_external_queries")
def external_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "documents").select(F.col("source").alias("run_id"), F.col("doc_id").alias("ordinal"), F.upper("text").alias("text"))
    return external.external_queries(segments, _names(spark, sf_dir))


@query(
    "str_09_glossary_hits",
    r"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents),
    v AS (SELECT DISTINCT regexp_extract(strip_accents(t), '([\p{L}\p{N}]+)', 1) AS v FROM d), w AS (SELECT v FROM v WHERE length(v) > 5),
    p AS (SELECT doc_id, v, list_transform(string_split(t, v), lambda x: length(x)) AS sizes FROM d JOIN w ON contains(t, v)),
    s AS (SELECT doc_id, v, unnest(list_transform(range(1, len(sizes)), lambda i: list_sum(sizes[1:i])::BIGINT + (i - 1) * length(v))) AS place FROM p)
    SELECT doc_id, v AS variant, count(*)::BIGINT AS n, min(place)::BIGINT AS first, sum(place)::BIGINT AS places FROM s GROUP BY doc_id, v""",
)
def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("segment_id"), "text")
    hits = transcripts.glossary_hits(segments, _names(spark, sf_dir))
    return hits.groupBy(F.col("segment_id").alias("doc_id"), "variant").agg(
        F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.sum("start").alias("places")
    )
