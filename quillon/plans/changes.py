"""Queries: changes of several tables as one commit, and what readers see after them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.index import InTransaction, TextIndex
from quillon.plans.catalog import query
from quillon.plans.tables import EDGES, ITEMS, documents, items, messages, relations
from quillon.plans.timeline import JOBS, job_events
from quillon.sources import commits, storage
from quillon.streaming import jobs


def _log(spark: SparkSession) -> commits.CommitLog:
    return commits.CommitLog(spark, f"{storage.shared_dir(spark)}/quillon-log-{uuid.uuid4().hex}")


@query(
    "snk_10_saved_answers",
    """WITH u AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role <> 'assistant' GROUP BY conv_id),
    a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, text FROM conversations WHERE role = 'assistant')
    SELECT a.conv_id AS conversation_id, (coalesce(u.last, 0) + k)::BIGINT AS ordinal, md5(text) AS digest, 1 AS n_evidence, 1 AS n_citations FROM a LEFT JOIN u USING (conv_id)""",
)
def saved_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns saved as answers behind what users wrote: each with its message, evidence and citation."""
    m, log = messages(spark, sf_dir), _log(spark)
    asked = m.filter("role <> 'assistant'").select(F.col("conv_id").alias("conversation_id"), F.col("turn").cast("long").alias("ordinal"), "role", "text")
    log.run(lambda t: t.append("messages", asked), "messages")
    number = F.concat_ws("-", "conv_id", F.lpad(F.col("turn").cast("string"), 9, "0"))
    answers = m.filter("role = 'assistant'").select(number.alias("answer_id"), F.col("conv_id").alias("conversation_id"), "text")
    evidence = answers.select("answer_id", F.lit("S1").alias("evidence_id"), F.md5("text").alias("chunk_id"))
    commits.save_answer(log, answers, evidence, evidence.select("answer_id", "evidence_id"))
    count = lambda name, n: log.read(name).groupBy("answer_id").agg(F.count(F.lit(1)).cast("int").alias(n))
    held = log.read("messages").join(count("answer_evidence", "n_evidence"), "answer_id").join(count("citations", "n_citations"), "answer_id")
    return held.select("conversation_id", "ordinal", F.md5("text").alias("digest"), "n_evidence", "n_citations")


@query(
    "inc_09_approved",
    rf"""WITH d AS (SELECT doc_id, doc_id % 5 = 0 AS held, doc_id % 10 = 0 AS approved, len(regexp_extract_all(translate(lower(source), '{T.ACCENTED}', '{T.PLAIN}'), '[\p{{L}}\p{{N}}]+'))
      + len(regexp_extract_all(translate(lower(text), '{T.ACCENTED}', '{T.PLAIN}'), '[\p{{L}}\p{{N}}]+')) AS n FROM documents)
    SELECT doc_id AS document_id, CASE WHEN approved THEN 'approved' WHEN held THEN 'quarantined' ELSE 'ready' END AS status, NOT held OR approved AS enabled,
      CASE WHEN approved THEN n::INT ELSE 0 END AS n_terms FROM d""",
)
def approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after some of those in quarantine were approved, indexed and enabled in one commit."""
    d, log = documents(spark, sf_dir), _log(spark)
    held = F.col("document_id") % 5 == 0
    state = d.select("document_id", F.when(held, "quarantined").otherwise("ready").alias("status"), (~held).alias("enabled"))
    chunks = d.select("document_id", "chunk_id", F.col("source").alias("title"), "content")

    def begin(t: commits.Transaction) -> None:
        t.append("documents", state)
        t.append("chunks", chunks)

    log.run(begin, "documents")
    commits.approve(log, d.filter("document_id % 10 = 0").select("document_id"), lambda t, rows: TextIndex(spark, "", store=InTransaction(t)).upsert(rows.drop("document_id")))
    entries = log.read("index_entries").select(F.col("chunk_id").alias("document_id"), "n_terms")
    return log.read("documents").join(entries, "document_id", "left").select("document_id", "status", "enabled", F.coalesce("n_terms", F.lit(0)).alias("n_terms"))


DELETED = "(item_id LIKE 's%' AND substr(item_id, 2)::INT % 3 = 0) OR (item_id LIKE 'n%' AND substr(item_id, 2)::INT % 4 = 0) OR item_id = 'r1'"
RESTORED = "(item_id LIKE 's%' AND substr(item_id, 2)::INT % 2 = 0) OR item_id = 'n4' OR item_id = 'r1'"


@query(
    "rul_15_restored",
    f"""WITH {EDGES}, {ITEMS}, l AS (SELECT item_id FROM i WHERE NOT ({DELETED}) OR ({RESTORED}))
    SELECT * FROM r WHERE source_id IN (SELECT item_id FROM l) AND target_id IN (SELECT item_id FROM l)
    UNION ALL SELECT item_id, alias, 'alias' FROM (SELECT item_id, lower(title) AS alias FROM i) WHERE item_id IN (SELECT item_id FROM l)""",
)
def restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations and aliases after items were deleted and some of them restored, in two steps."""
    i, log = items(spark, sf_dir), _log(spark)

    def begin(t: commits.Transaction) -> None:
        t.append("items", i.select("item_id", "item_type", "title"))
        t.append("aliases", i.select("item_id", F.lower("title").alias("alias")))
        t.append("item_tags", i.select("item_id", F.explode("tags").alias("tag")))
        t.append("relations", relations(spark, sf_dir))

    log.run(begin, "graph")
    where = lambda c: i.filter(c.replace("::INT", "")).select("item_id")
    commits.delete_items(log, where(f"({DELETED}) AND item_id <> 'r1'"))
    commits.delete_items(log, where("item_id = 'r1'"))
    commits.restore_items(log, where(f"({DELETED}) AND ({RESTORED}) AND item_id <> 'r1'"))
    commits.restore_items(log, where("item_id = 'r1'"))
    aliases = log.read("aliases").select(F.col("item_id").alias("source_id"), F.col("alias").alias("target_id"), F.lit("alias").alias("relation_type"))
    return log.read("relations").select("source_id", "target_id", "relation_type").unionAll(aliases)


@query("stm_02_streamed_states", f"WITH {JOBS} SELECT job_id, ordinal, status, percent FROM j")
def streamed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item states from a stream that is stopped twice and goes on from its checkpoint; each time older events arrive, too."""
    root, log = f"{storage.shared_dir(spark)}/quillon-stream-{uuid.uuid4().hex}", _log(spark)
    events = job_events(spark, sf_dir)
    for part in range(3):
        events.filter(F.col("event_ts") % 3 == part).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        jobs.keep_states(log, jobs.item_states(stream), f"{root}/checkpoint").awaitTermination()
    return log.read("items").select("job_id", "ordinal", "status", "percent")
