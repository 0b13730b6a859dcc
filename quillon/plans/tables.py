"""The driver's tables in the roles that the engine's operators expect, with the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge documents: language as collection, source as folder and tag."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".md"))
    return d.select(
        F.col("doc_id").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.concat(F.col("source"), F.lit(" "), F.col("lang")).alias("title"),
        F.col("text").alias("content"), "lang", "source", F.concat(F.lit("/library/"), "source", F.lit("/"), "lang", F.lit("/"), name).alias("path"),
        F.when(F.col("doc_id") % 3 == 0, "pdf").otherwise("text").alias("media_type"), (F.col("doc_id") % 17 != 0).alias("enabled"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")).alias("updated_at"), "n_chars",
    )


DOCS = """d AS (SELECT doc_id AS document_id, doc_id AS chunk_id, source || ' ' || lang AS title, text AS content, lang, source,
  '/library/' || source || '/' || lang || '/doc-' || doc_id || '.md' AS path,
  CASE WHEN doc_id % 3 = 0 THEN 'pdf' ELSE 'text' END AS media_type, doc_id % 17 <> 0 AS enabled,
  '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS updated_at, n_chars FROM documents)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed segments: a user's events as a recording, the type as modality and speaker; times in seconds of the day."""
    e = table(spark, sf_dir, "events")
    at = F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)") / 1000) / 1000.0
    length = F.col("event_id") % 40 - 2
    return e.select(
        F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.col("event_type").alias("speaker"), at.alias("start"),
        (at + length).alias("end"), F.col("value").alias("value"), "props", "ts",
    )


EVENTS = """e AS (SELECT user_id AS run, event_id AS seq, event_type AS speaker,
  floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000.0) / 1000.0::DOUBLE AS "start",
  floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000.0) / 1000.0::DOUBLE + (event_id % 40 - 2) AS "end", value, props, ts FROM events)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge items: regions and nations as topics, customers as entities, orders' clerks left aside, suppliers as sources."""
    kinds = [
        ("region", "r_regionkey", "r_name", "topic", "r", F.lit("")),
        ("nation", "n_nationkey", "n_name", "topic", "n", F.lit("body")),
        ("customer", "c_custkey", "c_name", "entity", "c", F.col("c_mktsegment")),
        ("supplier", "s_suppkey", "s_name", "source", "s", F.lit("")),
    ]
    out = None
    for name, key, title, kind, prefix, body in kinds:
        df = table(spark, sf_dir, name).select(
            F.concat(F.lit(prefix), F.col(key)).alias("item_id"), F.lit(kind).alias("item_type"), F.col(title).alias("title"),
            F.when(F.col(key) % 3 == 0, "compiled").otherwise("indexed").alias("maturity"),
            F.when(F.col(key) % 7 == 0, "stale").when(F.col(key) % 11 == 0, "archived").otherwise("current").alias("status"),
            F.when(F.col(key) % 2 == 0, "").otherwise("about").alias("summary"), body.alias("body"), (F.col(key) % 5 == 0).alias("high_value"),
            (F.col(key) % 13 != 0).alias("has_evidence"), (F.col(key) % 19 != 0).alias("has_metadata"),
            F.array(F.lit("kept"), F.when(F.col(key) % 4 == 0, "Not Kebab").otherwise("kebab-case")).alias("tags"),
            F.when(F.col(key) % 6 == 0, "2023-01-01T00:00:00Z").otherwise("2024-06-01T00:00:00Z").alias("updated_at"),
        )
        out = df if out is None else out.unionByName(df)
    return out


def _items_sql() -> str:
    parts = []
    for name, key, title, kind, prefix, body in (
        ("region", "r_regionkey", "r_name", "topic", "r", "''"), ("nation", "n_nationkey", "n_name", "topic", "n", "'body'"),
        ("customer", "c_custkey", "c_name", "entity", "c", "c_mktsegment"), ("supplier", "s_suppkey", "s_name", "source", "s", "''"),
    ):
        parts.append(
            f"""SELECT '{prefix}' || {key} AS item_id, '{kind}' AS item_type, {title} AS title,
  CASE WHEN {key} % 3 = 0 THEN 'compiled' ELSE 'indexed' END AS maturity,
  CASE WHEN {key} % 7 = 0 THEN 'stale' WHEN {key} % 11 = 0 THEN 'archived' ELSE 'current' END AS status,
  CASE WHEN {key} % 2 = 0 THEN '' ELSE 'about' END AS summary, {body} AS body, {key} % 5 = 0 AS high_value,
  {key} % 13 <> 0 AS has_evidence, {key} % 19 <> 0 AS has_metadata,
  ['kept', CASE WHEN {key} % 4 = 0 THEN 'Not Kebab' ELSE 'kebab-case' END] AS tags,
  CASE WHEN {key} % 6 = 0 THEN '2023-01-01T00:00:00Z' ELSE '2024-06-01T00:00:00Z' END AS updated_at FROM {name}"""
        )
    return "i AS (" + " UNION ALL ".join(parts) + ")"


ITEMS = _items_sql()


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier supports nation, nation extends region, region supports customer's nation mate: customers extend nations."""
    n, c, s = (table(spark, sf_dir, x) for x in ("nation", "customer", "supplier"))
    edge = lambda a, b, kind: [F.concat(F.lit(a[0]), F.col(a[1])).alias("source_id"), F.concat(F.lit(b[0]), F.col(b[1])).alias("target_id"), F.lit(kind).alias("relation_type")]
    return (
        s.filter("s_suppkey % 2 = 0").select(*edge(("s", "s_suppkey"), ("n", "s_nationkey"), "supports"))
        .unionAll(n.select(*edge(("n", "n_nationkey"), ("r", "n_regionkey"), "extends")))
        .unionAll(n.filter("n_nationkey % 5 = 0").select(*edge(("r", "n_regionkey"), ("n", "n_nationkey"), "supports")))
        .unionAll(c.filter("c_custkey % 3 <> 0").select(*edge(("n", "c_nationkey"), ("c", "c_custkey"), "extends")))
        .unionAll(c.filter("c_custkey % 50 = 0").select(*edge(("c", "c_custkey"), ("n", "c_nationkey"), "contradicts")))
    )


EDGES = """r AS (
  SELECT 's' || s_suppkey AS source_id, 'n' || s_nationkey AS target_id, 'supports' AS relation_type FROM supplier WHERE s_suppkey % 2 = 0
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'extends' FROM nation
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'supports' FROM nation WHERE n_nationkey % 5 = 0
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'extends' FROM customer WHERE c_custkey % 3 <> 0
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'contradicts' FROM customer WHERE c_custkey % 50 = 0)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden queries: the first words of benchmark passages, which stand in some documents."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("question"), "text")


QUESTIONS = "q AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:8], ' ') AS question, text FROM benchmark)"


def source_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("source_key", ids.document_id(F.col("path")))
