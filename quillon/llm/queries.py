"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.chunk_dedup import repeated_passages
from quillon.llm.common import documents, labels
from quillon.llm.exact_dedup import exact_groups
from quillon.llm.feature_history import point_in_time
from quillon.llm.fingerprints import fingerprint_report
from quillon.llm.language_model import language_scores
from quillon.llm.license_scan import scan_licenses
from quillon.llm.mixing import mix
from quillon.llm.near_dedup import near_groups
from quillon.llm.packing import pack
from quillon.llm.pii import span_report
from quillon.llm.quality import score_quality
from quillon.llm.token_alignment import align
from quillon.llm.toxicity import toxicity


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(documents(spark, sf_dir))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir)).drop("tag")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).drop("row_no")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(documents(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))


def op13_feature_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales, clicks, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sales", "clicks", "sale_lines"))
    return point_in_time(sales, clicks, lines)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_quality": op3_quality,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_mixing": op6_mixing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_lm_scores": op11_lm_scores,
    "op12_token_alignment": op12_token_alignment,
    "op13_feature_history": op13_feature_history,
}

ORACLE_SQL: dict[str, str] = {
    "op6_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1.0, 2.0, 3.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS weight,
             3.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, (sum(source_size) OVER ()
               - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
               / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w),
f AS (SELECT min(CASE WHEN level * weight <= cap THEN cap / weight END) AS edge FROM o),
l AS (SELECT any_value(level) AS level FROM o, f WHERE cap / weight = edge AND level * weight <= cap),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l) * weight, cap)) AS target FROM o),
p AS (SELECT d.doc_id, d.size, d.h, t.*,
             CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, target - passes * source_size AS rest,
             sum(size) OVER (PARTITION BY source ORDER BY h) AS upto,
             sum(size) OVER (PARTITION BY source, h) AS unit FROM p)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN rest > 0 AND (upto < rest OR (upto - unit < rest AND upto - rest < rest - (upto - unit)))
                              THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c""",
    "op7_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op13_feature_history": """
WITH bits AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
           lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
s AS (
  SELECT row_number() OVER () AS no, sale_id, client_id, epoch_us(sold_at) AS sold, epoch_us(arrived_at) + 14400000000 AS ready,
         CASE WHEN isfinite(total) THEN floor(100 * total + 0.5)::BIGINT ELSE 0 END AS cents,
         epoch_us(sold_at) + 1000000 * (xor(list_reduce(
           list_prepend(4294967295, list_transform(string_split(sale_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1])), 4294967295) % 259200) AS t
  FROM sales, bits WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
p AS (SELECT no, sale_id, client_id, t, d, t - d * 86400000000 AS since FROM s, (VALUES (2), (14)) w(d)),
c AS (
  SELECT client_id, click_id, epoch_us(ts) AS ts, epoch_us(arrived_at) + 14400000000 AS ready, kind,
         CASE WHEN isfinite(value) THEN floor(100 * value + 0.5)::BIGINT ELSE 0 END AS cents
  FROM (SELECT DISTINCT * FROM clicks)),
clicked AS (
  SELECT no, d, count(*) AS n_clicks, count(*) FILTER (kind = 'purchase') AS n_purchases, sum(cents)::BIGINT AS click_cents,
         max((c.ts, click_id))[2] AS last_click_id
  FROM p JOIN c ON c.client_id = p.client_id AND c.ts > since AND c.ts <= t AND c.ready <= t GROUP BY ALL),
sold AS (
  SELECT p.no, d, p.t, s.sale_id, s.cents FROM p JOIN s ON s.client_id = p.client_id AND s.sold > since AND s.sold <= p.t AND s.ready <= p.t),
bought AS (SELECT no, d, count(*) AS n_sales, sum(cents)::BIGINT AS sale_cents FROM sold GROUP BY ALL),
lined AS (
  SELECT no, d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items,
         sum(CASE WHEN isfinite(amount) THEN floor(100 * amount + 0.5)::BIGINT ELSE 0 END)::BIGINT AS line_cents
  FROM sold JOIN sale_lines l ON l.sale_id = sold.sale_id AND epoch_us(shipped_at) <= t GROUP BY ALL),
labelled AS (SELECT DISTINCT p.no FROM s AS p JOIN s ON s.client_id = p.client_id AND s.sold > p.t AND s.sold <= p.t + 604800000000)
SELECT sale_id, d, t AS t_us, labelled.no IS NOT NULL AS label,
       coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases, coalesce(click_cents, 0) AS click_cents, last_click_id,
       coalesce(n_sales, 0) AS n_sales, coalesce(sale_cents, 0) AS sale_cents, coalesce(n_lines, 0) AS n_lines,
       coalesce(n_items, 0) AS n_items, coalesce(line_cents, 0) AS line_cents
FROM p LEFT JOIN clicked USING (no, d) LEFT JOIN bought USING (no, d) LEFT JOIN lined USING (no, d) LEFT JOIN labelled USING (no)""",
}
