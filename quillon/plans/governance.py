"""Queries: the knowledge graph, health, proposals, wiki, joins and sets over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import ids
from quillon.functions import text as T
from quillon.operators import graph, retrieval, rules
from quillon.plans.catalog import query
from quillon.plans.tables import EDGES, ITEMS, items, relations, table
from quillon.sources import sinks

CLOSURE = f"""WITH RECURSIVE {EDGES}, c(item_id, ancestor_id) AS (SELECT target_id, source_id FROM r WHERE relation_type IN ('supports', 'extends')
  UNION SELECT c.item_id, r.source_id FROM c JOIN r ON r.target_id = c.ancestor_id WHERE r.relation_type IN ('supports', 'extends'))"""


@query("join_17_provenance", f"{CLOSURE} SELECT item_id, count(*)::BIGINT AS n_ancestors, min(ancestor_id) AS first_ancestor FROM c GROUP BY item_id")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.provenance(relations(spark, sf_dir))


@query("set_03_sourced_items", f"{CLOSURE} SELECT DISTINCT item_id FROM c WHERE ancestor_id LIKE 's%'")
def sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sourced_items(items(spark, sf_dir), relations(spark, sf_dir))


@query(
    "agg_09_degree",
    f"WITH {EDGES} SELECT item_id, count(*)::BIGINT AS degree FROM (SELECT source_id AS item_id FROM r UNION ALL SELECT target_id FROM r) GROUP BY item_id",
)
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree(relations(spark, sf_dir))


@query("set_02_endpoints", f"WITH {EDGES} SELECT source_id AS item_id FROM r UNION SELECT target_id FROM r")
def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(relations(spark, sf_dir)).select("item_id").distinct()


@query(
    "join_16_related_items",
    f"""WITH {EDGES}, {ITEMS} SELECT x.item_id, x.other_id, x.relation_type, x.direction, i.title FROM (
    SELECT source_id AS item_id, target_id AS other_id, relation_type, 'outgoing' AS direction FROM r UNION ALL SELECT target_id, source_id, relation_type, 'incoming' FROM r) x
    JOIN i ON i.item_id = x.other_id WHERE x.item_id LIKE 'n%'""",
)
def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = graph.neighbours(relations(spark, sf_dir)).filter(F.col("item_id").startswith("n"))
    return near.join(items(spark, sf_dir).select(F.col("item_id").alias("other_id"), "title"), "other_id").select("item_id", "other_id", "relation_type", "direction", "title")


@query(
    "join_19_contradictions",
    f"""WITH {EDGES}, {ITEMS} SELECT r.source_id, r.target_id, coalesce(a.title, r.source_id) AS source_title, coalesce(b.title, r.target_id) AS target_title
    FROM r LEFT JOIN i a ON a.item_id = r.source_id LEFT JOIN i b ON b.item_id = r.target_id WHERE relation_type = 'contradicts'""",
)
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.contradictions(relations(spark, sf_dir), items(spark, sf_dir))


HEALTH = f"""{CLOSURE}, {ITEMS}, g AS (SELECT item_id, count(*) AS degree FROM (SELECT source_id AS item_id FROM r UNION ALL SELECT target_id FROM r) GROUP BY item_id),
x AS (SELECT i.*, coalesce(degree, 0) AS degree, i.item_id IN (SELECT item_id FROM c WHERE ancestor_id LIKE 's%') AS sourced, status <> 'archived' AS active, item_type = 'source' AS src FROM i LEFT JOIN g ON g.item_id = i.item_id),
h AS (SELECT item_id, 'missing_metadata' AS code, 'info' AS severity FROM x WHERE active AND NOT has_metadata
 UNION ALL SELECT item_id, 'missing_summary', 'warning' FROM x WHERE active AND maturity IN ('summarized', 'compiled') AND summary = ''
 UNION ALL SELECT item_id, 'missing_body', 'warning' FROM x WHERE active AND item_type IN ('topic', 'entity', 'analysis', 'decision') AND body = ''
 UNION ALL SELECT item_id, 'source_without_evidence', 'error' FROM x WHERE active AND src AND NOT has_evidence
 UNION ALL SELECT item_id, 'orphan_item', 'warning' FROM x WHERE active AND NOT src AND degree = 0
 UNION ALL SELECT item_id, 'isolated_source', 'info' FROM x WHERE active AND src AND maturity = 'compiled' AND degree = 0
 UNION ALL SELECT item_id, 'stale_current', 'warning' FROM x WHERE status = 'current' AND updated_at < '2024-01-01'
 UNION ALL SELECT item_id, 'marked_stale', 'warning' FROM x WHERE status = 'stale'
 UNION ALL SELECT item_id, 'high_value_uncompiled', 'warning' FROM x WHERE src AND high_value AND maturity <> 'compiled'
 UNION ALL SELECT item_id, 'compiled_without_source', 'warning' FROM x WHERE active AND NOT src AND maturity = 'compiled' AND NOT sourced
 UNION ALL SELECT item_id, 'noncanonical_tag', 'info' FROM x WHERE list_contains(tags, 'Not Kebab'))"""


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, r = items(spark, sf_dir), relations(spark, sf_dir)
    return rules.item_health(i, r, graph.sourced_items(i, r), F.to_timestamp(F.lit("2024-06-30 00:00:00")))


@query("rul_01_health_issues", f"{HEALTH} SELECT item_id, code, severity FROM h")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir).select("item_id", "code", "severity")


@query("agg_11_health_counts", f"{HEALTH} SELECT severity, code, count(*)::BIGINT AS n FROM h GROUP BY ROLLUP (severity, code)")
def health_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir).rollup("severity", "code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_10_alias_collisions",
    """SELECT lower(p_name) AS alias, count(DISTINCT p_partkey)::BIGINT AS n_items, string_agg(DISTINCT lpad(p_partkey::VARCHAR, 8, '0'), ',' ORDER BY lpad(p_partkey::VARCHAR, 8, '0')) AS item_ids FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1""",
)
def alias_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return rules.alias_collisions(p.select(T.normalize(F.col("p_name")).alias("alias"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("item_id")))


@query(
    "rul_13_conflicting_variants",
    """SELECT lower(p_brand) AS variant, count(DISTINCT p_type)::BIGINT AS n_canonicals, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS canonicals FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1""",
)
def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.conflicting_variants(table(spark, sf_dir, "part").select(F.col("p_brand").alias("variant"), F.col("p_type").alias("canonical")))


@query(
    "rul_15_live_edges",
    f"WITH {EDGES}, {ITEMS}, l AS (SELECT item_id FROM i WHERE status <> 'archived') SELECT * FROM r WHERE source_id IN (SELECT item_id FROM l) AND target_id IN (SELECT item_id FROM l)",
)
def live_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.restore(relations(spark, sf_dir), items(spark, sf_dir).filter("status <> 'archived'")).select("source_id", "target_id", "relation_type")


@query(
    "snk_15_wiki_pages",
    f"""WITH {EDGES}, {ITEMS}, l AS (SELECT source_id, string_agg('- ' || relation_type || ': [[' || target_id || ']]', chr(10) ORDER BY '- ' || relation_type || ': [[' || target_id || ']]') AS links FROM r GROUP BY source_id)
    SELECT item_id, concat_ws(chr(10) || chr(10), '---' || chr(10) || 'id: ' || item_id || chr(10) || 'type: ' || item_type || chr(10) || 'status: ' || status || chr(10) || 'tags: [' || array_to_string(list_sort(tags), ', ') || ']' || chr(10) || '---',
      '# ' || title, nullif(trim(summary), ''), nullif(trim(body), ''), links) AS page FROM i LEFT JOIN l ON l.source_id = i.item_id""",
)
def wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.wiki_pages(items(spark, sf_dir), relations(spark, sf_dir))


@query(
    "rul_07_wiki_lint",
    f"""WITH {EDGES}, {ITEMS}, p AS (SELECT * FROM i WHERE status <> 'archived'), k AS (SELECT source_id AS item_id, target_id AS target FROM r WHERE source_id IN (SELECT item_id FROM p))
    SELECT DISTINCT item_id, 'broken_link' AS code, target AS detail FROM k WHERE target NOT IN (SELECT item_id FROM p)
    UNION ALL SELECT item_id, 'orphan_page', NULL FROM p WHERE item_id NOT IN (SELECT item_id FROM k UNION SELECT target FROM k)""",
)
def wiki_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = items(spark, sf_dir).filter("status <> 'archived'")
    return sinks.wiki_lint(sinks.wiki_pages(live, relations(spark, sf_dir)))


@query(
    "agg_24_wiki_index",
    f"WITH {ITEMS} SELECT status, string_agg('- [[' || item_id || '|' || title || ']]', chr(10) ORDER BY title, '- [[' || item_id || '|' || title || ']]') AS page FROM i WHERE item_type <> 'entity' GROUP BY status",
)
def wiki_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.wiki_index(items(spark, sf_dir).filter("item_type <> 'entity'"), "status")


@query(
    "inc_12_proposals",
    """SELECT sha256(concat_ws(chr(1), 'run', p_brand, p_type, lower(p_name))) AS fingerprint, count(*)::BIGINT AS n, min(p_partkey)::BIGINT AS first FROM part GROUP BY 1""",
)
def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.sha2(F.concat_ws("\x01", F.lit("run"), "p_brand", "p_type", T.normalize(F.col("p_name"))), 256)
    return table(spark, sf_dir, "part").groupBy(key.alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


@query("id_proposal_fingerprints")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", ids.proposal_fingerprint(F.lit("run"), F.col("p_brand"), F.lit(None).cast("string"), F.col("p_name")).alias("fingerprint"))


@query(
    "join_20_left_assessments",
    """SELECT n_name, count(s_suppkey)::BIGINT AS n, round(coalesce(sum(s_acctbal), 0), 2) AS balance FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_name""",
)
def left_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier").filter("s_acctbal > 5000")
    return n.join(s, n.n_nationkey == s.s_nationkey, "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n"), F.round(F.coalesce(F.sum("s_acctbal"), F.lit(0.0)), 2).alias("balance"))


@query(
    "join_18_glossary_scope",
    """SELECT o_orderkey, l_partkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%'
       QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) = 1""",
)
def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators.retrieval import best

    o = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1"))
    joined = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return best(joined, ["o_orderkey"], [F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], 1).select("o_orderkey", "l_partkey", "l_suppkey")


@query(
    "win_11_latest_run",
    """SELECT o_custkey, max(o_orderkey)::BIGINT AS n FROM (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) GROUP BY o_custkey""",
)
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("last")).select("o_custkey", F.col("last.o_orderkey").alias("n"))


@query(
    "win_13_global_max",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice / max(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem""",
)
def share_of_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", retrieval.share_of_most("l_extendedprice", ["l_orderkey"]).alias("share"))
    return rows.withColumn("share", F.round("share", 6))


@query(
    "flt_13_enum_violations",
    f"WITH {EDGES} SELECT relation_type, count(*)::BIGINT AS n, count_if(source_id = target_id)::BIGINT AS self_loops FROM r GROUP BY relation_type",
)
def enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations(spark, sf_dir).groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source_id") == F.col("target_id")).alias("self_loops"))
