"""Queries: documents, facets, duplicates, incremental indexing, chunks, privacy, pages, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import ids
from quillon.functions import moments as M
from quillon.functions import text as T
from quillon.operators import filters, grouping, incremental, rules
from quillon.plans.catalog import query
from quillon.plans.tables import DOCS, documents, messages, table
from quillon.sources import readers, sinks

# --- Identity and text functions -------------------------------------------------------------------------------------


@query(
    "id_hashes",
    f"""WITH {DOCS} SELECT document_id, 'doc-' || substr(sha256(path), 1, 20) AS doc, 'chk-' || substr(sha256('doc-' || substr(sha256(path), 1, 20) || '|k'), 1, 24) AS chunk,
    'src-' || substr(sha256(path || content), 1, 20) AS src, sha256(content) AS content_hash, sha256(concat_ws(chr(0), title, '', lang)) AS fingerprint FROM d""".replace("chr(0)", "chr(1)"),
)
def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = ids.document_id(F.col("path"))
    return documents(spark, sf_dir).select(
        "document_id", doc.alias("doc"), ids.chunk_id(doc, F.lit("k")).alias("chunk"), ids.text_source_id(F.col("path"), F.col("content")).alias("src"),
        ids.text_hash(F.col("content")).alias("content_hash"), F.sha2(F.concat_ws("\x01", "title", F.lit(""), "lang"), 256).alias("fingerprint"),
    )


@query(
    "str_01_normalize",
    r"""SELECT doc_id, sha256(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss')) AS digest FROM documents""",
)
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize(F.col("text")), 256).alias("digest"))


@query(
    "str_02_estimate_tokens",
    r"""SELECT doc_id, greatest(1, len(w) + ((length(text) - length(array_to_string(w, ''))) // 8))::BIGINT AS tokens
        FROM (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z0-9_]+|[\x{3400}-\x{9fff}]') AS w FROM documents)""",
)
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("str_05_repeated_phrases")
def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(T.repeats_phrase(F.col("text"))).select("doc_id")


@query("str_04_tags", r"""SELECT p_partkey, lower(p_name) AS name, regexp_matches(lower(p_name), '^[a-z0-9]+(-[a-z0-9]+)*$') AS canonical,
    trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '-') AS suggested FROM part""")
def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), name.rlike(T.CANONICAL_TAG).alias("canonical"), T.suggested_tag(F.col("p_name")).alias("suggested"))


@query("mth_01_clamp", "SELECT o_orderkey, least(greatest(o_totalprice / 200000, 0), 1)::DOUBLE AS share FROM orders")
def clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", M.clamp(F.col("o_totalprice") / 200000).alias("share"))


@query(
    "dat_02_stale",
    """SELECT count(*)::BIGINT AS n, count_if(o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 120 DAY)::BIGINT AS stale,
       count_if(strftime(o_orderdate, '%Y-%m-%d') < '1995-01-01')::BIGINT AS expired FROM orders""",
)
def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("at", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    as_of = F.to_timestamp(F.lit("1996-01-01 00:00:00"))
    return o.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(M.is_stale(F.col("at"), as_of)).alias("stale"),
        F.count_if(F.coalesce(M.expired(F.col("at"), F.to_date(F.lit("1995-01-01"))) == "expired", F.lit(False))).alias("expired"),
    )


# --- Facets, counts, duplicates --------------------------------------------------------------------------------------


@query("agg_02_facets", f"WITH {DOCS} SELECT lang, source, count(*) FILTER (enabled)::BIGINT AS n FROM d GROUP BY lang, source")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    names = d.select("lang", "source").distinct()
    enabled = d.filter("enabled").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return names.join(enabled, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "agg_01_duplicate_groups",
    """SELECT sha256(text) AS key, count(*)::BIGINT AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumns({"checksum": F.lit(""), "content_hash": ids.text_hash(F.col("content"))})
    return incremental.duplicate_groups(d)


@query(
    "agg_03_status",
    """SELECT 'documents' AS name, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'messages', count(*) FROM conversations
       UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'labels', count(*) FROM labels""",
)
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, source in (("documents", "documents"), ("pages", "pages"), ("messages", "conversations"), ("embeddings", "embeddings"), ("labels", "labels")):
        one = table(spark, sf_dir, source).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query(
    "agg_05_chunk_counts",
    f"WITH {DOCS} SELECT source, count(*)::BIGINT AS n, count(vec_id)::BIGINT AS embedded, max(n_chars)::BIGINT AS longest FROM d LEFT JOIN embeddings ON vec_id = document_id GROUP BY source",
)
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = documents(spark, sf_dir), table(spark, sf_dir, "embeddings").select("vec_id")
    return d.join(e, F.col("document_id") == F.col("vec_id"), "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("vec_id").alias("embedded"), F.max("n_chars").alias("longest")
    )


@query(
    "agg_06_folders",
    f"WITH {DOCS} SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*)::BIGINT AS n, max(updated_at) AS newest FROM d GROUP BY 1 ORDER BY n DESC, folder LIMIT 30",
)
def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.folder_counts(documents(spark, sf_dir))


@query(
    "agg_06_bootstrap",
    f"""WITH {DOCS}, g AS (SELECT lang AS name FROM d UNION ALL SELECT source FROM d),
    c AS (SELECT 'collection' AS kind, lang AS name, count(*)::BIGINT AS n FROM d GROUP BY lang UNION ALL SELECT 'tag', name, count(*) FROM g GROUP BY name
      UNION ALL SELECT 'media_type', media_type, count(*) FROM d GROUP BY media_type
      UNION ALL SELECT 'folder', regexp_replace(path, '/[^/]*$', ''), count(*) FROM d GROUP BY 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) AS rank FROM c)
    SELECT kind, name, n, rank::INT AS rank FROM k WHERE (kind <> 'tag' OR rank <= 40) AND (kind <> 'folder' OR rank <= 30)
    UNION ALL SELECT 'recent', title, 1, row_number() OVER (ORDER BY updated_at DESC, document_id)::INT FROM d QUALIFY row_number() OVER (ORDER BY updated_at DESC, document_id) <= 12""",
)
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("collection", F.col("lang"))
    return filters.bootstrap(d, d.select("document_id", F.explode(F.array("lang", "source")).alias("name")))


@query("flt_04_all_tags", f"WITH {DOCS} SELECT document_id FROM d WHERE lang = 'en' AND source = 'src3'")
def all_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    bridge = d.select("document_id", F.explode(F.array("lang", "source")).alias("name"))
    return filters.with_all_tags(d, bridge, ["en", "src3"], "document_id").select("document_id")


@query("flt_06_page", f"WITH {DOCS} SELECT document_id, updated_at FROM d ORDER BY updated_at DESC, document_id LIMIT 25 OFFSET 50")
def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.page(documents(spark, sf_dir), [F.desc("updated_at"), F.col("document_id")], 25, 50).select("document_id", "updated_at")


@query("join_08_missing_vectors", f"WITH {DOCS} SELECT document_id FROM d WHERE document_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"))
    return incremental.missing(documents(spark, sf_dir), vectors, ["document_id"]).select("document_id")


@query(
    "join_01_vectors_of_documents",
    f"WITH {DOCS} SELECT lang, label, count(*)::BIGINT AS n FROM d JOIN embeddings ON vec_id = document_id WHERE enabled GROUP BY lang, label",
)
def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), "label")
    return documents(spark, sf_dir).filter("enabled").join(e, "document_id").groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"))


# --- Incremental indexing --------------------------------------------------------------------------------------------

OLD_NEW = """o AS (SELECT doc_id AS k, sha256(text) AS h, lang FROM documents WHERE doc_id % 10 <> 0),
n AS (SELECT doc_id AS k, CASE WHEN doc_id % 7 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS h, lang FROM documents WHERE doc_id % 9 <> 0)"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").withColumn("k", F.col("doc_id"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    old = d.filter("doc_id % 10 <> 0").select("k", ids.text_hash(F.col("text")).alias("h"), "lang")
    return old, d.filter("doc_id % 9 <> 0").select("k", ids.text_hash(changed).alias("h"), "lang")


STATUS = "CASE WHEN o.k IS NULL THEN 'created' WHEN n.k IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'updated' END"


@query("inc_02_chunk_diff", f"WITH {OLD_NEW} SELECT coalesce(o.k, n.k) AS k, {STATUS} AS status FROM o FULL JOIN n ON o.k = n.k")
def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.classify(*_versions(spark, sf_dir), ["k"], ["h"])


@query(
    "inc_02_report",
    f"""WITH {OLD_NEW}, c AS (SELECT {STATUS} AS s FROM o FULL JOIN n ON o.k = n.k) SELECT count_if(s = 'created')::BIGINT AS created, count_if(s = 'updated')::BIGINT AS updated,
    count_if(s = 'unchanged')::BIGINT AS unchanged, count_if(s = 'deleted')::BIGINT AS deleted, count_if(s IN ('created', 'updated'))::BIGINT AS embedded FROM c""",
)
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.index_report(incremental.classify(*_versions(spark, sf_dir), ["k"], ["h"]))


@query("snk_01_merge", f"WITH {OLD_NEW} SELECT coalesce(n.k, o.k) AS k, coalesce(n.h, o.h) AS h, coalesce(n.lang, o.lang) AS lang FROM o FULL JOIN n ON o.k = n.k")
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return incremental.merge(old, new, ["k"], keep_if_null=["lang"])


@query(
    "inc_01_admission",
    """WITH e AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 4 = 0),
    i AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 AND doc_id % 3 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 3 = 0),
    f AS (SELECT h, min(doc_id) AS first FROM e GROUP BY h), w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY doc_id) AS twin FROM i),
    s AS (SELECT w.doc_id, w.h, CASE WHEN e.h = w.h THEN 'unchanged' WHEN e.h IS NOT NULL THEN 'updated' WHEN f.first IS NOT NULL OR twin <> w.doc_id THEN 'duplicate' ELSE 'created' END AS status,
      coalesce(f.first, CASE WHEN twin <> w.doc_id THEN twin END) AS other FROM w LEFT JOIN e ON e.doc_id = w.doc_id LEFT JOIN f ON f.h = w.h)
    SELECT doc_id::VARCHAR AS source_id, status, CASE WHEN status = 'duplicate' THEN other::VARCHAR END AS duplicate_of FROM s""",
)
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumns({"source_id": F.col("doc_id").cast("string"), "seq": F.col("doc_id"), "checksum": F.lit("")})
    changed = F.when((F.col("doc_id") % 8 == 0) & (F.col("doc_id") % 3 == 0), F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    existing = d.filter("doc_id % 4 = 0").select("source_id", "checksum", "seq", ids.text_hash(F.col("text")).alias("content_hash"))
    incoming = d.filter("doc_id % 3 = 0").select("source_id", "checksum", "seq", ids.text_hash(changed).alias("content_hash"))
    return incremental.admit(incoming, existing)


@query(
    "inc_12_first_wins",
    """SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1""",
)
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return incremental.first_wins(d, ids.text_hash(F.col("text")), ["doc_id"]).select("doc_id", "source")


@query(
    "inc_15_last_wins",
    """SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1""",
)
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.first_wins(table(spark, sf_dir, "documents"), F.col("source"), ["doc_id"], last=True).select("doc_id", "source")


@query("set_04_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("set_08_same_rows", "SELECT count(*)::BIGINT AS n FROM (SELECT doc_id, quality FROM labels EXCEPT ALL SELECT doc_id, 1 FROM documents)")
def same_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, d = table(spark, sf_dir, "labels").select("doc_id", "quality"), table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("quality"))
    return labels.exceptAll(d).agg(F.count(F.lit(1)).alias("n"))


@query(
    "win_18_size_cap",
    f"WITH {DOCS}, t AS (SELECT document_id, path, sum(coalesce(n_chars, 0)) OVER (ORDER BY path, document_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM d) SELECT document_id, total, total <= 1000000 AS fits FROM t",
)
def size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents(spark, sf_dir).select("document_id", "path", F.col("n_chars").alias("size"))
    return incremental.size_cap(files, ["path", "document_id"], 1_000_000).select("document_id", "total", "fits")


@query(
    "win_10_next_ordinals",
    """SELECT doc_id, source, 100 + row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal FROM documents""",
)
def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    existing = d.select("source", F.lit(100).cast("long").alias("ordinal")).distinct()
    return incremental.next_ordinals(d.select("doc_id", "source"), existing, ["source"], ["doc_id"])


# --- Chunks, gate, assessments ---------------------------------------------------------------------------------------


@query("chk_04_text_chunks")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select(F.col("document_id").cast("string").alias("document_id"), F.col("content").alias("text"))
    return grouping.text_chunks(d)


@query("chk_05_heading_blocks")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents get a heading before every tenth line."""
    lines = F.transform(F.split("content", "\n"), lambda x, i: F.when(i % 10 == 0, F.concat(F.repeat(F.lit("#"), (i / 10 % 3 + 1).cast("int")), F.lit(" part\n"), x)).otherwise(x))
    return grouping.heading_blocks(documents(spark, sf_dir).select("document_id", F.array_join(lines, "\n").alias("text")))


@query("chk_01_media_chunks")
def media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as media of five kinds, seven of a source together: pages, slides, cues, images or texts."""
    d = table(spark, sf_dir, "documents")
    kinds = F.array(*[F.lit(k) for k in ("pdf", "pptx", "video", "image", "text")])
    null = F.lit(None).cast("string")
    segments = d.select(
        F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 7)).alias("document_id"), F.get(kinds, (F.floor(F.col("doc_id") / 7) % 5).cast("int")).alias("media_type"),
        F.concat(F.lit("seg-"), "doc_id").alias("segment_id"), F.col("doc_id").alias("seq"), F.lit("speech").alias("modality"), F.col("text").alias("retrieval_text"), "text",
        F.array().cast("array<string>").alias("heading_path"), (F.col("doc_id") % 3).alias("page"), (F.col("doc_id") % 2).alias("slide"), F.lit("").alias("section"),
        (F.col("doc_id") * 1.0).alias("start"), (F.col("doc_id") + 0.5).alias("end"), F.col("lang").alias("speaker"), F.lit("pass").alias("quality"), null.alias("asset"),
    )
    return grouping.media_chunks(segments)


@query(
    "chk_06_locator_chunks",
    """SELECT source AS document_id, (doc_id // 7) AS page, '' AS section, min(doc_id)::BIGINT AS seq, string_agg(text, chr(10) ORDER BY doc_id) AS content, count(*)::BIGINT AS n_segments
       FROM documents GROUP BY source, doc_id // 7""",
)
def locator_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    segments = d.select(
        F.col("source").alias("document_id"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("segment_id"), F.floor(F.col("doc_id") / 7).alias("page"),
        F.lit("").alias("section"), "text",
    )
    return grouping.locator_chunks(segments, "page").drop("segment_ids")


GATE = """g AS (SELECT doc_id, 1 AS n_segments, length(text) AS n, CASE WHEN doc_id % 31 = 0 THEN 'metadata_only' ELSE 'full_source' END AS scope, CASE WHEN doc_id % 5 = 0 THEN 'video' WHEN doc_id % 3 = 0 THEN 'pdf' ELSE 'text' END AS m,
  doc_id % 2 AS sp, doc_id % 4 AS vi, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN 10 ELSE 0 END AS ep, doc_id % 11 AS cp, doc_id % 13 <> 0 AS ck, doc_id % 7 AS w FROM documents),
h AS (SELECT *, CASE WHEN ep > 0 THEN cp / ep::DOUBLE END AS share, m = 'video' AND sp = 0 AND vi > 0 AS sv, m = 'video' AND sp = 0 AND vi = 0 AS mute, scope = 'metadata_only' AS poor FROM g),
s AS (SELECT *, CASE WHEN poor THEN 20 ELSE 100 END - CASE WHEN sv THEN 20 ELSE 0 END AS a FROM h),
t AS (SELECT *, CASE WHEN mute THEN least(a, 30) ELSE a END AS b FROM s),
u AS (SELECT *, CASE WHEN share < 0.5 THEN least(b, 45) ELSE b END - CASE WHEN share >= 0.5 AND share < 0.85 THEN 15 ELSE 0 END - CASE WHEN ck THEN 0 ELSE 10 END - CASE WHEN n < 80 THEN 10 ELSE 0 END - least(15, w * 3) AS c FROM t),
v AS (SELECT *, greatest(0, least(100, c))::BIGINT AS quality_score, NOT (poor OR mute OR coalesce(share < 0.5, false)) AND greatest(0, least(100, c)) >= 60 AS accepted FROM u)"""


@query(
    "agg_16_extraction_gate",
    f"WITH {GATE} SELECT doc_id, quality_score, accepted, CASE WHEN quality_score >= 90 THEN '优秀' WHEN quality_score >= 75 THEN '良好' WHEN accepted THEN '可用' ELSE '不合格' END AS grade FROM v",
)
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit(1).alias("n_segments"), F.length("text").alias("n_characters"), F.when(i % 31 == 0, "metadata_only").otherwise("full_source").alias("scope"),
        F.when(i % 5 == 0, "video").when(i % 3 == 0, "pdf").otherwise("text").alias("media_type"), (i % 2).alias("n_speech"), (i % 4).alias("n_visual"),
        F.when((i % 3 == 0) & (i % 5 != 0), 10).otherwise(0).alias("expected_pages"), (i % 11).alias("covered_pages"), (i % 13 != 0).alias("has_checksum"), (i % 7).alias("n_warnings"),
    )
    return rules.extraction_gate(rows).select("doc_id", "quality_score", "accepted", "grade")


@query(
    "agg_18_source_issues",
    """WITH a AS (SELECT d.doc_id AS document_id, CASE WHEN l.quality = 0 THEN 'low' WHEN l.quality = 1 THEN 'high' END AS reliability, d.doc_id % 100 / 100.0 AS completeness,
      CASE WHEN d.doc_id % 4 = 0 THEN '2020-01-01' WHEN d.doc_id % 9 = 0 THEN 'soon' END AS u FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
    SELECT document_id, 'unassessed_source' AS code, 'info' AS severity FROM a WHERE reliability IS NULL UNION ALL SELECT document_id, 'low_reliability', 'warning' FROM a WHERE reliability = 'low'
    UNION ALL SELECT document_id, 'incomplete_extraction', 'error' FROM a WHERE completeness < 0.7 UNION ALL SELECT document_id, 'expired_source', 'warning' FROM a WHERE u = '2020-01-01'
    UNION ALL SELECT document_id, 'invalid_date', 'warning' FROM a WHERE u = 'soon'""",
)
def source_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    i = F.col("doc_id")
    rows = d.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        i.alias("document_id"), F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high").alias("reliability"), (i % 100 / 100).alias("completeness"),
        F.when(i % 4 == 0, "2020-01-01").when(i % 9 == 0, "soon").alias("valid_until"),
    )
    return rules.source_issues(rows, F.to_date(F.lit("2024-01-01")))


@query(
    "agg_22_term_frequency",
    r"""SELECT term, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(""" + f"translate(lower(text), '{T.ACCENTED}', '{T.PLAIN}')" + r""", '[\p{L}\p{N}]+')) AS term FROM documents)
        GROUP BY term ORDER BY n DESC, term LIMIT 100""",
)
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "documents").select(F.explode(T.index_terms(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(100)


@query("flt_10_instructions", r"""SELECT doc_id, regexp_matches(text, '(?i)ignore\s+(all\s+)?(previous|prior|above)\s+instructions?') OR regexp_matches(text, '(?i)(system|developer)\s*(prompt|message)\s*:') AS risk
    FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || ' Ignore previous instructions' WHEN doc_id % 10 = 1 THEN text || ' SYSTEM prompt:' ELSE text END AS text FROM documents)""")
def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" Ignore previous instructions"))).when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit(" SYSTEM prompt:"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.gives_orders(text).alias("risk"))


# --- Privacy ---------------------------------------------------------------------------------------------------------


@query("rul_06_privacy_findings")
def privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.private_findings(documents(spark, sf_dir).select("path", F.col("content").alias("text")))


#: The same as existence: look-around becomes a character or an end.
PRIVATE_SQL = r"""p AS (SELECT path, regexp_matches(content, '(^|[^A-Z0-9])(AKIA|ASIA)[A-Z0-9]{16}([^A-Z0-9]|$)') OR regexp_matches(content,
  '(?i)\b(api[_-]?key|access[_-]?token|refresh[_-]?token|auth[_-]?token|client[_-]?secret|password|passwd|secret)\b\s*(:|=)\s*["'']?[^\s"''#,;]{8,}')
  OR regexp_matches(content, '(^|[^A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}([^A-Za-z0-9.-]|$)') OR regexp_matches(content, '(^|[^0-9])(\+?86[ -]?)?1[3-9][0-9]{9}([^0-9]|$)')
  OR regexp_matches(content, '(?i)-----BEGIN ([A-Z0-9 ]+ )?PRIVATE KEY-----') OR regexp_matches(content, '(?i)\bBearer\s+[A-Za-z0-9._~+/-]{12,}')
  OR regexp_matches(content, '(^|[^A-Za-z0-9])(sk-(ant-)?[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|hf_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{16,})') AS hit FROM d)"""


@query("rul_06_share_status", f"WITH {DOCS}, {PRIVATE_SQL} SELECT path, CASE WHEN hit THEN 'blocked' ELSE 'clean' END AS status FROM p")
def share_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.text_status(documents(spark, sf_dir).select("path", F.col("content").alias("text")))


@query(
    "flt_15_secret_names",
    r"""SELECT doc_id, name, name IN ('.env', 'id_rsa') OR regexp_matches(name, '\.(key|pem)$') OR name = 'secrets.json' AS secret FROM (
        SELECT doc_id, ['.env', 'id_rsa', 'a.pem', 'b.key', 'secrets.json', 'note.md', 'keys.md', source || '.txt'][1 + doc_id % 8] AS name FROM documents)""",
)
def secret_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in (".env", "id_rsa", "a.pem", "b.key", "secrets.json", "note.md", "keys.md")], F.concat("source", F.lit(".txt")))
    d = table(spark, sf_dir, "documents").withColumn("name", F.get(names, (F.col("doc_id") % 8).cast("int")))
    return d.select("doc_id", "name", rules.secret_name(F.col("name")).alias("secret"))


@query("rul_18_path_collisions", "SELECT lower(p) AS folded, count(DISTINCT p)::BIGINT AS n_paths FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN upper(source || lang) ELSE source || lang END AS p FROM documents) GROUP BY 1 HAVING count(DISTINCT p) > 1")
def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("source", "lang")
    return rules.path_collisions(table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.upper(name)).otherwise(name).alias("path")))


# --- Pages -----------------------------------------------------------------------------------------------------------


@query("src_12_web_pages")
def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.web_pages(table(spark, sf_dir, "pages"), least=80)


@query(
    "str_22_url_identity",
    r"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS identity FROM pages""",
)
def url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ids.url_identity(F.col("url")).alias("identity"))


@query("flt_14_public_urls", r"""SELECT page_id, regexp_matches(url, '^https?://[^/:?#@]+([:/?#]|$)') AS public FROM pages""")
def public_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", filters.public_url(F.col("url")).alias("public"))


@query("src_17_routes", r"SELECT kind, count(*)::BIGINT AS n FROM (SELECT CASE WHEN regexp_matches(path, '\.md$') THEN 'text' ELSE 'web' END AS kind FROM (SELECT 'a/doc.md' AS path FROM documents UNION ALL SELECT url FROM pages WHERE NOT regexp_matches(url, '\.[A-Za-z0-9]+([?#].*)?$') )) GROUP BY kind")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "documents").select(F.lit("a/doc.md").alias("path")).unionAll(
        table(spark, sf_dir, "pages").filter(~F.col("url").rlike(r"\.[A-Za-z0-9]+([?#].*)?$")).select("url")
    )
    return paths.groupBy(filters.route(F.col("path")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("snk_16_manifest", "SELECT page_id::VARCHAR AS path, octet_length(encode(html))::BIGINT AS size, sha256(html) AS sha256 FROM pages")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.manifest(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content")))


# --- Conversations ---------------------------------------------------------------------------------------------------


@query(
    "agg_07_conversations",
    """SELECT conv_id, count(*)::BIGINT AS n_messages, count_if(role = 'user')::BIGINT AS n_user, max(turn)::BIGINT AS last_turn, arg_max(left(text, 80), turn) AS preview FROM conversations GROUP BY conv_id""",
)
def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_user"), F.max("turn").alias("last_turn"),
        F.max_by(F.substring("text", 1, 80), "turn").alias("preview"),
    )


@query("flt_05_search_conversations", """SELECT DISTINCT conv_id FROM conversations WHERE contains(lower(text), 'the')""")
def search_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    titled = m.filter("turn = 0").select("conv_id", F.lit("chat").alias("title")).union(m.select("conv_id", F.lit("chat").alias("title"))).distinct()
    return filters.search_conversations(titled, m, "The").select("conv_id")


@query(
    "win_08_last_messages",
    """SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6""",
)
def last_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators.retrieval import best

    return best(messages(spark, sf_dir), ["conv_id"], [F.desc("turn")], 6).select("conv_id", "turn")


@query(
    "win_09_rolling_summary",
    """WITH m AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
       s AS (SELECT conv_id, string_agg(role || ': ' || left(text, 360), chr(10) ORDER BY turn) AS t FROM m WHERE turn <= last - 6 GROUP BY conv_id) SELECT conv_id, right(t, 4000) AS summary FROM s""",
)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).withColumn("last", F.max("turn").over(Window.partitionBy("conv_id"))).filter("turn <= last - 6")
    line = F.concat("role", F.lit(": "), F.substring("text", 1, 360))
    lines = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    return m.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("t")).select("conv_id", F.right("t", F.lit(4000)).alias("summary"))


@query(
    "flt_11_question_analysis",
    r"""SELECT conv_id, turn, regexp_matches(n, '(?i)\b(it|that|those|they|this)\b') AS follow_up, CASE WHEN regexp_matches(n, '(?i)compare') THEN 'compare' WHEN regexp_matches(n, '(?i)synthesize|summarize|summary|overview') THEN 'synthesis'
        WHEN regexp_matches(n, '(?i)why|how') THEN 'explanation' ELSE 'factual' END AS task FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS n FROM conversations)""",
)
def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.collapse(F.col("text"))
    return messages(spark, sf_dir).select("conv_id", "turn", T.is_follow_up(n).alias("follow_up"), T.task_type(n).alias("task"))


@query(
    "str_16_keywords",
    r"""WITH k AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z0-9_-]{2,}') AS w FROM conversations), u AS (SELECT conv_id, turn, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM k),
        f AS (SELECT conv_id, turn, x, min(i) AS i FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM f)
        SELECT conv_id, turn, string_agg(x, ' ' ORDER BY n) AS keywords FROM r WHERE n <= 16 GROUP BY conv_id, turn""",
)
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.keywords(F.col("text"))
    return messages(spark, sf_dir).filter(F.size(words) > 0).select("conv_id", "turn", F.array_join(words, " ").alias("keywords"))


@query("str_18_rewrites")
def rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    m = messages(spark, sf_dir).withColumns({"context": F.lag("text").over(w), "question": T.collapse(F.col("text"))})
    return m.filter("role = 'user'").select("conv_id", "turn", T.rewrite_question(F.col("question"), T.is_follow_up(F.col("question")), F.col("context"), F.col("context")).alias("query"))


@query(
    "snk_17_conversation_markdown",
    """SELECT conv_id, string_agg('## ' || upper(left(role, 1)) || substr(role, 2) || chr(10) || chr(10) || trim(text), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id""",
)
def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.conversation_markdown(messages(spark, sf_dir))


@query(
    "chk_19_claim_units",
    r"""WITH u AS (SELECT conv_id, turn, trim(unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|' || chr(10) || '+'))) AS s FROM conversations)
        SELECT conv_id, turn, count(*)::BIGINT AS n FROM u WHERE length(trim(s, ' :;')) >= 5 AND NOT regexp_matches(s, ':\s*$') GROUP BY ALL""",
)
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators.qa import claim_units

    n = F.size(claim_units(F.col("text"))).cast("long")
    return messages(spark, sf_dir).select("conv_id", "turn", n.alias("n")).filter("n > 0")
