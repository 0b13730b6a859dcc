"""Queries: retrieval, answers, evaluation."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import index, qa, retrieval
from quillon.operators.filters import SearchFilters, filter_documents
from quillon.plans.catalog import query
from quillon.plans.tables import DOCS, ITEMS, QUESTIONS, documents, items, questions, table
from quillon.sources import readers, storage

#: Folding of accents as the index does it, and its terms.
FOLD = f"translate(lower({{}}), '{T.ACCENTED}', '{T.PLAIN}')"
TERMS = r"regexp_extract_all(" + FOLD + r", '[\p{{L}}\p{{N}}]+')"
#: What a question asks for; in the given tables each is one term.
PHRASES = r"regexp_extract_all({}, '[A-Za-z0-9_+-]+|[\x{{3400}}-\x{{9fff}}]+')"

BM25 = rf"""
t AS (SELECT document_id AS chunk_id, {TERMS.format("title")} AS a, {TERMS.format("content")} AS b FROM d),
n AS (SELECT count(*) AS n_chunks, avg(len(a) + len(b)) AS mean FROM t),
p AS (SELECT chunk_id, any_value(k) AS k, term, sum(w) AS f FROM (
  SELECT chunk_id, len(a) + len(b) AS k, unnest(a) AS term, 1.5::DOUBLE AS w FROM t
  UNION ALL SELECT chunk_id, len(a) + len(b), unnest(b), 1.0::DOUBLE FROM t) GROUP BY chunk_id, term),
g AS (SELECT term, count(*) AS holding FROM p GROUP BY term),
u AS (SELECT DISTINCT query_id, {TERMS.format("ph")}[1] AS term FROM (SELECT query_id, unnest({PHRASES.format("question")}) AS ph FROM q) WHERE len({TERMS.format("ph")}) = 1),
s AS (SELECT query_id, chunk_id, round(sum(CASE WHEN ln((n_chunks - holding + 0.5) / (holding + 0.5)) <= 0 THEN 1e-6
        ELSE ln((n_chunks - holding + 0.5) / (holding + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * k / mean)))::DOUBLE, 9) AS score
      FROM u JOIN p USING (term) JOIN g USING (term), n GROUP BY query_id, chunk_id),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 40)"""


def _index(spark: SparkSession, sf_dir: str) -> index.TextIndex:
    """The documents' index, kept in the shared folder from one query to the next."""
    files = readers.folder_state(spark, f"{sf_dir}/documents.parquet")
    chunks = documents(spark, sf_dir).withColumn("content_hash", F.sha2(F.concat_ws("|", "title", F.coalesce("content", F.lit(""))), 256))
    name = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    return index.kept_index(files, chunks, f"{storage.shared_dir(spark)}/quillon-index-{name}")


@query("ret_04_bm25", f"WITH {DOCS}, {QUESTIONS}, {BM25} SELECT query_id, chunk_id, rank::BIGINT AS rank, round(score, 6) AS score FROM kw")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.bm25(_index(spark, sf_dir), questions(spark, sf_dir))
    return out.select("query_id", "chunk_id", F.col("keyword_rank").cast("long").alias("rank"), F.round("keyword_score", 6).alias("score"))


@query("ret_03_postings", f"WITH {DOCS}, {QUESTIONS}, {BM25} SELECT term, count(*)::BIGINT AS n_chunks, sum(f)::DOUBLE AS weighted FROM p GROUP BY term")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.postings(_index(spark, sf_dir))
    return out.groupBy("term").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("weighted").alias("weighted"))


@query(
    "ret_02_phrase_hits",
    f"""WITH {DOCS}, {QUESTIONS}, ph AS (SELECT DISTINCT query_id, unnest(list_transform(range(1, 4),
      lambda x: array_to_string(string_split(question, ' ')[x:x+1], ' '))) AS phrase FROM q),
    tt AS (SELECT document_id AS chunk_id, ' ' || array_to_string({TERMS.format("content")}, '  ') || ' ' AS body,
           ' ' || array_to_string({TERMS.format("title")}, '  ') || ' ' AS title FROM d),
    pp AS (SELECT query_id, phrase, ' ' || array_to_string({TERMS.format("phrase")}, '  ') || ' ' AS inside,
           len({TERMS.format("phrase")}) AS k FROM ph)
    SELECT query_id, phrase, chunk_id, (
      (length(body) - length(replace(body, inside, ''))) / length(inside))::BIGINT AS n
    FROM pp, tt WHERE k = 2 AND contains(body, inside) AND string_split(trim(inside), '  ')[1] <> string_split(trim(inside), '  ')[2]""",
)
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir)
    words = F.split("question", " ")
    phrases = q.select("query_id", F.explode(F.array(*[F.array_join(F.slice(words, i, 2), " ") for i in (1, 2, 3)])).alias("phrase")).distinct()
    parts = T.index_terms(F.col("phrase"))
    phrases = phrases.filter((F.size(parts) == 2) & (F.get(parts, F.lit(0)) != F.get(parts, F.lit(1))))
    return retrieval.phrase_hits(documents(spark, sf_dir).withColumn("title", F.lit("")), phrases)


PHRASED = rf"""
tt AS (SELECT document_id AS chunk_id, ' ' || array_to_string({TERMS.format("content")}, '  ') || ' ' AS body, ' ' || array_to_string({TERMS.format("title")}, '  ') || ' ' AS head,
  len({TERMS.format("content")}) + len({TERMS.format("title")}) AS k FROM d),
n AS (SELECT count(*) AS n_chunks, avg(k) AS mean FROM tt),
pr AS (SELECT query_id, concat_ws('-', string_split(question, ' ')[1], string_split(question, ' ')[2]) AS pair, string_split(question, ' ')[3] AS third FROM q),
pt AS (SELECT query_id, concat_ws(' ', CASE WHEN len(list_distinct({TERMS.format("pair")})) = len({TERMS.format("pair")}) THEN pair END, third) AS question FROM pr),
ph AS (SELECT DISTINCT query_id, ' ' || array_to_string({TERMS.format("phrase")}, '  ') || ' ' AS inside FROM (SELECT query_id, unnest({PHRASES.format("question")}) AS phrase FROM pt)
  WHERE len({TERMS.format("phrase")}) > 0),
hits AS (SELECT inside, chunk_id, k, 1.5::DOUBLE * (length(head) - length(replace(head, inside, ''))) / length(inside) + 1.0::DOUBLE * (length(body) - length(replace(body, inside, ''))) / length(inside) AS f
  FROM (SELECT DISTINCT inside FROM ph), tt WHERE contains(body, inside) OR contains(head, inside)),
g AS (SELECT inside, count(*) AS holding FROM hits GROUP BY inside),
s AS (SELECT query_id, chunk_id, round(sum(CASE WHEN ln((n_chunks - holding + 0.5) / (holding + 0.5)) <= 0 THEN 1e-6
        ELSE ln((n_chunks - holding + 0.5) / (holding + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * k / mean)))::DOUBLE, 9) AS score
      FROM ph JOIN hits USING (inside) JOIN g USING (inside), n GROUP BY query_id, chunk_id)"""


@query(
    "ret_02_phrase_search",
    f"""WITH {DOCS}, {QUESTIONS}, {PHRASED} SELECT query_id, chunk_id, round(score, 6) AS score FROM s
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 40""",
)
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose first two words are joined by a hyphen: they must stand together. Phrases that repeat a word are left to tests."""
    words = F.split("question", " ")
    q = questions(spark, sf_dir)
    pair = F.concat_ws("-", F.get(words, F.lit(0)), F.get(words, F.lit(1)))
    parts = T.index_terms(pair)
    pair = F.when(F.size(F.array_distinct(parts)) == F.size(parts), pair)
    asked = q.select("query_id", F.concat_ws(" ", pair, F.get(words, F.lit(2))).alias("question"))
    found = retrieval.bm25(_index(spark, sf_dir), asked)
    return found.select("query_id", "chunk_id", F.round("keyword_score", 6).alias("score"))


VECTORS = """v AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS x FROM embeddings),
qv AS (SELECT chunk_id AS query_id, x AS y FROM v WHERE chunk_id % 25 = 0),
vs AS (SELECT query_id, chunk_id, list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) AS raw FROM v, qv),
vq AS (SELECT query_id, chunk_id, round(raw, 9) AS score FROM vs),
vt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vq WHERE score > 0 QUALIFY rank <= 40)"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return v, v.filter("chunk_id % 25 = 0").select(F.col("chunk_id").alias("query_id"), "vector")


@query("ret_11_vector_top", f"WITH {VECTORS} SELECT query_id, chunk_id, rank::BIGINT AS rank, round(score, 6) AS score FROM vt")
def vector_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.vector_top(*_vectors(spark, sf_dir))
    return out.select("query_id", "chunk_id", F.col("vector_rank").cast("long").alias("rank"), F.round("vector_score", 6).alias("score"))


@query(
    "ret_10_cosine",
    """SELECT label, count(*)::BIGINT AS n, round(avg(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS mean_square
       FROM embeddings GROUP BY label""",
)
def norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.functions import vectors as V

    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(V.dot(F.col("embedding"), F.col("embedding"))), 6).alias("mean_square"))


FUSED = """fu AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS fused, max(ks) AS ks, max(vs) AS vs FROM (
  SELECT query_id, chunk_id, rank, score AS ks, NULL::DOUBLE AS vs FROM kw UNION ALL SELECT query_id, chunk_id, rank, NULL, score FROM vt)
  GROUP BY query_id, chunk_id),
ft AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS rank FROM fu QUALIFY rank <= 30)"""

#: Questions whose number is also a vector's: both branches answer.
BOTH = VECTORS.replace("chunk_id % 25 = 0", "chunk_id IN (SELECT query_id FROM q)").replace(
    "FROM embeddings)", "FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))"
)


def _hybrid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, their vectors, and questions with theirs. Texts aren't shuffled to meet vectors that only the search by vectors reads."""
    v, _ = _vectors(spark, sf_dir)
    asked = storage.written(questions(spark, sf_dir).join(v.withColumnRenamed("chunk_id", "query_id"), "query_id"), "hybrid-questions")
    chunks = documents(spark, sf_dir)
    return chunks, v.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), asked


@query(
    "ret_12_rrf_fusion",
    f"""WITH {DOCS}, {QUESTIONS}, {BM25}, {BOTH}, {FUSED}
    SELECT query_id, chunk_id, rank::BIGINT AS rank, round(fused, 9) AS fused FROM ft
    WHERE query_id IN (SELECT query_id FROM qv)""",
)
def fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, vectors, asked = _hybrid(spark, sf_dir)
    fused = retrieval.fuse(retrieval.bm25(_index(spark, sf_dir), asked), retrieval.vector_top(vectors, asked))
    return fused.select("query_id", "chunk_id", F.col("fused_rank").cast("long").alias("rank"), F.round("fused_score", 9).alias("fused"))


def _overlap(column: str) -> str:
    terms = "list_distinct(regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[a-z0-9_]+'))"
    return f"(len(list_intersect({terms.format('question')}, {terms.format(column)})) / greatest(1, len({terms.format('question')})))::DOUBLE"


RERANKED = f"""rr AS (SELECT query_id, chunk_id, fused, {_overlap("content")} AS co, {_overlap("title")} AS ti,
    fused / max(fused) OVER w AS ff, coalesce(ks, 0) / CASE WHEN max(coalesce(ks, 0)) OVER w = 0 THEN 1 ELSE max(coalesce(ks, 0)) OVER w END AS kk,
    coalesce(vs, 0) / CASE WHEN max(coalesce(vs, 0)) OVER w = 0 THEN 1 ELSE max(coalesce(vs, 0)) OVER w END AS vv
  FROM ft JOIN d USING (chunk_id) JOIN q USING (query_id) WINDOW w AS (PARTITION BY query_id)),
rs AS (SELECT *, greatest(co, ti * 0.65) AS lo, 0.45::DOUBLE * co + 0.10::DOUBLE * ti + 0.20::DOUBLE * ff + 0.15::DOUBLE * kk + 0.10::DOUBLE * vv AS sc0 FROM rr),
rt AS (SELECT *, round(sc0, 9) AS sc FROM rs),
rc AS (SELECT *, max(lo) OVER (PARTITION BY query_id) AS ml, max(sc) OVER (PARTITION BY query_id) AS ms FROM rt),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, fused DESC, chunk_id) AS rank FROM rc
       WHERE ml > 0 AND lo >= greatest(0.03, ml * 0.25) AND sc >= ms * 0.25 QUALIFY rank <= 8)"""


@query(
    "ret_18_hybrid_search",
    f"""WITH {DOCS}, {QUESTIONS}, {BM25}, {BOTH}, {FUSED}, {RERANKED}
    SELECT query_id, chunk_id, rank::BIGINT AS rank, round(sc, 6) AS score, round(lo, 6) AS overlap FROM rk WHERE query_id IN (SELECT query_id FROM qv)""",
)
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, vectors, asked = _hybrid(spark, sf_dir)
    found = retrieval.hybrid_search(chunks, asked, index=_index(spark, sf_dir), vectors=vectors)
    return found.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("rerank_score", 6).alias("score"), F.round("lexical_overlap", 6).alias("overlap"))


FILTERED = "d.enabled AND d.media_type IN ('text') AND lower(d.path) LIKE '/library/src1/%' AND d.updated_at >= '2024-01-05' AND d.lang IN ('en', 'de')"
FILTERS = SearchFilters(media_types=("text",), folders=("/library/src1/",), since="2024-01-05", collections=("en", "de"))


def _allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return filter_documents(
        d, d.select("document_id", F.col("lang").alias("name")), d.select("document_id", F.col("source").alias("name")), FILTERS
    )


@query("flt_01_search_filters", f"WITH {DOCS} SELECT document_id, path, updated_at FROM d WHERE {FILTERED}")
def search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _allowed(spark, sf_dir).select("document_id", "path", "updated_at")


@query(
    "ret_04_bm25_filtered",
    f"""WITH {DOCS}, {QUESTIONS}, {BM25.split("kw AS")[0].rstrip().rstrip(",")}
    SELECT query_id, chunk_id, round(score, 6) AS score FROM s JOIN d USING (chunk_id) WHERE {FILTERED}
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 40""",
)
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.bm25(_index(spark, sf_dir), questions(spark, sf_dir), allowed=_allowed(spark, sf_dir).select("chunk_id"))
    return out.select("query_id", "chunk_id", F.round("keyword_score", 6).alias("score"))


GOLDEN = f"""WITH {DOCS}, {QUESTIONS}, {BM25},
top AS (SELECT query_id AS case_id, chunk_id AS id, rank FROM kw WHERE rank <= 10),
rel AS (SELECT query_id AS case_id, document_id AS id FROM q JOIN d ON contains(content, q.text)),
cases AS (SELECT DISTINCT case_id FROM rel),
f AS (SELECT case_id, min(rank) AS first FROM top JOIN rel USING (case_id, id) GROUP BY case_id),
m AS (SELECT avg((first IS NOT NULL)::INT) AS hit_rate, avg(coalesce(1.0::DOUBLE / first, 0)) AS mrr FROM cases LEFT JOIN f USING (case_id)),
c AS (SELECT case_id, id FROM top WHERE rank <= 4)
SELECT round(hit_rate, 6)::DOUBLE AS hit_rate, round(mrr, 6) AS mrr,
  round((SELECT count(*) FROM c JOIN rel USING (case_id, id)) / (SELECT count(*) FROM c), 6) AS citation_precision,
  round((SELECT count(DISTINCT case_id) FROM c JOIN rel USING (case_id, id)) / (SELECT count(*) FROM cases), 6) AS citation_coverage FROM m"""


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark passage whole: the index finds the passage's first terms, and only texts found are read."""
    q = questions(spark, sf_dir)
    begins = q.select("query_id", F.array_join(F.slice(T.index_terms(F.col("text")), 1, 4), " ").alias("phrase"))
    found = retrieval.phrase_hits(_index(spark, sf_dir), begins).select("query_id", "chunk_id")
    texts = documents(spark, sf_dir).select("chunk_id", "document_id", "content")
    hits = texts.join(found, "chunk_id").join(q.select("query_id", "text"), "query_id").filter(F.col("content").contains(F.col("text")))
    return hits.select(F.col("query_id").alias("case_id"), F.col("document_id").alias("id")).distinct()


@query("agg_12_golden_metrics", GOLDEN)
def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieval.bm25(_index(spark, sf_dir), questions(spark, sf_dir), retrieval.Bm25Options(keep=10))
    results = top.select(F.col("query_id").alias("case_id"), F.col("keyword_rank").alias("rank"), F.col("chunk_id").alias("id"))
    results, relevant = storage.written(results, "golden-results"), storage.written(_relevant(spark, sf_dir), "golden-relevant")
    targets = relevant.withColumn("target_id", F.col("case_id"))
    return qa.golden_metrics(results, relevant, results.filter("rank <= 4"), targets)


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few rows for each question, written: what comes of them neither searches again nor shuffles the documents' texts."""
    top = retrieval.bm25(_index(spark, sf_dir), questions(spark, sf_dir), retrieval.Bm25Options(keep=8))
    d = documents(spark, sf_dir).select("chunk_id", "title", "content", F.col("path").alias("source_id"))
    wide = top.join(d, "chunk_id").join(questions(spark, sf_dir).select("query_id", "question"), "query_id")
    return storage.written(qa.number_evidence(wide.withColumn("score", F.round("keyword_score", 6))), "evidence")


EVIDENCE = f"""{DOCS}, {QUESTIONS}, {BM25},
ev AS (SELECT query_id, question, chunk_id, title, content, path, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, title, path) AS no
       FROM kw JOIN d USING (chunk_id) JOIN q USING (query_id) WHERE rank <= 8)"""


@query("win_01_evidence_ids", f"WITH {EVIDENCE} SELECT query_id, chunk_id, 'S' || no AS evidence_id FROM ev")
def evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("query_id", "chunk_id", "evidence_id")


@query("ret_24_extractive_answers")
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.extractive_answers(qa.best_sentences(_evidence(spark, sf_dir)))


@query("agg_13_evidence_quality")
def evidence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = _evidence(spark, sf_dir)
    answered = qa.extractive_answers(qa.best_sentences(evidence))
    return qa.evidence_quality(answered, evidence.withColumn("identity", F.col("source_id")).select("query_id", "evidence_id", "identity", "instruction_risk"))


@query(
    "agg_14_source_count",
    f"WITH {EVIDENCE} SELECT query_id, count(DISTINCT path)::BIGINT AS n_sources, count(*)::BIGINT AS n_evidence FROM ev GROUP BY query_id",
)
def source_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = qa.source_identity(F.lit(None).cast("string"), F.col("source_id"), F.lit(None).cast("string"), F.col("source_id"))
    return _evidence(spark, sf_dir).groupBy("query_id").agg(F.countDistinct(key).alias("n_sources"), F.count(F.lit(1)).alias("n_evidence"))


@query(
    "rul_05_citation_errors",
    f"""WITH {EVIDENCE}, a AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'None.' ELSE 'It is so [S1] and [S12], see [S' || (query_id % 9 + 1) || '].' END AS md
      FROM (SELECT DISTINCT query_id FROM ev)),
    mk AS (SELECT DISTINCT query_id, substr(x, 2, length(x) - 2) AS citation_id FROM a, unnest(regexp_extract_all(md, '\\[S[0-9]+\\]')) AS u(x))
    SELECT mk.query_id, citation_id, 'unknown marker' AS error FROM mk LEFT JOIN ev ON ev.query_id = mk.query_id AND 'S' || ev.no = citation_id WHERE ev.no IS NULL
    UNION ALL SELECT mk.query_id, citation_id, 'chunk isn''t current' FROM mk JOIN ev ON ev.query_id = mk.query_id AND 'S' || ev.no = citation_id WHERE chunk_id % 17 = 0
    UNION ALL SELECT query_id, NULL, 'no markers' FROM a WHERE query_id % 3 = 0""",
)
def citation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = _evidence(spark, sf_dir)
    md = F.when(F.col("query_id") % 3 == 0, "None.").otherwise(
        F.concat(F.lit("It is so [S1] and [S12], see [S"), F.col("query_id") % 9 + 1, F.lit("]."))
    )
    answered = evidence.select("query_id").distinct().withColumn("markdown", md)
    known = evidence.select("query_id", "evidence_id", F.lit("knowledge").alias("source_kind"), F.lit(None).cast("string").alias("uri"), F.col("chunk_id").alias("document_id"), "chunk_id")
    return qa.citation_errors(answered, known, documents(spark, sf_dir).filter("enabled").select("chunk_id", "document_id"))


GOVERNED = f"""WITH {ITEMS}, n AS (SELECT item_id, updated_at, lower(title) AS t, lower(summary) AS s, lower(body) AS b, list_transform(tags, lambda x: lower(x)) AS g FROM i)
SELECT item_id, (CASE WHEN t = 'customer#0 kept' THEN 1000 ELSE 0 END + CASE WHEN starts_with(t, 'customer#0 kept') THEN 500 ELSE 0 END
  + 140 * (contains(t, 'customer#0')::INT + contains(t, 'kept')::INT) + 45 * (list_contains(g, 'customer#0')::INT + list_contains(g, 'kept')::INT)
  + 25 * (contains(s, 'customer#0')::INT + contains(s, 'kept')::INT) + 8 * (contains(b, 'customer#0')::INT + contains(b, 'kept')::INT))::BIGINT AS score
FROM n WHERE contains(t || ' ' || s || ' ' || b || ' ' || array_to_string(g, ' '), 'customer#0') AND contains(t || ' ' || s || ' ' || b || ' ' || array_to_string(g, ' '), 'kept')
ORDER BY score DESC, updated_at DESC, item_id DESC LIMIT 50"""


@query("ret_23_governed_search", GOVERNED)
def governed(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    tags = F.transform("tags", T.normalize)
    score = retrieval.governed_score(F.lit("customer#0 kept"), T.normalize(F.col("title")), none, T.normalize(F.col("summary")), T.normalize(F.col("body")), tags)
    scored = items(spark, sf_dir).withColumn("score", score).filter("score IS NOT NULL")
    return scored.orderBy(F.desc("score"), F.desc("updated_at"), F.desc("item_id")).limit(50).select("item_id", "score")


@query(
    "ret_22_embedding_profiles",
    "SELECT label, count(*)::BIGINT AS n, count(DISTINCT vec_id)::BIGINT AS ids, max(len(embedding))::BIGINT AS dimensions FROM embeddings GROUP BY label",
)
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("ids"), F.max(F.size("embedding")).cast("long").alias("dimensions"))


SPREAD = f"""WITH {DOCS}, c AS (SELECT source, chunk_id, row_number() OVER (PARTITION BY source ORDER BY chunk_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
  chunk_id % 29 = 0 AS focused FROM d),
e AS (SELECT source, round_even(k * (n - 1) / 11.0, 0)::BIGINT AS pos FROM (SELECT DISTINCT source, n FROM c), range(12) AS r(k)),
s AS (SELECT c.*, list_contains((SELECT list(e.pos) FROM e WHERE e.source = c.source), pos) AS even FROM c),
x AS (SELECT * FROM s WHERE focused OR even OR n <= 12),
y AS (SELECT *, count(*) OVER (PARTITION BY source) AS chosen, sum(focused::INT) OVER (PARTITION BY source ORDER BY pos) AS fn FROM x),
z AS (SELECT *, focused AND fn <= 6 AS first FROM y),
w AS (SELECT *, sum(first::INT) OVER (PARTITION BY source) AS nf, sum((NOT first)::INT) OVER (PARTITION BY source ORDER BY pos) AS rn FROM z)
SELECT source, chunk_id, round(1 - (row_number() OVER (PARTITION BY source ORDER BY pos) - 1) / (count(*) OVER (PARTITION BY source) * 1000.0), 6)::DOUBLE AS score
FROM w WHERE n <= 12 OR chosen <= 12 OR first OR rn <= 12 - nf"""


@query("ret_20_hierarchical_sample", SPREAD)
def hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    chunks = d.select(F.col("source").alias("document_id"), F.col("chunk_id").alias("ordinal"), "chunk_id", (F.col("chunk_id") % 29 == 0).alias("focused"))
    return qa.spread(chunks).select(F.col("document_id").alias("source"), "chunk_id", "score")


@query(
    "ret_19_strategy",
    r"""WITH s AS (SELECT source, sum(greatest(1, len(w) + ((length(text) - length(array_to_string(w, ''))) // 8)))::BIGINT AS tokens,
        count(*)::BIGINT AS n FROM (SELECT source, text, regexp_extract_all(text, '[A-Za-z0-9_]+|[\x{3400}-\x{9fff}]') AS w FROM documents) GROUP BY source)
    SELECT source, tokens, CASE WHEN tokens <= 12000 THEN 'full_context' ELSE 'hierarchical' END AS strategy FROM s""",
)
def strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    sums = d.groupBy("source").agg(F.sum(T.estimate_tokens(F.col("content"))).alias("tokens"))
    return sums.select("source", "tokens", qa.retrieval_strategy(F.lit("synthesis"), F.lit(1), F.lit(1), F.col("tokens")).alias("strategy"))


@query("ret_07_hashed_vectors")
def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.functions import ids

    d = documents(spark, sf_dir)
    return d.select("document_id", ids.hashed_vector(T.features(F.col("content"))).alias("vector"))


@query(
    "ret_06_features",
    r"""WITH f AS (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9_]+') AS w FROM documents)
    SELECT doc_id, (len(w) + greatest(len(w) - 1, 0))::BIGINT AS n, sha256(array_to_string(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '::' || w[i + 1])), ' ')) AS digest FROM f""",
)
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = T.features(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(f).cast("long").alias("n"), F.sha2(F.array_join(f, " "), 256).alias("digest"))
