"""Grounded answers: evidence, citations, coverage, strategies, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.retrieval import best

#: Phrases by which an answer admits that evidence is missing (fixed values).
INSUFFICIENT = ("没有足够资料", "资料不足", "insufficient evidence", "does not contain enough information")


def admits_lack(text: Column) -> Column:
    found = F.lit(False)
    for phrase in INSUFFICIENT:
        found = found | F.lower(text).contains(phrase)
    return found


def number_evidence(results: DataFrame) -> DataFrame:
    """Adds evidence_id S1.. by score, title and source within each query; one row for each chunk; risk of orders."""
    first = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("score"), "title", "source_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "title", "source_id")
    return (
        results.withColumn("nth", F.row_number().over(first))
        .filter("nth = 1")
        .drop("nth")
        .withColumn("evidence_no", F.row_number().over(order))
        .withColumns(
            {"evidence_id": F.concat(F.lit("S"), F.col("evidence_no")), "instruction_risk": T.gives_orders(F.col("content"))}
        )
    )


def source_identity(document: Column, uri: Column, path: Column, source: Column) -> Column:
    return F.coalesce(T.blank_to_null(document), T.blank_to_null(uri), T.blank_to_null(path), source)


def locator(page: Column, slide: Column, start: Column, end: Column, section: Column) -> Column:
    """page n, slide n, a-bs, section; only what is known."""
    time = F.when(start.isNotNull(), F.concat(F.round(start, 1), F.lit("-"), F.round(F.coalesce(end, start), 1), F.lit("s")))
    return F.concat_ws(", ", F.concat(F.lit("page "), page), F.concat(F.lit("slide "), slide), time, T.blank_to_null(section))


def evidence_line(most: int = 3600) -> Column:
    """A piece of evidence (content, evidence_id, instruction_risk, title) as JSON; its content up to so many characters."""
    return F.to_json(F.struct(F.substring("content", 1, most).alias("content"), "evidence_id", "instruction_risk", "title"))


def evidence_context(evidence: DataFrame, most: int = 3600) -> DataFrame:
    """query_id, context: one JSON line for each piece of evidence, in order."""
    line = evidence_line(most)
    lines = F.sort_array(F.collect_list(F.struct("evidence_no", line.alias("line"))))
    return evidence.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))


def claim_units(markdown: Column) -> Column:
    """The sentences of an answer that ought to carry a citation."""
    plain = F.regexp_replace(markdown, r"(?s)```.*?```", "")
    raw = F.split(plain, r"(?<=[。！？.!?])\s+|\n+")
    lead = lambda s: F.trim(F.regexp_replace(s, r"^\s*(?:[-*+]\s+|\d+[.)]\s+|>\s*)", ""))
    bare = lambda s: F.trim(F.regexp_replace(s, r"^#{1,6}\s+", ""))
    text = lambda s: F.trim(F.regexp_replace(s, r"\[S\d+\]", ""), F.lit(" \t:：;；"))
    units = F.transform(raw, lambda s: bare(lead(s)))
    return F.filter(units, lambda s: (F.length(text(s)) >= 5) & ~s.rlike(r"[:：]\s*$") & ~admits_lack(s))


def evidence_quality(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answers (query_id, markdown) with coverage, utilisation, diversity and level against evidence
    (query_id, evidence_id, identity, instruction_risk)."""
    found = evidence.groupBy("query_id").agg(
        F.collect_set("evidence_id").alias("ids"),
        F.count(F.lit(1)).alias("n_evidence"),
        F.countDistinct("identity").alias("n_sources"),
        F.count_if("instruction_risk").alias("n_risks"),
    )
    cited = F.array_intersect(T.citation_markers(F.col("markdown")), F.coalesce("ids", F.array().cast("array<string>")))
    claims = claim_units(F.col("markdown"))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 3)).otherwise(0.0)
    return (
        answers.join(found, "query_id", "left")
        .withColumns(
            {
                "n_evidence": F.coalesce("n_evidence", F.lit(0)),
                "n_sources": F.coalesce("n_sources", F.lit(0)),
                "n_risks": F.coalesce("n_risks", F.lit(0)),
                "n_cited": F.size(cited),
                "n_claims": F.size(claims),
                "n_cited_claims": F.size(F.filter(claims, lambda c: c.rlike(r"\[S\d+\]"))),
            }
        )
        .withColumns(
            {
                "coverage": share(F.col("n_cited_claims"), F.col("n_claims")),
                "utilization": share(F.col("n_cited"), F.col("n_evidence")),
                "diversity": share(F.col("n_sources"), F.col("n_evidence")),
            }
        )
        .withColumn(
            "level",
            F.when((F.col("n_evidence") == 0) | (F.col("n_cited") == 0), "insufficient")
            .when(F.col("coverage") >= 0.8, "well_supported")
            .when(F.col("coverage") >= 0.4, "partially_supported")
            .otherwise("limited"),
        )
        .drop("ids")
    )


def citation_errors(answers: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, citation_id, error: markers without evidence, without identity, or of chunks that aren't current."""
    marked = answers.select("query_id", F.explode(T.citation_markers(F.col("markdown"))).alias("citation_id"))
    known = evidence.withColumnRenamed("evidence_id", "citation_id")
    current = chunks.select("chunk_id", "document_id", F.lit(True).alias("current"))
    error = (
        F.when(F.col("source_kind").isNull(), "unknown marker")
        .when((F.col("source_kind") == "web") & (F.coalesce("uri", F.lit("")) == ""), "no address")
        .when((F.col("source_kind") == "knowledge") & (F.col("document_id").isNull() | F.col("chunk_id").isNull()), "no identity")
        .when((F.col("source_kind") == "knowledge") & F.col("current").isNull(), "chunk isn't current")
    )
    wrong = (
        marked.join(known, ["query_id", "citation_id"], "left")
        .join(current, ["chunk_id", "document_id"], "left")
        .select("query_id", "citation_id", error.alias("error"))
        .filter("error IS NOT NULL")
    )
    silent = (
        answers.filter((F.size(T.citation_markers(F.col("markdown"))) == 0) & ~admits_lack(F.col("markdown")))
        .join(evidence.select("query_id").distinct(), "query_id", "left_semi")
        .select("query_id", F.lit(None).cast("string").alias("citation_id"), F.lit("no markers").alias("error"))
    )
    return wrong.unionByName(silent)


def best_sentences(evidence: DataFrame, pieces: int = 4, most: int = 360) -> DataFrame:
    """query_id, evidence_id, excerpt: of the first pieces of evidence the sentence that shares most terms."""
    asked = T.rerank_terms(F.col("question"), "-")
    sentences = F.filter(F.transform(F.split("content", r"(?<=[。！？.!?])\s+|\n+"), lambda x: F.trim(x)), lambda s: s != "")
    split = (
        evidence.filter(F.col("evidence_no") <= pieces)
        .withColumn("asked", asked)
        .select("query_id", "evidence_id", "evidence_no", "asked", F.posexplode(sentences).alias("at", "sentence"))
        .withColumn("shared", F.size(F.array_intersect("asked", T.rerank_terms(F.col("sentence"), "-"))))
    )
    top = best(split, ["query_id", "evidence_id"], [F.desc("shared"), F.col("at")], 1)
    return top.select("query_id", "evidence_no", "evidence_id", T.excerpt(F.col("sentence"), most).alias("excerpt"))


def extractive_answers(excerpts: DataFrame) -> DataFrame:
    """query_id, markdown: the excerpts as a list, each with its marker."""
    line = F.concat(F.lit("- "), "excerpt", F.lit(" ["), "evidence_id", F.lit("]"))
    lines = F.sort_array(F.collect_list(F.struct("evidence_no", line.alias("line"))))
    return excerpts.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("markdown"))


def retrieval_strategy(task: Column, n_selected: Column, n_retrieved: Column, tokens: Column, budget: int = 12_000) -> Column:
    """full_context, hierarchical or focused, by the number of selected or retrieved documents and their tokens."""
    summary = task == "synthesis"
    single = (n_selected == 1) | ((n_selected == 0) & summary & (n_retrieved == 1))
    return (
        F.when(single & (tokens <= budget), "full_context").when(single & summary, "hierarchical").otherwise("focused")
    )


def spread(chunks: DataFrame, limit: int = 12) -> DataFrame:
    """Of each document's chunks (document_id, ordinal, chunk_id, focused) at most `limit`: focused ones, at most half of the
    limit if there are too many, and evenly spaced ones; scores fall with the position."""
    by_document = Window.partitionBy("document_id")
    rows = chunks.withColumns(
        {"at": F.row_number().over(by_document.orderBy("ordinal", "chunk_id")) - 1, "n": F.count(F.lit(1)).over(by_document)}
    )
    # Python's rounding to even of i (n - 1) / (limit - 1), for all i at once.
    spots = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.bround(i * (F.col("n") - 1) / F.lit(limit - 1)).cast("long"))
    rows = rows.withColumn("even", F.array_contains(spots, F.col("at").cast("long")))
    rows = rows.filter(F.col("focused") | F.col("even") | (F.col("n") <= limit))
    rows = rows.withColumns(
        {
            "chosen": F.count(F.lit(1)).over(by_document),
            "focused_no": F.sum(F.col("focused").cast("int")).over(by_document.orderBy("at")),
        }
    )
    half = max(1, limit // 2)
    first = F.col("focused") & (F.col("focused_no") <= half)
    rows = rows.withColumn("first", first).withColumns(
        {
            "n_first": F.sum(F.col("first").cast("int")).over(by_document),
            "rest_no": F.sum((~F.col("first")).cast("int")).over(by_document.orderBy("at")),
        }
    )
    kept = rows.filter(
        (F.col("n") <= limit) | (F.col("chosen") <= limit) | F.col("first") | (F.col("rest_no") <= F.lit(limit) - F.col("n_first"))
    )
    total = F.count(F.lit(1)).over(by_document)
    place = F.row_number().over(by_document.orderBy("at")) - 1
    return kept.withColumn("score", F.round(1 - place / (total * 1000), 6)).select("document_id", "chunk_id", "ordinal", "score")


def golden_metrics(results: DataFrame, relevant: DataFrame, citations: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: hit_rate, mrr, citation_precision, citation_coverage.

    results (case_id, rank, id), relevant (case_id, id), citations (case_id, citation_id, id), targets (case_id,
    target_id, id); cases are those of relevant.
    """
    cases = relevant.select("case_id").distinct()
    first = results.join(relevant, ["case_id", "id"], "left_semi").groupBy("case_id").agg(F.min("rank").alias("first"))
    retrieval = cases.join(first, "case_id", "left").agg(
        F.avg(F.col("first").isNotNull().cast("double")).alias("hit_rate"),
        F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("mrr"),
    )
    good = citations.join(relevant, ["case_id", "id"], "left_semi").agg(F.count(F.lit(1)).alias("good"))
    covered = targets.join(citations.select("case_id", "id").distinct(), ["case_id", "id"], "left_semi")
    covered = covered.agg(F.countDistinct("case_id", "target_id").alias("covered"))
    totals = citations.agg(F.count(F.lit(1)).alias("cited")).crossJoin(
        targets.agg(F.countDistinct("case_id", "target_id").alias("targets"))
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    # Each side is one row.
    return retrieval.crossJoin(good).crossJoin(covered).crossJoin(totals).select(
        F.round("hit_rate", 6).alias("hit_rate"),
        F.round("mrr", 6).alias("mrr"),
        share("good", "cited").alias("citation_precision"),
        share("covered", "targets").alias("citation_coverage"),
    )
