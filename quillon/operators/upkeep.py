"""Changes that reach several tables at once: renaming, removal, quarantine, managed items, artifacts, re-indexing.

Every operator takes tables and returns them changed, so a caller commits all of them as one version or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import ids
from quillon.functions import text as T
from quillon.operators.incremental import admit

Tables = dict[str, DataFrame]


def rename(tables: Tables, titles: DataFrame) -> Tables:
    """tables with the titles (document_id, title) of renamed documents.

    Every table with document_id and title is changed; of items (item_type) only sources are. A blank title renames nothing.
    """
    new = titles.select("document_id", F.trim("title").alias("__title")).filter(F.col("__title") != "")

    def renamed(df: DataFrame) -> DataFrame:
        takes = F.col("__title").isNotNull() & ((F.col("item_type") == "source") if "item_type" in df.columns else F.lit(True))
        return df.join(new, "document_id", "left").withColumn("title", F.when(takes, F.col("__title")).otherwise(F.col("title"))).select(df.columns)

    return {name: renamed(df) if {"document_id", "title"} <= set(df.columns) else df for name, df in tables.items()}


def enable(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """documents with ``enabled`` as wanted (document_id, enabled) says."""
    new = wanted.select("document_id", F.col("enabled").alias("__enabled"))
    return documents.join(new, "document_id", "left").withColumn("enabled", F.coalesce("__enabled", "enabled")).select(documents.columns)


def cascade(tables: Tables, gone: DataFrame) -> Tables:
    """tables without the rows of documents (document_id) that go, and without what hangs on their chunks (chunk_id)."""
    chunks = tables["chunks"].join(gone, "document_id", "left_semi").select("chunk_id").distinct()

    def left(df: DataFrame) -> DataFrame:
        if "document_id" in df.columns:
            return df.join(gone.select("document_id"), "document_id", "left_anti").select(df.columns)
        return df.join(chunks, "chunk_id", "left_anti").select(df.columns) if "chunk_id" in df.columns else df

    return {name: left(df) for name, df in tables.items()}


def managed_states(items: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """items with status and maturity of managed sources (item_type source, managed_from documents) as their index has them:
    current while enabled and indexed, indexed while there are chunks. Items written by hand stay as they are."""
    held = chunks.select("document_id").distinct().withColumn("__held", F.lit(True))
    state = documents.select("document_id", "enabled").join(held, "document_id", "left").select("document_id", F.col("enabled").alias("__enabled"), "__held")
    rows = items.join(state, "document_id", "left")
    managed = (F.col("item_type") == "source") & (F.col("managed_from") == "documents")
    held_now = F.coalesce("__held", F.lit(False))
    status = F.when(managed, F.when(held_now & F.coalesce("__enabled", F.lit(False)), "current").otherwise("needs-review")).otherwise(F.col("status"))
    maturity = F.when(managed, F.when(held_now, "indexed").otherwise("unreviewed")).otherwise(F.col("maturity"))
    return rows.withColumns({"status": status, "maturity": maturity}).select(items.columns)


def quarantine(incoming: DataFrame, documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keep sources without an index: (report, documents, chunks).

    incoming: source_id, checksum, content_hash, seq; documents also document_id and enabled. A known source is disabled and
    loses its chunks; it is unchanged if it was so already. Report: source_id, status, duplicate_of, deleted_chunks.
    """
    judged = admit(incoming, documents)
    counted = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    known = documents.select("source_id", "document_id", "enabled").join(counted, "document_id", "left")
    rows = judged.join(known, "source_id", "left")
    n = F.when(F.col("status") == "duplicate", F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long")
    still = (F.col("status") == "unchanged") & ((n > 0) | F.col("enabled"))
    report = rows.select("source_id", F.when(still, "updated").otherwise(F.col("status")).alias("status"), "duplicate_of", n.alias("deleted_chunks"), "document_id")
    held = report.filter("status <> 'duplicate' AND document_id IS NOT NULL").select("document_id").distinct()
    disabled = enable(documents, held.withColumn("enabled", F.lit(False)))
    return report.drop("document_id"), disabled, chunks.join(held, "document_id", "left_anti")


def save_artifacts(artifacts: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, relations) that artifacts (artifact_id, title, markdown, source_document_ids) make: an output item each, and a source
    that supports it for each of its documents that is known."""
    output = F.concat(F.lit("kg:artifact:"), "artifact_id")
    source = F.concat(F.lit("kg:document:"), "document_id")
    outputs = artifacts.select(output.alias("item_id"), F.lit("output").alias("item_type"), F.lit("draft").alias("status"), F.lit("compiled").alias("maturity"), "title", F.col("markdown").alias("body"))
    each = artifacts.select(output.alias("target_id"), F.explode(F.array_distinct("source_document_ids")).alias("document_id"))
    known = each.join(documents.select("document_id", "title"), "document_id")
    sources = known.select(source.alias("item_id"), F.lit("source").alias("item_type"), F.lit("current").alias("status"), F.lit("indexed").alias("maturity"), "title", F.lit("").alias("body")).distinct()
    relations = known.select(ids.relation_id(source, F.col("target_id")).alias("relation_id"), source.alias("source_id"), "target_id", F.lit("supports").alias("relation_type"))
    return outputs.unionByName(sources), relations


def save_annotations(annotations: DataFrame, new: DataFrame) -> DataFrame:
    """annotations (annotation_id, document_id, chunk_id, kind, content, tags): a known one keeps its place and takes content, kind and tags."""
    a = annotations.alias("a").join(new.alias("n"), F.col("a.annotation_id") == F.col("n.annotation_id"), "full_outer")
    taken = ("kind", "tags")
    return a.select(
        F.coalesce("a.annotation_id", "n.annotation_id").alias("annotation_id"), *[F.coalesce(f"a.{c}", f"n.{c}").alias(c) for c in ("document_id", "chunk_id")],
        F.coalesce(F.trim("n.content"), F.col("a.content")).alias("content"), *[F.coalesce(f"n.{c}", f"a.{c}").alias(c) for c in taken],
    )


def reindex_runs(chunks: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """run_id, chunk_id, ordinal, action of transcripts that were grouped anew after edits.

    chunks: document_id, run_id, chunk_id, ordinal, content_hash as stored; rebuilt: the same of all chunks of the edited runs, numbered
    from 0. A rebuilt chunk keeps its vector where its hash is the same, and is embedded otherwise; stored chunks of a run
    that aren't rebuilt are deleted; other runs aren't touched. Ordinals go on from the run's first, or behind its document's last.
    """
    runs = rebuilt.select("run_id", "document_id").distinct()
    first = chunks.groupBy("run_id").agg(F.min("ordinal").alias("first"))
    last = chunks.groupBy("document_id").agg(F.max("ordinal").alias("last"))
    base = runs.join(first, "run_id", "left").join(last, "document_id", "left").select("run_id", F.coalesce("first", F.col("last") + 1, F.lit(0)).alias("base"))
    old = chunks.join(runs.select("run_id"), "run_id", "left_semi").select("run_id", "chunk_id", F.col("content_hash").alias("old_hash"))
    new = rebuilt.select("run_id", "chunk_id", F.col("ordinal").alias("offset"), F.col("content_hash").alias("new_hash"))
    action = F.when(F.col("new_hash").isNull(), "delete").when(F.col("new_hash") == F.col("old_hash"), "keep").otherwise("embed")
    both = old.join(new, ["run_id", "chunk_id"], "full_outer").join(base, "run_id", "left")
    return both.select("run_id", "chunk_id", (F.col("base") + F.col("offset")).cast("long").alias("ordinal"), action.alias("action"))


def newest_first(items: DataFrame) -> list[Column]:
    """The order of item lists: newest, then title whatever its case, then id."""
    return [F.desc("updated_at"), F.lower("title"), F.col("item_id")]


def by_number(column: str) -> Column:
    """Ids such as S10 in the order of their numbers."""
    return F.substring(column, 2, 20).try_cast("int")


def claim(items: DataFrame, by: list[str]) -> DataFrame:
    """Of each key the item (ordinal, status) that a worker takes next: one that runs, then one that waits, then another; none that is completed."""
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "queued", 1).otherwise(2)
    w = Window.partitionBy(*by).orderBy(rank, "ordinal")
    return items.filter("status <> 'completed'").withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def quality_overview(documents: DataFrame) -> DataFrame:
    """document_id, title, media_type, enabled, score, grade, accepted, n_checks of documents whose quality is JSON; without a report a
    document counts as older material that is accepted."""
    report = F.from_json("quality", "score long, grade string, accepted boolean, checks array<string>")
    rows = documents.withColumn("__q", report)
    return rows.select(
        "document_id", "title", "media_type", "enabled", F.coalesce("__q.score", F.lit(0).cast("long")).alias("score"), F.coalesce("__q.grade", F.lit(NO_REPORT)).alias("grade"),
        F.coalesce("__q.accepted", F.lit(True)).alias("accepted"), F.greatest(F.size("__q.checks"), F.lit(0)).cast("long").alias("n_checks"),
    )


#: The grade of documents from before there were reports (fixed value).
NO_REPORT = "历史资料"


def reranked_by_service(candidates: DataFrame, response: DataFrame) -> DataFrame:
    """candidates (query_id, position, ...) in the order of a rerank service's JSON answers (query_id, body), with rerank_score.

    Positions that don't exist, or that an answer names again, don't count; candidates that it doesn't name are left out.
    """
    shape = "results array<struct<index:int,relevance_score:double,score:double>>"
    named = response.select("query_id", F.posexplode(F.from_json("body", shape)["results"]).alias("at", "r"))
    score = F.coalesce("r.relevance_score", "r.score", F.lit(0.0))
    first = named.groupBy("query_id", F.col("r.index").alias("position")).agg(F.min("at").alias("rank"), F.min_by(score, "at").alias("rerank_score"))
    return candidates.join(first, ["query_id", "position"])


def service_vectors(requests: DataFrame, response: DataFrame) -> DataFrame:
    """request_id, position, vector of an embedding service's JSON answers (request_id, body), by the positions that they name;
    an answer with another number of vectors than was asked for (request_id, n), or with vectors of several lengths, gives none."""
    shape = "data array<struct<index:int,embedding:array<double>>>"
    rows = response.select("request_id", F.from_json("body", shape)["data"].alias("data")).join(requests, "request_id")
    sizes = F.array_distinct(F.transform("data", lambda x: F.size(x["embedding"])))
    good = rows.filter((F.size("data") == F.col("n")) & (F.size(sizes) == 1) & (F.size(F.array_distinct(F.transform("data", lambda x: x["index"]))) == F.col("n")))
    return good.select("request_id", F.explode("data").alias("x")).select("request_id", F.col("x.index").alias("position"), F.col("x.embedding").alias("vector"))


def streamed_text(lines: DataFrame, by: list[str]) -> DataFrame:
    """by, text of token deltas: NDJSON lines (by, seq, line) of objects with ``delta`` or ``message.content``; broken lines say nothing."""
    one = F.from_json("line", "delta string, message struct<content:string>")
    piece = F.coalesce(one["delta"], one["message"]["content"], F.lit(""))
    ordered = F.array_sort(F.collect_list(F.struct("seq", piece.alias("piece"))))
    return lines.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("text"))


def attempts(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """request_id, nth, provider that a transcription tries in turn: the one that it asks for, then, unless it forbids that, the others
    that are available (provider, priority, available), each once."""
    asked = requests.withColumn("provider", ids.provider_id(F.col("provider")))
    offered = providers.filter("available").select(F.col("provider").alias("candidate"), "priority")
    pairs = asked.join(F.broadcast(offered), F.lit(True))
    wanted = F.col("provider").isNull() | (F.col("provider") == F.col("candidate")) | F.col("fallback")
    w = Window.partitionBy("request_id").orderBy((~F.coalesce(F.col("provider") == F.col("candidate"), F.lit(False))).cast("int"), "priority", "candidate")
    return pairs.filter(wanted).select("request_id", F.row_number().over(w).alias("nth"), F.col("candidate").alias("provider"))


def audit_counts(changes: DataFrame, evidence: DataFrame, events: DataFrame) -> DataFrame:
    """run_id, n_changes, proposed, accepted, rejected, n_events, n_evidence of corrections.

    changes: run_id, change_id, status; evidence and events: change_id.
    """
    n = lambda df, name: df.filter("change_id IS NOT NULL").groupBy("change_id").agg(F.count(F.lit(1)).alias(name))
    rows = changes.join(n(evidence, "__e"), "change_id", "left").join(n(events, "__v"), "change_id", "left")
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    total = lambda c, name: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(name)
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_changes"), of("proposed"), of("accepted"), of("rejected"), total("__v", "n_events"), total("__e", "n_evidence"))


def short_claim(text: Column, at: Column, size: Column, radius: int = 36) -> Column:
    """What stands around a match (at: from 1): so many characters on either side, white space collapsed, without marks at its ends."""
    first = F.greatest(at - radius, F.lit(1))
    last = F.least(at + size - 1 + radius, F.length(text))
    return F.trim(T.collapse(F.substring(text, first.cast("int"), (last - first + 1).cast("int"))), F.lit(CLAIM_ENDS))


#: Marks that a claim neither begins nor ends with (fixed value).
CLAIM_ENDS = " ，,。；;：:"


def _hot_word(value: Column, longest: int) -> Column:
    return F.substring(T.collapse(F.translate(F.coalesce(value, F.lit("")), "\x00", " ")), 1, longest)


def hot_words(values: Column, most: int = 200, longest: int = 128) -> Column:
    """A list of words that a recogniser is told of: clean, bounded, each once whatever its case, the first spelling wins."""
    clean = F.transform(values, lambda v: _hot_word(v, longest))
    filled = F.filter(clean, lambda v: v != "")
    lows = F.transform(filled, lambda v: F.lower(v))
    first = F.filter(F.arrays_zip(filled.alias("v"), F.transform(lows, lambda v, i: F.array_position(lows, v) == i + 1).alias("f")), lambda x: x["f"])
    return F.slice(F.transform(first, lambda x: x["v"]), 1, most)


def hot_word_lists(words: DataFrame, by: list[str], most: int = 200, longest: int = 128) -> DataFrame:
    """by, words: ``hot_words`` of each group of words (by, place, word), in the order of their places, however many a group has.

    Equal words are one before they are shuffled, and a group's list is made of the few that stay. A group without words has an empty list.
    """
    clean = words.select(*by, "place", _hot_word(F.col("word"), longest).alias("v"))
    first = clean.groupBy(*by, F.lower("v").alias("low")).agg(F.min(F.struct("place", "v")).alias("first"))
    order = [F.col("low") == "", F.col("first")]
    kept = first.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("n") <= most)
    listed = F.array_sort(F.collect_list(F.when(F.col("low") != "", F.struct("n", F.col("first.v").alias("v")))))
    return kept.groupBy(*by).agg(F.transform(listed, lambda x: x["v"]).alias("words"))


def list_chunks(chunks: DataFrame, references: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, ordinal, chunk_id, title, page_number, text_start of chunks, in the document's order, with their reference where there is one."""
    titled = chunks.join(documents.select("document_id", "title"), "document_id")
    return titled.join(references.select("chunk_id", "page_number", "text_start"), "chunk_id", "left").select("document_id", "ordinal", "chunk_id", "title", "page_number", "text_start")


def integrity(documents: DataFrame, chunks: DataFrame, references: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: how many documents and chunks there are, chunks of no document, without a reference or a vector, vectors of no chunk,
    and documents without chunks."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [
        n(documents, "n_documents"), n(chunks, "n_chunks"), n(chunks.join(documents, "document_id", "left_anti"), "orphan_chunks"),
        n(chunks.join(references, "chunk_id", "left_anti"), "missing_references"), n(chunks.join(vectors, "chunk_id", "left_anti"), "missing_vectors"),
        n(vectors.join(chunks, "chunk_id", "left_anti"), "orphan_vectors"), n(documents.join(chunks, "document_id", "left_anti"), "empty_documents"),
    ]
    out = parts[0]
    for one in parts[1:]:
        out = out.crossJoin(one)  # one row each
    return out


def issue_chunks(issues: DataFrame, cores: DataFrame) -> DataFrame:
    """run_id, issue_id, ordinal: the correction cores whose context (run_id, ordinal, context_first, context_last) holds an issue's row
    (run_id, issue_id, position). Contexts are unnested, so the join is by equality."""
    held = cores.select("run_id", "ordinal", F.explode(F.sequence("context_first", "context_last")).alias("position"))
    return issues.join(held, ["run_id", "position"]).select("run_id", "issue_id", "ordinal")


def upsert_documents(documents: DataFrame, incoming: DataFrame, items: DataFrame, assessments: DataFrame) -> Tables:
    """documents, items and assessments after an upsert of incoming (document_id, title, summary, score).

    A null summary keeps the stored one. A new document gets a managed source item and an assessment whose score, out of 100, is
    clamped to 0 to 1; an item written by hand, and an older assessment, stay.
    """
    a, b = documents.alias("a"), incoming.alias("b")
    merged = a.join(b, F.col("a.document_id") == F.col("b.document_id"), "full_outer").select(
        F.coalesce("a.document_id", "b.document_id").alias("document_id"), F.coalesce("b.title", "a.title").alias("title"), F.coalesce("b.summary", "a.summary").alias("summary")
    )
    managed = incoming.select(
        F.concat(F.lit("kg:document:"), "document_id").alias("item_id"), "document_id", F.lit("source").alias("item_type"), "title", F.lit("documents").alias("managed_from")
    )
    known = items.filter("managed_from = 'documents'").select("document_id")
    fresh = managed.join(known, "document_id", "left_anti").select(items.columns)
    renamed = rename({"items": items.filter("managed_from = 'documents'")}, incoming.select("document_id", "title"))["items"]
    kept = items.filter("coalesce(managed_from, '') <> 'documents'")
    rated = incoming.filter("score IS NOT NULL").select("document_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / 100)).alias("completeness"))
    new = rated.join(assessments.select("document_id"), "document_id", "left_anti")
    return {"documents": merged, "items": kept.unionByName(renamed).unionByName(fresh), "assessments": assessments.unionByName(new.select(assessments.columns))}
