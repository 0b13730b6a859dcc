"""Review of proposed knowledge, and the strict reading of model answers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import ids
from quillon.functions import text as T
from quillon.operators.rules import Rule, findings

# --- Proposals -------------------------------------------------------------------------------------------------------


def from_cards(cards: DataFrame, entities: DataFrame, changes: DataFrame) -> DataFrame:
    """proposal_id, title, body, summary, aliases, confidence of cards (run_id, document_id, card_id, title, content, segment_ids).

    Aliases are the entities (segment_id, canonical) of a card's segments in their order, the title aside; confidence is the
    least among its segments' changes (segment_id, confidence).
    """
    each = cards.select("card_id", "title", F.posexplode("segment_ids").alias("at", "segment_id"))
    named = (
        each.join(entities, "segment_id")
        .filter(T.normalize(F.col("canonical")) != T.normalize(F.col("title")))
        .groupBy("card_id", "canonical")
        .agg(F.min("at").alias("at"))
        .groupBy("card_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "canonical"))), lambda x: x["canonical"]).alias("aliases"))
    )
    sure = each.join(changes, "segment_id").groupBy("card_id").agg(F.min("confidence").alias("confidence"))
    key = ids.proposal_fingerprint(F.col("run_id"), F.col("document_id"), F.lit("topic"), T.normalize(F.col("title")), T.normalize(F.col("content")))
    return (
        cards.join(named, "card_id", "left")
        .join(sure, "card_id", "left")
        .select(
            key.alias("proposal_id"), "document_id", "title", F.col("content").alias("body"), F.substring("content", 1, 240).alias("summary"),
            F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "confidence", F.lit("proposed").alias("status"),
        )
        .dropDuplicates(["proposal_id"])
    )


def with_duplicates(proposals: DataFrame, items: DataFrame) -> DataFrame:
    """Adds duplicate_item_id: the smallest item (item_id, title, aliases) whose title or alias is the proposal's title."""
    names = items.select("item_id", F.explode(F.array_distinct(F.transform(F.concat(F.array("title"), "aliases"), T.normalize))).alias("name"))
    owner = names.groupBy("name").agg(F.min("item_id").alias("duplicate_item_id"))
    return proposals.withColumn("name", T.normalize(F.col("title"))).join(owner, "name", "left").drop("name")


def decide(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """proposals with their new status; decisions (proposal_id, decision: accept, merge or reject) bind only what is still proposed.

    A merge without a duplicate to merge into is an acceptance.
    """
    joined = proposals.join(decisions, "proposal_id", "left")
    waiting = F.col("status") == "proposed"
    status = (
        F.when(waiting & (F.col("decision") == "reject"), "rejected")
        .when(waiting & (F.col("decision") == "merge") & F.col("duplicate_item_id").isNotNull(), "merged")
        .when(waiting & F.col("decision").isin("accept", "merge"), "accepted")
        .otherwise(F.col("status"))
    )
    return joined.withColumn("status", status).drop("decision")


def apply_decisions(items: DataFrame, decided: DataFrame) -> DataFrame:
    """items (item_id, title, summary, body, aliases, status) after accepted proposals became items and merged ones were added to theirs.

    A body is added once, aliases are joined in order, and what changed needs review.
    """
    new = decided.filter("status = 'accepted'").select(
        F.concat(F.lit("item-"), F.substring("proposal_id", 1, 20)).alias("item_id"), "title", F.coalesce(T.blank_to_null(F.col("summary")), F.substring("body", 1, 240)).alias("summary"),
        "body", "aliases", F.lit("needs-review").alias("status"),
    )
    merged = decided.filter("status = 'merged'").groupBy(F.col("duplicate_item_id").alias("item_id")).agg(
        F.sort_array(F.collect_list(F.struct("proposal_id", "body", "summary", "aliases"))).alias("added")
    )

    def add(body: Column, x: Column) -> Column:
        return F.when(body.contains(x["body"]), body).otherwise(F.concat_ws("\n\n", T.blank_to_null(body), x["body"]))

    joined = items.join(merged, "item_id", "left")
    changed = F.col("added").isNotNull()
    names = F.array_distinct(F.concat("aliases", F.flatten(F.transform("added", lambda x: x["aliases"]))))
    return joined.select(
        "item_id", "title",
        F.when(changed, F.coalesce(T.blank_to_null(F.col("summary")), F.get("added", F.lit(0))["summary"])).otherwise(F.col("summary")).alias("summary"),
        F.when(changed, F.aggregate("added", F.trim("body"), add)).otherwise(F.col("body")).alias("body"),
        F.when(changed, names).otherwise(F.col("aliases")).alias("aliases"),
        F.when(changed, F.lit("needs-review")).otherwise(F.col("status")).alias("status"),
    ).unionByName(new)


def supporting_edges(decided: DataFrame, sources: DataFrame) -> DataFrame:
    """source_id, target_id, relation_type: a proposal's document (document_id, item_id) supports the item it became or joined."""
    target = F.when(F.col("status") == "merged", F.col("duplicate_item_id")).otherwise(F.concat(F.lit("item-"), F.substring("proposal_id", 1, 20)))
    done = decided.filter(F.col("status").isin("accepted", "merged")).select("document_id", target.alias("target_id"))
    return done.join(sources, "document_id").select(F.col("item_id").alias("source_id"), "target_id", F.lit("supports").alias("relation_type")).distinct()


# --- Strict answers --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class AnswerContract:
    """Version, and fields that an answer and its corrections have, no more and no fewer (fixed values)."""

    version: str = "deep-correction-response-v2"
    fields: tuple[str, ...] = ("schema_version", "chunk_id", "reviewed_segment_ids", "corrections", "chapters", "knowledge_cards", "entities")
    correction: tuple[str, ...] = ("segment_id", "corrected_text", "reason", "confidence", "uncertain", "evidence")


#: Quotes that stand for a whole text (fixed values).
WHOLE_SEGMENT, WHOLE_RERECOGNITION = "__FULL_SEGMENT__", "__FULL_RERECOGNITION__"
EVIDENCE = "struct<kind:string,segment_id:string,evidence_id:string,url:string,quote:string>"
CORRECTION = f"struct<segment_id:string,corrected_text:string,reason:string,confidence:double,uncertain:boolean,evidence:array<{EVIDENCE}>>"
ANSWER = f"schema_version string, chunk_id string, reviewed_segment_ids array<string>, corrections array<{CORRECTION}>"
#: Columns that answers may lack, and what counts for them.
OPTIONAL = {
    "context_ids": "array<string>", "rerecognition": "string", "glossary": "array<string>", "web": "array<struct<evidence_id:string,url:string,snippet:string>>",
}


def _read(answers: DataFrame) -> DataFrame:
    """answers with `a`, the answer as it is read, and `own`, its corrections without those of segments that only overlap."""
    for name, kind in OPTIONAL.items():
        if name not in answers.columns:
            answers = answers.withColumn(name, F.lit(None).cast(kind))
    read = answers.withColumn("a", F.from_json("payload", ANSWER))
    corrections = F.coalesce("a.corrections", F.array().cast(f"array<{CORRECTION}>"))
    overlap = F.array_except(F.coalesce("context_ids", F.array().cast("array<string>")), "core_ids")
    return read.withColumn("own", F.filter(corrections, lambda c: ~F.coalesce(F.array_contains(overlap, c["segment_id"]), F.lit(False))))


def _same(keys: Column, wanted: tuple[str, ...]) -> Column:
    return F.array_sort(keys) == F.array(*[F.lit(x) for x in sorted(wanted)])


def answer_errors(answers: DataFrame, contract: AnswerContract = AnswerContract()) -> DataFrame:
    """answer_id, code of answers (answer_id, payload, chunk_id, core_ids, source_text: map of segment id to text).

    An answer without errors may be applied: exact fields, all core segments reviewed in order, corrections of core segments
    only, none twice, confidence from 0 to 1, and evidence for each: quotes verbatim in the segment, the second recognition or
    the glossary, or a snippet of the web that was given under that id and address. Corrections of segments that only overlap
    (context_ids) aren't applied and aren't errors. Optional columns: context_ids, rerecognition, glossary, web.
    """
    raw = F.col("payload")
    item_keys = F.transform(F.from_json(F.get_json_object(raw, "$.corrections"), "array<string>"), lambda x: F.json_object_keys(x))
    read = _read(answers).withColumns({"keys": F.json_object_keys(raw), "item_keys": item_keys})
    corrections = F.col("own")
    touched = F.transform(corrections, lambda c: c["segment_id"])
    number = F.size(corrections)

    def proven(c: Column, e: Column) -> Column:
        quote = e["quote"]
        text = F.col("source_text")[F.coalesce(e["segment_id"], c["segment_id"])]
        held = lambda whole, inside: (quote == whole) | inside.contains(quote)
        low = F.transform("glossary", lambda g: F.lower(g))
        return F.coalesce(F.trim(quote) != "", F.lit(False)) & F.coalesce(
            F.when(e["kind"].isin("source", "context"), held(WHOLE_SEGMENT, text) & text.isNotNull())
            .when(e["kind"] == "rerecognition", held(WHOLE_RERECOGNITION, F.col("rerecognition")) & (e["segment_id"] == c["segment_id"]) & F.col("rerecognition").isNotNull())
            .when(e["kind"] == "glossary", F.array_contains(low, F.lower(quote)))
            .when(e["kind"] == "web", F.exists("web", lambda w: (w["evidence_id"] == e["evidence_id"]) & (w["url"] == e["url"]) & w["snippet"].contains(quote))),
            F.lit(False),
        )

    def quoted(c: Column) -> Column:
        return (F.size(c["evidence"]) > 0) & F.forall(c["evidence"], lambda e: proven(c, e))

    ok = lambda c: F.coalesce(c, F.lit(False))
    readable = F.col("keys").isNotNull() & ~raw.contains("```")
    return findings(
        read,
        ["answer_id"],
        [
            Rule("not_json", "error", ~readable),
            Rule("wrong_fields", "error", readable & ~ok(_same(F.col("keys"), contract.fields))),
            Rule("wrong_chunk", "error", readable & ~ok((F.col("a.schema_version") == contract.version) & (F.col("a.chunk_id") == F.col("chunk_id")))),
            Rule("not_all_reviewed", "error", readable & ~ok(F.col("a.reviewed_segment_ids") == F.col("core_ids"))),
            Rule("wrong_correction_fields", "error", readable & (F.size("item_keys") > 0) & ~ok(F.forall("item_keys", lambda k: _same(k, contract.correction)))),
            Rule("unknown_segment", "error", readable & ~ok(F.size(F.array_except(touched, "core_ids")) == 0)),
            Rule("corrected_twice", "error", readable & (F.size(F.array_distinct(touched)) < number)),
            Rule("confidence_out_of_range", "error", readable & ~ok(F.forall(corrections, lambda c: c["confidence"].between(0.0, 1.0)))),
            Rule("quote_not_verbatim", "error", readable & ~ok(F.forall(corrections, quoted))),
        ],
    ).select("answer_id", "code")


def usable_corrections(answers: DataFrame, contract: AnswerContract = AnswerContract()) -> DataFrame:
    """answer_id, segment_id, corrected_text, confidence, uncertain of the corrections of answers without errors."""
    sound = answers.join(answer_errors(answers, contract).select("answer_id").distinct(), "answer_id", "left_anti")
    each = _read(sound).select("answer_id", F.explode("own").alias("c"))
    return each.select("answer_id", "c.segment_id", "c.corrected_text", "c.confidence", "c.uncertain")
