"""Exact deduplication with a heavy-hitter split (built-in functions only).

1. Every text becomes a digest: SHA-256 of the text with each run of white space replaced by one space.
2. Misra-Gries counters (Spark's frequent-items sketch) run per digest shard and name the digests that may
   be frequent; an exact count verifies them.
3. The verified winners, at most ``winners`` rows, are broadcast: rows of frequent texts are settled on the
   map side and never meet in one task.
4. The remaining digests are settled by an ordinary shuffle of (digest, id) pairs: a sum and a minimum that combine
   before the shuffle, then a join that Spark splits where a digest is frequent though no counter named it (a shard
   names its 16 most frequent only). ``exact_groups`` never shuffles texts; ``drop_exact_copies`` shuffles each
   row once, to find the rows that stay.

Defined results: a null text counts as empty; empty texts equal each other; rows that repeat a doc_id with the
same text are copies of which one row is kept; null doc_ids sort last; an empty table gives an empty result;
other columns, whatever their names, are ignored by ``exact_groups`` and carried by ``drop_exact_copies``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, materialise, text_of, wrapped


@dataclass(frozen=True)
class ExactDedupOptions:
    shards: int = 64  # digests are dealt to so many independent counter sets
    counters: int = 256  # items tracked in a shard
    candidates: int = 16  # most frequent items taken from a shard
    heavy_rows: int = 32  # a verified digest with fewer rows goes the ordinary way
    winners: int = 1024  # rows broadcast, at most

    def __post_init__(self) -> None:
        if self.shards * self.candidates > 65_536 or self.winners > 65_536:
            raise ValueError("the broadcast sides must stay small")


def digest_of(column: str = "text") -> Column:
    return F.sha2(F.regexp_replace(text_of(column), SPACE, " "), 256)


def _order() -> Column:
    """Smallest doc_id first, nulls last, then the row's number."""
    return F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_no"))


def frequent_digests(rows: DataFrame, options: ExactDedupOptions) -> DataFrame:
    """(digest, first, group_size) of the verified frequent digests, at most ``winners`` rows."""
    shard = F.pmod(F.xxhash64("digest"), F.lit(options.shards))
    named = (
        rows.groupBy(shard.alias("shard"))
        .agg(F.expr(f"approx_top_k(digest, {options.candidates}, {options.counters})").alias("top"))
        .select(F.explode("top").alias("top"))
        .select(F.col("top.item").alias("digest"))
    )
    return (
        rows.join(F.broadcast(named), "digest")  # shards * candidates rows at most
        .groupBy("digest")
        .agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") >= options.heavy_rows)
        .orderBy(F.desc("group_size"), "digest")
        .limit(options.winners)
    )


def exact_groups(docs: DataFrame, options: ExactDedupOptions = ExactDedupOptions()) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, row_no."""
    rows = materialise(
        docs.select("doc_id", digest_of().alias("digest")).withColumn("row_no", F.monotonically_increasing_id()),
        "digests",
    )
    heavy = materialise(frequent_digests(rows, options), "frequent")
    settled = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("group_size"))
    ordinary = rest.join(groups, "digest").select(settled.columns)
    return settled.unionAll(ordinary).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("first.row_no")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "row_no",
    )


def drop_exact_copies(docs: DataFrame, options: ExactDedupOptions = ExactDedupOptions()) -> DataFrame:
    """The rows of docs that stay, with their own columns. Rows that repeat (doc_id, text) stay once."""
    kept = exact_groups(docs, options).filter("kept").select(
        F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_digest")
    )
    again = Window.partitionBy("digest", "id").orderBy(F.lit(0))
    wide = (
        wrapped(docs)
        .withColumns({"digest": digest_of("row.text"), "id": F.col("row.doc_id")})
        .withColumn("copy", F.row_number().over(again))
        .filter("copy = 1")
    )
    match = (F.col("digest") == F.col("keep_digest")) & F.col("id").eqNullSafe(F.col("keep_id"))
    return wide.join(kept, match, "left_semi").select("row.*")
