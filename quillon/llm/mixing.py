"""Mixing sources to target weights with hash-threshold histograms (built-in functions only).

A source's target may exceed its size, so a target is ``passes`` whole passes over the source plus a rest.
The rest is the set of documents whose hash lies at or below a threshold. Thresholds come from histograms:
sizes are summed by source and leading hash bits, the bucket in which the budget ends is found by a running
sum over that source's buckets, and only the documents in that one bucket are histogrammed again by the
next bits. Documents are never sorted, and a larger budget always takes a superset of a smaller one.

Defined results: a null text has size 0; a null source is a source of its own and sorts last; a source whose
documents are all empty gets target 0; documents with equal hashes (a repeated doc_id) are taken or left
together; a null doc_id hashes as its own value; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD, materialise, text_of, wrapped


@dataclass(frozen=True)
class MixOptions:
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)  # dealt to the sources in order, repeating
    share: float = 1.0  # of all sizes
    max_repeats: int = 3
    seed: str = "mix"
    bits: int = 12  # of the hash, for each histogram


#: Bits of a document's hash: 15 hexadecimal digits.
HASH_BITS = 60


def size_of(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def hash_of(column: str, seed: str) -> Column:
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, options: MixOptions) -> DataFrame:
    """(key, source, source_size, target): the sources are a dimension, a few rows beside the documents.

    Targets are min(cap, level * weight) with the one level at which they sum to the budget; sources in order
    of cap / weight reach their caps first, so running sums give the level.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in options.weights])
    sources = sizes.withColumn(
        "weight", F.get(weights, ((F.row_number().over(in_order) - 1) % len(options.weights)).cast("int"))
    ).withColumn("cap", F.col("source_size") * float(options.max_repeats))
    everything = Window.partitionBy(F.lit(0))
    filling = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onwards = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * options.share
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onwards)
    free = F.col("level") * F.col("weight") <= F.col("cap")
    # The first source that stays below its cap fixes the level of all that follow.
    fixed = F.first(F.when(free, F.col("level")), ignorenulls=True).over(filling)
    return (
        sources.withColumn("level", level)
        .withColumn("fixed", fixed)
        .select(
            "key",
            "source",
            "source_size",
            F.least("cap", F.coalesce(F.col("fixed") * F.col("weight"), F.col("cap"))).alias("target"),
        )
    )


def _boundary(units: DataFrame, keys: list[str]) -> DataFrame:
    """Of units (keys, bucket, tokens, rest): the bucket of each key in which its rest ends, and what lies below."""
    below = Window.partitionBy(*keys).orderBy("bucket")
    return (
        units.withColumn("below", F.sum("tokens").over(below) - F.col("tokens"))
        .filter((F.col("below") < F.col("rest")) & (F.col("below") + F.col("tokens") >= F.col("rest")))
        .select(*keys, "bucket", "tokens", "rest", "below")
    )


def thresholds(narrow: DataFrame, targets: DataFrame, options: MixOptions) -> DataFrame:
    """(key, threshold): the largest hash that the rest of each source takes; sources without a rest have no row."""
    rests = targets.filter("source_size > 0").select(
        "key", (F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).alias("rest")
    ).filter("rest > 0")
    # Empty documents move no budget; two histograms narrow a source to one bucket of 2 ** (2 * bits).
    sized = narrow.filter("size > 0")
    shift = HASH_BITS - options.bits
    first = sized.groupBy("key", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("tokens"))
    at_first = _boundary(first.join(rests, "key"), ["key"])
    inside = at_first.select("key", F.col("bucket").alias("outer"), (F.col("rest") - F.col("below")).alias("rest"))
    second = (
        sized.withColumn("outer", F.shiftright("hash", shift))
        .join(inside, ["key", "outer"])
        .groupBy("key", "outer", "rest", F.shiftright("hash", shift - options.bits).alias("bucket"))
        .agg(F.sum("size").alias("tokens"))
    )
    at_second = _boundary(second, ["key"])
    last = at_second.select("key", F.col("bucket").alias("outer"), (F.col("rest") - F.col("below")).alias("rest"))
    # What is left is the documents that share 2 * bits leading bits with the budget's end: single hashes.
    third = (
        sized.withColumn("outer", F.shiftright("hash", shift - options.bits))
        .join(last, ["key", "outer"])
        .groupBy("key", "rest", F.col("hash").alias("bucket"))
        .agg(F.sum("size").alias("tokens"))
    )
    # The unit at the end is taken if that brings the sum nearer to the budget.
    nearer = F.col("below") + F.col("tokens") - F.col("rest") < F.col("rest") - F.col("below")
    return _boundary(third, ["key"]).select(
        "key", F.when(nearer, F.col("bucket")).otherwise(F.col("bucket") - 1).alias("threshold")
    )


def _key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def _limits(docs: DataFrame, options: MixOptions) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, hash, key of every document; key, source_size, target, passes, threshold of every source)."""
    narrow = materialise(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            size_of().alias("size"),
            hash_of("doc_id", options.seed).alias("hash"),
            _key("source").alias("key"),
        ),
        "sizes",
    )
    sizes = narrow.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes, options), "targets")
    limits = targets.join(materialise(thresholds(narrow, targets, options), "thresholds"), "key", "left").select(
        "key",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("passes"),
        F.coalesce("threshold", F.lit(-1)).alias("threshold"),
    )
    return narrow, materialise(limits, "limits")


#: How often a document with columns size and hash is taken, beside its source's limits.
_REPEATS = "cast(IF(size > 0, passes + IF(hash <= threshold, 1, 0), 0) AS long)"


def mix(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, repeats, taken."""
    narrow, limits = _limits(docs, options)
    # One row per source: Spark broadcasts it while its size allows, and splits a skewed join beyond that.
    return (
        narrow.join(limits, "key")
        .withColumn("repeats", F.expr(_REPEATS))
        .select(
            "doc_id", "source", "size", "source_size", "target", "repeats",
            (F.col("size") * F.col("repeats")).alias("taken"),
        )
    )


def apply_mix(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """The mix itself: every document of docs as often as the mix takes it, with its own columns.

    A document's repeats follow from itself and its source's limits, so texts stay where they lie.
    """
    _, limits = _limits(docs, options)
    own = [size_of("row.text").alias("size"), hash_of("row.doc_id", options.seed).alias("hash"), _key("row.source").alias("key")]
    return (
        wrapped(docs)
        .select("row", *own)
        .join(limits, "key")
        .withColumn("repeats", F.expr(_REPEATS))
        .filter("repeats > 0")
        .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
        .select("row.*")
    )
