"""SimHash document fingerprints and permuted block tables (built-in functions only).

A term is a lower-cased word and weighs its length, so that short function words count for little; each
occurrence votes with its weight on the 128 signed bits of its hash. Votes are packed two to a long and summed
per document before anything is shuffled. Searching splits a fingerprint into radius + 1 blocks: fingerprints
within the radius agree on one block at least, so one table per block, keyed by that block, finds all of them.

Defined results: a null text counts as empty; a text without words has the all-zero fingerprint; equal texts
have equal fingerprints; a null doc_id comes first in the order of documents; rows that repeat a doc_id follow
each other; a single document is its own next one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, materialise, shuffle_partitions, text_of

BITS = 128
LANE = 0x0000000100000001
LOW = 0xFFFFFFFF


def _bit_sums(hashed: str, name: str) -> list[Column]:
    """32 sums; sum k holds the votes for bit k in its low and for bit 32 + k in its high half.

    A half can't overflow: all weights of a text sum to its length at most, which is below 2 ** 31.
    """
    lane = F.lit(LANE)
    return [
        F.sum(F.shiftrightunsigned(hashed, k).bitwiseAND(lane) * F.col("weight")).alias(f"{name}_{k}") for k in range(32)
    ]


def _bits(name: str) -> Column:
    """The long whose bit is set where more than half of the weight voted for it."""

    def bit(k: int) -> Column:
        half = F.col(f"{name}_{k % 32}")
        votes = half.bitwiseAND(F.lit(LOW)) if k < 32 else F.shiftrightunsigned(half, 32)
        return F.when(2 * votes > F.col("weight"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))

    return reduce(lambda a, b: a.bitwiseOR(b), [bit(k) for k in range(64)])


def simhash(texts: DataFrame, keys: list[str], body: str) -> DataFrame:
    """keys, fp_high, fp_low: the fingerprint of each row's body; keys must tell the rows apart."""
    word = F.explode(F.split(F.lower(F.col(body)), SPACE))
    terms = texts.select(*keys, word.alias("word")).select(
        *keys,
        F.length("word").cast("long").alias("weight"),
        F.xxhash64("word").alias("h"),
        F.xxhash64(F.lit(1), "word").alias("l"),
    )
    votes = terms.groupBy(*keys).agg(F.sum("weight").alias("weight"), *_bit_sums("h", "h"), *_bit_sums("l", "l"))
    return votes.select(*keys, _bits("h").alias("fp_high"), _bits("l").alias("fp_low"))


def hex_of(high: str, low: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(F.col(c)), 16, "0") for c in (high, low)]))


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)), F.lit(0))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def _bucket(bounds: list[int]) -> Column:
    """The number of the last bound that is not above doc_id; two short searches instead of one long one."""
    step = max(1, round(len(bounds) ** 0.5))
    fine = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    upto = lambda bounds: F.size(F.filter(bounds, lambda x: x <= F.col("doc_id")))
    coarse = F.greatest(upto(F.array(*[F.lit(b[0]) for b in fine])), F.lit(1))
    parts = F.array(*[F.array(*[F.lit(x) for x in b]) for b in fine])
    inner = F.greatest(upto(F.get(parts, coarse - 1)), F.lit(1))
    return F.coalesce((coarse - 1) * step + inner - 1, F.lit(0))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """bucket, last, row_no, doc_id, text, next_text: each document beside the next by doc_id.

    Quantiles of doc_id deal the documents to buckets, and the first document of each bucket is also sent, marked
    ``last``, to the end of the bucket before; so neighbours meet within a bucket and no task sorts everything.
    """
    n = buckets or 2 * shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(n)], max(10_000, 20 * n))).first()[0]
    bounds = sorted(set(cuts or [0]))
    here = F.struct(F.col("own").alias("bucket"), F.lit(False).alias("last"))
    before = F.struct(((F.col("own") + len(bounds) - 1) % len(bounds)).alias("bucket"), F.lit(True).alias("last"))
    opens = F.col("doc_id").isin(bounds) if len(bounds) <= 4096 else F.col("doc_id") == F.get(F.lit(bounds), "own")
    opens = F.col("doc_id").isNull() | opens  # null ids come first of all: the last document's next is among them
    dealt = (
        rows.withColumns({"row_no": F.monotonically_increasing_id(), "own": _bucket(bounds)})
        .withColumn("to", F.explode(F.when(opens, F.array(here, before)).otherwise(F.array(here))))
        .select(F.col("to.bucket").cast("int").alias("bucket"), "to.last", "row_no", "doc_id", "text")
        # A bucket is a partition: by hash, several would meet in one task.
        .repartitionById(len(bounds), F.col("bucket").cast("int"))
    )
    return dealt.withColumn("next_text", F.lead("text").over(_along()))


def _along() -> Window:
    return Window.partitionBy("bucket").orderBy("last", F.col("doc_id").asc_nulls_first(), "row_no")


def fingerprint_edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, high, low, edited_high, edited_low, near_edited, near_next.

    All steps keep the partitioning by bucket: texts are shuffled once.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half),
        F.substring(F.coalesce(F.col("next_text"), F.lit("")), F.lit(1), half),
    )
    pairs = (
        with_next(docs, buckets)
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", edited)
        .withColumn("edited_sha256", F.sha2("edited", 256))
    )
    keys = ["bucket", "last", "row_no", "doc_id", "n_chars", "edited_sha256"]
    both = pairs.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")),
                F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")),
            )
        ).alias("one"),
    ).select(*keys, "one.kind", "one.body")
    of = lambda kind, part: F.max(F.when(F.col("kind") == kind, F.col(part)))
    prints = (
        simhash(both, [*keys, "kind"], "body")
        .groupBy(*keys)
        .agg(
            of(0, "fp_high").alias("high"), of(0, "fp_low").alias("low"),
            of(1, "fp_high").alias("edited_high"), of(1, "fp_low").alias("edited_low"),
        )
    )
    along = _along()
    return (
        prints.withColumns({"next_high": F.lead("high").over(along), "next_low": F.lead("low").over(along)})
        .filter(~F.col("last"))
        .select(
            "row_no", "doc_id", "n_chars", "edited_sha256", "high", "low", "edited_high", "edited_low",
            likeness(("high", "low"), ("edited_high", "edited_low")).alias("near_edited"),
            likeness(("high", "low"), ("next_high", "next_low")).alias("near_next"),
        )
    )


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 blocks that cover the fingerprint."""
    edges = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _block(high: str, low: str, first: int, bits: int) -> Column:
    """Bits [first, first + bits) of the fingerprint, counted from its low end."""
    mask = F.lit((1 << bits) - 1 if bits < 64 else -1)
    if first >= 64:
        return F.shiftrightunsigned(high, first - 64).bitwiseAND(mask)
    part = F.shiftrightunsigned(low, first)
    if first + bits > 64:
        part = part.bitwiseOR(F.shiftleft(F.col(high), 64 - first))
    return part.bitwiseAND(mask)


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3) -> DataFrame:
    """high, low, n_within: for each distinct query fingerprint, the rows of prints within the Hamming radius.

    Both sides are reduced to distinct fingerprints with counts before the tables are built. A pair that
    several tables find counts in the first of them only, so pairs need no distinct.
    """
    if not 0 <= radius < BITS:
        raise ValueError("the radius must be at least 0 and below the number of bits")
    blocks = _blocks(radius)

    def tables(df: DataFrame, high: str, low: str) -> DataFrame:
        keyed = F.posexplode(F.array(*[_block(high, low, *b) for b in blocks]))
        return df.select("*", keyed.alias("tab", "block"))

    known = prints.groupBy(F.col("high").alias("p_high"), F.col("low").alias("p_low")).agg(F.count(F.lit(1)).alias("rows"))
    asked = queries.select(F.col("high").alias("q_high"), F.col("low").alias("q_low")).distinct()
    first_table = F.coalesce(
        *[F.when(_block("q_high", "q_low", *b) == _block("p_high", "p_low", *b), F.lit(i)) for i, b in enumerate(blocks)]
    )
    return (
        tables(asked, "q_high", "q_low")
        .join(tables(known, "p_high", "p_low"), ["tab", "block"])
        .filter(distance(("q_high", "q_low"), ("p_high", "p_low")) <= radius)
        .filter(first_table == F.col("tab"))
        .groupBy(F.col("q_high").alias("high"), F.col("q_low").alias("low"))
        .agg(F.sum("rows").alias("n_within"))
    )


def fingerprint_report(docs: DataFrame, radius: int = 3, every: int = 100) -> DataFrame:
    """Fingerprints of all documents; documents whose id is divisible by ``every`` also search all others.

    n_near: how many other documents lie within the radius; null where the document isn't a query.
    """
    prints = materialise(fingerprint_edits(docs), "prints")
    queries = prints.filter(F.col("doc_id") % every == 0)
    # Tables of two longs; the answers belong to the queries, one row in `every`.
    answers = queries.join(within_radius(queries, prints, radius), ["high", "low"]).select(
        "row_no", (F.col("n_within") - 1).alias("n_near")
    )
    return prints.join(answers, "row_no", "left").select(
        "doc_id", "n_chars", "edited_sha256",
        hex_of("high", "low").alias("fingerprint"),
        hex_of("edited_high", "edited_low").alias("edited_fingerprint"),
        "near_edited", "near_next", "n_near",
    )
