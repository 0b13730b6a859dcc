"""Near-duplicate detection: MinHash bands propose, odd sketches screen, full shingle sets confirm.

A document's set holds its distinct 5-word shingles. Documents are linked when the Jaccard similarity of their
sets is at least 0.75, and a component holds what links reach.

1. One Arrow pass gives each document its set's size and key, 32 band keys of 4 MinHash values and an odd sketch:
   256 MinHash samples folded into a 512-bit parity bitmap.
2. Documents with equal sets form a class; only its smallest document goes on.
3. Documents that share a band key are candidates. At similarity 0.75 the chance to share none is 5e-6. Instead of all
   pairs of a key, a document is compared with the three centres (smallest documents of its keys) with which it shares
   most keys. The population count of two sketches' XOR estimates the similarity and screens the pairs; those that may
   reach the threshold are confirmed on their full sets. Links give components.
4. What is left are keys whose documents lie in several components. In small keys all pairs across components are
   screened and confirmed. Large keys that share documents form clusters, in which each document outside the largest
   component is compared with all in other components, in blocks; only links leave such a task. So no candidate pair
   of different components goes unexamined, pairs within a component need no look, and rows stay in proportion to documents.

Defined results: a null text counts as empty; without words the set is empty and linked with nothing; rows that
repeat a doc_id with the same text are one document, with different texts they link what either links; null doc_ids
form no links and come out as their own component (null); an empty table gives an empty result; other columns are
ignored by ``near_groups`` and carried by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import lean, materialise, text_of, wrapped
from quillon.llm.components import components
from quillon.llm.wordhash import constants, mix, shingle_sets, texts_of


@dataclass(frozen=True)
class NearDedupOptions:
    width: int = 5  # words of a shingle
    percent: int = 75  # similarity at which documents are linked
    bands: int = 32
    band_rows: int = 4
    samples: int = 256  # MinHash values; the bands use the first of them
    sketch_bits: int = 512
    slack: float = 4.75  # standard deviations by which a sketch may miss the threshold
    centres: int = 3  # with which a document is compared at first
    batch_rows: int = 256  # that Python holds at once
    block: int = 128  # documents that are compared with as many others in one task


def minhashes(values: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The smallest of each affine image of the values; in blocks, so that memory doesn't follow the text."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(values), 512):
        np.minimum(low, (values[i : i + 512, None] * factors + terms).min(axis=0), out=low)
    return low


def odd_sketch(low: np.ndarray, bits: int) -> np.ndarray:
    """The parity of how many (sample number, value) pairs hash to each bit."""
    at = mix(low + np.arange(len(low), dtype=np.uint64)) % np.uint64(bits)
    odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_odd_bits(options: NearDedupOptions) -> int:
    """The population count that a linked pair exceeds only with the slack's small chance."""
    share = options.percent / 100
    differing = options.samples * (1 - share)
    differing += options.slack * (options.samples * share * (1 - share)) ** 0.5
    fill = (1 - np.exp(-4 * differing / options.sketch_bits)) / 2
    return int(options.sketch_bits * fill + options.slack * (options.sketch_bits * fill * (1 - fill)) ** 0.5) + 1


SIGNATURE = "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>"


def signatures(docs: DataFrame, options: NearDedupOptions) -> DataFrame:
    factors, terms = constants(options.samples, 11), constants(options.samples, 13)
    mixers = constants(options.band_rows, 17)
    band_numbers = constants(options.bands, 19)
    used = options.bands * options.band_rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bands, sketches = [], [], [], []
            for values in shingle_sets(texts_of(batch.column(1)), options.width):
                sizes.append(len(values))
                again = mix(values)
                keys.append(np.array([values.sum(dtype=np.uint64), again.sum(dtype=np.uint64)]).tobytes())
                if len(values):
                    low = minhashes(values, factors, terms)
                    rows = low[:used].reshape(options.bands, options.band_rows)
                    bands.append(mix((mix(rows) * mixers).sum(axis=1, dtype=np.uint64) + band_numbers).view(np.int64))
                    sketches.append(odd_sketch(low, options.sketch_bits))
                else:
                    bands.append(np.empty(0, dtype=np.int64))
                    sketches.append(np.empty(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, type=pa.int64()),
                    pa.array(keys, type=pa.binary()),
                    pa.array(bands, type=pa.list_(pa.int64())),
                    pa.array(sketches, type=pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_key", "bands", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(sign, SIGNATURE)


def wanted_bits(ids: DataFrame, bits: int = 24) -> np.ndarray:
    """A bitmap over the hashes of ids (column rep): 2 ** bits bits, whatever the number of ids."""
    slot = F.pmod(F.xxhash64("rep"), F.lit(1 << bits))
    words = ids.select(slot.alias("slot")).groupBy(F.expr("cast(shiftright(slot, 6) AS int)").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("held")
    )
    table, out = words.toArrow(), np.zeros(1 << (bits - 6), dtype=np.int64)
    out[table["word"].to_numpy()] = table["held"].to_numpy()
    return out


def full_sets(docs: DataFrame, wanted: np.ndarray, width: int) -> DataFrame:
    """rep, set: the sorted shingle hashes as bytes, for the documents in the bitmap and a few more.

    The bitmap has a fixed size and keeps texts from being shuffled: only sets of wanted documents are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    bits = (len(wanted) * 64).bit_length() - 1

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(2).to_numpy()
            keep = (shared.value[slot >> 6] >> (slot & 63)) & 1
            some = batch.filter(pa.array(keep.astype(bool)))
            found = [x.tobytes() for x in shingle_sets(texts_of(some.column(1)), width)]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, type=pa.binary())], names=["rep", "set"])

    rep = F.col("doc_id").cast("long")
    slot = F.pmod(F.xxhash64(rep), F.lit(1 << bits))
    known = docs.filter(rep.isNotNull()).select(rep.alias("rep"), text_of().alias("text"), slot.alias("slot"))
    return known.mapInArrow(sets, "rep long, set binary")


def _odd_bits(a: str, b: str, options: NearDedupOptions) -> Column:
    words = options.sketch_bits // 64
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(words)), F.lit(0))


def confirm(pairs: DataFrame, sets: DataFrame, options: NearDedupOptions) -> DataFrame:
    """Of pairs (a, b) of representatives those whose full sets (rep, set) are similar enough."""
    percent = options.percent

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))

    left = pairs.join(sets.withColumnRenamed("set", "a_set"), F.col("a") == F.col("rep")).drop("rep")
    return left.join(sets.withColumnRenamed("set", "b_set"), F.col("b") == F.col("rep")).select(
        "a", "b", "a_set", "b_set"
    ).mapInArrow(check, "a long, b long")


def near_groups(docs: DataFrame, options: NearDedupOptions = NearDedupOptions()) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    docs = lean(docs, rows=options.batch_rows)
    signed = materialise(signatures(docs, options), "signatures")
    filled = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialise(filled.groupBy("n_shingles", "set_key").agg(F.min("doc_id").alias("rep")), "classes")
    members = filled.select("doc_id", "n_shingles", "set_key").join(classes, ["n_shingles", "set_key"])
    of_class = materialise(members.select("doc_id", "rep").distinct(), "of-class")
    leaders = classes.withColumnRenamed("n_shingles", "size").withColumnRenamed("set_key", "own_key")
    same_set = (F.col("size") == F.col("n_shingles")) & (F.col("own_key") == F.col("set_key"))
    reps = filled.join(leaders, (F.col("doc_id") == F.col("rep")) & same_set).select("rep", "bands", "sketch")
    links = _links(reps.dropDuplicates(["rep", "bands"]), docs.select("doc_id", "text"), options)
    # A document is tied to its class, and to several classes where rows repeat its doc_id with different texts.
    tied = of_class.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionAll(tied))
    return signed.join(found, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _links(reps: DataFrame, texts: DataFrame, options: NearDedupOptions) -> DataFrame:
    """Confirmed links (a, b) that give the components of the representatives (rep, bands, sketch)."""
    banded = reps.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("total"), F.min("rep").alias("centre")).filter("total > 1")
    members = materialise(banded.join(materialise(shared, "shared"), "key"), "members")
    sketches = materialise(reps.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "sketch"), "sketches")

    # Each document with the centres with which it shares most keys.
    counted = members.filter("rep <> centre").groupBy("rep", "centre").agg(F.count(F.lit(1)).alias("n"))
    nearest = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("n"), "centre"))
    pairs = materialise(
        counted.withColumn("nth", nearest).filter(F.col("nth") <= options.centres).select(
            F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")
        ).distinct(),
        "pairs",
    )
    left = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("a_sketch"))
    right = sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("b_sketch"))
    near = _odd_bits("a_sketch", "b_sketch", options) <= most_odd_bits(options)
    likely = materialise(pairs.join(left, "a").join(right, "b").filter(near).select("a", "b"), "likely")
    sets = materialise(full_sets(texts, wanted_bits(sketches.select("rep")), options.width), "sets")
    links = materialise(confirm(likely, sets, options), "confirmed")

    # Keys whose documents lie in several components.
    found = components(links)
    placed = materialise(
        members.join(found, F.col("rep") == F.col("node"), "left").select(
            "key", "total", "rep", F.coalesce("component", "rep").alias("component")
        ),
        "placed",
    )
    parts = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_keys = materialise(parts.filter("low <> high").select("key"), "open")
    waiting = materialise(placed.join(open_keys, "key", "left_semi"), "waiting")
    few, many = waiting.filter(F.col("total") <= options.block), waiting.filter(F.col("total") > options.block)
    of = _clusters(many)
    rest = _links_of_small_keys(few, of, sketches, sets, options)
    return links.unionAll(rest).unionAll(_links_of_large_keys(of, sketches, sets, options))


def _clusters(waiting: DataFrame) -> DataFrame:
    """rep, cluster, component of the documents of large keys: keys that share documents form a cluster."""
    centre = materialise(waiting.groupBy("key").agg(F.min("rep").alias("centre")), "centres")
    spokes = waiting.join(centre, "key").filter("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b"))
    clusters = components(spokes.distinct()).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    return materialise(clusters.join(waiting.select("rep", "component").distinct(), "rep"), "clusters")


def _links_of_small_keys(
    waiting: DataFrame, clusters: DataFrame, sketches: DataFrame, sets: DataFrame, options: NearDedupOptions
) -> DataFrame:
    """All pairs of a key that lie in different components; a key has at most ``block`` documents here.

    Documents of one cluster are compared there, and not here again.
    """
    drawn = waiting.join(clusters.select("rep", "cluster"), "rep", "left").join(sketches, "rep")
    drawn = materialise(drawn.select("key", "rep", "component", "cluster", "sketch"), "small-keys")
    side = lambda s: drawn.select(
        "key", *[F.col(c).alias(f"{s}{n}") for c, n in (("rep", ""), ("component", "_part"), ("cluster", "_cluster"), ("sketch", "_sketch"))]
    )
    left, right = side("a"), side("b")
    near = _odd_bits("a_sketch", "b_sketch", options) <= most_odd_bits(options)
    met = F.coalesce(F.col("a_cluster") == F.col("b_cluster"), F.lit(False))
    apart = (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (F.col("a_part") != F.col("b_part")) & ~met & near
    likely = materialise(left.join(right, apart).select("a", "b").distinct(), "likely")
    return materialise(confirm(likely, sets, options), "confirmed")


def _links_of_large_keys(of: DataFrame, sketches: DataFrame, sets: DataFrame, options: NearDedupOptions) -> DataFrame:
    """Links between the components of clusters (rep, cluster, component).

    Every document outside the cluster's largest component is compared with
    every document of another component, in blocks of about ``block`` documents on either side: a task holds two
    blocks, and only links leave it, not pairs.
    """
    sizes = of.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("cluster").agg(
        F.max(F.struct("n", (-F.col("component")).alias("minus"))).alias("top"), F.sum("n").alias("total")
    )
    plan = largest.select(
        "cluster", (-F.col("top.minus")).alias("main"),
        F.ceil(F.col("total") / options.block).alias("blocks"),
        F.ceil((F.col("total") - F.col("top.n")) / options.block).alias("asking"),
    )
    full = materialise(of.join(plan, "cluster"), "planned").join(sets, "rep").join(sketches, "rep")
    full = materialise(full, "cluster-members").withColumn("outside", F.col("component") != F.col("main"))
    number = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "rep"), F.col(n))
    columns = ["rep", "component", "sketch", "set"]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asking = full.filter("outside").select("cluster", number(1, "asking").alias("x"), every("blocks").alias("y"), F.lit(True).alias("asks"), "outside", *columns)
    asked = full.filter("asking > 0").select("cluster", every("asking").alias("x"), number(2, "blocks").alias("y"), F.lit(False).alias("asks"), "outside", *columns)
    bits, percent = most_odd_bits(options), options.percent

    def compare(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        rep, part, outside = (table[c].to_numpy() for c in ("rep", "component", "outside"))
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table["set"]]
        drawn = np.array(table["sketch"].to_pylist(), dtype=np.int64).reshape(len(rep), -1).view(np.uint64)
        sizes = np.array([len(x) for x in sets])
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        out: list[tuple[int, int]] = []
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := joined.get(x, x)) != x:
                x = up
            return x

        for i in left:
            odd = np.bitwise_count(drawn[right] ^ drawn[i]).sum(axis=1)
            both_ask = outside[right] & (rep[right] >= rep[i])  # such a pair is met the other way round
            alike = 100 * np.minimum(sizes[right], sizes[i]) >= percent * np.maximum(sizes[right], sizes[i])
            for j in right[(odd <= bits) & (part[right] != part[i]) & ~both_ask & alike]:
                p, q = root(int(part[i])), root(int(part[j]))
                if p != q:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        out.append((int(rep[i]), int(rep[j])))
                        joined[max(p, q)] = min(p, q)
        a, b = (list(x) for x in zip(*out, strict=True)) if out else ([], [])
        return pa.table({"a": pa.array(a, type=pa.int64()), "b": pa.array(b, type=pa.int64())})

    return materialise(asking.unionByName(asked).groupBy("cluster", "x", "y").applyInArrow(compare, "a long, b long"), "confirmed")


def drop_near_copies(docs: DataFrame, options: NearDedupOptions = NearDedupOptions()) -> DataFrame:
    """The rows of docs that stay, with their own columns: one document of each component."""
    dropped = near_groups(docs, options).filter("NOT kept").select("doc_id")
    return wrapped(docs).join(dropped, F.col("row.doc_id") == F.col("doc_id"), "left_anti").select("row.*")
