"""Running totals and values carried forward over rows that no single task could hold.

Rows lie in blocks. A block's own running values need its rows only; what it begins with comes from one row for each
block before it. So a key's rows may be as many as they like: a window over a key sees its blocks, never its rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.storage import written

BLOCK = "__block"


def dealt(rows: DataFrame, order: list[str], parts: int | None = None, label: str = "dealt") -> DataFrame:
    """rows with ``__block``, the number of the range of `order` that they fall into; written once, so that the ranges hold.

    Rows that are equal in `order` share a block: it should name rows one by one.
    """
    count = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(count, *order).withColumn(BLOCK, F.spark_partition_id()), label)


def _join(rows: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of `before` for their keys, which may be null."""
    renamed = before.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys]
    return rows.join(renamed, same, "left").drop(*(f"__of_{k}" for k in keys))


def _before(sums: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """What stands before each block: totals of the earlier blocks of its key."""
    if by:
        earlier = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        return sums.select(*by, BLOCK, *[F.sum(n).over(earlier).alias(f"__{n}") for n in names])
    rows = sorted(sums.collect(), key=lambda r: r[BLOCK])  # a row for each block, of which there are as many as partitions
    totals = [list(accumulate((r[n] or 0 for r in rows), initial=0)) for n in names]
    values = [(r[BLOCK], *(t[i] for t in totals)) for i, r in enumerate(rows)]
    fields = ", ".join(f"__{n} {sums.schema[n].dataType.simpleString()}" for n in names)
    return F.broadcast(sums.sparkSession.createDataFrame(values, f"{BLOCK} int, {fields}"))


def running_totals(blocks: DataFrame, by: list[str], order: list[str], totals: dict[str, Column]) -> DataFrame:
    """blocks (with ``__block``) and, for each name, the total of its column over a key's rows up to each row, itself included.

    Within a key, blocks follow one another in `order`; nulls count as 0.
    """
    names = list(totals)
    valued = blocks.withColumns({f"__v_{n}": F.coalesce(c, F.lit(0)) for n, c in totals.items()})
    sums = valued.groupBy(*by, BLOCK).agg(*[F.sum(f"__v_{n}").alias(n) for n in names])
    within = Window.partitionBy(*by, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = valued.withColumns({n: F.sum(f"__v_{n}").over(within) for n in names}).drop(*(f"__v_{n}" for n in names))
    added = _join(inside, _before(sums, by, names), [*by, BLOCK])
    return added.withColumns({n: F.col(n) + F.coalesce(f"__{n}", F.lit(0)) for n in names}).drop(*(f"__{n}" for n in names))


def carried(blocks: DataFrame, by: list[str], order: list[str], name: str, value: Column) -> DataFrame:
    """blocks and the last value that isn't null of a key's rows before each row."""
    valued = blocks.withColumn("__value", value)
    # Rows without a value have no place in the order, so the greatest place is the last value's.
    last = valued.groupBy(*by, BLOCK).agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(*order))).alias("__last"))
    earlier = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    held = last.select(*by, BLOCK, F.last("__last", ignorenulls=True).over(earlier).alias("__held"))
    within = Window.partitionBy(*by, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = valued.withColumn(name, F.last("__value", ignorenulls=True).over(within)).drop("__value")
    return _join(inside, held, [*by, BLOCK]).withColumn(name, F.coalesce(name, "__held")).drop("__held")


def order_statistics(rows: DataFrame, by: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """by, rank, value: the values of these ranks (by, rank from 1; ascending) of a key's rows.

    A histogram of whole numbers names the bin that holds a rank, a histogram of its 4,096th parts the next, and only values of
    that one are told apart; equal values count as one row.
    """
    number = F.col(value).cast("double")
    first, second = F.floor(number), F.floor((number - F.floor(number)) * 4096)
    known = rows.filter(number.isNotNull()).select(*by, first.alias("__a"), second.alias("__b"), number.alias("__c"))
    asked = ranks.select(*by, F.col("rank").alias("rank"), F.col("rank").cast("long").alias("__left"))
    keys = list(by)
    for level in ("__a", "__b", "__c"):
        counts = known.groupBy(*keys, level).agg(F.count(F.lit(1)).alias("__n"))
        upto = Window.partitionBy(*keys).orderBy(level)
        bins = counts.withColumn("__upto", F.sum("__n").over(upto))
        asked = asked.join(bins, keys).filter((F.col("__left") > F.col("__upto") - F.col("__n")) & (F.col("__left") <= F.col("__upto")))
        asked = asked.withColumn("__left", F.col("__left") - (F.col("__upto") - F.col("__n"))).drop("__n", "__upto")
        keys.append(level)
        known = known.join(asked.select(*keys).distinct(), keys, "left_semi")
    return asked.select(*by, "rank", F.col("__c").alias(value))
