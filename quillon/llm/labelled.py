"""Documents joined with their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labels up to this many rows (16 bytes each) are broadcast; beyond it the join shuffles. The result is the same.
BROADCAST_ROWS = 1_000_000


def with_labels(docs: DataFrame, labels: DataFrame, label: str, how: str = "inner") -> DataFrame:
    """docs with `__label` (0 or 1; how "left": null for rows without a label).

    Of several labels for a doc_id the largest counts, others than 0 and 1 don't.
    """
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("__labelled"))
        .agg(F.max(label).cast("int").alias("__label"))
    )
    if labels.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return docs.join(known, F.col("doc_id") == F.col("__labelled"), how).drop("__labelled")
