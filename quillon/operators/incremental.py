"""Change detection, incremental indexing, merging and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import prefix


def classify(old: DataFrame, new: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """keys, status: created, deleted, updated or unchanged, by null-safe comparison."""
    a = old.select(*keys, F.struct(*compare).alias("__old"))
    b = new.select(*keys, F.struct(*compare).alias("__new"))
    status = (
        F.when(F.col("__old").isNull(), "created")
        .when(F.col("__new").isNull(), "deleted")
        .when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged")
        .otherwise("updated")
    )
    return a.join(b, list(keys), "full_outer").select(*keys, status.alias("status"))


def folder_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """relative, status of files (relative, size, mtime): changed (new ones, too), removed or unchanged."""
    found = classify(old, new, ["relative"], ["size", "mtime"])
    names = F.when(F.col("status") == "deleted", "removed").when(F.col("status") == "unchanged", "unchanged").otherwise("changed")
    return found.select("relative", names.alias("status"))


def same_state(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], scalars: Sequence[str], facets: Sequence[str]) -> DataFrame:
    """keys, same: whether all scalars are equal, nulls included, and all facets (arrays) hold the same values in any order."""
    plain = lambda df: df.select(*keys, *scalars, *[F.array_sort(F.array_distinct(F.coalesce(F.col(f), F.array().cast("array<string>")))).alias(f) for f in facets])
    found = classify(plain(stored), plain(incoming), keys, [*scalars, *facets])
    return found.select(*keys, (F.col("status") == "unchanged").alias("same"))


def vault_plan(stored: DataFrame, scanned: DataFrame, errors: DataFrame) -> DataFrame:
    """relative, action of notes (relative, content_hash): create, update, keep or delete. After a scan with errors nothing is deleted: what it
    didn't see may still be there."""
    broken = errors.agg((F.count(F.lit(1)) > 0).alias("broken"))
    found = classify(stored, scanned, ["relative"], ["content_hash"]).crossJoin(broken)
    action = (
        F.when(F.col("status") == "deleted", F.when(F.col("broken"), "keep").otherwise("delete")).when(F.col("status") == "created", "create")
        .when(F.col("status") == "updated", "update").otherwise("keep")
    )
    return found.select("relative", action.alias("action"))


def index_report(changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts by status; created and updated chunks need embedding."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    counts = {"created": n("created"), "updated": n("updated"), "unchanged": n("unchanged"), "deleted": n("deleted"), "embedded": n("created", "updated")}
    return changes.groupBy(*by).agg(*[v.alias(k) for k, v in counts.items()])


def merge(target: DataFrame, updates: DataFrame, keys: Sequence[str], keep_if_null: Sequence[str] = ()) -> DataFrame:
    """target with updates by key: new rows are added, values replaced; null doesn't replace where named."""
    names = target.columns
    rest = [c for c in names if c not in keys]
    a = target.select(*keys, F.struct(*rest).alias("__old"))
    b = updates.select(*keys, F.struct(*rest).alias("__new"))
    chosen = [
        (F.coalesce(F.col(f"__new.{c}"), F.col(f"__old.{c}")) if c in keep_if_null else F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}"))).alias(c)
        for c in rest
    ]
    return a.join(b, list(keys), "full_outer").select(*keys, *chosen).select(*names)


def admit(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming (source_id, checksum, content_hash, seq) with status and duplicate_of against existing.

    A known source is unchanged or updated. A new one is a duplicate if its checksum, else its content, is known, also from
    an earlier incoming row; else it is created.
    """
    known = existing.select("source_id", F.col("content_hash").alias("known_hash"))
    by_checksum = existing.filter(F.coalesce("checksum", F.lit("")) != "").groupBy("checksum").agg(F.min_by("source_id", "seq").alias("same_file"))
    by_content = existing.groupBy("content_hash").agg(F.min_by("source_id", "seq").alias("same_text"))
    first = Window.partitionBy("content_hash").orderBy("seq")
    twin = F.first("source_id").over(first)
    rows = (
        incoming.join(known, "source_id", "left")
        .join(by_checksum, "checksum", "left")
        .join(by_content, "content_hash", "left")
        .withColumn("twin", F.when(F.row_number().over(first) > 1, twin))
    )
    other = F.coalesce("same_file", "same_text", "twin")
    status = (
        F.when(F.col("known_hash") == F.col("content_hash"), "unchanged")
        .when(F.col("known_hash").isNotNull(), "updated")
        .when(other.isNotNull(), "duplicate")
        .otherwise("created")
    )
    return rows.select("source_id", status.alias("status"), F.when(status == "duplicate", other).alias("duplicate_of"))


def duplicate_groups(documents: DataFrame) -> DataFrame:
    """key, n, ids of documents that share a checksum or, without one, their content."""
    key = F.coalesce(F.when(F.col("checksum") != "", F.col("checksum")), F.col("content_hash"))
    return (
        documents.groupBy(key.alias("key"))
        .agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("document_id")), lambda x: x.cast("string")), ",").alias("ids"))
        .filter("n > 1")
    )


def first_wins(rows: DataFrame, key: Column, order: Sequence[Column | str], last: bool = False) -> DataFrame:
    """One row for each key: the first, or the last, in order."""
    by = [F.desc(o) if last and isinstance(o, str) else o for o in order]
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*by))).filter("__n = 1").drop("__n")


def latest(events: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """by, value of each key's latest event: states are recomputed, never counted up, so replays change nothing."""
    return events.groupBy(*by).agg(F.max_by(value, order).alias(value))


def job_status(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, mean progress and status of jobs from their items (status, percent)."""
    n = lambda s: F.count_if(F.col("status") == s)
    return (
        items.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n_items"), n("completed").alias("completed"), n("failed").alias("failed"), n("cancelled").alias("cancelled"),
            F.count_if(F.col("status").isin("queued", "running")).alias("open"), F.bround(F.avg("percent")).cast("long").alias("percent"),
        )
        .withColumn(
            "status",
            F.when(F.col("open") > 0, "running").when(F.col("failed") > 0, "failed").when(F.col("cancelled") > 0, "cancelled").otherwise("completed"),
        )
    )


def import_summary(items: DataFrame, by: Sequence[str], status: Column) -> DataFrame:
    """succeeded, failed, cancelled of imports, by the status of their items."""
    n = lambda s: F.count_if(status == s).alias(s)
    return items.groupBy(*by).agg(n("succeeded"), n("failed"), n("cancelled"))


def merge_metadata(old: Column, new: Column, allowed: Sequence[str]) -> Column:
    """Two maps as one: a key's newer value wins where it isn't null, and only allowed keys stay."""
    both = F.map_zip_with(old, new, lambda k, a, b: F.coalesce(b, a))
    return F.map_filter(both, lambda k, v: k.isin(*allowed))


def missing(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of left without a partner."""
    return left.join(right.select(*keys), list(keys), "left_anti")


def next_ordinals(new: DataFrame, existing: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """new with ordinals that continue each key's; a key's rows are numbered in ranges, however many they are."""
    last = existing.groupBy(*by).agg(F.max("ordinal").alias("__last"))
    blocks = prefix.dealt(new, [*by, *order], label="ordinals")
    numbered = prefix.running_totals(blocks, list(by), list(order), {"__number": F.lit(1).cast("long")}).drop(prefix.BLOCK)
    return numbered.join(last, list(by), "left").withColumn("ordinal", F.coalesce("__last", F.lit(0)) + F.col("__number")).drop("__last", "__number")


def size_cap(files: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """files and the total of their sizes in order up to each, itself included, and whether that fits; a null size counts as 0.

    The order runs over all files: ranges of it are summed by themselves, and each begins with the sum of those before it.
    """
    blocks = prefix.dealt(files, list(order), label="files")
    return prefix.running_totals(blocks, [], list(order), {"total": F.col("size").cast("long")}).drop(prefix.BLOCK).withColumn("fits", F.col("total") <= most)
