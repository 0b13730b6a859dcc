"""Filters of documents, items and conversations as predicates and semi-joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SearchFilters:
    """Values of one field are alternatives; fields restrict each other."""

    media_types: tuple[str, ...] = ()
    collections: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    document_ids: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()
    since: str | None = None
    until: str | None = None


def in_folder(path: Column, folder: str) -> Column:
    """Below the folder, whatever the case of ASCII letters."""
    return F.lower(path).startswith(folder.rstrip("/").lower() + "/")


def filter_documents(documents: DataFrame, collections: DataFrame, tags: DataFrame, filters: SearchFilters) -> DataFrame:
    """Enabled documents that pass all filters; collections and tags are (document_id, name) bridges."""
    out = documents.filter("enabled")
    if filters.media_types:
        out = out.filter(F.col("media_type").isin(*filters.media_types))
    if filters.document_ids:
        out = out.filter(F.col("document_id").cast("string").isin(*filters.document_ids))
    if filters.folders:
        anywhere = F.lit(False)
        for folder in filters.folders:
            anywhere = anywhere | in_folder(F.col("path"), folder)
        out = out.filter(anywhere)
    if filters.since:
        out = out.filter(F.col("updated_at") >= filters.since)
    if filters.until:
        out = out.filter(F.col("updated_at") <= filters.until)
    for names, bridge in ((filters.collections, collections), (filters.tags, tags)):
        if names:
            out = out.join(bridge.filter(F.col("name").isin(*names)), "document_id", "left_semi")
    return out


def with_all_tags(items: DataFrame, tags: DataFrame, wanted: Sequence[str], key: str = "item_id") -> DataFrame:
    """Items that carry every tag."""
    if not wanted:
        return items
    found = tags.filter(F.col("name").isin(*wanted)).groupBy(key).agg(F.countDistinct("name").alias("n")).filter(F.col("n") == len(set(wanted)))
    return items.join(found, key, "left_semi")


def search_conversations(conversations: DataFrame, messages: DataFrame, text: str) -> DataFrame:
    """Conversations whose title, or one of whose messages, contains the text, whatever its case."""
    low = text.lower()
    titled = conversations.filter(F.lower("title").contains(low)).select("conv_id")
    said = messages.filter(F.lower("text").contains(low)).select("conv_id")
    return conversations.join(titled.unionAll(said).distinct(), "conv_id", "left_semi")


def belonging(rows: DataFrame, owners: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys together stand in owners."""
    return rows.join(owners.select(*keys), list(keys), "left_semi")


def folder_counts(documents: DataFrame, most: int = 30) -> DataFrame:
    """folder, n, newest of the folders with most documents (path, updated_at)."""
    folder = F.regexp_replace("path", "/[^/]*$", "").alias("folder")
    counted = documents.groupBy(folder).agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("newest"))
    return counted.orderBy(F.desc("n"), "folder").limit(most)


def bootstrap(documents: DataFrame, tags: DataFrame, top_tags: int = 40, recent: int = 12) -> DataFrame:
    """kind, name, n, rank of what a first screen shows: collections, most used tags, media types, folders, newest documents.

    documents: document_id, title, collection, media_type, path, updated_at; tags: document_id, name.
    """
    def counted(rows: DataFrame, kind: str, name: str, most: int | None) -> DataFrame:
        sums = rows.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
        ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "name")))
        return (ranked if most is None else ranked.filter(F.col("rank") <= most)).select("kind", "name", "n", "rank")

    newest = documents.orderBy(F.desc("updated_at"), "document_id").limit(recent)
    last = Window.partitionBy(F.lit(0)).orderBy(F.desc("updated_at"), "document_id")
    folders = folder_counts(documents).select(F.lit("folder").alias("kind"), F.col("folder").alias("name"), "n")
    placed = Window.partitionBy("kind").orderBy(F.desc("n"), "name")
    return (
        counted(documents, "collection", "collection", None).unionAll(counted(tags, "tag", "name", top_tags)).unionAll(counted(documents, "media_type", "media_type", None))
        .unionAll(folders.withColumn("rank", F.row_number().over(placed)))
        .unionAll(newest.select(F.lit("recent").alias("kind"), F.col("title").alias("name"), F.lit(1).cast("long").alias("n"), F.row_number().over(last).alias("rank")))
    )


def page(rows: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


def newest(rows: DataFrame, by: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """At most so many rows of each key, in order, with their rank: events, artifacts, annotations of one thing."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def matching(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns have the wanted values: one, or any of a list; None restricts nothing. Runs, jobs, edits and proposals
    are listed by such filters and ``page``."""
    for name, value in wanted.items():
        if isinstance(value, (list, tuple, set)):
            rows = rows.filter(F.col(name).isin(*value))
        elif value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows


def public_url(url: Column) -> Column:
    """http or https, without credentials, not at a private or local address."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/:?#@]+)(?:[:/?#]|$)", 1))
    private = host.rlike(r"^(?:localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|0\.|.*\.local$)")
    return (host != "") & ~private


def route(name: Column) -> Column:
    """Kind of a source by its suffix."""
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    kinds = {
        "pdf": ("pdf",), "presentation": ("ppt", "pptx"), "document": ("doc", "docx"), "image": ("png", "jpg", "jpeg", "webp", "gif"),
        "audio": ("mp3", "wav", "m4a", "flac"), "video": ("mp4", "mov", "mkv", "webm"), "text": ("md", "txt", "json", "csv"),
    }
    out = F.lit("web")
    for kind, suffixes in kinds.items():
        out = F.when(suffix.isin(*suffixes), kind).otherwise(out)
    return out
