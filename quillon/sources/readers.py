"""Sources as DataFrames: text and notes, bundles, web pages, subtitles, transcripts, folders, golden sets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import ids
from quillon.functions import moments as M
from quillon.functions import text as T
from quillon.sources import schemas

#: Suffixes that are read as text (fixed values).
TEXT_SUFFIXES = ("md", "markdown", "txt", "rst", "csv", "tsv", "json", "jsonl", "yaml", "yml", "log")


def text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, text of whole files."""
    return (
        spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True)
        .select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    )


def text_documents(files: DataFrame) -> DataFrame:
    """document_id, source_id, title, text, checksum of (path, text[, title])."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    source = ids.text_source_id(F.col("path"), F.col("text"))
    return files.select(
        ids.document_id(source).alias("document_id"), source.alias("source_id"),
        (F.coalesce("title", name) if "title" in files.columns else name).alias("title"), "text", ids.text_hash(F.col("text")).alias("checksum"),
    )


#: Attributes that describe content without text (fixed values).
DESCRIBING = ("objects", "scene", "chart", "table", "layout")


def structured_description(attributes: Column) -> Column:
    kept = F.map_filter(attributes, lambda k, v: k.isin(*DESCRIBING))
    return F.when(F.size(kept) > 0, F.to_json(kept)).otherwise("")


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """Segments of source bundles (nested JSON, schema 1.0), each with its source."""
    read = spark.read.schema(schemas.BUNDLE).option("multiLine", True).json(path)
    return bundle_segments(read)


def bundle_segments(read: DataFrame) -> DataFrame:
    good = read.filter("schema_version = '1.0'")
    sources = good.select("bundle_id", F.explode("sources").alias("s"))
    content = good.select("bundle_id", F.explode("content").alias("c"))
    text = F.coalesce(F.trim("c.text"), F.lit(""))
    described = F.coalesce(T.blank_to_null(F.col("c.description")), F.when(text == "", structured_description(F.col("c.attributes"))), F.lit(""))
    return (
        content.join(sources, (content.bundle_id == sources.bundle_id) & (F.col("c.source_id") == F.col("s.id")))
        .select(
            ids.document_id(F.col("s.id")).alias("document_id"), F.col("s.id").alias("source_id"), F.col("s.kind").alias("media_type"),
            F.col("s.title").alias("title"), F.col("c.id").alias("segment_id"), F.col("c.sequence").alias("seq"), F.col("c.modality").alias("modality"),
            text.alias("text"), described.alias("description"), F.col("c.location").alias("location"), F.col("c.speaker").alias("speaker"),
            F.col("s.metadata.collections").alias("collections"), F.col("s.metadata.tags").alias("tags"), F.col("s.origin.sha256").alias("checksum"),
        )
        .withColumn("retrieval_text", F.concat_ws("\n", T.blank_to_null(F.col("text")), T.blank_to_null(F.col("description")), F.concat(F.lit("Speaker: "), T.blank_to_null(F.col("speaker")))))
    )


# --- Web -------------------------------------------------------------------------------------------------------------

#: Elements whose text isn't content, that begin a line, and that have no end tag; names of a page's title (fixed values).
IGNORED = frozenset(("script", "style", "noscript", "svg"))
BLOCKS = frozenset(("p", "div", "section", "article", "h1", "h2", "h3", "li", "br"))
VOID = frozenset(("br", "img", "hr", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track"))
TITLES = frozenset(("og:title", "twitter:title"))


class _Tokens(HTMLParser):
    """A page as a list of (what, name or text, attributes); what: +1 opens an element, -1 closes one, 0 is text."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, str, dict[str, str | None]]] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.found.append((1, tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        self.found.append((-1, tag, {}))

    def handle_data(self, data: str) -> None:
        self.found.append((0, data, {}))


def readable(html: str | None, root: str | None = None) -> tuple[str, str]:
    """(title, text) of a page, or of the element with the id `root` in it.

    Running sums over the page's tokens give for each how many ignored elements hold it, whether a title does, and how deep it
    lies in the root; what is text and what a line break follows from these alone.
    """
    tokens = _Tokens(html or "").found
    hidden = titled = 0
    inside = 0 if root else 1
    lines: list[str] = []
    names: list[str] = []
    told = ""
    for what, name, attributes in tokens:
        if what == 0:
            if not hidden and (titled or inside > 0):
                (names if titled else lines).append(name)
            continue
        hidden = max(0, hidden + what * (name in IGNORED))
        titled = max(0, min(1, titled + what * (name == "title")))
        if root and name not in VOID and (inside or (what > 0 and attributes.get("id") == root)):
            inside += what
        if what > 0 and name in BLOCKS and inside > 0:
            lines.append("\n")
        if what > 0 and name == "meta" and attributes.get("property") in TITLES:
            told = attributes.get("content") or told
    text = re.sub(r"[ \t\r\f\v]+", " ", unescape(" ".join(lines)))
    return (told or "".join(names)).strip(), re.sub(r"\n\s*\n+", "\n\n", text).strip()


def web_pages(pages: DataFrame, root: str | None = None, least: int = 0) -> DataFrame:
    """page_id, url, title, text of (page_id, url, html); shorter texts than `least` are dropped. HTML needs a parser."""

    @F.pandas_udf("title string, text string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([readable(html, root) for html in batch], columns=["title", "text"])

    out = pages.select("page_id", "url", read("html").alias("page")).select("page_id", "url", "page.title", "page.text")
    return out.filter(F.length("text") >= least) if least else out


# --- Subtitles -------------------------------------------------------------------------------------------------------


def subtitle_cues(files: DataFrame, close: float = 0.25) -> DataFrame:
    """file_id, start, end, text of SRT and VTT texts (file_id, text); equal neighbours that touch are one cue."""
    clean = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), "^﻿", "")
    blocks = files.select("file_id", F.posexplode(F.split(clean, r"\n\s*\n")).alias("block_no", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    timing = F.get("lines", F.col("at"))
    stamp = lambda x: x.rlike(r"^(?:\d+:)?\d+:\d+[.,]?\d*$")
    words = F.array_join(F.slice("lines", F.col("at") + 2, F.greatest(F.size("lines") - F.col("at") - 1, F.lit(0))), "\n")
    raw = (
        blocks.withColumn("lines", lines)
        .filter((F.size("lines") > 0) & ~F.upper(F.get("lines", F.lit(0))).rlike("^(?:WEBVTT|NOTE|STYLE|REGION)"))
        .withColumn("at", F.array_position(F.transform(F.slice("lines", 1, 3), lambda x: x.contains("-->")), F.lit(True)).cast("int") - 1)
        .filter("at >= 0")
        .select("file_id", "block_no", F.trim(F.get(F.split(timing, "-->"), F.lit(0))).alias("a"), F.regexp_extract(F.get(F.split(timing, "-->"), F.lit(1)), r"^\s*(\S*)", 1).alias("z"), words.alias("text"))
        .filter(stamp(F.col("a")) & stamp(F.col("z")))
        .select("file_id", "block_no", M.parse_cue_time(F.col("a")).alias("start"), M.parse_cue_time(F.col("z")).alias("end"), F.trim(T.strip_tags(F.col("text"))).alias("text"))
    )
    w = Window.partitionBy("file_id").orderBy("block_no")
    same = (F.lag("text").over(w) == F.col("text")) & (F.col("start") <= F.lag("end").over(w) + close)
    return (
        raw.withColumn("opens", (~F.coalesce(same, F.lit(False))).cast("int"))
        .withColumn("cue", F.sum("opens").over(w))
        .groupBy("file_id", "cue")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("text").alias("text"))
        .drop("cue")
    )


# --- Notes, transcripts, folders, golden sets ------------------------------------------------------------------------


def notes(files: DataFrame) -> DataFrame:
    """note_id, relative, title, tags, body of Markdown notes (root, relative, text): front matter, then first heading, then name."""
    front = F.regexp_extract("text", r"^---\n(?s:(.*?))\n---(?:\n|$)", 1)
    field = lambda name: T.blank_to_null(F.trim(F.regexp_extract(front, rf"(?m)^{name}:[ \t]*(.*)$", 1), F.lit(" \"'")))
    heading = T.blank_to_null(F.regexp_extract("text", r"(?m)^#\s+(.+?)\s*$", 1))
    stem = F.regexp_extract("relative", r"([^/]+?)(?:\.[^./]*)?$", 1)
    tags = F.split(F.regexp_replace(F.coalesce(field("tags"), F.lit("")), r"[\[\]\"'#]", ""), r"[,\s]+")
    return files.select(
        ids.note_source_id(F.col("root"), F.col("relative")).alias("note_id"), "relative",
        F.coalesce(field("title"), heading, stem).alias("title"), F.filter(tags, lambda t: t != "").alias("tags"),
        F.regexp_replace("text", r"^---\n(?s:.*?)\n---(?:\n|$)", "").alias("body"),
    )


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    return transcript_segments(spark.read.schema(schemas.TRANSCRIPT).option("multiLine", True).json(path))


def transcript_segments(read: DataFrame) -> DataFrame:
    """run_id, segment_id, ordinal, start_ms, end_ms, speaker_id, text, confidence, flags; older files, whose times are seconds, are
    upgraded on the way."""
    at = lambda ms, s: F.coalesce(F.col(ms), F.round(F.col(s) * 1000).cast("long"))
    run = F.coalesce("run.id", F.concat(F.lit("run-"), F.substring(F.coalesce("source.sha256", F.lit("")), 1, 12)))
    return read.select(run.alias("run_id"), F.posexplode("segments").alias("pos", "s")).select(
        "run_id", F.coalesce("s.id", F.format_string("seg-%05d", "pos")).alias("segment_id"), F.coalesce("s.ordinal", "pos").alias("ordinal"),
        at("s.start_ms", "s.start").alias("start_ms"), at("s.end_ms", "s.end").alias("end_ms"), F.coalesce("s.speaker_id", "s.speaker").alias("speaker_id"),
        F.coalesce(T.blank_to_null(F.col("s.corrected_text")), "s.raw_text", "s.text", F.lit("")).alias("text"), "s.confidence",
        F.coalesce("s.flags", F.array().cast("array<string>")).alias("flags"),
    )


#: What a vault walk leaves out, and the suffixes of notes (fixed values).
VAULT_EXCLUDED = (".git", ".obsidian", ".trash", "_assets")
VAULT_EXCLUDED_PREFIX = "10_Knowledge/AI Answers/"
NOTE_SUFFIXES = ("md", "markdown")


def vault_notes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, errors) of a vault's files (root, relative, resolved): notes in its visible folders; an error for each note that a link
    leads outside the vault."""
    parts = F.split("relative", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    name = F.element_at(parts, -1)
    hidden = F.exists(folders, lambda x: x.isin(*VAULT_EXCLUDED) | x.startswith(".")) | name.startswith(".") | F.col("relative").startswith(VAULT_EXCLUDED_PREFIX)
    wanted = files.filter(~hidden & F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)).isin(*NOTE_SUFFIXES))
    inside = F.col("resolved").startswith(F.concat(F.rtrim("root", F.lit("/")), F.lit("/")))
    return wanted.filter(inside), wanted.filter(~inside).select("root", "relative")


def ocr_lines(payloads: DataFrame) -> DataFrame:
    """document_id, page, line_no, text, confidence, box of recognisers' JSON (document_id, page, payload).

    An object holds lists of texts, scores and boxes; a list holds (box, text, confidence) or (box, text) for each line, and may itself
    stand first in a list with the time taken. Blank texts are left out; a score that is no finite number is null.
    """
    listed = F.from_json("payload", "txts array<string>, scores array<double>, boxes array<string>")
    rows = F.from_json("payload", "array<array<string>>")
    nested = F.from_json(F.get_json_object("payload", "$[0]"), "array<array<string>>")
    from_object = F.transform(
        listed["txts"], lambda t, i: F.struct(t.alias("text"), F.get(listed["scores"], i).alias("confidence"), F.get(listed["boxes"], i).alias("box"))
    )
    each = lambda items: F.transform(
        F.filter(items, lambda x: F.size(x) >= 2),
        lambda x: F.struct(F.get(x, F.lit(1)).alias("text"), F.get(x, F.lit(2)).try_cast("double").alias("confidence"), F.get(x, F.lit(0)).alias("box")),
    )
    # In a nested list the second element of the first item is a line, not a text.
    within = F.get_json_object("payload", "$[0][0][1]").isNotNull() & ~F.coalesce(F.get_json_object("payload", "$[0][1]").rlike(r"^[^\[]"), F.lit(False))
    lines = F.when(listed["txts"].isNotNull(), from_object).when(within, each(nested)).otherwise(each(rows))
    score = F.col("x.confidence")
    return payloads.select("document_id", "page", F.posexplode(lines).alias("line_no", "x")).select(
        "document_id", "page", "line_no", F.trim("x.text").alias("text"), F.when(~F.isnan(score) & (F.abs(score) < float("inf")), F.round(score, 3)).alias("confidence"), F.col("x.box").alias("box"),
    ).filter("text <> ''")


def folder_state(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """relative, size, mtime of files, from their metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("relative"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"))


def golden_cases(read: DataFrame) -> DataFrame:
    """case_id, query, relevant ids and citation targets; a case without targets has one of all that is relevant."""
    case = F.posexplode("cases").alias("pos", "c")
    own = F.array(F.struct(F.lit("target-1").alias("target_id"), F.col("c.relevant_chunk_ids").alias("chunk_ids"), F.col("c.relevant_document_ids").alias("document_ids")))
    return read.select("name", case).select(
        "name", F.coalesce("c.id", F.format_string("case-%d", F.col("pos") + 1)).alias("case_id"), F.col("c.query").alias("query"),
        F.col("c.relevant_document_ids").alias("document_ids"), F.col("c.relevant_chunk_ids").alias("chunk_ids"),
        F.when(F.size(F.coalesce("c.citation_targets", F.array().cast("array<struct<target_id:string,chunk_ids:array<string>,document_ids:array<string>>>"))) > 0, F.col("c.citation_targets")).otherwise(own).alias("targets"),
    )


def package_manifests(spark: SparkSession, path: str) -> DataFrame:
    """package_id, title, updated_at, path of the manifests below a folder, the newest first."""
    read = spark.read.schema("package_id string, title string, updated_at string").option("multiLine", True).json(f"{path}/*/manifest.json")
    return read.withColumn("path", F.input_file_name()).orderBy(F.desc("updated_at"), "package_id")


#: Which reader takes a file, by suffix (fixed values); other files are text.
READERS = {"vtt": "subtitles", "srt": "subtitles", "html": "web", "htm": "web", "md": "notes", "markdown": "notes"}


def load_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """document_id, title, media_type, text of the files below a folder, each read as its suffix says."""
    files = text_files(spark, path, glob)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    reader = F.lit("text")
    for name, kind in READERS.items():
        reader = F.when(suffix == name, kind).otherwise(reader)
    files = files.withColumn("reader", reader)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    plain = files.filter("reader = 'text'").select("path", name.alias("title"), F.lit("text").alias("media_type"), "text")
    pages = web_pages(files.filter("reader = 'web'").select(F.col("path").alias("page_id"), F.col("path").alias("url"), F.col("text").alias("html")))
    pages = pages.select(F.col("url").alias("path"), F.coalesce(T.blank_to_null(F.col("title")), F.regexp_extract("url", r"([^/]+?)(?:\.[^./]*)?$", 1)).alias("title"), F.lit("web").alias("media_type"), "text")
    written = notes(files.filter("reader = 'notes'").select(F.lit(path).alias("root"), F.col("path").alias("relative"), "text"))
    written = written.select(F.col("relative").alias("path"), "title", F.lit("text").alias("media_type"), F.col("body").alias("text"))
    cues = subtitle_cues(files.filter("reader = 'subtitles'").select(F.col("path").alias("file_id"), "text")).groupBy("file_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "\n").alias("text")
    )
    cues = cues.select(F.col("file_id").alias("path"), F.regexp_extract("file_id", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("title"), F.lit("transcript").alias("media_type"), "text")
    rows = plain.unionByName(pages).unionByName(written).unionByName(cues)
    return rows.select(ids.document_id(ids.file_source_id(F.col("path"))).alias("document_id"), "title", "media_type", "text", "path")


#: Signs of a page that asks for a proof instead of showing its content (fixed values).
CHALLENGES = ("captcha", "verify you are human", "access denied", "环境异常", "完成验证")


def decoded_pages(raw: DataFrame) -> DataFrame:
    """page_id, url, html of downloads (page_id, url, content, content_type): decoded by the charset that the header or the page names, at
    most 15 MB; pages that are a challenge are left out."""
    named = F.lower(F.regexp_extract(F.coalesce("content_type", F.lit("")), r"(?i)charset=[\"']?([A-Za-z0-9_-]+)", 1))
    head = F.decode(F.substring("content", 1, 2048), "ISO-8859-1")
    inside = F.lower(F.regexp_extract(head, r"(?i)charset=[\"']?([A-Za-z0-9_-]+)", 1))
    charset = F.coalesce(T.blank_to_null(named), T.blank_to_null(inside), F.lit("utf-8"))
    known = {"iso-8859-1": "ISO-8859-1", "latin-1": "ISO-8859-1", "windows-1252": "ISO-8859-1", "us-ascii": "US-ASCII", "utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE"}
    html = F.try_validate_utf8(F.col("content").cast("string"))
    for name, charset_name in known.items():
        html = F.when(charset == name, F.decode("content", charset_name)).otherwise(html)
    rows = raw.filter(F.octet_length("content") <= 15 << 20).select("page_id", "url", F.coalesce(html, F.decode("content", "ISO-8859-1")).alias("html"))
    asks = F.lit(False)
    for sign in CHALLENGES:
        asks = asks | F.lower("html").contains(sign)
    return rows.filter(~(asks & (F.length("html") < 20_000)))


def packages(files: DataFrame) -> DataFrame:
    """package_id, stem, members of files that belong together by their normalised name."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    stem = F.regexp_replace(T.fold(name), r"[\s_-]*(?:transcript|subtitles?|slides?|notes?|audio|video)?[\s_-]*$", "")
    return (
        files.groupBy(stem.alias("stem"))
        .agg(F.sort_array(F.collect_set("path")).alias("members"))
        .filter(F.size("members") > 1)
        .withColumn("package_id", ids.package_id(F.col("stem")))
    )
