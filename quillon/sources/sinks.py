"""What leaves the engine: subtitles, transcripts, wiki pages, conversations, manifests, versioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import moments as M
from quillon.functions import text as T
from quillon.sources.commits import CommitLog


def _in_order(rows: DataFrame, by: list[str], order: str, line: Column, joiner: str, name: str) -> DataFrame:
    """by, name: lines joined in order."""
    lines = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), joiner).alias(name))


def subtitles(segments: DataFrame, by: list[str], style: str = "srt") -> DataFrame:
    """by, subtitles of segments (by, ordinal, start_ms, end_ms, text)."""
    mark = "," if style == "srt" else "."
    cue = F.concat(M.cue_time(F.col("start_ms"), mark), F.lit(" --> "), M.cue_time(F.col("end_ms"), mark), F.lit("\n"), F.col("text"))
    line = F.concat(F.col("ordinal") + 1, F.lit("\n"), cue) if style == "srt" else cue
    out = _in_order(segments, by, "ordinal", line, "\n\n", "subtitles")
    return out if style == "srt" else out.withColumn("subtitles", F.concat(F.lit("WEBVTT\n\n"), "subtitles"))


def transcript_markdown(segments: DataFrame, by: list[str]) -> DataFrame:
    who = F.coalesce(T.blank_to_null(F.col("speaker_id")), F.lit("speaker_unknown"))
    line = F.concat(F.lit("**["), M.clock(F.col("start_ms") / 1000), F.lit("] "), who, F.lit("** "), F.col("text"))
    return _in_order(segments, by, "ordinal", line, "\n\n", "markdown")


def transcript_text(segments: DataFrame, by: list[str]) -> DataFrame:
    """by, text: a line for each segment, with its speaker where one is known."""
    who = T.blank_to_null(F.col("speaker_id"))
    return _in_order(segments, by, "ordinal", F.concat_ws(": ", who, "text"), "\n", "text")


def transcript_json(segments: DataFrame, by: list[str]) -> DataFrame:
    """by, json: the segments as an array, in order."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "start_ms", "end_ms", "speaker_id", "text")))
    return segments.groupBy(*by).agg(F.to_json(rows).alias("json"))


def conversation_markdown(messages: DataFrame) -> DataFrame:
    line = F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), F.trim("text"))
    return _in_order(messages, ["conv_id"], "turn", line, "\n\n", "markdown")


#: Headings and labels of a correction's export (fixed values).
CORRECTION = {
    "title": " 深度精校稿", "speakers": "## 说话人", "speaker_table": "| 匿名 ID | 显示名称 | 名称来源 |\n|---|---|---|", "no_speaker": "| — | 未进行说话人区分 | — |", "unnamed": "未确认",
    "terms": "## 术语校正表", "term_table": "| 原文 | 建议/校订 | 状态 | 理由 |\n|---|---|---|---|", "no_term": "| — | — | 无术语校正记录 | — |",
    "body": "## 完整精校正文", "no_body": "无可导出的精校正文。", "audit": "## 审计摘要",
    "counts": ("- 修改建议总数：", "- 待审核：", "- 已接受：", "- 已拒绝：", "- 状态审计事件：", "- 导出正文段落："),
}


def correction_markdown(runs: DataFrame, speakers: DataFrame, paragraphs: DataFrame, changes: DataFrame, counts: DataFrame) -> DataFrame:
    """run_id, markdown of corrected transcripts.

    runs: run_id, name; speakers: run_id, speaker_id, display_name, name_source; paragraphs: run_id, ordinal, speaker_id, start_ms,
    end_ms, text (with rejected changes undone); changes: run_id, ordinal, change_type, before_text, after_text, status, reason;
    counts: as ``audit_counts`` gives them.
    """
    c = CORRECTION
    cell = lambda x: F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\|", r"\\|"), r"\s*\n\s*", " ")
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(x) for x in cells]), F.lit(" |"))
    named = F.coalesce(T.blank_to_null(F.col("display_name")), F.lit(c["unnamed"]))
    people = _in_order(speakers, ["run_id"], "speaker_id", row(F.col("speaker_id"), named, F.col("name_source")), "\n", "people")
    terms = changes.filter("change_type = 'terminology'")
    terms = _in_order(terms, ["run_id"], "ordinal", row(*[F.col(x) for x in ("before_text", "after_text", "status", "reason")]), "\n", "terms")
    who = F.coalesce(T.blank_to_null(F.col("display_name")), "speaker_id", F.lit("speaker_unknown"))
    spoken = paragraphs.join(speakers.select("run_id", "speaker_id", "display_name"), ["run_id", "speaker_id"], "left")
    head = F.concat(F.lit("### ["), M.clock(F.col("start_ms") / 1000), F.lit(" → "), M.clock(F.col("end_ms") / 1000), F.lit("] "), who)
    body = _in_order(spoken, ["run_id"], "ordinal", F.concat(head, F.lit("\n\n"), T.escape_markdown(F.col("text"))), "\n\n", "body")
    n = paragraphs.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_paragraphs"))
    out = runs.select("run_id", "name")
    for part in (people, terms, body, n, counts):
        out = out.join(part, "run_id", "left")
    sums = ("n_changes", "proposed", "accepted", "rejected", "n_events", "n_paragraphs")
    audit = F.concat_ws("\n", *[F.concat(F.lit(label), F.coalesce(F.col(x), F.lit(0)).cast("string")) for label, x in zip(c["counts"], sums, strict=True)])
    table = lambda heading, empty, rows: F.concat(F.lit(heading + "\n"), F.coalesce(F.col(rows), F.lit(empty)))
    return out.select("run_id", F.concat_ws(
        "\n\n", F.concat(F.lit("# "), T.escape_markdown(F.col("name")), F.lit(c["title"])), F.lit(c["speakers"]), table(c["speaker_table"], c["no_speaker"], "people"),
        F.lit(c["terms"]), table(c["term_table"], c["no_term"], "terms"), F.lit(c["body"]), F.coalesce("body", F.lit(c["no_body"])), F.lit(c["audit"]), audit,
    ).alias("markdown"))


def wiki_pages(items: DataFrame, relations: DataFrame) -> DataFrame:
    """item_id, page: front matter, title, summary, body and links."""
    link = F.concat(F.lit("- "), "relation_type", F.lit(": [["), "target_id", F.lit("]]"))
    links = relations.groupBy(F.col("source_id").alias("item_id")).agg(F.array_join(F.sort_array(F.collect_list(link)), "\n").alias("links"))
    front = F.concat(
        F.lit("---\nid: "), "item_id", F.lit("\ntype: "), "item_type", F.lit("\nstatus: "), "status", F.lit("\ntags: ["),
        F.array_join(F.sort_array("tags"), ", "), F.lit("]\n---"),
    )
    return items.join(links, "item_id", "left").select(
        "item_id", F.concat_ws("\n\n", front, F.concat(F.lit("# "), "title"), T.blank_to_null(F.col("summary")), T.blank_to_null(F.col("body")), "links").alias("page")
    )


def wiki_index(items: DataFrame, by: str) -> DataFrame:
    """One index page for each value of a column."""
    return _in_order(items, [by], "title", F.concat(F.lit("- [["), "item_id", F.lit("|"), "title", F.lit("]]")), "\n", "page")


def wiki_lint(pages: DataFrame) -> DataFrame:
    """item_id, code, detail: pages without front matter, with broken links, without any link to or from them."""
    links = pages.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all("page", F.lit(r"\[\[([^\]|#]+)"), 1))).alias("target"))
    bare = pages.filter(~F.col("page").startswith("---\n")).select("item_id", F.lit("missing_front_matter").alias("code"), F.lit(None).cast("string").alias("detail"))
    known = pages.select(F.col("item_id").alias("target"))
    broken = links.join(known, "target", "left_anti").select("item_id", F.lit("broken_link").alias("code"), F.col("target").alias("detail"))
    linked = links.select("item_id").union(links.select("target")).distinct()
    orphan = pages.join(linked, "item_id", "left_anti").select("item_id", F.lit("orphan_page").alias("code"), F.lit(None).cast("string").alias("detail"))
    return bare.unionByName(broken).unionByName(orphan)


def manifest(files: DataFrame) -> DataFrame:
    """path, size, sha256 of files (path, content)."""
    return files.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest_errors(expected: DataFrame, found: DataFrame) -> DataFrame:
    """path, error: what is missing, unexpected or different."""
    a = expected.select("path", F.col("sha256").alias("wanted"))
    error = F.when(F.col("sha256").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("sha256") != F.col("wanted"), "different")
    return a.join(found.select("path", "sha256"), "path", "full_outer").select("path", error.alias("error")).filter("error IS NOT NULL")


def checkpoint_identity(files: DataFrame, configuration: dict[str, str]) -> DataFrame:
    """One row: identity of a checkpoint, from what its files (path, sha256) hold and from the configuration, whatever their order."""
    settings = "\n".join(f"{k}={v}" for k, v in sorted(configuration.items()))
    # Sums of the parts of each file's digest don't depend on an order, so any number of tasks makes them and none holds all files.
    own = F.sha2(F.concat_ws("=", "path", "sha256"), 256)
    lanes = [F.sum(F.conv(F.substring(own, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"lane{i}") for i in range(4)]
    sums = files.agg(F.count(F.lit(1)).cast("string").alias("n"), *lanes)
    return sums.select(F.sha2(F.concat_ws("\x00", "n", *(F.coalesce(f"lane{i}", F.lit("0")) for i in range(4)), F.lit(settings)), 256).alias("identity"))


def commit_version(tables: dict[str, DataFrame], root: str) -> int:
    """Put tables in force as one version; of two writers that began with the same one, the second is refused."""
    transaction = CommitLog(next(iter(tables.values())).sparkSession, root).begin()
    for name, rows in tables.items():
        transaction.replace(name, rows)
    return transaction.commit("version")


def roll_back_version(spark: SparkSession, root: str) -> int:
    """Put the version before the current one in force again; its files were never changed."""
    log = CommitLog(spark, root)
    current = log.state().version
    if current < 2:
        raise ValueError("there is no earlier version")
    return log.roll_back(current - 1)


def read_version(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the version that was committed last."""
    return CommitLog(spark, root).read(name)
