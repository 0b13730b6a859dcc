"""Office files as segments: word-processing documents and presentations are ZIP archives of XML, which the standard library reads.

Files arrive as (path, content) of the binary-file source; parsing runs in Arrow batches. PDF pages need an optional package.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENTS = "array<struct<seq:int,kind:string,locator:int,heading_path:array<string>,text:string,pictures:array<string>>>"

#: Archives that unpack to more than this many bytes are refused.
MOST_BYTES = 256 << 20


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _parts(content: bytes, wanted: str) -> list[tuple[int, ElementTree.Element]]:
    """(number, root) of the parts whose names match, in the order of their numbers."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        if sum(i.file_size for i in archive.infolist()) > MOST_BYTES:
            raise ValueError("the archive is too large")
        found = [(int(m[1]) if m.groups() and m[1] else 0, name) for name in archive.namelist() if (m := re.fullmatch(wanted, name))]
        return [(n, ElementTree.fromstring(archive.read(name))) for n, name in sorted(found)]


def _text(node: ElementTree.Element) -> str:
    out = []
    for x in node.iter():
        kind = _local(x.tag)
        if kind == "t":
            out.append(x.text or "")
        elif kind in ("tab", "br"):
            out.append(" ")
    return "".join(out).strip()


def document_segments(content: bytes) -> list[tuple]:
    """Paragraphs and tables of a word-processing document, under the headings that stand above them."""
    out: list[tuple] = []
    stack: list[str] = []
    for _, root in _parts(content, r"word/document\.xml"):
        body = next(x for x in root.iter() if _local(x.tag) == "body")
        for block in body:
            kind = _local(block.tag)
            if kind == "tbl":
                lines = [" | ".join(_text(c) for c in row if _local(c.tag) == "tc") for row in block.iter() if _local(row.tag) == "tr"]
                text = "\n".join(lines)
            else:
                text = _text(block)
            style = next((v for x in block.iter() if _local(x.tag) == "pStyle" for k, v in x.attrib.items() if _local(k) == "val"), "")
            level = re.fullmatch(r"(?i)heading\s*([1-9])", style)
            if level and text:
                stack = [*stack[: int(level[1]) - 1], text]
            elif text:
                out.append((len(out), "table" if kind == "tbl" else "text", None, list(stack), text))
    return out


#: What stands before a chart's title and series (fixed values), and how many points of a series are told.
CHART_TITLE, CHART_SERIES, CHART_POINTS = "图表标题：", "数据系列 ", 30


class Slides:
    """A presentation's parts: slides in their order, with the notes, charts and pictures that their relations name."""

    def __init__(self, archive: zipfile.ZipFile):
        self.archive, self.names = archive, set(archive.namelist())

    def root(self, name: str) -> ElementTree.Element | None:
        return ElementTree.fromstring(self.archive.read(name)) if name in self.names else None

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """Id -> (kind, part) of what a part refers to inside the archive."""
        folder, name = part.rsplit("/", 1)
        rels = self.root(f"{folder}/_rels/{name}.rels")
        found = {}
        for x in rels if rels is not None else ():
            if x.get("TargetMode") != "External":
                target = x.get("Target", "")
                path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"{folder}/{target}")
                found[x.get("Id", "")] = (x.get("Type", "").rsplit("/", 1)[-1], path)
        return found

    def ordered(self) -> list[str]:
        """The slides as the presentation lists them; by their numbers where it doesn't."""
        main = self.root("ppt/presentation.xml")
        if main is not None:
            rels = self.relations("ppt/presentation.xml")
            ids = [next((v for k, v in x.attrib.items() if k.endswith("}id")), "") for x in main.iter() if _local(x.tag) == "sldId"]
            if listed := [rels[i][1] for i in ids if i in rels and rels[i][1] in self.names]:
                return listed
        numbered = [(int(m[1]), n) for n in self.names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))]
        return [n for _, n in sorted(numbered)]

    def notes(self, slide: str, rels: dict[str, tuple[str, str]]) -> str:
        part = next((p for kind, p in rels.values() if kind == "notesSlide"), slide.replace("slides/slide", "notesSlides/notesSlide"))
        root = self.root(part)
        return "" if root is None else _text(root)

    def chart(self, part: str) -> str:
        """A chart's title and, for each series, its name and first points."""
        root = self.root(part)
        lines = []
        for x in root.iter() if root is not None else ():
            if _local(x.tag) == "chart":
                lines += [CHART_TITLE + _text(t) for t in x if _local(t.tag) == "title" and _text(t)]
            elif _local(x.tag) == "ser":
                name = next((_value(t) for t in x if _local(t.tag) == "tx"), "")
                points = [_number(p) for v in x if _local(v.tag) == "val" for p in v.iter() if _local(p.tag) == "pt"]
                lines.append(f"{CHART_SERIES}{name}：{points[:CHART_POINTS]}")
        return "\n".join(lines)

    def blocks(self, node: ElementTree.Element, rels: dict[str, tuple[str, str]]) -> Iterator[tuple[str, list[str]]]:
        """(text, pictures) of the shapes below a node, in their order; groups are gone through."""
        for shape in node:
            kind = _local(shape.tag)
            if kind == "grpSp":
                yield from self.blocks(shape, rels)
                continue
            of = [v for x in shape.iter() for k, v in x.attrib.items() if _local(x.tag) in ("blip", "chart") and _local(k) in ("embed", "id")]
            parts = [rels[i] for i in of if i in rels]
            rows = [" | ".join(_text(c) for c in row if _local(c.tag) == "tc") for row in shape.iter() if _local(row.tag) == "tr"]
            lines = rows or [_text(p) for p in shape.iter() if _local(p.tag) == "p"]
            charts = [self.chart(path) for what, path in parts if what == "chart"]
            yield "\n".join(x for x in [*lines, *charts] if x), [path for what, path in parts if what == "image"]


def _value(node: ElementTree.Element) -> str:
    return next((x.text or "" for x in node.iter() if _local(x.tag) == "v"), "")


def _number(point: ElementTree.Element) -> float | None:
    try:
        return float(_value(point))
    except ValueError:
        return None


def slide_segments(content: bytes) -> list[tuple]:
    """Each slide's texts, tables and charts in their order, then its notes, with the pictures it shows; the heading is its first line."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        if sum(i.file_size for i in archive.infolist()) > MOST_BYTES:
            raise ValueError("the archive is too large")
        slides = Slides(archive)
        for n, part in enumerate(slides.ordered(), 1):
            root, rels = slides.root(part), slides.relations(part)
            tree = next((x for x in root.iter() if _local(x.tag) == "spTree"), None)
            found = list(slides.blocks(tree, rels)) if tree is not None else [("\n".join(t for p in root.iter() if _local(p.tag) == "p" and (t := _text(p))), [])]
            texts = [t for t, _ in found if t]
            text = "\n".join(x for x in [*texts, slides.notes(part, rels)] if x)
            pictures = [p for _, ps in found for p in ps]
            if text or pictures:
                out.append((len(out), "slide", n, [texts[0].splitlines()[0][:120]] if texts else [], text, pictures))
    return out


def page_segments(content: bytes) -> list[tuple]:
    try:
        from pypdf import PdfReader
    except ImportError as error:
        raise RuntimeError("reading PDF files needs the package pypdf") from error
    texts = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
    return [(i, "page", i + 1, [], t.strip()) for i, t in enumerate(texts)]


#: Pages with fewer characters are read by a recogniser (a fixed value).
SCANNED = 100


def page_route(text: Column) -> Column:
    """``recognise`` for a page whose text is too short to be all of it, else ``text``."""
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < SCANNED, "recognise").otherwise("text")


READERS = {"docx": document_segments, "pptx": slide_segments, "pdf": page_segments}


def office_segments(files: DataFrame) -> DataFrame:
    """path, error, seq, kind, locator, heading_path, text, pictures of files (path, content); a file that can't be read has one row with the
    error."""

    @F.pandas_udf(f"error string, segments {SEGMENTS}")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for paths, contents in batches:
            out = []
            for path, content in zip(paths, contents, strict=True):
                parse = READERS.get(path.rsplit(".", 1)[-1].lower())
                try:
                    if parse is None:
                        raise ValueError("no reader for this kind of file")
                    names = ("seq", "kind", "locator", "heading_path", "text", "pictures")
                    out.append((None, [dict(zip(names, s if len(s) == len(names) else (*s, []), strict=True)) for s in parse(content)]))
                except (ValueError, RuntimeError, KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError) as error:
                    out.append((f"{type(error).__name__}: {error}", []))
            yield pd.DataFrame(out, columns=["error", "segments"])

    parsed = files.select("path", read("path", "content").alias("r")).select("path", "r.error", F.explode_outer("r.segments").alias("s"))
    return parsed.select("path", "error", "s.*")
