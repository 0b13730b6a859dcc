import io
import zipfile

from pyspark.sql import functions as F

from quillon.operators import transcripts
from quillon.sources import office, readers
from tests.test_operators import rows


def test_spans_apply_or_refuse(spark):
    texts = spark.createDataFrame([(1, "use spark sql"), (2, "use spark"), (3, "plain")], "id long, text string")
    spans = spark.createDataFrame([(1, 4, 9, "spark", "Spark"), (1, 10, 13, "sql", "SQL"), (2, 4, 9, "other", "X")], "id long, start long, end long, before string, after string")
    assert rows(transcripts.apply_spans(texts, spans), "id", "text", "refused") == [(1, "use Spark SQL", False), (2, "use spark", True), (3, "plain", False)]


def test_rejected_changes_roll_back_in_order(spark):
    paragraphs = spark.createDataFrame([(1, "the B then B and D")], "paragraph_id long, text string")
    changes = spark.createDataFrame([(1, 1, "A", "B", "rejected"), (1, 2, "C", "D", "rejected"), (1, 3, "x", "then", "accepted")], "paragraph_id long, ordinal long, before_text string, after_text string, status string")
    assert transcripts.roll_back(paragraphs, changes).first().text == "the A then B and C"


def test_uncertain_text(spark):
    df = spark.createDataFrame([(0.3,), (0.6,), (0.9,)], "c double").select(transcripts.mark_uncertain(F.lit("new"), F.lit("old"), F.col("c")).alias("t"))
    assert [r.t for r in df.collect()] == ["old [?]", "new [?]", "new"]


def test_resubmitted_runs_must_match(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert transcripts.changed_facts(stored, stored).count() == 0
    assert rows(transcripts.changed_facts(stored, stored.filter("k = 1").union(spark.createDataFrame([(2, "c")], stored.schema))), "k", "v", "side") == [(2, "b", "stored"), (2, "c", "resubmitted")]


def test_complex_layout(spark):
    flat = [("d", 1, f"line {i}", 0.0, 90.0, float(i), i + 0.9) for i in range(10)]
    two = [("d", 2, f"l{i}", 0.0, 40.0, float(i), i + 0.9) for i in range(5)] + [("d", 2, f"r{i}", 60.0, 100.0, i + 0.5, i + 1.4) for i in range(5)]
    sign = [("d", 3, "a ≤ b", 0.0, 9.0, 0.0, 1.0)]
    df = spark.createDataFrame(flat + two + sign, "document_id string, page int, text string, left double, right double, top double, bottom double")
    assert rows(transcripts.complex_layout(df), "page", "complex") == [(1, False), (2, True), (3, True)]


def test_office_files(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' if s else f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Top", "Heading1") + p("one") + p("Sub", "Heading2") + p("two") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl>"
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"

    def packed(parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in parts.items():
                z.writestr(name, text)
        return bytearray(out.getvalue())

    docx = packed({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>'})
    slide = lambda t: f'<s xmlns:a="{a}"><a:p><a:r><a:t>{t}</a:t></a:r></a:p></s>'
    pptx = packed({"ppt/slides/slide2.xml": slide("second"), "ppt/slides/slide1.xml": slide("first"), "ppt/notesSlides/notesSlide2.xml": slide("note")})
    files = spark.createDataFrame([("x.docx", docx), ("y.pptx", pptx), ("z.docx", bytearray(b"broken"))], "path string, content binary")
    got = office.office_segments(files).collect()
    assert [(r.heading_path, r.text) for r in got if r.path == "x.docx"] == [(["Top"], "one"), (["Top", "Sub"], "two"), (["Top", "Sub"], "a | b")]
    assert [(r.locator, r.text) for r in got if r.path == "y.pptx"] == [(1, "first"), (2, "second\nnote")]
    assert [r.error.split(":")[0] for r in got if r.path == "z.docx"] == ["BadZipFile"]


def test_transcripts_of_both_versions(spark):
    import json

    from quillon.sources import schemas

    new = {"source": {"sha256": "abc"}, "run": {"id": "r1"}, "segments": [{"id": "s", "ordinal": 0, "start_ms": 10, "end_ms": 20, "raw_text": "raw", "corrected_text": "fixed"}]}
    old = {"source": {"sha256": "0123456789abcdef"}, "segments": [{"start": 1.5, "end": 2.25, "text": "hello", "speaker": "A"}]}
    df = spark.createDataFrame([(json.dumps(x),) for x in (new, old)], "j string").select(F.from_json("j", schemas.TRANSCRIPT).alias("t")).select("t.*")
    got = rows(readers.transcript_segments(df), "run_id", "segment_id", "start_ms", "end_ms", "text")
    assert got == [("r1", "s", 10, 20, "fixed"), ("run-0123456789ab", "seg-00000", 1500, 2250, "hello")]
