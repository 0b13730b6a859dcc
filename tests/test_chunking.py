"""Chunks of text against plain recounting, chunks of other media, and folds over long recordings."""

import random
import re

from quillon.operators import grouping


def tokens(text):
    words = re.findall("[A-Za-z0-9_]+|[㐀-鿿]", text)
    return max(1, len(words) + (len(text) - sum(map(len, words))) // 8) if text.strip() else 0


def slowly(text, target, most):
    """Every size counted anew from the text that it is of."""
    units = []
    for unit in re.split(r"(?<=[。！？.!?])\s+|\n{2,}", text.strip()):
        unit = unit.strip()
        while unit and tokens(unit) > most:
            n = max(i for i in range(1, len(unit) + 1) if tokens(unit[:i]) <= most)
            # What is left begins within a word perhaps: that part counts as a word, as the whole does.
            units.append(unit[:n].strip())
            unit = unit[n:].strip()
        if unit:
            units.append(unit)
    out = []
    for unit in units:
        if out and tokens("\n\n".join([*out[-1], unit])) <= target:
            out[-1].append(unit)
        else:
            out.append([unit])
    return ["\n\n".join(u) for u in out]


def test_pieces_are_those_of_plain_counting():
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice(["ab", "word9 ", " ", ". ", "漢字", "! ", "\n\n", "-+-", "é", "_x"]) for _ in range(r.randint(0, 150)))
        assert [p[0] for p in grouping.text_pieces(text, 20, 30)] == slowly(text, 20, 30), text


def test_offsets_point_at_the_text():
    text = "First one. Second one!\n\nThird part here. " + "long " * 60 + "end."
    pieces = grouping.text_pieces(text, 16, 24)
    assert pieces[0][1] == 0 and all(end - start == len(content) for content, start, end in pieces)
    assert all(text.find(c.split("\n\n")[0][:20], s) == s for c, s, _ in pieces[:2])


def test_long_texts_take_linear_time():
    for text in ("word " * 200_000, "x" * 1_000_000, "漢" * 300_000, ". " * 300_000):
        assert sum(len(c.split()) for c, _, _ in grouping.text_pieces(text)) >= 1


def test_sections_keep_the_stack_of_headings():
    text = "before\n# A\none\n### C\ntwo\n## B \nthree\n#no heading\n# Z\n"
    assert list(grouping.heading_sections(text, ["Top"])) == [
        (["Top"], "before", 0), (["A"], "one", 11), (["A", "C"], "two", 21), (["A", "B"], "three\n#no heading", 31),
    ]


SEGMENTS = "document_id string, media_type string, segment_id string, seq int, modality string, retrieval_text string, text string, heading_path array<string>, page int, slide int, section string, start double, end double, speaker string, quality string, asset string"


def test_each_medium_is_chunked_its_way(spark):
    rows = [
        ("p", "PDF", "s1", 1, "text", "one", "one", [], 1, None, None, None, None, None, "pass", None),
        ("p", "pdf", "s2", 2, "text", "two", "two", ["H"], 1, None, None, None, None, None, "pass", "a.png"),
        ("p", "pdf", "s3", 3, "text", "three", "three", [], None, None, "Part", None, None, None, "pass", None),
        ("i", "image", "s4", 1, "ocr", "seen", "seen", [], None, None, None, None, None, None, "pass", "b.png"),
        ("v", "video", "s5", 1, "speech", "hi\nSpeaker: A", "hi", [], None, None, None, 1.0, 2.0, "A", "pass", None),
        ("v", "video", "s6", 2, "speech", "you", "you", [], None, None, None, 20.0, 21.0, "A", "pass", None),
        ("t", None, "s7", 1, "text", "# H\nbody", "# H\nbody", [], None, None, None, None, None, None, "pass", None),
        ("t", "text", "s8", 2, "text", "", "", [], None, None, None, None, None, None, "pass", None),
    ]
    got = {(r.document_id, r.ordinal): r for r in grouping.media_chunks(spark.createDataFrame(rows, SEGMENTS)).collect()}
    assert {k: (r.content, r.heading_path, r.page_number, r.image_path) for k, r in got.items()} == {
        ("p", 0): ("one\n\ntwo", ["H"], 1, "a.png"), ("p", 1): ("three", ["Part"], None, None), ("i", 0): ("seen", [], None, "b.png"),
        ("v", 0): ("A：hi", [], None, None), ("v", 1): ("A：you", [], None, None), ("t", 0): ("body", ["H"], None, None),
    }
    assert got["p", 0].chunk_key == "page:1:section:-:members:s1,s2:part:0" and got["p", 1].chunk_key == "page:segment:s3:section:Part:members:s3:part:0"
    assert got["v", 1].chunk_key == "time:20.0:21.0:speaker:A:quality:pass:members:s6:group:1" and got["t", 0].text_start == 4
    assert grouping.media_chunks(spark.createDataFrame([], SEGMENTS)).count() == 0


def test_context_reaches_over_neighbours(spark):
    rows = [("r", i, float(i * 10), float(i * 10 + 5)) for i in range(30)]
    cored = grouping.core_groups(spark.createDataFrame(rows, "run string, seq int, start double, end double"), ["run"], 95.0)
    got = [(r.core_first, r.core_last, r.context_first, r.context_last) for r in grouping.correction_plan(cored, ["run"], reach=36.0).orderBy("ordinal").collect()]
    assert got == [(0, 9, 0, 13), (10, 19, 6, 23), (20, 29, 16, 29)]
