"""Presentations read from their own XML: order, charts, tables, pictures and notes."""

import io
import zipfile

from quillon.sources import office

A, C = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/chart"
P, R = "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
SPACES = f'xmlns:a="{A}" xmlns:c="{C}" xmlns:p="{P}" xmlns:r="{R}"'


def paragraphs(*lines):
    return "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in lines)


def shape(*lines):
    return f"<p:sp><p:txBody>{paragraphs(*lines)}</p:txBody></p:sp>"


def slide(*shapes):
    return f"<p:sld {SPACES}><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:sld>"


def rels(**targets):
    rows = "".join(f'<Relationship Id="{i}" Type="{R}/{kind}" Target="{target}"/>' for i, (kind, target) in targets.items())
    return f"<Relationships>{rows}</Relationships>"


def chart(points):
    values = "".join(f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>' for i, v in enumerate(points))
    series = f"<c:ser><c:tx><c:strRef><c:strCache><c:pt><c:v>Sales</c:v></c:pt></c:strCache></c:strRef></c:tx><c:val><c:numRef><c:numCache>{values}</c:numCache></c:numRef></c:val></c:ser>"
    return f"<c:chartSpace {SPACES}><c:chart><c:title>{paragraphs('By year')}</c:title><c:plotArea><c:barChart>{series}</c:barChart></c:plotArea></c:chart></c:chartSpace>"


def presentation():
    table = "".join(f"<a:tr>{''.join(f'<a:tc>{paragraphs(x)}</a:tc>' for x in row)}</a:tr>" for row in (("a", "b"), ("c", "d")))
    picture = '<p:pic><p:blipFill><a:blip r:embed="r2"/></p:blipFill></p:pic>'
    parts = {
        "ppt/presentation.xml": f'<p:presentation {SPACES}><p:sldIdLst><p:sldId id="1" r:id="s2"/><p:sldId id="2" r:id="s1"/><p:sldId id="3" r:id="s3"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(s1=("slide", "slides/slide1.xml"), s2=("slide", "slides/slide2.xml"), s3=("slide", "/ppt/slides/slide3.xml")),
        "ppt/slides/slide1.xml": slide(shape("Title", "more"), '<p:graphicFrame><c:chart r:id="r1"/></p:graphicFrame>', f"<p:grpSp>{shape('in a group')}{picture}</p:grpSp>"),
        "ppt/slides/_rels/slide1.xml.rels": rels(r1=("chart", "../charts/chart7.xml"), r2=("image", "../media/image1.png"), r3=("notesSlide", "../notesSlides/notesSlide9.xml")),
        "ppt/slides/slide2.xml": slide(f"<p:graphicFrame><a:tbl>{table}</a:tbl></p:graphicFrame>"),
        "ppt/slides/slide3.xml": slide(),
        "ppt/charts/chart7.xml": chart([*range(40), "x"]),
        "ppt/notesSlides/notesSlide9.xml": slide(shape("say this")),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return bytearray(out.getvalue())


def test_slides_in_order_with_all_they_show(spark):
    files = spark.createDataFrame([("deck.pptx", presentation())], "path string, content binary")
    one, two = office.office_segments(files).orderBy("seq").collect()
    assert (one.locator, one.text, one.heading_path, one.pictures) == (1, "a | b\nc | d", ["a | b"], [])
    points = [float(i) for i in range(30)]
    assert two.text == f"Title\nmore\n图表标题：By year\n数据系列 Sales：{points}\nin a group\nsay this"
    assert (two.locator, two.heading_path, two.pictures, two.error) == (2, ["Title"], ["ppt/media/image1.png"], None)


def test_short_pages_go_to_the_recogniser(spark):
    pages = spark.createDataFrame([(1, "x" * 99), (2, "x" * 100), (3, None), (4, " " * 200)], "n int, text string")
    got = {r.n: r.route for r in pages.select("n", office.page_route(pages.text).alias("route")).collect()}
    assert got == {1: "recognise", 2: "text", 3: "recognise", 4: "recognise"}
