"""Folders of mixed files, downloads, manifests, versions, and the kept index."""

import json

from quillon.functions import ids
from quillon.operators.index import LiveIndex, TextIndex
from quillon.sources import readers, sinks


def test_files_are_read_as_their_suffix_says(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain words")
    (tmp_path / "b.md").write_text("---\ntitle: Noted\n---\nbody")
    (tmp_path / "c.html").write_text("<html><title>Page</title><body><p>seen</p><script>no</script></body></html>")
    (tmp_path / "d.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nspoken\n\n00:03.000 --> 00:04.000\nwords")
    got = {r.path.rsplit("/", 1)[1]: (r.title, r.media_type, r.text) for r in readers.load_documents(spark, str(tmp_path)).collect()}
    assert got == {
        "a.txt": ("a", "text", "plain words"), "b.md": ("Noted", "text", "body"), "c.html": ("Page", "web", "seen"), "d.vtt": ("d", "transcript", "spoken\nwords"),
    }


def test_downloads_are_decoded_and_challenges_left_out(spark):
    rows = [
        (1, "u", "é ü".encode(), "text/html; charset=UTF-8"), (2, "u", "é".encode("latin-1"), "text/html; charset=ISO-8859-1"), (3, "u", b"<p>Verify you are human</p>", None),
        (4, "u", '<meta charset="windows-1252">é'.encode("latin-1"), None), (5, "u", b"\xff\xfe broken", None),
    ]
    got = {r.page_id: r.html for r in readers.decoded_pages(spark.createDataFrame(rows, "page_id int, url string, content binary, content_type string")).collect()}
    assert set(got) == {1, 2, 4, 5} and got[1] == "é ü" and got[2] == "é" and got[4].endswith("é")


def test_manifests_newest_first(spark, tmp_path):
    for name, at in (("x", "2024-01-01"), ("y", "2024-02-01")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(json.dumps({"package_id": name, "title": name, "updated_at": at}))
    assert [r.package_id for r in readers.package_manifests(spark, str(tmp_path)).collect()] == ["y", "x"]


def test_versions_are_numbered_and_rolled_back(spark, tmp_path):
    root = str(tmp_path)
    for n in (1, 2):
        sinks.commit_version({"t": spark.range(n)}, root)
    assert sinks.read_version(spark, root, "t").count() == 2
    sinks.roll_back_version(spark, root)
    assert sinks.read_version(spark, root, "t").count() == 1


def test_a_maintained_index_is_that_of_its_chunks(spark, tmp_path):
    def chunks(rows):
        df = spark.createDataFrame(rows, "chunk_id string, title string, content string")
        return df.withColumn("content_hash", ids.text_hash(df["content"]))

    def terms(index):
        return sorted((r.term, r.chunk_id, r.n_terms, r.in_title, r.in_content) for r in index.postings().collect())

    index = TextIndex(spark, str(tmp_path / "i"))
    assert index.postings().count() == 0 and index.statistics().first().n_chunks == 0
    index.sync(chunks([("a", "One", "alpha beta alpha"), ("b", None, "beta"), ("c", "Three", None)]))
    after = chunks([("a", "One", "alpha gamma"), ("b", None, "beta"), ("d", "", "Ünïcode delta")])
    found = {(r.chunk_id, r.state) for r in index.sync(after).collect()}
    assert found == {("a", "changed"), ("c", "orphan"), ("d", "missing")} and index.compare(after).count() == 0
    assert terms(index) == terms(LiveIndex(after)) and ("unicode", "d", 2, [], [0]) in terms(index)
    assert index.statistics().first() == LiveIndex(after).statistics().first()
    assert terms(index.compacted(str(tmp_path / "j"))) == terms(index)
