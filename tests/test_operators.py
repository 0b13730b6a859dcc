import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import filters, graph, grouping, incremental, intervals, qa, retrieval, rules
from quillon.sources import readers, sinks
from quillon.streaming import jobs


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# --- Retrieval -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(
        [
            ("c1", "Lidar notes", "point cloud mapping with lidar odometry", [1.0, 0.0]),
            ("c2", "Cooking", "soup with onions and salt", [0.0, 1.0]),
            ("c3", "Lidar", "lidar lidar lidar", [0.9, 0.1]),
            ("c4", "", "FAST-LIVO2 is a fast livo2 system", [0.5, 0.5]),
        ],
        "chunk_id string, title string, content string, vector array<double>",
    )


def test_bm25_matches_its_formula(spark, corpus):
    queries = spark.createDataFrame([(1, "onions")], "query_id int, question string")
    got = retrieval.bm25(corpus, queries).first()
    n, k = 4, [8, 6, 4, 7]
    idf = math.log((n - 1 + 0.5) / 1.5)
    want = idf * 1.0 * 2.2 / (1.0 + 1.2 * (0.25 + 0.75 * k[1] / (sum(k) / 4)))
    assert got.chunk_id == "c2" and got.keyword_score == pytest.approx(want, abs=1e-8)


def test_no_shared_terms_gives_nothing(spark, corpus):
    queries = spark.createDataFrame([(1, "zebra quantum", [0.0, 0.0])], "query_id int, question string, vector array<double>")
    assert retrieval.hybrid_search(corpus, queries).count() == 0


def test_phrases_need_neighbours(spark, corpus):
    phrases = spark.createDataFrame([(1, "FAST-LIVO2"), (2, "lidar odometry"), (3, "cloud lidar")], "query_id int, phrase string")
    assert rows(retrieval.phrase_hits(corpus, phrases), "query_id", "chunk_id", "n") == [(1, "c4", 2), (2, "c1", 1)]


def test_fusion_ignores_the_order_of_rows(spark, corpus):
    queries = spark.createDataFrame([(1, "lidar mapping", [1.0, 0.0])], "query_id int, question string, vector array<double>")
    fused = lambda c: rows(retrieval.fuse(retrieval.bm25(c, queries), retrieval.vector_top(c, queries)), "chunk_id", "fused_rank", "fused_score")
    assert fused(corpus) == fused(corpus.orderBy(F.desc("chunk_id")))
    assert fused(corpus)[0][2] == pytest.approx(1 / 61 + 1 / 61) or fused(corpus)[0][2] == pytest.approx(1 / 61 + 1 / 62)


def test_relevance_cut_kinds(spark):
    scored = spark.createDataFrame(
        [(1, "a", 0.9, 0.5, 0.5), (1, "b", 0.3, 0.4, 0.1), (1, "c", 0.1, 0.3, 0.2)],
        "query_id int, chunk_id string, rerank_score double, fused_score double, lexical_overlap double",
    )
    cut = lambda **k: [r[0] for r in rows(retrieval.cut_relevant(scored, **k), "chunk_id")]
    assert cut() == ["a"] and cut(reranker="api") == ["a"] and cut(reranker="none") == ["a", "b", "c"]
    none = scored.withColumn("lexical_overlap", F.lit(0.0))
    assert retrieval.cut_relevant(none).count() == 0
    assert rows(retrieval.cut_relevant(none, semantic=True), "chunk_id") == [("a",)]


def test_filters_conjoin(spark):
    docs = spark.createDataFrame(
        [(1, "pdf", "/Lib/A/x.pdf", "2024-01-02", True), (2, "video", "/lib/b/y.mp4", "2024-02-02", True), (3, "pdf", "/lib/a/z.pdf", "2024-01-09", False)],
        "document_id int, media_type string, path string, updated_at string, enabled boolean",
    )
    facets = spark.createDataFrame([(1, "A"), (2, "B")], "document_id int, name string")
    tags = spark.createDataFrame([(1, "x"), (2, "y")], "document_id int, name string")
    pick = lambda **k: [r[0] for r in rows(filters.filter_documents(docs, facets, tags, filters.SearchFilters(**k)), "document_id")]
    assert pick(collections=("B",), tags=("y",), media_types=("video",)) == [2]
    assert pick(collections=("A",), tags=("y",)) == [] and pick(folders=("/lib/a/",)) == [1] and pick(until="2024-01-31") == [1]
    both = spark.createDataFrame([(1, "x"), (1, "z"), (2, "x")], "item_id int, name string")
    assert rows(filters.with_all_tags(both.select("item_id").distinct(), both, ["x", "z"]), "item_id") == [(1,)]


# --- Answers ---------------------------------------------------------------------------------------------------------


def test_coverage_of_claims(spark):
    answers = spark.createDataFrame([(1, "It maps rooms well. It is very fast [S1]."), (2, "All is said here [S1].")], "query_id int, markdown string")
    evidence = spark.createDataFrame([(1, "S1", "d1", True), (1, "S2", "d1", False), (2, "S1", "d1", False)], "query_id int, evidence_id string, identity string, instruction_risk boolean")
    got = rows(qa.evidence_quality(answers, evidence), "query_id", "coverage", "utilization", "diversity", "level", "n_risks")
    assert got == [(1, 0.5, 0.5, 0.5, "partially_supported", 1), (2, 1.0, 1.0, 1.0, "well_supported", 0)]


def test_golden_metrics(spark):
    results = spark.createDataFrame([("a", 1, "x"), ("b", 3, "y"), ("b", 1, "n"), ("c", 1, "n")], "case_id string, rank int, id string")
    relevant = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "case_id string, id string")
    cited = spark.createDataFrame([("a", "S1", "x"), ("b", "S1", "n")], "case_id string, citation_id string, id string")
    targets = relevant.withColumn("target_id", F.lit("t"))
    got = qa.golden_metrics(results, relevant, cited, targets).first()
    assert (got.hit_rate, got.mrr, got.citation_precision, got.citation_coverage) == (0.666667, round((1 + 1 / 3) / 3, 6), 0.5, 0.333333)


def test_spread_takes_twelve_of_many(spark):
    chunks = spark.createDataFrame([("d", i, f"c{i:02}", i in (3, 4)) for i in range(36)], "document_id string, ordinal int, chunk_id string, focused boolean")
    got = [r[0] for r in rows(qa.spread(chunks), "ordinal")]
    want = sorted({3, 4} | set(sorted(round(i * 35 / 11) for i in range(12) if round(i * 35 / 11) not in (3, 4))[:10]))
    assert len(got) == 12 and got == want


# --- Intervals and grouping ------------------------------------------------------------------------------------------


def test_speakers_of_words(spark):
    words = spark.createDataFrame([("r", 1, 0.0, 2.0), ("r", 2, 4.0, 6.0), ("r", 3, 9.0, 9.5), ("r", 4, 1.0, 1.0)], "run string, word_id int, start double, end double")
    turns = spark.createDataFrame([("r", "a", 0.0, 1.2), ("r", "b", 1.2, 5.0), ("r", "c", 5.0, 7.0), ("r", "d", 4.0, 4.5)], "run string, speaker string, r_start double, r_end double")
    got = rows(intervals.assign_speakers(words, turns, ["run"], 2.0), "word_id", "speaker", "overlapping")
    assert got == [(1, "a", False), (2, "b", True), (3, "speaker_unknown", False), (4, "a", False)]


@pytest.mark.parametrize("width", [0.7, 3.0, 50.0])
def test_overlap_join_is_brute_force(spark, width):
    r = random.Random(5)
    span = lambda: (lambda a: (a, a + round(r.random() * 6, 2)))(round(r.random() * 40, 2))
    left, right = [("k", i, *span()) for i in range(40)], [("k", i, *span()) for i in range(40)]
    a = spark.createDataFrame(left, "k string, i int, start double, end double")
    b = spark.createDataFrame(right, "k string, j int, r_start double, r_end double")
    want = sorted((i, j) for _, i, s, e in left for _, j, p, q in right if min(e, q) - max(s, p) > 0 or (s == e and p <= s < q))
    assert rows(intervals.overlap_join(a, b, ["k"], width), "i", "j") == want


def test_cues_break_on_speaker_pause_and_sentence(spark):
    words = [("r", 0, 0.0, 0.4, "a", "hello"), ("r", 1, 0.5, 0.9, "a", "world."), ("r", 2, 1.0, 1.2, "a", "next"), ("r", 3, 2.5, 2.8, "a", "late"), ("r", 4, 2.9, 3.0, "b", "other")]
    df = spark.createDataFrame(words, "run string, seq int, start double, end double, speaker string, text string")
    assert rows(grouping.cue_groups(df, ["run"]), "seq", "group_no") == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3)]


def test_temporal_chunks_by_speaker_and_quality(spark):
    segments = [("r", 1.0, 10.0, 20.0, "A", "speech", "pass", "", "one"), ("r", 2.0, 20.0, 28.0, "B", "speech", "pass", "", "two"), ("r", 3.0, 28.0, 30.0, "B", "speech", "review", "", "three"),
                ("r", 4.0, 30.0, 31.0, "B", "frame", "review", "", "four"), ("r", 5.0, 45.0, 46.0, "B", "frame", "review", "", "five")]
    df = spark.createDataFrame(segments, "run string, seq double, start double, end double, speaker string, modality string, quality string, section string, text string")
    got = rows(grouping.temporal_chunks(grouping.temporal_groups(df, ["run"]), ["run"]), "group_no", "start", "end", "content")
    assert got == [(0, 10.0, 20.0, "A：one"), (1, 20.0, 28.0, "B：two"), (2, 28.0, 30.0, "B：three"), (3, 30.0, 31.0, "B：four"), (4, 45.0, 46.0, "B：five")]


def test_text_chunks_cover_the_input(spark):
    text = " ".join(f"word{i}" for i in range(1500)) + ". Short end. " + "x" * 9000
    got = grouping.text_chunks(spark.createDataFrame([("d", text), ("e", None)], "document_id string, text string")).orderBy("ordinal").collect()
    assert all(r.token_count <= 480 for r in got) and {r.document_id for r in got} == {"d"}
    assert "".join(r.content for r in got).replace("\n", "").replace(" ", "") == text.replace(" ", "")


def test_heading_paths(spark):
    df = spark.createDataFrame([("d", "# H1\nbody one\n## H2\nbody two\n# H3\nthree")], "document_id string, text string")
    assert [(r.heading_path, r.body) for r in grouping.heading_blocks(df).orderBy("block_no").collect()] == [(["H1"], "body one"), (["H1", "H2"], "body two"), (["H3"], "three")]


def test_voice_spans_bridge_and_pad(spark):
    loud = [0] * 20 + [900] * 10 + [0] * 5 + [900] * 10 + [0] * 60 + [900] * 3 + [0] * 20
    df = spark.createDataFrame([("r", i, float(e)) for i, e in enumerate(loud)], "run string, n int, energy double")
    got = intervals.voice_spans(df, ["run"]).collect()
    assert [(round(r.start, 2), round(r.end, 2)) for r in got] == [(0.42, 1.53)]


# --- Graph, rules, incremental ---------------------------------------------------------------------------------------


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("s", "a", "supports"), ("a", "b", "extends"), ("b", "c", "supports"), ("c", "a", "supports"), ("x", "y", "contradicts")], "source_id string, target_id string, relation_type string")
    items = spark.createDataFrame([("s", "source"), ("a", "topic")], "item_id string, item_type string")
    assert rows(graph.sourced_items(items, edges), "item_id") == [("a",), ("b",), ("c",)]
    assert ("a", "a") in rows(graph.ancestors(edges), "item_id", "ancestor_id")


def test_private_findings_and_boundaries(spark):
    key = "AKIA" + "A1" * 8
    files = spark.createDataFrame([("a.txt", f"line\nkey {key}\n{key} again"), ("b.txt", f"x{key}y and Z{key}"), ("c.txt", "clean")], "path string, text string")
    assert rows(rules.private_findings(files), "path", "category", "n", "lines") == [("a.txt", "aws_access_key", 2, [2, 3]), ("b.txt", "aws_access_key", 1, [1])]
    assert rows(rules.share_status(files, rules.private_findings(files)), "path", "status") == [("a.txt", "blocked"), ("b.txt", "blocked"), ("c.txt", "clean")]
    name = spark.createDataFrame([(".env.local",), ("id_rsa",), ("api-keys.json",), ("notes.md",)], "n string")
    assert [r[0] for r in name.select(rules.secret_name(F.col("n"))).collect()] == [True, True, True, False]


def test_merge_keeps_where_null(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "k int, v string, w string")
    b = spark.createDataFrame([(2, None, None), (3, "z", "r")], "k int, v string, w string")
    assert rows(incremental.merge(a, b, ["k"], ["v"]), "k", "v", "w") == [(1, "x", "p"), (2, "y", None), (3, "z", "r")]


def test_admission(spark):
    old = spark.createDataFrame([("s1", "f1", "h1", 1), ("s2", "", "h2", 2)], "source_id string, checksum string, content_hash string, seq int")
    new = spark.createDataFrame([("s1", "f1", "h1", 1), ("s2", "", "h9", 2), ("s3", "f1", "h3", 3), ("s4", "", "h2", 4), ("s5", "", "h5", 5), ("s6", "", "h5", 6)], old.schema)
    assert rows(incremental.admit(new, old), "source_id", "status", "duplicate_of") == [
        ("s1", "unchanged", None), ("s2", "updated", None), ("s3", "duplicate", "s1"), ("s4", "duplicate", "s2"), ("s5", "created", None), ("s6", "duplicate", "s5"),
    ]


# --- Sources, sinks, streams -----------------------------------------------------------------------------------------


def test_bundle_segments(spark):
    from quillon.sources import schemas

    import json

    bundle = {"schema_version": "1.0", "bundle_id": "b", "sources": [{"id": "p", "kind": "pdf", "title": "P", "metadata": {"collections": ["A"], "tags": ["x"]}}],
              "content": [{"id": "c1", "source_id": "p", "sequence": 1, "modality": "page", "text": "hello", "speaker": "Ann", "location": {"page": 3}},
                          {"id": "c2", "source_id": "p", "sequence": 2, "modality": "image", "text": "", "attributes": {"chart": "bar", "other": "n"}}]}
    df = spark.createDataFrame([(json.dumps(bundle),)], "j string").select(F.from_json("j", schemas.BUNDLE).alias("b")).select("b.*")
    got = readers.bundle_segments(df).orderBy("seq").collect()
    assert got[0].retrieval_text == "hello\nSpeaker: Ann" and got[0].location.page == 3 and got[1].description == '{"chart":"bar"}'


def test_subtitles_round_trip(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,000\n<i>Hello</i>\n\n2\n00:00:02,100 --> 00:00:03,000\nHello\n\nNOTE x\n\n3\n00:00:05,000 --> 00:00:06,500\nBye\nnow"
    got = readers.subtitle_cues(spark.createDataFrame([(1, srt)], "file_id int, text string"))
    assert rows(got, "start", "end", "text") == [(1.0, 3.0, "Hello"), (5.0, 6.5, "Bye\nnow")]
    segments = got.select("file_id", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("start")).alias("ordinal"),
                          (F.col("start") * 1000).alias("start_ms"), (F.col("end") * 1000).alias("end_ms"), "text")
    again = readers.subtitle_cues(sinks.subtitles(segments, ["file_id"], "vtt").select("file_id", F.col("subtitles").alias("text")))
    assert rows(again, "start", "end", "text") == rows(got, "start", "end", "text")


def test_pages_and_notes(spark):
    html = "<html><head><title>T &amp; t</title><script>x()</script></head><body><p>One</p><div id='m'>Two<br>three</div><svg>no</svg></body></html>"
    assert readers.readable(html) == ("T & t", "One \n Two \n three")
    assert readers.readable(html, "m")[1] == "Two \n three"
    note = "---\ntitle: \"Named\"\ntags: [a, b]\n---\n# Head\nbody"
    df = spark.createDataFrame([("/r", "d/n.md", note), ("/r", "d/m.md", "# Head\nx"), ("/r", "d/k.md", "x")], "root string, relative string, text string")
    assert rows(readers.notes(df), "relative", "title", "tags") == [("d/k.md", "k", []), ("d/m.md", "Head", []), ("d/n.md", "Named", ["a", "b"])]


def test_versions_swap_as_one(spark, tmp_path):
    root = str(tmp_path / "index")
    sinks.commit_version({"a": spark.range(3), "b": spark.range(1)}, root)
    sinks.commit_version({"a": spark.range(5), "b": spark.range(2)}, root)
    assert sinks.read_version(spark, root, "a").count() == 5 and sinks.read_version(spark, root, "b").count() == 2


def test_folder_stream_feeds_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("one\ntwo")
    got: list = []

    def run():
        stream = jobs.watch_folder(spark, str(tmp_path / "in"), "*.md")
        jobs.ingest(stream, str(tmp_path / "state"), lambda df, n: got.extend(r.text for r in df.collect())).awaitTermination()

    run()
    (tmp_path / "in/b.md").write_text("three")
    run()
    assert got == ["one\ntwo", "three"]


def test_job_stream_is_idempotent(spark, tmp_path):
    (tmp_path / "e").mkdir()
    lines = ['{"job_id":"j","ordinal":1,"status":"running","percent":10,"event_ts":"2024-01-01T00:00:00Z"}', '{"job_id":"j","ordinal":1,"status":"completed","percent":100,"event_ts":"2024-01-01T00:01:00Z"}']
    (tmp_path / "e/1.json").write_text("\n".join(lines))
    (tmp_path / "e/2.json").write_text("\n".join(lines))
    states = jobs.item_states(jobs.progress_events(spark, str(tmp_path / "e")))
    q = states.writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(jobs.job_states(spark.table("states")), "job_id", "n_items", "completed", "status") == [("j", 1, 1, "completed")]
