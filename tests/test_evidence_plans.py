"""Queries on few rows for each question search once and leave the documents' texts where they lie."""

from quillon.operators import retrieval
from quillon.plans import search


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain("extended")
    return capsys.readouterr().out


def test_evidence_is_searched_for_once(spark, sf, capsys):
    found = search._evidence(spark, sf)
    shown = plan(found, capsys)
    assert "evidence_id" in shown and "Window" not in shown and "Join" not in shown


def test_texts_do_not_meet_vectors(spark, sf, capsys):
    chunks, vectors, asked = search._hybrid(spark, sf)
    assert "Join" not in plan(chunks, capsys) and "Join" not in plan(asked, capsys)
    assert set(vectors.columns) == {"chunk_id", "vector"} and vectors.join(chunks, "chunk_id", "left_anti").isEmpty()


def test_vectors_apart_answer_as_those_in_chunks(spark):
    rows = [(i, f"t{i % 3}", f"common word{i % 4}", [float(i % 5), 1.0] if i % 6 else None) for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id long, title string, content string, vector array<float>")
    queries = spark.createDataFrame([(1, "word1 t1", [1.0, 2.0]), (2, "common", [3.0, 1.0])], "query_id long, question string, vector array<float>")
    allowed = chunks.filter("chunk_id % 3 < 2").select("chunk_id")
    for some in (None, allowed):
        want = retrieval.hybrid_search(chunks, queries, allowed=some).drop("vector").collect()
        found = retrieval.hybrid_search(chunks.drop("vector"), queries, allowed=some, vectors=chunks.select("chunk_id", "vector")).collect()
        assert sorted(map(str, found)) == sorted(map(str, want)) and want
