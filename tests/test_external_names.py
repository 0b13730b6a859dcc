"""What external queries shuffle: of a run's words one row in a batch, of a glossary's terms one for a run."""

from quillon.operators import external, phrases


def test_names_of_a_run_are_one_row_each(spark):
    rows = [("r", i, "NASA met Bob, NASA left X1") for i in range(200)]
    found = external._mentions(spark.createDataFrame(rows, "run_id string, ordinal long, text string").coalesce(1)).collect()
    assert sorted((r.words, r.kind, r.ordinal, r.n) for r in found) == [("Bob", 0, 0, 200), ("NASA", 0, 0, 800), ("X1", 0, 0, 400)]


def test_held_terms_are_those_of_all_occurrences(spark):
    glossary = spark.createDataFrame([("abc", "A"), ("ABC", "B"), ("bc", "A"), ("straße", "S"), (" ", "N"), ("zz", None)], "variant string, canonical string")
    texts = spark.createDataFrame([(1, "xAbCx abc"), (1, "bc"), (2, "STRASSE straße"), (3, None), (4, "zz")], "id long, text string")
    every = phrases.find_phrases(texts, "id", "text", glossary).select("id", "canonical").distinct().collect()
    for shard in (1, 100):
        assert sorted(phrases.held_terms(texts, "id", "text", glossary, shard).collect()) == sorted(every)
