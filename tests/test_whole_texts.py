"""Registered queries read texts to their end."""

from quillon.plans import catalog


def test_external_queries_count_terms_of_the_whole_text(spark, tmp_path):
    rows = [(1, "x " * 150 + "zebra zebra", "en", "a", 311)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.load()["rul_09_external_queries"](spark, str(tmp_path)).collect()
    assert any(r["query"].startswith("ZEBRA") for r in found)
