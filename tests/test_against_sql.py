"""Queries on small tables of odd values against their SQL."""

import duckdb
import pytest

from quillon.operators import upkeep
from quillon.plans import catalog

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def differing(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    found = catalog.load()[name](spark, str(folder))
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        expected = connection.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found.collect()), key=order) == sorted(expected, key=order)
    return len(expected)


def test_numbers_that_repeat_themselves_are_no_finding(spark, tmp_path):
    rows = [(121212, 8), (1111111, 8), (41 * 5, 9)]
    assert differing(spark, tmp_path, "agg_17_more_codes", "events", rows, "event_id long, user_id long")


def test_digits_of_a_digest_are_no_phone_number(spark, tmp_path):
    # Some of these digests hold eleven digits between letters that look like a number.
    rows = [(i, f"t{n}", "en", "src", 2) for n, i in zip(range(4000), (i for i in range(2, 10**6) if i % 4 != 1 and i % 5 not in (0, 3) and i % 9 not in (3, 4)))]
    assert differing(spark, tmp_path, "snk_18_share_copy", "documents", rows, DOCUMENTS)


@pytest.mark.parametrize("text", ["7ce1 token", "a_bc of x-1 9ab-c", "befde251580 1thorth 2x", "on one-two"])
def test_acronyms_within_words(spark, tmp_path, text):
    assert differing(spark, tmp_path, "str_17_subjects", "documents", [(1, text, "en", "src", 9)], DOCUMENTS)


def test_hot_words_of_large_groups(spark):
    rows = [("a", i, f" Word{i % 300} " if i % 2 else f"word{i % 300}") for i in range(3000)] + [("b", 1, " "), ("b", 2, None), ("c", 5, "x" * 200)]
    words = spark.createDataFrame(rows, "run string, place long, word string")
    found = {r.run: r.words for r in upkeep.hot_word_lists(words, ["run"]).collect()}
    assert found == {"a": [f"Word{i}" if i % 2 else f"word{i}" for i in range(200)], "b": [], "c": ["x" * 128]}
