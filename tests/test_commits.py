"""Commits: all or nothing at every step, one of two writers, and changes that need several tables."""

import pytest
from pyspark.sql import functions as F

from quillon.operators.index import InTransaction, TextIndex
from quillon.sources import commits
from quillon.sources.commits import CommitLog, Conflict, Transaction


@pytest.fixture
def log(spark, tmp_path):
    return CommitLog(spark, str(tmp_path / "log"))


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_one_of_two_writers_is_refused(spark, log):
    log.run(lambda t: t.append("t", spark.range(3)))
    one, two = log.begin(), log.begin()
    for t, n in ((one, 10), (two, 20)):
        t.replace("t", t.read("t").select((F.col("id") + n).alias("id")))
    assert one.commit() == 2
    with pytest.raises(Conflict):
        two.commit()
    assert values(log.read("t"), "id") == [(10,), (11,), (12,)]


def test_appends_to_a_table_do_not_conflict(spark, log):
    log.run(lambda t: t.append("t", spark.range(1)))
    one, two, other = log.begin(), log.begin(), log.begin()
    one.append("t", spark.range(10, 11))
    two.append("t", spark.range(20, 21))
    other.append("u", spark.range(5))
    assert [one.commit(), other.commit(), two.commit()] == [2, 3, 4]
    assert values(log.read("t"), "id") == [(0,), (10,), (20,)] and values(log.read("t", 2), "id") == [(0,), (10,)]
    assert log.roll_back(2) == 5 and values(log.read("t"), "id") == [(0,), (10,)] and "u" not in log.state().folders


def test_an_append_after_a_replacement_is_refused_and_run_again(spark, log):
    log.run(lambda t: t.append("t", spark.range(1)))
    late = log.begin()
    late.append("t", spark.range(7, 8))
    log.run(lambda t: t.replace("t", spark.range(100, 101)))
    with pytest.raises(Conflict):
        late.commit()
    tries = []

    def change(t):
        tries.append(1)
        t.replace("t", t.read("t").select((F.col("id") + 1).alias("id")))
        if len(tries) == 1:
            log.run(lambda x: x.append("t", spark.range(200, 201)))

    log.run(change)
    assert len(tries) == 2 and values(log.read("t"), "id") == [(101,), (201,)]


DOCS = [(1, "quarantined", False), (2, "quarantined", False), (3, "ready", True)]
CHUNKS = [(1, 10, "t", "red apple"), (2, 20, "t", "green pear"), (3, 30, "t", "blue")]


def library(spark, log):
    def begin(t):
        t.append("documents", spark.createDataFrame(DOCS, "document_id long, status string, enabled boolean"))
        t.append("chunks", spark.createDataFrame(CHUNKS, "document_id long, chunk_id long, title string, content string"))

    log.run(begin)


def indexed(t, rows):
    TextIndex(rows.sparkSession, "", store=InTransaction(t)).upsert(rows.drop("document_id"))


def test_approving_indexes_and_enables_as_one(spark, log):
    library(spark, log)
    commits.approve(log, spark.createDataFrame([(1,), (3,)], "document_id long"), indexed)
    assert values(log.read("documents"), "document_id", "status", "enabled") == [(1, "approved", True), (2, "quarantined", False), (3, "ready", True)]
    assert values(log.read("index_entries"), "chunk_id") == [(10,)]
    commits.approve(log, spark.createDataFrame([(2,)], "document_id long"), indexed)
    index = TextIndex(spark, "", store=InTransaction(log.begin()))
    assert values(index.postings(), "term", "chunk_id") == [("apple", 10), ("green", 20), ("pear", 20), ("red", 10), ("t", 10), ("t", 20)]
    assert index.statistics().first()["n_chunks"] == 2


def test_a_failure_at_any_step_leaves_the_old_state(spark, log, monkeypatch):
    library(spark, log)
    before, write, create = log.state(), Transaction._write, CommitLog._create
    steps = 0
    for dying in range(1, 20):
        count = 0

        def dies(f, dying=dying):
            def step(*args):
                nonlocal count
                count += 1
                if count == dying:
                    raise RuntimeError("lost")
                return f(*args)

            return step

        with monkeypatch.context() as m:
            m.setattr(Transaction, "_write", dies(write))
            m.setattr(CommitLog, "_create", dies(create))
            try:
                commits.approve(log, spark.createDataFrame([(1,)], "document_id long"), indexed)
                break
            except RuntimeError:
                steps += 1
                assert log.state() == before
    assert steps == 7  # entries, positions, blocks, epoch, documents, events, commit
    assert values(log.read("documents").filter("enabled"), "document_id") == [(1,), (3,)]


def test_answers_are_saved_whole_or_not_at_all(spark, log):
    answer = lambda i: spark.createDataFrame([(i, "c", "text")], "answer_id string, conversation_id string, text string")
    evidence = lambda i: spark.createDataFrame([(i, "S1", "k")], "answer_id string, evidence_id string, chunk_id string")
    cited = lambda i, e: spark.createDataFrame([(i, e)], "answer_id string, evidence_id string")
    commits.save_answer(log, answer("a"), evidence("a"), cited("a", "S1"))
    for bad in ((answer("a"), evidence("a"), cited("a", "S1")), (answer("b"), evidence("b"), cited("b", "S2")), (answer("b"), evidence("x"), cited("x", "S1"))):
        with pytest.raises(ValueError):
            commits.save_answer(log, *bad)
    commits.save_answer(log, answer("b"), evidence("b"), cited("b", "S1"))
    assert log.versions() == [1, 2] and values(log.read("messages"), "ordinal", "answer_id") == [(1, "a"), (2, "b")]


def test_items_come_back_as_they_were(spark, log):
    tables = {
        "items": ([("a", "x"), ("b", "y"), ("c", "z")], "item_id string, title string"), "aliases": ([("a", "A"), ("a", "AA")], "item_id string, alias string"),
        "item_tags": ([("b", "t")], "item_id string, tag string"),
        "relations": ([("a", "b", "supports"), ("b", "c", "extends"), ("c", "a", "supports")], "source_id string, target_id string, relation_type string"),
    }
    log.run(lambda t: [t.append(k, spark.createDataFrame(*v)) for k, v in tables.items()])
    held = lambda: {k: values(log.read(k), *log.read(k).columns) for k in tables}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "item_id string")
    whole = held()
    commits.delete_items(log, ids("a", "b"))
    assert held()["relations"] == [] and held()["items"] == [("c", "z")]
    commits.restore_items(log, ids("a"))
    assert held()["relations"] == [("c", "a", "supports")] and held()["aliases"] == whole["aliases"]
    with pytest.raises(ValueError):
        commits.restore_items(log, ids("a"))
    commits.restore_items(log, ids("b"))
    assert held() == whole and values(log.read("tombstones"), "item_id") == []
