"""A cancelled ingest stops, leaves no half commit, and its items say so."""

import threading
import time

import pytest

from quillon.sources.commits import CommitLog
from quillon.streaming.cancelling import Cancelled, Ingest

ITEMS = [("j", 1, "queued"), ("j", 2, "completed"), ("other", 1, "queued")]


@pytest.fixture
def log(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    log.run(lambda t: t.append("items", spark.createDataFrame(ITEMS, "job_id string, ordinal int, status string")))
    return log


def items(log):
    return sorted(tuple(r) for r in log.read("items").collect())


def slow(batches):
    for b in batches:
        time.sleep(60)
        yield b


def test_a_running_job_is_stopped(spark, log):
    ingest, ended = Ingest(spark, log, "j"), []

    def work(t, check):
        t.append("documents", spark.range(3))
        check()
        t.append("chunks", spark.range(0, 4, 1, 2).mapInPandas(slow, "id long"))

    def run():
        try:
            ingest.run(work)
        except Cancelled as error:
            ended.append(error)

    thread = threading.Thread(target=run)
    thread.start()
    time.sleep(12)
    began = time.time()
    ingest.cancel()
    thread.join(40)
    assert ended and time.time() - began < 40
    assert items(log) == [("j", 1, "cancelled"), ("j", 2, "completed"), ("other", 1, "queued")]
    assert set(log.state().folders) == {"items"}
    assert spark.range(3).count() == 3  # other work goes on


def test_between_steps_and_without_cancelling(spark, log):
    ingest = Ingest(spark, log, "j")

    def work(t, check):
        t.append("documents", spark.range(3))
        ingest.cancel()
        check()

    with pytest.raises(Cancelled):
        ingest.run(work)
    assert set(log.state().folders) == {"items"} and items(log)[0] == ("j", 1, "cancelled")
    Ingest(spark, log, "other").run(lambda t, check: t.append("documents", spark.range(3)))
    assert log.read("documents").count() == 3 and items(log)[2] == ("other", 1, "completed")
    with pytest.raises(ZeroDivisionError):
        Ingest(spark, log, "other").run(lambda t, check: 1 / 0)
