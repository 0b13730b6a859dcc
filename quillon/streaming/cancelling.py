"""Ingests that can be cancelled: running Spark jobs stop by their tag, and what was written so far is never committed."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.commits import CommitLog, Transaction


class Cancelled(RuntimeError):
    """The ingest was cancelled; the tables are as they were, its open items read ``cancelled``."""


class Ingest:
    """One job of a table ``items`` (job_id, ordinal, status), run in one thread and cancelled from another."""

    def __init__(self, spark: SparkSession, log: CommitLog, job_id: str):
        self.spark, self.log, self.job_id = spark, log, job_id
        self.tag = f"ingest-{job_id}"
        self._asked = threading.Event()

    def cancel(self) -> None:
        self._asked.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def check(self) -> None:
        """Between steps: stop here if that was asked for."""
        if self._asked.is_set():
            raise Cancelled(self.job_id)

    def _mark(self, of: tuple[str, ...], to: str) -> Callable[[Transaction], None]:
        def change(t: Transaction) -> None:
            own = (F.col("job_id") == self.job_id) & F.col("status").isin(*of)
            items: DataFrame = t.read("items")
            t.replace("items", items.withColumn("status", F.when(own, to).otherwise(F.col("status"))))

        return change

    def run(self, work: Callable[[Transaction, Callable[[], None]], None]) -> int:
        """Do the work in one transaction and commit it with its items completed.

        work gets the transaction and ``check``, to be called between steps. A cancelled ingest commits its items' state only.
        """
        context = self.spark.sparkContext
        self.log.run(self._mark(("queued",), "running"), "begin")
        context.addJobTag(self.tag)
        try:
            transaction = self.log.begin()
            self.check()
            work(transaction, self.check)
            self._mark(("running",), "completed")(transaction)
            self.check()
            return transaction.commit("ingest")
        except Exception as error:
            if not self._asked.is_set():
                raise
            context.removeJobTag(self.tag)  # what follows isn't to be stopped
            self.log.run(self._mark(("queued", "running"), "cancelled"), "cancelled")
            raise Cancelled(self.job_id) from error
        finally:
            context.removeJobTag(self.tag)
