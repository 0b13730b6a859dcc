"""Several tables that change as one: an optimistic log of commits over Parquet folders.

A commit is a numbered file that is created only if it isn't there, and names for each table the folders that hold it. Data are
written first, into folders of their own that nothing names; the file makes them the tables' state for all at once. A writer
that dies before leaves the old state. Of two writers with the same number one creates the file; the other looks at what
was committed since it began: where that touched a table that it read, or replaced one that it appends to, it is refused and may
begin anew; else it takes the next number.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed what this one read or replaces."""


@dataclass(frozen=True)
class State:
    """What a version holds: by table its folders, and the version that last appended to or replaced it."""

    version: int = 0
    folders: dict[str, list[str]] = field(default_factory=dict)
    appended: dict[str, int] = field(default_factory=dict)
    replaced: dict[str, int] = field(default_factory=dict)
    note: str = ""


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._folder = self._path(f"{self.root}/_commits")
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._files.exists(self._folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._files.listStatus(self._folder) if s.getPath().getName().endswith(".json"))

    def state(self, version: int | None = None) -> State:
        """The state at a version; the latest, or an empty one, if none is named."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if version == 0:
            return State()
        stream = self._files.open(self._path(self._folder, f"{version:020d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return State(**json.loads(text))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self._read(self.state(version), table)

    def _read(self, state: State, table: str) -> DataFrame:
        folders = [f"{self.root}/{f}" for f in state.folders[table]]
        # Folders may lack columns that later ones have.
        out = self.spark.read.parquet(folders[0])
        for folder in folders[1:]:
            out = out.unionByName(self.spark.read.parquet(folder), allowMissingColumns=True)
        return out

    def begin(self) -> Transaction:
        return Transaction(self, self.state())

    def run(self, change: Callable[[Transaction], None], note: str = "", attempts: int = 5) -> int:
        """Apply a change to the latest state and commit it; refused, it is applied to the state that won, so often."""
        for attempt in range(attempts):
            transaction = self.begin()
            change(transaction)
            try:
                return transaction.commit(note)
            except Conflict:
                if attempt + 1 == attempts:
                    raise
        raise AssertionError("at least one attempt")

    def roll_back(self, version: int) -> int:
        """Put the state of an earlier version in force again, as a commit of its own."""
        earlier = self.state(version)
        transaction = self.begin()
        for table in transaction.base.folders:
            transaction.reads.add(table)
        transaction.folders = {t: list(f) for t, f in earlier.folders.items()}
        transaction.replaces |= set(earlier.folders) | set(transaction.base.folders)
        return transaction.commit(f"roll back to {version}")

    def _create(self, state: State) -> bool:
        """Create a commit's file; false if that number is taken. The file is whole before it has its name."""
        self._files.mkdirs(self._folder)
        target, draft = self._path(self._folder, f"{state.version:020d}.json"), self._path(self._folder, f".{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        stream.write(bytearray(json.dumps(state.__dict__, sort_keys=True).encode()))
        stream.close()
        try:
            if self._files.getScheme() == "file":
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            else:
                jvm = self.spark._jvm
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, options)
        except FileExistsError:
            return False
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                return False
            raise
        finally:
            self._files.delete(draft, False)
        return True


class Transaction:
    """Changes to tables that become visible together."""

    def __init__(self, log: CommitLog, base: State):
        self.log, self.base = log, base
        self.folders = {t: list(f) for t, f in base.folders.items()}
        self.reads: set[str] = set()
        self.appends: dict[str, list[str]] = {}
        self.replaces: set[str] = set()

    def has(self, table: str) -> bool:
        self.reads.add(table)
        return bool(self.folders.get(table))

    def read(self, table: str) -> DataFrame:
        """A table as the transaction began, with its own changes."""
        self.reads.add(table)
        return self.log._read(State(folders=self.folders), table)

    def append(self, table: str, rows: DataFrame) -> None:
        folder = self._write(table, rows)
        self.folders.setdefault(table, []).append(folder)
        self.appends.setdefault(table, []).append(folder)

    def replace(self, table: str, rows: DataFrame) -> None:
        self.folders[table] = [self._write(table, rows)]
        self.replaces.add(table)

    def _write(self, table: str, rows: DataFrame) -> str:
        folder = f"{table}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.log.root}/{folder}")
        return folder

    def commit(self, note: str = "") -> int:
        current = self.base
        while True:
            folders = {t: list(f) for t, f in current.folders.items()}
            for table in self.replaces:
                folders.pop(table, None)
                if table in self.folders:
                    folders[table] = self.folders[table]
            for table in set(self.appends) - self.replaces:
                folders[table] = [*current.folders.get(table, []), *self.appends[table]]
            version = current.version + 1
            marked = lambda old, tables: old | {t: version for t in tables}  # noqa: E731, B023
            state = State(version, folders, marked(current.appended, self.appends), marked(current.replaced, self.replaces), note)
            if self.log._create(state):
                return version
            current = self.log.state(version)
            self._check(current)

    def _check(self, current: State) -> None:
        since = lambda marks, tables: sorted(t for t in tables if marks.get(t, 0) > self.base.version)
        touched = since(current.appended, self.reads | self.replaces) + since(current.replaced, self.reads | self.replaces | set(self.appends))
        if touched:
            raise Conflict(f"committed meanwhile: {', '.join(dict.fromkeys(touched))}")


# --- Changes of several tables ---------------------------------------------------------------------------------------


def approve(log: CommitLog, document_ids: DataFrame, index: Callable[[Transaction, DataFrame], None], note: str = "approve") -> int:
    """Approve quarantined documents (document_id), index their chunks and enable them, as one commit.

    ``index`` adds chunks to whatever index the transaction holds. Documents that aren't in quarantine stay as they are.
    """

    def change(t: Transaction) -> None:
        documents = t.read("documents")
        chosen = documents.filter("status = 'quarantined'").join(document_ids, "document_id", "left_semi").select("document_id")
        chunks = t.read("chunks").join(chosen, "document_id", "left_semi")
        index(t, chunks)
        flagged = documents.join(chosen.withColumn("__chosen", F.lit(True)), "document_id", "left")
        approved = F.col("__chosen").isNotNull()
        t.replace("documents", flagged.withColumns({
            "status": F.when(approved, "approved").otherwise(F.col("status")), "enabled": F.col("enabled") | approved,
        }).drop("__chosen"))
        t.append("events", chosen.select("document_id", F.lit("approved").alias("event")))

    return log.run(change, note)


def save_answer(log: CommitLog, answers: DataFrame, evidence: DataFrame, citations: DataFrame) -> int:
    """Save answers with their message, evidence and citations, or nothing.

    answers: answer_id, conversation_id, text; evidence: answer_id, evidence_id, chunk_id; citations: answer_id, evidence_id. A message
    takes its conversation's next ordinal. An answer that is saved already, a citation without evidence, or evidence without an
    answer refuses them all.
    """

    def change(t: Transaction) -> None:
        old = {name: t.read(name) if t.has(name) else None for name in ("messages", "answers")}
        if old["answers"] is not None and not answers.join(old["answers"], "answer_id", "left_semi").isEmpty():
            raise ValueError("an answer is saved already")
        if not citations.join(evidence, ["answer_id", "evidence_id"], "left_anti").isEmpty():
            raise ValueError("a citation names no evidence")
        if not evidence.join(answers, "answer_id", "left_anti").isEmpty():
            raise ValueError("evidence belongs to no answer")
        from quillon.operators.incremental import next_ordinals

        rows = answers.select("answer_id", "conversation_id", F.lit("assistant").alias("role"), "text")
        none = rows.select("conversation_id", F.lit(0).cast("long").alias("ordinal")).limit(0)
        known = none if old["messages"] is None else old["messages"].select("conversation_id", "ordinal")
        messages = next_ordinals(rows, known, ["conversation_id"], ["answer_id"])
        t.append("messages", messages.select("conversation_id", F.col("ordinal").cast("long").alias("ordinal"), "role", "text", "answer_id"))
        t.append("answers", answers)
        t.append("answer_evidence", evidence)
        t.append("citations", citations)

    return log.run(change, "answer")


ITEM_TABLES = ("items", "aliases", "item_tags", "relations")


def delete_items(log: CommitLog, item_ids: DataFrame) -> int:
    """Delete items (item_id) with their aliases, tags and relations of both directions; one tombstone row holds all of an item."""

    def change(t: Transaction) -> None:
        items, aliases, tags, relations = (t.read(x) for x in ITEM_TABLES)
        gone = item_ids.select("item_id").distinct()
        tomb = items.join(gone, "item_id", "left_semi").select("item_id", F.struct(*items.columns).alias("item"))
        for rows, name, key in ((aliases, "aliases", "item_id"), (tags, "tags", "item_id"), (relations, "leaving", "source_id"), (relations, "coming", "target_id")):
            own = gone.withColumnRenamed("item_id", "__gone")
            held = rows.join(own, F.col(key) == F.col("__gone")).groupBy(F.col("__gone").alias("item_id")).agg(F.collect_list(F.struct(*rows.columns)).alias(name))
            tomb = tomb.join(held, "item_id", "left")
        t.append("tombstones", tomb)
        without = lambda rows, key: rows.join(gone.withColumnRenamed("item_id", "__gone"), F.col(key) == F.col("__gone"), "left_anti")
        t.replace("items", without(items, "item_id"))
        t.replace("aliases", without(aliases, "item_id"))
        t.replace("item_tags", without(tags, "item_id"))
        t.replace("relations", without(without(relations, "source_id"), "target_id"))

    return log.run(change, "delete")


def restore_items(log: CommitLog, item_ids: DataFrame) -> int:
    """Restore deleted items (item_id) from their tombstones, with the relations whose other end is there, restored now or never deleted.

    An item that is there already, or has no tombstone, refuses them all.
    """

    def change(t: Transaction) -> None:
        items, aliases, tags, relations = (t.read(x) for x in ITEM_TABLES)
        tombs, wanted = t.read("tombstones"), item_ids.select("item_id").distinct()
        if not wanted.join(tombs, "item_id", "left_anti").isEmpty() or not items.join(wanted, "item_id", "left_semi").isEmpty():
            raise ValueError("an item is there already, or was never deleted")
        back = tombs.join(wanted, "item_id", "left_semi")
        now = items.unionByName(back.select("item.*"))
        unfold = lambda name: back.select(F.inline(name))
        ends = now.select(F.col("item_id").alias("__end"))
        live = unfold("leaving").unionByName(unfold("coming")).distinct()
        for end in ("source_id", "target_id"):
            live = live.join(ends, F.col(end) == F.col("__end"), "left_semi")
        t.replace("items", now)
        t.replace("aliases", aliases.unionByName(unfold("aliases")))
        t.replace("item_tags", tags.unionByName(unfold("tags")))
        t.replace("relations", relations.unionByName(live))
        t.replace("tombstones", tombs.join(wanted, "item_id", "left_anti"))

    return log.run(change, "restore")
