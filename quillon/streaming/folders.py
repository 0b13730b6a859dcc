"""A folder as a stream of changes: files added, changed and removed.

Spark's own file source sees additions only. Here an offset names a snapshot of the folder, a listing that is kept beside the
checkpoint; a micro-batch is what differs between two snapshots, dealt to partitions by path. A stream that is stopped and started
again takes up the snapshot that its checkpoint names, so a file that was removed meanwhile is reported once.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillon.sources.commits import CommitLog, Transaction

SCHEMA = "path string, change string, size long, mtime long"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def snapshot(path: str, suffixes: tuple[str, ...] = ()) -> dict[str, list[int]]:
    """Relative path -> (size, mtime in nanoseconds) of the files below a folder; hidden ones are left aside."""
    from pyarrow import fs

    files, root = _filesystem(path)
    base = root.rstrip("/") + "/"
    found = {}
    for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
        relative = info.path.removeprefix(base)
        hidden = any(part.startswith(".") for part in relative.split("/"))
        if info.type == fs.FileType.File and not hidden and (not suffixes or relative.lower().endswith(suffixes)):
            found[relative] = [info.size, info.mtime_ns or 0]
    return found


def differences(before: dict[str, list[int]], after: dict[str, list[int]]) -> Iterator[tuple[str, str, int, int]]:
    for path in sorted(before.keys() | after.keys()):
        old, new = before.get(path), after.get(path)
        if old != new:
            yield path, "removed" if new is None else "added" if old is None else "changed", *(new or old)


class _Part(InputPartition):
    def __init__(self, number: int, start: str, end: str):
        super().__init__(number)
        self.number, self.start, self.end = number, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.state = options["path"], options["state"]
        self.suffixes = tuple(s for s in options.get("suffixes", "").lower().split(",") if s)
        self.parts = int(options.get("partitions", "8"))

    def _name(self, digest: str) -> tuple:
        files, root = _filesystem(self.state)
        return files, root, f"{root.rstrip('/')}/{digest}.json"

    def _load(self, digest: str) -> dict[str, list[int]]:
        if not digest:
            return {}
        files, _, name = self._name(digest)
        with files.open_input_stream(name) as stream:
            return json.loads(stream.readall())

    def initialOffset(self) -> dict:
        return {"snapshot": ""}

    def latestOffset(self) -> dict:
        text = json.dumps(snapshot(self.path, self.suffixes), sort_keys=True).encode()
        digest = hashlib.sha256(text).hexdigest()
        files, root, name = self._name(digest)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(name) as stream:
            stream.write(text)
        return {"snapshot": digest}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        return [_Part(i, start["snapshot"], end["snapshot"]) for i in range(self.parts)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for row in differences(self._load(partition.start), self._load(partition.end)):
            if zlib.crc32(row[0].encode()) % self.parts == partition.number:
                yield row

    def commit(self, end: dict) -> None:
        """Snapshots stay: a restarted query may read an earlier one again."""


class FolderChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options)


def folder_changes(spark: SparkSession, path: str, state: str, suffixes: tuple[str, ...] = (), partitions: int = 8) -> DataFrame:
    """path, change (added, changed or removed), size, mtime of a folder's files; state: a folder for its snapshots."""
    spark.dataSource.register(FolderChanges)
    options = {"state": state, "suffixes": ",".join(suffixes), "partitions": str(partitions)}
    return spark.readStream.format("folder_changes").options(**options).load(path)


def follow(log: CommitLog, changes: DataFrame, checkpoint: str) -> StreamingQuery:
    """Keep a table ``documents`` (path, size, mtime, enabled, batch) in step with a folder's changes; one commit for each batch.

    Removed files' documents are disabled, not deleted. A batch that is repeated after a restart changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        def change(t: Transaction) -> None:
            done = t.read("batches") if t.has("batches") else None
            if done is not None and not done.filter(F.col("number") == number).isEmpty():
                return
            new = batch.select("path", "size", "mtime", (F.col("change") != "removed").alias("enabled"), F.lit(number).cast("long").alias("batch"))
            if t.has("documents"):
                kept = t.read("documents").join(new, "path", "left_anti")
                t.replace("documents", kept.unionByName(new))
            else:
                t.append("documents", new)
            t.append("batches", batch.sparkSession.createDataFrame([(number,)], "number long"))

        log.run(change, f"batch {number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
