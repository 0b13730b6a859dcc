"""Streams with restarts: a folder's removals, and groups by speaker that arrive out of order."""

import random

from quillon.sources.commits import CommitLog
from quillon.streaming import folders, speech


def test_removed_files_are_disabled_once(spark, tmp_path):
    inbox, log = tmp_path / "in", CommitLog(spark, str(tmp_path / "log"))
    (inbox / "sub").mkdir(parents=True)
    (inbox / "a.md").write_text("one")
    (inbox / "sub" / "b.md").write_text("two")
    (inbox / "c.bin").write_text("other")

    def run():
        changes = folders.folder_changes(spark, str(inbox), str(tmp_path / "snapshots"), (".md",), 2)
        query = folders.follow(log, changes, str(tmp_path / "checkpoint"))
        query.awaitTermination()
        return {r.path: (r.size, r.enabled, r.batch) for r in log.read("documents").collect()}

    assert run() == {"a.md": (3, True, 0), "sub/b.md": (3, True, 0)}
    before = log.versions()
    run()
    assert log.versions() == before  # nothing new
    (inbox / "sub" / "b.md").unlink()
    (inbox / "a.md").write_text("longer")
    (inbox / "d.md").write_text("new")
    assert run() == {"a.md": (6, True, 1), "sub/b.md": (3, False, 1), "d.md": (3, True, 1)}
    assert run() == {"a.md": (6, True, 1), "sub/b.md": (3, False, 1), "d.md": (3, True, 1)}
    (inbox / "sub" / "b.md").write_text("back")
    assert run()["sub/b.md"] == (4, True, 2)


def test_groups_by_speaker_are_those_of_the_table(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(2)
    schema = "run string, seq long, speaker string, start_ms long, end_ms long"
    rows = []
    for run in ("x", "y"):
        at = 10_000
        for seq in range(60):
            at += r.choice((100, 900, 2_000, 6_000))
            rows.append((run, seq, r.choice("AAB"), at, at + r.choice((300, 1_500))))
    rows.sort(key=lambda x: x[3])
    batches = [rows[i : i + 30] for i in range(0, len(rows), 30)]
    for b in batches:
        r.shuffle(b)
    batches[1].append(batches[0].pop())  # late, but not too late
    batches += [[("end", 0, "Z", 10_000_000, 10_000_001)], [("end", 1, "Z", 20_000_000, 20_000_001)]]
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:  # each run of the query begins from the checkpoint
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(inbox)
        stream = speech.speaker_groups(spark.readStream.schema(schema).json(inbox), late="40 seconds")
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()
    key = lambda df: sorted(tuple(x) for x in df.filter("run <> 'end'").collect())
    table = speech.speaker_groups_of_table(spark.createDataFrame(rows, schema))
    assert key(spark.read.schema(speech.OUT).parquet(out)) == key(table)
