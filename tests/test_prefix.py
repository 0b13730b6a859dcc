"""Running totals, carried values and order statistics over blocks, and what is built on them, against plain loops."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from quillon.operators import incremental, intervals, prefix


def table(spark, seed, n=300):
    r = random.Random(seed)
    rows = [(r.choice(("hot", "hot", "hot", "b", None)), i, r.choice((None, r.randint(-5, 50)))) for i in range(n)]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, n long, v long")


def test_totals_run_over_all_ranges(spark):
    rows, df = table(spark, 1)
    blocks = prefix.dealt(df, ["n"], 7)
    got = {r.n: r.total for r in prefix.running_totals(blocks, [], ["n"], {"total": F.col("v")}).collect()}
    total, want = 0, {}
    for _, n, v in sorted(rows, key=lambda x: x[1]):
        total += v or 0
        want[n] = total
    assert got == want


def test_totals_and_values_of_a_hot_key(spark):
    rows, df = table(spark, 2)
    blocks = prefix.dealt(df, ["k", "n"], 7)
    got = {r.n: (r.total, r.held) for r in prefix.carried(prefix.running_totals(blocks, ["k"], ["n"], {"total": F.col("v")}), ["k"], ["n"], "held", F.col("v")).collect()}
    total, held, want = {}, {}, {}
    for k, n, v in sorted(rows, key=lambda x: x[1]):
        total[k] = total.get(k, 0) + (v or 0)
        want[n] = (total[k], held.get(k))
        held[k] = held.get(k) if v is None else v
    assert got == want


def test_size_cap_counts_over_all_files(spark):
    files = [(f"p{i:03d}", 10 if i % 4 else None) for i in range(100)]
    df = spark.createDataFrame(files, "path string, size long")
    got = {r.path: (r.total, r.fits) for r in incremental.size_cap(df, ["path"], 300).collect()}
    total = 0
    for path, size in files:
        total += size or 0
        assert got[path] == (total, total <= 300)


def test_ranks(spark):
    r = random.Random(3)
    rows = [(k, r.choice((1.0, 1.0001, 1.00005, -3.5, 220.25, r.uniform(0, 3)))) for k in "ab" for _ in range(99)]
    df = spark.createDataFrame(rows, "k string, v double")
    ranks = spark.createDataFrame([(k, i) for k in "ab" for i in (1, 2, 50, 98, 99)], "k string, rank long")
    for row in prefix.order_statistics(df, ["k"], "v", ranks).collect():
        assert row.v == sorted(v for k, v in rows if k == row.k)[row["rank"] - 1]


def plain_spans(energies, frame=0.03, bridge=14, least=8, pad=0.18):
    quiet = sorted(energies)[: max(1, len(energies) // 5)]
    limit = max(220.0, median(quiet) * 3)
    speech = [e >= limit for e in energies]
    spoken = [i for i, s in enumerate(speech) if s]
    for a, b in zip(spoken, spoken[1:], strict=False):
        if b - a - 1 <= bridge:
            speech[a:b] = [True] * (b - a)
    out, i = [], 0
    while i < len(speech):
        j = i
        while j < len(speech) and speech[j]:
            j += 1
        if j - i >= least:
            start, end, mean = max(0.0, i * frame - pad), min(len(speech) * frame, j * frame + pad), round(sum(energies[i:j]) / (j - i), 2)
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], end, max(out[-1][2], mean))
            else:
                out.append((start, end, mean))
        i = max(j, i + 1)
    return out


@pytest.mark.parametrize("block", [5, 16, 20_000])
def test_voice_spans_in_blocks(spark, block):
    r = random.Random(9)
    runs = {}
    for name in ("hot", "short", "silent"):
        energies, n = [], {"hot": 900, "short": 30, "silent": 40}[name]
        while len(energies) < n:
            loud = r.random() < 0.5 and name != "silent"
            energies += [r.uniform(300, 900) if loud else r.choice((10.0, 20.0, r.uniform(0, 60)))] * r.choice((1, 3, 9, 13, 16, 40))
        runs[name] = energies[:n]
    rows = [(k, i, e) for k, es in runs.items() for i, e in enumerate(es)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "run string, n int, energy double")
    got = {}
    for x in sorted(intervals.voice_spans(df, ["run"], block=block).collect(), key=lambda x: x.start):
        got.setdefault(x.run, []).append((x.start, x.end, x.mean_energy))
    for name, energies in runs.items():
        assert got.get(name, []) == [pytest.approx(s, abs=0.011) for s in plain_spans(energies)]
