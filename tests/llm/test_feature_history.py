"""Features as of a time, against counting the rows of each window anew."""

import math
import random
import zlib
from datetime import datetime, timedelta

from quillon.llm.feature_history import FeatureOptions, point_in_time

SALES = "sale_id long, client_id long, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, t string, block string"
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, latest int"
LINES = "sale_id long, item_id long, amount double, shipped_at timestamp_ntz, sold string"
ZERO = datetime(2024, 1, 1)


def cents(x):
    return 0 if x is None or not math.isfinite(x) else math.floor(100.0 * x + 0.5)


def brute(sales, clicks, lines, days=(2, 14)):
    wait, out = timedelta(minutes=240), []
    clicks = list(dict.fromkeys(clicks))
    known = [s for s in sales if s[1] is not None and s[3] is not None]
    for s in known:
        t = s[3] + timedelta(seconds=zlib.crc32(str(s[0]).encode()) % 259200 if s[0] is not None else 0)
        label = any(o[1] == s[1] and t < o[3] <= t + timedelta(days=7) for o in known)
        for d in days:
            since = t - timedelta(days=d)
            c = [x for x in clicks if x[3] == s[1] and x[1] and x[2] and since < x[1] <= t and x[2] + wait <= t]
            o = [x for x in known if x[1] == s[1] and x[4] and since < x[3] <= t and x[4] + wait <= t]
            n = [x for y in o for x in lines if x[0] is not None and x[0] == y[0] and x[3] and x[3] <= t]
            last = max(((x[1], x[0]) for x in c), default=(None, None))[1]
            out.append((s[0], d, round((t - datetime(1970, 1, 1)) / timedelta(microseconds=1)), label, len(c),
                        sum(x[4] == "purchase" for x in c), sum(cents(x[5]) for x in c), last, len(o), sum(cents(x[2]) for x in o),
                        len(n), len({x[1] for x in n} - {None}), sum(cents(x[2]) for x in n)))
    return sorted(out, key=str)


def shop(seed, n=120):
    r = random.Random(seed)
    when = lambda: None if r.random() < 0.03 else ZERO + timedelta(seconds=r.choice((60, 3600, 86400)) * r.randrange(600) % (40 * 86400))
    late = lambda t: None if t is None or r.random() < 0.03 else t + timedelta(seconds=r.choice((0, 5, 9000, 400_000)))
    client = lambda: r.choice((7, 7, 7, 1, 2, None))
    sales = [(i, client(), r.choice((1.005, None, 3.2, math.nan, math.inf)), t, late(t), "x", "y") for i in range(n) for t in [when()]]
    clicks = [
        (r.randrange(n), t, late(t), client(), r.choice(("view", "purchase", None)), r.choice((2.5, None, -1.25)), r.choice(("{}", None)), 1)
        for _ in range(4 * n) for t in [when()]
    ]
    clicks += clicks[:20]
    lines = []
    for _ in range(5 * n):
        s = r.choice((sales[0], r.choice(sales)))
        shipped = None if s[3] is None or r.random() < 0.05 else s[3] + timedelta(hours=r.choice((0, 3, 30, 300, 400)))
        lines.append((r.choice((s[0], s[0], s[0], None)), r.choice((1, 1, 2, 3, None)), r.choice((9.99, None)), shipped, "z"))
    return sales, clicks, lines + lines[:10]


def found(spark, sales, clicks, lines, options=FeatureOptions()):
    frames = (spark.createDataFrame(x, s) for x, s in ((sales, SALES), (clicks, CLICKS), (lines, LINES)))
    return sorted((tuple(r) for r in point_in_time(*frames, options).collect()), key=str)


def test_windows_hold_what_was_visible(spark):
    for seed in (1, 2):
        tables = shop(seed)
        assert found(spark, *tables) == brute(*tables)


def test_blocks_and_bins_change_nothing(spark):
    tables = shop(3, 60)
    fine = FeatureOptions(block_seconds=3600, bin_seconds=7)
    assert found(spark, *tables, fine) == brute(*tables)


def test_edges(spark):
    assert found(spark, [], [], []) == []
    sales = [(None, 1, 5.0, ZERO, ZERO, "", ""), (5, None, 1.0, ZERO, ZERO, "", ""), (6, 2, 1.0, None, ZERO, "", "")]
    assert found(spark, sales, [], []) == brute(sales, [], [])
    twice = [(1, 1, 5.0, ZERO, ZERO, "", "")] * 2
    lines = [(1, 4, 1.0, ZERO, "")] * 3
    rows = found(spark, twice, [], lines)
    assert rows == brute(twice, [], lines) and len(rows) == 4
