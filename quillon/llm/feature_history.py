"""Point-in-time features from a materialised temporal history.

A feature that counts rows in a sliding window changes only when a row becomes visible and when it leaves the window.
These changes are deltas: (key, at, columns to add). Deltas of one key and instant are coalesced; running sums in time
order then give segments [at, end) in which every feature is constant, ``end`` being the next delta's time by ``lead``.
A probe (key, t) has the values of the one segment that covers t.

Nothing is summed over a whole key at once, since one key may hold a third of all rows. Time is cut into blocks; a
block's opening values are the sums of the totals of the blocks before it, of which a key has as many as the history has
blocks, whatever the number of rows. Within blocks segments are also split at the edges of short bins that hold a probe,
so that probes meet segments by an equi-join on key and bin and one comparison. Blocks and bins change no result.

Features of the shop's tables, for each window of d days before t: counts and cents of clicks and sales that had arrived
``visible_minutes`` before t, lines of those sales that were shipped by t, and their distinct items. The latest click is a
running maximum of (time, id), void once it leaves the window. Items count while any of their lines does: of a line's
time only what no earlier line of the client and item covers is added, which a running maximum of sale times tells.

Defined results: a sale without client or time is no probe and never counts; a null sale_id makes t the time of sale and
has no lines; rows without client, time or arrival never count; neither do lines without a shipping time; fully equal
clicks count once, equal lines each; a null, infinite or not-a-number amount is 0 cents; sales that repeat are probes as
often as they stand; empty tables give no rows or zeros; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from quillon.llm.common import materialise

SECOND = 1_000_000
DAY = 86_400 * SECOND


@dataclass(frozen=True)
class FeatureOptions:
    windows: tuple[int, ...] = (2, 14)  # days
    visible_minutes: int = 240
    label_days: int = 7
    spread_seconds: int = 259_200  # t is up to so many seconds after the sale
    block_seconds: int = 86_400
    bin_seconds: int = 1


def micros(df: DataFrame, column: str) -> Column:
    """Epoch microseconds of a timestamp; one without a zone counts as UTC, whatever the session's zone."""
    kind, value = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, TimestampType):
        return F.unix_micros(value)
    if not isinstance(kind, TimestampNTZType):
        raise TypeError(f"{column} must be a timestamp")
    of_day = (F.hour(value) * 3600 + F.minute(value) * 60).cast("long") * SECOND
    fraction = (F.date_part(F.lit("SECOND"), value) * SECOND).cast("long")
    return F.unix_date(value.cast("date")).cast("long") * DAY + of_day + fraction


def cents(column: str) -> Column:
    """floor(100 x + 0.5); 0 where there is no number or none that fits."""
    number = F.col(f"`{column}`").cast("double")
    fits = F.abs(number) <= F.lit(9.0e16)  # false for what isn't a number
    return F.coalesce(F.floor(F.when(fits, F.lit(100.0) * number + F.lit(0.5))), F.lit(0)).cast("long")


def one_history(
    deltas: DataFrame,
    probes: DataFrame,
    key: str,
    sums: Sequence[str],
    latest: str,
    block_seconds: int = 86_400,
    bin_seconds: int = 1,
) -> DataFrame:
    """probes (key, t, ...) with the running ``sums`` and the greatest ``latest`` of all deltas (key, at, sums, latest) up to t.

    Times are epoch microseconds; ``latest`` is a struct that is null in rows without one.
    """
    block, bin_ = block_seconds * SECOND, bin_seconds * SECOND
    zeros = [F.lit(0).cast("long").alias(c) for c in sums]
    none = F.lit(None).cast(deltas.schema[latest].dataType).alias(latest)
    in_block = lambda at: F.floor(F.col(at) / F.lit(block)).cast("long")
    deltas = deltas.select(key, in_block("at").alias("block"), "at", *sums, latest)
    asked = probes.select("*", in_block("t").alias("block"), F.floor(F.col("t") / F.lit(bin_)).cast("long").alias("bin"))

    # What each block that holds a probe opens with: totals of the blocks before it.
    totals = deltas.groupBy(key, "block").agg(*[F.sum(c).alias(c) for c in sums])
    greatest = deltas.filter(F.col(latest).isNotNull()).groupBy(key, "block").agg(F.max(latest).alias(latest))
    marks = (
        totals.select(key, "block", *sums, none, F.lit(False).alias("probed"))
        .unionByName(greatest.select(key, "block", *zeros, latest, F.lit(False).alias("probed")))
        .unionByName(asked.select(key, "block").distinct().select(key, "block", *zeros, none, F.lit(True).alias("probed")))
    )
    before = Window.partitionBy(key).orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    opening = (
        marks.select(
            key,
            "block",
            "probed",
            *[F.coalesce(F.sum(c).over(before), F.lit(0).cast("long")).alias(c) for c in sums],
            F.max(latest).over(before).alias(latest),
        )
        .filter("probed")
        .select(key, "block", (F.col("block") * block).alias("at"), *sums, latest, F.lit(None).cast("long").alias("edge"))
    )
    edges = asked.select(key, "block", (F.col("bin") * bin_).alias("at")).distinct()
    rows = (
        deltas.withColumn("edge", F.lit(None).cast("long"))
        .unionByName(opening)
        .unionByName(edges.select(key, "block", "at", *zeros, none, F.col("at").alias("edge")))
    )
    # Rows of one instant: all but the last have no length and fall away.
    order = Window.partitionBy(key, "block").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    segments = (
        rows.select(
            key,
            F.col("at").alias("start"),
            F.coalesce(F.lead("at").over(order), (F.col("block") + 1) * block).alias("end"),
            F.floor(F.col("at") / F.lit(bin_)).cast("long").alias("bin"),
            F.max("edge").over(upto).alias("edge"),
            *[F.sum(c).over(upto).alias(c) for c in sums],
            F.max(latest).over(upto).alias(latest),
        )
        .filter((F.col("start") < F.col("end")) & (F.col("edge") == F.col("bin") * bin_))
        .drop("edge")
    )
    held = asked.drop("block").join(segments.withColumnsRenamed({key: "of_key", "bin": "of_bin"}),
        (F.col(key) == F.col("of_key")) & (F.col("bin") == F.col("of_bin"))
        & (F.col("start") <= F.col("t")) & (F.col("t") < F.col("end")),
    )
    return held.drop("of_key", "of_bin", "bin", "start", "end")


def _unfold(df: DataFrame, changes: list[tuple[Column, dict[str, Column]]], names: Sequence[str]) -> DataFrame:
    """A row for each change (at, signs by name) that isn't all zero; other columns stay."""
    zero = F.lit(0)
    rows = [F.struct(at.alias("at"), *[signs.get(n, zero).alias(n) for n in names]) for at, signs in changes]
    found = df.withColumn("change", F.explode(F.array(*rows)))
    some = reduce(lambda a, b: a | b, [F.col(f"change.{n}") != 0 for n in names])
    return found.filter(some).select("*", "change.*").drop("change")


def _flag(condition: Column, sign: int = 1) -> Column:
    return F.when(condition, F.lit(sign)).otherwise(F.lit(0))


FEATURES = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")


class Shop:
    """The shop's tables as deltas and probes."""

    def __init__(self, sales: DataFrame, clicks: DataFrame, lines: DataFrame, options: FeatureOptions):
        self.options, self.windows = options, options.windows
        self.sums = [f"{f}_{d}" for d in self.windows for f in FEATURES] + ["ahead"]
        self.latest = "latest"
        wait = options.visible_minutes * 60 * SECOND
        offset = F.pmod(F.crc32(F.col("sale_id").cast("string").cast("binary")), F.lit(options.spread_seconds))
        self.sales = (
            sales.select(
                "sale_id", F.col("client_id").alias("client"), micros(sales, "sold_at").alias("sold"),
                (micros(sales, "arrived_at") + wait).alias("ready"), cents("total").alias("cents"),
            )
            .filter("client IS NOT NULL AND sold IS NOT NULL")
            .select(
                "sale_id", "client", "sold", "cents",
                F.when(F.col("ready").isNotNull(), F.greatest("sold", "ready")).alias("seen"),
                (F.col("sold") + F.coalesce(offset, F.lit(0)) * SECOND).alias("t"),
            )
        )
        # Equal clicks count once; their text takes part as a digest.
        known = clicks.filter("client_id IS NOT NULL AND ts IS NOT NULL AND arrived_at IS NOT NULL")
        whole = [F.sha2(F.col(f"`{c}`"), 256).alias(c) if c == "props" else F.col(f"`{c}`") for c in known.columns]
        self.clicks = known.select(*whole).distinct().select(
            F.col("client_id").alias("client"), "click_id", micros(clicks, "ts").alias("ts"),
            F.greatest(micros(clicks, "ts"), micros(clicks, "arrived_at") + wait).alias("seen"),
            F.coalesce((F.col("kind") == "purchase").cast("long"), F.lit(0).cast("long")).alias("bought"), cents("value").alias("cents"),
        )
        self.lines = lines.select(
            F.col("sale_id").alias("of_sale"), F.col("item_id").alias("item"), micros(lines, "shipped_at").alias("shipped"),
            cents("amount").alias("line_cents"),
        ).filter("of_sale IS NOT NULL AND shipped IS NOT NULL")

    def probes(self) -> DataFrame:
        return self.sales.select("sale_id", "client", "t")

    def _rows(self, df: DataFrame, values: dict[str, Column], latest: Column | None = None) -> DataFrame:
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("struct<ts:bigint,click_id:bigint>")
        columns = [values.get(c, zero).cast("long").alias(c) for c in self.sums]
        return df.select("client", "at", *columns, (none if latest is None else latest).alias(self.latest))

    def click_deltas(self) -> DataFrame:
        days = {d: d * DAY for d in self.windows}
        signs = {d: F.col("seen") < F.col("ts") + n for d, n in days.items()}
        changes = [(F.col("seen"), {f"x{d}": _flag(s) for d, s in signs.items()})]
        changes += [(F.col("ts") + days[d], {f"x{d}": _flag(s, -1)}) for d, s in signs.items()]
        rows = _unfold(self.clicks, changes, [f"x{d}" for d in self.windows])
        of = {"n_clicks": F.lit(1), "n_purchases": F.col("bought"), "click_cents": F.col("cents")}
        values = {f"{f}_{d}": F.col(f"x{d}") * c for d in self.windows for f, c in of.items()}
        return self._rows(rows, values, F.when(F.col("at") == F.col("seen"), F.struct("ts", "click_id")))

    def sale_deltas(self) -> DataFrame:
        days = {d: d * DAY for d in self.windows}
        signs = {d: F.col("seen") < F.col("sold") + n for d, n in days.items()}
        changes = [(F.col("seen"), {f"x{d}": _flag(s) for d, s in signs.items()})]
        changes += [(F.col("sold") + days[d], {f"x{d}": _flag(s, -1)}) for d, s in signs.items()]
        changes += [(F.col("sold") - self.options.label_days * DAY, {"ahead": F.lit(1)}), (F.col("sold"), {"ahead": F.lit(-1)})]
        rows = _unfold(self.sales, changes, [*(f"x{d}" for d in self.windows), "ahead"])
        of = {"n_sales": F.lit(1), "sale_cents": F.col("cents")}
        values = {f"{f}_{d}": F.col(f"x{d}") * c for d in self.windows for f, c in of.items()}
        return self._rows(rows, values | {"ahead": F.col("ahead")})

    def line_deltas(self) -> DataFrame:
        """Lines and, where no earlier line of the item still counts, items."""
        last = max(self.windows) * DAY
        begin = F.greatest("seen", "shipped")
        seen = self.sales.select("sale_id", "client", "sold", "seen").filter(F.col("seen") < F.col("sold") + last)
        found = (
            self.lines.join(seen, F.col("of_sale") == F.col("sale_id"))
            .filter(begin < F.col("sold") + last)
            .groupBy("client", "item", begin.alias("begin"), "sold")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("line_cents").alias("cents"))
        )
        block = self.options.block_seconds * SECOND
        found = materialise(found.withColumn("block", F.floor(F.col("begin") / F.lit(block)).cast("long")), "shop-lines")
        items = found.filter("item IS NOT NULL")
        earlier = Window.partitionBy("client", "item").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        opening = (
            items.groupBy("client", "item", "block").agg(F.max("sold").alias("top"))
            .select("client", "item", "block", F.max("top").over(earlier).alias("sold"))
            .filter("sold IS NOT NULL")
            .select("client", "item", (F.col("block") * block).alias("begin"), "sold", F.lit(0).cast("long").alias("n"),
                    F.lit(0).cast("long").alias("cents"), "block", F.lit(0).alias("kind"))
        )
        within = Window.partitionBy("client", "item", "block").orderBy("kind", "begin").rowsBetween(Window.unboundedPreceding, -1)
        covered = items.withColumn("kind", F.lit(1)).unionByName(opening).withColumn("top", F.max("sold").over(within)).filter("kind = 1")
        rows = covered.select("client", "item", "begin", "sold", "n", "cents", "top").unionByName(
            found.filter("item IS NULL").select("client", "item", "begin", "sold", "n", "cents", F.lit(None).cast("long").alias("top"))
        )
        starts: dict[str, Column] = {}
        changes: list[tuple[Column, dict[str, Column]]] = []
        for d in self.windows:
            end = F.col("sold") + d * DAY
            counts = F.col("begin") < end
            adds = counts & F.col("item").isNotNull() & F.coalesce(F.col("top") < F.col("sold"), F.lit(True))
            from_ = F.coalesce(F.col("top") + d * DAY, F.col("begin"))  # up to here an earlier line covers the item
            starts |= {f"l{d}": _flag(counts), f"i{d}": _flag(adds & (from_ <= F.col("begin")))}
            changes.append((from_, {f"i{d}": _flag(adds & (from_ > F.col("begin")))}))
            changes.append((end, {f"l{d}": _flag(counts, -1), f"i{d}": _flag(adds, -1)}))
        names = [f"{x}{d}" for d in self.windows for x in "li"]
        rows = _unfold(rows, [(F.col("begin"), starts), *changes], names)
        values = {}
        for d in self.windows:
            values |= {f"n_lines_{d}": F.col(f"l{d}") * F.col("n"), f"n_items_{d}": F.col(f"i{d}"), f"line_cents_{d}": F.col(f"l{d}") * F.col("cents")}
        return self._rows(rows, values)

    def deltas(self) -> DataFrame:
        """All deltas, one for each client and instant, but that of clicks which become the latest stands by itself."""
        sums = [F.sum(c).alias(c) for c in self.sums]
        clicks = self.click_deltas()
        rest = clicks.filter(F.col(self.latest).isNull()).unionByName(self.sale_deltas()).unionByName(self.line_deltas())
        none = F.lit(None).cast("struct<ts:bigint,click_id:bigint>").alias(self.latest)
        seen = clicks.filter(F.col(self.latest).isNotNull()).groupBy("client", "at").agg(*sums, F.max(self.latest).alias(self.latest))
        return rest.groupBy("client", "at").agg(*sums).select("*", none).unionByName(seen)


def point_in_time(sales: DataFrame, clicks: DataFrame, lines: DataFrame, options: FeatureOptions = FeatureOptions()) -> DataFrame:
    """For every sale and window: sale_id, d, t_us, label, counts, cents and the latest click."""
    shop = Shop(sales, clicks, lines, options)
    history = materialise(shop.deltas(), "shop-deltas")
    found = one_history(history, shop.probes(), "client", shop.sums, shop.latest, options.block_seconds, options.bin_seconds)
    of_window = [
        F.struct(
            F.lit(d).alias("d"),
            *[F.col(f"{f}_{d}").alias(f) for f in FEATURES],
            F.when(F.col("latest.ts") > F.col("t") - d * DAY, F.col("latest.click_id")).alias("last_click_id"),
        )
        for d in options.windows
    ]
    return found.select(
        "sale_id", F.col("t").alias("t_us"), (F.col("ahead") > 0).alias("label"), F.explode(F.array(*of_window)).alias("w")
    ).select(
        "sale_id", "w.d", "t_us", "label", "w.n_clicks", "w.n_purchases", "w.click_cents", "w.last_click_id",
        "w.n_sales", "w.sale_cents", "w.n_lines", "w.n_items", "w.line_cents",
    )
