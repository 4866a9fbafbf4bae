"""Event-study operators: session calendar, strict as-of alignment, forward returns, trailing Z-scores, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_MINUTES = 570  # 09:30, wall clock of the exchange
CLOSE_MINUTES = 960
#: Calendar days (of about 30 bytes) up to which the bridge from days to sessions is broadcast.
BRIDGE_DAYS = 200_000
#: Rows of a series that one window works on, beside those before it that it needs.
BLOCK = 4096


def bars(trades: DataFrame) -> DataFrame:
    """Daily bars of the weekdays: ``session, open, high, low, close, volume`` from ``day, key, price``."""
    days = trades.filter(F.weekday("day") < 5)
    return days.groupBy(F.col("day").alias("session")).agg(F.min_by("price", "key").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "key").alias("close"), F.count("*").alias("volume"))


def next_open(releases: DataFrame, sessions: DataFrame, at: int = OPEN_MINUTES) -> DataFrame:
    """``releases`` (``day``, ``minutes`` on the exchange's wall clock) with ``entry``: the first session whose open
    (the minute ``at``) is strictly after the release, null past the end. A table of the calendar's days turns it into an equi-join: it
    goes from the first session to the last, whatever the releases' days, so its ordered window and its size are
    bounded by the calendar. It is broadcast only if its days, counted first, are at most ``BRIDGE_DAYS``."""
    ends = sessions.agg(F.min("session").alias("first"), F.max("session").alias("last")).first()
    if ends["first"] is None:
        return releases.withColumn("entry", F.lit(None).cast("date"))
    first, last = (F.lit(d).cast("date") for d in ends)
    days = releases.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("_day")).join(sessions.select("session", F.col("session").alias("_day")), "_day", "left")
    ahead = Window.orderBy("_day")
    bridge = days.select("_day", F.first("session", True).over(ahead.rowsBetween(0, Window.unboundedFollowing)).alias("_here"), F.first("session", True).over(ahead.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    if (ends["last"] - ends["first"]).days < BRIDGE_DAYS:
        bridge = F.broadcast(bridge)
    found = releases.withColumn("_day", F.when(F.col("day") <= last, F.greatest("day", first)))
    early = (F.col("minutes") < at) | (F.col("_here") != F.col("day"))
    return found.join(bridge, "_day", "left").withColumn("entry", F.when(early, F.col("_here")).otherwise(F.col("_later"))).drop("_day", "_here", "_later")


def forward_returns(prices: DataFrame, horizons: tuple[int, ...] = (1, 3, 5, 10, 20), entry: str = "open", leave: str = "close") -> DataFrame:
    """Per session the return to ``leave`` of the h-th following session; null past the end."""
    order = Window.orderBy("session")  # bounded by the calendar
    return prices.select("session", *[(F.try_divide(F.lead(leave, h).over(order), F.col(entry)) - 1).alias(f"fwd_ret_{h}") for h in horizons])


def placed(series: DataFrame, key: str, order: list[str], part: Column) -> DataFrame:
    """Adds ``_pos``, the zero-based place of each row in its key's order, without a window over a whole key: ``part``
    (ascending with the order, such as the hour) is counted first, and rows are numbered within a part."""
    series = series.withColumn("_part", part)
    counts = series.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    counts = counts.select("_key", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1
    numbered = series.withColumn("_within", within)
    both = numbered.join(counts, numbered[key].eqNullSafe(counts["_key"]) & numbered["_part"].eqNullSafe(counts["_of"]))
    return both.withColumn("_pos", F.col("_before") + F.col("_within")).drop("_part", "_key", "_of", "_before", "_within")


def blocks(series: DataFrame, key: str, back: int, size: int = BLOCK) -> tuple[DataFrame, Window]:
    """``series`` (with ``_pos``) cut into blocks of ``size`` rows, each with copies of the ``back`` rows before it
    (``_own`` is false), and the window of a block: a series of any length is spread over many tasks."""
    size = max(size, back)
    block = F.floor(F.col("_pos") / size)
    both = F.when(F.col("_pos") % size >= size - back, F.array(block, block + 1)).otherwise(F.array(block))
    cut = series.withColumn("_block", F.explode(both)).withColumn("_own", F.col("_block") == block)
    return cut, Window.partitionBy(key, "_block").orderBy("_pos")


def own(cut: DataFrame) -> DataFrame:
    return cut.filter("_own").drop("_own", "_block", "_pos")


def zscores(series: DataFrame, key: str, order: list[str], value: str, window: int, over: Window | None = None) -> DataFrame:
    """Adds ``mu``, ``sigma`` and ``z`` of the ``window`` rows before each row of a key, itself excluded. ``over`` is
    the window of ``blocks``, for series too long for one task."""
    if window < 2:
        raise ValueError("a window holds two rows at least")
    past = (over or Window.partitionBy(key).orderBy(*order)).rowsBetween(-window, -1)
    full = F.count(value).over(past) == window
    series = series.withColumns({"mu": F.when(full, F.avg(value).over(past)), "sigma": F.when(full, F.stddev_samp(value).over(past))})
    return series.withColumn("z", F.when(F.col("sigma") > 0, (F.col(value) - F.col("mu")) / F.col("sigma")))


def zscores_by_join(series: DataFrame, key: str, value: str, window: int) -> DataFrame:
    """The same by another route, without windows, to check them by: each row (with ``_pos``) is sent to the ``window``
    places after it, where the values that arrive are summed up."""
    arriving = series.select(F.col(key).alias("_key"), F.col(value).alias("_value"), F.explode(F.sequence(F.col("_pos") + 1, F.col("_pos") + window)).alias("_at"))
    past = arriving.groupBy("_key", "_at").agg(F.count("_value").alias("_n"), F.avg("_value").alias("mu"), F.stddev_samp("_value").alias("sigma")).filter(F.col("_n") == window)
    both = series.join(past, series[key].eqNullSafe(past["_key"]) & (series["_pos"] == past["_at"]), "left").drop("_key", "_at", "_n")
    return both.withColumn("z", F.when(F.col("sigma") > 0, (F.col(value) - F.col("mu")) / F.col("sigma")))


def differing(one: DataFrame, other: DataFrame, keys: list[str], values: tuple[str, ...] = ("mu", "sigma", "z"), relative: float = 1e-10, absolute: float = 1e-12) -> DataFrame:
    """The rows in which two routes to the same values disagree beyond the tolerance, or of which one has no such row
    or value: ``keys`` and each value from both sides. Nulls equal each other."""
    both = one.select(*keys, *[F.col(v).alias(f"{v}_one") for v in values], F.lit(True).alias("_one"))
    both = both.join(other.select(*keys, *[F.col(v).alias(f"{v}_other") for v in values], F.lit(True).alias("_other")), keys, "full_outer")
    bad = F.col("_one").isNull() | F.col("_other").isNull()
    for v in values:
        a, b = F.col(f"{v}_one"), F.col(f"{v}_other")
        bad = bad | (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > absolute + relative * F.abs(b), F.lit(False))
    return both.filter(bad).drop("_one", "_other")


def assert_backward(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``one`` itself; Z-scores that another route, which sees the rows before each alone, doesn't give are an error."""
    if bad := differing(one, other, keys).limit(3).collect():
        raise AssertionError(f"Z-scores of two routes differ: {bad}")
    return one


def positions(z: Column, theta: float, sign: int = 1) -> Column:
    """``sign`` above ``theta``, ``-sign`` below ``-theta``, else 0; null counts as 0."""
    if sign not in (1, -1):
        raise ValueError("sign is 1 or -1")
    return F.when(z > theta, sign).when(z < -theta, -sign).otherwise(0)


def turnover(df: DataFrame, key: str, order: list[str], over: Window | None = None) -> DataFrame:
    """Adds the absolute change of ``position``; a key's first row starts from 0."""
    return df.withColumn("turnover", F.abs(F.col("position") - F.lag("position", 1, 0).over(over or Window.partitionBy(key).orderBy(*order))))


def signs(hypothesis: str) -> int:
    """The sign that a named hypothesis gives to a high score."""
    known = {"dovish_surprise_bullish": 1, "dovish_surprise_bearish": -1}
    if hypothesis not in known:
        raise ValueError(f"unknown hypothesis {hypothesis}")
    return known[hypothesis]
