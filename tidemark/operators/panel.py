"""The event panel: release instants, the counted funnel, the leak assertions, overlap and coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from tidemark.functions import text as T
from tidemark.operators import events as E
from tidemark.operators import scans as S
from tidemark.sources.stages import first_of, staged

ZONE = "America/New_York"
DEFAULT_MINUTES = 14 * 60
SOURCES = ("manual_override", "parsed_from_document", "scheduled_default")


def instant(day: Column, minutes: Column, zone: str = ZONE) -> Column:
    """The instant of a wall-clock time of ``zone``, with its daylight-saving rules."""
    return F.make_timestamp_ltz(F.year(day), F.month(day), F.day(day), F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"), F.lit(0), F.lit(zone))


def resolved_releases(docs: DataFrame, overrides: dict[str, int] | None = None, default: int = DEFAULT_MINUTES) -> DataFrame:
    """``docs`` (``doc_date, text``) with ``parsed_minutes``, ``release_minutes``, ``release_time_source`` and the
    instant ``release``: an override of the date goes before the time that the text states, that before the default.
    What the text states is kept even where it is overridden; without a text nothing is parsed."""
    if default <= E.OPEN_MINUTES:
        raise ValueError("the default release time must be after the session's open, so that an unknown time is never early")
    parsed, known = T.release_minutes(F.col("text")), F.lit(None).cast("int")
    if overrides:
        pairs = [F.lit(x) for day, minutes in sorted(overrides.items()) for x in (day, minutes)]
        known = F.try_element_at(F.create_map(*pairs), F.col("doc_date").cast("string"))
    docs = docs.withColumn("parsed_minutes", parsed).withColumn("_known", known)
    source = F.when(F.col("_known").isNotNull(), SOURCES[0]).when(F.col("parsed_minutes").isNotNull(), SOURCES[1]).otherwise(SOURCES[2])
    docs = docs.withColumns({"release_minutes": F.coalesce("_known", "parsed_minutes", F.lit(default)), "release_time_source": source})
    return docs.drop("_known").withColumn("release", instant(F.col("doc_date"), F.col("release_minutes")))


def zoned(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself; a time without a zone is an error, not a guess."""
    if isinstance(df.schema[name].dataType, TimestampNTZType):
        raise ValueError(f"{name} has no time zone")
    return df


def local(release: Column, zone: str = ZONE) -> Column:
    """The wall clock of ``zone`` at an instant, whatever the session's own zone: its microseconds are counted on from
    1970 in UTC, not read off the session's clock, which shows two instants alike when summer time ends."""
    seconds = (F.unix_micros(release.cast("timestamp")).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    none = F.lit(0)
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(none, none, none, seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def next_open(df: DataFrame, sessions: DataFrame, release: str = "release", zone: str = ZONE, minute: int = E.OPEN_MINUTES) -> DataFrame:
    """``df`` with ``entry``: the first session whose open (or another ``minute`` of its day) is strictly after the
    instant ``release``."""
    at = local(F.col(release), zone)
    wall = zoned(df, release).withColumns({"day": F.to_date(at), "minutes": (F.hour(at) * 60 + F.minute(at) + F.when(F.second(at) + F.date_part(F.lit("SECOND"), at) > 0, 0.5).otherwise(0.0))})
    return E.next_open(wall, sessions, minute).drop("day", "minutes")


def funnel_steps(start: str, scheduled_only: bool) -> dict[str, Column]:
    """The panel's filters in order, each with its name in the count."""
    return {
        "statements": F.col("doc_type") == "statement",
        "after_dropping_flagged": ~F.col("is_flagged"),
        "after_sample_start": F.col("doc_date") >= F.lit(start).cast("date"),
        "after_unscheduled_filter": F.coalesce("is_scheduled", F.lit(False)) if scheduled_only else F.lit(True),
    }


def funnel(docs: DataFrame, start: str, scheduled_only: bool = False) -> DataFrame:
    """``step, n`` of each filter and of the resolved entries, counted in one pass."""
    so_far, counts = F.lit(True), {"discovered": F.count("*")}
    for name, keep in {**funnel_steps(start, scheduled_only), "with_entry_date": F.col("entry").isNotNull()}.items():
        so_far = so_far & F.coalesce(keep, F.lit(False))
        counts[name] = F.count_if(so_far)
    return docs.agg(*[c.alias(n) for n, c in counts.items()]).unpivot([], list(counts), "step", "n")


def to_score(docs: DataFrame, start: str) -> DataFrame:
    """The documents that are scored: statements that aren't flagged, from the sample's start on. Unscheduled ones are
    scored too, so that whether the panel takes them can be chosen later."""
    steps = funnel_steps(start, False)
    return docs.filter(steps["statements"] & steps["after_dropping_flagged"] & steps["after_sample_start"])


def panel(docs: DataFrame, prices: DataFrame, start: str, scheduled_only: bool = False, horizons: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """The rows of ``docs`` (with ``entry``) that pass the funnel, without their texts, with forward returns."""
    for keep in funnel_steps(start, scheduled_only).values():
        docs = docs.filter(keep)
    returns = E.forward_returns(prices, horizons).withColumnRenamed("session", "entry")
    return docs.drop("text").join(returns, "entry", "left")


def leaks(df: DataFrame, sessions: DataFrame, release: str = "release", zone: str = ZONE) -> DataFrame:
    """The rows that break the guard, with ``why``: the entry's open isn't after the release, or the entry is no session."""
    have = zoned(df, release).filter(F.col("entry").isNotNull())
    early = have.filter(instant(F.col("entry"), F.lit(E.OPEN_MINUTES), zone) <= F.col(release)).withColumn("why", F.lit("not_after_release"))
    return early.unionByName(have.join(sessions.select(F.col("session").alias("entry")), "entry", "left_anti").withColumn("why", F.lit("not_a_session")))


def assert_no_leaks(df: DataFrame, sessions: DataFrame, release: str = "release") -> DataFrame:
    if bad := leaks(df, sessions, release).limit(5).collect():
        raise AssertionError(f"look-ahead: {bad}")
    return df


def calendar(sessions: DataFrame) -> DataFrame:
    """``session, pos``: the place of each session. One row per session, so the ordered window is bounded by the calendar."""
    return sessions.select("session").withColumn("pos", F.row_number().over(Window.orderBy("session")) - 1)


def event_gaps(entries: DataFrame, sessions: DataFrame) -> DataFrame:
    """``first, second, gap`` of consecutive distinct entries, in sessions; entries that are no session don't count."""
    placed = entries.filter(F.col("entry").isNotNull()).select(F.col("entry").alias("session")).distinct().join(calendar(sessions), "session")
    order = Window.orderBy("pos")  # at most one row per session
    return placed.select(F.lag("session").over(order).alias("first"), F.col("session").alias("second"), (F.col("pos") - F.lag("pos").over(order)).alias("gap")).filter("first is not null")


def overlaps(entries: DataFrame, sessions: DataFrame, horizons: list[int]) -> DataFrame:
    """``h, first, second, gap`` of the neighbours whose windows of ``h`` sessions overlap."""
    return event_gaps(entries, sessions).withColumn("h", F.explode(F.array(*map(F.lit, horizons)))).filter("gap < h").select("h", "first", "second", "gap")


def gap_summary(entries: DataFrame, sessions: DataFrame) -> DataFrame:
    """``n_events, min_gap, median_gap, max_gap``; one event alone has no gap."""
    gaps = staged(event_gaps(entries, sessions).select("gap"), "gaps")
    middle = S.quantiles(gaps, [], "gap", [0.5]).select(F.get("q", F.lit(0)).alias("median_gap"))
    return entries.agg(F.count_distinct("entry").alias("n_events")).join(gaps.agg(F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"))).join(middle)


def release_lags(df: DataFrame, release: str = "release", zone: str = ZONE) -> DataFrame:
    """Hours from release to the entry's open: least, median and most, and how many entered the session of the day itself."""
    have = df.filter(F.col("entry").isNotNull())
    hours = (F.unix_micros(instant(F.col("entry"), F.lit(E.OPEN_MINUTES), zone)) - F.unix_micros(release)) / 3.6e9
    lags = staged(have.select(hours.alias("hours"), (F.to_date(local(F.col(release), zone)) == F.col("entry")).alias("same")), "lags")
    middle = S.quantiles(lags, [], "hours", [0.5]).select(F.get("q", F.lit(0)).alias("median_hours"))
    found = lags.agg(F.count("*").alias("n"), F.min("hours").alias("min_hours"), F.max("hours").alias("max_hours"), F.count_if("same").alias("same_session"))
    return found.join(middle)


def return_coverage(df: DataFrame, horizons: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """Per horizon how many returns are there and missing, their mean and standard deviation."""
    long = df.unpivot([], [f"fwd_ret_{h}" for h in horizons], "horizon", "ret")
    return long.groupBy("horizon").agg(F.count("ret").alias("n_present"), F.count_if(F.col("ret").isNull()).alias("n_null"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"))


def entry_returns(docs: DataFrame, prices: DataFrame, horizon: int) -> DataFrame:
    """``docs`` (with ``release``) with the return over ``horizon`` sessions of both rules of entry: ``ret_next_trading_open``
    from the first open strictly after the release, ``ret_same_day_close`` from the first close (16:00) strictly after
    it, which for a release of the trading day is that day's own. Both leave at a later session's close."""
    for rule, price, minute in (("next_trading_open", "open", E.OPEN_MINUTES), ("same_day_close", "close", E.CLOSE_MINUTES)):
        returns = E.forward_returns(prices, (horizon,), price).select(F.col("session").alias("entry"), F.col(f"fwd_ret_{horizon}").alias(f"ret_{rule}"))
        docs = next_open(docs, prices, minute=minute).join(returns, "entry", "left").drop("entry")
    return docs


def with_sentences(panel_: DataFrame, scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """The panel without the documents in which no sentence was found. Those that weren't scored at all stay: they are
    an error of the merge."""
    return panel_.join(scores.filter("n_sentences = 0").select(key), key, "left_anti")


def merged_scores(panel_: DataFrame, scores: DataFrame, key: str = "doc_id", score: str = "s_prob") -> DataFrame:
    """``panel_`` with the scores of its keys. Keys that repeat on either side, or rows without a score, are an error."""
    for side, df in (("panel", panel_), ("scores", scores)):
        if twice := df.groupBy(key).count().filter("count > 1").limit(3).collect():
            raise AssertionError(f"{key} repeats in {side}: {twice}")
    out = panel_.join(scores, key, "left")
    if lost := out.filter(F.col(score).isNull()).limit(3).collect():
        raise AssertionError(f"rows without a score: {lost}")
    return out


def signalled(df: DataFrame, score: str, order: list[str], window: int, theta: float, sign: int = 1) -> DataFrame:
    """``df`` with ``S``, ``mu, sigma, z``, ``position`` and ``turnover`` of one chronological series of any length, in
    blocks of its rows. ``order`` begins with a date."""
    rows = E.placed(df.withColumns({"S": F.col(score), "series": F.lit("all")}), "series", order, F.col(order[0]))
    cut, over = E.blocks(rows, "series", window + 1)
    z = E.zscores(cut, "series", [], "S", window, over).withColumn("position", E.positions(F.col("z"), theta, sign))
    return E.own(E.turnover(z, "series", [], over)).drop("series")


def signal(panel_: DataFrame, scores: DataFrame, order: list[str], window: int, theta: float, sign: int = 1, primary: str = "s_prob", key: str = "doc_id") -> DataFrame:
    """The signal of the panel's rows by their primary score, behind the guards of ``merged_scores``."""
    return signalled(merged_scores(panel_, scores, key, primary), primary, order, window, theta, sign)


def documents_table(discovery: DataFrame, bodies: DataFrame, overrides: dict[str, int] | None = None, least: int = 500, key: str = "raw_path") -> DataFrame:
    """Every discovered row of the wanted types with its parsed text, flags and release. A row whose file is missing
    stays, flagged, with an empty text; flagged rows are kept, so that parsed and flagged rows sum to all."""
    rows = discovery.filter(F.col("doc_type").isin("statement", "minutes")).join(bodies.select(key, "text", "selector_used"), key, "left")
    missing, error = F.col("selector_used").isNull(), T.is_error_page(F.col("text"))
    rows = resolved_releases(rows, overrides).withColumns({"is_error_page": error & ~missing, "is_flagged": missing | error | (F.length("text") < least)})
    return rows.withColumns({"text": F.coalesce("text", F.lit("")), "n_chars": F.coalesce(F.length("text"), F.lit(0)), "selector_used": F.coalesce("selector_used", F.lit("MISSING_FILE"))})


def first_sessions(prices: DataFrame, at: str, *order: str) -> DataFrame:
    """One row of each day of ``at`` (a time or day, without its clock), as ``session``: the first by ``order``. A null
    day is no session."""
    rows = prices.withColumn("session", F.to_date(at)).filter(F.col("session").isNotNull())
    return first_of(rows if at == "session" else rows.drop(at), "session", *order)


def complete_prices(prices: DataFrame) -> DataFrame:
    """The rows that have both an open and a close."""
    return prices.na.drop(subset=["open", "close"])


def checked_calendar(prices: DataFrame, day: str = "session") -> DataFrame:
    """``prices`` itself; days that are null or repeat are an error."""
    if bad := prices.groupBy(day).count().filter(F.col(day).isNull() | (F.col("count") > 1)).limit(3).collect():
        raise ValueError(f"the calendar repeats or lacks days: {bad}")
    return prices


def edges(rows: DataFrame, order: str, n: int = 3) -> DataFrame:
    """The first and the last ``n`` rows by ``order``."""
    return rows.orderBy(order).limit(n).unionByName(rows.orderBy(F.col(order).desc()).limit(n)).distinct()
