"""Queries over the event panel and its signal, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import asof
from tidemark.operators import evaluation as V
from tidemark.operators import grid as G
from tidemark.operators import events as E
from tidemark.operators import panel as P
from tidemark.operators import scans as S
from tidemark.plans import planted
from tidemark.sources import stages
from tidemark.sources.stages import fresh_dir, staged

HORIZONS = (1, 3, 5, 10, 20)
RETURNS = [f"fwd_ret_{h}" for h in HORIZONS]
START, MIN_TEXT_CHARS = "1995-06-01", 500
#: Release times set by hand (minutes of the day in the exchange's zone).
OVERRIDES = {"1995-01-02": 420, "1995-02-08": 1020, "1995-07-06": 570}
LOOKBACK, THETA = 6, 1.0
#: The grid of the robustness report.
LOOKBACKS, THETAS, SCORES = [6, 12], [0.5, 1.0, 1.5], ["s_prob", "s_count"]
ENTRIES, STARTS, UNSCHEDULED = ["next_trading_open", "same_day_close"], ["1997-01-01", "1995-06-01"], [True, False]
ERAS = ((1994, 1996), (1996, 1998), (1998, 2000), (2000, 2002))
BINS, ROUNDS = 12, 10_000
SPOTS = ("1995-01-02", "1995-02-08", "1995-07-06", "1996-01-07")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return E.bars(orders.select(F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price")))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as statements and minutes. The table has no dates and types: they follow from the id."""
    docs = planted.texts(spark, sf)
    error = T.is_error_page(F.col("text"))
    return docs.withColumns({
        "doc_date": F.date_add(F.lit("1995-01-02").cast("date"), (F.col("doc_id") * 37 % 2420).cast("int")),
        "doc_type": F.when(F.col("doc_id") % 4 == 3, "minutes").otherwise("statement"),
        "is_error_page": error, "is_flagged": error | (F.length(F.coalesce("text", F.lit(""))) < MIN_TEXT_CHARS), "is_scheduled": T.is_scheduled(F.col("text")),
    })


def released(spark: SparkSession, sf: str) -> DataFrame:
    return P.next_open(P.resolved_releases(documents(spark, sf), OVERRIDES), bars(spark, sf))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return P.panel(released(spark, sf), bars(spark, sf), START)


def scores(spark: SparkSession, sf: str, start: str = START) -> DataFrame:
    """The scores of the documents that the panel can take: the filter of the funnel, but for the schedule."""
    docs = P.to_score(documents(spark, sf), start).select("doc_id", "text")
    return V.document_scores(docs, V.scored_sentences(docs))


def scored_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The panel with its scores: one of each document, and none without; both are worked out once."""
    rows, found = staged(panel(spark, sf), "panel"), staged(scores(spark, sf), "scores")
    return P.merged_scores(P.with_sentences(rows, found), found)


def signalled(spark: SparkSession, sf: str) -> DataFrame:
    return P.signalled(scored_panel(spark, sf), "s_prob", ["doc_date", "doc_id"], LOOKBACK, THETA)


def rounded(df: DataFrame, *names: str, to: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, to) for n in names})


def release_resolution(spark: SparkSession, sf: str) -> DataFrame:
    found = P.resolved_releases(documents(spark, sf), OVERRIDES)
    return found.select("doc_id", "parsed_minutes", "release_minutes", "release_time_source", F.unix_seconds("release").alias("release_epoch"))


def panel_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return P.funnel(released(spark, sf), START)


def scheduled_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """The funnel that takes scheduled meetings only; unknown ones go."""
    return P.funnel(released(spark, sf), START, scheduled_only=True)


def event_panel(spark: SparkSession, sf: str) -> DataFrame:
    found = panel(spark, sf).select("doc_id", F.col("entry").cast("string").alias("entry"), *RETURNS)
    return rounded(found, *RETURNS, to=8)


def leak_violations(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows the guard covers, and how many break it (none)."""
    rows = released(spark, sf)
    bad = P.leaks(rows, bars(spark, sf)).agg(F.count_if(F.col("why") == "not_after_release").alias("n_not_after"), F.count_if(F.col("why") == "not_a_session").alias("n_no_session"))
    return rows.agg(F.count("entry").alias("n_entries")).join(bad)


def event_overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    found = P.overlaps(released(spark, sf).filter("doc_id % 50 = 0"), bars(spark, sf), list(HORIZONS))
    return found.select("h", F.col("first").cast("string").alias("first"), F.col("second").cast("string").alias("second"), "gap")


def event_gap_summary(spark: SparkSession, sf: str) -> DataFrame:
    return P.gap_summary(released(spark, sf), bars(spark, sf))


def release_lag_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.release_lags(released(spark, sf)), "min_hours", "median_hours", "max_hours")


def return_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.return_coverage(panel(spark, sf)), "mean", "sd")


def composition(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by type, schedule and source of the release time; unknown is a value."""
    rows = P.resolved_releases(documents(spark, sf), OVERRIDES).select("doc_type", F.col("is_scheduled").cast("string").alias("is_scheduled"), "release_time_source")
    return rows.unpivot([], rows.columns, "facet", "value").groupBy("facet", F.coalesce("value", F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))


def documents_per_year(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).groupBy("doc_type", F.year("doc_date").alias("year")).agg(F.count("*").alias("n"))


def parse_identity(spark: SparkSession, sf: str) -> DataFrame:
    found = documents(spark, sf).agg(F.count("*").alias("n_total"), F.count_if(~F.col("is_flagged")).alias("n_parsed"), F.count_if("is_flagged").alias("n_flagged"), F.count_if("is_error_page").alias("n_error_pages"))
    return found.withColumn("holds", F.col("n_total") == F.col("n_parsed") + F.col("n_flagged"))


def price_summary(spark: SparkSession, sf: str) -> DataFrame:
    years = F.datediff(F.max("session"), F.min("session")) / 365.25
    return bars(spark, sf).agg(F.count("*").alias("n_sessions"), F.min("session").cast("string").alias("first"), F.max("session").cast("string").alias("last"), F.round(years, 6).alias("years"), F.round(F.count("*") / years, 6).alias("per_year"), F.bool_or(F.col("open").isNull() | F.col("close").isNull()).alias("any_null"))


def spot_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of a few dates that plain date arithmetic gets wrong."""
    wanted = spark.createDataFrame([(d,) for d in SPOTS], "day string").select(F.col("day").cast("date").alias("doc_date"))
    found = released(spark, sf).join(F.broadcast(wanted), "doc_date", "left_semi")
    return found.select("doc_id", F.col("doc_date").cast("string").alias("doc_date"), F.col("entry").cast("string").alias("entry"), (F.to_date(P.local(F.col("release"))) == F.col("entry")).alias("same_session"))


def asof_instants(spark: SparkSession, sf: str) -> DataFrame:
    """Entries where every session has hours of its own: some open at 13:00."""
    hours = bars(spark, sf).select("session", F.when(F.dayofmonth("session") % 9 == 1, 780).otherwise(E.OPEN_MINUTES).alias("open_minutes"))
    docs = documents(spark, sf).select("doc_id", "doc_date", "text")
    found = asof.next_open(P.resolved_releases(docs, OVERRIDES).select("doc_id", "release"), hours)
    return found.select("doc_id", F.col("entry").cast("string").alias("entry"))


def previous_purchase(spark: SparkSession, sf: str) -> DataFrame:
    """For each event the last purchase of its user before it."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts", "event_type")
    bought = events.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought_at"), F.col("event_id").alias("purchase_id"))
    return asof.joined(events.drop("event_type"), bought, "ts", "bought_at", ["purchase_id"], ["user_id"], forward=False).select("event_id", "purchase_id")


def document_signal(spark: SparkSession, sf: str) -> DataFrame:
    found = signalled(spark, sf)
    return rounded(found.select("doc_id", "S", "mu", "sigma", "z", "position", "turnover"), "S", "mu", "sigma", "z")


def z_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Equal bins between the least and the greatest Z, which falls into the last."""
    z = signalled(spark, sf).filter("z is not null").select(F.round("z", 6).alias("z"))
    ends = z.agg(F.min("z").alias("a"), F.max("z").alias("b"))
    place = F.least(F.floor((F.col("z") - F.col("a")) * BINS / F.nullif(F.col("b") - F.col("a"), F.lit(0.0))), F.lit(BINS - 1))
    return z.join(F.broadcast(ends)).groupBy(F.coalesce(place, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))


def top_surprises(spark: SparkSession, sf: str) -> DataFrame:
    z = signalled(spark, sf).filter("z is not null").select("doc_id", F.round("z", 6).alias("z"), "position")
    return z.orderBy(F.abs("z").desc(), "doc_id").limit(10)


def era_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Score and Z by era; an era leaves its first year out and takes its last in."""
    rows, era = signalled(spark, sf).filter("z is not null").withColumn("year", F.year("doc_date")), F.when(F.lit(False), "")
    for a, b in ERAS:
        era = era.when((F.col("year") > a) & (F.col("year") <= b), f"{a + 1}-{b}")
    got = rows.withColumn("era", era).filter("era is not null").groupBy("era").agg(F.count("*").alias("n"), F.avg("S").alias("s_mean"), F.avg("z").alias("z_mean"), F.stddev_samp("z").alias("z_sd"))
    return rounded(got, "s_mean", "z_mean", "z_sd")


def score_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows of the panel have a score, no sentence, or no row among the scores (none)."""
    rows = panel(spark, sf).select("doc_id").join(scores(spark, sf).select("doc_id", "n_sentences", "s_prob"), "doc_id", "left")
    return rows.agg(F.count("*").alias("n_panel"), F.count("s_prob").alias("n_scored"), F.count_if(F.col("n_sentences") == 0).alias("n_without_sentences"), F.count_if(F.col("n_sentences").isNull()).alias("n_not_scored"))


def robustness_grid(spark: SparkSession, sf: str) -> DataFrame:
    """All six axes: score, sample start, unscheduled releases, lookback, threshold and entry. The texts are scored
    once; a series is a score, a start and whether it takes unscheduled releases."""
    docs = documents(spark, sf)
    first = min(STARTS)
    found = staged(scores(spark, sf, first).filter("n_sentences > 0").select("doc_id", *SCORES), "grid-scores")
    rows = P.resolved_releases(P.to_score(docs, first), OVERRIDES).select("doc_id", "doc_date", "is_scheduled", "release")
    base = P.entry_returns(rows, bars(spark, sf), 1).join(found, "doc_id")
    series = G.crossed(base, sample_start=STARTS, include_unscheduled=UNSCHEDULED)
    series = series.filter((F.col("doc_date") >= F.col("sample_start").cast("date")) & (F.col("include_unscheduled") | F.coalesce("is_scheduled", F.lit(False))))
    returns = [f"ret_{e}" for e in ENTRIES]
    series = series.unpivot(["doc_id", "doc_date", "sample_start", "include_unscheduled", *returns], SCORES, "score", "S")
    series = series.withColumn("series", F.concat_ws("/", "score", "sample_start", "include_unscheduled"))
    cells = G.trailing_signals(series, "series", ["doc_date", "doc_id"], F.col("doc_date"), "S", LOOKBACKS, THETAS)
    axes = ["score", "sample_start", "include_unscheduled", "lookback", "theta"]
    each = cells.unpivot([*axes, "z", "position", "turnover"], returns, "entry", "ret").withColumn("entry", F.substring("entry", 5, 100))
    return rounded(G.per_cell(each, [*axes, "entry"], "ret"), "mean_ret")


def ic_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Both scores against all horizons, in one job."""
    rows = scored_panel(spark, sf).select(*[F.round(c, 8).alias(c) for c in (*SCORES, *RETURNS)])
    long = rows.unpivot(RETURNS, list(SCORES), "score", "value").unpivot(["score", "value"], RETURNS, "horizon", "fwd").withColumn("pair", F.concat_ws("/", "score", "horizon"))
    got = V.power(V.correlations(long, "pair", "value", "fwd")).withColumn("p", V.p_value("t", "n"))
    return rounded(got, "ic", "pearson", "t", "p", "mde", "n_needed", "ir", to=5)


def session_moves(spark: SparkSession, sf: str) -> DataFrame:
    rows = bars(spark, sf)
    return rows.select("session", F.round(F.col("close") / F.col("open") - 1, 8).alias("move")).join(E.forward_returns(rows), "session").withColumns({c: F.round(c, 8) for c in RETURNS})


def ic_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.bootstrap(session_moves(spark, sf), "move", "fwd_ret_1", "session", ROUNDS), "low", "high")


def hac_standard_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Of the mean forward return of each horizon, whose windows overlap by the horizon less one."""
    long = session_moves(spark, sf).unpivot(["session"], RETURNS, "horizon", "ret")
    return rounded(V.hac_errors(long, "horizon", "ret", "session", F.regexp_extract("horizon", r"\d+", 0).cast("int") - 1), "mean", "se")


def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Per session the mean of the session returns before it: what was known then."""
    rows = S.expanding(session_moves(spark, sf).select("session", "move"), [], ["session"], "move")
    return rounded(rows.select(F.col("session").cast("string").alias("session"), F.col("n_before").alias("n"), F.col("mean_before").alias("mean")), "mean")


def zscore_by_join(spark: SparkSession, sf: str) -> DataFrame:
    """The Z-scores of all events by the route without windows; must equal those by windows."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "ts", "value")
    rows = E.placed(events, "event_type", ["ts", "event_id"], F.date_trunc("hour", "ts"))
    return rounded(E.zscores_by_join(rows, "event_type", "value", LOOKBACK).select("event_id", "mu", "sigma", "z"), "mu", "sigma", "z")


def zscore_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How many events both routes to the Z-scores give, and in how many of them they differ (none)."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "ts", "value")
    rows = E.placed(events, "event_type", ["ts", "event_id"], F.date_trunc("hour", "ts"))
    cut, over = E.blocks(rows, "event_type", LOOKBACK)
    one, other = E.own(E.zscores(cut, "event_type", [], "value", LOOKBACK, over)), E.zscores_by_join(rows, "event_type", "value", LOOKBACK)
    return one.agg(F.count("*").alias("n"), F.count("z").alias("n_usable")).join(E.differing(one, other, ["event_id"]).agg(F.count("*").alias("n_different")))


def stage_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The document scores and the panel written as stage tables, CSV and Parquet, and read back with pinned types."""
    rows, found = staged(panel(spark, sf), "panel"), staged(scores(spark, sf), "scores")
    folder = fresh_dir(spark, "stages")
    scored = rows.select("doc_id", "doc_date", "is_scheduled").join(found, "doc_id").withColumn("n_chars", F.lit(0))
    stages.write(scored, "doc_scores", f"{folder}/scores", "doc_date")
    stages.write(rows.select("doc_id", "doc_type", "doc_date", F.lit(None).alias("url"), "is_scheduled", F.lit(None).alias("raw_path"), F.lit(0).alias("n_chars"), F.lit(None).alias("selector_used"), F.col("release").alias("release_datetime"), "release_time_source", F.col("parsed_minutes").cast("string").alias("parsed_release_time"), "is_error_page", "is_flagged", F.col("entry").alias("entry_date"), *RETURNS), "panel", f"{folder}/panel", "doc_date", "doc_id")
    both = stages.read(spark, "panel", f"{folder}/panel").join(stages.read(spark, "doc_scores", f"{folder}/scores").drop("doc_date", "is_scheduled", "n_chars"), "doc_id")
    found = both.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("doc_date").cast("string").alias("doc_date"), "is_scheduled", F.unix_seconds("release_datetime").alias("release_epoch"), "fwd_ret_5", "n_sentences", F.col("S_prob").alias("s_prob"))
    return rounded(found, "fwd_ret_5", "s_prob")


def documents_table(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as if read from files, of which some are missing and some were never wanted."""
    docs = documents(spark, sf).withColumn("raw_path", F.concat(F.lit("d"), "doc_id"))
    kind = F.when(F.col("doc_id") % 17 == 0, "transcript").otherwise(F.col("doc_type"))
    bodies = docs.filter("doc_id % 13 != 0").select("raw_path", T.clean_text(F.col("text")).alias("text"), F.lit("file").alias("selector_used"))
    found = P.documents_table(docs.select("doc_id", "raw_path", "doc_date", kind.alias("doc_type")), bodies, OVERRIDES, MIN_TEXT_CHARS)
    return found.select("doc_id", "doc_type", "selector_used", "n_chars", "is_error_page", "is_flagged", "release_minutes", "release_time_source")


def price_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions whose open or close is missing (here: below a floor) and what is left of them."""
    rows = bars(spark, sf).withColumn("open", F.when(F.col("open") >= 20_000, F.col("open")))
    left = P.checked_calendar(P.complete_prices(rows)).agg(F.count("*").alias("n_kept"), F.max("session").cast("string").alias("last"))
    return rows.agg(F.count("*").alias("n_sessions"), F.count_if(F.col("open").isNull()).alias("n_dropped")).join(left)


def first_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Of the orders of each day, whose times differ, the first one stands for the session."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderdate", "o_totalprice")
    found = P.first_sessions(orders, "o_orderdate", "o_orderkey")
    return found.select(F.col("session").cast("string").alias("session"), "o_orderkey", "o_totalprice")


def session_edges(spark: SparkSession, sf: str) -> DataFrame:
    return P.edges(bars(spark, sf), "session").select(F.col("session").cast("string").alias("session"), "open", "close", "volume")


QUERIES = {f.__name__: f for f in (zscore_agreement, stage_round_trip, first_trades, score_coverage, scheduled_funnel, asof_instants, previous_purchase, documents_table, price_quality, session_edges, release_resolution, panel_funnel, event_panel, leak_violations, event_overlap_pairs, event_gap_summary, release_lag_stats, return_coverage, composition, documents_per_year, parse_identity, price_summary, spot_checks, document_signal, z_histogram, top_surprises, era_buckets, robustness_grid, ic_grid, ic_bootstrap_ci, hac_standard_errors, walk_forward, zscore_by_join)}

BARS = """bars AS (SELECT CAST(o_orderdate AS DATE) AS session, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS "close", count(*) AS volume
  FROM orders WHERE isodow(o_orderdate) <= 5 GROUP BY 1),
f AS (SELECT session, """ + ", ".join(f'lead("close", {h}) OVER (ORDER BY session) / open - 1 AS fwd_ret_{h}' for h in HORIZONS) + " FROM bars)"  # fmt: skip
DOC_STEPS = r"""d0 AS (SELECT doc_id, text, DATE '1995-01-02' + CAST(doc_id * 37 % 2420 AS INTEGER) AS doc_date, CASE WHEN doc_id % 4 = 3 THEN 'minutes' ELSE 'statement' END AS doc_type,
  regexp_matches(lower(substr(coalesce(text, ''), 1, 600)), 'page not found|the page you were looking for has been moved|no longer exists') AS is_error_page,
  regexp_extract(substr(text, 1, 1500), '(?i)for\s+release\s+at\s+(\d{1,2})[:.](\d{2})\s*([ap])\.?\s*m\.?', ['h', 'm', 'p']) AS r,
  CASE WHEN regexp_matches(lower(text), 'conference call|unscheduled|notation vote|videoconference') THEN FALSE WHEN contains(lower(text), 'meeting') THEN TRUE END AS is_scheduled FROM pd),
d1 AS (SELECT *, is_error_page OR length(coalesce(text, '')) < 500 AS is_flagged,
  CASE WHEN TRY_CAST(r.h AS INTEGER) BETWEEN 1 AND 12 AND TRY_CAST(r.m AS INTEGER) < 60 THEN CAST(TRY_CAST(r.h AS INTEGER) % 12 * 60 + TRY_CAST(r.m AS INTEGER) + CASE WHEN lower(r.p) = 'p' THEN 720 ELSE 0 END AS INTEGER) END AS parsed_minutes,
  CASE CAST(doc_date AS VARCHAR) WHEN '1995-01-02' THEN 420 WHEN '1995-02-08' THEN 1020 WHEN '1995-07-06' THEN 570 END AS known FROM d0),
d2 AS (SELECT *, CAST(coalesce(known, parsed_minutes, 840) AS INTEGER) AS release_minutes, CASE WHEN known IS NOT NULL THEN 'manual_override' WHEN parsed_minutes IS NOT NULL THEN 'parsed_from_document' ELSE 'scheduled_default' END AS release_time_source FROM d1),
d AS (SELECT *, timezone('America/New_York', CAST(doc_date AS TIMESTAMP) + to_minutes(release_minutes)) AS release FROM d2)"""
DOCS = f"{planted.TEXTS}, {DOC_STEPS}"
RELEASED = f"""{BARS}, {DOCS}, o AS (SELECT session, timezone('America/New_York', CAST(session AS TIMESTAMP) + INTERVAL 570 MINUTE) AS opens FROM bars),
rel AS (SELECT d.*, o.session AS entry, o.opens FROM d ASOF LEFT JOIN o ON d.release < o.opens)"""
KEPT = f"doc_type = 'statement' AND NOT is_flagged AND doc_date >= DATE '{START}'"
PANEL = f"{RELEASED}, pan AS (SELECT rel.*, f.* EXCLUDE (session) FROM rel LEFT JOIN f ON rel.entry = f.session WHERE {KEPT})"
GAPS = "c AS (SELECT session, row_number() OVER (ORDER BY session) AS pos FROM bars), ev AS (SELECT DISTINCT c.session, pos FROM rel JOIN c ON rel.entry = c.session WHERE {0}), g AS (SELECT lag(session) OVER (ORDER BY pos) AS a, session AS b, pos - lag(pos) OVER (ORDER BY pos) AS gap FROM ev QUALIFY a IS NOT NULL)"
SENTENCES = r"""s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(coalesce(text, ''), E' \t\n\r\f\x0b'),
  '([.!?])\s+([A-Z0-9])', E'\\1\n\\2', 'g'), E'\n'), lambda x: trim(x, E' \t\n\r\f\x0b')), lambda x: length(x) >= 15) AS l FROM pd),
e AS (SELECT doc_id, unnest(range(len(l))) AS idx, unnest(l) AS sentence FROM s)"""
SCORED = f"""{SENTENCES}, lo AS (SELECT doc_id, idx, sentence, exp(length(sentence) % 7 / 7.0) AS a, exp(length(sentence) % 5 / 5.0) AS b, exp(0.5) AS c FROM e),
sc AS (SELECT doc_id, idx, sentence, a / (a + b + c) AS p_pos, b / (a + b + c) AS p_neg, c / (a + b + c) AS p_neu, CASE WHEN a >= b AND a >= c THEN 'positive' WHEN b >= c THEN 'negative' ELSE 'neutral' END AS label,
  least(len(regexp_split_to_array(sentence, '\\s+')), 512) AS n_tokens,
  regexp_matches(lower(sentence), '^\\s*(voting (for|against) the |in taking the discount rate action|in a related action, the board of governors (approved|voted)|the board of governors of the federal reserve system (approved|voted)|absent and not voting|release date:|for (immediate )?release)') AS is_boilerplate FROM lo),
ds AS (SELECT doc_id, count(*) AS n_sentences, avg(p_pos - p_neg) AS s_prob, (count(*) FILTER (label = 'positive') - count(*) FILTER (label = 'negative')) / count(*) AS s_count FROM sc GROUP BY 1)"""


def signal_sql(score: str = "s_prob", lookback: int = LOOKBACK, theta: float = THETA, name: str = "sig") -> str:
    past = f"OVER (ORDER BY doc_date, doc_id ROWS BETWEEN {lookback} PRECEDING AND 1 PRECEDING)"
    return f"""{name}0 AS (SELECT doc_id, doc_date, {score} AS S, fwd_ret_1, count(*) {past} AS n, avg({score}) {past} AS a, stddev_samp({score}) {past} AS sd FROM pan JOIN ds USING (doc_id)),
{name}1 AS (SELECT *, CASE WHEN n = {lookback} THEN a END AS mu, CASE WHEN n = {lookback} THEN sd END AS sigma, CASE WHEN n = {lookback} AND sd > 0 THEN (S - a) / sd END AS z FROM {name}0),
{name}2 AS (SELECT *, CASE WHEN z > {theta} THEN 1 WHEN z < -{theta} THEN -1 ELSE 0 END AS position FROM {name}1),
{name} AS (SELECT *, abs(position - lag(position, 1, 0) OVER (ORDER BY doc_date, doc_id)) AS turnover FROM {name}2)"""


SIGNAL = f"{PANEL}, {SCORED}, {signal_sql()}"
MOVES = f'{BARS}, mv AS (SELECT session, round("close" / open - 1, 8) AS move, {", ".join(f"round({c}, 8) AS {c}" for c in RETURNS)} FROM bars JOIN f USING (session))'
_ICS = """k AS (SELECT *, rank() OVER (PARTITION BY pair ORDER BY value) + (count(*) OVER (PARTITION BY pair, value) - 1) / 2 AS ra, rank() OVER (PARTITION BY pair ORDER BY fwd) + (count(*) OVER (PARTITION BY pair, fwd) - 1) / 2 AS rb FROM u WHERE value IS NOT NULL AND fwd IS NOT NULL),
c1 AS (SELECT pair, count(*) AS n, corr(ra, rb) AS ic, corr(value, fwd) AS pearson FROM k GROUP BY 1), c2 AS (SELECT *, ic * sqrt((n - 2) / (1 - ic * ic)) AS t FROM c1),
si AS (SELECT pair, sum(w * pow(1 + x * x / (n - 2), -(n - 1) / 2)) * t / 6000 AS area FROM (SELECT pair, n, abs(t) AS t, abs(t) * i / 2000 AS x, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM c2, range(2001) r(i)) GROUP BY pair, n, t)"""

ORACLES = {
    "stage_round_trip": f"WITH {PANEL}, {SCORED} SELECT doc_id, CAST(doc_date AS VARCHAR) AS doc_date, is_scheduled, CAST(epoch(release) AS BIGINT) AS release_epoch, round(fwd_ret_5, 6) AS fwd_ret_5, CAST(coalesce(n_sentences, 0) AS INTEGER) AS n_sentences, round(s_prob, 6) AS s_prob FROM pan LEFT JOIN ds USING (doc_id)",
    "zscore_agreement": f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events), w AS (SELECT event_id, count(value) OVER v AS n, avg(value) OVER v AS m, stddev_samp(value) OVER v AS s FROM events WINDOW v AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {LOOKBACK} PRECEDING AND 1 PRECEDING)),
j AS (SELECT a.event_id, count(b.value) AS n, avg(b.value) AS m, stddev_samp(b.value) AS s FROM p a LEFT JOIN p b ON a.event_type = b.event_type AND b.i BETWEEN a.i - {LOOKBACK} AND a.i - 1 GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (w.n = {LOOKBACK} AND w.s > 0) AS n_usable, count(*) FILTER (w.n <> j.n OR w.n = {LOOKBACK} AND (abs(w.m - j.m) > 1e-9 OR abs(w.s - j.s) > 1e-9)) AS n_different FROM w JOIN j USING (event_id)""",
    "first_trades": "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS session, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1",
    "asof_instants": f"WITH {BARS}, {DOCS}, o AS (SELECT session, timezone('America/New_York', CAST(session AS TIMESTAMP) + to_minutes(CASE WHEN day(session) % 9 = 1 THEN 780 ELSE 570 END)) AS opens FROM bars) SELECT doc_id, CAST(session AS VARCHAR) AS entry FROM d ASOF LEFT JOIN o ON d.release < o.opens",
    "previous_purchase": "WITH b AS (SELECT user_id, ts, max(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT event_id, purchase_id FROM events e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.ts > b.ts",
    "price_quality": f"WITH {BARS} SELECT count(*) AS n_sessions, count(*) FILTER (open < 20000) AS n_dropped, count(*) FILTER (open >= 20000) AS n_kept, CAST(max(session) FILTER (open >= 20000) AS VARCHAR) AS last FROM bars",
    "session_edges": f"WITH {BARS}, n AS (SELECT *, row_number() OVER (ORDER BY session) AS i, row_number() OVER (ORDER BY session DESC) AS j FROM bars) SELECT CAST(session AS VARCHAR) AS session, open, \"close\", volume FROM n WHERE i <= 3 OR j <= 3",
    "release_resolution": f"WITH {DOCS} SELECT doc_id, parsed_minutes, release_minutes, release_time_source, CAST(epoch(release) AS BIGINT) AS release_epoch FROM d",
    "panel_funnel": f"""WITH {RELEASED}, c AS (SELECT count(*) AS discovered, count(*) FILTER (doc_type = 'statement') AS statements, count(*) FILTER (doc_type = 'statement' AND NOT is_flagged) AS after_dropping_flagged,
  count(*) FILTER ({KEPT}) AS after_sample_start, count(*) FILTER ({KEPT}) AS after_unscheduled_filter, count(*) FILTER ({KEPT} AND entry IS NOT NULL) AS with_entry_date FROM rel) UNPIVOT c ON COLUMNS(*) INTO NAME step VALUE n""",
    "scheduled_funnel": f"""WITH {RELEASED}, c AS (SELECT count(*) AS discovered, count(*) FILTER (doc_type = 'statement') AS statements, count(*) FILTER (doc_type = 'statement' AND NOT is_flagged) AS after_dropping_flagged,
  count(*) FILTER ({KEPT}) AS after_sample_start, count(*) FILTER ({KEPT} AND is_scheduled) AS after_unscheduled_filter, count(*) FILTER ({KEPT} AND is_scheduled AND entry IS NOT NULL) AS with_entry_date FROM rel) UNPIVOT c ON COLUMNS(*) INTO NAME step VALUE n""",
    "event_panel": f"WITH {PANEL} SELECT doc_id, CAST(entry AS VARCHAR) AS entry, {', '.join(f'round({c}, 8) AS {c}' for c in RETURNS)} FROM pan",
    "leak_violations": f"WITH {RELEASED} SELECT count(entry) AS n_entries, count(*) FILTER (opens <= release) AS n_not_after, count(*) FILTER (entry IS NOT NULL AND entry NOT IN (SELECT session FROM bars)) AS n_no_session FROM rel",
    "event_overlap_pairs": f"WITH {RELEASED}, {GAPS.format('doc_id % 50 = 0')} SELECT CAST(h AS INTEGER) AS h, CAST(a AS VARCHAR) AS first, CAST(b AS VARCHAR) AS second, CAST(gap AS INTEGER) AS gap FROM g, (SELECT unnest([1, 3, 5, 10, 20]) AS h) WHERE gap < h",
    "event_gap_summary": f"WITH {RELEASED}, {GAPS.format('TRUE')} SELECT (SELECT count(*) FROM ev) AS n_events, CAST(min(gap) AS INTEGER) AS min_gap, median(gap) AS median_gap, CAST(max(gap) AS INTEGER) AS max_gap FROM g",
    "release_lag_stats": f"WITH {RELEASED}, h AS (SELECT (epoch(opens) - epoch(release)) / 3600 AS h, CAST(timezone('America/New_York', release) AS DATE) = entry AS same FROM rel WHERE entry IS NOT NULL) SELECT count(*) AS n, round(min(h), 6) AS min_hours, round(median(h), 6) AS median_hours, round(max(h), 6) AS max_hours, count(*) FILTER (same) AS same_session FROM h",
    "return_coverage": f"WITH {PANEL} " + " UNION ALL ".join(f"SELECT '{c}' AS horizon, count({c}) AS n_present, count(*) - count({c}) AS n_null, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd FROM pan" for c in RETURNS),
    "composition": f"WITH {DOCS} " + " UNION ALL ".join(f"SELECT '{c}' AS facet, coalesce(CAST({c} AS VARCHAR), 'unknown') AS value, count(*) AS n FROM d GROUP BY 2" for c in ("doc_type", "is_scheduled", "release_time_source")),
    "documents_per_year": f"WITH {DOCS} SELECT doc_type, CAST(year(doc_date) AS INTEGER) AS year, count(*) AS n FROM d GROUP BY 1, 2",
    "parse_identity": f"WITH {DOCS} SELECT count(*) AS n_total, count(*) FILTER (NOT is_flagged) AS n_parsed, count(*) FILTER (is_flagged) AS n_flagged, count(*) FILTER (is_error_page) AS n_error_pages, count(*) = count(*) FILTER (NOT is_flagged) + count(*) FILTER (is_flagged) AS holds FROM d",
    "price_summary": f"WITH {BARS} SELECT count(*) AS n_sessions, CAST(min(session) AS VARCHAR) AS first, CAST(max(session) AS VARCHAR) AS last, round((max(session) - min(session)) / 365.25, 6) AS years, round(count(*) / ((max(session) - min(session)) / 365.25), 6) AS per_year, bool_or(open IS NULL OR \"close\" IS NULL) AS any_null FROM bars",
    "spot_checks": f"WITH {RELEASED} SELECT doc_id, CAST(doc_date AS VARCHAR) AS doc_date, CAST(entry AS VARCHAR) AS entry, CAST(timezone('America/New_York', release) AS DATE) = entry AS same_session FROM rel WHERE CAST(doc_date AS VARCHAR) IN {SPOTS}",
    "document_signal": f"WITH {SIGNAL} SELECT doc_id, round(S, 6) AS S, round(mu, 6) AS mu, round(sigma, 6) AS sigma, round(z, 6) AS z, position, turnover FROM sig",
    "z_histogram": f"WITH {SIGNAL}, zz AS (SELECT round(z, 6) AS z FROM sig WHERE z IS NOT NULL), m AS (SELECT min(z) AS a, max(z) AS b FROM zz) SELECT CAST(coalesce(least(floor((z - a) * {BINS} / nullif(b - a, 0)), {BINS - 1}), 0) AS BIGINT) AS bin, count(*) AS n FROM zz, m GROUP BY 1",
    "top_surprises": f"WITH {SIGNAL} SELECT doc_id, round(z, 6) AS z, position FROM sig WHERE z IS NOT NULL ORDER BY abs(round(z, 6)) DESC, doc_id LIMIT 10",
    "era_buckets": f"WITH {SIGNAL}, er AS (SELECT *, CASE {' '.join(f"WHEN year(doc_date) > {a} AND year(doc_date) <= {b} THEN '{a + 1}-{b}'" for a, b in ERAS)} END AS era FROM sig WHERE z IS NOT NULL) SELECT era, count(*) AS n, round(avg(S), 6) AS s_mean, round(avg(z), 6) AS z_mean, round(stddev_samp(z), 6) AS z_sd FROM er WHERE era IS NOT NULL GROUP BY 1",
    "robustness_grid": f"""WITH {RELEASED}, {SCORED},
gc AS (SELECT session, "close", lead("close") OVER (ORDER BY session) / "close" - 1 AS ret, timezone('America/New_York', CAST(session AS TIMESTAMP) + INTERVAL 960 MINUTE) AS closes FROM bars),
gb AS (SELECT rel.doc_id, doc_date, is_scheduled, release, f.fwd_ret_1 AS r_open, s_prob, s_count FROM rel LEFT JOIN f ON rel.entry = f.session JOIN ds USING (doc_id) WHERE doc_type = 'statement' AND NOT is_flagged),
ge AS (SELECT gb.*, gc.ret AS r_close FROM gb ASOF LEFT JOIN gc ON gb.release < gc.closes),
gs AS (SELECT doc_id, doc_date, r_open, r_close, score, sample_start, include_unscheduled, CASE score WHEN 's_prob' THEN s_prob ELSE s_count END AS S
  FROM ge, (SELECT unnest({SCORES}) AS score), (SELECT unnest({STARTS}) AS sample_start), (SELECT unnest([TRUE, FALSE]) AS include_unscheduled) WHERE doc_date >= CAST(sample_start AS DATE) AND (include_unscheduled OR is_scheduled)),
gw AS (SELECT *, {", ".join(f"CASE WHEN count(S) OVER w{n} = {n} AND stddev_samp(S) OVER w{n} > 0 THEN (S - avg(S) OVER w{n}) / stddev_samp(S) OVER w{n} END AS z{n}" for n in LOOKBACKS)} FROM gs
  WINDOW {", ".join(f"w{n} AS (PARTITION BY score, sample_start, include_unscheduled ORDER BY doc_date, doc_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in LOOKBACKS)}),
gl AS ({" UNION ALL ".join(f"SELECT *, {n} AS lookback, z{n} AS z FROM gw" for n in LOOKBACKS)}), gt AS (SELECT *, CASE WHEN z > theta THEN 1 WHEN z < -theta THEN -1 ELSE 0 END AS position FROM gl, (SELECT CAST(unnest({THETAS}) AS DOUBLE) AS theta)),
gp AS (SELECT *, abs(position - lag(position, 1, 0) OVER (PARTITION BY score, sample_start, include_unscheduled, lookback, theta ORDER BY doc_date, doc_id)) AS turnover FROM gt)
SELECT score, sample_start, include_unscheduled, lookback, theta, entry, count(*) AS n, count(z) AS n_usable, count(*) FILTER (position = 1) AS n_long, count(*) FILTER (position = -1) AS n_short, CAST(sum(turnover) AS BIGINT) AS turnover,
  round(avg(position * CASE entry WHEN 'same_day_close' THEN r_close ELSE r_open END), 6) AS mean_ret FROM gp, (SELECT unnest({ENTRIES}) AS entry) GROUP BY ALL""",
    "score_coverage": f"""WITH {PANEL}, {SCORED}, ok AS (SELECT doc_id FROM d WHERE {KEPT}) SELECT count(*) AS n_panel, count(s_prob) AS n_scored, count(*) FILTER (s_prob IS NULL AND doc_id IN (SELECT doc_id FROM ok)) AS n_without_sentences, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM ok)) AS n_not_scored FROM pan LEFT JOIN ds USING (doc_id)""",
    "ic_grid": f"WITH {PANEL}, {SCORED}, u AS ({' UNION ALL '.join(f"SELECT '{s}/{r}' AS pair, round({s}, 8) AS value, round({r}, 8) AS fwd FROM pan JOIN ds USING (doc_id)" for s in SCORES for r in RETURNS)}), {_ICS} SELECT pair, n, round(ic, 5) AS ic, round(pearson, 5) AS pearson, round(t, 5) AS t, round(1.96 / sqrt(n), 5) AS mde, round(pow(1.96 + 0.84, 2) / (ic * ic), 5) AS n_needed, round(ic * sqrt(8), 5) AS ir, round(1 - 2 * area * exp(lgamma((n - 1) / 2) - lgamma((n - 2) / 2)) / sqrt((n - 2) * pi()), 5) AS p FROM c2 JOIN si USING (pair)",
    "ic_bootstrap_ci": f"""WITH {MOVES}, q AS (SELECT move, fwd_ret_1 AS y, row_number() OVER (ORDER BY session) - 1 AS i, count(*) OVER () AS n FROM mv WHERE move IS NOT NULL AND fwd_ret_1 IS NOT NULL),
w AS (SELECT b, CAST('0x' || substr(md5('42:' || b || ':' || i), 1, 8) AS BIGINT) % n AS i FROM q, range({ROUNDS}) r(b)),
k AS (SELECT w.b, rank() OVER (PARTITION BY w.b ORDER BY move) + (count(*) OVER (PARTITION BY w.b, move) - 1) / 2 AS ra, rank() OVER (PARTITION BY w.b ORDER BY y) + (count(*) OVER (PARTITION BY w.b, y) - 1) / 2 AS rb FROM w JOIN q ON w.i = q.i),
c AS (SELECT b, corr(ra, rb) AS ic FROM k GROUP BY 1) SELECT CAST((SELECT count(*) FROM q) AS INTEGER) AS n, count(*) AS rounds, round(quantile_cont(ic, 0.025), 6) AS low, round(quantile_cont(ic, 0.975), 6) AS high FROM c""",
    "hac_standard_errors": f"WITH {MOVES}, "
    + ", ".join(f"h{h} AS (SELECT row_number() OVER (ORDER BY session) AS i, fwd_ret_{h} AS x, fwd_ret_{h} - avg(fwd_ret_{h}) OVER () AS e FROM mv WHERE fwd_ret_{h} IS NOT NULL)" for h in HORIZONS)
    + " ".join(f"{' UNION ALL' if h > 1 else ''} SELECT 'fwd_ret_{h}' AS horizon, (SELECT count(*) FROM h{h}) AS n, (SELECT round(avg(x), 6) FROM h{h}) AS mean, round(sqrt(sum(CASE WHEN b.i = a.i THEN 1 ELSE 2 * (1 - (b.i - a.i) / {h}) END * a.e * b.e)) / (SELECT count(*) FROM h{h}), 6) AS se FROM h{h} a JOIN h{h} b ON b.i BETWEEN a.i AND a.i + {h - 1}" for h in HORIZONS),
    "walk_forward": f"WITH {MOVES} SELECT CAST(session AS VARCHAR) AS session, count(move) OVER w AS n, round(avg(move) OVER w, 6) AS mean FROM mv WINDOW w AS (ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "zscore_by_join": f"""WITH m AS (SELECT event_id, value, count(value) OVER w AS n, avg(value) OVER w AS a, stddev_samp(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {LOOKBACK} PRECEDING AND 1 PRECEDING))
SELECT event_id, CASE WHEN n = {LOOKBACK} THEN round(a, 6) END AS mu, CASE WHEN n = {LOOKBACK} THEN round(s, 6) END AS sigma, CASE WHEN n = {LOOKBACK} AND s > 0 THEN round((value - a) / s, 6) END AS z FROM m""",
}
