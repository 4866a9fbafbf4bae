"""The registered queries of the event-study operators and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import evaluation as V
from tidemark.operators import events as E
from tidemark.plans import planted

LOOKBACK, THETA = 6, 1.0
MIN_TEXT_CHARS, COSTS = 500, [0.0, 1.0, 2.0, 5.0, 10.0]


def _bars(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return E.bars(orders.select(F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price")))


def _signal(spark: SparkSession, sf: str) -> DataFrame:
    series = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "ts", "value")
    rows = E.placed(series, "event_type", ["ts", "event_id"], F.date_trunc("hour", "ts"))
    cut, over = E.blocks(rows, "event_type", LOOKBACK + 1)
    z = E.zscores(cut, "event_type", [], "value", LOOKBACK, over).withColumn("position", E.positions(F.col("z"), THETA))
    return E.own(E.turnover(z, "event_type", [], over))


def price_bars(spark: SparkSession, sf: str) -> DataFrame:
    return _bars(spark, sf).select(F.col("session").cast("string").alias("session"), "open", "high", "low", "close", "volume")


def asof_next_open(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    day = F.date_add(F.lit("1995-01-02").cast("date"), (F.col("doc_id") * 37 % 2420).cast("int"))
    minutes = F.when(F.col("doc_id") % 5 == 0, 570).otherwise(F.col("doc_id") * 97 % 1440)
    found = E.next_open(docs.select("doc_id", day.alias("day"), minutes.alias("minutes")), _bars(spark, sf))
    return found.select("doc_id", F.col("entry").cast("string").alias("entry"))


def forward_returns(spark: SparkSession, sf: str) -> DataFrame:
    found = E.forward_returns(_bars(spark, sf))
    return found.select(F.col("session").cast("string").alias("session"), *[F.round(c, 8).alias(c) for c in found.columns[1:]])


def trailing_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return _signal(spark, sf).select("event_id", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"), F.round("z", 6).alias("z"))


def positions_turnover(spark: SparkSession, sf: str) -> DataFrame:
    return _signal(spark, sf).select("event_id", "position", "turnover")


def signal_summary(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("position")
    return _signal(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.count("z").alias("n_usable"), F.count_if(F.col("z").isNull()).alias("n_warmup"), F.round(F.avg("z"), 6).alias("z_mean"), F.round(F.stddev_samp("z"), 6).alias("z_sd"), F.round(F.min("z"), 6).alias("z_min"), F.round(F.max("z"), 6).alias("z_max"), F.count_if(p == 1).alias("n_long"), F.count_if(p == -1).alias("n_short"), F.count_if(p == 0).alias("n_flat"), F.sum("turnover").cast("bigint").alias("turnover"), F.round(F.avg("turnover"), 3).alias("mean_turnover"), F.round(100 * F.avg((p != 0).cast("int")), 1).alias("pct_in_market"))


def calendar_check(spark: SparkSession, sf: str) -> DataFrame:
    """Days of one calendar that the other lacks, both ways."""
    have = _bars(spark, sf).select(F.col("session").alias("day"))
    other = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.to_date("l_shipdate").alias("day")).filter(F.weekday("day") < 5).distinct()
    gone = other.join(have, "day", "left_anti").withColumn("issue", F.lit("missing_from_prices"))
    return gone.unionByName(have.join(other, "day", "left_anti").withColumn("issue", F.lit("not_a_session"))).select(F.col("day").cast("string").alias("day"), "issue")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return planted.texts(spark, sf)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def split_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("idx", "sentence"))


def document_flags(spark: SparkSession, sf: str) -> DataFrame:
    text, error = F.col("text"), T.is_error_page(F.col("text"))
    return _docs(spark, sf).select("doc_id", error.alias("is_error_page"), (error | (F.length(F.coalesce(text, F.lit(""))) < MIN_TEXT_CHARS)).alias("is_flagged"), T.release_minutes(text).alias("release_minutes"), T.is_scheduled(text).alias("is_scheduled"))


def doc_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    return _rounded(V.document_scores(docs, V.scored_sentences(docs)), "s_prob", "s_count", "mean_confidence")


def _moves(spark: SparkSession, sf: str) -> DataFrame:
    bars = _bars(spark, sf)
    moves = bars.select("session", F.round(F.col("close") / F.col("open") - 1, 8).alias("move")).join(E.forward_returns(bars), "session")
    moves = moves.withColumns({"position": E.positions(F.col("move"), 0.1), "series": F.lit("all")})
    return E.turnover(moves, "series", ["session"])


def ic_by_horizon(spark: SparkSession, sf: str) -> DataFrame:
    long = _moves(spark, sf).unpivot(["session", "move"], [f"fwd_ret_{h}" for h in (1, 3, 5, 10, 20)], "horizon", "fwd").withColumn("fwd", F.round("fwd", 8))
    return _rounded(V.correlations(long, "horizon", "move", "fwd"), "ic", "pearson", "t")


def cost_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Performance of the strategy at each cost."""
    returns = V.strategy_returns(_moves(spark, sf), "fwd_ret_1", COSTS)
    return _rounded(V.performance(returns, "bps", "session"), "growth", "vol", "sharpe", "max_drawdown", "win_rate", "avg_win", "avg_loss")


QUERIES: dict = {f.__name__: f for f in (asof_next_open, price_bars, forward_returns, trailing_zscore, positions_turnover, signal_summary, calendar_check, split_sentences, document_flags, doc_sentiment, ic_by_horizon, cost_curve)}

_BARS = """bars AS (SELECT CAST(o_orderdate AS DATE) AS session, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS "close", count(*) AS volume
  FROM orders WHERE isodow(o_orderdate) <= 5 GROUP BY 1)"""
_PAST = f"OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {LOOKBACK} PRECEDING AND 1 PRECEDING)"
_SIGNAL = f"""m AS (SELECT event_id, event_type, ts, value, count(value) {_PAST} AS n, avg(value) {_PAST} AS a, stddev_samp(value) {_PAST} AS s FROM events),
z AS (SELECT *, CASE WHEN n = {LOOKBACK} THEN a END AS mu, CASE WHEN n = {LOOKBACK} THEN s END AS sigma,
  CASE WHEN n = {LOOKBACK} AND s > 0 THEN (value - a) / s END AS z FROM m),
p AS (SELECT *, CASE WHEN z > {THETA} THEN 1 WHEN z < -{THETA} THEN -1 ELSE 0 END AS position FROM z),
t AS (SELECT *, abs(position - lag(position, 1, 0) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS turnover FROM p)"""

_SENTENCES = planted.TEXTS + r""", s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(coalesce(text, ''), E' \t\n\r\f\x0b'),
  '([.!?])\s+([A-Z0-9])', E'\\1\n\\2', 'g'), E'\n'), lambda x: trim(x, E' \t\n\r\f\x0b')), lambda x: length(x) >= 15) AS l FROM pd),
e AS (SELECT doc_id, unnest(range(len(l))) AS idx, unnest(l) AS sentence FROM s)"""
_MOVES = f"""{_BARS}, v AS (SELECT session, round("close" / open - 1, 8) AS move, {", ".join(f'lead("close", {h}) OVER (ORDER BY session) / open - 1 AS fwd_ret_{h}' for h in (1, 3, 5, 10, 20))} FROM bars),
q AS (SELECT *, CASE WHEN move > 0.1 THEN 1 WHEN move < -0.1 THEN -1 ELSE 0 END AS position FROM v)"""

ORACLES: dict = {
    "split_sentences": f"WITH {_SENTENCES} SELECT doc_id, CAST(idx AS INTEGER) AS idx, sentence FROM e",
    "document_flags": f"WITH {planted.TEXTS}, " + r"""a AS (SELECT doc_id, coalesce(text, '') AS text, regexp_matches(lower(substr(coalesce(text, ''), 1, 600)), 'page not found|the page you were looking for has been moved|no longer exists') AS bad,
  regexp_extract(substr(text, 1, 1500), '(?i)for\s+release\s+at\s+(\d{1,2})[:.](\d{2})\s*([ap])\.?\s*m\.?', ['h', 'm', 'p']) AS r FROM pd)
SELECT doc_id, bad AS is_error_page, bad OR length(text) < 500 AS is_flagged,
  CASE WHEN TRY_CAST(r.h AS INTEGER) BETWEEN 1 AND 12 AND TRY_CAST(r.m AS INTEGER) < 60 THEN CAST(TRY_CAST(r.h AS INTEGER) % 12 * 60 + TRY_CAST(r.m AS INTEGER) + CASE WHEN lower(r.p) = 'p' THEN 720 ELSE 0 END AS INTEGER) END AS release_minutes,
  CASE WHEN regexp_matches(lower(text), 'conference call|unscheduled|notation vote|videoconference') THEN FALSE WHEN contains(lower(text), 'meeting') THEN TRUE END AS is_scheduled FROM a""",
    "doc_sentiment": f"""WITH {_SENTENCES}, g AS (SELECT doc_id, sentence, exp(length(sentence) % 7 / 7.0) AS a, exp(length(sentence) % 5 / 5.0) AS b, exp(0.5) AS c FROM e),
p AS (SELECT *, CASE WHEN a >= b AND a >= c THEN 1 WHEN b >= c THEN -1 ELSE 0 END AS y, a + b + c AS z FROM g),
d AS (SELECT doc_id, count(*) AS n, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = -1) AS n_neg, count(*) FILTER (y = 0) AS n_neu, CAST(max(least(len(regexp_split_to_array(sentence, '\\s+')), 512)) AS INTEGER) AS mt, avg((a - b) / z) AS sp, avg(greatest(a, b, c) / z) AS mc,
  count(*) FILTER (regexp_matches(lower(sentence), '^\\s*(voting (for|against) the |in taking the discount rate action|in a related action, the board of governors (approved|voted)|the board of governors of the federal reserve system (approved|voted)|absent and not voting|release date:|for (immediate )?release)')) AS nb FROM p GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(n_pos, 0) AS n_pos, coalesce(n_neg, 0) AS n_neg, coalesce(n_neu, 0) AS n_neu, coalesce(mt, 0) AS max_tokens, coalesce(nb, 0) AS n_boilerplate, round(sp, 6) AS s_prob, round(mc, 6) AS mean_confidence,
  round((n_pos - n_neg) / n, 6) AS s_count FROM documents LEFT JOIN d USING (doc_id)""",
    "ic_by_horizon": f"""WITH {_MOVES}, u AS (UNPIVOT (SELECT session, move, {", ".join(f"round(fwd_ret_{h}, 8) AS fwd_ret_{h}" for h in (1, 3, 5, 10, 20))} FROM q) ON COLUMNS('fwd_ret_.*') INTO NAME horizon VALUE fwd),
k AS (SELECT horizon, move, fwd, rank() OVER (PARTITION BY horizon ORDER BY move) + (count(*) OVER (PARTITION BY horizon, move) - 1) / 2 AS a,
  rank() OVER (PARTITION BY horizon ORDER BY fwd) + (count(*) OVER (PARTITION BY horizon, fwd) - 1) / 2 AS b FROM u WHERE move IS NOT NULL AND fwd IS NOT NULL),
c AS (SELECT horizon, count(*) AS n, corr(a, b) AS ic, corr(move, fwd) AS pearson FROM k GROUP BY 1)
SELECT horizon, n, round(ic, 6) AS ic, round(pearson, 6) AS pearson, round(ic * sqrt((n - 2) / (1 - ic * ic)), 6) AS t FROM c""",
    "cost_curve": f"""WITH {_MOVES}, w AS (SELECT *, abs(position - lag(position, 1, 0) OVER (ORDER BY session)) AS turnover FROM q),
r AS (SELECT session, bps, position * fwd_ret_1 - bps * 1e-4 * turnover AS ret FROM w, (SELECT CAST(unnest([0.0, 1, 2, 5, 10]) AS DOUBLE) AS bps) WHERE fwd_ret_1 IS NOT NULL),
l AS (SELECT *, ln(1 + greatest(ret, -1 + 1e-15)) AS g, ret <= -1 AS lost FROM r),
y AS (SELECT *, CASE WHEN bool_or(lost) OVER u THEN 0 ELSE exp(sum(g) OVER u) END AS equity FROM l WINDOW u AS (PARTITION BY bps ORDER BY session)),
f AS (SELECT *, equity / greatest(max(equity) OVER (PARTITION BY bps ORDER BY session), 1) - 1 AS fall FROM y)
SELECT bps, count(*) AS n, CASE WHEN bool_or(lost) THEN -1 ELSE round(exp(sum(g) * 8 / count(*)) - 1, 6) END AS growth, round(stddev_samp(ret) * sqrt(8), 6) AS vol,
  round(avg(ret) / stddev_samp(ret) * sqrt(8), 6) AS sharpe, round(min(fall), 6) AS max_drawdown, round(count(*) FILTER (ret > 0) / count(*), 6) AS win_rate,
  round(avg(ret) FILTER (ret > 0), 6) AS avg_win, round(avg(ret) FILTER (ret < 0), 6) AS avg_loss, count(*) FILTER (ret <> 0) AS n_trades FROM f GROUP BY bps""",
    "price_bars": f'WITH {_BARS} SELECT CAST(session AS VARCHAR) AS session, open, high, low, "close", volume FROM bars',
    "asof_next_open": f"""WITH {_BARS}, r AS (SELECT doc_id, CAST(DATE '1995-01-02' + CAST(doc_id * 37 % 2420 AS INTEGER) AS TIMESTAMP)
  + to_minutes(CASE WHEN doc_id % 5 = 0 THEN 570 ELSE doc_id * 97 % 1440 END) AS at FROM documents),
o AS (SELECT session, CAST(session AS TIMESTAMP) + INTERVAL 570 MINUTE AS at FROM bars)
SELECT r.doc_id, CAST(o.session AS VARCHAR) AS entry FROM r ASOF LEFT JOIN o ON r.at < o.at""",
    "forward_returns": f"WITH {_BARS} SELECT CAST(session AS VARCHAR) AS session, "
    + ", ".join(f'round(lead("close", {h}) OVER (ORDER BY session) / open - 1, 8) AS fwd_ret_{h}' for h in (1, 3, 5, 10, 20))
    + " FROM bars",
    "trailing_zscore": f"WITH {_SIGNAL} SELECT event_id, round(mu, 6) AS mu, round(sigma, 6) AS sigma, round(z, 6) AS z FROM t",
    "positions_turnover": f"WITH {_SIGNAL} SELECT event_id, position, turnover FROM t",
    "signal_summary": f"""WITH {_SIGNAL} SELECT event_type, count(*) AS n, count(z) AS n_usable, count(*) - count(z) AS n_warmup, round(avg(z), 6) AS z_mean, round(stddev_samp(z), 6) AS z_sd, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max,
  count(*) FILTER (position = 1) AS n_long, count(*) FILTER (position = -1) AS n_short, count(*) FILTER (position = 0) AS n_flat,
  CAST(sum(turnover) AS BIGINT) AS turnover, round(avg(turnover), 3) AS mean_turnover, round(100 * avg(CASE WHEN position <> 0 THEN 1 ELSE 0 END), 1) AS pct_in_market FROM t GROUP BY event_type""",
    "calendar_check": f"""WITH {_BARS}, l AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem WHERE isodow(l_shipdate) <= 5)
SELECT CAST(session AS VARCHAR) AS day, 'missing_from_prices' AS issue FROM l ANTI JOIN bars USING (session)
UNION ALL SELECT CAST(session AS VARCHAR), 'not_a_session' FROM bars ANTI JOIN l USING (session)""",
}
