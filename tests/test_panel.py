"""Releases, entries, funnel, guards and series of the event panel, on small fixtures and against plain Python."""

import math
import statistics
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import evaluation as V
from tidemark.operators import events as E
from tidemark.operators import panel as P
from tidemark.operators import scans as SC

DAYS = [date(2020, 3, d) for d in range(2, 32) if date(2020, 3, d).weekday() < 5 and d != 12]


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.createDataFrame([(d, 100.0 + i, 100.0 + i) for i, d in enumerate(DAYS)], "session date, open double, close double")


def docs(spark, rows):
    return spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(rows)], "doc_id bigint, doc_date date, text string")


@pytest.mark.parametrize(
    ("day", "stated", "entry"),
    [
        (date(2020, 3, 4), "2:00 p.m.", date(2020, 3, 5)),
        (date(2020, 3, 4), "8:00 a.m.", date(2020, 3, 4)),
        (date(2020, 3, 4), "9:30 a.m.", date(2020, 3, 5)),  # at the open itself is too late
        (date(2020, 3, 15), "5:00 p.m.", date(2020, 3, 16)),
        (date(2020, 3, 11), "2:00 p.m.", date(2020, 3, 13)),  # the 12th is no session
        (date(2020, 3, 10), "8:00 a.m.", date(2020, 3, 10)),  # after the clocks went forward
        (date(2020, 4, 15), "2:00 p.m.", None),
        (date(2020, 2, 1), "2:00 p.m.", date(2020, 3, 2)),
    ],
)
def test_entry_is_the_next_open_strictly_after(spark, sessions, day, stated, entry):
    rows = P.next_open(P.resolved_releases(docs(spark, [(day, f"For release at {stated} EST")])), sessions)
    assert [r.entry for r in rows.collect()] == [entry]
    assert P.leaks(rows, sessions).count() == 0
    P.assert_no_leaks(rows, sessions)


def test_release_sources(spark):
    rows = docs(spark, [(date(2020, 3, 4), "For release at 2:30 p.m."), (date(2020, 3, 5), "x"), (date(2020, 3, 15), "For release at 5:00 p.m."), (date(2020, 3, 6), None)])
    got = P.resolved_releases(rows, {"2020-03-15": 480}).orderBy("doc_id").collect()
    assert [(r.release_time_source, r.release_minutes, r.parsed_minutes) for r in got] == [("parsed_from_document", 870, 870), ("scheduled_default", 840, None), ("manual_override", 480, 1020), ("scheduled_default", 840, None)]
    assert got[0].release == datetime(2020, 3, 4, 19, 30)  # winter; the session is in UTC
    with pytest.raises(ValueError):
        P.resolved_releases(rows, default=570)


def test_times_without_a_zone_are_refused(spark, sessions):
    naive = spark.createDataFrame([(datetime(2020, 3, 4, 14),)], "release timestamp_ntz")
    with pytest.raises(ValueError):
        P.next_open(naive, sessions)


def test_leaks_are_found(spark, sessions):
    rows = P.resolved_releases(docs(spark, [(date(2020, 3, 4), ""), (date(2020, 3, 4), "")])).withColumn("entry", F.when(F.col("doc_id") == 0, F.lit("2020-03-04").cast("date")).otherwise(F.lit("2020-03-12").cast("date")))
    assert sorted((r.doc_id, r.why) for r in P.leaks(rows, sessions).collect()) == [(0, "not_after_release"), (1, "not_a_session")]
    with pytest.raises(AssertionError):
        P.assert_no_leaks(rows, sessions)


def test_overlaps_and_gaps(spark, sessions):
    entries = spark.createDataFrame([(date(2020, 3, 3),), (date(2020, 3, 16),), (date(2020, 3, 16),), (None,)], "entry date")
    assert [r.h for r in P.overlaps(entries, sessions, [1, 5, 20]).collect()] == [20]
    summary = P.gap_summary(entries, sessions).first()
    assert (summary.n_events, summary.min_gap, summary.max_gap) == (2, 8, 8)


def test_forward_returns_of_a_ramp(spark, sessions):
    got = {r.session: r for r in E.forward_returns(sessions).collect()}
    entry = got[date(2020, 3, 4)]
    assert entry.fwd_ret_1 == pytest.approx(103 / 102 - 1) and entry.fwd_ret_5 == pytest.approx(107 / 102 - 1)
    assert got[DAYS[-2]].fwd_ret_20 is None and got[DAYS[-2]].fwd_ret_1 is not None


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], "key string, at int, value double")


SERIES = [math.sin(0.7 * i) * 0.2 + math.cos(0.31 * i) * 0.1 for i in range(40)]


def z_by_hand(values, window):
    out = []
    for i, v in enumerate(values):
        past = values[i - window : i] if i >= window else []
        out.append((v - statistics.mean(past)) / statistics.stdev(past) if past and statistics.stdev(past) > 0 else None)
    return out


@pytest.mark.parametrize("window", [2, 3, 6, 12])
def test_zscores_look_back_only(spark, window):
    """By a whole window, by blocks of a few rows and by join; later rows don't change earlier ones."""
    rows, changed = series(spark, SERIES), series(spark, [v * -3 + 99 if i >= 25 else v for i, v in enumerate(SERIES)])
    plain = [r.z for r in E.zscores(rows, "key", ["at"], "value", window).orderBy("at").collect()]
    placed = E.placed(rows, "key", ["at"], F.floor(F.col("at") / 7))
    cut, over = E.blocks(placed, "key", window, size=13)
    blocked = [r.z for r in E.own(E.zscores(cut, "key", [], "value", window, over)).orderBy("at").collect()]
    joined = [r.z for r in E.zscores_by_join(placed, "key", "value", window).orderBy("at").collect()]
    later = [r.z for r in E.zscores(changed, "key", ["at"], "value", window).orderBy("at").collect()]
    for got in (plain, blocked, joined):
        assert got == pytest.approx(z_by_hand(SERIES, window))
    assert later[:25] == plain[:25] and later[26:] != plain[26:]


def test_zscore_of_a_constant_is_null(spark):
    got = E.zscores(series(spark, [0.5] * 6 + [0.9]), "key", ["at"], "value", 6).orderBy("at").collect()[-1]
    assert got.sigma == 0 and got.z is None
    with pytest.raises(ValueError):
        E.zscores(series(spark, [1.0]), "key", ["at"], "value", 1)


def test_positions_and_signs(spark):
    rows = spark.createDataFrame([(x,) for x in (-2.0, -1.0, 0.5, 1.0, 1.5, None)], "z double")
    assert [r[0] for r in rows.select(E.positions(F.col("z"), 1.0)).collect()] == [-1, 0, 0, 0, 1, 0]
    assert [r[0] for r in rows.select(E.positions(F.col("z"), 1.0, E.signs("dovish_surprise_bearish"))).collect()] == [1, 0, 0, 0, -1, 0]
    for bad in (0, 2):
        with pytest.raises(ValueError):
            E.positions(F.col("z"), 1.0, bad)


def test_merge_guards(spark):
    panel = spark.createDataFrame([(1,), (2,)], "doc_id int")
    good = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "doc_id int, s_prob double")
    assert P.merged_scores(panel, good).count() == 2
    for bad in (good.union(good), good.filter("doc_id = 1")):
        with pytest.raises(AssertionError):
            P.merged_scores(panel, bad)


def test_total_loss(spark):
    rows = spark.createDataFrame([("a", 1, 0.1), ("a", 2, -1.0), ("a", 3, 0.1), ("b", 1, 0.1), ("b", 2, -0.5), ("c", 1, None)], "key string, at int, ret double")
    got = {r.key: r for r in V.performance(rows, "key", "at").collect()}
    assert (got["a"].growth, got["a"].max_drawdown, got["b"].max_drawdown, got["b"].n_trades) == (-1, -1, pytest.approx(-0.5), 2) and "c" not in got


def test_average_ranks_and_p(spark):
    values = [3.0, 1.0, 3.0, 2.0, 9.0, 3.0, -1.0]
    rows = spark.createDataFrame([("k", v) for v in values], "key string, v double")
    got = {r.v: r.rank_v for r in SC.average_ranks(rows, ["key"], ["v"], parts=3).collect()}
    assert got == {-1.0: 1, 1.0: 2, 2.0: 3, 3.0: 5, 9.0: 7}
    p = V.tail_probability(np.array([2.228139, 0.0, 12.7062, np.nan]), np.array([10, 5, 1, 3]))
    assert p[:3] == pytest.approx([0.05, 1.0, 0.05], abs=1e-5) and np.isnan(p[3])


def test_hac_error_by_hand(spark):
    e = np.array([0.3, -0.1, 0.4, 0.2, -0.5, 0.1])
    rows = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate(e)], "key string, at int, v double")
    got = V.hac_errors(rows, "key", "v", "at", F.lit(2)).first()
    d = e - e.mean()
    want = (d @ d + 2 * sum((1 - k / 3) * (d[k:] @ d[:-k]) for k in (1, 2))) / 36
    assert got.se == pytest.approx(want**0.5)


def test_scores_of_a_document_without_sentences(spark):
    rows = spark.createDataFrame([(1, "This is one long sentence. And here is another one."), (2, ""), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in V.document_scores(rows, V.scored_sentences(rows)).collect()}
    assert got[1].n_sentences == 2 and (got[2].n_sentences, got[2].s_prob, got[2].s_count, got[2].max_tokens) == (0, None, None, 0) and got[3].n_neu == 0


def test_a_model_is_called_in_batches(spark):
    def model():
        def score(texts):
            assert len(texts) <= 3
            return [[len(t) % 2, (len(t) + 1) % 2, -5.0] for t in texts]

        return score

    rows = spark.createDataFrame([(i, "word " * (i + 4) + "x" * (i % 2)) for i in range(20)], "doc_id int, text string")
    got = V.scored_sentences(rows, V.batched(model, 3)).collect()
    assert len(got) == 20 and all(r.label == ("positive" if len(r.sentence) % 2 else "negative") for r in got)


@pytest.mark.parametrize(
    ("url", "day"),
    [
        ("/fomc/19940204default.htm", "1994-02-04"),
        ("https://x.gov/boarddocs/press/general/1999/19990630/", "1999-06-30"),
        ("/newsevents/press/monetary/20080122b.htm", "2008-01-22"),
        ("/newsevents/pressreleases/monetary20200315a1.htm", "2020-03-15"),
        ("/monetarypolicy/fomcminutes20200429.htm", "2020-04-29"),
        ("/newsevents/pressreleases/monetary20209999a.htm", None),
        ("/other", None),
        (None, None),
    ],
)
def test_url_date(spark, url, day):
    got = spark.createDataFrame([(url,)], "url string").select(T.url_date(F.col("url")).cast("string"), T.url_host(F.col("url"))).first()
    assert got[0] == day and got[1] == ("x.gov" if url and "x.gov" in url else "")


def test_clean_text(spark):
    raw = "Skip to main content\r\n  The   Committee\tdecided. \n\n| Home |\nShares rose\n2002 Monetary policy\nhome sales fell For immediate release\n | "
    rows = spark.createDataFrame([(raw,), (None,)], "t string").select(T.clean_text(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["The Committee decided.\nhome sales fell", ""]


def test_documents_table_keeps_missing_files(spark):
    discovery = spark.createDataFrame([("a", "statement", date(2020, 3, 4)), ("b", "statement", date(2020, 3, 5)), ("c", "minutes", date(2020, 3, 6)), ("d", "note", date(2020, 3, 6))], "raw_path string, doc_type string, doc_date date")
    bodies = spark.createDataFrame([("a", "For release at 8:00 a.m. " + "x" * 600, "s"), ("c", "Page not found " + "x" * 600, "s"), ("d", "y", "s")], "raw_path string, text string, selector_used string")
    got = {r.raw_path: (r.selector_used, r.n_chars, r.is_error_page, r.is_flagged, r.release_minutes) for r in P.documents_table(discovery, bodies).collect()}
    assert got == {"a": ("s", 625, False, False, 480), "b": ("MISSING_FILE", 0, False, True, 840), "c": ("s", 615, True, True, 840)}


def test_calendar_guards(spark, sessions):
    assert P.checked_calendar(sessions).count() == len(DAYS)
    for bad in (sessions.union(sessions.limit(1)), sessions.union(spark.createDataFrame([(None, 1.0, 1.0)], sessions.schema))):
        with pytest.raises(ValueError):
            P.checked_calendar(bad)
    assert P.complete_prices(spark.createDataFrame([(1.0, None), (1.0, 2.0)], "open double, close double")).count() == 1
    assert [r.session for r in P.edges(sessions, "session", 1).orderBy("session").collect()] == [DAYS[0], DAYS[-1]]


def test_wall_clock_in_sessions_with_summer_time(spark):
    at = ["2023-10-29 00:30:00.000001", "2023-10-29 01:30:00", "2023-03-12 07:00:00", "1969-12-31 23:59:59.5", None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(at)], "i int, s string").select("i", F.to_utc_timestamp(F.col("s").cast("timestamp"), "UTC").alias("t"), F.to_timestamp(F.concat("s", F.lit(" UTC"))).alias("u"))
    for zone in ("Europe/Berlin", "America/New_York", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = [r.w for r in rows.select("i", P.local(F.col("u")).cast("string").alias("w")).orderBy("i").collect()]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == ["2023-10-28 20:30:00.000001", "2023-10-28 21:30:00", "2023-03-12 03:00:00", "1969-12-31 18:59:59.5", None]


def test_two_routes_to_the_same_z(spark):
    rows = spark.createDataFrame([("k", i, math.sin(0.7 * i) * 0.2) for i in range(40)], "k string, _pos int, v double").withColumn("id", F.col("_pos"))
    one, other = E.zscores(rows, "k", ["_pos"], "v", 6), E.zscores_by_join(rows, "k", "v", 6)
    assert E.assert_backward(one, other, ["id"]) is one
    # A window that sees the row itself, a row that is missing, and a value that should be null are all found.
    ahead = one.withColumn("z", F.when(F.col("id") == 20, F.col("z") + 1e-6).otherwise(F.col("z")))
    for bad in (ahead, one.filter("id <> 3"), one.withColumn("mu", F.coalesce("mu", F.lit(0.0)))):
        with pytest.raises(AssertionError):
            E.assert_backward(bad, other, ["id"])
    assert [r.id for r in E.differing(ahead, other, ["id"]).collect()] == [20]


def test_entries_at_the_close(spark, sessions):
    at = ["2020-03-04 10:00", "2020-03-04 16:00", "2020-03-07 12:00"]
    rows = spark.createDataFrame(list(enumerate(at)), "i int, s string").select("i", F.to_utc_timestamp("s", "America/New_York").alias("release"))
    prices = sessions.withColumn("close", F.col("close") + 10)
    got = [(round(r.ret_next_trading_open, 6), round(r.ret_same_day_close, 6)) for r in P.entry_returns(rows, prices, 1).orderBy("i").collect()]
    place = {d: i for i, d in enumerate(DAYS)}
    want = []
    for first_open, first_close in ((date(2020, 3, 5), date(2020, 3, 4)), (date(2020, 3, 5), date(2020, 3, 5)), (date(2020, 3, 9), date(2020, 3, 9))):
        a, b = place[first_open], place[first_close]
        want.append((round((111 + a) / (100 + a) - 1, 6), round((111 + b) / (110 + b) - 1, 6)))
    assert got == want


def test_documents_without_sentences_leave_the_panel_by_name(spark):
    panel = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    scores = spark.createDataFrame([(1, 2, 0.1), (2, 0, None)], "doc_id int, n_sentences int, s_prob double")
    left = P.with_sentences(panel, scores)
    assert sorted(r.doc_id for r in left.collect()) == [1, 3]
    with pytest.raises(AssertionError):  # 3 was never scored
        P.merged_scores(left, scores)


def test_agreement(spark):
    pairs = spark.createDataFrame([("positive", "positive")] * 3 + [("positive", "neutral"), ("negative", "positive"), ("other", "neutral")], "a string, b string")
    got = {(r.actual, r.said): r for r in V.agreement(pairs, "a", "b").collect()}
    assert len(got) == 9 and got["positive", "positive"].of_actual == 0.75 and got["positive", "positive"].of_said == 0.75
    assert got["neutral", "neutral"].of_actual is None and got["negative", "positive"].n == 1 and got["negative", "positive"].accuracy == 0.6
    assert got["positive", "neutral"].kappa == pytest.approx((0.6 - 16 / 25) / (1 - 16 / 25))


def test_numbered_and_first_sessions(spark):
    from tidemark.operators import scans

    rows = spark.createDataFrame([("a", i * 7 % 50, i) for i in range(50)] + [(None, 3, 99)], "k string, at int, i int").repartition(3)
    got = {(r.k, r.at): r.place for r in scans.numbered(rows, ["k"], ["at"], "place", 7).collect()}
    assert got == {("a", i): i + 1 for i in range(50)} | {(None, 3): 1}
    days = spark.createDataFrame([("2020-03-04 09:00", 2, 1.0), ("2020-03-04 08:00", 1, 2.0), (None, 3, 3.0)], "s string, n int, price double").withColumn("s", F.col("s").cast("timestamp"))
    assert [tuple(r) for r in P.first_sessions(days, "s", "n").select("n", "price", F.col("session").cast("string")).collect()] == [(1, 2.0, "2020-03-04")]
