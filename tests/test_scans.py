"""Ranks, quantiles, running means and equity over many ranges against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as V
from tidemark.operators import scans as S


def keyed(spark, seed=1, n=600):
    rng = np.random.default_rng(seed)
    # One key holds most rows, one value a third of them.
    rows = [(("a", "a", "a", "b", None)[rng.integers(5)], i, None if rng.random() < 0.05 else 7.0 if rng.random() < 0.33 else float(rng.integers(-40, 40)) / 4, float(rng.normal())) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, i int, v double, w double").repartition(5)


@pytest.mark.parametrize("parts", [1, 9])
def test_ranks_and_quantiles(spark, parts):
    rows, df = keyed(spark)
    own = pd.DataFrame(rows, columns=["k", "i", "v", "w"]).dropna(subset=["v"])
    own["k"] = own["k"].fillna("-")
    want = {int(i): (a, b) for i, a, b in zip(own["i"], own.groupby("k")["v"].rank(), own.groupby("k")["w"].rank(), strict=True)}
    got = S.average_ranks(df, ["k"], ["v", "w"], parts).collect()
    assert {r.i: (r.rank_v, r.rank_w) for r in got} == want and len(got) == len(want)
    probs = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    for r in S.quantiles(df, ["k"], "v", probs, parts).collect():
        values = own[own["k"] == (r.k or "-")]["v"]
        assert r.n == len(values) and r.q == pytest.approx(list(np.quantile(values, probs)))
    whole = S.quantiles(df, [], "w", [0.5], parts).first()
    assert whole.n == 600 and whole.q == pytest.approx([np.median([r[3] for r in rows])])
    assert S.quantiles(df.filter("k = 'z'"), ["k"], "v", [0.5], parts).count() == 0


def test_no_window_spans_a_key(spark):
    _, df = keyed(spark)
    plan = S.ordered(df, ["k"], "v", 9)._jdf.queryExecution().toString()
    assert "Window" in plan and "v#" not in plan.split("Window")[1].split("\n")[0]


@pytest.mark.parametrize("parts", [1, 9])
def test_expanding(spark, parts):
    rows, df = keyed(spark)
    got = {r.i: (r.n_before, r.mean_before) for r in S.expanding(df, ["k"], ["i"], "v", parts).collect()}
    seen = {}
    for k, i, v, _ in rows:
        past = seen.setdefault(k, [])
        assert got[i][0] == len(past) and (got[i][1] == pytest.approx(np.mean(past)) if past else got[i][1] is None)
        past += [] if v is None else [v]
    assert len(got) == len(rows)


@pytest.mark.parametrize("parts", [1, 11])
def test_equity_across_ranges(spark, parts):
    rng = np.random.default_rng(3)
    rows = [(k, i, float(r)) for k, n in (("a", 300), ("b", 120), ("lost", 200), ("up", 30)) for i, r in enumerate(rng.normal(0.001, 0.05, n) if k != "up" else np.full(n, 0.01))]
    rows = [(k, i, -1.2 if k == "lost" and i == 90 else r) for k, i, r in rows] + [("a", 999, None)]
    df = spark.createDataFrame(rows, "k string, i int, ret double").repartition(4)
    got = {(r.k, r.i): (r.equity, r.fall) for r in S.equity(df, ["k"], ["i"], "ret", parts).collect()}
    for k in ("a", "b", "lost", "up"):
        level, top, gone = 1.0, 1.0, False
        for key, i, r in rows:
            if key == k and r is not None:
                gone |= r <= -1
                level = 0.0 if gone else level * (1 + r)
                top = max(top, level)
                assert got[k, i] == pytest.approx((level, level / top - 1), abs=1e-9), (k, i)
    assert len(got) == len(rows) - 1
    falls = {r.key: r.max_drawdown for r in V.performance(df.withColumnRenamed("k", "key"), "key", "i").collect()}
    assert falls["lost"] == -1 and falls["up"] == 0


def test_resamples_equal_plain_ranks():
    import hashlib

    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 9, 60).astype(float), rng.normal(size=60)
    for b, ic in enumerate(V.resampled(x, y, [0, 1, 2], 42)):
        at = [int(hashlib.md5(f"42:{b}:{i}".encode()).hexdigest()[:8], 16) % 60 for i in range(60)]
        assert ic == pytest.approx(pd.Series(x[at]).rank().corr(pd.Series(y[at]).rank()))
    assert np.isnan(V.resampled(np.zeros(5), np.arange(5.0), [0], 1)[0])


def test_interval_does_not_depend_on_the_tasks(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, float(a), float(a + b)) for i, (a, b) in enumerate(rng.normal(size=(80, 2)))], "i int, x double, y double")
    one, many = (V.bootstrap(df.repartition(3), "x", "y", "i", 50, groups=g).first() for g in (1, 7))
    assert one == many and one.rounds == 50 and 0 < one.low < one.high < 1
    with pytest.raises(ValueError):
        V.bootstrap(df.limit(2), "x", "y", "i", 5)
    assert V.bootstrap(df.withColumn("x", F.lit(1.0)), "x", "y", "i", 5).first().rounds == 0
