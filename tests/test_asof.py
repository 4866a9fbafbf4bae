"""As-of joins over ranges against bisection."""

import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof


def brute(left, right, forward, strict):
    out = {}
    for i, k, t in left:
        times = sorted((u, v) for kk, u, v in right if kk == k and u is not None)
        best = {}
        for u, v in times:
            best.setdefault(u, v)
            best[u] = min(best[u], v) if forward else max(best[u], v)
        us = sorted(best)
        if t is None:
            out[i] = None
        elif forward:
            j = (bisect_right if strict else bisect_left)(us, t)
            out[i] = best[us[j]] if j < len(us) else None
        else:
            j = (bisect_left if strict else bisect_right)(us, t) - 1
            out[i] = best[us[j]] if j >= 0 else None
    return out


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("strict", [True, False])
def test_equals_bisection(spark, forward, strict):
    rng = random.Random(2)
    # A third of the rows share one time, and a range may hold rows of one side only.
    left = [(i, rng.choice(["a", "b", None]), None if i % 50 == 0 else 100 if i % 3 == 0 else rng.randint(0, 300)) for i in range(400)]
    right = [(rng.choice(["a", "b", "c", None]), rng.choice([None, 100, *range(40, 250, 7)]), j) for j in range(60)]
    a, b = spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, u int, v int")
    got = asof.joined(a, b, "t", "u", ["v"], ["k"], forward, strict, parts=13)
    assert got.columns == ["i", "k", "t", "v"] and {r.i: r.v for r in got.collect()} == brute(left, right, forward, strict)


def test_empty_sides_and_clashes(spark):
    a, b = spark.createDataFrame([(1, 5)], "i int, t int"), spark.createDataFrame([(7, 9)], "u int, v int")
    assert asof.joined(a, b.limit(0), "t", "u", ["v"]).collect()[0].v is None and asof.joined(a.limit(0), b, "t", "u", ["v"]).count() == 0
    with pytest.raises(ValueError):
        asof.joined(a, b.withColumnRenamed("v", "i"), "t", "u", ["i"])


def test_hours_of_their_own(spark):
    sessions = spark.createDataFrame([("2020-03-03", 570), ("2020-03-04", 780), ("2020-03-06", 570)], "s string, open_minutes int").select(F.to_date("s").alias("session"), "open_minutes")
    zone = lambda x: F.to_timestamp(F.lit(x + " America/New_York"), "yyyy-MM-dd HH:mm VV")
    times = ["2020-03-04 09:45", "2020-03-04 12:59", "2020-03-04 13:00", "2020-03-05 10:00", "2020-03-06 09:30"]
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), zone(x).alias("release")) for i, x in enumerate(times)])).alias("r")).select("r.*")
    assert [str(r.entry) for r in asof.next_open(rows, sessions, parts=3).orderBy("i").collect()] == ["2020-03-04", "2020-03-04", "2020-03-06", "2020-03-06", "None"]
    with pytest.raises(ValueError):
        asof.next_open(rows.withColumn("release", F.col("release").cast("timestamp_ntz")), sessions)
