"""The stream equals the batch however the series is cut, restarts from its state, and never changes the past."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import events as E
from tidemark.streaming import zscores as Z

SCHEMA = "id bigint, at bigint, k string, v double"


def series():
    rng = random.Random(5)
    rows = [(i, i // 3, rng.choice(["a", "a", "a", "b", None]), None if rng.random() < 0.05 else round(rng.gauss(0, 1), 3)) for i in range(240)]
    return rows + [(500 + i, 100 + i, "flat", 0.5) for i in range(9)]


def streamed(spark, folder, batches, name="s"):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}-in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/{name}-in")
        found = Z.run(spark, Z.zscores(stream, "k", F.col("at"), "id", "v", 6, 1.0), f"{folder}/{name}-out", f"{folder}/{name}-checkpoint")
    return {r.id: r for r in found.collect()}


def plain(r):
    return r.id, *[None if x is None else round(x, 9) for x in (r.mu, r.sigma, r.z)], r.position, r.turnover


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    rows = series()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.coalesce("k", F.lit("-")))
    z = E.zscores(df, "k", ["at", "id"], "v", 6).withColumn("position", E.positions(F.col("z"), 1.0))
    want = sorted(plain(r) for r in E.turnover(z, "k", ["at", "id"]).collect())
    ordered = sorted(rows, key=lambda r: r[1])
    # Each cut is a run of its own, which restarts from the checkpoint; within a cut rows come in any order.
    cuts = [ordered[:7], random.Random(1).sample(ordered[7:150], 143), ordered[150:]]
    got = streamed(spark, str(tmp_path), cuts)
    assert sorted(plain(r) for r in got.values()) == want and not any(r.late for r in got.values())


def test_later_rows_leave_the_past(spark, tmp_path):
    rows = [(i, i, "a", float(np.sin(0.7 * i))) for i in range(20)]
    first = streamed(spark, str(tmp_path), [rows], "x")
    again = streamed(spark, str(tmp_path), [[(90, 3, "a", 9.0), (19, 19, "a", 1.0), (21, None, "a", 1.0), (30, 30, "a", 99.0)]], "x")
    assert {i: plain(r) for i, r in again.items() if i in first and i != 19} == {i: plain(r) for i, r in first.items() if i != 19}
    assert again[90].late and again[90].z is None and again[90].position is None and again[21].late and not again[30].late and again[30].position == 1


def test_parameters(spark):
    with pytest.raises(ValueError):
        Z.zscores(spark.createDataFrame([], SCHEMA), "k", F.col("at"), "id", "v", 1, 1.0)
    mu, sigma, z = Z.scored(np.array([]), np.array([0.5] * 6 + [0.9]), 6)
    assert sigma[6] == 0 and np.isnan(z).all() and np.isnan(mu[5])
