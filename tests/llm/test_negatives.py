"""Hard negatives against plain inner products, in one and in many blocks, and against the SQL."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives
from tidemark.llm.queries import OP13_SQL, op13_negatives

SF = "/root/testdata/sf0.01"


def brute(rows):
    out, rows = [], sorted(set(rows))
    for a, la, xa in rows:
        if a % 10:
            continue
        near = sorted((-sum(p * q for p, q in zip(xa, x, strict=True)), i) for i, y, x in rows if y == la and i != a)[:5]
        for s, i in near:
            hits = sorted((-sum(p * q for p, q in zip(xa, x, strict=True)), j) for j, y, x in rows if y != la and j != a)
            hits = [(t, j) for t, j in hits if 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("dims, most", [(11, 300), (8, 1 << 29), (3, 2)])
def test_equals_brute_force_in_any_blocks(spark, dims, most):
    rng = np.random.default_rng(dims)
    centre = rng.integers(-most // 2, most // 2 + 1, (3, dims))
    rows = [(i, int(y), [int(v) for v in np.clip(centre[y] + rng.integers(-most // 2, most // 2 + 1, dims), -most, most)]) for i, y in enumerate(rng.choice(3, 260, p=[0.8, 0.15, 0.05]))]
    rows += rows[:15]
    df = spark.createDataFrame(rows, "id bigint, label bigint, x array<bigint>")
    want = brute([(i, y, tuple(x)) for i, y, x in rows])
    assert len(want) > 50
    for block, part in ((1 << 14, 1 << 13), (17, 4)):
        got = negatives.mined(df, df.filter("id % 10 = 0"), dims=dims, block=block, part=part)
        assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == want


def test_tables_score_exactly():
    rng = np.random.default_rng(1)
    x, a = rng.integers(-256, 257, (500, 64)), rng.integers(-256, 257, (70, 64))
    x[0], a[0] = -256, -256
    got = negatives.Planes(x, 10).scores(negatives.tables_of(a, np.int32), 0, 500)
    assert (got == x @ a.T).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables")
def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = con.execute(OP13_SQL)
    names = [d[0] for d in want.description]
    rows = sorted(want.fetchall())
    assert sorted(tuple(r) for r in op13_negatives(spark, SF).select(*names).collect()) == rows and len(rows) > 50


def test_defined_cases(spark):
    one, nan = [1.0] * 4, [1.0, float("nan"), 1.0, 1.0]
    rows = [(0, one, 1, "x"), (0, one, 1, "x"), (5, one, 1, "x"), (6, None, 1, "x"), (7, nan, 1, "x"), (8, [1.0, None, 1.0, 1.0], 1, "x"), (9, [float("inf")] * 4, 1, "x"), (None, one, 1, "x"), (3, [0.5] * 4, 2, "x"), (2, [0.5] * 4, 2, "x"), (4, one[:3], 2, "x"), (1, one, None, "x"), (10, one, 3, "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, id string")
    few = negatives.quantised(df, F.col("label"), dims=4)
    assert sorted(r.id for r in few.collect()) == [0, 0, 2, 3, 5, 10]
    got = sorted(tuple(r) for r in negatives.mined(few, few.filter("id % 10 = 0"), dims=4).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == [(0, 5, 1, 2, 262144, 131072), (0, 5, 2, 3, 262144, 131072)]
    assert negatives.mined(few.limit(0), few.limit(0), dims=4).count() == 0
    with pytest.raises(ValueError):
        negatives.mined(few.withColumn("x", F.array(*[F.lit(1 << 40)] * 4)), few, dims=4)
