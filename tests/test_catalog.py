"""Each event-study query against its SQL oracle, on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import text as T
from tidemark.operators import events as E
from tidemark.plans import panel, reports, streamed, trained

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES | panel.QUERIES | reports.QUERIES | trained.QUERIES | streamed.QUERIES, catalog.ORACLES | panel.ORACLES | reports.ORACLES | trained.ORACLES | streamed.ORACLES


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("orders", "documents", "events", "lineitem", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    plain = lambda rows: sorted(tuple(str(round(x, 9) + 0.0 if isinstance(x, float) else x) for x in r) for r in rows)
    assert plain(got.select(*names).collect()) == plain(want.fetchall())


def test_constant_series_has_no_z_and_null_is_flat(spark):
    rows = spark.createDataFrame([("a", i, 0.5 if i < 6 else 0.9) for i in range(7)], "k string, i int, v double")
    z = E.zscores(rows, "k", ["i"], "v", 6).orderBy("i").collect()
    assert z[6]["sigma"] == 0.0 and z[6]["z"] is None and z[5]["mu"] is None
    with pytest.raises(ValueError):
        E.zscores(rows, "k", ["i"], "v", 1)


def test_equality_with_the_open_loses(spark):
    sessions = spark.createDataFrame([("2020-03-03",), ("2020-03-04",), ("2020-03-06",)], "s string").selectExpr("date(s) session")
    r = spark.createDataFrame([(1, "2020-03-04", 569), (2, "2020-03-04", 570), (3, "2020-03-05", 900), (4, "2020-03-06", 571), (5, None, 1)], "i int, d string, minutes int").selectExpr("i", "date(d) day", "minutes")
    assert [str(x.entry) for x in E.next_open(r, sessions).orderBy("i").collect()] == ["2020-03-04", "2020-03-06", "2020-03-06", "None", "None"]


def test_text_functions(spark):
    texts = ["For release at 2:00 p.m. EDT. Voting against the action. 2 Members of the board met.", "for release at 13.00 a.m", "PAGE NOT FOUND", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(T.release_minutes(F.col("t")).alias("m"), T.is_error_page(F.col("t")).alias("e"), T.sentences(F.col("t")).alias("s"), "i").orderBy("i").collect()
    assert [r.m for r in rows] == [840, None, None, None, None] and [r.e for r in rows] == [False, False, True, False, False]
    assert rows[0].s == ["For release at 2:00 p.m.", "Voting against the action.", "2 Members of the board met."] and rows[3].s == rows[4].s == []
