"""The ledger: whole runs or nothing, and no address twice."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import ledger, stages

SCHEMA = "url string, doc_date string, http_status int, fetched_at_utc timestamp, content binary, extra string"


def fetched(spark, rows):
    return spark.createDataFrame([(u, "2020-01-02", 200, None, c, "x") for u, c in rows], SCHEMA).withColumn("doc_date", F.to_date("doc_date")).repartition(3)


def held(spark, root):
    return sorted((r.url, bytes(r.content)) for r in ledger.files(spark, root).collect())


def test_a_rerun_adds_nothing(spark, tmp_path):
    root = f"{tmp_path}/ledger"
    assert held(spark, root) == [] and ledger.manifest(spark, root).count() == 0
    rows = [("a", b"1"), ("b", b"\x00\xff"), ("c", None)]
    ledger.stored(fetched(spark, [*rows, (None, b"no")]), root)
    want = [("a", b"1"), ("b", b"\x00\xff"), ("c", b"")]
    assert held(spark, root) == want and len(os.listdir(f"{root}/commits")) == 1
    ledger.stored(fetched(spark, [("a", b"other"), *rows]), root)
    assert held(spark, root) == want and len(os.listdir(f"{root}/commits")) == 1
    ledger.stored(fetched(spark, [("a", b"other"), ("d", b"4"), ("d", b"4")]), root)
    assert held(spark, root) == [*want, ("d", b"4")]
    found = ledger.manifest(spark, root)
    assert found.filter(~F.col("raw_path").rlike(r"^runs/\w+/\w+/\d+_20200102_[0-9a-f]{6}\.htm$")).count() == 0
    files = ledger.files(spark, root).select("raw_path", F.sha2("content", 256).alias("sha256"))
    assert stages.verified(found, files).count() == 0 and ledger.swept(root) == 1  # the run that added nothing


def test_a_killed_run_leaves_no_row(spark, tmp_path):
    root = f"{tmp_path}/ledger"
    ledger.stored(fetched(spark, [("a", b"1")]), root)
    rows = fetched(spark, [(f"u{i}", b"x") for i in range(60)])
    broken = rows.withColumn("content", F.when(F.col("url") == "u33", F.raise_error("lost").cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        ledger.stored(broken, root)
    assert held(spark, root) == [("a", b"1")] and len(os.listdir(f"{root}/runs")) == 1  # the abort cleaned up
    # A driver that is killed cleans nothing up: files without a commit don't count, and can be swept.
    os.makedirs(f"{root}/runs/dead/task")
    open(f"{root}/commits/_dead", "w").close()
    assert held(spark, root) == [("a", b"1")] and ledger.swept(root) == 1
    ledger.stored(rows, root)
    assert len(held(spark, root)) == 61
    with pytest.raises(Exception, match="only added to"):
        rows.select("url", F.lit("n").alias("name"), "http_status", "fetched_at_utc", "content").write.format(ledger.FORMAT).option("path", root).mode("overwrite").save()
