"""WARC archives: exact round trip, revisits, rolling and damage."""

import gzip
import hashlib

import duckdb
import pytest

from tidemark.llm import queries, warc

SCHEMA = "page_id bigint, url string, html string, digest string"


def test_round_trip_with_revisits_and_rolling(spark):
    big, odd = "é" * 700, "x\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/é b\n", big, "z"), (2, None, None, "z"), (3, "u", "", "z"), (4, "u", big, "z"), (9, "u", big, "z"), (9, "u", big, "z"), (5, "u", odd, None), (6, "u", "small", None), (7, "u", "small", None), (None, "u", big, None)]
    folder, manifest = warc.write(spark.createDataFrame(rows, SCHEMA), roll=400)
    got = sorted(map(tuple, warc.read(spark, folder, manifest).drop("url").collect()), key=str)
    want = []
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        last = 9 if html == big and page_id != 9 else None
        want.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if last else "response", last))
    assert got == sorted(want, key=str) and manifest.count() > 1


def test_same_rows_give_the_same_bytes(spark):
    """Whatever the input's splits, and with more rows than Spark samples for its ranges."""
    rows = spark.range(30_000).selectExpr("id * 7 page_id", "'u' url", "repeat(concat('text ', id % 7), cast(id % 90 as int)) html", "cast(null as string) digest")
    first, again = warc.write(rows.repartition(3))[1].collect(), warc.write(rows.repartition(11, "html"))[1].collect()
    assert sorted(first) == sorted(again) and len(first) == 8


def test_damage_is_found_and_empty_tables_work(spark, tmp_path):
    rows = [(1, "u", "body " * 300, None), (2, "u", "body " * 300, None)]
    folder, manifest = warc.write(spark.createDataFrame(rows, SCHEMA), uri=str(tmp_path / "w"))
    assert warc.read(spark, folder, manifest).count() == 2
    with pytest.raises(Exception, match="manifest"):
        warc.read(spark, folder, manifest.withColumn("records", manifest["records"] + 1)).collect()
    file = next((tmp_path / "w").glob("*.warc.gz"))
    text = gzip.decompress(file.read_bytes())
    file.write_bytes(gzip.compress(text.replace(b"X-Page-Id: 1", b"X-Page-Id: 7"), mtime=0))
    with pytest.raises(Exception, match="manifest"):
        warc.read(spark, folder, manifest).collect()
    file.write_bytes(gzip.compress(text.replace(b"X-Refers-To-Page: 2", b"X-Refers-To-Page: 5"), mtime=0))
    listed = [(file.name, 2, file.stat().st_size, hashlib.sha256(file.read_bytes()).hexdigest())]
    with pytest.raises(Exception, match="revisit"):
        warc.read(spark, folder, spark.createDataFrame(listed, manifest.schema)).collect()
    folder, manifest = warc.write(spark.createDataFrame([], SCHEMA))
    assert warc.read(spark, folder, manifest).count() == 0


def test_temporary_files_are_removed(spark, tmp_path):
    (tmp_path / "_temporary-of-a-lost-task").write_text("x")
    warc.write(spark.createDataFrame([(1, "u", "body", None)], SCHEMA), uri=str(tmp_path))
    assert [f.name for f in tmp_path.iterdir() if f.name.startswith("_temporary")] == []


def test_the_archive_holds_its_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "body", None), (2, "u", "more", None)], SCHEMA)
    with pytest.raises(Exception, match="manifest"):
        warc.read(spark, str(tmp_path)).collect()
    warc.write(rows, uri=str(tmp_path))
    assert sorted(f.name for f in tmp_path.iterdir()) == ["manifest", "part-000001-00000.warc.gz"]
    (tmp_path / "part-000009-00000.warc.gz").write_bytes(b"left by a run that was killed")
    assert warc.read(spark, str(tmp_path)).count() == 2
    warc.write(rows.filter("page_id = 2"), uri=str(tmp_path))
    assert [r.page_id for r in warc.read(spark, str(tmp_path)).collect()] == [2]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    if not con.execute("SELECT count(*) FROM duckdb_functions() WHERE function_name = 'sha1'").fetchone()[0]:
        pytest.skip("no sha1")
    want = con.execute(queries.OP1_SQL)
    names = [d[0] for d in want.description]
    got = queries.op1_warc(spark, sf).select(*names)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
