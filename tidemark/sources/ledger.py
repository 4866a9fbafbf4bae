"""A write-once store of raw files with its manifest, as a data source of Spark's Python API.

A run's tasks write their files, and one Parquet part of manifest rows each, under ``runs/<run>/<attempt>``: names that
no other attempt uses. Only when all of them are done does the driver write ``commits/<run>.json``, which names the
parts, under a temporary name, and rename it. Readers see what commits name and nothing else, so a run that was killed
leaves no row and no file that counts (``swept`` removes what it left), a lost task is simply written again, and files
that were committed are never touched. The folder is one that pyarrow can open, such as ``spark.checkpoint.dir``'s.

``stored`` adds the rows whose address the ledger lacks: a second run over the same rows adds nothing. One run at a
time may write; of rows of one address the first by ``order`` is taken. Null contents are stored as empty files; rows
without an address are left out."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tidemark.functions import text as T
from tidemark.sources.stages import SCHEMAS, first_of, not_fetched

FORMAT = "tidemark_ledger"
ROWS = pa.schema([("url", pa.string()), ("raw_path", pa.string()), ("http_status", pa.int32()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("fetched_at_utc", pa.timestamp("us", "UTC"))])
#: Manifest rows that a task holds at a time.
BATCH = 1000


def opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def committed(root: str) -> list[tuple[str, str]]:
    """Of each committed run its name and the folder of each of its tasks."""
    files, top = opened(root)
    found = []
    for info in files.get_file_info(fs.FileSelector(f"{top}/commits", allow_not_found=True)):
        if info.base_name.endswith(".json") and not info.base_name.startswith("_"):
            with files.open_input_stream(info.path) as f:
                found += [(info.base_name.removesuffix(".json"), part) for part in json.loads(f.read())["parts"]]
    return sorted(found)


class Ledger(DataSource):
    """Options: ``path``. Read: the manifest's columns and ``content``. Written: ``url, name, http_status,
    fetched_at_utc, content``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMAS["manifest"] + ", content BINARY"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a ledger is only added to")
        return Writer(self.options["path"], uuid.uuid4().hex)


class Part(InputPartition):
    def __init__(self, folder: str):
        self.folder = folder


class Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Part]:
        """One for each task that wrote; a ledger without any has one that is empty."""
        return [Part(f) for _, f in committed(self.root)] or [Part("")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.folder:
            return
        files, top = opened(self.root)
        with files.open_input_file(f"{top}/{partition.folder}/manifest.parquet") as f:
            for batch in pq.ParquetFile(f).iter_batches(BATCH):
                for row in batch.to_pylist():
                    with files.open_input_stream(f"{top}/{row['raw_path']}") as raw:
                        yield (*row.values(), raw.read())


class Written(WriterCommitMessage):
    def __init__(self, folder: str, rows: int):
        self.folder, self.rows = folder, rows


class Writer(DataSourceWriter):
    def __init__(self, root: str, run: str):
        self.root, self.run = root, run

    def write(self, iterator: Iterator) -> Written:
        files, top = opened(self.root)
        folder, rows, held = f"runs/{self.run}/{uuid.uuid4().hex}", 0, []
        files.create_dir(f"{top}/{folder}")
        with files.open_output_stream(f"{top}/{folder}/manifest.parquet") as sink, pq.ParquetWriter(sink, ROWS) as out:
            for row in iterator:
                content = bytes(row.content or b"")
                # The number keeps apart addresses whose names are the same.
                path = f"{folder}/{rows}_{row.name}"
                with files.open_output_stream(f"{top}/{path}") as raw:
                    raw.write(content)
                held.append({"url": row.url, "raw_path": path, "http_status": row.http_status, "n_bytes": len(content), "sha256": hashlib.sha256(content).hexdigest(), "fetched_at_utc": row.fetched_at_utc})
                rows += 1
                if len(held) == BATCH:
                    out.write_table(pa.Table.from_pylist(held, ROWS))
                    held = []
            if held:
                out.write_table(pa.Table.from_pylist(held, ROWS))
        return Written(folder, rows)

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted(m.folder for m in messages if m is not None and m.rows)
        if not parts:
            return
        files, top = opened(self.root)
        files.create_dir(f"{top}/commits")
        with files.open_output_stream(f"{top}/commits/_{self.run}") as f:
            f.write(json.dumps({"parts": parts}).encode())
        files.move(f"{top}/commits/_{self.run}", f"{top}/commits/{self.run}.json")

    def abort(self, messages: list[Written | None]) -> None:
        files, top = opened(self.root)
        if files.get_file_info(f"{top}/runs/{self.run}").type == fs.FileType.Directory:
            files.delete_dir(f"{top}/runs/{self.run}")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The manifest's rows alone, read by Spark."""
    parts = [f"{root.rstrip('/')}/{folder}/manifest.parquet" for _, folder in committed(root)]
    return spark.read.schema(SCHEMAS["manifest"]).parquet(*parts) if parts else spark.createDataFrame([], SCHEMAS["manifest"])


def files(spark: SparkSession, root: str) -> DataFrame:
    """The manifest's rows with the ``content`` of their files, read by the tasks."""
    spark.dataSource.register(Ledger)
    return spark.read.format(FORMAT).option("path", root).load()


def stored(fetched: DataFrame, root: str, *order: str) -> None:
    """Add the rows of ``fetched`` (``url, doc_date, http_status, fetched_at_utc, content``) that the ledger lacks."""
    spark = fetched.sparkSession
    spark.dataSource.register(Ledger)
    new = first_of(not_fetched(fetched.filter(F.col("url").isNotNull()), manifest(spark, root)), "url", *(order or ("fetched_at_utc",)))
    rows = new.select("url", T.raw_name(F.coalesce("doc_date", F.lit("1970-01-01").cast("date")), F.col("url")).alias("name"), F.col("http_status").cast("int").alias("http_status"), F.col("fetched_at_utc").cast("timestamp").alias("fetched_at_utc"), F.col("content").cast("binary").alias("content"))
    rows.write.format(FORMAT).option("path", root).mode("append").save()


def swept(root: str) -> int:
    """Remove the folders of runs that never committed, and how many. No run may be writing."""
    source, top = opened(root)
    known, gone = {part.split("/")[1] for _, part in committed(root)}, 0
    for info in source.get_file_info(fs.FileSelector(f"{top}/runs", allow_not_found=True)):
        if info.base_name not in known:
            source.delete_dir(info.path)
            gone += 1
    return gone
