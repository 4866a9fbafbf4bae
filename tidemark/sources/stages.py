"""The stage tables of an event study: their schemas, readers and writers, and the manifest of raw files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "manifest": "url STRING, raw_path STRING, http_status INT, n_bytes BIGINT, sha256 STRING, fetched_at_utc TIMESTAMP",
    "discovery": "doc_type STRING, doc_date DATE, url STRING, anchor_text STRING, meeting_heading STRING, is_scheduled BOOLEAN, source_index STRING, raw_path STRING",
    "documents": "doc_type STRING, doc_date DATE, url STRING, is_scheduled BOOLEAN, raw_path STRING, text STRING, n_chars INT, selector_used STRING, release_datetime TIMESTAMP, release_time_source STRING, parsed_release_time STRING, is_error_page BOOLEAN, is_flagged BOOLEAN",
    "panel": "doc_id STRING, doc_type STRING, doc_date DATE, url STRING, is_scheduled BOOLEAN, raw_path STRING, n_chars INT, selector_used STRING, release_datetime TIMESTAMP, release_time_source STRING, parsed_release_time STRING, is_error_page BOOLEAN, is_flagged BOOLEAN, entry_date DATE, fwd_ret_1 DOUBLE, fwd_ret_3 DOUBLE, fwd_ret_5 DOUBLE, fwd_ret_10 DOUBLE, fwd_ret_20 DOUBLE",
    "prices": "date DATE, Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE, Volume BIGINT",
    "sentences": "doc_id STRING, doc_date DATE, sentence_idx INT, sentence STRING, p_pos DOUBLE, p_neg DOUBLE, p_neu DOUBLE, label STRING, n_tokens INT, is_boilerplate BOOLEAN",
    "doc_scores": "doc_id STRING, doc_date DATE, is_scheduled BOOLEAN, n_chars INT, S_count DOUBLE, S_prob DOUBLE, n_sentences INT, n_pos INT, n_neg INT, n_neu INT, n_boilerplate INT, mean_confidence DOUBLE, max_tokens INT",
}
#: Tables kept as CSV; the others are Parquet.
CSV = ("manifest", "doc_scores")


def schema(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


def write(df: DataFrame, table: str, path: str, *order: str) -> None:
    """Write the columns of the table's schema to a new folder (an existing one is an error: reading and overwriting
    the same files loses them), sorted within files by ``order``."""
    fields = schema(table).fields
    df = df.select(*[F.col(f.name).cast(f.dataType) for f in fields])
    if order:
        df = df.sortWithinPartitions(*order)
    if table in CSV:
        df.write.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)
    else:
        df.write.parquet(path)


def read(spark: SparkSession, table: str, path: str) -> DataFrame:
    """The table with its schema pinned; a CSV table that isn't there is empty."""
    kinds = schema(table)
    if table not in CSV:
        return spark.read.schema(kinds).parquet(path)
    try:
        return spark.read.schema(kinds).option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kinds)


def raw_files(spark: SparkSession, folder: str) -> DataFrame:
    """``raw_path`` (file name), ``n_bytes`` and ``sha256`` of the files of a folder."""
    found = spark.read.format("binaryFile").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("raw_path"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def verified(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``raw_path, issue`` of the manifest's fetched rows (status 200) whose file is missing or has changed."""
    have = files.select("raw_path", F.col("sha256").alias("_found"))
    both = manifest.filter("http_status = 200").join(have, "raw_path", "left")
    issue = F.when(F.col("_found").isNull(), "file_missing").when(F.col("_found") != F.col("sha256"), "sha256_mismatch")
    return both.select("raw_path", issue.alias("issue")).filter("issue is not null")


def not_fetched(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """The rows whose address the manifest doesn't have yet."""
    return wanted.join(manifest.select("url").distinct(), "url", "left_anti")


def appended(manifest: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of a manifest are only ever added."""
    return manifest.unionByName(more.select(*manifest.columns))


def first_of(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row of each key, the first by ``order``; a null key is a key."""
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_first = 1").drop("_first")


_local: dict[str, str] = {}


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path that no other run uses, in the folder that the driver and all executors share: the session's
    ``spark.checkpoint.dir``. Only a local session may leave that unset, and gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-stage-")
        folder = _local[context.applicationId]
    return f"{folder.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: work done once, lineage cut, safe to recompute from."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
