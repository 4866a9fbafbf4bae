"""Tables, row keys and shared stage tables for the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that hold a row's identity while its text travels; clashing input columns are not read.
KEY = ["doc_id", "text_hash"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``. Only a local session (tests) may
    leave it unset, and gets a temporary folder, one for each application; on a cluster that would lose data."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
        found = _local[context.applicationId]
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: work done once, lineage cut, safe to recompute from."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While it lasts, tasks hand at most so many rows at a time to Python, for rows that are whole texts: at the
    default of 10,000 a task holds its whole split once more on either side. Only what runs meanwhile is affected."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(min(before, rows) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def text_hash(column: str | Column = "text") -> Column:
    """With ``doc_id``, tells rows apart even where ids repeat; rows equal in both are the same document twice."""
    return F.xxhash64(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on the row key that also matches null ids."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, the row key and the whole text (null: empty); other columns stay behind."""
    return docs.select("doc_id", text_hash(text).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
