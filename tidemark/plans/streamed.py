"""Queries that run as streams, each with the SQL of its batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.sources.stages import fresh_dir
from tidemark.streaming import zscores as Z

SLICES = 3
EVENTS = "event_id bigint, ts timestamp_ntz, event_type string, value double"


def streamed_signal(spark: SparkSession, sf: str) -> DataFrame:
    """The signal of all events, which arrive in slices of time. Each slice is a run of the stream of its own, which
    carries on from the state that the one before it left."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "event_type", "value")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(at), F.max(at)).first()
    folder = fresh_dir(spark, "events-stream")
    cut = F.when(at.isNull(), 0).otherwise(F.floor((at - (first or 0)) * SLICES / ((last or 0) - (first or 0) + 1)))
    for k in range(SLICES):
        events.filter(cut == k).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(EVENTS).parquet(f"{folder}/in")
        found = Z.run(spark, Z.zscores(stream, "event_type", at, "event_id", "value", catalog.LOOKBACK, catalog.THETA), f"{folder}/out", f"{folder}/checkpoint")
    return found.select(F.col("id").alias("event_id"), "late", *[F.round(c, 6).alias(c) for c in ("mu", "sigma", "z")], "position", "turnover")


QUERIES = {"streamed_signal": streamed_signal}
ORACLES = {"streamed_signal": f"WITH {catalog._SIGNAL} SELECT event_id, FALSE AS late, round(mu, 6) AS mu, round(sigma, 6) AS sigma, round(z, 6) AS z, position, CAST(turnover AS INTEGER) AS turnover FROM t"}
