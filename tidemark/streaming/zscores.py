"""Trailing Z-scores, positions and turnover of keyed series that arrive as a stream.

Spark's streaming windows span times, not rows, so the last rows of each key are kept as state: a ring buffer of
``window`` values, the place of the last row and its position. A micro-batch of a key is put in order and worked on at
once. What is emitted for a row depends on it and the rows before it alone, so a row's result is final: more data leave
it as it is, and it equals the batch operators' result when the rows of a key come in order, however they are cut into
batches.

Defined cases: rows that come after a later one of their key was seen are emitted with ``late`` true and without Z,
position or turnover, and don't count; ties of time go by id, and a row of the same time and id comes late; a null
value gives no Z and none to the ``window`` rows after it; a null time or id comes late; a null key is a key. A
key's rows of one micro-batch are held by one task: bound it by the files that a trigger takes (``maxFilesPerTrigger``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the session must use to hold such state.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STATE = "past array<double>, at bigint, id bigint, position int"
OUT = "key string, id bigint, late boolean, mu double, sigma double, z double, position int, turnover int"


def scored(past: np.ndarray, values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``mu, sigma, z`` of ``values``, which follow the values ``past``; NaN where they aren't defined."""
    line = np.concatenate([np.full(window, np.nan), past, values])[-(window + len(values)) :]
    before = np.lib.stride_tricks.sliding_window_view(line, window)[: len(values)]
    mu = before.mean(axis=1)
    sigma = np.sqrt(((before - mu[:, None]) ** 2).sum(axis=1) / (window - 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return mu, sigma, np.where(sigma > 0, (values - mu) / sigma, np.nan)


class TrailingZ(StatefulProcessor):
    def __init__(self, window: int, theta: float, sign: int):
        self.window, self.theta, self.sign = window, theta, sign

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get()
        past, at, id_, position = (held[0], held[1], held[2], held[3]) if held else ([], None, None, 0)
        new = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable", na_position="last").reset_index(drop=True)
        known = new["at"].notna() & new["id"].notna()
        late = ~known | new.duplicated(["at", "id"])
        if at is not None:
            late |= (new["at"] < at) | ((new["at"] == at) & (new["id"] <= id_))
        out = pd.DataFrame({"key": [key[0]] * len(new), "id": new["id"].astype("Int64"), "late": late})
        out[["mu", "sigma", "z"]] = np.nan
        out["position"] = out["turnover"] = pd.array([None] * len(out), "Int32")
        own = new[~late]
        if len(own):
            values = own["value"].to_numpy(float)
            mu, sigma, z = scored(np.array(past, float), values, self.window)
            side = np.where(z > self.theta, self.sign, np.where(z < -self.theta, -self.sign, 0)).astype(int)
            turned = np.abs(np.diff(np.r_[position, side]))
            for name, column in (("mu", mu), ("sigma", sigma), ("z", z)):
                out.loc[own.index, name] = column
            out.loc[own.index, "position"], out.loc[own.index, "turnover"] = side, turned
            last = np.r_[np.array(past, float), values][-self.window :]
            self.state.update(([None if np.isnan(v) else float(v) for v in last], int(own["at"].iloc[-1]), int(own["id"].iloc[-1]), int(side[-1])))
        floats = ["mu", "sigma", "z"]
        out[floats] = out[floats].astype(object).where(out[floats].notna(), None)
        yield out

    def close(self) -> None:
        pass


def zscores(stream: DataFrame, key: str, at: Column, id_: str, value: str, window: int, theta: float, sign: int = 1) -> DataFrame:
    """``key, id, late, mu, sigma, z, position, turnover`` of each row of a stream, in append mode. ``at`` is a whole
    number that rises with time."""
    if window < 2:
        raise ValueError("a window holds two rows at least")
    if sign not in (1, -1):
        raise ValueError("sign is 1 or -1")
    rows = stream.select(F.col(key).cast("string").alias("key"), at.cast("bigint").alias("at"), F.col(id_).cast("bigint").alias("id"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=TrailingZ(window, theta, sign), outputStructType=OUT, outputMode="Append", timeMode="None")


def run(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Works off what the stream has now, then stops; what was written so far, each row once. A later run with the same
    folders carries on where this one, or one that failed, stopped."""
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STATE_STORE[0], before)
    return spark.read.schema(OUT).parquet(out)


def files(spark: SparkSession, folder: str, schema: str, each: int = 1) -> DataFrame:
    """A stream of a folder's Parquet files, oldest first, ``each`` of them at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", each).parquet(folder)
