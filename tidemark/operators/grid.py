"""The signal of every cell of a parameter grid in one pass over the series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import events as E


def crossed(df: DataFrame, **axes: list) -> DataFrame:
    """Each row once for each cell of the axes: a column of each name."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return df


def trailing_signals(series: DataFrame, key: str, order: list[str], part: Column, value: str, lookbacks: list[int], thetas: list[float], sign: int = 1) -> DataFrame:
    """``series`` with ``lookback, theta, z, position, turnover``, a row for each cell. The series are cut into blocks
    once; the trailing windows of all lookbacks are frames of one window over them, and so is each Z's predecessor,
    from which the turnover of every threshold follows without another sort."""
    cut, over = E.blocks(E.placed(series, key, order, part), key, max(lookbacks) + 1)
    for n in lookbacks:
        cut = E.zscores(cut, key, [], value, n, over).drop("mu", "sigma").withColumnRenamed("z", f"_z{n}")
    cells = [F.struct(F.lit(n).alias("lookback"), F.col(f"_z{n}").alias("z"), F.lag(f"_z{n}").over(over).alias("z_before")) for n in lookbacks]
    cut = cut.withColumn("_cells", F.array(*cells)).drop(*[f"_z{n}" for n in lookbacks])
    each = crossed(E.own(cut).withColumn("_cell", F.explode("_cells")), theta=thetas)
    z, theta = F.col("_cell.z"), F.col("theta")
    position, earlier = E.positions(z, theta, sign), E.positions(F.col("_cell.z_before"), theta, sign)
    return each.select(*series.columns, F.col("_cell.lookback").alias("lookback"), "theta", z.alias("z"), position.alias("position"), F.abs(position - earlier).alias("turnover"))


def per_cell(signals: DataFrame, axes: list[str], fwd: str) -> DataFrame:
    """Of each cell the rows, the usable ones, the positions, the turnover and the mean return that follows."""
    p = F.col("position")
    return signals.groupBy(*axes).agg(F.count("*").alias("n"), F.count("z").alias("n_usable"), F.count_if(p == 1).alias("n_long"), F.count_if(p == -1).alias("n_short"), F.sum("turnover").cast("bigint").alias("turnover"), F.avg(p * F.col(fwd)).alias("mean_ret"))
