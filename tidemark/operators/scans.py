"""Ranks, exact quantiles, running sums and equity curves of keys of any size.

Rows are dealt into ranges of their order by ``repartitionByRange``; a window works within a range and key, a table of
one row per key and range is summed up over the ranges, and what lies before a range is joined back. No task holds a
key, and equal values are counted before they are dealt, so ties don't pile up in one range. The dealt rows are written
once (the ranges' borders come from a sample, so they must not be drawn again), while the plan is built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.stages import staged


def dealt(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` in ranges of ``order``, each row with its range's number, ``_part``."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())


def matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join on ``keys``, where nulls match; the keys are those of ``left``."""
    right, on = right.withColumnsRenamed({k: f"_of_{k}" for k in keys}), F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return left.join(right, on).drop(*[f"_of_{k}" for k in keys])


def carried(rows: DataFrame, keys: list[str], sums: dict[str, Column], found: dict[str, Column]) -> DataFrame:
    """``rows`` (written, with ``_part``) with what the earlier ranges of their key come to. ``sums`` aggregates a key
    and range, ``found`` is worked out from that over a key's ranges, where ``before`` is the window of the earlier."""
    ends = rows.groupBy(*keys, "_part").agg(*[c.alias(n) for n, c in sums.items()])
    return matched(rows, ends.select(*keys, "_part", *[c.alias(n) for n, c in found.items()]), [*keys, "_part"])


def before(keys: list[str]) -> Window:
    """The earlier ranges of a key: one row per range."""
    return Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def ordered(df: DataFrame, keys: list[str], value: str, parts: int | None = None) -> DataFrame:
    """``keys, value, n, before``: each distinct value of a key, how often it is there, and how many rows of the key
    have a lesser one. Null values are left out; null keys are keys."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    within = Window.partitionBy("_part", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = staged(dealt(counts, [*keys, value], parts).withColumn("_within", F.coalesce(F.sum("n").over(within), F.lit(0))), "ordered")
    rows = carried(rows, keys, {"_sum": F.sum("n")}, {"_earlier": F.coalesce(F.sum("_sum").over(before(keys)), F.lit(0))})
    return rows.select(*keys, value, "n", (F.col("_within") + F.col("_earlier")).alias("before"))


def average_ranks(df: DataFrame, keys: list[str], values: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with the average rank of each of ``values`` within its key, as ``rank_`` and the value's name; rows where
    one is null go. All values are ranked at once."""
    df = df.filter(" and ".join(f"`{v}` is not null" for v in values))
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("_of"), F.col(v).cast("double").alias("_value")) for v in values])).alias("_z")).select(*keys, "_z.*")
    ranks = ordered(long, [*keys, "_of"], "_value", parts)
    for v in values:
        own = ranks.filter(F.col("_of") == v).select(*keys, F.col("_value").alias("_v"), (F.col("before") + (F.col("n") + 1) / 2).alias(f"rank_{v}"))
        df = matched(df.withColumn("_v", F.col(v).cast("double")), own, [*keys, "_v"]).drop("_v")
    return df


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], parts: int | None = None) -> DataFrame:
    """``keys, n`` and ``q``, an array of the value at each of ``probabilities``, linear between neighbours; exact.
    Keys without a value have no row."""
    rows = ordered(df.withColumn(value, F.col(value).cast("double")), keys, value, parts)
    totals = rows.groupBy(*keys).agg(F.sum("n").alias("_all"))
    last = F.col("before") + F.col("n") - 1
    place = lambda p: (F.col("_all") - 1) * F.lit(float(p))
    both = matched(rows, totals if keys else F.broadcast(totals), keys)  # one row without keys
    # Of all values, those at or beside a wanted place.
    at = lambda place: (F.col("before") <= place) & (place <= last)
    low = [F.max(F.when(at(F.floor(place(p))), F.col(value))) for p in probabilities]
    high = [F.max(F.when(at(F.ceil(place(p))), F.col(value))) for p in probabilities]
    share = [F.max(place(p) - F.floor(place(p))) for p in probabilities]
    found = both.groupBy(*keys).agg(F.max("_all").alias("n"), *[c.alias(f"_{kind}{i}") for kind, cs in (("l", low), ("h", high), ("s", share)) for i, c in enumerate(cs)])
    q = [F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_s{i}") for i in range(len(probabilities))]
    return found.select(*keys, "n", F.array(*q).alias("q"))


def scanned(df: DataFrame, keys: list[str], order: list[str], name: str, within: dict[str, Column], sums: dict[str, Column], found: dict[str, Column], parts: int | None = None) -> DataFrame:
    """``df`` with ``within``, worked out over the rows of a key and range up to each row, and ``found``."""
    over = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt(df, [*keys, *order], parts)
    for n, c in within.items():
        rows = rows.withColumn(n, c.over(over))
    return carried(staged(rows, name), keys, sums, found)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """``df`` with the one-based place of each row in its key's order, as ``name``. ``order`` tells the rows of a key
    apart."""
    over = Window.partitionBy("_part", *keys).orderBy(*order)
    rows = staged(dealt(df, [*keys, *order], parts).withColumn("_within", F.row_number().over(over)), "numbered")
    rows = carried(rows, keys, {"_n": F.count("*")}, {"_earlier": F.coalesce(F.sum("_n").over(before(keys)), F.lit(0))})
    return rows.select(*df.columns, (F.col("_within") + F.col("_earlier")).alias(name))


def expanding(df: DataFrame, keys: list[str], order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``n_before`` and ``mean_before`` of the key's earlier values; nulls don't count. ``order`` tells the
    rows of a key apart."""
    sums = {"_s": F.sum(value), "_n": F.count(value)}
    rows = scanned(df, keys, order, "expanding", {"_ws": F.sum(value), "_wn": F.count(value)}, sums, {f"_e{n}": F.coalesce(F.sum(n).over(before(keys)), F.lit(0)) for n in sums}, parts)
    own = F.coalesce(F.col(value), F.lit(0))
    n = F.col("_wn") + F.col("_e_n") - F.when(F.col(value).isNotNull(), 1).otherwise(0)
    total = F.coalesce("_ws", F.lit(0)) + F.col("_e_s") - own
    return rows.withColumns({"n_before": n, "mean_before": F.when(n > 0, total / n)}).select(*df.columns, "n_before", "mean_before")


def equity(df: DataFrame, keys: list[str], order: list[str], ret: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``equity``, compounded from 1, and ``fall`` from its highest so far (1 at least). A return of -1 or
    less is a total loss: equity stays 0 and the fall -1 from there on, across ranges. Rows without a return go.

    A range comes to the sum of its logarithms, the highest of its running sums, and whether it holds a total loss; of
    two ranges in a row these follow from those of each, so they are carried over like sums are."""
    rows = df.filter(F.col(ret).isNotNull())
    gone, step = F.col(ret) <= -1, F.log1p(F.greatest(F.col(ret), F.lit(-1 + 1e-15)))
    rows = rows.withColumns({"_gone": gone.cast("int"), "_step": step})
    over = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt(rows, [*keys, *order], parts).withColumn("_up", F.sum("_step").over(over)).withColumns({"_peak": F.max("_up").over(over), "_lost": F.max("_gone").over(over)})
    earlier = before(keys)
    rows = staged(rows, "equity")
    ends = rows.groupBy(*keys, "_part").agg(F.sum("_step").alias("_sum"), F.max("_up").alias("_top"), F.max("_gone").alias("_hit"))
    ends = ends.withColumns({"_base": F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)), "_past": F.coalesce(F.max("_hit").over(earlier), F.lit(0))})
    ends = ends.withColumn("_high", F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("_base") + F.col("_top")).over(earlier), F.lit(0.0))))
    both = matched(rows, ends.select(*keys, "_part", "_base", "_past", "_high"), [*keys, "_part"])
    lost, level = (F.col("_lost") + F.col("_past")) > 0, F.col("_base") + F.col("_up")
    fall = F.exp(level - F.greatest("_high", F.col("_base") + F.col("_peak"))) - 1
    return both.withColumns({"equity": F.when(lost, 0.0).otherwise(F.exp(level)), "fall": F.when(lost, -1.0).otherwise(fall)}).select(*df.columns, "equity", "fall")
