"""As-of joins over instants, without a calendar and without a task that holds one side or one key.

Both sides are put in one order (key, time, side) and dealt into ranges of about equal size, ties of time included.
Within a range the neighbour from the other side is a window away; for the rows at a range's end it is the nearest one
of another range, which a table of one row per range carries over. Two shuffles, one table written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import panel as P
from tidemark.sources.stages import staged


def joined(left: DataFrame, right: DataFrame, at: str, right_at: str, take: list[str], by: list[str] | None = None, forward: bool = True, strict: bool = True, parts: int | None = None) -> DataFrame:
    """``left`` with the columns ``take`` of the first row of ``right`` with the same ``by`` whose ``right_at`` is after
    ``at`` (``forward``), or the last one before it; ``strict`` leaves equal times out. Of right rows equal in key and
    time, the least by ``take`` counts forwards, the greatest backwards. Null times match nothing, null keys match each
    other; rows of ``left`` that match nothing have nulls. Writes the dealt rows while the plan is built."""
    by, spark = by or [], left.sparkSession
    if clash := set(take) & set(left.columns):
        raise ValueError(f"the left side has {sorted(clash)} already")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in by])
    pick = F.min if forward else F.max
    facts = right.filter(F.col(right_at).isNotNull()).groupBy(key.alias("_key"), F.col(right_at).alias("_t")).agg(pick(F.struct(*take)).alias("_take"))
    # At equal times the side that is looked at comes first where it isn't to be found.
    side = 0 if strict == forward else 2
    kind = F.struct(*[F.col(c) for c in left.columns])
    asks = left.select(key.alias("_key"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.xxhash64(kind).alias("_salt"), kind.alias("_row"))
    gives = facts.select("_key", "_t", F.lit(side).alias("_side"), F.lit(0).cast("bigint").alias("_salt"), F.struct("_key", "_take").alias("_give"))
    both = asks.unionByName(gives, allowMissingColumns=True)
    order = ["_key", "_t", "_side", "_salt"]
    dealt = both.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    near = Window.partitionBy("_part").orderBy(*order)
    found = F.first("_give", True).over(near.rowsBetween(0, Window.unboundedFollowing)) if forward else F.last("_give", True).over(near.rowsBetween(Window.unboundedPreceding, 0))
    rows = staged(dealt.withColumn("_found", found), "asof-ranges")
    pick_by = F.min_by if forward else F.max_by
    ends = rows.filter(F.col("_side") != 1).groupBy("_part").agg(pick_by("_give", F.struct("_key", "_t")).alias("_end"))
    every = spark.range(parts).select(F.col("id").cast("int").alias("_part")).join(ends, "_part", "left")
    whole = Window.orderBy("_part")  # one row per range
    other = F.first("_end", True).over(whole.rowsBetween(1, Window.unboundedFollowing)) if forward else F.last("_end", True).over(whole.rowsBetween(Window.unboundedPreceding, -1))
    carried = every.select("_part", other.alias("_carried"))
    got = rows.filter(F.col("_side") == 1).join(F.broadcast(carried), "_part").withColumn("_found", F.coalesce("_found", "_carried"))
    fits = F.col("_t").isNotNull() & F.col("_found._key").eqNullSafe(F.col("_key"))
    return got.select("_row.*", *[F.when(fits, F.col(f"_found._take.{c}")).alias(c) for c in take])


def opens(sessions: DataFrame, minutes: str = "open_minutes", zone: str = P.ZONE) -> DataFrame:
    """``session, opens``: the instant at which each session opens, by its own time of day."""
    return sessions.select("session", P.instant(F.col("session"), F.col(minutes), zone).alias("opens"))


def next_open(releases: DataFrame, sessions: DataFrame, release: str = "release", zone: str = P.ZONE, parts: int | None = None) -> DataFrame:
    """``releases`` with ``entry``: of ``sessions`` (``session, open_minutes``) the first that opens strictly after the
    instant, whatever each one's hours."""
    calendar = opens(sessions, zone=zone).withColumnRenamed("session", "entry")
    return joined(P.zoned(releases, release), calendar, release, "opens", ["entry"], parts=parts)
