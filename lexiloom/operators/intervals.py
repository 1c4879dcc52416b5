"""Interval operators over ordered time points (events): segments, as-of and nearest lookups, runs, frames, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order(by: str = "user_id", *cols: str) -> Window:
    return Window.partitionBy(by).orderBy(*(cols or ("ts", "event_id")))


def segments(points: DataFrame) -> DataFrame:
    """Consecutive points of a key form [start, end); ``linked`` if the one before is adjacent, i.e. was kept (its text is not null)."""
    w = order()
    out = points.withColumn("end_id", F.lead("event_id").over(w)).withColumn("end_ts", F.lead("ts").over(w)).withColumn("before", F.lag("text").over(w))
    return out.where(F.col("end_id").isNotNull() & F.col("text").isNotNull()).withColumn("linked", F.coalesce(F.col("before").isNotNull(), F.lit(False)))


def flanks(points: DataFrame, silent: Column) -> DataFrame:
    """Content points with the start of a silent one right before and the end of a silent one right after (which needs a second next point)."""
    w = order()
    p = points.withColumn("quiet", silent)
    p = p.withColumn("lq", F.lag("quiet").over(w)).withColumn("lt", F.lag("ts").over(w)).withColumn("nq", F.lead("quiet").over(w)).withColumn("n2", F.lead("ts", 2).over(w))
    return p.where(~F.col("quiet")).withColumn("flank_start", F.when(F.col("lq"), F.col("lt"))).withColumn("flank_end", F.when(F.col("nq"), F.col("n2")))


def last_known(points: DataFrame, value: Column) -> DataFrame:
    """The last value that isn't null at or before each point."""
    return points.withColumn("recent", F.last(value, ignorenulls=True).over(order()))


def asof(markers: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """For each probe (key, t, id) the greatest marker (key, t, id) at or before it and the least at or after: one union and one sort, no join."""
    both = markers.select(key, "t", F.lit(0).alias("kind"), F.col("id").alias("m"), F.col("t").alias("mt"), F.lit(None).cast("long").alias("id")).unionByName(
        probes.select(key, "t", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("m"), F.lit(None).cast("timestamp").alias("mt"), "id")
    )
    up = Window.partitionBy(key).orderBy("t", "kind", "m").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key).orderBy(F.desc("t"), "kind", F.desc("m")).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    out = both.withColumn("left_id", last("m", up)).withColumn("left_t", last("mt", up)).withColumn("right_id", last("m", down)).withColumn("right_t", last("mt", down))
    return out.where("kind = 1").select(key, "id", "t", "left_id", "left_t", "right_id", "right_t")


def runs(points: DataFrame, mask: Column) -> DataFrame:
    """Run-length intervals of an equal mask per key: gaps and islands."""
    w = order()
    p = points.withColumn("mask", mask).withColumn("new", F.when(F.lag("mask").over(w).eqNullSafe(F.col("mask")), 0).otherwise(1))
    p = p.withColumn("run", F.sum("new").over(w))
    return p.groupBy("user_id", "run").agg(F.first("mask").alias("mask"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n"))


def frames(points: DataFrame, size: int, shift: int) -> DataFrame:
    """Sliding frames of ``size`` points every ``shift``, whole ones only, with the mean magnitude. Each point joins the frames it lies in, by arithmetic."""
    p = points.withColumn("i", F.row_number().over(order()) - 1)
    lo = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / shift))
    p = p.withColumn("hi", F.floor(F.col("i") / shift)).where(lo <= F.col("hi")).withColumn("frame", F.explode(F.sequence(lo.cast("long"), F.col("hi").cast("long"))))
    return p.groupBy("user_id", "frame").agg(F.round(F.avg(F.abs("value")), 6).alias("magnitude"), F.count("*").alias("n")).where(F.col("n") == size)


def pre_emphasis(points: DataFrame, a: float = 0.97) -> DataFrame:
    """x_i - a x_(i-1), the first (1 - a) x_0."""
    before = F.lag("value").over(order())
    return points.withColumn("y", F.when(before.isNull(), (1 - a) * F.col("value")).otherwise(F.col("value") - a * before))


def deltas(points: DataFrame, half: int = 2) -> DataFrame:
    """Rate of change over a window of ``half`` points either side; edges repeat the first and last value."""
    near = lambda of, r: F.coalesce(*[of("value", k).over(order()) for k in range(r, 0, -1)], F.col("value"))  # noqa: E731  the farthest neighbour that there is
    total = sum(r * (near(F.lead, r) - near(F.lag, r)) for r in range(1, half + 1))
    return points.withColumn("delta", total / (2 * sum(r * r for r in range(1, half + 1))))
