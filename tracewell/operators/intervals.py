"""Points in intervals of any length, as an equi-join.

An interval is covered by aligned buckets of one, two, four .. units, at most two
of each size, however long it is; a point lies in one bucket of each size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

#: The smallest bucket is 2 ** UNIT wide: with nanoseconds about four and a half minutes.
UNIT = 38


def dyadic_cover(start: Column, end: Column, unit: int = UNIT) -> Column:
    """Array of (level, bucket) that cover start to end, both included; none if start is greater or either is null.

    From the smallest level up: an odd first bucket and an odd bucket behind the
    last stand alone, what is left between them is looked at two by two.
    """
    none = F.array().cast("array<struct<level:int,bucket:bigint>>")
    state = F.struct(F.shiftright(start.cast("long"), unit).alias("lo"), (F.shiftright(end.cast("long"), unit) + 1).alias("hi"), none.alias("out"))

    def up(s: Column, level: Column) -> Column:
        lo, hi = s["lo"], s["hi"]
        left = (lo < hi) & (lo.bitwiseAND(F.lit(1)) == 1)
        first = F.when(left, lo + 1).otherwise(lo)
        right = (first < hi) & (hi.bitwiseAND(F.lit(1)) == 1)
        last = F.when(right, hi - 1).otherwise(hi)
        one = lambda hit, bucket: F.when(hit, F.array(F.struct(level.cast("int").alias("level"), bucket.alias("bucket")))).otherwise(none)
        return F.struct(F.shiftright(first, 1).alias("lo"), F.shiftright(last, 1).alias("hi"), F.concat(s["out"], one(left, lo), one(right, last)).alias("out"))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(63 - unit)), state, up)["out"]
    return F.when(start <= end, found).otherwise(none)


def points_in_intervals(points: DataFrame, intervals: DataFrame, time: str, start: str, end: str, unit: int = UNIT) -> DataFrame:
    """Every point with every interval that holds its time, both ends included; columns of both sides, whose names differ.

    Points are looked up only on the levels that some interval uses; their number
    is bounded by the bits of a long.
    """
    cover = cut(intervals.withColumn("__b", F.explode(dyadic_cover(F.col(start), F.col(end), unit))).select("*", F.col("__b.level").alias("__level"), F.col("__b.bucket").alias("__bucket")).drop("__b"))
    levels = sorted(r[0] for r in cover.select("__level").distinct().collect())
    if not levels:
        return points.join(cover, F.lit(False)).drop("__level", "__bucket")
    spread = points.withColumn("__level", F.explode(F.array(*[F.lit(i) for i in levels])))
    spread = spread.withColumn("__bucket", F.expr(f"shiftright(`{time}`, {unit} + __level)"))
    return spread.join(cover, ["__level", "__bucket"]).where(F.col(time).between(F.col(start), F.col(end))).drop("__level", "__bucket")
