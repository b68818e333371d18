"""Dense row numbers, running sums and running aggregates of keys without a task for a whole table or key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut


def dense_index(df: DataFrame, keys: list[str], name: str = "index_id", start: int = 0) -> DataFrame:
    """Number all rows by the keys' order, from ``start`` on.

    Ranges are sorted in parallel; only one count per range is added up, and a
    row's number is its range's offset plus its place.  Keys need a tie-breaker
    for numbers that don't depend on the run.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    low = F.lit((1 << 33) - 1)
    ranged = cut(ranged.withColumn("__m", F.monotonically_increasing_id()))
    placed = ranged.withColumn("__p", F.shiftright("__m", 33)).withColumn("__i", F.col("__m").bitwiseAND(low))
    counts = placed.groupBy("__p").agg(F.count("*").alias("__n"))  # a row for each range
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    return placed.join(offsets, "__p").withColumn(name, F.col("__o") + F.col("__i") + F.lit(start)).drop("__m", "__p", "__i", "__o")


def dense_index_within(df: DataFrame, group: str, keys: list[str], name: str, start: int = 0) -> DataFrame:
    """Number the rows of every group by the keys' order; a large group is numbered by many tasks."""
    numbered = dense_index(df, [group, *keys], "__n")
    first = numbered.groupBy(F.col(group).alias("__g")).agg(F.min("__n").alias("__first"))  # a row for each group
    joined = numbered.join(first, F.col(group).eqNullSafe(F.col("__g")))
    return joined.withColumn(name, F.col("__n") - F.col("__first") + F.lit(start)).drop("__n", "__g", "__first")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """The rows with running sums in the given order, own row included; sums: column -> name of its sum.

    Ranges are summed in parallel; only one sum per range is added up.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    totals = ranged.groupBy("__p").agg(*[F.sum(c).alias(f"__{n}") for c, n in sums.items()])  # a row for each range
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__p", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums.values()])
    inside = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(offsets, "__p")
    return joined.select(*df.columns, *[(F.sum(c).over(inside) + F.col(f"__{n}")).alias(n) for c, n in sums.items()])


#: How the aggregate of earlier ranges and that of a range's own rows make one.
_BOTH = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "bit_or": (F.bit_or, lambda a, b: F.coalesce(a.bitwiseOR(b), a, b)),
}


def running(df: DataFrame, by: list[str], order: list[Column], aggs: dict[str, tuple[str, Column]], own: bool = True) -> DataFrame:
    """The rows with aggregates of their key's rows up to them in the given order, the own row included or not.

    aggs: name -> (sum, min, max or bit_or, column).  Rows are cut into ranges of
    key and order, so a key with many rows is worked on by many tasks.  Only one
    key can go on from a range to the next; what it brings along is at most one
    row for each range.  Keys aren't null; without a tie-breaker in the order,
    ties come in any order.
    """
    ranged = cut(df.repartitionByRange(*[F.col(k) for k in by], *order).withColumn("__p", F.spark_partition_id()))
    totals = ranged.groupBy("__p", *by).agg(*[_BOTH[f][0](c).alias(f"__{n}") for n, (f, c) in aggs.items()])
    before = Window.partitionBy(*by).orderBy("__p")
    carried = totals.select("__p", *by, F.row_number().over(before).alias("__r"), *[_BOTH[f][0](f"__{n}").over(before.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__{n}") for n, (f, _) in aggs.items()])
    carried = carried.where("__r > 1").drop("__r")  # of keys that began in an earlier range: no more than ranges
    inside = Window.partitionBy("__p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    joined = ranged.join(F.broadcast(carried), ["__p", *by], "left")
    return joined.select(*df.columns, *[_BOTH[f][1](F.col(f"__{n}"), _BOTH[f][0](c).over(inside)).alias(n) for n, (f, c) in aggs.items()])
