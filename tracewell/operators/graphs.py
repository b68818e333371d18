"""Event streams cut into time-window provenance graphs.

events: src_index_id, operation, dst_index_id, event_uuid, timestamp_rec (ns), _id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import EASTERN, local_day, ns_to_text, text_to_ns
from ..sources.cdm import RELATIONS
from .order import dense_index, dense_index_within, running
from .store import cut, discard

MINUTE = 60_000_000_000
ORDER = ["timestamp_rec", "event_uuid", "_id"]


def day_slices(events: DataFrame, year_month: str, days: range, tz: str = EASTERN) -> DataFrame:
    """Events of the days with their ``day``; an event exactly at midnight belongs to no day."""
    lo, hi = (text_to_ns(F.lit(f"{year_month}-{d:02d} 00:00:00"), tz) for d in (days.start, days.stop))
    inside = events.where((F.col("timestamp_rec") > lo) & (F.col("timestamp_rec") < hi))
    start = text_to_ns(F.concat(F.lit(f"{year_month}-"), F.lpad(local_day(F.col("timestamp_rec"), tz).cast("string"), 2, "0"), F.lit(" 00:00:00")), tz)
    return inside.where(F.col("timestamp_rec") > start).withColumn("day", local_day(F.col("timestamp_rec"), tz))


def graph_events(events: DataFrame, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    return events.where(F.col("operation").isin(*relations))


def with_batches(events: DataFrame, batch_size: int = 1024) -> DataFrame:
    """``seq`` from 0 within the day, in order of time, and ``batch`` of so many events."""
    numbered = dense_index_within(events, "day", ORDER, "seq")
    return numbered.withColumn("batch", F.floor(F.col("seq") / batch_size).cast("long"))


def _closing_batches(ends: DataFrame, size: int) -> DataFrame:
    """(day, batch) of all batches that close a window.

    A window that begins at a batch's end closes with the first batch that ends
    later than ``size`` after; so every batch points to the one that would close
    after it, and a day's windows are what can be reached from its beginning.
    Every round jumps four times as far as the one before.
    """
    none = F.lit(None).cast("long")
    told = ends.select("day", F.col("last").alias("at"), F.lit(1).alias("told"), "batch", none.alias("asker"))
    asked = ends.select("day", (F.col("last") + size).alias("at"), F.lit(0).alias("told"), none.alias("batch"), F.col("batch").alias("asker"))
    first = ends.groupBy("day").agg((F.min("first") + size).alias("at")).select("day", "at", F.lit(0).alias("told"), none.alias("batch"), F.lit(-1).cast("long").alias("asker"))
    found = running(told.unionByName(asked).unionByName(first), ["day"], [F.desc("at"), F.col("told")], {"next": ("min", F.col("batch"))})
    jumps = cut(found.where("told = 0").select("day", F.col("asker").alias("batch"), "next", (F.col("asker") < 0).alias("reached")))
    while True:
        far = jumps
        for here, there in (("next", "next2"), ("next2", "next3"), ("next3", "next4")):
            far = far.join(jumps.select("day", F.col("batch").alias(here), F.col("next").alias(there)), ["day", here], "left")
        passed = far.where("reached").select("day", F.explode(F.array("next", "next2", "next3")).alias("batch")).where("batch is not null").distinct()
        merged = far.select("day", "batch", F.col("next4").alias("next"), "reached").join(passed.withColumn("passed", F.lit(True)), ["day", "batch"], "left")
        before, jumps = jumps, cut(merged.select("day", "batch", "next", (F.col("reached") | F.coalesce("passed", F.lit(False))).alias("reached")))
        discard(before)
        if not jumps.where("reached and next is not null").take(1):
            return jumps.where("reached and batch >= 0").select("day", "batch")


def assign_windows(batched: DataFrame, minutes: float = 15.0, batch_size: int = 1024, drop_tail: bool = True) -> DataFrame:
    """Events with their batch-greedy window: ``day_window`` (from 0 in the day), ``tw_start``, ``tw_end``.

    A window closes with the first batch that ends later than its start and the
    minutes; the next one starts at that batch's end.  Only the ends of batches,
    one row for each ``batch_size`` events, take part in this.  The events of a
    day's unfinished last window are dropped, or make a window of their own.
    """
    ends = cut(batched.groupBy("day", "batch").agg(F.min("timestamp_rec").alias("first"), F.max("timestamp_rec").alias("last")))
    closing = _closing_batches(ends, int(minutes * MINUTE))
    if not drop_tail:
        closing = closing.unionByName(ends.groupBy("day").agg(F.max("batch").alias("batch"))).distinct()
    marked = ends.join(closing.withColumn("closes", F.lit(1)), ["day", "batch"], "left")
    placed = running(marked, ["day"], [F.col("batch")], {"before": ("sum", F.coalesce("closes", F.lit(0)).cast("long")), "start": ("max", F.when(F.col("closes") == 1, F.col("last"))), "begin": ("min", F.col("first"))}, own=False)
    placed = cut(placed.select("day", "batch", F.coalesce("before", F.lit(0)).alias("day_window"), F.coalesce("start", "begin", "first").alias("tw_start"), F.when(F.col("closes") == 1, F.col("last")).alias("end")))
    ended = placed.where("end is not null").select("day", "day_window", F.col("end").alias("tw_end"))
    return batched.join(placed.select("day", "batch", "day_window", "tw_start").join(ended, ["day", "day_window"]), ["day", "batch"])


def number_windows(windowed: DataFrame) -> DataFrame:
    """``tw``: the place of the window among all, in order of start, from 0."""
    names = dense_index(windowed.select("day", "day_window").distinct(), ["day", "day_window"], "tw")
    return windowed.join(names, ["day", "day_window"])


def tumbling_windows(events: DataFrame, minutes: float = 15.0) -> DataFrame:
    """Events with fixed event-time windows instead: ``tw_start`` and ``tw_end`` in ns."""
    size = int(minutes * MINUTE)
    start = F.col("timestamp_rec") - F.pmod("timestamp_rec", F.lit(size))
    return events.withColumn("tw_start", start).withColumn("tw_end", start + size)


def window_name(start: Column, end: Column, tz: str = EASTERN) -> Column:
    return F.concat(ns_to_text(start, tz), F.lit("~"), ns_to_text(end, tz))


def fuse_edges(windowed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Collapse runs: of a window's events from src to dst in order of time, the first of each run of one operation, with columns to keep."""
    by = Window.partitionBy("day", "tw", "src_index_id", "dst_index_id").orderBy(*ORDER)
    before = windowed.withColumn("__before", F.lag("operation").over(by))
    first = before.where(F.col("__before").isNull() | (F.col("__before") != F.col("operation")))
    return first.select("day", "tw", F.col("src_index_id").alias("src"), F.col("dst_index_id").alias("dst"), "operation", F.col("timestamp_rec").alias("time"), "event_uuid", *keep)


def window_nodes(windowed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(day, tw, index_id, node_type, label) of all endpoints; nodes: index_id, node_type, label."""
    ends = windowed.select("day", "tw", F.explode(F.array("src_index_id", "dst_index_id")).alias("index_id")).distinct()
    return ends.join(nodes.select("index_id", "node_type", "label"), "index_id").select("day", "tw", "index_id", "node_type", "label")


def window_stats(windowed: DataFrame, tw_edges: DataFrame) -> DataFrame:
    """(day, tw, n_events, n_nodes, n_edges)."""
    events = windowed.groupBy("day", "tw").agg(F.count("*").alias("n_events"))
    ends = windowed.select("day", "tw", F.explode(F.array("src_index_id", "dst_index_id")).alias("n")).groupBy("day", "tw").agg(F.countDistinct("n").alias("n_nodes"))
    edges = tw_edges.groupBy("day", "tw").agg(F.count("*").alias("n_edges"))
    return events.join(ends, ["day", "tw"]).join(edges, ["day", "tw"])


def node_type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count("*").alias("n"))


def window_bounds(tw_edges: DataFrame) -> DataFrame:
    return tw_edges.groupBy("tw").agg(F.min("time").alias("start"), F.max("time").alias("end"))


def assign_split(df: DataFrame, train: list[int], val: list[int], test: list[int]) -> DataFrame:
    """``split`` by day; days of no split are dropped."""
    day = F.col("day")
    split = F.when(day.isin(*train), "train").when(day.isin(*val), "val").when(day.isin(*test), "test")
    return df.withColumn("split", split).where("split is not null")


def full_edges(*splits: DataFrame) -> DataFrame:
    out = splits[0]
    for df in splits[1:]:
        out = out.unionByName(df)
    return out


def max_node_id(tw_edges: DataFrame) -> DataFrame:
    return tw_edges.agg((F.max(F.greatest("src", "dst")) + 1).alias("n_nodes"))


def reindex_nodes(tw_edges: DataFrame) -> DataFrame:
    """(tw, node, local): ids from 0 inside each window, in order of id."""
    ends = tw_edges.select("tw", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return dense_index_within(ends, "tw", ["node"], "local")


def edge_to_node_features(edges: DataFrame, feature: str = "feature", order: list[str] | None = None) -> DataFrame:
    """(tw, node, role, feature): the feature of the node's last edge in either role."""
    keys = F.struct(*(order or ["time", "event_uuid"]))
    ends = edges.select("tw", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit("src").alias("role")), F.struct(F.col("dst").alias("node"), F.lit("dst").alias("role")))).alias("e"), keys.alias("k"), F.col(feature).alias("feature"))
    return ends.groupBy("tw", "e.node", "e.role").agg(F.max_by("feature", "k").alias("feature"))


def last_message(messages: DataFrame, node: str = "node", time: str = "time", message: str = "msg") -> DataFrame:
    """The latest message of each node; of several at one time the greatest."""
    return messages.groupBy(node).agg(F.max(F.struct(time, message)).alias("m")).select(node, f"m.{time}", f"m.{message}")
