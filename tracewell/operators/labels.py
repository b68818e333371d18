"""Ground truth joined to nodes, events and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import EASTERN, text_nanos_to_ns, text_to_ns
from .intervals import points_in_intervals


#: Attacks that are broadcast.
FEW = 1000


def resolve_ground_truth(truth: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found: attack, node, node_uuid, node_label; missing: rows whose uuid is no node)."""
    known = nodes.select("node_uuid", F.col("index_id").alias("node"))
    found = truth.join(known, "node_uuid").select("attack", "node", "node_uuid", "node_label")
    return found, truth.join(known, "node_uuid", "left_anti")


def attack_nodes(found: DataFrame) -> DataFrame:
    return found.groupBy("attack").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


def attack_windows_ns(attacks: DataFrame, tz: str = EASTERN) -> DataFrame:
    """(attack, start_ns, end_ns) from local times."""
    return attacks.select("attack", text_to_ns(F.col("start"), tz).alias("start_ns"), text_to_ns(F.col("end"), tz).alias("end_ns"))


def events_in_attacks(events: DataFrame, attacks: DataFrame) -> DataFrame:
    """Events with every attack whose interval, ends included, holds their time.

    Few attacks are broadcast; more are joined by the buckets that cover them.
    """
    inside = F.col("timestamp_rec").between(F.col("start_ns"), F.col("end_ns"))
    if attacks.limit(FEW + 1).count() <= FEW:
        return events.join(F.broadcast(attacks), inside)
    return points_in_intervals(events, attacks, "timestamp_rec", "start_ns", "end_ns")


def malicious_times(events: DataFrame, attacks: DataFrame, truth: DataFrame) -> DataFrame:
    """(attack, time, node): endpoints that are ground truth of the attack that holds the event; both ends count."""
    inside = events_in_attacks(events, attacks)
    ends = inside.select("attack", F.col("timestamp_rec").alias("time"), F.explode(F.array("src_index_id", "dst_index_id")).alias("node"))
    return ends.join(truth.select("attack", "node").distinct(), ["attack", "node"], "left_semi").select("attack", "time", "node")


def declared_bounds(names: DataFrame, tz: str = EASTERN) -> DataFrame:
    """(tw, start, end) from window names of the form start~end."""
    part = lambda i: text_nanos_to_ns(F.get(F.split("name", "~"), F.lit(i)), tz)
    return names.select("tw", part(0).alias("start"), part(1).alias("end"))


def window_labels(malicious: DataFrame, bounds: DataFrame) -> DataFrame:
    """(tw, node, n): malicious times strictly inside each window; windows may have any length."""
    hits = points_in_intervals(malicious.select("time", "node"), bounds.select("tw", "start", "end"), "time", "start", "end")
    return hits.where((F.col("start") < F.col("time")) & (F.col("time") < F.col("end"))).groupBy("tw", "node").agg(F.count("*").alias("n"))


def label_coverage(malicious: DataFrame, bounds: DataFrame) -> DataFrame:
    """(hits, times): pairs of a distinct malicious time and a window that holds it, and distinct times."""
    times = malicious.select("time").distinct()
    hits = points_in_intervals(times, bounds.select("tw", "start", "end"), "time", "start", "end")
    hits = hits.where((F.col("start") < F.col("time")) & (F.col("time") < F.col("end")))
    return hits.agg(F.count("*").alias("hits")).crossJoin(times.agg(F.count("*").alias("times")))
