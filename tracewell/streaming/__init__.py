"""Structured Streaming entry points: the same operators on a stream of log lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.cdm import Profile, parse_records, filter_relations


def stream_cdm(spark: SparkSession, path: str, glob: str = "*json*", files_per_trigger: int = 100) -> DataFrame:
    """(value, file, line_id) of log files as they appear under the path; line ids are null, as a stream's lines have no numbers."""
    lines = spark.readStream.option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.lit(None).cast("long").alias("line_id"))


def stream_events(lines: DataFrame, profile: Profile, late: str = "10 minutes") -> DataFrame:
    """Events of a stream with their event time ``ts`` and a watermark; repeats inside the watermark are dropped."""
    records = parse_records(lines, profile)
    events = records.where("kind = 'Event' and subject is not null and object is not null")
    events = events.select("subject", "object", F.col("type").alias("operation"), F.col("uuid").alias("event_uuid"), "timestamp_rec", F.timestamp_micros((F.col("timestamp_rec") / 1000).cast("long")).alias("ts"))
    return filter_relations(events, profile).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_uuid"])


def stream_window_counts(events: DataFrame, minutes: int = 15) -> DataFrame:
    """(start, end, operation, n) by tumbling windows of event time."""
    w = F.window("ts", f"{minutes} minutes")
    return events.groupBy(w, "operation").agg(F.count("*").alias("n")).select("window.start", "window.end", "operation", "n")


#: Groups that nodes are dealt to, each with one state; a checkpoint goes on with the number that it began with.
BUCKETS = 2048
#: Nodes that a frame of updates tells of.
TOLD = 10_000


def _latest(node: np.ndarray, e_id: np.ndarray, nbr: np.ndarray, k: int) -> np.ndarray:
    """Places of each node's k latest edges, by node and latest first."""
    order = np.lexsort((nbr, ~e_id, node))  # ~ turns the order of whole numbers round
    nodes = node[order]
    starts = np.flatnonzero(np.r_[np.ones(len(nodes[:1]), bool), nodes[1:] != nodes[:-1]])
    rank = np.arange(len(nodes)) - np.repeat(starts, np.diff(np.r_[starts, len(nodes)]))
    return order[rank < k]


def stream_last_neighbors(edges: DataFrame, k: int = 20, late: str = "10 minutes", idle_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(node, gone, neighbors): each node's k latest edges, given anew whenever a batch changes them (update mode).

    edges: a stream of src, dst, e_id, ts.  A node's k edges are its state;
    edges may come in any order.  Edges of before the watermark are left out.
    With ``idle_ms`` a node that had no edge for so long, by event time, is
    forgotten and told once more with ``gone``.  Tasks cut a batch to k edges of
    each node before they are shuffled, so hubs send little.

    Nodes are dealt to ``buckets`` by hash.  The nodes of a bucket have one state,
    arrays of whole numbers that are worked on as such: a call for each node
    would cost far more than its edges.  The state is written anew when one of
    them changes, so many nodes in small batches want more buckets.
    """
    pairs = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr")))
    ends = edges.select(F.explode(pairs).alias("p"), "e_id", F.unix_millis("ts").alias("ms"), "ts").select("p.node", "p.nbr", "e_id", "ms", "ts")

    def fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(_latest(*(batch.column(c).to_numpy() for c in ("node", "e_id", "nbr")), k)))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        nodes, sizes, newest, e_ids, nbrs = (np.frombuffer(x, "int64") for x in (state.get if state.exists else [b""] * 5))
        fresh = [np.empty((0, 4), "int64")]
        for batch in () if state.hasTimedOut else batches:
            fresh.append(batch.loc[batch["ms"] >= mark, ["node", "e_id", "nbr", "ms"]].to_numpy("int64"))
        node, e_id, nbr, ms = np.concatenate(fresh).T
        changed = np.unique(node)
        known = np.union1d(nodes, changed)
        if not len(known):
            return
        last = np.full(len(known), np.iinfo("int64").min)  # each node's newest edge
        last[np.searchsorted(known, nodes)] = newest
        np.maximum.at(last, np.searchsorted(known, node), ms)
        stay = np.ones(len(known), bool) if idle_ms is None else last >= mark - idle_ms
        gone, known, last = known[~stay], known[stay], last[stay]

        node, e_id, nbr = np.r_[np.repeat(nodes, sizes), node], np.r_[e_ids, e_id], np.r_[nbrs, nbr]
        held = np.flatnonzero(np.isin(node, known))
        held = held[_latest(node[held], e_id[held], nbr[held], k)]
        node, e_id, nbr = node[held], e_id[held], nbr[held]
        bounds = np.r_[np.searchsorted(node, known), len(node)]
        if len(known):
            state.update(tuple(x.tobytes() for x in (known, np.diff(bounds), last, e_id, nbr)))
            if idle_ms is not None:
                state.setTimeoutTimestamp(int(last.min()) + idle_ms)
        else:
            state.remove()
        at = np.searchsorted(known, changed)
        for i in range(0, len(changed), TOLD):
            spans = list(zip(bounds[at[i : i + TOLD]], bounds[at[i : i + TOLD] + 1]))
            yield pd.DataFrame({"node": changed[i : i + TOLD], "gone": False, "e_id": [e_id[a:b] for a, b in spans], "nbr": [nbr[a:b] for a, b in spans]})
        if len(gone):
            yield pd.DataFrame({"node": gone, "gone": True, "e_id": [[]] * len(gone), "nbr": [[]] * len(gone)})

    base = ends.mapInArrow(fewer, "node long, nbr long, e_id long, ms long, ts timestamp").withWatermark("ts", late)
    dealt = base.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(buckets))).groupBy("bucket")
    out, kept = "node long, gone boolean, e_id array<long>, nbr array<long>", "nodes binary, sizes binary, newest binary, e_ids binary, nbrs binary"
    told = dealt.applyInPandasWithState(update, out, kept, "update", GroupStateTimeout.EventTimeTimeout)
    return told.select("node", "gone", F.arrays_zip("e_id", "nbr").alias("neighbors"))


def keep_latest(updates: DataFrame, path: str, checkpoint: str) -> None:
    """Run the stream over what is there, and write each batch's updates into a folder of its own, which a repeated batch overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """(node, nbr, e_id): the neighbours that the latest batch told of each node; nodes that are gone have none."""
    told = spark.read.option("basePath", path).parquet(path)
    last = told.groupBy("node").agg(F.max_by(F.struct("gone", "neighbors"), "batch").alias("s"))
    return last.where("not s.gone").select("node", F.explode("s.neighbors").alias("n")).select("node", "n.nbr", "n.e_id")
