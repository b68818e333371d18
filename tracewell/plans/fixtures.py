"""Audit data derived from the general-purpose tables, so that every operator has input that grows with them.

Users are subjects.  What an event's key names is, by its remainder, a file of
the user's group of ten, a remote host that all users share (so hosts are hubs),
or the subject that the user descends from; nodes grow with users.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graphs, scoring
from ..operators.order import dense_index
from ..operators.store import cut
from ..sources.cdm import orient_edges

BATCH, MINUTES = 16, 60.0
TRAIN, VAL, TEST = list(range(1, 21)), list(range(21, 24)), list(range(24, 31))
OPERATIONS = {"click": "EVENT_READ", "view": "EVENT_OPEN", "purchase": "EVENT_WRITE", "signup": "EVENT_SENDTO"}
#: Attack intervals on test days, as local times.
ATTACKS = (("a1", "2024-01-24 06:00:00", "2024-01-25 18:30:00"), ("a2", "2024-01-27 00:00:00", "2024-01-27 23:59:59"))


class Fixture:
    """Derived tables of one directory; each is made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def raw_events(self) -> DataFrame:
        """subject, object, operation, event_uuid, timestamp_rec, _id, loss, day."""
        e = self.table("events")
        k, user = F.get_json_object("props", "$.k").cast("long"), F.col("user_id")
        file = F.concat(F.lit("F"), F.floor(user / 10).cast("string"), F.lit("_"), k.cast("string"))
        obj = F.when(k % 4 < 2, file).when(k % 4 == 2, F.concat(F.lit("N"), k.cast("string"))).otherwise(F.concat(F.lit("S"), F.floor(user / 2).cast("string")))
        operation = F.lit("EVENT_OTHER")
        for kind, name in OPERATIONS.items():
            operation = F.when(F.col("event_type") == kind, name).otherwise(operation)
        return e.select(
            F.concat(F.lit("S"), user.cast("string")).alias("subject"),
            obj.alias("object"),
            operation.alias("operation"),
            F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("event_uuid"),
            (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_rec"),
            F.col("event_id").alias("_id"),
            (F.col("value") / 100.0).alias("loss"),
            F.dayofmonth("ts").alias("day"),
        )

    @cached_property
    def nodes(self) -> DataFrame:
        """index_id, node_uuid, node_type, path, cmd, dst_addr, dst_port, src_addr, src_port, msg, label."""
        ids = self.raw_events.select(F.explode(F.array("subject", "object")).alias("node_uuid")).distinct()
        first = F.substring("node_uuid", 1, 1)
        kind = F.when(first == "N", "netflow").when(first == "S", "subject").otherwise("file")
        named = ids.withColumn("node_type", kind).withColumn("rank", F.when(first == "N", 0).when(first == "S", 1).otherwise(2))
        n = dense_index(named, ["rank", "node_uuid"]).drop("rank")
        only = lambda k, c: F.when(F.col("node_type") == k, c)
        u = F.col("node_uuid")
        n = n.withColumn("path", only("subject", F.concat(F.lit("/bin/"), u))).withColumn("path", F.coalesce("path", only("file", F.concat(F.lit("/data/"), u))))
        n = n.withColumn("cmd", only("subject", F.concat(u, F.lit(" -x"))))
        for c, v in {"src_addr": "10.0.0.1", "src_port": "4444", "dst_addr": "1.2.3.4", "dst_port": "80"}.items():
            n = n.withColumn(c, only("netflow", F.lit(v)))
        n = n.withColumn("msg", X.node_message(F.col("node_type"), F.col("path"), F.col("cmd"), F.col("dst_addr"), F.col("dst_port")))
        return n.withColumn("label", F.col("msg"))  # the numbered rows are stored

    @cached_property
    def events(self) -> DataFrame:
        """The event table: oriented edges with ids, and loss and day."""
        ids = self.nodes.select("node_uuid", "index_id")
        e = self.raw_events.join(ids.toDF("subject", "src_index_id"), "subject").join(ids.toDF("object", "dst_index_id"), "object")
        e = e.withColumnRenamed("subject", "src_node").withColumnRenamed("object", "dst_node")
        return cut(orient_edges(e))

    @cached_property
    def windowed(self) -> DataFrame:
        """Graph events with their greedy window and its number ``tw``."""
        batched = graphs.with_batches(graphs.graph_events(self.events), BATCH)
        return cut(graphs.number_windows(graphs.assign_windows(batched, MINUTES, BATCH)))

    @cached_property
    def edges(self) -> DataFrame:
        return graphs.fuse_edges(self.windowed)

    @cached_property
    def typed_edges(self) -> DataFrame:
        """Fused edges with end types, split and the event's own loss."""
        kinds = self.nodes.select("index_id", "node_type")
        e = graphs.fuse_edges(self.windowed, ("loss",)).join(kinds.toDF("src", "src_type"), "src").join(kinds.toDF("dst", "dst_type"), "dst")
        return cut(graphs.assign_split(e, TRAIN, VAL, TEST))

    def losses(self, split: str) -> DataFrame:
        """srcnode, dstnode, loss, tw, edge_type, time of a split's fused edges."""
        e = self.typed_edges.where(F.col("split") == split)
        return e.select(F.col("src").alias("srcnode"), F.col("dst").alias("dstnode"), "loss", "tw", F.col("operation").alias("edge_type"), "time")

    @cached_property
    def truth(self) -> DataFrame:
        """attack, node_uuid, node_label, node_id, node."""
        digit = F.regexp_extract("node_uuid", "[0-9]+", 0).cast("int")
        bad = ((F.col("node_type") == "subject") & (digit % 5 == 0)) | (F.col("node_type") == "netflow")
        n = self.nodes.where(bad)
        return n.select(F.when(F.col("node_type") == "subject", "a1").otherwise("a2").alias("attack"), "node_uuid", F.col("msg").alias("node_label"), F.col("index_id").cast("string").alias("node_id"), F.col("index_id").alias("node"))

    @cached_property
    def attacks(self) -> DataFrame:
        return self.spark.createDataFrame(ATTACKS, "attack string, start string, end string")

    @cached_property
    def doc_scores(self) -> DataFrame:
        """node, score, y_true, y_hat, tw_with_max_loss: labelled documents as nodes with scores, about as many scores as documents."""
        score = F.col("n_chars").cast("double") / (F.col("doc_id") % 97 + 1)
        d = self.table("documents").select(F.col("doc_id").alias("node"), score.alias("score"))
        rows = d.join(self.table("labels").select(F.col("doc_id").alias("node"), F.col("toxic").alias("y_true")), "node")
        return rows.select("node", "score", "y_true", (F.col("score") > 100).cast("int").alias("y_hat"), (F.col("node") % 7).cast("int").alias("tw_with_max_loss"))

    @cached_property
    def trade_edges(self) -> DataFrame:
        """A larger graph: customers to parts by line of order; tw is the month of shipping."""
        l, o = self.table("lineitem"), self.table("orders")
        j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        return j.select(
            F.month("l_shipdate").alias("tw"), F.col("o_custkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst"), F.col("l_returnflag").alias("operation"),
            (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("time"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("event_uuid"), F.col("l_discount").alias("loss"),
        )

    @cached_property
    def surprisals(self) -> DataFrame:
        """Test edges with their surprisal under the training edges."""
        e = self.typed_edges.drop("loss")
        return scoring.edge_surprisal(e.where("split = 'train'"), e.where("split = 'test'"), 1.0)
