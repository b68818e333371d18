"""Every operator as a query over derived tables, each with SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import times as T
from ..operators import detect, features, graphs, labels, scoring, trace
from ..operators.order import dense_index
from .. import streaming
from ..operators.store import cut, shared_dir
from ..sources import cdm, tables
from . import fixtures
from .fixtures import Fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_RAW = """
raw AS (
  SELECT event_id, epoch_us(ts) * 1000 AS ns, CAST(user_id AS VARCHAR) AS s, user_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
    event_type, value, CAST(day(ts) AS INTEGER) AS day FROM events),
ev AS (
  SELECT event_id AS _id, 'E' || event_id AS event_uuid, ns AS timestamp_rec, 'S' || s AS subject,
    CASE WHEN k % 4 < 2 THEN 'F' || (user_id // 10) || '_' || k WHEN k % 4 = 2 THEN 'N' || k ELSE 'S' || (user_id // 2) END AS object,
    CASE event_type WHEN 'click' THEN 'EVENT_READ' WHEN 'view' THEN 'EVENT_OPEN' WHEN 'purchase' THEN 'EVENT_WRITE' WHEN 'signup' THEN 'EVENT_SENDTO' ELSE 'EVENT_OTHER' END AS operation,
    CAST(value AS DOUBLE) / 100.0 AS loss, day FROM raw),
uu AS (SELECT DISTINCT u FROM (SELECT subject AS u FROM ev UNION ALL SELECT object FROM ev)),
nodes AS (
  SELECT row_number() OVER (ORDER BY CASE left(u, 1) WHEN 'N' THEN 0 WHEN 'S' THEN 1 ELSE 2 END, u) - 1 AS index_id, u AS node_uuid,
    CASE left(u, 1) WHEN 'N' THEN 'netflow' WHEN 'S' THEN 'subject' ELSE 'file' END AS node_type,
    CASE left(u, 1) WHEN 'N' THEN '1.2.3.4:80' WHEN 'S' THEN '/bin/' || u || ' ' || u || ' -x' ELSE '/data/' || u END AS msg FROM uu),
ed AS (
  SELECT e._id, e.event_uuid, e.timestamp_rec, e.operation, e.loss, e.day,
    CASE WHEN e.operation IN ('EVENT_READ', 'EVENT_OPEN') THEN o.index_id ELSE s.index_id END AS src,
    CASE WHEN e.operation IN ('EVENT_READ', 'EVENT_OPEN') THEN s.index_id ELSE o.index_id END AS dst
  FROM ev e JOIN nodes s ON e.subject = s.node_uuid JOIN nodes o ON e.object = o.node_uuid)"""
_WIN = (
    _RAW
    + """,
bt AS (
  SELECT *, (row_number() OVER (PARTITION BY day ORDER BY timestamp_rec, event_uuid, _id) - 1) // 16 AS batch
  FROM ed WHERE operation <> 'EVENT_OTHER'),
ends AS (SELECT day, batch, min(timestamp_rec) AS f, max(timestamp_rec) AS l FROM bt GROUP BY day, batch),
walk AS (
  SELECT day, batch, f AS start, 0 AS dw, l > f + 3600000000000 AS closes, l FROM ends WHERE batch = 0
  UNION ALL
  SELECT e.day, e.batch, CASE WHEN w.closes THEN w.l ELSE w.start END, CASE WHEN w.closes THEN w.dw + 1 ELSE w.dw END,
    e.l > CASE WHEN w.closes THEN w.l ELSE w.start END + 3600000000000, e.l
  FROM walk w JOIN ends e ON e.day = w.day AND e.batch = w.batch + 1),
closed AS (SELECT day, dw, start, l AS fin, row_number() OVER (ORDER BY day, dw) - 1 AS tw FROM walk WHERE closes),
win AS (
  SELECT b.*, c.tw, c.start AS tw_start, c.fin AS tw_end FROM bt b JOIN walk w ON b.day = w.day AND b.batch = w.batch JOIN closed c ON c.day = w.day AND c.dw = w.dw),
fused AS (
  SELECT day, tw, src, dst, operation, timestamp_rec AS time, event_uuid, loss
  FROM (SELECT *, lag(operation) OVER (PARTITION BY day, tw, src, dst ORDER BY timestamp_rec, event_uuid, _id) AS before FROM win)
  WHERE before IS NULL OR before <> operation),
typed AS (
  SELECT f.*, s.node_type AS src_type, d.node_type AS dst_type, CASE WHEN f.day <= 20 THEN 'train' WHEN f.day <= 23 THEN 'val' ELSE 'test' END AS split
  FROM fused f JOIN nodes s ON f.src = s.index_id JOIN nodes d ON f.dst = d.index_id),
ls AS (SELECT src AS srcnode, dst AS dstnode, loss, tw, operation AS edge_type, time, split FROM typed),
byn AS (SELECT srcnode AS node, loss, tw FROM ls WHERE split = 'test' UNION ALL SELECT dstnode, loss, tw FROM ls WHERE split = 'test'),
peak AS (SELECT node, max(loss) AS score, count(*) AS n FROM byn GROUP BY node),
scored AS (
  SELECT p.node, p.score, CAST(coalesce((SELECT min(tw) FROM byn b WHERE b.node = p.node AND b.loss = p.score AND p.score > 0), -1) AS INTEGER) AS tw_with_max_loss FROM peak p),
truth AS (
  SELECT CASE node_type WHEN 'subject' THEN 'a1' ELSE 'a2' END AS attack, index_id AS node, node_uuid, msg AS node_label FROM nodes
  WHERE (node_type = 'subject' AND CAST(substr(node_uuid, 2) AS INTEGER) % 5 = 0) OR node_type = 'netflow')"""
)
_DOCS = """
sc AS (
  SELECT d.doc_id AS node, CAST(d.n_chars AS DOUBLE) / (d.doc_id % 97 + 1) AS score, l.toxic AS y_true, CASE WHEN CAST(d.n_chars AS DOUBLE) / (d.doc_id % 97 + 1) > 100 THEN 1 ELSE 0 END AS y_hat, CAST(d.doc_id % 7 AS INTEGER) AS tw_with_max_loss
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
gr AS (SELECT score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM sc GROUP BY score),
cv AS (
  SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM gr WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
_TRADE = """
tr AS (
  SELECT CAST(month(l_shipdate) AS INTEGER) AS tw, o_custkey AS src, l_partkey + 1000000 AS dst, l_returnflag AS operation,
    epoch_us(l_shipdate) * 1000 AS time, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS event_uuid, l_discount AS loss
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def query(sql: str | None = None):
    def register(fn: Callable[[Fixture], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Fixture(spark, sf_dir))
        QUERIES[fn.__name__].__doc__ = fn.__doc__
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def raw_sql(body: str) -> str:
    return f"WITH {_RAW} {body}"


def win_sql(body: str) -> str:
    return f"WITH RECURSIVE {_WIN} {body}"


# -- ingestion --------------------------------------------------------------


def cdm_lines(fx: Fixture) -> DataFrame:
    """Raw records of the theia_e3 kind, made from the derived events and nodes."""
    p = cdm.PREFIX + "18."
    n, e = fx.nodes, fx.raw_events
    subject = F.format_string('{"datum":{"' + p + 'Subject":{"uuid":"%s","type":"SUBJECT_PROCESS","cmdLine":{"string":"%s"},"properties":{"map":{"path":"%s"}}}}}', "node_uuid", "cmd", "path")
    file = F.format_string('{"datum":{"' + p + 'FileObject":{"uuid":"%s","baseObject":{"properties":{"map":{"filename":"%s"}}},"type":"FILE_OBJECT_FILE"}}}', "node_uuid", "path")
    flow = F.format_string('{"datum":{"' + p + 'NetFlowObject":{"uuid":"%s","localAddress":"%s","localPort":%s,"remoteAddress":"%s","remotePort":%s}}}', "node_uuid", "src_addr", "src_port", "dst_addr", "dst_port")
    event = F.format_string('{"datum":{"' + p + 'Event":{"uuid":"%s","type":"%s","subject":{"' + p + 'UUID":"%s"},"predicateObject":{"' + p + 'UUID":"%s"},"timestampNanos":%s}}}', "event_uuid", "operation", "subject", "object", F.col("timestamp_rec").cast("string"))
    kind = F.when(F.col("node_type") == "subject", subject).when(F.col("node_type") == "file", file).otherwise(flow)
    lines = n.select(kind.alias("value")).unionByName(e.select(event.alias("value")))
    return lines.withColumn("file", F.lit("derived")).withColumn("line_id", F.monotonically_increasing_id())


@query(raw_sql("SELECT count(*) AS n, CASE left(node_uuid, 1) WHEN 'S' THEN 'Subject' WHEN 'F' THEN 'FileObject' ELSE 'NetFlowObject' END AS kind FROM nodes GROUP BY ALL UNION ALL SELECT count(*), 'Event' FROM ev"))
def cdm_kinds(fx):
    """Records by kind."""
    return cdm_lines(fx).groupBy(cdm.cdm_kind(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))


@query(raw_sql("SELECT index_id, node_uuid, sha256(node_uuid) AS hash_id, node_type, CASE node_type WHEN 'subject' THEN '/bin/' || node_uuid WHEN 'file' THEN '/data/' || node_uuid END AS path, CASE node_type WHEN 'subject' THEN node_uuid || ' -x' END AS cmd, CASE node_type WHEN 'netflow' THEN '1.2.3.4' END AS dst_addr, CASE node_type WHEN 'netflow' THEN '80' END AS dst_port FROM nodes"))
def cdm_nodes(fx):
    """Raw lines to one nodes table with dense ids."""
    nodes, _ = cdm.ingest(cdm_lines(fx), cdm.PROFILES["theia_e3"])
    return nodes.select("index_id", "node_uuid", "hash_id", "node_type", "path", "cmd", "dst_addr", "dst_port")


@query(raw_sql("SELECT src AS src_index_id, dst AS dst_index_id, operation, event_uuid, timestamp_rec FROM ed WHERE operation <> 'EVENT_OTHER'"))
def cdm_events(fx):
    """Raw lines to resolved, filtered and oriented events."""
    _, events = cdm.ingest(cdm_lines(fx), cdm.PROFILES["theia_e3"])
    return events.select("src_index_id", "dst_index_id", "operation", "event_uuid", "timestamp_rec")


@query(raw_sql("SELECT 'S' || c AS uuid, cmd FROM (SELECT s AS c, arg_max(event_type || ' ' || event_id, lpad(CAST(ns AS VARCHAR), 20, '0') || lpad(CAST(event_id AS VARCHAR), 20, '0')) AS cmd FROM raw GROUP BY s)"))
def cdm_subject_commands(fx):
    """Last command of each subject, taken from its events (last write wins)."""
    e = fx.table("events")
    rows = e.select(F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("uuid"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("cmd"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    return cdm.dedup_last(rows, "uuid", ["t", "event_id"], ["cmd"])


@query(raw_sql("SELECT operation, count(*) AS n FROM ev WHERE operation NOT IN ('EVENT_FCNTL', 'EVENT_OTHER', 'EVENT_ADD_OBJECT_ATTRIBUTE', 'EVENT_FLOWS_TO') GROUP BY operation"))
def relation_filter(fx):
    """Events by relation, without the excluded ones."""
    return cdm.filter_relations(fx.raw_events, cdm.PROFILES["cadets_e3"]).groupBy("operation").agg(F.count("*").alias("n"))


@query("SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS index_id, l_orderkey, l_linenumber, l_partkey FROM lineitem")
def dense_numbers(fx):
    """Dense numbers of all order lines, without a global window."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return dense_index(fx.table("lineitem").select(keys), keys).select("index_id", "l_orderkey", "l_linenumber", "l_partkey")


def _folder(fx: Fixture, name: str) -> str:
    """A new folder among the shared ones."""
    return f"{shared_dir(fx.spark)}/{name}-{uuid.uuid4().hex}"


@query(raw_sql("SELECT count(*) AS n, CASE left(node_uuid, 1) WHEN 'S' THEN 'Subject' WHEN 'F' THEN 'FileObject' ELSE 'NetFlowObject' END AS kind FROM nodes GROUP BY ALL UNION ALL SELECT count(*), 'Event' FROM ev"))
def log_files(fx):
    """Raw lines written as text files and read back, by kind."""
    path = _folder(fx, "logs")
    cdm_lines(fx).select("value").write.text(path)
    return cdm.read_cdm(fx.spark, path, "part-*").groupBy(cdm.cdm_kind(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))


_CADETS = """,
cl AS (
  SELECT node_uuid AS u, node_type AS t, CAST(regexp_extract(node_uuid, '[0-9]+$') AS BIGINT) AS k FROM nodes),
ce AS (
  SELECT subject, object, 'x' || (_id % 5) AS exec, CASE WHEN _id % 9 = 4 THEN NULL ELSE '/p/' || (_id % 7) END AS path,
    lpad(CAST(timestamp_rec AS VARCHAR), 20, '0') || event_uuid AS at FROM ev),
cn AS (
  SELECT u, 'netflow' AS t, NULL AS path, NULL AS cmd, '1.2.3.4' AS dst_addr, 0 AS r FROM cl WHERE t = 'netflow' AND k % 8 = 2
  UNION ALL SELECT u, 'netflow', NULL, NULL, NULL, 0 FROM cl WHERE t = 'file' AND k % 16 = 1
  UNION ALL SELECT l.u, 'subject', NULL, arg_max(e.exec, e.at), NULL, 1 FROM cl l JOIN ce e ON e.subject = l.u WHERE l.t = 'subject' GROUP BY l.u
  UNION ALL SELECT l.u, 'file', nullif(arg_max(coalesce(e.path, '?'), e.at), '?'), NULL, NULL, 2 FROM cl l JOIN ce e ON e.object = l.u WHERE l.t = 'file' AND k % 16 <> 1 GROUP BY l.u)"""


def cadets_lines(fx: Fixture) -> DataFrame:
    """Raw records of the cadets_e3 kind: commands and paths in events, unix sockets, netflows without remote end."""
    p = cdm.PREFIX + "18."
    k = F.regexp_extract("node_uuid", "[0-9]+$", 0).cast("long")
    subject = F.format_string('{"datum":{"' + p + 'Subject":{"uuid":"%s","type":"SUBJECT_PROCESS"}}}', "node_uuid")
    file = F.format_string('{"datum":{"' + p + 'FileObject":{"uuid":"%s","type":"%s"}}}', "node_uuid", F.when(k % 16 == 1, "FILE_OBJECT_UNIX_SOCKET").otherwise("FILE_OBJECT_FILE"))
    remote = F.when(k % 8 == 2, ',"remoteAddress":"1.2.3.4","remotePort":80').otherwise("")
    flow = F.format_string('{"datum":{"' + p + 'NetFlowObject":{"uuid":"%s","localAddress":"10.0.0.1","localPort":4444%s}}}', "node_uuid", remote)
    path = F.when(F.col("_id") % 9 == 4, "null").otherwise(F.format_string('{"string":"/p/%s"}', (F.col("_id") % 7).cast("string")))
    event = F.format_string('{"datum":{"' + p + 'Event":{"uuid":"%s","type":"%s","subject":{"' + p + 'UUID":"%s"},"predicateObject":{"' + p + 'UUID":"%s"},"predicateObjectPath":%s,"timestampNanos":%s,"properties":{"map":{"exec":"x%s"}}}}}', "event_uuid", "operation", "subject", "object", path, F.col("timestamp_rec").cast("string"), (F.col("_id") % 5).cast("string"))
    kind = F.when(F.col("node_type") == "subject", subject).when(F.col("node_type") == "file", file).otherwise(flow)
    lines = fx.nodes.select(kind.alias("value")).unionByName(fx.raw_events.select(event.alias("value")))
    return lines.withColumn("file", F.lit("derived")).withColumn("line_id", F.monotonically_increasing_id())


@query(raw_sql(_CADETS.lstrip("\n") + " SELECT row_number() OVER (ORDER BY r, u) - 1 AS index_id, u AS node_uuid, t AS node_type, path, cmd, dst_addr FROM cn"))
def cdm_cadets_nodes(fx):
    """Nodes of the profile whose commands and paths stand in events."""
    nodes, _ = cdm.ingest(cadets_lines(fx), cdm.PROFILES["cadets_e3"])
    return nodes.select("index_id", "node_uuid", "node_type", "path", "cmd", "dst_addr")


@query(raw_sql(_CADETS.lstrip("\n") + " SELECT e.event_uuid, e.operation, CASE WHEN e.operation IN ('EVENT_READ', 'EVENT_OPEN') THEN e.object ELSE e.subject END AS src, CASE WHEN e.operation IN ('EVENT_READ', 'EVENT_OPEN') THEN e.subject ELSE e.object END AS dst FROM ev e WHERE e.operation <> 'EVENT_OTHER' AND e.subject IN (SELECT u FROM cn WHERE t = 'subject') AND e.object IN (SELECT u FROM cn)"))
def cdm_cadets_events(fx):
    """Events of that profile, by the uuids of their ends."""
    nodes, events = cdm.ingest(cadets_lines(fx), cdm.PROFILES["cadets_e3"])
    named = lambda c: nodes.select(F.col("index_id").alias(f"{c}_index_id"), F.col("node_uuid").alias(c))
    return events.join(named("src"), "src_index_id").join(named("dst"), "dst_index_id").select("event_uuid", "operation", "src", "dst")


@query(raw_sql("SELECT index_id, node_uuid, node_type, CASE node_type WHEN 'file' THEN '/data/' || node_uuid END AS path, CASE node_type WHEN 'subject' THEN node_uuid || ' -x' END AS cmd, CASE node_type WHEN 'netflow' THEN '10.0.0.1' END AS src_addr, CASE node_type WHEN 'netflow' THEN '80' END AS dst_port FROM nodes"))
def cdm_wrapped_nodes(fx):
    """Nodes of the profile that wraps addresses and ports and knows subjects by their command alone."""
    p, n = cdm.PREFIX + "20.", fx.nodes
    subject = F.format_string('{"datum":{"' + p + 'Subject":{"uuid":"%s","cmdLine":{"string":"%s"},"properties":{"map":{"path":"%s"}}}}}', "node_uuid", "cmd", "path")
    file = F.format_string('{"datum":{"' + p + 'FileObject":{"uuid":"%s","baseObject":{"properties":{"map":{"path":"%s"}}},"type":"FILE_OBJECT_FILE"}}}', "node_uuid", "path")
    flow = F.format_string('{"datum":{"' + p + 'NetFlowObject":{"uuid":"%s","localAddress":{"string":"%s"},"localPort":{"int":%s},"remoteAddress":{"string":"%s"},"remotePort":{"int":%s}}}}', "node_uuid", "src_addr", "src_port", "dst_addr", "dst_port")
    kind = F.when(F.col("node_type") == "subject", subject).when(F.col("node_type") == "file", file).otherwise(flow)
    lines = n.select(kind.alias("value")).withColumn("file", F.lit("derived")).withColumn("line_id", F.monotonically_increasing_id())
    nodes, _ = cdm.ingest(lines, cdm.PROFILES["clearscope_e5"])
    return nodes.select("index_id", "node_uuid", "node_type", "path", "cmd", "src_addr", "dst_port")


def _with_lines(nodes: DataFrame, subject: DataFrame, file: DataFrame, flow: DataFrame) -> DataFrame:
    kind = F.when(F.col("node_type") == "subject", subject).when(F.col("node_type") == "file", file).otherwise(flow)
    return nodes.select(kind.alias("value")).withColumn("file", F.lit("derived")).withColumn("line_id", F.monotonically_increasing_id())


@query(raw_sql("SELECT row_number() OVER (ORDER BY index_id) - 1 AS index_id, node_uuid, node_type, CASE node_type WHEN 'subject' THEN '/bin/' || node_uuid WHEN 'file' THEN '/data/' || node_uuid END AS path, CASE node_type WHEN 'subject' THEN node_uuid || ' -x' END AS cmd, CASE node_type WHEN 'netflow' THEN '1.2.3.4' END AS dst_addr FROM nodes WHERE NOT (node_type = 'subject' AND CAST(substr(node_uuid, 2) AS INTEGER) % 3 = 1)"))
def cdm_theia_e5_nodes(fx):
    """Nodes of the profile that wraps endpoints and drops subjects without a path."""
    p = cdm.PREFIX + "20."
    path = F.when(F.regexp_extract("node_uuid", "[0-9]+$", 0).cast("long") % 3 == 1, F.lit("")).otherwise(F.format_string('"path":"%s"', "path"))
    subject = F.format_string('{"datum":{"' + p + 'Subject":{"uuid":"%s","cmdLine":{"string":"%s"},"properties":{"map":{%s}}}}}', "node_uuid", "cmd", path)
    file = F.format_string('{"datum":{"' + p + 'FileObject":{"uuid":"%s","baseObject":{"properties":{"map":{"path":"%s"}}},"type":"FILE_OBJECT_FILE"}}}', "node_uuid", "path")
    flow = F.format_string('{"datum":{"' + p + 'NetFlowObject":{"uuid":"%s","localAddress":{"string":"%s"},"localPort":{"int":%s},"remoteAddress":{"string":"%s"},"remotePort":{"int":%s}}}}', "node_uuid", "src_addr", "src_port", "dst_addr", "dst_port")
    nodes, _ = cdm.ingest(_with_lines(fx.nodes, subject, file, flow), cdm.PROFILES["theia_e5"])
    return nodes.select("index_id", "node_uuid", "node_type", "path", "cmd", "dst_addr")


@query(raw_sql("SELECT row_number() OVER (ORDER BY index_id) - 1 AS index_id, node_uuid, node_type, CASE node_type WHEN 'file' THEN '/data/' || node_uuid END AS path, CASE node_type WHEN 'subject' THEN node_uuid || ' -x' END AS cmd, CASE WHEN node_type = 'netflow' THEN '10.0.0.1' END AS src_addr FROM nodes WHERE NOT (node_type = 'file' AND CAST(regexp_extract(node_uuid, '[0-9]+$') AS BIGINT) % 16 = 1)"))
def cdm_clearscope_e3_nodes(fx):
    """Nodes of the profile with plain endpoints and subjects known by their command; files without a path are none."""
    p = cdm.PREFIX + "18."
    path = F.when(F.regexp_extract("node_uuid", "[0-9]+$", 0).cast("long") % 16 == 1, F.lit("null")).otherwise(F.format_string('{"path":"%s"}', "path"))
    subject = F.format_string('{"datum":{"' + p + 'Subject":{"uuid":"%s","cmdLine":{"string":"%s"},"properties":{"map":{"path":"%s"}}}}}', "node_uuid", "cmd", "path")
    file = F.format_string('{"datum":{"' + p + 'FileObject":{"uuid":"%s","baseObject":{"properties":{"map":%s}},"type":"FILE_OBJECT_FILE"}}}', "node_uuid", path)
    flow = F.format_string('{"datum":{"' + p + 'NetFlowObject":{"uuid":"%s","localAddress":"%s","localPort":%s,"remoteAddress":"","remotePort":0}}}', "node_uuid", "src_addr", "src_port")
    nodes, _ = cdm.ingest(_with_lines(fx.nodes, subject, file, flow), cdm.PROFILES["clearscope_e3"])
    return nodes.select("index_id", "node_uuid", "node_type", "path", "cmd", "src_addr")


@query(raw_sql("SELECT o.u AS node_uuid, nullif(arg_max(CASE WHEN e._id % 6 = 5 THEN '?' ELSE '/p/' || (e._id % 7) END, lpad(CAST(e.timestamp_rec AS VARCHAR), 20, '0') || e.event_uuid), '?') AS path FROM (SELECT node_uuid AS u FROM nodes WHERE node_type = 'file') o JOIN ev e ON e.object = o.u GROUP BY o.u"))
def cdm_unknown_paths(fx):
    """Paths of files from their events; an event whose line says <unknown> gives none."""
    p = cdm.PREFIX + "18."
    file = fx.nodes.where("node_type = 'file'").select(F.format_string('{"datum":{"' + p + 'FileObject":{"uuid":"%s","type":"FILE_OBJECT_FILE"}}}', "node_uuid").alias("value"))
    name = F.when(F.col("_id") % 6 == 5, "<unknown>").otherwise("sh")
    event = F.format_string('{"datum":{"' + p + 'Event":{"uuid":"%s","type":"%s","subject":{"' + p + 'UUID":"%s"},"predicateObject":{"' + p + 'UUID":"%s"},"predicateObjectPath":{"string":"/p/%s"},"timestampNanos":%s,"properties":{"map":{"exec":"%s"}}}}}', "event_uuid", "operation", "subject", "object", (F.col("_id") % 7).cast("string"), F.col("timestamp_rec").cast("string"), name)
    lines = file.unionByName(fx.raw_events.select(event.alias("value"))).withColumn("file", F.lit("derived")).withColumn("line_id", F.monotonically_increasing_id())
    return cdm.file_nodes(cdm.parse_records(lines, cdm.PROFILES["cadets_e3"]), cdm.PROFILES["cadets_e3"]).select(F.col("uuid").alias("node_uuid"), "path")


@query(raw_sql("SELECT src AS src_index_id, dst AS dst_index_id, operation, event_uuid, timestamp_rec FROM ed"))
def stored_event_table(fx):
    """Node and event tables written and read back; here the events."""
    path = _folder(fx, "tables")
    tables.write_tables({"nodes": fx.nodes, "event": fx.events}, path)
    return tables.read_tables(fx.spark, path, "event").select("src_index_id", "dst_index_id", "operation", "event_uuid", "timestamp_rec")


#: Database of the queries that need one; unset, an embedded one in memory, which only a single JVM can reach.
DATABASE = "spark.tracewell.jdbc.url"


@query(raw_sql("SELECT src AS src_index_id, dst AS dst_index_id, operation, event_uuid, timestamp_rec FROM ed"))
def database_event_table(fx):
    """The event table appended to a database, twice, and read back in eight ranges of time of near equal rows."""
    url = fx.spark.conf.get(DATABASE, None) or f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    name = f"event_{uuid.uuid4().hex[:12]}"
    events = fx.events.select("src_index_id", "dst_index_id", "operation", "event_uuid", "timestamp_rec")
    for _ in range(2):
        tables.write_tables({name: events}, url, {name: ["event_uuid"]}, {name: "operation VARCHAR(64), event_uuid VARCHAR(64)"})
    return tables.read_tables(fx.spark, url, name, 8)


@query(win_sql("SELECT day, CAST(tw AS INTEGER) AS tw, src, dst, operation, time, event_uuid FROM fused WHERE day IN (24, 25, 26)"))
def stored_graphs(fx):
    """Window graphs written by day; three days read back."""
    path = _folder(fx, "graphs")
    tables.write_graphs(fx.edges, graphs.window_nodes(fx.windowed, fx.nodes), path)
    return tables.read_graphs(fx.spark, path, [24, 25, 26]).select("day", F.col("tw").cast("int").alias("tw"), "src", "dst", "operation", "time", "event_uuid")


@query(win_sql("SELECT CAST(l.tw AS INTEGER) AS tw, l.split, 3 AS model_epoch, l.srcnode, l.dstnode, s.msg AS srcmsg, d.msg AS dstmsg, l.edge_type, l.time, round(l.loss, 9) AS loss FROM ls l JOIN nodes s ON l.srcnode = s.index_id JOIN nodes d ON l.dstnode = d.index_id WHERE l.split = 'val'"))
def stored_losses(fx):
    """Edge losses written as CSV by split, epoch and window, and read back."""
    path = _folder(fx, "losses")
    e = scoring.describe_losses(fx.losses("val"), fx.nodes.select("index_id", "msg"))
    tables.write_losses(e.withColumn("split", F.lit("val")).withColumn("model_epoch", F.lit(3)), path)
    rows = tables.read_losses(fx.spark, path)
    return rows.select("tw", "split", "model_epoch", "srcnode", "dstnode", "srcmsg", "dstmsg", "edge_type", "time", F.round("loss", 9).alias("loss"))


@query(win_sql("SELECT attack, node_uuid, node_label, CAST(node AS VARCHAR) AS node_id FROM truth"))
def stored_truth(fx):
    """Ground truth written as CSV, a folder for each attack, and read back with the attack that the path names."""
    path = _folder(fx, "truth")
    fx.truth.select("attack", "node_uuid", "node_label", "node_id").write.partitionBy("attack").csv(path)
    return tables.read_ground_truth(fx.spark, path)


# -- text and time ----------------------------------------------------------


@query("SELECT c_custkey, sha256(c_name || ' ' || c_mktsegment) AS label, c_name || ' ' || c_mktsegment AS msg, sha256(c_name) AS hash_id, c_name AS display FROM customer")
def node_texts(fx):
    """Label, message, hash and display name of customers as subjects."""
    c = fx.table("customer").select("c_custkey", "c_name", "c_mktsegment", F.lit("subject").alias("t"), F.lit(None).cast("string").alias("z"))
    z = F.col("z")
    label = X.node_label(F.col("t"), {"path": F.col("c_name"), "cmd": F.col("c_mktsegment")}, {"subject": ["path", "cmd"]})
    return c.select("c_custkey", label.alias("label"), X.node_message(F.col("t"), F.col("c_name"), F.col("c_mktsegment"), z, z).alias("msg"), X.node_hash(F.col("c_name")).alias("hash_id"), X.node_display(F.col("t"), F.col("c_name"), F.col("c_mktsegment"), z, z, z, z).alias("display"))


@query("SELECT s_suppkey, '10.' || s_nationkey || ':' || s_suppkey AS msg, 'None:None->10.' || s_nationkey || ':' || s_suppkey AS display, string_split('10 . ' || s_nationkey || ' : ' || s_suppkey, ' ') AS tokens FROM supplier")
def netflow_texts(fx):
    """Message, display name and tokens of suppliers as netflows."""
    s = fx.table("supplier").select("s_suppkey", F.concat(F.lit("10."), F.col("s_nationkey").cast("string")).alias("a"), F.col("s_suppkey").cast("string").alias("p"), F.lit("netflow").alias("t"), F.lit(None).cast("string").alias("z"))
    msg = X.node_message(F.col("t"), F.col("z"), F.col("z"), F.col("a"), F.col("p"))
    display = X.node_display(F.col("t"), F.col("z"), F.col("z"), F.col("z"), F.col("z"), F.col("a"), F.col("p"))
    return s.select("s_suppkey", msg.alias("msg"), display.alias("display"), X.tokenize_netflow(msg).alias("tokens"))


@query("SELECT p_partkey, string_split('/ ' || replace(p_name, ' ', ' / '), ' ') AS tokens, xx AS n FROM (SELECT *, len(string_split(p_name, ' ')) AS xx FROM part)")
def path_tokens(fx):
    """Tokens of parts as file paths."""
    path = F.concat(F.lit("\\\\"), F.replace("p_name", F.lit(" "), F.lit("/")))
    return fx.table("part").select("p_partkey", X.tokenize_path(path).alias("tokens"), F.size(F.split("p_name", " ")).cast("long").alias("n"))


@query("SELECT p_name AS msg, count(*) AS copies, max(p_partkey) AS index_id FROM part GROUP BY p_name")
def corpus_messages(fx):
    """One row for each distinct message of the corpus, with the node that speaks for it."""
    n = fx.table("part").select(F.col("p_name").alias("msg"), F.col("p_partkey").alias("index_id"), F.lit("file").alias("node_type"))
    corpus = features.build_corpus(n)
    best = n.groupBy("msg").agg(F.count("*").alias("copies"), F.max("index_id").alias("index_id"))
    return corpus.join(best, "msg").select("msg", "copies", "index_id")


@query("SELECT DISTINCT p_name AS msg, list_concat(['file'], string_split(p_name, ' ')) AS tokens FROM part UNION ALL SELECT DISTINCT '10.' || s_nationkey || ':' || s_suppkey, list_concat(['netflow'], ['10', '.', CAST(s_nationkey AS VARCHAR), ':', CAST(s_suppkey AS VARCHAR)]) FROM supplier")
def typed_tokens(fx):
    """Token lists of the corpus, led by the node's type."""
    files = fx.table("part").select(F.col("p_name").alias("msg"), F.col("p_partkey").alias("index_id"), F.lit("file").alias("node_type"))
    flows = fx.table("supplier").select(F.concat(F.lit("10."), F.col("s_nationkey").cast("string"), F.lit(":"), F.col("s_suppkey").cast("string")).alias("msg"), F.col("s_suppkey").alias("index_id"), F.lit("netflow").alias("node_type"))
    return features.build_corpus(files.unionByName(flows), use_node_types=True).select("msg", "tokens")


@query("SELECT o_orderpriority, count(DISTINCT coalesce(o_orderstatus, '') || '|' || CAST(o_custkey AS VARCHAR)) AS n FROM orders GROUP BY o_orderpriority")
def row_hash_counts(fx):
    """Distinct rows by their hash, which are as many as distinct rows."""
    o = fx.table("orders")
    return o.groupBy("o_orderpriority").agg(F.countDistinct(X.hash_list(F.coalesce("o_orderstatus", F.lit("")), F.col("o_custkey").cast("string"))).alias("n"))


@query("SELECT page_id, regexp_extract(url, '([^./?]+)$', 1) AS extension, len(string_split(url, '.')) AS n FROM pages")
def file_extensions(fx):
    """Extension of a name, here of the last dotted part of urls."""
    p = fx.table("pages")
    name = F.element_at(F.split("url", r"[/?]"), -1)
    return p.select("page_id", F.coalesce(X.split_filename(name)["extension"], name).alias("extension"), F.size(F.split("url", r"\.")).cast("long").alias("n"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST((epoch_us(ts) * 1000) % 1000000000 AS VARCHAR), 9, '0') AS utc, epoch_us(ts) * 1000 AS back, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS sec, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS eastern FROM events")
def times(fx):
    """Nanoseconds to text and back; January in the eastern zone is five hours behind."""
    e = fx.table("events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ns"))
    text = T.ns_to_text(F.col("ns"), "UTC")
    sec = T.text_to_sec(F.substring(text, 1, 19), "UTC")
    return e.select("event_id", text.alias("utc"), T.text_nanos_to_ns(T.ns_to_text(F.col("ns"))).alias("back"), sec.alias("sec"), T.sec_to_text(sec).alias("eastern"))


@query("SELECT o_orderkey, len(generate_series(o_orderdate, o_orderdate + INTERVAL 95 MINUTE, INTERVAL 30 MINUTE)) + 1 AS n_ticks FROM orders")
def ticks(fx):
    """Ticks every 30 minutes over 95 minutes, the end included."""
    o = fx.table("orders").withColumn("t", F.col("o_orderdate").cast("timestamp"))
    return o.select("o_orderkey", F.size(T.tick_series(F.col("t"), F.col("t") + F.expr("interval 95 minutes"), 30)).cast("long").alias("n_ticks"))


# -- windows and graphs -----------------------------------------------------


@query(raw_sql("SELECT CAST(day AS INTEGER) AS day, count(*) AS n FROM ev WHERE day BETWEEN 3 AND 9 AND timestamp_rec > CAST(1704067200 + (day - 1) * 86400 AS BIGINT) * 1000000000 GROUP BY day"))
def day_counts(fx):
    """Events by day of a range of days, midnight excluded."""
    e = fx.raw_events.drop("day")
    return graphs.day_slices(e, "2024-01", range(3, 10), "UTC").groupBy("day").agg(F.count("*").alias("n"))


@query(win_sql("SELECT day, CAST(tw AS INTEGER) AS tw, min(tw_start) AS tw_start, min(tw_end) AS tw_end, count(*) AS n_events FROM win GROUP BY day, tw"))
def greedy_windows(fx):
    """Batch-greedy windows and their events."""
    w = fx.windowed
    return w.groupBy("day", F.col("tw").cast("int").alias("tw")).agg(F.min("tw_start").alias("tw_start"), F.min("tw_end").alias("tw_end"), F.count("*").alias("n_events"))


@query(win_sql("SELECT day, CAST(tw AS INTEGER) AS tw, src, dst, operation, time, event_uuid FROM fused"))
def fused_edges(fx):
    """Edges after run collapse."""
    return fx.edges.withColumn("tw", F.col("tw").cast("int"))


@query(win_sql("SELECT DISTINCT w.day, CAST(w.tw AS INTEGER) AS tw, n.index_id, n.node_type, n.msg AS label FROM (SELECT day, tw, src AS i FROM win UNION SELECT day, tw, dst FROM win) w JOIN nodes n ON w.i = n.index_id"))
def window_node_sets(fx):
    """Nodes of every window."""
    return graphs.window_nodes(fx.windowed, fx.nodes).withColumn("tw", F.col("tw").cast("int"))


@query(win_sql("SELECT e.day, CAST(e.tw AS INTEGER) AS tw, e.n AS n_events, x.n AS n_nodes, f.n AS n_edges FROM (SELECT day, tw, count(*) AS n FROM win GROUP BY ALL) e JOIN (SELECT tw, count(DISTINCT i) AS n FROM (SELECT tw, src AS i FROM win UNION ALL SELECT tw, dst FROM win) GROUP BY tw) x ON e.tw = x.tw JOIN (SELECT tw, count(*) AS n FROM fused GROUP BY tw) f ON f.tw = e.tw"))
def window_statistics(fx):
    """Events, nodes and edges of every window."""
    return graphs.window_stats(fx.windowed, fx.edges).withColumn("tw", F.col("tw").cast("int"))


@query(raw_sql("SELECT node_type, count(*) AS n FROM nodes GROUP BY node_type"))
def node_types(fx):
    return graphs.node_type_counts(fx.nodes)


@query(win_sql("SELECT CAST(tw AS INTEGER) AS tw, min(time) AS start, max(time) AS \"end\" FROM fused GROUP BY tw"))
def window_time_bounds(fx):
    return graphs.window_bounds(fx.edges).withColumn("tw", F.col("tw").cast("int"))


@query(raw_sql("SELECT timestamp_rec - timestamp_rec % 900000000000 AS tw_start, operation, count(*) AS n FROM ev GROUP BY ALL"))
def tumbling_counts(fx):
    """Events by fixed windows of 15 minutes."""
    return graphs.tumbling_windows(fx.raw_events, 15.0).groupBy("tw_start", "operation").agg(F.count("*").alias("n"))


@query(win_sql("SELECT split, count(*) AS n_edges, max(greatest(src, dst)) + 1 AS n_nodes FROM typed GROUP BY split"))
def split_sizes(fx):
    """Edges by split, and greatest node id + 1."""
    e = fx.typed_edges
    return e.groupBy("split").agg(F.count("*").alias("n_edges"), (F.max(F.greatest("src", "dst")) + 1).alias("n_nodes"))


@query(f"WITH {_TRADE} SELECT max(greatest(src, dst)) + 1 AS n_nodes FROM tr")
def greatest_node(fx):
    e = fx.trade_edges
    return graphs.max_node_id(graphs.full_edges(e.where("operation = 'A'"), e.where("operation <> 'A'")))


@query(f"WITH {_TRADE}, n AS (SELECT tw, src AS node FROM tr UNION SELECT tw, dst FROM tr) SELECT tw, node, CAST(row_number() OVER (PARTITION BY tw ORDER BY node) - 1 AS INTEGER) AS local FROM n")
def local_ids(fx):
    """Ids from 0 inside each window."""
    return graphs.reindex_nodes(fx.trade_edges).withColumn("local", F.col("local").cast("int"))


@query(f"WITH {_TRADE}, n AS (SELECT tw, src AS node, 'src' AS role, operation, time, event_uuid FROM tr UNION ALL SELECT tw, dst, 'dst', operation, time, event_uuid FROM tr) SELECT tw, node, role, arg_max(operation, lpad(CAST(time AS VARCHAR), 20, '0') || event_uuid) AS feature FROM n GROUP BY tw, node, role")
def last_edge_features(fx):
    """Feature of each node's last edge by role."""
    e = fx.trade_edges.withColumn("feature", F.col("operation"))
    return graphs.edge_to_node_features(e)


@query("SELECT o_custkey AS node, max(epoch_us(o_orderdate)) AS time, arg_max(o_orderpriority, CAST(epoch_us(o_orderdate) AS VARCHAR) || o_orderpriority) AS msg FROM orders GROUP BY o_custkey")
def last_messages(fx):
    """Latest message of each node."""
    o = fx.table("orders").select(F.col("o_custkey").alias("node"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("time"), F.col("o_orderpriority").alias("msg"))
    return graphs.last_message(o)


# -- features ---------------------------------------------------------------


@query("SELECT n, i, round(1.0 / n - (n - 1) * (-1.0 / (30.0 * n)) / 2 + (i - 1) * (-1.0 / (30.0 * n)), 9) AS weight FROM (SELECT DISTINCT len(string_split(p_name, ' ')) + 2 AS n FROM part), (SELECT unnest(range(1, 4)) AS i)")
def position_weights(fx):
    """Weights of the first three of n tokens, for the lengths that occur."""
    n = fx.table("part").select((F.size(F.split("p_name", " ")) + 2).cast("long").alias("n")).distinct()
    rows = n.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(3)).cast("array<bigint>")))
    return rows.select("n", "i", F.round(features.position_weight(F.col("i"), F.col("n")), 9).alias("weight"))


@query()
def word_vectors(fx):
    """Skip-gram vectors of the words of part names."""
    n = fx.table("part").select(F.col("p_name").alias("msg"), F.col("p_partkey").alias("index_id"), F.lit("file").alias("node_type"))
    return features.train_word_vectors(features.build_corpus(n), dim=16, epochs=2, seed=1)


@query()
def node_text_vectors(fx):
    """Position-weighted node vectors out of word vectors."""
    n = fx.table("part").select(F.col("p_name").alias("msg"), F.col("p_partkey").alias("index_id"), F.lit("file").alias("node_type"))
    vectors = features.train_word_vectors(features.build_corpus(n), dim=16, epochs=2, seed=1)
    return features.node_vectors(n, vectors)


_W = "1.0 / n + (n - 1) * (1.0 / (30.0 * n)) / 2 - (i - 1) * (1.0 / (30.0 * n))"


@query(f"WITH m AS (SELECT DISTINCT p_name AS msg, string_split(p_name, ' ') AS t FROM part), w AS (SELECT msg, len(t) AS n, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS word FROM m), s AS (SELECT msg, sum(len(word) * ({_W})) AS a, sum(ascii(word) * ({_W})) AS b FROM w GROUP BY msg) SELECT p_partkey AS index_id, round(a / sqrt(a * a + b * b), 6) AS x, round(b / sqrt(a * a + b * b), 6) AS y FROM part JOIN s ON p_name = msg")
def given_node_vectors(fx):
    """Position-weighted node vectors under given word vectors: a word's length and first letter."""
    n = fx.table("part").select(F.col("p_name").alias("msg"), F.col("p_partkey").alias("index_id"), F.lit("file").alias("node_type"))
    words = features.build_corpus(n).select(F.explode("tokens").alias("word")).distinct()
    words = words.select("word", F.array(F.length("word").cast("double"), F.ascii("word").cast("double")).alias("vector"))
    found = features.node_vectors(n, words)
    return found.select("index_id", F.round(F.get("vector", F.lit(0)), 6).alias("x"), F.round(F.get("vector", F.lit(1)), 6).alias("y"))


@query(win_sql("SELECT event_uuid, [CASE src_type WHEN 'subject' THEN 1.0 ELSE 0.0 END, CASE src_type WHEN 'file' THEN 1.0 ELSE 0.0 END, CASE src_type WHEN 'netflow' THEN 1.0 ELSE 0.0 END] AS x_src, CAST(16 AS INTEGER) AS n_msg, CASE operation WHEN 'EVENT_OPEN' THEN 3 WHEN 'EVENT_READ' THEN 4 WHEN 'EVENT_SENDTO' THEN 8 WHEN 'EVENT_WRITE' THEN 9 END AS edge FROM typed"))
def type_only_edges(fx):
    """Edge vectors split without the text vectors, the relation among the message."""
    n = fx.nodes
    vectors = n.select("index_id", F.array(*[(F.col("index_id") / 10.0) for _ in range(4)]).alias("vector"))
    e = features.edge_vectors(fx.typed_edges.select("event_uuid", "src", "dst", "operation"), n, vectors)
    s = features.split_edge_vector(e, 4, predict_relation=False, mode="only_type")
    return s.select("event_uuid", "x_src", F.size("msg").alias("n_msg"), F.array_position("edge_feats", F.lit(1.0)).cast("int").alias("edge"))


@query(win_sql("SELECT event_uuid, [CASE src_type WHEN 'subject' THEN 1.0 ELSE 0.0 END, CASE src_type WHEN 'file' THEN 1.0 ELSE 0.0 END, CASE src_type WHEN 'netflow' THEN 1.0 ELSE 0.0 END] AS x_type, CASE operation WHEN 'EVENT_OPEN' THEN 3 WHEN 'EVENT_READ' THEN 4 WHEN 'EVENT_SENDTO' THEN 8 WHEN 'EVENT_WRITE' THEN 9 END AS y, CAST(22 AS INTEGER) AS n_msg, round(src / 10.0, 6) AS first_src FROM typed"))
def edge_vector_parts(fx):
    """Edge vectors assembled and split again."""
    n = fx.nodes
    vectors = n.select("index_id", F.array(*[(F.col("index_id") / 10.0) for _ in range(8)]).alias("vector"))
    e = features.edge_vectors(fx.typed_edges.select("event_uuid", "src", "dst", "operation"), n, vectors)
    s = features.split_edge_vector(e, 8)
    return s.select("event_uuid", F.slice("x_src", 9, 3).alias("x_type"), "y", F.size("msg").alias("n_msg"), F.round(F.element_at("x_src", 1), 6).alias("first_src"))


def _numbered(fx) -> DataFrame:
    e = dense_index(fx.edges.select("src", "dst", "tw", "time", "event_uuid"), ["tw", "time", "event_uuid"], "e_id")
    return e.withColumn("batch", F.floor(F.col("e_id") / 32).cast("long"))


_NB = ", en AS (SELECT src, dst, row_number() OVER (ORDER BY tw, time, event_uuid) - 1 AS e_id FROM fused), eb AS (SELECT *, e_id // 32 AS batch FROM en), nn AS (SELECT src AS node, dst AS nbr, e_id, batch FROM eb UNION ALL SELECT dst, src, e_id, batch FROM eb)"


@query(win_sql(_NB + ", nb AS (SELECT DISTINCT node, batch FROM nn), j AS (SELECT b.node, b.batch, n.e_id, n.nbr, row_number() OVER (PARTITION BY b.node, b.batch ORDER BY n.e_id DESC, n.nbr) AS r FROM nb b JOIN nn n ON n.node = b.node AND n.batch < b.batch) SELECT node, batch, count(*) AS n, sum(e_id) AS e_sum, min(e_id) AS e_min, sum(nbr) AS nbr_sum FROM j WHERE r <= 5 GROUP BY node, batch"))
def last_neighbors(fx):
    """Five last neighbours of each node as of each batch, in digest."""
    found = features.last_k_neighbors(_numbered(fx), 5).select("node", "batch", F.explode("neighbors").alias("x"))
    return found.groupBy("node", "batch").agg(F.count("*").alias("n"), F.sum("x.e_id").alias("e_sum"), F.min("x.e_id").alias("e_min"), F.sum("x.nbr").alias("nbr_sum"))


@query(win_sql(_NB + " SELECT node, nbr, e_id FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY e_id DESC, nbr) AS r FROM nn) WHERE r <= 20"))
def neighbor_snapshots(fx):
    """Twenty last neighbours of each node in the end."""
    return features.neighbor_snapshot(_numbered(fx), 20)


@query(win_sql(_NB + " SELECT node, nbr, e_id FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY e_id DESC, nbr) AS r FROM nn) WHERE r <= 20"))
def streamed_neighbors(fx):
    """The same as the state of a stream over files of edges, stopped half way and begun again from its checkpoint."""
    source, path, checkpoint = (_folder(fx, n) for n in ("edges", "updates", "checkpoint"))
    e = dense_index(fx.edges.select("src", "dst", "tw", "time", "event_uuid"), ["tw", "time", "event_uuid"], "e_id")
    e = cut(e.select("src", "dst", "e_id", F.timestamp_micros((F.col("time") / 1000).cast("long")).alias("ts")))
    n = max(1, len(e.inputFiles()))
    for part in (0, 1):
        e.where(F.col("e_id") % 2 == part).repartition(2 * n).write.mode("append").parquet(source)
        files = fx.spark.readStream.schema(e.schema).option("maxFilesPerTrigger", n).parquet(source)
        streaming.keep_latest(streaming.stream_last_neighbors(files, 20, "40 days"), path, checkpoint)
    return streaming.latest_state(fx.spark, path)


@query(win_sql(_NB + ", nb AS (SELECT DISTINCT node, batch FROM nn), j AS (SELECT b.node, b.batch, n.nbr, row_number() OVER (PARTITION BY b.node, b.batch ORDER BY n.e_id DESC, n.nbr) AS r FROM nb b JOIN nn n ON n.node = b.node AND n.batch < b.batch) SELECT node, batch, [round(avg(nbr), 6), round(avg(nbr * 2.0), 6)] AS vector FROM j WHERE r <= 5 GROUP BY node, batch"))
def neighbor_means(fx):
    """Mean vector of the five last neighbours as of each batch."""
    vectors = fx.nodes.select("index_id", F.array(F.col("index_id").cast("double"), F.col("index_id") * 2.0).alias("vector"))
    return features.neighbor_features(_numbered(fx), vectors, 5).withColumn("vector", F.transform("vector", lambda x: F.round(x, 6)))


# -- scoring ----------------------------------------------------------------

_SUR = ", cn AS (SELECT src_type, dst_type, operation, count(*) AS c FROM typed WHERE split = 'train' GROUP BY ALL), tt AS (SELECT src_type, dst_type, sum(c) AS t FROM cn GROUP BY ALL), su AS (SELECT y.event_uuid, y.src, y.dst, y.tw, y.time, y.operation, -ln((coalesce(c.c, 0) + 1.0) / (coalesce(t.t, 0) + 10.0)) AS loss FROM typed y LEFT JOIN cn c USING (src_type, dst_type, operation) LEFT JOIN tt t USING (src_type, dst_type) WHERE y.split = 'test')"


@query(win_sql(_SUR + " SELECT event_uuid, round(loss, 9) AS loss FROM su"))
def edge_surprise(fx):
    """Surprisal of test edges under counts of training edges."""
    return fx.surprisals.select("event_uuid", F.round("loss", 9).alias("loss"))


@query()
def edge_classifier(fx):
    """Losses of a multinomial regression on end types."""
    f = F.concat(features.one_hot(F.col("src_type"), cdm.NODE_TYPES), features.one_hot(F.col("dst_type"), cdm.NODE_TYPES))
    e = fx.typed_edges.withColumn("features", f).select("event_uuid", "operation", "features", "split")
    model = scoring.fit_edge_classifier(e.where("split = 'train'"))
    return scoring.score_edges(model, e.where("split = 'test'")).select("event_uuid", F.round("loss", 6).alias("loss"))


@query(win_sql(", wt AS (SELECT r, f, ((r * 7 + f * 3) % 5 - 2) / 4.0 AS w FROM (SELECT unnest(range(10)) AS r), (SELECT unnest(range(6)) AS f)), te AS (SELECT event_uuid, operation, CASE src_type WHEN 'subject' THEN 0 WHEN 'file' THEN 1 ELSE 2 END AS s, CASE dst_type WHEN 'subject' THEN 3 WHEN 'file' THEN 4 ELSE 5 END AS d FROM typed WHERE split = 'test'), lg AS (SELECT t.event_uuid, t.operation, a.r, a.r / 10.0 + a.w + b.w AS z FROM te t JOIN wt a ON a.f = t.s JOIN wt b ON b.f = t.d AND b.r = a.r) SELECT event_uuid, round(ln(sum(exp(z))) - max(CASE WHEN r = CASE operation WHEN 'EVENT_OPEN' THEN 2 WHEN 'EVENT_READ' THEN 3 WHEN 'EVENT_SENDTO' THEN 7 WHEN 'EVENT_WRITE' THEN 8 END THEN z END), 9) AS loss FROM lg GROUP BY event_uuid"))
def given_classifier(fx):
    """Losses of a multinomial classifier with given coefficients on end types."""
    f = F.concat(features.one_hot(F.col("src_type"), cdm.NODE_TYPES), features.one_hot(F.col("dst_type"), cdm.NODE_TYPES))
    e = fx.typed_edges.where("split = 'test'").withColumn("features", f).select("event_uuid", "operation", "features")
    given = {name: (r / 10, [((r * 7 + i * 3) % 5 - 2) / 4 for i in range(6)]) for r, name in enumerate(cdm.RELATIONS)}
    return scoring.score_edges_with(given, e).select("event_uuid", F.round("loss", 9).alias("loss"))


@query(win_sql("SELECT event_uuid, round(loss * 2 + 1, 9) AS loss FROM typed WHERE split = 'test'"))
def user_model(fx):
    """Losses by a function of the caller."""
    e = fx.typed_edges.where("split = 'test'").select("event_uuid", F.col("loss").alias("x"))
    return scoring.score_with(lambda pdf: pdf["x"] * 2 + 1, e).select("event_uuid", F.round("loss", 9).alias("loss"))


@query(win_sql("SELECT s.msg AS srcmsg, d.msg AS dstmsg, l.edge_type, count(*) AS n, round(sum(l.loss), 6) AS total FROM ls l JOIN nodes s ON l.srcnode = s.index_id JOIN nodes d ON l.dstnode = d.index_id WHERE l.split = 'test' GROUP BY ALL"))
def described_losses(fx):
    """Losses by the messages of both ends."""
    d = scoring.describe_losses(fx.losses("test"), fx.nodes.select("index_id", "msg"))
    return d.groupBy("srcmsg", "dstmsg", "edge_type").agg(F.count("*").alias("n"), F.round(F.sum("loss"), 6).alias("total"))


@query(win_sql("SELECT CAST(tw AS INTEGER) AS tw, (SELECT count(DISTINCT i) FROM (SELECT tw, srcnode AS i FROM ls WHERE split = 'test' UNION ALL SELECT tw, dstnode FROM ls WHERE split = 'test') q WHERE q.tw = l.tw) AS n_nodes, count(*) AS n_edges, round(avg(loss), 9) AS mean_loss, min(time) AS first, max(time) AS last FROM ls l WHERE split = 'test' GROUP BY tw"))
def window_losses(fx):
    """Nodes, edges, mean loss and span of every window."""
    s = scoring.loss_summary(fx.losses("test"))
    return s.withColumn("tw", F.col("tw").cast("int")).withColumn("mean_loss", F.round("mean_loss", 9))


# -- detection --------------------------------------------------------------


@query(win_sql("SELECT round(max(loss), 9) AS max_val_loss, round(avg(loss), 9) AS mean_val_loss, round(quantile_cont(loss, 0.5), 9) AS p50, round(quantile_cont(loss, 0.75), 9) AS p75, round(quantile_cont(loss, 0.9), 9) AS p90, round(var_pop(loss), 9) AS var, round(stddev_pop(loss), 9) AS std FROM ls WHERE split = 'val'"))
def validation_thresholds(fx):
    """Statistics of the validation losses."""
    s = detect.loss_thresholds(fx.losses("val"))
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


def _node_results(fx) -> DataFrame:
    return detect.node_scores(detect.node_losses(fx.losses("test")))


@query(win_sql("SELECT node, round(score, 9) AS score, tw_with_max_loss FROM scored"))
def node_max_scores(fx):
    """Largest loss of each node, and the first window that has it."""
    return _node_results(fx).withColumn("score", F.round("score", 9))


@query(win_sql("SELECT node, round(avg(loss), 9) AS score FROM byn GROUP BY node"))
def node_mean_scores(fx):
    return detect.node_scores(detect.node_losses(fx.losses("test")), "mean_val_loss").select("node", F.round("score", 9).alias("score"))


@query(win_sql("SELECT s.node, CASE WHEN s.score > (SELECT avg(loss) FROM ls WHERE split = 'val') THEN 1 ELSE 0 END AS y_hat, CASE WHEN t.node IS NULL THEN 0 ELSE 1 END AS y_true FROM scored s LEFT JOIN truth t ON s.node = t.node"))
def threshold_alerts(fx):
    """Alerts above the mean validation loss, beside the truth."""
    limit = detect.threshold(detect.loss_thresholds(fx.losses("val")), "mean_val_loss")
    return detect.label_truth(detect.label_by_threshold(_node_results(fx), limit), fx.truth).select("node", "y_hat", "y_true")


_KM = ", best AS (SELECT node, score FROM {0} ORDER BY score DESC, node DESC LIMIT 20), nu AS (SELECT node, score, row_number() OVER w AS i, sum(score) OVER w AS s1, sum(score * score) OVER w AS q1, count(*) OVER () AS n, sum(score) OVER () AS st, sum(score * score) OVER () AS qt FROM best WINDOW w AS (ORDER BY score, node ROWS UNBOUNDED PRECEDING)), er AS (SELECT *, round((q1 - s1 * s1 / i) + (qt - q1 - (st - s1) * (st - s1) / (n - i)), 9) AS err FROM nu WHERE i < n), ct AS (SELECT i FROM er ORDER BY err, i LIMIT 1), al AS (SELECT node FROM nu WHERE i > coalesce((SELECT i FROM ct), 0))"


@query(f"WITH {_DOCS}" + _KM.format("sc") + " SELECT s.node, s.score, CASE WHEN a.node IS NULL THEN 0 ELSE 1 END AS y_hat FROM sc s LEFT JOIN al a ON s.node = a.node")
def kmeans_alerts(fx):
    """Of the twenty best scores the higher of two clusters."""
    return detect.label_by_kmeans(fx.doc_scores.drop("y_hat")).select("node", "score", "y_hat")


@query(win_sql(_SUR + ", bn AS (SELECT src AS node, loss FROM su UNION ALL SELECT dst, loss FROM su), fs AS (SELECT node, round(max(loss), 9) AS score FROM bn GROUP BY node)" + _KM.format("fs") + " SELECT a.node, n.msg, f.score FROM al a JOIN nodes n ON a.node = n.index_id JOIN fs f ON f.node = a.node"))
def flagship_alerts(fx):
    """Events to windows to fused edges to surprisal to node scores to alerts."""
    e = fx.surprisals.select(F.col("src").alias("srcnode"), F.col("dst").alias("dstnode"), "loss", "tw")
    scores = detect.node_scores(detect.node_losses(e)).withColumn("score", F.round("score", 9))
    alerts = detect.label_by_kmeans(scores).where("y_hat = 1")
    return alerts.join(fx.nodes.select(F.col("index_id").alias("node"), "msg"), "node").select("node", "msg", "score")


_CONF = "tp AS (SELECT CAST(sum(CASE WHEN y_true = 1 AND y_hat = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN y_true = 0 AND y_hat = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN y_true = 0 AND y_hat = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN y_true = 1 AND y_hat = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM sc)"


@query(f"WITH {_DOCS}, {_CONF} SELECT tp, fp, tn, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc, round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy, round((tp * tn) / (fp * fn), 9) AS dor FROM tp")
def confusion_metrics(fx):
    """Confusion counts and measures."""
    m = detect.classification_metrics(fx.doc_scores)
    return m.select("tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "mcc", "accuracy", "dor")])


@query(f"WITH {_DOCS}, st AS (SELECT *, coalesce(lag(tp) OVER (ORDER BY score DESC), 0) AS t0, coalesce(lag(fp) OVER (ORDER BY score DESC), 0) AS f0 FROM cv) SELECT round(sum((fp - f0) * (tp + t0) / 2.0) / (max(p) * max(n)), 9) AS auc, round(sum((tp - t0) * tp / (tp + fp)) / max(p), 9) AS ap FROM st")
def ranking_quality(fx):
    """ROC-AUC and average precision."""
    return detect.ranking_metrics(fx.doc_scores).select(F.round("auc", 9).alias("auc"), F.round("ap", 9).alias("ap"))


@query(f"WITH {_DOCS} SELECT round(score, 9) AS score, round(tp / (tp + fp), 9) AS precision, round(tp / p, 9) AS recall FROM cv")
def precision_recall(fx):
    c = detect.pr_curve(fx.doc_scores)
    return c.select(F.round("score", 9).alias("score"), F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(f"WITH {_DOCS} SELECT score AS threshold, round(tp / p, 9) AS tpr, round(fp / n, 9) AS fpr FROM cv WHERE tp / p >= 0.16 ORDER BY fp / n, score DESC LIMIT 1")
def supervised_threshold(fx):
    b = detect.best_threshold(fx.doc_scores)
    return b.select("threshold", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query(f"WITH {_DOCS}, bd AS (SELECT min(score) AS lo, max(score) AS hi, sum(y_true) AS p, sum(1 - y_true) AS n FROM sc), ti AS (SELECT i, CASE WHEN i = 299 THEN hi ELSE lo + i * ((hi - lo) / 299) END AS threshold, p, n FROM bd, (SELECT unnest(range(0, 300)) AS i)), ab AS (SELECT i, threshold, max(t.p) AS p, max(t.n) AS n, sum(y_true) AS tp, sum(1 - y_true) AS fp FROM ti t JOIN sc ON sc.score >= t.threshold GROUP BY i, threshold) SELECT round(threshold, 9) AS threshold, CASE WHEN fp * (p - tp) <> 0 THEN round(tp * (n - fp) / (fp * (p - tp)), 6) END AS dor, round(tp / p, 9) AS recall FROM ab")
def odds_curve(fx):
    """Diagnostic odds ratio and recall over 300 thresholds."""
    c = detect.dor_curve(fx.doc_scores)
    return c.select(F.round("threshold", 9).alias("threshold"), F.round("dor", 6).alias("dor"), F.round("recall", 9).alias("recall"))


@query(f"WITH {_DOCS} SELECT * FROM (SELECT node, score, y_true, CAST(row_number() OVER (PARTITION BY y_true ORDER BY score DESC, node) AS INTEGER) AS place FROM sc) WHERE place <= 10")
def best_nodes(fx):
    """Ten best nodes of either label."""
    return detect.top_nodes(fx.doc_scores).select("node", "score", "y_true", "place")


@query(f"WITH {_DOCS} SELECT round(avg(CASE WHEN tw_with_max_loss IN (1, 3) THEN 1.0 ELSE 0.0 END), 9) AS ratio FROM sc WHERE y_true = 0 AND y_hat = 1")
def false_positive_windows(fx):
    """Share of false positives that peak in a malicious window."""
    bad = fx.doc_scores.where("tw_with_max_loss in (1, 3)").select(F.col("tw_with_max_loss").alias("tw")).distinct()
    return detect.fp_window_ratio(fx.doc_scores, bad).select(F.round("ratio", 9).alias("ratio"))


@query(f"WITH {_DOCS}, ep AS (SELECT CAST(node % 5 AS INTEGER) AS e, * FROM sc), c AS (SELECT e, sum(CASE WHEN y_true = 1 AND y_hat = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y_true = 0 AND y_hat = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y_true = 0 AND y_hat = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN y_true = 1 AND y_hat = 0 THEN 1 ELSE 0 END) AS fn FROM ep GROUP BY e), m AS (SELECT e, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0 ELSE (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc FROM c) SELECT e AS model_epoch, round(mcc, 9) AS mcc FROM m ORDER BY round(mcc, 9) DESC, e LIMIT 1")
def best_model_epoch(fx):
    """First epoch with the highest correlation."""
    stats = detect.classification_metrics(fx.doc_scores.withColumn("model_epoch", (F.col("node") % 5).cast("int")), ["model_epoch"])
    return detect.best_epoch(stats.select("model_epoch", F.round("mcc", 9).alias("mcc")))


#: The labelled documents under five epochs of a model; an epoch's scores are the documents' by their place in it.
_EPOCHS = """
ex AS (SELECT CAST(e AS INTEGER) AS model_epoch, node, score / (1 + (node * (e + 1)) % 5) AS score, y_true, tw_with_max_loss FROM sc, (SELECT unnest(range(5)) AS e)),
el AS (SELECT model_epoch, avg(score) AS threshold FROM ex GROUP BY model_epoch),
eh AS (SELECT x.*, CASE WHEN x.score > l.threshold THEN 1 ELSE 0 END AS y_hat FROM ex x JOIN el l USING (model_epoch)),
eg AS (SELECT model_epoch, score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM ex GROUP BY ALL),
ec AS (
  SELECT model_epoch, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model_epoch) AS p, sum(neg) OVER (PARTITION BY model_epoch) AS n
  FROM eg WINDOW w AS (PARTITION BY model_epoch ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


def _epoch_results(fx: Fixture) -> DataFrame:
    e = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("model_epoch")
    d = fx.doc_scores.select("*", e)
    return d.withColumn("score", F.col("score") / (1 + F.col("node") * (F.col("model_epoch") + 1) % 5)).drop("y_hat")


def _epoch_limits(results: DataFrame) -> DataFrame:
    return results.groupBy("model_epoch").agg(F.avg("score").alias("threshold"))


@query(f"WITH {_DOCS}, {_EPOCHS}, cc AS (SELECT model_epoch, sum(CASE WHEN y_true = 1 AND y_hat = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y_true = 0 AND y_hat = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y_true = 0 AND y_hat = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN y_true = 1 AND y_hat = 0 THEN 1 ELSE 0 END) AS fn FROM eh GROUP BY model_epoch), rk AS (SELECT model_epoch, sum(neg * (2 * tp - pos) / 2.0) / (max(p) * max(n)) AS auc, sum(pos * tp / (tp + fp)) / max(p) AS ap FROM ec GROUP BY model_epoch) SELECT model_epoch, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc, round(auc, 9) AS auc, round(ap, 9) AS ap FROM cc JOIN rk USING (model_epoch)")
def epoch_evaluation(fx):
    """Counts and measures of five epochs, each with a threshold of its own, in one pass."""
    r = _epoch_results(fx)
    m = detect.evaluate_epochs(r, _epoch_limits(r))
    return m.select("model_epoch", "tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("mcc", "auc", "ap")])


@query(f"WITH {_DOCS}, {_EPOCHS} SELECT model_epoch, round(score, 9) AS score, round(tp / (tp + fp), 9) AS precision, round(tp / p, 9) AS recall FROM ec")
def epoch_precision_recall(fx):
    """Precision and recall at every score of five epochs."""
    c = detect.pr_curve(_epoch_results(fx), ["model_epoch"])
    return c.select("model_epoch", *[F.round(x, 9).alias(x) for x in ("score", "precision", "recall")])


@query(f"WITH {_DOCS}, {_EPOCHS} SELECT model_epoch, threshold, tpr, fpr FROM (SELECT model_epoch, round(score, 9) AS threshold, round(tp / p, 9) AS tpr, round(fp / n, 9) AS fpr, row_number() OVER (PARTITION BY model_epoch ORDER BY fp / n, score DESC) AS r FROM ec WHERE tp / p >= 0.16) WHERE r = 1")
def epoch_thresholds(fx):
    """Best threshold of each epoch."""
    b = detect.best_threshold(_epoch_results(fx), by=["model_epoch"])
    return b.select("model_epoch", *[F.round(c, 9).alias(c) for c in ("threshold", "tpr", "fpr")])


@query(f"WITH {_DOCS}, {_EPOCHS}, bd AS (SELECT model_epoch, min(score) AS lo, max(score) AS hi, sum(y_true) AS p, sum(1 - y_true) AS n FROM ex GROUP BY model_epoch), ti AS (SELECT model_epoch, i, CASE WHEN i = 39 THEN hi ELSE lo + i * ((hi - lo) / 39) END AS threshold, p, n FROM bd, (SELECT unnest(range(0, 40)) AS i)), ab AS (SELECT t.model_epoch, i, threshold, max(t.p) AS p, max(t.n) AS n, sum(y_true) AS tp, sum(1 - y_true) AS fp FROM ti t JOIN ex x ON x.model_epoch = t.model_epoch AND x.score >= t.threshold GROUP BY ALL) SELECT model_epoch, round(threshold, 9) AS threshold, CASE WHEN fp * (p - tp) <> 0 THEN round(tp * (n - fp) / (fp * (p - tp)), 6) END AS dor, round(tp / p, 9) AS recall FROM ab")
def epoch_odds_curves(fx):
    """Odds ratio and recall over 40 thresholds of each epoch."""
    c = detect.dor_curve(_epoch_results(fx), 40, ["model_epoch"])
    return c.select("model_epoch", F.round("threshold", 9).alias("threshold"), F.round("dor", 6).alias("dor"), F.round("recall", 9).alias("recall"))


@query(f"WITH {_DOCS}, {_EPOCHS}, best AS (SELECT * FROM (SELECT model_epoch, node, score, row_number() OVER (PARTITION BY model_epoch ORDER BY score DESC, node DESC) AS r FROM ex) WHERE r <= 20), nu AS (SELECT model_epoch, node, row_number() OVER w AS i, sum(score) OVER w AS s1, sum(score * score) OVER w AS q1, count(*) OVER a AS n, sum(score) OVER a AS st, sum(score * score) OVER a AS qt FROM best WINDOW w AS (PARTITION BY model_epoch ORDER BY score, node ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY model_epoch)), er AS (SELECT *, round((q1 - s1 * s1 / i) + (qt - q1 - (st - s1) * (st - s1) / (n - i)), 9) AS err FROM nu WHERE i < n), ct AS (SELECT model_epoch, i FROM (SELECT *, row_number() OVER (PARTITION BY model_epoch ORDER BY err, i) AS r FROM er) WHERE r = 1) SELECT n.model_epoch, n.node FROM nu n JOIN ct c ON n.model_epoch = c.model_epoch AND n.i > c.i")
def epoch_kmeans_alerts(fx):
    """Of the twenty best scores of each epoch the higher of two clusters."""
    return detect.label_by_kmeans(_epoch_results(fx), by=["model_epoch"]).where("y_hat = 1").select("model_epoch", "node")


@query(f"WITH {_DOCS}, {_EPOCHS}, tn AS (SELECT model_epoch, node, y_true, CAST(row_number() OVER (PARTITION BY model_epoch, y_true ORDER BY score DESC, node) AS INTEGER) AS place FROM ex) SELECT model_epoch, node, y_true, place FROM tn WHERE place <= 3")
def epoch_best_nodes(fx):
    """Three best nodes of either label of each epoch."""
    return detect.top_nodes(_epoch_results(fx), 3, ["model_epoch"]).select("model_epoch", "node", "y_true", "place")


@query(f"WITH {_DOCS}, {_EPOCHS} SELECT model_epoch, round(avg(CASE WHEN tw_with_max_loss IN (1, 3) THEN 1.0 ELSE 0.0 END), 9) AS ratio FROM eh WHERE y_true = 0 AND y_hat = 1 GROUP BY model_epoch")
def epoch_false_positive_windows(fx):
    """Share of each epoch's false positives that peak in a malicious window."""
    r = _epoch_results(fx)
    bad = r.where("tw_with_max_loss in (1, 3)").select(F.col("tw_with_max_loss").alias("tw")).distinct()
    ratio = detect.fp_window_ratio(detect.label_by_threshold(r, _epoch_limits(r), ["model_epoch"]), bad, ["model_epoch"])
    return ratio.select("model_epoch", F.round("ratio", 9).alias("ratio"))


# -- labels -----------------------------------------------------------------

_AT = ", att AS (SELECT * FROM (VALUES ('a1', 1706076000 * 1000000000::BIGINT, 1706207400 * 1000000000::BIGINT), ('a2', 1706313600 * 1000000000::BIGINT, 1706399999 * 1000000000::BIGINT)) v(attack, s, e))"
_MAL = _AT + ", md AS (SELECT a.attack, d.timestamp_rec AS time, d.src, d.dst FROM ed d JOIN att a ON d.timestamp_rec BETWEEN a.s AND a.e), mal AS (SELECT m.attack, m.time, t.node FROM md m JOIN truth t ON t.attack = m.attack AND t.node = m.src UNION ALL SELECT m.attack, m.time, t.node FROM md m JOIN truth t ON t.attack = m.attack AND t.node = m.dst), bo AS (SELECT tw, min(time) AS s, max(time) AS e FROM fused GROUP BY tw)"


@query(win_sql("SELECT attack, node, node_uuid, node_label FROM truth"))
def ground_truth_nodes(fx):
    """Ground truth resolved to node ids."""
    return labels.resolve_ground_truth(fx.truth.select("attack", "node_uuid", "node_label", "node_id"), fx.nodes)[0]


@query(win_sql("SELECT attack, list_sort(list(node)) AS nodes FROM truth GROUP BY attack"))
def nodes_of_attacks(fx):
    return labels.attack_nodes(fx.truth)


def _attacks(fx):
    return labels.attack_windows_ns(fx.attacks, "UTC")


@query(win_sql(_AT + " SELECT a.attack, count(*) AS n FROM ed d JOIN att a ON d.timestamp_rec BETWEEN a.s AND a.e GROUP BY a.attack"))
def attack_events(fx):
    """Events inside the attacks' intervals."""
    return labels.events_in_attacks(fx.events, _attacks(fx)).groupBy("attack").agg(F.count("*").alias("n"))


@query(win_sql(_MAL + " SELECT attack, time, node FROM mal"))
def malicious_events(fx):
    """Times and nodes that are malicious."""
    return labels.malicious_times(fx.events, _attacks(fx), fx.truth)


@query(win_sql(_MAL + " SELECT CAST(b.tw AS INTEGER) AS tw, m.node, count(*) AS n FROM mal m JOIN bo b ON b.s < m.time AND m.time < b.e GROUP BY ALL"))
def malicious_windows(fx):
    """Malicious times inside each window, by node."""
    mal = labels.malicious_times(fx.events, _attacks(fx), fx.truth)
    return labels.window_labels(mal, graphs.window_bounds(fx.edges)).withColumn("tw", F.col("tw").cast("int"))


@query(win_sql(_MAL + ", de AS (SELECT tw, min(tw_start) AS s, min(tw_end) AS e FROM win GROUP BY tw) SELECT CAST(b.tw AS INTEGER) AS tw, m.node, count(*) AS n FROM mal m JOIN de b ON b.s < m.time AND m.time < b.e GROUP BY ALL"))
def declared_windows(fx):
    """The same with the bounds that the windows' names declare."""
    names = fx.windowed.groupBy("tw").agg(F.min("tw_start").alias("s"), F.min("tw_end").alias("e")).select("tw", graphs.window_name(F.col("s"), F.col("e")).alias("name"))
    mal = labels.malicious_times(fx.events, _attacks(fx), fx.truth)
    return labels.window_labels(mal, labels.declared_bounds(names)).withColumn("tw", F.col("tw").cast("int"))


@query(win_sql(_MAL + " SELECT (SELECT count(*) FROM (SELECT DISTINCT time FROM mal) t JOIN bo b ON b.s < t.time AND t.time < b.e) AS hits, (SELECT count(DISTINCT time) FROM mal) AS times"))
def window_coverage(fx):
    """Malicious times that a window holds, of all."""
    mal = labels.malicious_times(fx.events, _attacks(fx), fx.truth)
    return labels.label_coverage(mal, graphs.window_bounds(fx.edges))


# -- tracing ----------------------------------------------------------------


def _test_edges(fx) -> DataFrame:
    return fx.typed_edges.where("split = 'test'").select(F.col("tw").cast("int").alias("tw"), "src", "dst", "operation", "time", "event_uuid", "loss")


def _pois(fx) -> DataFrame:
    """The alerted end of each test window: the source of its greatest loss."""
    return _test_edges(fx).groupBy("tw").agg(F.max_by("src", F.struct("loss", "event_uuid")).alias("poi"))


_TE = ", te AS (SELECT CAST(tw AS INTEGER) AS tw, src, dst, operation, time, event_uuid, loss FROM typed WHERE split = 'test'), po AS (SELECT tw, src AS poi FROM (SELECT *, row_number() OVER (PARTITION BY tw ORDER BY loss DESC, event_uuid DESC) AS r FROM te) WHERE r = 1)"


@query(win_sql(_TE + ", tn AS (SELECT tw, src AS node FROM te UNION SELECT tw, dst FROM te) SELECT t.tw, s.node, round(s.score, 9) AS score FROM tn t JOIN scored s ON t.node = s.node"))
def results_in_windows(fx):
    """Node results in every window that holds the node."""
    e = _test_edges(fx)
    tw_nodes = e.select("tw", F.explode(F.array("src", "dst")).alias("index_id")).distinct()
    return trace.results_by_window(_node_results(fx), tw_nodes).select("tw", "node", F.round("score", 9).alias("score"))


@query(win_sql(_TE + ", al AS (SELECT node FROM scored ORDER BY score DESC, node DESC LIMIT 3), tn AS (SELECT tw, src AS node FROM te UNION SELECT tw, dst FROM te) SELECT t.tw, t.node AS poi FROM tn t JOIN al a ON t.node = a.node"))
def interest_points(fx):
    """Alerted nodes of every window."""
    e = _test_edges(fx)
    tw_nodes = e.select("tw", F.explode(F.array("src", "dst")).alias("index_id")).distinct()
    results = _node_results(fx).orderBy(F.desc("score"), F.desc("node")).limit(3).withColumn("y_hat", F.lit(1))
    return trace.points_of_interest(trace.results_by_window(results, tw_nodes))


@query(f"WITH {_TRADE}, o AS (SELECT tw, src AS node, count(*) AS c FROM tr GROUP BY ALL), i AS (SELECT tw, dst AS node, count(*) AS c FROM tr GROUP BY ALL) SELECT coalesce(o.tw, i.tw) AS tw, coalesce(o.node, i.node) AS node, round(CASE WHEN coalesce(i.c, 0) = 0 THEN 0.0 ELSE coalesce(o.c, 0) / i.c END, 9) AS score FROM o FULL JOIN i ON o.tw = i.tw AND o.node = i.node")
def degree_scores(fx):
    """Edges out over edges in, on the larger graph."""
    return trace.degree_score(fx.trade_edges).withColumn("score", F.round("score", 9))


_DS = ", oo AS (SELECT tw, src AS node, count(*) AS c FROM te GROUP BY ALL), ii AS (SELECT tw, dst AS node, count(*) AS c FROM te GROUP BY ALL), dg AS (SELECT coalesce(o.tw, i.tw) AS tw, coalesce(o.node, i.node) AS node, CASE WHEN coalesce(i.c, 0) = 0 THEN 0.0 ELSE coalesce(o.c, 0) / i.c END AS score FROM oo o FULL JOIN ii i ON o.tw = i.tw AND o.node = i.node)"


@query(win_sql(_TE + _DS + ", lo AS (SELECT d.tw, d.node, CAST(floor(s.score) AS DOUBLE) AS score FROM dg d JOIN scored s ON d.node = s.node), sa AS (SELECT tw, node, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.0 END AS a FROM dg WINDOW w AS (PARTITION BY tw)), sb AS (SELECT tw, node, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.0 END AS b FROM lo WINDOW w AS (PARTITION BY tw)) SELECT sa.tw, sa.node, round(a + b, 9) AS score FROM sa JOIN sb ON sa.tw = sb.tw AND sa.node = sb.node"))
def combined_scores(fx):
    """Scaled degree and loss scores, added."""
    e = _test_edges(fx)
    tw_nodes = e.select("tw", F.explode(F.array("src", "dst")).alias("index_id")).distinct()
    both = trace.combined_score(trace.degree_score(e), trace.loss_score(tw_nodes, _node_results(fx)))
    return both.withColumn("score", F.round("score", 9))


_VE = ", ve AS (SELECT tw, src, dst, time, event_uuid, row_number() OVER (PARTITION BY tw ORDER BY time, event_uuid) AS seq FROM te WHERE src <> dst), en AS (SELECT tw, seq, src AS node, 0 AS into_ FROM ve UNION ALL SELECT tw, seq, dst, 1 FROM ve), vn AS (SELECT *, sum(into_) OVER w - first(into_) OVER w AS v FROM en WINDOW w AS (PARTITION BY tw, node ORDER BY seq ROWS UNBOUNDED PRECEDING)), vx AS (SELECT e.tw, e.seq, e.src, CAST(s.v AS BIGINT) AS vsrc, e.dst, CAST(d.v AS BIGINT) AS vdst FROM ve e JOIN vn s ON s.tw = e.tw AND s.seq = e.seq AND s.into_ = 0 JOIN vn d ON d.tw = e.tw AND d.seq = e.seq AND d.into_ = 1)"


@query(win_sql(_TE + _VE + " SELECT tw, CAST(seq AS INTEGER) AS seq, src, vsrc, dst, vdst FROM vx"))
def versioned_edges(fx):
    """Edges between versions of nodes."""
    return trace.version_edges(_test_edges(fx)).withColumn("seq", F.col("seq").cast("int"))


_BACK = _VE + ", tops AS (SELECT tw, node, max(v) AS last FROM vn GROUP BY ALL), re AS (SELECT p.tw, p.poi, p.poi AS node, CAST(t.last AS BIGINT) AS v FROM po p JOIN tops t ON t.tw = p.tw AND t.node = p.poi UNION SELECT r.tw, r.poi, x.src, x.vsrc FROM re r JOIN vx x ON x.tw = r.tw AND x.dst = r.node AND x.vdst <= r.v)"


@query(win_sql(_TE + _BACK + " SELECT tw, poi, node, max(v) AS v FROM re GROUP BY ALL"))
def backward_reaches(fx):
    """What leads to the poi, by highest version."""
    return trace.backward_reach(trace.version_edges(_test_edges(fx)), _pois(fx))


@query(win_sql(_TE + _VE + ", re AS (SELECT DISTINCT p.tw, p.poi, p.poi AS node, CAST(0 AS BIGINT) AS v FROM po p JOIN vn t ON t.tw = p.tw AND t.node = p.poi UNION SELECT r.tw, r.poi, x.dst, x.vdst FROM re r JOIN vx x ON x.tw = r.tw AND x.src = r.node AND x.vsrc >= r.v) SELECT tw, poi, node, min(v) AS v FROM re GROUP BY ALL"))
def forward_reaches(fx):
    """What the poi leads to, by lowest version."""
    return trace.forward_reach(trace.version_edges(_test_edges(fx)), _pois(fx))


#: Both sides of tracing as one: side 1 is the mirrored graph, with edges turned round and versions below zero.
_TWO = _VE + """, fa AS (
  SELECT tw, node, CAST(max(v) AS BIGINT) AS last, arg_min(into_, seq) = 0 AS starts, coalesce(max(CASE WHEN into_ = 0 THEN v END), -1) < max(v) AS ends FROM vn GROUP BY ALL),
xe AS (SELECT 0 AS side, tw, src AS a, vsrc AS va, dst AS b, vdst AS vb FROM vx UNION ALL SELECT 1, tw, dst, -vdst, src, -vsrc FROM vx),
gs AS (
  SELECT 0 AS side, p.tw, p.poi, p.poi AS node, f.last AS v FROM po p JOIN fa f ON f.tw = p.tw AND f.node = p.poi WHERE NOT (f.last = 0 AND f.starts)
  UNION ALL SELECT 1, p.tw, p.poi, p.poi, CAST(0 AS BIGINT) FROM po p JOIN fa f ON f.tw = p.tw AND f.node = p.poi WHERE NOT (f.last = 0 AND f.ends)),
st AS (SELECT 0 AS side, tw, node, CAST(0 AS BIGINT) AS v FROM fa WHERE starts UNION ALL SELECT 1, tw, node, -last FROM fa WHERE ends)"""
_CHOSEN = """, mn AS (
  SELECT m.side, m.tw, m.poi, m.grp, coalesce(round(avg(CASE WHEN m.node <> m.poi THEN coalesce(d.score, 0.0) END), 12), 0.0) AS mean
  FROM mb m LEFT JOIN dg d ON d.tw = m.tw AND d.node = m.node GROUP BY ALL),
be AS (SELECT side, tw, poi, grp FROM (SELECT *, rank() OVER (PARTITION BY side, tw, poi ORDER BY mean DESC) AS r FROM mn) WHERE r = 1)
SELECT m.tw, m.poi, m.node FROM mb m JOIN be USING (side, tw, poi, grp) UNION SELECT tw, poi, poi FROM po"""
_SETS = """, rv AS (
  SELECT * FROM gs UNION SELECT r.side, r.tw, r.poi, x.a, x.va FROM rv r JOIN xe x ON x.side = r.side AND x.tw = r.tw AND x.b = r.node AND x.vb <= r.v),
rc AS (SELECT side, tw, poi, node, max(v) AS v FROM rv GROUP BY ALL),
inn AS (
  SELECT x.side, x.tw, s.poi, x.a, x.va, x.b, x.vb FROM xe x JOIN rc s ON s.side = x.side AND s.tw = x.tw AND s.node = x.a AND x.va <= s.v
  JOIN rc d ON d.side = x.side AND d.tw = x.tw AND d.poi = s.poi AND d.node = x.b AND x.vb <= d.v),
sp AS (
  SELECT r.side, r.tw, r.poi, r.node AS grp, r.node, s.v FROM rc r JOIN st s ON s.side = r.side AND s.tw = r.tw AND s.node = r.node
  UNION SELECT p.side, p.tw, p.poi, p.grp, x.b, x.vb FROM sp p JOIN inn x ON x.side = p.side AND x.tw = p.tw AND x.poi = p.poi AND x.a = p.node AND x.va >= p.v),
mb AS (SELECT DISTINCT side, tw, poi, grp, node FROM sp)"""
_PATHS = """, se AS (
  SELECT side, tw, a, va, b, vb, 0 AS stays FROM xe
  UNION ALL SELECT side, tw, node, CASE side WHEN 0 THEN k ELSE -k - 1 END, node, CASE side WHEN 0 THEN k + 1 ELSE -k END, 1
  FROM (SELECT tw, node, unnest(range(0, last)) AS k FROM fa), (VALUES (0), (1)) q(side)),
hp AS (
  SELECT *, 0 AS h FROM gs UNION SELECT p.side, p.tw, p.poi, x.a, x.va, p.h + 1 FROM hp p JOIN se x ON x.side = p.side AND x.tw = p.tw AND x.b = p.node AND x.vb = p.v),
di AS (SELECT side, tw, poi, node, v, min(h) AS h FROM hp GROUP BY ALL),
nx AS (
  SELECT * FROM (
    SELECT d.side, d.tw, d.poi, d.node, d.v, x.b, x.vb, row_number() OVER (PARTITION BY d.side, d.tw, d.poi, d.node, d.v ORDER BY x.stays, x.b, x.vb) AS r
    FROM di d JOIN se x ON x.side = d.side AND x.tw = d.tw AND x.a = d.node AND x.va = d.v
    JOIN di e ON e.side = d.side AND e.tw = d.tw AND e.poi = d.poi AND e.node = x.b AND e.v = x.vb AND e.h = d.h - 1)
  WHERE r = 1),
wk AS (
  SELECT d.side, d.tw, d.poi, d.node AS grp, d.node, d.v FROM di d JOIN st s ON s.side = d.side AND s.tw = d.tw AND s.node = d.node AND s.v = d.v
  UNION SELECT w.side, w.tw, w.poi, w.grp, n.b, n.vb FROM wk w JOIN nx n ON n.side = w.side AND n.tw = w.tw AND n.poi = w.poi AND n.node = w.node AND n.v = w.v),
mb AS (SELECT DISTINCT side, tw, poi, grp, node FROM wk)"""


@query(win_sql(_TE + _DS + _TWO + _SETS + _CHOSEN))
def component_traces(fx):
    """Nodes between the pois and their best entries and exits."""
    e = _test_edges(fx)
    return trace.trace_component(e, _pois(fx), trace.degree_score(e))


@query(win_sql(_TE + _DS + _TWO + _PATHS + _CHOSEN))
def path_traces(fx):
    """Nodes on one shortest path to the best entries and exits."""
    e = _test_edges(fx)
    return trace.trace_shortest_path(e, _pois(fx), trace.degree_score(e))


@query(win_sql(_TE + ", li AS (SELECT DISTINCT tw, src, dst FROM te UNION SELECT DISTINCT tw, dst, src FROM te), h1 AS (SELECT p.tw, p.poi, p.poi AS node FROM po p UNION SELECT p.tw, p.poi, l.dst FROM po p JOIN li l ON l.tw = p.tw AND l.src = p.poi), h2 AS (SELECT * FROM h1 UNION SELECT h.tw, h.poi, l.dst FROM h1 h JOIN li l ON l.tw = h.tw AND l.src = h.node) SELECT tw, poi, node FROM h2"))
def two_hops(fx):
    """Nodes within two edges of the poi."""
    return trace.n_hop(_test_edges(fx), _pois(fx), 2)


@query(win_sql(_TE + ", re AS (SELECT tw, poi, poi AS node, 9223372036854775807 AS t FROM po UNION SELECT r.tw, r.poi, e.src, e.time FROM re r JOIN te e ON e.tw = r.tw AND e.dst = r.node AND e.time < r.t) SELECT tw, poi, node, max(t) AS time FROM re GROUP BY ALL"))
def temporal_back(fx):
    """Time-respecting backward trace."""
    return trace.temporal_backward(_test_edges(fx), _pois(fx))


@query(win_sql(_TE + ", re AS (SELECT tw, poi, poi AS node, (-9223372036854775807 - 1)::BIGINT AS t FROM po UNION SELECT r.tw, r.poi, e.dst, e.time FROM re r JOIN te e ON e.tw = r.tw AND e.src = r.node AND e.time > r.t) SELECT tw, poi, node, min(t) AS time FROM re GROUP BY ALL"))
def temporal_ahead(fx):
    """Time-respecting forward trace."""
    return trace.temporal_forward(_test_edges(fx), _pois(fx))


_H1 = ", li AS (SELECT DISTINCT tw, src, dst FROM te UNION SELECT DISTINCT tw, dst, src FROM te), h1 AS (SELECT p.tw, p.poi, p.poi AS node FROM po p UNION SELECT p.tw, p.poi, l.dst FROM po p JOIN li l ON l.tw = p.tw AND l.src = p.poi)"


@query(win_sql(_TE + _H1 + " SELECT h.tw, h.poi, CASE WHEN max(CASE WHEN h.node = h.poi AND t.node IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN 'TP' ELSE 'FP' END AS tp_or_fp, count(t.node) AS tps, count(*) - count(t.node) AS fps FROM h1 h LEFT JOIN truth t ON t.node = h.node GROUP BY h.tw, h.poi"))
def trace_reports(fx):
    """True and false positives of each poi's trace (here its neighbours)."""
    return trace.trace_report(trace.n_hop(_test_edges(fx), _pois(fx), 1), fx.truth)


@query(win_sql(_TE + _H1 + " SELECT DISTINCT e.tw, e.src, e.dst, e.operation, e.event_uuid FROM te e JOIN h1 a ON a.tw = e.tw AND a.node = e.src JOIN h1 b ON b.tw = e.tw AND b.node = e.dst"))
def alert_graphs(fx):
    """Edges among the neighbours of the pois."""
    return trace.alert_subgraph(_test_edges(fx), _pois(fx), 1).select("tw", "src", "dst", "operation", "event_uuid")


@query(win_sql(_TE + _H1 + ", tn AS (SELECT tw, src AS node FROM te UNION SELECT tw, dst FROM te), rs AS (SELECT t.tw, s.node, s.score, CASE WHEN g.node IS NULL THEN 0 ELSE 1 END AS y_true FROM tn t JOIN scored s ON s.node = t.node LEFT JOIN truth g ON g.node = s.node) SELECT r.node, round(greatest(max(r.score), 0.0), 9) AS score, max(r.y_true) AS y_true, max(CASE WHEN h.node IS NULL THEN 0 ELSE 1 END) AS y_hat FROM rs r LEFT JOIN (SELECT DISTINCT tw, node FROM h1) h ON h.tw = r.tw AND h.node = r.node GROUP BY r.node"))
def metrics_after_tracing(fx):
    """Node results after tracing."""
    e = _test_edges(fx)
    tw_nodes = e.select("tw", F.explode(F.array("src", "dst")).alias("index_id")).distinct()
    rows = trace.results_by_window(detect.label_truth(_node_results(fx), fx.truth), tw_nodes)
    return trace.results_after_trace(rows, trace.n_hop(e, _pois(fx), 1)).withColumn("score", F.round("score", 9))


@query(win_sql(_TE + _H1 + ", tn AS (SELECT tw, src AS node FROM te UNION SELECT tw, dst FROM te) SELECT t.tw, s.node, round(s.score, 9) AS score, CASE WHEN g.node IS NULL THEN 0 ELSE 1 END AS y_true, CASE WHEN h.node IS NULL THEN 0 ELSE 1 END AS y_hat FROM tn t JOIN scored s ON s.node = t.node LEFT JOIN truth g ON g.node = s.node LEFT JOIN (SELECT DISTINCT tw, node FROM h1) h ON h.tw = t.tw AND h.node = t.node"))
def window_results_after_tracing(fx):
    """Results after tracing, window by window."""
    e = _test_edges(fx)
    tw_nodes = e.select("tw", F.explode(F.array("src", "dst")).alias("index_id")).distinct()
    rows = trace.results_by_window(detect.label_truth(_node_results(fx), fx.truth), tw_nodes)
    return trace.results_after_trace(rows, trace.n_hop(e, _pois(fx), 1), "window").withColumn("score", F.round("score", 9))


@query(win_sql(_TE + _H1 + " SELECT DISTINCT node FROM h1"))
def all_traced_nodes(fx):
    """Nodes of any trace (here neighbours of the pois)."""
    return trace.traced_nodes(trace.n_hop(_test_edges(fx), _pois(fx), 1), by_window=False)


@query(win_sql(_TE + _H1 + " SELECT h.tw, h.poi, CASE WHEN max(CASE WHEN h.node = h.poi AND t.node IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN 'TP' ELSE 'FP' END AS tp_or_fp, count(t.node) AS tps, count(*) - count(t.node) AS fps FROM h1 h LEFT JOIN truth t ON t.node = h.node GROUP BY h.tw, h.poi"))
def stored_trace_report(fx):
    """The trace report written as CSV and read back."""
    path = _folder(fx, "report")
    tables.write_trace_report(trace.trace_report(trace.n_hop(_test_edges(fx), _pois(fx), 1), fx.truth), path)
    return fx.spark.read.csv(path, header=True, schema="tw int, poi long, tp_or_fp string, tps long, fps long")


@query(win_sql(_TE + " SELECT s.msg AS src_path, d.msg AS dst_path, e.operation, round(max(e.loss), 9) AS score, min(e.time) AS first, max(e.time) AS last, count(*) AS n_edges FROM te e JOIN nodes s ON e.src = s.index_id JOIN nodes d ON e.dst = d.index_id GROUP BY ALL"))
def contracted_graph(fx):
    """Nodes of one name and type as one."""
    n = fx.nodes.select(F.col("index_id").alias("node"), F.col("msg").alias("path"), "node_type", F.lit(0).alias("y_true"), F.lit(0.0).alias("score"))
    _, e = trace.contract_graph(_test_edges(fx).withColumnRenamed("loss", "score"), n)
    return e.select("src_path", "dst_path", "operation", F.round("score", 9).alias("score"), "first", "last", "n_edges")


@query(win_sql("SELECT n.msg AS path, n.node_type, max(CASE WHEN t.node IS NULL THEN 0 ELSE 1 END) AS y_true, round(greatest(coalesce(max(s.score), 0.0), 0.0), 9) AS score FROM (SELECT *, CASE node_type WHEN 'file' THEN '/data' ELSE msg END AS m FROM nodes) n LEFT JOIN truth t ON t.node = n.index_id LEFT JOIN scored s ON s.node = n.index_id GROUP BY ALL").replace("n.msg AS path", "n.m AS path"))
def contracted_nodes(fx):
    """The nodes that nodes of one name and type become, here all files one; with the worst label and the best score."""
    n = fx.nodes.select(F.col("index_id").alias("node"), F.when(F.col("node_type") == "file", "/data").otherwise(F.col("msg")).alias("path"), "node_type")
    n = detect.label_truth(n, fx.truth).join(_node_results(fx).select("node", "score"), "node", "left")
    merged, _ = trace.contract_graph(_test_edges(fx).withColumnRenamed("loss", "score"), n)
    return merged.select("path", "node_type", "y_true", F.round("score", 9).alias("score"))


# -- at a larger size -------------------------------------------------------


@query(f"WITH {_TRADE}, b AS (SELECT src AS node, loss, tw FROM tr UNION ALL SELECT dst, loss, tw FROM tr) SELECT node, round(max(loss), 9) AS score, round(avg(loss), 9) AS mean FROM b GROUP BY node")
def trade_node_scores(fx):
    """Node scores of the larger graph."""
    e = detect.node_losses(fx.trade_edges.select(F.col("src").alias("srcnode"), F.col("dst").alias("dstnode"), "loss", "tw"))
    return e.groupBy("node").agg(F.round(F.max("loss"), 9).alias("score"), F.round(F.avg("loss"), 9).alias("mean"))


@query(f"WITH {_TRADE} SELECT tw, src, dst, operation, time, event_uuid FROM (SELECT *, lag(operation) OVER (PARTITION BY tw, src, dst ORDER BY time, event_uuid) AS b FROM tr) WHERE b IS NULL OR b <> operation")
def trade_fused_edges(fx):
    """Run collapse on the larger graph."""
    e = fx.trade_edges.select("tw", F.col("src").alias("src_index_id"), F.col("dst").alias("dst_index_id"), "operation", F.col("time").alias("timestamp_rec"), "event_uuid", F.lit(0).alias("_id"), F.lit(0).alias("day"))
    return graphs.fuse_edges(e).drop("day")


assert fixtures.BATCH == 16  # the SQL above says so
