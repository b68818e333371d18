"""Raw audit records (JSON lines) to node and event tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import node_hash
from ..operators.order import dense_index
from ..operators.store import cut

PREFIX = "com.bbn.tc.schema.avro.cdm"

#: The relations of the graphs, by id from 1 on.
RELATIONS = (
    "EVENT_CONNECT", "EVENT_EXECUTE", "EVENT_OPEN", "EVENT_READ", "EVENT_RECVFROM",
    "EVENT_RECVMSG", "EVENT_SENDMSG", "EVENT_SENDTO", "EVENT_WRITE", "EVENT_CLONE",
)
#: Relations in which data flows from the object to the subject.
REVERSED = (
    "EVENT_EXECUTE", "EVENT_LSEEK", "EVENT_MMAP", "EVENT_OPEN", "EVENT_ACCEPT",
    "EVENT_READ", "EVENT_RECVFROM", "EVENT_RECVMSG", "EVENT_READ_SOCKET_PARAMS", "EVENT_CHECK_FILE_ATTRIBUTES",
)
#: Relations that are never events.
EXCLUDED = ("EVENT_FCNTL", "EVENT_OTHER", "EVENT_ADD_OBJECT_ATTRIBUTE", "EVENT_FLOWS_TO")
#: Node types, by id from 1 on.
NODE_TYPES = ("subject", "file", "netflow")


@dataclass(frozen=True)
class Profile:
    """How one kind of recorder writes its logs."""

    name: str
    version: int = 18
    remote_required: bool = True  # netflows need all four endpoints
    sockets: bool = True  # unix sockets become netflows
    subjects_from_events: bool = True  # command from the events' exec
    files_from_events: bool = True  # path from the events' object path
    unknown_is_null: bool = True
    subject_path: bool = False
    subject_path_required: bool = False
    file_field: str = "path"
    allow_list: bool = False  # the ten relations only; else all but the excluded

    @property
    def wrapped(self) -> bool:
        return self.version == 20


PROFILES = {
    p.name: p
    for p in (
        Profile("cadets_e3"),
        Profile("cadets_e5", version=20, unknown_is_null=False),
        Profile("theia_e3", 18, False, False, False, False, False, True, False, "filename", True),
        Profile("theia_e5", 20, False, False, False, False, False, True, True, "path", True),
        Profile("clearscope_e3", 18, False, False, False, False, False, False, False, "path", True),
        Profile("clearscope_e5", 20, False, False, False, False, False, False, False, "path", True),
    )
}


def read_cdm(spark: SparkSession, path: str, glob: str = "*json*") -> DataFrame:
    """(value, file, line_id) of all JSON lines under the path; line ids rise within a file."""
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_id"))


def cdm_kind(value: Column) -> Column:
    """The record's kind, as Subject or Event."""
    key = F.get(F.json_object_keys(F.get_json_object(value, "$.datum")), F.lit(0))
    return F.element_at(F.split(key, r"\."), -1)


def record_schema(profile: Profile) -> T.StructType:
    """What a profile's records are parsed under: the fields that are read, and no others."""

    def struct(**fields: T.DataType) -> T.StructType:
        return T.StructType([T.StructField(k, v) for k, v in fields.items()])

    text = T.StringType()
    prefix = f"{PREFIX}{profile.version}."
    uuid = T.StructType([T.StructField(f"{prefix}UUID", text)])
    address, port = (struct(string=text), struct(int=text)) if profile.wrapped else (text, text)
    kinds = {
        "Subject": struct(uuid=text, cmdLine=struct(string=text), properties=struct(map=struct(path=text))),
        "FileObject": struct(uuid=text, type=text, baseObject=struct(properties=struct(map=struct(**{profile.file_field: text})))),
        "NetFlowObject": struct(uuid=text, localAddress=address, localPort=port, remoteAddress=address, remotePort=port),
        "Event": struct(uuid=text, type=text, subject=uuid, predicateObject=uuid, predicateObjectPath=struct(string=text), properties=struct(map=struct(exec=text)), timestampNanos=text),
    }
    return struct(datum=T.StructType([T.StructField(prefix + k, v) for k, v in kinds.items()]))


def parse_records(raw: DataFrame, profile: Profile) -> DataFrame:
    """All records in one narrow table: kind, uuid and the fields that any kind has; each line is parsed once.

    Lines that aren't JSON, and records of other kinds, have no kind and no fields.
    """
    prefix = f"{PREFIX}{profile.version}."
    parsed = raw.select("file", "line_id", F.from_json("value", record_schema(profile)).alias("j"), F.contains("value", F.lit("<unknown>")).alias("has_unknown"))

    def at(kind: str, *path: str) -> Column:
        out = F.col("j").getField("datum").getField(prefix + kind)
        for name in path:
            out = out.getField(name)
        return out

    def end(name: str, wrap: str) -> Column:
        return at("NetFlowObject", name, wrap) if profile.wrapped else at("NetFlowObject", name)

    kinds = ("Subject", "FileObject", "NetFlowObject", "Event")
    return parsed.select(
        "file",
        "line_id",
        F.coalesce(*[F.when(at(k).isNotNull(), k) for k in kinds]).alias("kind"),
        F.coalesce(*[at(k, "uuid") for k in kinds]).alias("uuid"),
        F.coalesce(at("FileObject", "type"), at("Event", "type")).alias("type"),
        at("Subject", "properties", "map", "path").alias("subject_path"),
        at("Subject", "cmdLine", "string").alias("cmd"),
        (F.lit(None).cast("string") if profile.files_from_events else at("FileObject", "baseObject", "properties", "map", profile.file_field)).alias("file_path"),
        end("localAddress", "string").alias("src_addr"),
        end("localPort", "int").alias("src_port"),
        end("remoteAddress", "string").alias("dst_addr"),
        end("remotePort", "int").alias("dst_port"),
        at("Event", "subject", f"{prefix}UUID").alias("subject"),
        at("Event", "predicateObject", f"{prefix}UUID").alias("object"),
        at("Event", "predicateObjectPath", "string").alias("object_path"),
        at("Event", "properties", "map", "exec").alias("exec"),
        at("Event", "timestampNanos").cast("long").alias("timestamp_rec"),
        "has_unknown",
    )


def dedup_last(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row for each key: the last by ``order``; its nulls win like any other value."""
    rest = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(key).agg(rest.alias("__last")).select(key, *[F.col(f"__last.{c}").alias(c) for c in columns])


def _no(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.lit(None).cast("string"))
    return df


def netflow_nodes(records: DataFrame, profile: Profile) -> DataFrame:
    """(uuid, src_addr, src_port, dst_addr, dst_port); unix sockets have no endpoints."""
    ends = ["src_addr", "src_port", "dst_addr", "dst_port"]
    needed = ends if profile.remote_required else ends[:2]
    flows = records.where((F.col("kind") == "NetFlowObject") & F.col("uuid").isNotNull())
    for c in needed:
        flows = flows.where(F.col(c).isNotNull())
    flows = dedup_last(flows, "uuid", ["file", "line_id"], ends)
    if not profile.sockets:
        return flows
    sockets = records.where((F.col("kind") == "FileObject") & (F.col("type") == "FILE_OBJECT_UNIX_SOCKET")).select("uuid").distinct()
    return flows.unionByName(_no(sockets.join(flows, "uuid", "left_anti"), *ends))


def subject_nodes(records: DataFrame, profile: Profile) -> DataFrame:
    """(uuid, path, cmd)."""
    known = records.where((F.col("kind") == "Subject") & F.col("uuid").isNotNull())
    if profile.subjects_from_events:
        used = records.where((F.col("kind") == "Event") & F.col("exec").isNotNull()).select(F.col("subject").alias("uuid"), F.col("exec").alias("cmd"), "timestamp_rec", F.col("uuid").alias("event"))
        named = dedup_last(used.join(known.select("uuid").distinct(), "uuid", "left_semi"), "uuid", ["timestamp_rec", "event"], ["cmd"])
        return _no(named, "path").select("uuid", "path", "cmd")
    named = known.select("uuid", F.col("subject_path").alias("path") if profile.subject_path else F.lit(None).cast("string").alias("path"), "cmd", "file", "line_id")
    if profile.subject_path_required:
        named = named.where("path is not null")
    return dedup_last(named, "uuid", ["file", "line_id"], ["path", "cmd"])


def file_nodes(records: DataFrame, profile: Profile) -> DataFrame:
    """(uuid, path)."""
    files = records.where((F.col("kind") == "FileObject") & F.col("uuid").isNotNull())
    if not profile.files_from_events:
        named = files.where("file_path is not null").select("uuid", F.col("file_path").alias("path"), "file", "line_id")
        return dedup_last(named, "uuid", ["file", "line_id"], ["path"])
    known = files.where("type is null or type <> 'FILE_OBJECT_UNIX_SOCKET'").select("uuid").distinct()
    path = F.when(F.col("has_unknown"), F.lit(None)).otherwise(F.col("object_path")) if profile.unknown_is_null else F.col("object_path")
    used = records.where("kind = 'Event' and object is not null").select(F.col("object").alias("uuid"), path.alias("path"), "timestamp_rec", F.col("uuid").alias("event"))
    return dedup_last(used.join(known, "uuid", "left_semi"), "uuid", ["timestamp_rec", "event"], ["path"])


def assign_index(netflow: DataFrame, subject: DataFrame, file: DataFrame) -> DataFrame:
    """One nodes table with dense ids from 0: netflows first, then subjects, then files, by uuid.

    (index_id, node_uuid, hash_id, node_type, path, cmd, src_addr, src_port, dst_addr, dst_port)
    """
    ends = ["src_addr", "src_port", "dst_addr", "dst_port"]
    parts = [
        _no(netflow, "path", "cmd").withColumn("node_type", F.lit("netflow")).withColumn("rank", F.lit(0)),
        _no(subject, *ends).withColumn("node_type", F.lit("subject")).withColumn("rank", F.lit(1)),
        _no(file, "cmd", *ends).withColumn("node_type", F.lit("file")).withColumn("rank", F.lit(2)),
    ]
    columns = ["uuid", "node_type", "rank", "path", "cmd", *ends]
    every = parts[0].select(columns).unionByName(parts[1].select(columns)).unionByName(parts[2].select(columns))
    numbered = dense_index(every, ["rank", "uuid"])
    return numbered.select("index_id", F.col("uuid").alias("node_uuid"), node_hash(F.col("uuid")).alias("hash_id"), "node_type", "path", "cmd", *ends)


def filter_relations(events: DataFrame, profile: Profile, column: str = "operation") -> DataFrame:
    return events.where(F.col(column).isin(*RELATIONS)) if profile.allow_list else events.where(~F.col(column).isin(*EXCLUDED))


def resolve_events(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Join both endpoints: the subject to a subject; the object to a file, else a netflow, else a subject; others are dropped."""
    subjects = nodes.where("node_type = 'subject'").select(F.col("node_uuid").alias("subject"), F.col("hash_id").alias("src_node"), F.col("index_id").alias("src_index_id"))
    rank = F.when(F.col("node_type") == "file", 0).when(F.col("node_type") == "netflow", 1).otherwise(2)
    objects = nodes.groupBy("node_uuid").agg(F.min_by(F.struct("hash_id", "index_id"), rank).alias("o"))
    objects = objects.select(F.col("node_uuid").alias("object"), F.col("o.hash_id").alias("dst_node"), F.col("o.index_id").alias("dst_index_id"))
    return events.join(subjects, "subject").join(objects, "object")


def orient_edges(events: DataFrame) -> DataFrame:
    """Turn the edges of reversed relations round, so that edges follow the data."""
    turned = F.col("operation").isin(*REVERSED)
    pick = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a)
    ends = {"src_node": "dst_node", "src_index_id": "dst_index_id", "dst_node": "src_node", "dst_index_id": "src_index_id"}
    return events.select(*[pick(c, ends[c]) if c in ends else F.col(c) for c in events.columns])


def event_table(records: DataFrame, nodes: DataFrame, profile: Profile) -> DataFrame:
    """(src_node, src_index_id, operation, dst_node, dst_index_id, event_uuid, timestamp_rec); repeated events stay."""
    events = records.where("kind = 'Event' and subject is not null and object is not null").select("subject", "object", F.col("type").alias("operation"), F.col("uuid").alias("event_uuid"), "timestamp_rec")
    found = orient_edges(resolve_events(filter_relations(events, profile), nodes))
    return found.select("src_node", "src_index_id", "operation", "dst_node", "dst_index_id", "event_uuid", "timestamp_rec")


def ingest(raw: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """Raw lines to (nodes, events); the lines are parsed once and stored in narrow columns."""
    records = cut(parse_records(raw, profile))
    nodes = assign_index(netflow_nodes(records, profile), subject_nodes(records, profile), file_nodes(records, profile))
    return nodes, event_table(records, nodes, profile)
