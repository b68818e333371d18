"""Hand-made records of every profile, files in and out, and a stream."""

import json
import tempfile

from pyspark.sql import functions as F

from tracewell.sources import cdm, tables
from tracewell.streaming import stream_cdm, stream_events, stream_window_counts


def record(kind, body, version=18):
    return json.dumps({"datum": {f"{cdm.PREFIX}{version}.{kind}": body}})


def event(uuid, kind, subject, obj, path="/f", exe="sh", t=1, version=18):
    u = lambda x: {f"{cdm.PREFIX}{version}.UUID": x}
    return record("Event", {"uuid": uuid, "type": kind, "subject": u(subject), "predicateObject": u(obj), "predicateObjectPath": {"string": path} if path else None, "timestampNanos": 1523028000000000000 + t, "properties": {"map": {"exec": exe}}}, version)


def lines(version):
    port = (lambda x: {"int": x}) if version == 20 else (lambda x: x)
    addr = (lambda x: {"string": x}) if version == 20 else (lambda x: x)
    props = lambda **k: {"baseObject": {"properties": {"map": k}}}
    return [
        record("Subject", {"uuid": "S1", "type": "SUBJECT_PROCESS", "cmdLine": {"string": "/bin/sh -c ls"}, "properties": {"map": {"path": "/bin/sh"}}}, version),
        record("FileObject", {"uuid": "F1", "type": "FILE_OBJECT_FILE", **props(filename="/etc/passwd", path="/etc/passwd")}, version),
        record("FileObject", {"uuid": "X1", "type": "FILE_OBJECT_UNIX_SOCKET"}, version),
        record("NetFlowObject", {"uuid": "N1", "localAddress": addr("10.0.0.1"), "localPort": port(4444), "remoteAddress": addr("1.2.3.4"), "remotePort": port(80)}, version),
        record("NetFlowObject", {"uuid": "N2", "localAddress": addr("10.0.0.1"), "localPort": port(4445)}, version),
        event("E1", "EVENT_READ", "S1", "F1", "/etc/passwd", "sh", 5, version),
        event("E2", "EVENT_WRITE", "S1", "F1", None, "bash", 6, version),
        event("E3", "EVENT_SENDTO", "S1", "N1", None, "bash", 7, version),
        event("E4", "EVENT_CLOSE", "S1", "F1", "<unknown>", "bash", 4, version),
        event("E5", "EVENT_OTHER", "S1", "F1", "/x", "bash", 3, version),
        event("E6", "EVENT_READ", "S9", "F1", "/x", "bash", 2, version),
    ]


def ingest(spark, name):
    profile = cdm.PROFILES[name]
    raw = spark.createDataFrame([(v, "f", i) for i, v in enumerate(lines(profile.version))], "value string, file string, line_id long")
    nodes, events = cdm.ingest(raw, profile)
    return {r["node_uuid"]: r.asDict() for r in nodes.collect()}, {r["event_uuid"]: r.asDict() for r in events.collect()}


def test_every_profile(spark):
    for name, profile in cdm.PROFILES.items():
        nodes, events = ingest(spark, name)
        assert sorted(n["index_id"] for n in nodes.values()) == list(range(len(nodes)))
        assert nodes["N1"]["dst_addr"] == "1.2.3.4" and nodes["N1"]["dst_port"] == "80"
        assert ("N2" in nodes) == (not profile.remote_required)
        if "N2" in nodes:
            assert nodes["N2"]["dst_addr"] is None and nodes["N2"]["src_port"] == "4445"
        assert ("X1" in nodes) == profile.sockets
        if profile.subjects_from_events:
            assert (nodes["S1"]["path"], nodes["S1"]["cmd"]) == (None, "bash")
            assert nodes["F1"]["path"] is None  # the last event's path is null, and wins
        else:
            assert nodes["S1"]["cmd"] == "/bin/sh -c ls" and nodes["F1"]["path"] == "/etc/passwd"
            assert nodes["S1"]["path"] == ("/bin/sh" if profile.subject_path else None)
        wanted = {"E1", "E2", "E3"} | (set() if profile.allow_list else {"E4"})
        assert set(events) == wanted
        s, f = nodes["S1"]["index_id"], nodes["F1"]["index_id"]
        assert (events["E1"]["src_index_id"], events["E1"]["dst_index_id"]) == (f, s)
        assert (events["E2"]["src_index_id"], events["E2"]["dst_index_id"]) == (s, f)


def test_objects_resolve_to_files_first(spark):
    nodes = spark.createDataFrame([(0, "u", "h0", "netflow"), (1, "u", "h1", "file"), (2, "s", "h2", "subject")], "index_id long, node_uuid string, hash_id string, node_type string")
    found = cdm.resolve_events(spark.createDataFrame([("s", "u"), ("u", "s"), ("s", "?")], "subject string, object string"), nodes)
    assert [(r["src_index_id"], r["dst_index_id"]) for r in found.collect()] == [(2, 1)]


def test_files_in_and_out(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    e = spark.createDataFrame([(d, t, 1, 2, "EVENT_READ", 5, "E") for d in (1, 2) for t in (0, 1)], "day int, tw int, src long, dst long, operation string, time long, event_uuid string")
    n = spark.createDataFrame([(1, 0, 1, "file", "l"), (2, 0, 1, "file", "l")], "day int, tw int, index_id long, node_type string, label string")
    tables.write_graphs(e, n, f"{folder}/g")
    assert tables.read_graphs(spark, f"{folder}/g", [2]).count() == 2 and tables.read_graphs(spark, f"{folder}/g", [1], "nodes").count() == 1
    tables.write_tables({"event": e}, folder)
    assert tables.read_tables(spark, folder, "event").count() == 4
    losses = spark.createDataFrame([(0.5, 1, 2, "a,b", "c", "EVENT_READ", 7, "val", 3, 0)], tables.LOSS_SCHEMA + ", split string, model_epoch int, tw int")
    tables.write_losses(losses, f"{folder}/l")
    assert tables.read_losses(spark, f"{folder}/l").collect() == losses.collect()
    with open(f"{folder}/attack_7.csv", "w") as f:
        f.write("u1,/bin/x,5\n")
    assert tuple(tables.read_ground_truth(spark, f"{folder}/attack_7.csv").first()) == ("attack_7", "u1", "/bin/x", "5")
    report = spark.createDataFrame([(0, 9, "TP", 1, 0), (0, 2, "FP", 0, 1)], "tw int, poi long, tp_or_fp string, tps long, fps long")
    tables.write_trace_report(report, f"{folder}/r")
    assert spark.read.csv(f"{folder}/r", header=True).count() == 2


def test_stream_of_lines(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/a.json.1", "w") as f:
        f.write("\n".join(lines(18) + [lines(18)[5]]))
    counts = stream_window_counts(stream_events(stream_cdm(spark, folder), cdm.PROFILES["theia_e3"]))
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r["operation"]: r["n"] for r in spark.table("counts").collect()} == {"EVENT_READ": 2, "EVENT_WRITE": 1, "EVENT_SENDTO": 1}


def test_raw_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/x.json", "w") as f:
        f.write("\n".join(lines(18)))
    with open(f"{folder}/skip.txt", "w") as f:
        f.write("no\n")
    raw = cdm.read_cdm(spark, folder)
    assert raw.count() == 11 and raw.select(cdm.cdm_kind(F.col("value")).alias("k")).distinct().count() == 4
