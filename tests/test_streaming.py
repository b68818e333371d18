"""State of streams against the tables that they read."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracewell import streaming
from tracewell.operators import features

START = datetime(2024, 1, 1)
SCHEMA = "src long, dst long, e_id long, ts timestamp"


def run(spark, source, folder, **options):
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    streaming.keep_latest(streaming.stream_last_neighbors(files, 5, **options), f"{folder}/updates", f"{folder}/checkpoint")
    return {tuple(r) for r in streaming.latest_state(spark, f"{folder}/updates").select("node", "nbr", "e_id").collect()}


def write(spark, rows, source):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)


def test_state_outlives_restarts_and_equals_the_snapshot(spark, tmp_path):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(8), rng.randrange(8), i, START + timedelta(seconds=i)) for i in range(300)]
    source, seen = str(tmp_path / "edges"), []
    order = rows[:]
    rng.shuffle(order)  # edges come in any order inside the watermark
    for begin in range(0, 300, 100):
        part = order[begin : begin + 100]
        write(spark, part[:50], source)
        write(spark, part[50:], source)
        seen += part
        got = run(spark, source, str(tmp_path), late="1 hour")
        batch = spark.createDataFrame([(s, d, e, 0) for s, d, e, _ in seen], "src long, dst long, e_id long, batch long")
        assert got == {tuple(r) for r in features.neighbor_snapshot(batch, 5).select("node", "nbr", "e_id").collect()}


def test_late_edges_are_left_out_and_idle_nodes_forgotten(spark, tmp_path):
    source, at = str(tmp_path / "edges"), lambda m: START + timedelta(minutes=m)
    write(spark, [(1, 2, 0, at(0)), (3, 4, 1, at(1))], source)
    assert run(spark, source, str(tmp_path), late="5 minutes", idle_ms=30 * 60_000) == {(1, 2, 0), (2, 1, 0), (3, 4, 1), (4, 3, 1)}
    write(spark, [(3, 5, 2, at(20))], source)
    run(spark, source, str(tmp_path), late="5 minutes", idle_ms=30 * 60_000)
    write(spark, [(3, 6, 3, at(2)), (3, 7, 4, at(21))], source)  # minute 2 lies before the watermark of minute 15
    got = run(spark, source, str(tmp_path), late="5 minutes", idle_ms=30 * 60_000)
    assert {x for x in got if x[0] == 3} == {(3, 4, 1), (3, 5, 2), (3, 7, 4)}
    for minute, e in ((60, 5), (61, 6)):
        write(spark, [(8, 9, e, at(minute))], source)
        got = run(spark, source, str(tmp_path), late="5 minutes", idle_ms=30 * 60_000)
    assert {x[0] for x in got} == {8, 9}


def test_nodes_share_states(spark, tmp_path):
    """A call for each node took about 7 ms of a core; states are those of buckets, however many nodes there are."""
    source = str(tmp_path / "edges")
    for part in range(2):
        rows = spark.range(40_000).selectExpr("id % 9000 as src", "(id * 7 + 1) % 9001 + 9000 as dst", f"id * 2 + {part} as e_id", "timestamp_micros(1704067200000000 + id * 1000000) as ts")
        rows.unionByName(rows.selectExpr("-1 as src", "dst", f"e_id + {10**6} as e_id", "ts")).repartition(1).write.mode("append").parquet(source)  # -1 is a hub
    got = run(spark, source, str(tmp_path), late="1 day")
    batch = spark.read.parquet(source).selectExpr("src", "dst", "e_id", "0L as batch")
    assert got == {tuple(r) for r in features.neighbor_snapshot(batch, 5).select("node", "nbr", "e_id").collect()} and len({x[0] for x in got}) == 18_002
    assert spark.read.format("statestore").load(str(tmp_path / "checkpoint")).count() <= 4096


def test_nodes_of_one_bucket_are_forgotten_one_by_one(spark, tmp_path):
    source, at = str(tmp_path / "edges"), lambda m: START + timedelta(minutes=m)
    steps = [
        ([(1, 2, 0, at(0)), (3, 4, 1, at(10))], {1, 2, 3, 4}),
        ([(5, 6, 2, at(40)), (5, 1, 3, at(20))], {1, 3, 4, 5, 6}),  # the watermark is minute 5 while they are read, 35 after
        ([(5, 6, 4, at(46)), (2, 1, 5, at(3))], {1, 5, 6}),  # an edge of minute 3 is late and keeps nobody; 41 after
        ([(7, 7, 6, at(60))], {5, 6, 7}),  # 55 after
        ([(7, 8, 7, at(90))], {7, 8}),  # 85 after
    ]
    for rows, left in steps:
        write(spark, rows, source)
        got = run(spark, source, str(tmp_path), late="5 minutes", idle_ms=30 * 60_000, buckets=1)
        assert {x[0] for x in got} == left, rows
    assert got == {(7, 7, 6), (7, 8, 7), (8, 7, 7)} and sum(r["nbr"] == 7 for r in streaming.latest_state(spark, f"{tmp_path}/updates").collect()) == 3
