"""Column functions and ordering."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.functions import times as T
from tracewell.operators import features
from tracewell.operators.order import dense_index


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_times(spark):
    assert one(spark, T.text_to_sec(F.lit("2018-04-06 11:20:00"))) == 1523028000
    ns = 1523028000 * T.NANOS + 42
    assert one(spark, T.ns_to_text(F.lit(ns))) == "2018-04-06 11:20:00.000000042"
    assert one(spark, T.text_nanos_to_ns(F.lit("2018-04-06 11:20:00.000000042"))) == ns
    assert one(spark, T.text_nanos_to_ns(F.lit("2018-04-06 11:20:00"))) == ns - 42
    assert one(spark, T.text_to_ns(F.lit("no time"))) is None
    ticks = one(spark, T.tick_series(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 01:10:00").cast("timestamp"), 30))
    assert [t.minute for t in ticks] == [0, 30, 0, 10]


def test_texts(spark):
    t = lambda c: one(spark, c)
    none = F.lit(None).cast("string")
    assert t(X.node_message(F.lit("subject"), none, F.lit("ls"), none, none)) == "None ls"
    assert t(X.node_message(F.lit("netflow"), none, none, F.lit("1.2.3.4"), F.lit("80"))) == "1.2.3.4:80"
    assert t(X.node_display(F.lit("subject"), none, F.lit("ls"), none, none, none, none)) == "ls"
    assert t(X.tokenize_path(F.lit("C:\\\\\\\\a\\\\b.exe"))) == ["C", ":", "/", "a", "/", "b.exe"]
    assert t(X.tokenize_netflow(F.lit("10.0.0.1:80"))) == ["10", ".", "0", ".", "0", ".", "1", ":", "80"]
    assert t(X.tokenize_nodes(F.lit("netflow"), F.lit("1:2"), True)) == ["netflow", "1", ":", "2"]
    assert tuple(t(X.split_filename(F.lit("my-file_2.tar.gz")))) == ("my file 2 tar", "gz")
    assert t(X.hash_list(F.lit("a"), F.lit("b"))) != t(X.hash_list(F.lit("b"), F.lit("a")))


def test_position_weights_sum_to_one(spark):
    for n in (1, 2, 7, 30):
        w = spark.range(1, n + 1).select(features.position_weight(F.col("id"), F.lit(n)).alias("w")).agg(F.sum("w")).first()[0]
        assert w == pytest.approx(1)


def test_dense_index(spark):
    values = list(range(500))
    random.Random(0).shuffle(values)
    rows = dense_index(spark.createDataFrame([(v,) for v in values], "v int").repartition(6), ["v"], "i", 10).collect()
    assert sorted((r["i"], r["v"]) for r in rows) == [(v + 10, v) for v in range(500)]
    assert dense_index(spark.range(0), ["id"], "i").count() == 0
