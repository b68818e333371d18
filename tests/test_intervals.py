"""Points in intervals of very different lengths."""

import random

from pyspark.sql import functions as F

from tracewell.operators import labels
from tracewell.operators.intervals import dyadic_cover, points_in_intervals

SECOND = 10**9
YEAR = 365 * 86400 * SECOND


def test_a_second_beside_ten_years(spark):
    rng = random.Random(1)
    begin = 1_700_000_000 * SECOND
    spans = [(0, begin, begin + SECOND), (1, begin - 5 * YEAR, begin + 5 * YEAR), (2, begin + 5, begin + 5), (3, begin + 9, begin), (4, None, begin), (5, -7 * YEAR, 3)]
    spans += [(10 + i, s := begin + rng.randrange(YEAR), s + rng.randrange(10 ** rng.randrange(1, 17))) for i in range(60)]
    intervals = spark.createDataFrame(spans, "tw int, start long, end long")
    cover = intervals.select("tw", F.explode(dyadic_cover(F.col("start"), F.col("end"))).alias("b"))
    assert cover.where("tw < 2").count() < 200
    assert cover.groupBy("tw", "b.level").count().where("count > 2").count() == 0
    times = [begin, begin + 5, begin + SECOND, begin + SECOND + 1, -1, 3, 4] + [begin + rng.randrange(-YEAR, YEAR) for _ in range(400)]
    points = spark.createDataFrame([(t, i) for i, t in enumerate(times)] + [(None, -1)], "time long, node long")
    got = sorted((r["node"], r["tw"]) for r in points_in_intervals(points, intervals, "time", "start", "end").collect())
    assert got == sorted((i, tw) for i, t in enumerate(times) for tw, s, e in spans if s is not None and s <= t <= e)
    strict = {(r["tw"], r["node"]) for r in labels.window_labels(points, intervals).collect()}
    assert strict == {(tw, i) for i, t in enumerate(times) for tw, s, e in spans if s is not None and s < t < e}
    assert points_in_intervals(points, intervals.where("false"), "time", "start", "end").count() == 0


def test_many_attacks_are_joined_by_their_buckets(spark, monkeypatch):
    monkeypatch.setattr(labels, "FEW", 2)
    attacks = spark.createDataFrame([("a", 0, 10**15), ("b", 5, 5), ("c", 10**14, 10**18), ("d", 7, 6)], "attack string, start_ns long, end_ns long")
    times = [0, 4, 5, 6, 10**14 - 1, 10**14, 10**15, 10**15 + 1, 10**18, 10**18 + 1]
    events = spark.createDataFrame([(t,) for t in times], "timestamp_rec long")
    got = {(r["timestamp_rec"], r["attack"]) for r in labels.events_in_attacks(events, attacks).collect()}
    assert got == {(t, a) for t in times for a, s, e in (("a", 0, 10**15), ("b", 5, 5), ("c", 10**14, 10**18)) if s <= t <= e}
