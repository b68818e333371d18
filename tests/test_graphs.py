"""Windows, run collapse and neighbour memory against sequential versions."""

import functools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracewell.operators import features, graphs, trace
from tracewell.operators.order import running

MIN = graphs.MINUTE


def events(rng, n, days=3):
    ops = ["EVENT_READ", "EVENT_WRITE", "EVENT_OPEN"]
    rows = []
    for i in range(n):
        day = rng.randrange(1, days + 1)
        rows.append((rng.randrange(5), rng.choice(ops), rng.randrange(5), f"E{i:04d}", day * 86400 * 10**9 + rng.randrange(20 * 60) * MIN // 20, i, day))
    return rows


def cut_days(rows, batch, minutes, drop_tail):
    out = {}
    by_day = defaultdict(list)
    for r in rows:
        by_day[r[6]].append(r)
    for day, rs in by_day.items():
        rs.sort(key=lambda r: (r[4], r[3], r[5]))
        start, window, held = rs[0][4], 0, []
        for i in range(0, len(rs), batch):
            part = rs[i : i + batch]
            held += part
            last = i + batch >= len(rs)
            if part[-1][4] > start + minutes * MIN or (last and not drop_tail):
                for r in held:
                    out[r[5]] = (day, window, start, part[-1][4])
                start, window, held = part[-1][4], window + 1, []
    return out


SCHEMA = "src_index_id long, operation string, dst_index_id long, event_uuid string, timestamp_rec long, _id long, day int"


@pytest.mark.parametrize("drop_tail", [True, False])
def test_greedy_windows(spark, drop_tail):
    rows = events(random.Random(1), 777)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = graphs.assign_windows(graphs.with_batches(df, 16), 30, 16, drop_tail).collect()
    assert {r["_id"]: (r["day"], r["day_window"], r["tw_start"], r["tw_end"]) for r in got} == cut_days(rows, 16, 30, drop_tail)


def test_run_collapse(spark):
    rng = random.Random(2)
    rows = events(rng, 300, 1)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("tw", F.lit(0))
    expect, last = [], {}
    for r in sorted(rows, key=lambda r: (r[4], r[3], r[5])):
        if last.get((r[0], r[2])) != r[1]:
            expect.append(r[3])
        last[r[0], r[2]] = r[1]
    assert sorted(r["event_uuid"] for r in graphs.fuse_edges(df).collect()) == sorted(expect)


def test_day_slices_leave_midnight_out(spark):
    ns = [1704067200, 1704067201, 1704153600, 1704153601, 1704239999, 1704240000]
    df = spark.createDataFrame([(x * 10**9,) for x in ns], "timestamp_rec long")
    got = graphs.day_slices(df, "2024-01", range(1, 3), "UTC").collect()
    assert sorted((r["timestamp_rec"] // 10**9, r["day"]) for r in got) == [(1704067201, 1), (1704153601, 2), (1704239999, 2)]


def test_last_neighbors(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(6), rng.randrange(6), i, i // 4) for i in range(120)]
    seen, expect = defaultdict(list), {}
    for b in range(30):
        part = rows[b * 4 : b * 4 + 4]
        for node in {r[0] for r in part} | {r[1] for r in part}:
            expect[node, b] = [tuple(x) for x in sorted(seen[node], reverse=True)[:5]]
        for s, d, e, _ in part:
            seen[s].append((e, d))
            seen[d].append((e, s))
    df = spark.createDataFrame(rows, "src long, dst long, e_id long, batch long")
    got = {(r["node"], r["batch"]): [(x["e_id"], x["nbr"]) for x in r["neighbors"]] for r in features.last_k_neighbors(df, 5).collect()}
    assert {k: [e for e, _ in v] for k, v in got.items()} == {k: [e for e, _ in v] for k, v in expect.items()}


def versioned(rows):
    """Edges of the versioned graph by a walk in order of time."""
    seen, edges = {}, []
    for s, d in rows:
        if s == d:
            continue
        seen.setdefault(s, 0)
        if d in seen:
            edges.append(((d, seen[d]), (d, seen[d] + 1)))
            seen[d] += 1
        else:
            seen[d] = 0
        edges.append(((s, seen[s]), (d, seen[d])))
    return seen, edges


def reach(edges, start, back):
    step = defaultdict(set)
    for a, b in edges:
        step[b if back else a].add(a if back else b)
    out, todo = {start}, [start]
    while todo:
        for n in step[todo.pop()]:
            if n not in out:
                out.add(n)
                todo.append(n)
    return out


def component(rows, poi, scores):
    last, edges = versioned(rows)
    result = {poi}
    if poi not in last:
        return result
    for back in (True, False):
        start = (poi, last[poi] if back else 0)
        if not any((b if back else a) == start for a, b in edges):
            continue
        inner = reach(edges, start, back)
        own = [(a, b) for a, b in edges if a in inner and b in inner]
        ends = [n for n in inner if not any((b if back else a) == n for a, b in own)]
        groups = defaultdict(set)
        for e in ends:
            groups[e[0]] |= {n for n, _ in reach(own, e, not back) & inner}
        means = {}
        for e, nodes in groups.items():
            rest = [scores[n] for n in nodes if n != poi]
            means[e] = round(sum(rest) / len(rest), 9) if rest else 0
        for e, m in means.items():
            if m == max(means.values()):
                result |= groups[e]
    return result


def shortest(rows, poi, scores):
    """As component, by one path of fewest steps for each entry and exit; of equal ones that which leaves a node first, then to the least node."""
    last, edges = versioned(rows)
    result = {poi}
    if poi not in last:
        return result
    for mirrored in (False, True):
        steps = [((b[0], -b[1]), (a[0], -a[1])) if mirrored else (a, b) for a, b in edges]
        goal = (poi, 0 if mirrored else last[poi])
        if not any(b == goal for _, b in steps):
            continue
        hops, todo = {goal: 0}, [goal]
        for b in todo:
            for x, y in steps:
                if y == b and x not in hops:
                    hops[x] = hops[b] + 1
                    todo.append(x)
        groups = {}
        entered = {b for _, b in steps}
        for start in hops:
            if start in entered:
                continue
            at, nodes = start, {start[0]}
            while at != goal:
                ways = [b for a, b in steps if a == at and hops.get(b) == hops[at] - 1]
                at = min(ways, key=lambda b: (b[0] == at[0], b))
                nodes.add(at[0])
            groups[start[0]] = nodes
        means = {}
        for e, nodes in groups.items():
            rest = [scores[n] for n in nodes if n != poi]
            means[e] = round(sum(rest) / len(rest), 9) if rest else 0
        for e, m in means.items():
            if m == max(means.values()):
                result |= groups[e]
    return result


def traced_windows(rng, windows, most_nodes, most_edges):
    rows, pois, scores, graphs_ = [], [], [], {}
    for tw in range(windows):
        n = rng.randrange(2, most_nodes)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, most_edges))]
        rows += [(tw, s, d, i, f"E{i:05d}") for i, (s, d) in enumerate(edges)]
        own = {i: rng.randrange(5) / 4 for i in range(n)}
        scores += [(tw, i, s) for i, s in own.items()]
        poi = rng.randrange(n)
        pois.append((tw, poi))
        graphs_[tw] = (edges, poi, own)
    return rows, pois, scores, graphs_


def traced(spark, rows, pois, scores, trace_with):
    e = spark.createDataFrame(rows, "tw int, src long, dst long, time long, event_uuid string")
    p, s = spark.createDataFrame(pois, "tw int, poi long"), spark.createDataFrame(scores, "tw int, node long, score double")
    got = defaultdict(set)
    for r in trace_with(e, p, s).collect():
        got[r["tw"]].add(r["node"])
    return dict(got)


@pytest.mark.parametrize("seed, windows, nodes, edges", [(4, 60, 9, 25), (5, 12, 90, 260)])
def test_tracing_matches_the_versioned_graph(spark, seed, windows, nodes, edges):
    rows, pois, scores, plain = traced_windows(random.Random(seed), windows, nodes, edges)
    assert traced(spark, rows, pois, scores, trace.trace_component) == {tw: component(*g) for tw, g in plain.items()}
    assert traced(spark, rows, pois, scores, trace.trace_shortest_path) == {tw: shortest(*g) for tw, g in plain.items()}


def test_many_entries_fill_several_words(spark):
    """A hundred and fifty entries that all lead to one poi by way of a hub."""
    n = 150
    rows = [(0, i, 1000 + i % 3, i, f"E{i:05d}") for i in range(n)] + [(0, 1000 + k, 2000, n + k, f"E{n + k:05d}") for k in range(3)]
    scores = [(0, i, 1.0 if i in (7, 70, 140) else 0.0) for i in range(n)] + [(0, 1000 + k, 0.5) for k in range(3)]
    edges, own = [(r[1], r[2]) for r in rows], {i: s for _, i, s in scores} | {2000: 0.0}
    for fn, brute in ((trace.trace_component, component), (trace.trace_shortest_path, shortest)):
        got = traced(spark, rows, [(0, 2000)], scores, fn)[0]
        assert got == brute(edges, 2000, own) == {7, 70, 140, 1000 + 7 % 3, 1000 + 70 % 3, 1000 + 140 % 3, 2000}


def test_versions_of_a_hub_are_counted_by_many_tasks(spark):
    rng = random.Random(6)
    pairs = [(0, i % 50 + 1) if rng.random() < 0.4 else (i % 50 + 1, 0) for i in range(4000)]
    rows = [(tw, s, d, i, f"E{i:05d}") for tw in (0, 1) for i, (s, d) in enumerate(pairs)]
    df = trace.version_edges(spark.createDataFrame(rows, "tw int, src long, dst long, time long, event_uuid string"))
    seen, _ = versioned(pairs)
    tops = defaultdict(int)
    for r in df.collect():
        for n, v in ((r["src"], r["vsrc"]), (r["dst"], r["vdst"])):
            tops[r["tw"], n] = max(tops[r["tw"], n], v)
    assert dict(tops) == {(tw, n): v for tw in (0, 1) for n, v in seen.items()}


@pytest.mark.parametrize("own", [True, False])
def test_running_aggregates(spark, own):
    rng = random.Random(7)
    rows = [(0 if rng.random() < 0.8 else rng.randrange(1, 5), i, rng.randrange(100)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, t long, x long").repartition(5)
    got = running(df, ["k"], [F.col("t")], {"s": ("sum", F.col("x")), "lo": ("min", F.struct("x", "t")), "hi": ("max", F.col("x")), "bits": ("bit_or", F.col("x"))}, own)
    for k in range(5):
        mine = sorted(r for r in rows if r[0] == k)
        upto = []
        for r in sorted((r for r in got.collect() if r["k"] == k), key=lambda r: r["t"]):
            if own:
                upto.append(mine[len(upto)])
            want = (sum(m[2] for m in upto), min((m[2], m[1]) for m in upto), max(m[2] for m in upto), functools.reduce(int.__or__, (m[2] for m in upto))) if upto else (None,) * 4
            assert (r["s"], r["lo"] and tuple(r["lo"]), r["hi"], r["bits"]) == want
            if not own:
                upto.append(mine[len(upto)])


def test_windows_of_one_batch_and_of_none(spark):
    one = spark.createDataFrame([(0, "EVENT_READ", 1, "E1", 5, 1, 1), (0, "EVENT_READ", 1, "E2", 9, 2, 1)], SCHEMA)
    assert graphs.assign_windows(graphs.with_batches(one, 16), 1, 16).count() == 0
    tail = graphs.assign_windows(graphs.with_batches(one, 16), 1, 16, drop_tail=False)
    assert {(r["day_window"], r["tw_start"], r["tw_end"]) for r in tail.collect()} == {(0, 5, 9)}
    assert graphs.assign_windows(graphs.with_batches(one.where("false"), 16)).count() == 0


def test_many_windows_a_day(spark):
    """A window for nearly every batch: more than a single round of jumps can reach."""
    rows = [(0, "EVENT_READ", 1, f"E{i:05d}", i * MIN, i, 1) for i in range(1500)]
    got = graphs.assign_windows(graphs.with_batches(spark.createDataFrame(rows, SCHEMA), 4), 6, 4).collect()
    assert {r["_id"]: (r["day"], r["day_window"], r["tw_start"], r["tw_end"]) for r in got} == cut_days(rows, 4, 6, True)
    assert len({r["day_window"] for r in got}) > 150
    assert [r["tw"] for r in graphs.number_windows(spark.createDataFrame([(2, 0), (1, 1), (1, 0)], "day int, day_window long")).orderBy("day", "day_window").collect()] == [0, 1, 2]


@pytest.mark.parametrize("backward", [True, False])
def test_temporal_traces(spark, backward):
    """A node's time is the best of the edges that reach it, strictly before (after) the time of the node that they leave."""
    rng = random.Random(8)
    rows, pois, expect = [], [], {}
    for tw in range(25):
        n = rng.randrange(3, 12)
        edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(20)) for _ in range(rng.randrange(1, 40))]
        rows += [(tw, *e) for e in edges]
        pois.append((tw, rng.randrange(n)))
        best = {pois[-1][1]: 2**63 - 1 if backward else -(2**63)}
        for _ in range(len(edges) + 1):
            for s, d, t in edges:
                here, there = (d, s) if backward else (s, d)
                if here in best and (t < best[here] if backward else t > best[here]):
                    best[there] = t if there not in best else (max if backward else min)(best[there], t)
        expect |= {(tw, node): t for node, t in best.items()}
    e, p = spark.createDataFrame(rows, "tw int, src long, dst long, time long"), spark.createDataFrame(pois, "tw int, poi long")
    got = (trace.temporal_backward if backward else trace.temporal_forward)(e, p).collect()
    assert {(r["tw"], r["node"]): r["time"] for r in got} == expect
