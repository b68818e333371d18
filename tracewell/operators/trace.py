"""Reconstructing an attack around alerted nodes by tracing through time.

Every time data flows into a node that was seen before, the node gets a new
version.  What precedes version k of a node precedes all later versions, so the
reach of a poi is one number for each node: the highest version that leads to it
(backward) or the lowest that it leads to (forward).  Rounds join the changed
frontier with the edges until nothing changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import dense_index, dense_index_within, running
from .store import cut, discard


def results_by_window(results: DataFrame, tw_nodes: DataFrame) -> DataFrame:
    """Node results in every window that holds the node."""
    return tw_nodes.select("tw", F.col("index_id").alias("node")).distinct().join(results, "node")


def points_of_interest(by_window: DataFrame) -> DataFrame:
    """(tw, poi) of alerted nodes."""
    return by_window.where("y_hat = 1").select("tw", F.col("node").alias("poi")).distinct()


def degree_score(tw_edges: DataFrame) -> DataFrame:
    """(tw, node, score): edges out over edges in, 0 without edges in."""
    out = tw_edges.groupBy("tw", F.col("src").alias("node")).agg(F.count("*").alias("o"))
    into = tw_edges.groupBy("tw", F.col("dst").alias("node")).agg(F.count("*").alias("i"))
    both = out.join(into, ["tw", "node"], "full_outer")
    return both.select("tw", "node", F.when(F.coalesce("i", F.lit(0)) == 0, 0.0).otherwise(F.coalesce("o", F.lit(0)) / F.col("i")).alias("score"))


def loss_score(tw_nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """(tw, node, score): the node's own score cut to a whole number, 0 if it has none."""
    known = scores.select("node", F.col("score").alias("s"))
    return tw_nodes.select("tw", F.col("index_id").alias("node")).join(known, "node", "left").select("tw", "node", F.coalesce(F.col("s").cast("int"), F.lit(0)).cast("double").alias("score"))


def combined_score(degree: DataFrame, loss: DataFrame) -> DataFrame:
    """(tw, node, score): both scores scaled to 0..1 inside the window, added; a constant one counts 0."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        bounds = df.groupBy("tw").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))  # a row for each window
        lo, hi = F.col("lo"), F.col("hi")
        return df.join(bounds, "tw").select("tw", "node", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(0.0).alias(name))

    both = scaled(degree, "a").join(scaled(loss, "b"), ["tw", "node"], "full_outer")
    return both.select("tw", "node", (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("score"))


def version_edges(tw_edges: DataFrame) -> DataFrame:
    """(tw, seq, src, vsrc, dst, vdst): edges in order of time between versions of nodes; self-loops are dropped.

    A node's version counts the edges into it, but for one that it began with.
    """
    edges = dense_index_within(tw_edges.where("src <> dst"), "tw", ["time", "event_uuid"], "seq", 1)
    ends = edges.select("tw", "seq", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("into")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("into")))).alias("e")).select("tw", "seq", "e.node", "e.into")
    ends = running(ends, ["tw", "node"], [F.col("seq")], {"n": ("sum", F.col("into")), "first": ("min", F.struct("seq", "into"))})
    ends = ends.withColumn("v", F.col("n") - F.col("first.into"))
    sides = ends.groupBy("tw", "seq").agg(*[F.max(F.when(F.col("into") == k, F.col(c))).alias(f"{p}{n}") for k, n in ((0, "src"), (1, "dst")) for c, p in (("node", ""), ("v", "v"))])
    return sides.select("tw", "seq", "src", "vsrc", "dst", "vdst")


def node_versions(versioned: DataFrame) -> DataFrame:
    """(tw, node, last, starts, ends): last version; whether it first appears as a source; whether its last version is never one."""
    ends = versioned.select("tw", "seq", F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("vsrc").alias("v"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("node"), F.col("vdst").alias("v"), F.lit(False).alias("out")))).alias("e")).select("tw", "seq", "e.node", "e.v", "e.out")
    out = ends.groupBy("tw", "node").agg(F.max("v").alias("last"), F.min_by("out", "seq").alias("starts"), F.max(F.when(F.col("out"), F.col("v"))).alias("top"))
    return out.select("tw", "node", "last", "starts", (F.coalesce("top", F.lit(-1)) < F.col("last")).alias("ends"))


def _spread(edges: DataFrame, seeds: DataFrame, keys: list[str], on: list[str], backward: bool) -> DataFrame:
    """(keys, node, v): from the seeds along edges until nothing changes.

    Only what changed is joined again, and only with edges between the old
    version and the new one, so that each edge of a hub is taken once.
    """
    here, there, at, to = ("dst", "src", "vdst", "vsrc") if backward else ("src", "dst", "vsrc", "vdst")
    best = F.max if backward else F.min
    state = cut(seeds.select(*keys, "node", "v"))
    frontier = cut(state.withColumn("old", F.lit(None).cast("long")))
    while True:
        step = frontier.join(edges.withColumnRenamed(here, "node"), [*on, "node"])
        fresh = (F.col(at) <= F.col("v")) & (F.col("old").isNull() | (F.col(at) > F.col("old"))) if backward else (F.col(at) >= F.col("v")) & (F.col("old").isNull() | (F.col(at) < F.col("old")))
        step = step.where(fresh).groupBy(*keys, F.col(there).alias("node")).agg(best(to).alias("v"))
        known = state.withColumnRenamed("v", "old")
        better = F.col("old").isNull() | (F.col("v") > F.col("old") if backward else F.col("v") < F.col("old"))
        last, frontier = frontier, cut(step.join(known, [*keys, "node"], "left").where(better).select(*keys, "node", "v", "old"))
        discard(last)
        if not frontier.take(1):
            return state
        before, state = state, cut(state.unionByName(frontier.drop("old")).groupBy(*keys, "node").agg(best("v").alias("v")))
        discard(before)


def backward_reach(versioned: DataFrame, pois: DataFrame) -> DataFrame:
    """(tw, poi, node, v): all that leads to the poi's last version, by highest version."""
    last = node_versions(versioned).select("tw", F.col("node").alias("poi"), F.col("last").alias("v"))
    return _spread(versioned.drop("seq"), pois.join(last, ["tw", "poi"]).withColumn("node", F.col("poi")), ["tw", "poi"], ["tw"], True)


def forward_reach(versioned: DataFrame, pois: DataFrame) -> DataFrame:
    """(tw, poi, node, v): all that the poi's version 0 leads to, by lowest version."""
    known = node_versions(versioned).select("tw", F.col("node").alias("poi"))
    return _spread(versioned.drop("seq"), pois.join(known, ["tw", "poi"]).withColumn("node", F.col("poi")).withColumn("v", F.lit(0).cast("long")), ["tw", "poi"], ["tw"], False)


_SIDE = ["side", "tw", "poi"]


def _sides(versioned: DataFrame, pois: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges: side, tw, src, vsrc, dst, vdst; goals: side, tw, poi, node, v; starts: side, tw, node, v), stored.

    Side 0 leads from entries to a poi's last version.  Side 1 is side 0 of the
    mirrored graph: edges turned round and versions below zero, so that it leads
    from exits to the poi's version 0.  A poi without edges on a side has no goal
    there.
    """
    facts = cut(node_versions(versioned))
    mirrored = versioned.select(F.lit(1).alias("side"), "tw", F.col("dst").alias("src"), (-F.col("vdst")).alias("vsrc"), F.col("src").alias("dst"), (-F.col("vsrc")).alias("vdst"))
    edges = cut(versioned.select(F.lit(0).alias("side"), "tw", "src", "vsrc", "dst", "vdst").unionByName(mirrored))
    own = pois.select("tw", "poi").distinct().join(facts.withColumnRenamed("node", "poi"), ["tw", "poi"])
    ahead = F.array(F.struct(F.lit(0).alias("side"), F.col("starts").alias("mark"), F.col("last").alias("v")), F.struct(F.lit(1).alias("side"), F.col("ends").alias("mark"), F.lit(0).cast("long").alias("v")))
    goals = own.select("tw", "poi", "last", F.explode(ahead).alias("g")).where("not (last = 0 and g.mark)").select("g.side", "tw", "poi", F.col("poi").alias("node"), "g.v")
    first = F.array(F.struct(F.lit(0).alias("side"), F.col("starts").alias("mark"), F.lit(0).cast("long").alias("v")), F.struct(F.lit(1).alias("side"), F.col("ends").alias("mark"), (-F.col("last")).alias("v")))
    starts = facts.select("tw", "node", F.explode(first).alias("s")).where("s.mark").select("s.side", "tw", "node", "s.v")
    return edges, cut(goals), cut(starts)


def _best(means: DataFrame) -> DataFrame:
    """The rows of each side of a poi that have its highest mean."""
    return means.join(means.groupBy(*_SIDE).agg(F.max("mean").alias("top")), _SIDE).where("mean = top").drop("mean", "top")


def _mean() -> Column:
    return F.coalesce(F.round(F.sum("s") / F.sum("c"), 12), F.lit(0.0)).alias("mean")


def _scored(members: DataFrame, scores: DataFrame) -> DataFrame:
    """Members with their score ``s`` and how often it counts, ``c``: a node without a score counts 0, the poi doesn't count."""
    joined = members.join(scores.select("tw", "node", "score"), ["tw", "node"], "left")
    other = F.col("node") != F.col("poi")
    return joined.withColumn("s", F.when(other, F.coalesce("score", F.lit(0.0)))).withColumn("c", F.when(other, 1))


def _spread_sets(inner: DataFrame, seeds: DataFrame) -> DataFrame:
    """(side, tw, poi, word, node, bits): which of the seeds reach each node along edges that lead on in time.

    seeds: side, tw, poi, word, node, v, bits: sets of up to 64 entries.  Entries
    that first reach a node at one version share a row; only what is new goes on.
    """
    keys = [*_SIDE, "word", "node"]
    state = cut(seeds.select(*keys, "v", "bits"))
    frontier = cut(state)
    while True:
        step = frontier.join(inner.withColumnRenamed("src", "node"), [*_SIDE, "node"]).where("vsrc >= v")
        step = step.groupBy(*_SIDE, "word", F.col("dst").alias("node"), F.col("vdst").alias("v")).agg(F.bit_or("bits").alias("bits"))
        both = state.withColumn("new", F.lit(0)).unionByName(step.withColumn("new", F.lit(1)))
        seen = running(both, keys, [F.col("v"), F.col("new")], {"seen": ("bit_or", F.col("bits"))}, own=False)
        left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long"))))
        merged = cut(seen.withColumn("bits", left).where("bits <> 0").select(*keys, "v", "bits", "new"))
        discard(frontier, state)
        frontier, state = cut(merged.where("new = 1").drop("new")), cut(merged.drop("new"))
        discard(merged)
        if not frontier.take(1):
            return state.groupBy(*keys).agg(F.bit_or("bits").alias("bits"))


def trace_component(tw_edges: DataFrame, pois: DataFrame, scores: DataFrame) -> DataFrame:
    """(tw, poi, node): the poi, and on both sides the nodes between it and the entries (exits) of highest mean score.

    Entries precede the poi and have no predecessor; an entry's nodes lie on any
    path from it to the poi; likewise exits.  pois: (tw, poi); scores: (tw, node,
    score).  Pois that aren't in their window's edges stand alone.  Entries are
    carried as sets of bits, 64 in a row, so what is kept grows with the poi's
    reach, not with entries times nodes.
    """
    edges, goals, starts = _sides(cut(version_edges(tw_edges)), pois)
    reach = _spread(edges, goals, _SIDE, ["side", "tw"], True)
    src, dst = (reach.select(*_SIDE, F.col("node").alias(c), F.col("v").alias(f"{c}_top")) for c in ("src", "dst"))
    inner = edges.join(src, ["side", "tw", "src"]).join(dst, [*_SIDE, "dst"]).where("vsrc <= src_top and vdst <= dst_top")
    inner = cut(inner.select(*_SIDE, "src", "vsrc", "dst", "vdst"))
    entries = reach.select(*_SIDE, "node").join(starts, ["side", "tw", "node"])
    entries = dense_index(entries, [*_SIDE, "node"], "e").withColumn("word", F.floor(F.col("e") / 64)).withColumn("bits", F.expr("shiftleft(1L, cast(e % 64 as int))"))
    sets = cut(_spread_sets(inner, entries))

    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("bits", b) == 1)).alias("bit")
    means = _scored(sets, scores).select(*_SIDE, "word", "s", "c", bit).groupBy(*_SIDE, "word", "bit").agg(_mean())
    best = _best(means).groupBy(*_SIDE, "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("chosen"))
    between = sets.join(best, [*_SIDE, "word"]).where(F.col("bits").bitwiseAND(F.col("chosen")) != 0).select("tw", "poi", "node")
    return between.unionByName(pois.select("tw", "poi", F.col("poi").alias("node"))).distinct()


def _hops(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """(side, tw, poi, node, v, w, to, vto): from node at version v it takes w steps to the goal by the edge to ``to`` at ``vto``.

    A step is an edge or going on to the node's next version.  Only versions that
    edges leave from have rows: from any other version one first goes on to the
    version at which v + w is least.  Every round hands on what has got shorter;
    what an edge's end needs is found among its node's rows by a running minimum
    from the highest version down.
    """
    keys = [*_SIDE, "node"]
    none = F.lit(None).cast("long")
    state = cut(goals.select(*keys, "v", F.lit(0).cast("long").alias("w"), none.alias("to"), none.alias("vto")))
    frontier = cut(state)
    while True:
        tops = frontier.groupBy(*keys).agg(F.max("v").alias("top"))
        asked = edges.withColumnRenamed("dst", "node").join(tops, ["side", "tw", "node"]).where("vdst <= top")
        asked = asked.select(*keys, F.col("vdst").alias("v"), F.lit(1).alias("asks"), none.alias("sum"), "src", "vsrc")
        told = frontier.select(*keys, "v", F.lit(0).alias("asks"), (F.col("v") + F.col("w")).alias("sum"), none.alias("src"), none.alias("vsrc"))
        found = running(asked.unionByName(told), keys, [F.desc("v"), F.col("asks")], {"least": ("min", F.col("sum"))}).where("asks = 1 and least is not null")
        step = found.select(*_SIDE, F.col("src").alias("node"), F.col("vsrc").alias("v"), F.struct((F.col("least") - F.col("v") + 1).alias("w"), F.col("node").alias("to"), F.col("v").alias("vto")).alias("s"))
        step = step.groupBy(*keys, "v").agg(F.min("s").alias("s")).select(*keys, "v", "s.*")
        known = state.select(*keys, "v", F.col("w").alias("old"))
        last, frontier = frontier, cut(step.join(known, [*keys, "v"], "left").withColumn("shorter", F.col("old").isNull() | (F.col("w") < F.col("old"))))
        discard(last)
        every = state.unionByName(frontier.drop("old", "shorter")).groupBy(*keys, "v").agg(F.min(F.struct("w", "to", "vto")).alias("s"))
        before, state = state, cut(every.select(*keys, "v", "s.*"))
        discard(before)
        last, frontier = frontier, cut(frontier.where("shorter").select(*keys, "v", "w"))
        discard(last)
        if not frontier.take(1):
            return state


def _walk(hops: DataFrame, starts: DataFrame) -> DataFrame:
    """(side, tw, poi, group, node): the nodes on the way from each start (node, v) of a poi to its goal, step by step."""
    keys = [*_SIDE, "node"]
    none = F.lit(None).cast("long")
    cursors = cut(starts.select(*_SIDE, F.col("node").alias("group"), "node", "v"))
    seen = []
    while cursors.take(1):
        seen.append(cursors)
        told = hops.join(cursors.select(*keys).distinct(), keys, "left_semi")
        told = told.select(*keys, "v", F.lit(0).alias("asks"), F.struct((F.col("v") + F.col("w")).alias("sum"), F.col("v").alias("leave"), "to", "vto").alias("way"), none.alias("group"))
        asked = cursors.select(*keys, "v", F.lit(1).alias("asks"), F.lit(None).cast(told.schema["way"].dataType).alias("way"), "group")
        found = running(asked.unionByName(told), keys, [F.desc("v"), F.col("asks")], {"best": ("min", F.col("way"))}).where("asks = 1")
        cursors = cut(found.where("best.to is not null").select(*_SIDE, "group", F.col("best.to").alias("node"), F.col("best.vto").alias("v")))
    if not seen:
        return cursors.drop("v")
    out = seen[0]
    for df in seen[1:]:
        out = out.unionByName(df)
    return out.drop("v").distinct()


def trace_shortest_path(tw_edges: DataFrame, pois: DataFrame, scores: DataFrame) -> DataFrame:
    """As trace_component, but a group is one path of fewest steps from an entry to the poi, or from the poi to an exit.

    A step is an edge or going on to a node's next version.  Of equally short
    paths it is the one that leaves each node earliest, seen from the entry (or
    exit), and then goes on to the least node.
    """
    edges, goals, starts = _sides(cut(version_edges(tw_edges)), pois)
    hops = _hops(edges, goals)
    begun = hops.groupBy(*_SIDE, "node").agg(F.max("v").alias("top")).join(starts, ["side", "tw", "node"]).where("v <= top")
    members = cut(_walk(hops, begun))
    means = _scored(members, scores).groupBy(*_SIDE, "group").agg(_mean())
    between = members.join(_best(means), [*_SIDE, "group"], "left_semi").select("tw", "poi", "node")
    return between.unionByName(pois.select("tw", "poi", F.col("poi").alias("node"))).distinct()


def n_hop(tw_edges: DataFrame, pois: DataFrame, n: int) -> DataFrame:
    """(tw, poi, node) within n edges of the poi, either direction."""
    links = tw_edges.select("tw", "src", "dst")
    links = links.unionByName(links.select("tw", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    reach = pois.select("tw", "poi", F.col("poi").alias("node"))
    for _ in range(n):
        step = reach.join(links.withColumnRenamed("src", "node"), ["tw", "node"]).select("tw", "poi", F.col("dst").alias("node"))
        reach = cut(reach.unionByName(step).distinct())
    return reach


def _temporal(edges: DataFrame, pois: DataFrame, backward: bool) -> DataFrame:
    here, there = ("dst", "src") if backward else ("src", "dst")
    best = F.max if backward else F.min
    bound = F.lit(2**63 - 1 if backward else -(2**63)).cast("long")
    state = cut(pois.select("tw", "poi", F.col("poi").alias("node"), bound.alias("time")))
    frontier = cut(state.withColumn("old", F.lit(None).cast("long")))
    while True:
        step = frontier.withColumnRenamed("time", "t").join(edges.select("tw", F.col(here).alias("node"), F.col(there).alias("next"), "time"), ["tw", "node"])
        # edges beyond the time that the node had before were taken then
        fresh = (F.col("time") < F.col("t")) & (F.col("old").isNull() | (F.col("time") >= F.col("old"))) if backward else (F.col("time") > F.col("t")) & (F.col("old").isNull() | (F.col("time") <= F.col("old")))
        step = step.where(fresh).groupBy("tw", "poi", F.col("next").alias("node")).agg(best("time").alias("time"))
        known = state.withColumnRenamed("time", "old")
        better = F.col("old").isNull() | (F.col("time") > F.col("old") if backward else F.col("time") < F.col("old"))
        last, frontier = frontier, cut(step.join(known, ["tw", "poi", "node"], "left").where(better).select("tw", "poi", "node", "time", "old"))
        discard(last)
        if not frontier.take(1):
            return state
        before, state = state, cut(state.unionByName(frontier.drop("old")).groupBy("tw", "poi", "node").agg(best("time").alias("time")))
        discard(before)


def temporal_backward(edges: DataFrame, pois: DataFrame) -> DataFrame:
    """(tw, poi, node, time): from the poi back along the latest edges strictly before the time reached; time is the latest such edge's."""
    return _temporal(edges, pois, True)


def temporal_forward(edges: DataFrame, pois: DataFrame) -> DataFrame:
    """(tw, poi, node, time): from the poi on along the earliest edges strictly after the time reached."""
    return _temporal(edges, pois, False)


def trace_report(traced: DataFrame, truth: DataFrame) -> DataFrame:
    """(tw, poi, tp_or_fp, tps, fps): whether the poi is ground truth, and how many traced nodes are and aren't."""
    known = truth.select("node").distinct().withColumn("y", F.lit(1))
    marked = traced.join(known, "node", "left").withColumn("y", F.coalesce("y", F.lit(0)))
    out = marked.groupBy("tw", "poi").agg(F.sum("y").alias("tps"), F.sum(1 - F.col("y")).alias("fps"), F.max(F.when(F.col("node") == F.col("poi"), F.col("y"))).alias("own"))
    return out.select("tw", "poi", F.when(F.col("own") == 1, "TP").otherwise("FP").alias("tp_or_fp"), "tps", "fps")


def traced_nodes(traced: DataFrame, by_window: bool = True) -> DataFrame:
    return traced.select("tw", "node").distinct() if by_window else traced.select("node").distinct()


def induced_subgraph(tw_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of a window both ends of which are among its nodes (tw, node)."""
    inner = tw_edges.join(nodes.select("tw", F.col("node").alias("src")), ["tw", "src"], "left_semi")
    return inner.join(nodes.select("tw", F.col("node").alias("dst")), ["tw", "dst"], "left_semi")


def results_after_trace(by_window: DataFrame, traced: DataFrame, level: str = "node") -> DataFrame:
    """Results with y_hat by whether the node was traced; by node (score: greatest over the windows, 0 at least) or by window."""
    hit = traced.select("tw", "node").distinct().withColumn("t", F.lit(1))
    rows = by_window.join(hit, ["tw", "node"], "left").withColumn("y_hat", F.coalesce("t", F.lit(0)))
    if level == "window":
        return rows.select("tw", "node", "score", "y_true", "y_hat")
    return rows.groupBy("node").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"), F.max("y_true").alias("y_true"), F.max("y_hat").alias("y_hat"))


def contract_graph(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of one (path, type) become one: (nodes: path, node_type, y_true, score; edges with greatest score and span of time).

    nodes: node, path, node_type, y_true, score; edges: src, dst, operation, score, time.
    """
    merged = nodes.groupBy("path", "node_type").agg(F.max("y_true").alias("y_true"), F.greatest(F.max("score"), F.lit(0.0)).alias("score"))
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("path").alias(f"{c}_path"), F.col("node_type").alias(f"{c}_type"))
    joined = edges.join(side("src"), "src").join(side("dst"), "dst")
    keys = ["src_path", "src_type", "dst_path", "dst_type", "operation"]
    return merged, joined.groupBy(*keys).agg(F.max("score").alias("score"), F.min("time").alias("first"), F.max("time").alias("last"), F.count("*").alias("n_edges"))


def alert_subgraph(tw_edges: DataFrame, seeds: DataFrame, n: int = 1) -> DataFrame:
    """Edges among the nodes within n edges of the seeds (tw, poi), in their windows."""
    near = n_hop(tw_edges, seeds, n).select("tw", "node").distinct()
    return induced_subgraph(tw_edges, near)
