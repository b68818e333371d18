"""Sharding and mixing: DataFrame functions only."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracewell.llm import mixing, sharding

from .util import AWKWARD, make_docs, words


def texts(n):
    return [("word " * (1 + i * 7 % 40)).strip() + f" {i}" for i in range(n)]


def test_shards_are_near_equal_and_gapless(spark):
    ts = texts(900) + AWKWARD
    docs = make_docs(spark, ts).withColumn("vslot", F.lit(0)).withColumn("size", F.lit("x"))
    rows = sharding.shard_records(docs, 7).collect()
    assert len(rows) == len(ts)
    loads, places = Counter(), defaultdict(list)
    for r in rows:
        raw = (ts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert set(loads) == set(range(7))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(loads.values()) - min(loads.values()) <= max(r["size"] for r in rows)
    again = sharding.shard_records(docs, 7).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in rows} == {r["doc_id"]: (r["shard"], r["slot"]) for r in again}


def test_growing_moves_slots_only_to_the_new_shard(spark):
    docs = make_docs(spark, texts(600))
    sized = docs.select(sharding.virtual_slot(F.col("doc_id"), 256).alias("vslot"), F.length("text").cast("long").alias("size"))
    first = sharding.assign_slots(sharding.slot_bytes(sized, 256), 5)
    old = {r["vslot"]: r["shard"] for r in first.collect()}
    grown = {r["vslot"]: (r["shard"], r["version"], r["bytes"]) for r in sharding.grow_map(first, 5).collect()}
    assert {s for v, (s, _, _) in grown.items() if s != old[v]} == {5} and {x[1] for x in grown.values()} == {2}
    loads = Counter()
    for s, _, b in grown.values():
        loads[s] += b
    assert len(loads) == 6 and max(loads.values()) < 1.2 * min(loads.values())
    placed = sharding.shard_records(docs, 6, slots=256, slot_map=sharding.grow_map(first, 5)).collect()
    assert len(placed) == 600 and all(grown[r["virtual_slot"]][0] == r["shard"] for r in placed)


def test_sharding_nulls_and_empty_tables(spark):
    docs = make_docs(spark, ["a", "a", None, "b"], [None, 1, 1, None])
    rows = sharding.shard_records(docs, 3).collect()
    assert len(rows) == 4 and len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert sharding.shard_records(docs.where("false"), 3).count() == 0


def targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_w = sum(w[s] for s in order if s not in capped)
        out = {s: most * sizes[s] if s in capped else rest * w[s] / open_w for s in order}
        over = {s for s in order if s not in capped and out[s] >= most * sizes[s]}
        if not over:
            return out
        capped |= over


@pytest.mark.parametrize("names", [["a"], ["b", None, "a", "ä", "", "z"]])
def test_mix_meets_its_targets(spark, names):
    ts = texts(400) + AWKWARD
    sources = [names[(i * i) % len(names) if i % 3 else 0] for i in range(len(ts))]
    docs = make_docs(spark, ts, sources=sources).withColumn("h", F.lit(1)).withColumn("block", F.lit("x")).withColumn("__size", F.lit(1)).withColumn("doc", F.lit(2)).withColumn("__source", F.lit("y"))
    rows, table = mixing.mixed(docs)
    rows = rows.collect()
    size, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == len(words(ts[r["doc_id"]])) and 0 <= r["taken"] <= 3 * r["size"] and r["source"] == sources[r["doc_id"]]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    expect = targets({s: size[s] for s in set(sources)})
    for r in rows:
        assert r["target"] == pytest.approx(expect[r["source"]]) and r["source_size"] == size[r["source"]]
    assert all(abs(taken[s] - expect[s]) <= 1 for s in expect)
    again = {r["doc_id"]: r["taken"] for r in mixing.mixed(docs)[0].collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}

    tree = mixing.splitting_tree(table, 3).collect()
    copies = Counter((r["source"], r["block"]) for r in tree)
    want = {(r["source"], r["block"]): r["passes"] + (r["drawn"] > 0) for r in table.collect()}
    assert copies == Counter({k: v for k, v in want.items() if v})
    per = Counter(r["out_shard"] for r in tree)
    assert max(per.values()) - min(per.values()) <= 3

    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    # whole documents, the last one of a source by what is nearer
    expect = Counter({r["doc_id"]: sum(c["words"] * 2 >= r["size"] for c in r["placed"]) for r in rows if r["placed"]})
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == +expect and all(r["text"] == ts[r["doc_id"]] for r in got)


def test_mix_shards_hold_what_is_taken(spark):
    docs = make_docs(spark, texts(200))
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixed(docs)[0].collect()}
    rows = mixing.mix_shards(docs, 2).collect()
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["words"]
    assert got == Counter({k: v for k, v in taken.items() if v}) and {r["out_shard"] for r in rows} <= set(range(4))


def test_mix_of_repeats_nulls_and_nothing(spark):
    docs = make_docs(spark, ["a b c", "a b c", None, ""], [1, 1, None, 2], sources=[None, None, "s", "s"])
    rows = mixing.mixed(docs)[0].collect()
    assert len(rows) == 4 and sum(r["taken"] for r in rows) == 6
    assert mixing.mixed(docs.where("false"))[0].count() == 0 and mixing.mixed_documents(docs.where("false")).count() == 0


def test_op9_and_the_pipeline_draw_through_the_tree(spark, monkeypatch):
    docs = make_docs(spark, texts(200))
    rows, table = mixing.mixed(docs, levels=2)
    tree = mixing.splitting_tree(table, 2).collect()
    rows = rows.collect()
    drawn, leaf = Counter(), Counter()
    for r in rows:
        for c in r["placed"] or []:
            drawn[r["source"], r["block"], c["turn"], c["out_shard"]] += c["words"]
    for r in tree:
        leaf[r["source"], r["block"], r["turn"], r["out_shard"]] += r["quota"]
    assert drawn == +leaf

    whole = {r["doc_id"]: r["taken"] for r in mixing.mix_rows(docs).collect()}
    assert len(whole) == 200 and whole == {r["doc_id"]: r["taken"] for r in rows}
    real = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda *a: real(*a).where("out_shard = 0"))  # leaves that draw nothing take nothing
    some = {r["doc_id"]: r["taken"] for r in mixing.mix_rows(docs).collect()}
    out = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    assert 0 < sum(some.values()) < sum(whole.values()) and set(out) <= {k for k, v in some.items() if v}
    assert sum(abs(out[k] * len(words(texts(200)[k])) - some[k]) for k in some) <= 3 * max(len(words(t)) for t in texts(200))


def test_equal_rows_share_what_is_left_for_them(spark):
    """Forty equal rows without an id: the source's target is met but for a rest of less than one word a row."""
    rows = [(None, "word " * 100, "en", "a", 1)] * 40 + [(i, "word " * 10, "en", "b", 1) for i in range(100)]
    got = mixing.mix_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)).collect()
    assert len(got) == 140
    for source in (True, False):
        own = [r for r in got if (r["doc_id"] is None) == source]
        target = own[0]["target"]
        assert target - len(own) < sum(r["taken"] for r in own) <= target + 1 and all(r["taken"] <= 3 * r["size"] for r in own)
