import random

from pyspark.sql import functions as F

from tracewell.llm import decontam

from .util import AWKWARD, make_docs, prose


def planted(rng):
    items = [" ".join(prose(rng, n, 100_000)) for n in (3, 8, 19, 20, 30, 60)]
    texts, expect = [], set()
    for d in range(60):
        t = prose(rng, rng.randrange(0, 200), 100_000)
        if d % 3 == 0:
            k = rng.randrange(len(items))
            p = items[k].split()
            for at in rng.sample(range(len(p)), len(p) // 10):
                p[at] = "changed"
            at = rng.randrange(len(t) + 1)
            t[at:at] = [x.upper() + "," for x in p]
            expect.add((d, k))
        texts.append(" ".join(t))
    return items, texts, expect


def test_both_ways_find_what_was_planted(spark):
    rng = random.Random(8)
    items, texts, expect = planted(rng)
    docs = make_docs(spark, texts + AWKWARD).withColumn("seed", F.lit(1)).withColumn("item_id", F.lit(5))
    bench = spark.createDataFrame([*enumerate(items), (None, items[0]), (99, None), (98, "")], "item_id long, text string")
    for limit in (decontam.BROADCAST_TOKENS, 0):
        rows = decontam.contaminated(docs, bench, broadcast_tokens=limit).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == expect
        assert all(5 * r["n_matched"] >= 4 * r["n_tokens"] for r in rows)
        left = decontam.decontaminated(docs, bench, broadcast_tokens=limit)
        assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(range(len(texts) + len(AWKWARD))) - {d for d, _ in expect}


def test_overlap_against_brute_force():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        doc, item = rng.integers(0, 3, 30).astype(np.uint64), rng.integers(0, 3, rng.integers(1, 25)).astype(np.uint64)
        d = int(rng.integers(-5, 30))
        need = min(6, len(item))
        best = None
        for a in range(len(item) - need + 1):
            if d + a >= 0 and d + a + need <= len(doc):
                m = int((doc[d + a : d + a + need] == item[a : a + need]).sum())
                best = m if best is None else max(best, m)
        found = decontam.overlap(doc, item, d, 6, 80)
        assert (found is not None) == (best is not None and best * 100 >= 80 * need)
        if found:
            assert found[2] * 100 >= 80 * found[1] and found[1] >= need


def test_empty_tables(spark):
    docs, bench = make_docs(spark, ["a b c"]), spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs, bench).count() == 0 and decontam.decontaminated(docs, bench).count() == 1
    assert decontam.contaminated(docs.where("false"), bench).count() == 0


def test_every_tolerated_overlap_leaves_a_seed():
    from itertools import combinations

    for n in range(1, 15):
        need = min(n, decontam.LEAST_TOKENS)
        spare = need - -(-decontam.LEAST_PERCENT * need // 100)
        for gone in combinations(range(need), spare):
            kept = set(range(need)) - set(gone)
            masks = decontam.shapes(n, decontam.LEAST_TOKENS, decontam.LEAST_PERCENT)
            assert any({at + i for i, c in enumerate(m) if c == "1"} <= kept for m in masks for at in range(need - len(m) + 1)), (n, gone)


def test_both_ways_judge_rows_and_see_damaged_short_items(spark):
    from collections import Counter
    from itertools import combinations

    items = [" ".join(f"i{n}x{k}" for k in range(n)) for n in range(1, 13)]
    texts, ids, hit = [], [], []
    for n, item in enumerate(items, 1):
        for gone in combinations(range(n), n - -(-80 * n // 100)):
            texts.append("so " + " ".join("other" if k in gone else w for k, w in enumerate(item.split())) + " on")
            hit.append(n)
            ids.append(None if len(ids) % 3 == 0 else len(ids) // 2)
    texts, ids = texts + ["quite clean"] * 3, ids + [None, ids[1], 10_000]
    docs = make_docs(spark, texts, ids)
    bench = spark.createDataFrame([*enumerate(items, 1), (5, "nothing like it")], "item_id long, text string")
    for limit in (decontam.BROADCAST_TOKENS, 0):
        rows = decontam.contaminated(docs, bench, broadcast_tokens=limit).collect()
        assert Counter((r["doc_id"], r["item_id"]) for r in rows) == Counter(zip(ids, hit))
        left = decontam.decontaminated(docs, bench, broadcast_tokens=limit)
        assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter((i, "quite clean") for i in ids[-3:])
