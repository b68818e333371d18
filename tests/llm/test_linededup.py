import random

import numpy as np

from pyspark.sql import functions as F

from tracewell.llm import linededup

from .util import AWKWARD, make_docs, prose, words


def within_one(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    long_, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def brute(ids, texts, least):
    lines, out = [], {}
    for d, t in zip(ids, texts):
        for i, line in enumerate(t.split("\n") if t else []):
            lines.append((d, i, words(line), line))
    lines.sort(key=lambda x: x[:2])
    gone = set()
    for k, (d, i, w, _) in enumerate(lines):
        for e, j, v, _ in lines[:k]:
            if w and v and (w == v or (min(len(w), len(v)) >= least and within_one(w, v))):
                gone.add((d, i))
                break
    for d, t in zip(ids, texts):
        own = [(i, line) for e, i, _, line in lines if e == d]
        out[d] = (len(own), sum((d, i) in gone for i, _ in own), "\n".join(line for i, line in own if (d, i) not in gone))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(7)
    pool = [prose(rng, rng.randrange(1, 14), 60) for _ in range(60)]
    texts = []
    for _ in range(50):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            line = list(rng.choice(pool))
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(len(line) + 1)
                line[at : at + rng.randrange(0, 2)] = [f"w{rng.randrange(60)}"] * rng.randrange(0, 2)
            lines.append(" ".join(line))
        texts.append("\n".join(lines))
    texts += ["a a b b c c d\na a b c c d\n\n  \n", "a a b b c c d"] + AWKWARD
    ids = rng.sample(range(1000), len(texts))
    rows = linededup.without_near_lines(make_docs(spark, texts, ids)).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept"]) for r in rows} == brute(ids, texts, linededup.LEAST_WORDS)


def test_nulls_repeats_and_empty_tables(spark):
    line = "one two three four five six seven"
    docs = make_docs(spark, [line, line, line, None], [None, 4, 4, 8]).withColumn("key", F.lit(1)).withColumn("line", F.lit(2))
    rows = sorted((r["doc_id"] or -1, r["n_lines"], r["n_removed"]) for r in linededup.without_near_lines(docs).collect())
    assert rows == [(-1, 1, 0), (4, 1, 0), (4, 1, 0), (8, 0, 0)]
    assert linededup.without_near_lines(docs.where("false")).count() == 0


def test_within_one_edit_is_the_edit_distance():
    rng = random.Random(2)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    for _ in range(3000):
        a = [rng.randrange(3) for _ in range(rng.randrange(7))]
        b = list(a) if rng.random() < 0.7 else [rng.randrange(3) for _ in range(rng.randrange(7))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(3)] * rng.randrange(2)
        assert linededup.within_one_edit(np.array(a, int), np.array(b, int)) == (distance(a, b) <= 1)


def test_texts_are_shuffled_once(spark):
    """Joins of texts with lists of lines read buckets: whatever the lists' size, no exchange lies above the texts."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = linededup.without_near_lines(make_docs(spark, ["a b c d e f g\na b c d e f g", "a b c d e f h", None], [1, 2, None]))
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in rows) == [(-1, 0), (1, 1), (2, 1)]
    line = next(x for x in plan.split("\n") if "FileScan" in x and "text" in x and "Bucketed: true" in x)
    above = plan.split("\n")[: plan.split("\n").index(line)]
    depth = lambda x: len(x) - len(x.lstrip(" :|+-"))
    level, parents = depth(line), []
    for x in reversed(above):
        if depth(x) < level:
            parents.append(x)
            level = depth(x)
    assert not any("Exchange" in x for x in parents)
