import itertools
import random

from pyspark.sql import functions as F

from tracewell.llm import minhash
from tracewell.llm.components import connected_components

from .util import AWKWARD, make_docs, prose, words


def shingles(text, size):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    if len(w) < size:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def brute(ids, texts, size, num, den):
    sets = [shingles(t, size) for t in texts]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        common = len(sets[i] & sets[j])
        if sets[i] and sets[j] and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
            root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)]) for i, d in enumerate(ids)}


def near_copies(rng):
    """A hub with near copies of very different distance, copies of copies, and unrelated texts."""
    base = prose(rng, 150)
    texts = [" ".join(base)]
    for _ in range(150):
        source = rng.choice(texts).split() if rng.random() < 0.3 else list(base)
        for _ in range(rng.randrange(0, 14)):
            source[rng.randrange(len(source))] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(source))
    texts += texts[:5] + [" ".join(prose(rng, rng.randrange(1, 80))) for _ in range(30)]
    return texts


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    texts = near_copies(rng) + AWKWARD
    ids = rng.sample(range(10_000), len(texts))
    for size, num in ((3, 85), (5, 80)):
        rows = minhash.near_duplicates(make_docs(spark, texts, ids), size, num, 100).collect()
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
        assert got == brute(ids, texts, size, num, 100)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_nulls_repeats_and_empty_tables(spark):
    docs = make_docs(spark, ["a b c d", "a b c d", None, "q r s t"], [5, 5, None, None])
    rows = sorted((r["doc_id"] is None, r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, 3).collect())
    assert rows[:2] == [(False, 5, True)] * 2 and [r[2] for r in rows] == [True] * 4
    kept = minhash.drop_near_duplicates(docs, 3)
    assert kept.columns == docs.columns and kept.count() == 3
    none = docs.where("false")
    assert minhash.near_duplicates(none).count() == 0 and minhash.drop_near_duplicates(none).count() == 0
    extra = docs.withColumn("set_a", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("bands", F.lit(2))
    assert minhash.near_duplicates(extra, 3).count() == 4
    assert minhash.drop_near_duplicates(extra, 3).columns == extra.columns


def test_connected_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(60)]
    more = [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(500, None), (7, 7)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain + more, "a long, b long")).collect()}
    assert len({found[i] for i in range(61)}) == 1
    for a, b in more[:30]:
        if a != b:
            assert found[a] == found[b]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_large_group_around_the_threshold(spark):
    """Hundreds of near copies of one text, most of them just below or above the threshold, some shortened, some copies of copies."""
    rng = random.Random(11)
    base = prose(rng, 120, 10**6)
    texts = [" ".join(base)]
    for _ in range(500):
        t = rng.choice(texts).split() if rng.random() < 0.1 else list(base)
        for _ in range(rng.choice((1, 2, 3, 3, 4, 4, 5, 8))):
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice(([], [f"z{rng.randrange(10**6)}"], [f"z{rng.randrange(10**6)}"], [t[at], "again"]))
        cut = rng.choice((0, 0, 1, 4, 9))
        texts.append(" ".join(t[: len(t) - cut]))
    ids = rng.sample(range(10_000), len(texts))
    for size, num in ((3, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(make_docs(spark, texts, ids), size, num, 100).collect()}
        assert got == brute(ids, texts, size, num, 100)


def test_large_inner_buckets_get_hubs_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 5)
    rng = random.Random(5)
    texts, ids = near_copies(rng), None
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(make_docs(spark, texts, ids), 3, 85, 100).collect()}
    assert got == brute(range(len(texts)), texts, 3, 85, 100)


def test_rows_that_repeat_an_id(spark):
    text = "a b c d e f g h i j k l m n o p"
    docs = make_docs(spark, [text, text, "p q r s t u v w", "zz yy xx ww vv", text + " q"], [5, 5, 5, 3, 9])
    docs = docs.withColumn("id", F.lit("x")).withColumn("text_key", F.lit(1)).withColumn("doc", F.lit(2)).withColumn("rows", F.lit(3))
    kept = minhash.drop_near_duplicates(docs, 3, 80, 100)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, "zz yy xx ww vv"), (5, text)]
