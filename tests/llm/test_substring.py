import hashlib
import random

from pyspark.sql import functions as F

from tracewell.llm import substring

from .util import AWKWARD, make_docs, prose, words


def brute(ids, texts, window):
    first, tokens = {}, {}
    for d, t in sorted(zip(ids, texts), key=lambda x: x[0]):
        tokens[d] = w = words(t)
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (d, s))
    out = {}
    for d, w in tokens.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (d, s):
                gone.update(range(s, s + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), kept)
    return out


def repeating(rng):
    shared = [prose(rng, n) for n in (20, 21, 25, 40, 90)]
    texts = []
    for _ in range(60):
        t = []
        for _ in range(rng.randrange(1, 5)):
            t += prose(rng, rng.randrange(0, 40), 5000)
            p = rng.choice(shared)
            cut = rng.randrange(0, 12)
            t += p[cut : len(p) - rng.randrange(0, 6)]
        texts.append(" ".join(t))
    texts += texts[:4] + ["la " * 70, "la " * 45, "a b c " * 30, "b c a " * 30]
    return texts


def test_matches_brute_force(spark):
    rng = random.Random(5)
    texts = repeating(rng) + AWKWARD
    ids = rng.sample(range(1000), len(texts))
    expect = brute(ids, texts, 20)
    rows = substring.without_repeats(make_docs(spark, texts, ids), 20).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows} == expect
    rows = substring.without_repeats(make_docs(spark, texts, ids), 20, digest=True).collect()
    assert {r["doc_id"]: r["kept"] for r in rows} == {d: hashlib.sha256(e[2].encode()).hexdigest() for d, e in expect.items()}


def test_long_references_are_compared_by_hash(spark, monkeypatch):
    rng = random.Random(6)
    texts = repeating(rng)
    ids = list(range(len(texts)))
    monkeypatch.setattr(substring, "LONGEST_REFERENCE", 60)
    rows = substring.without_repeats(make_docs(spark, texts, ids), 20).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows} == brute(ids, texts, 20)


def test_nulls_and_empty_tables(spark):
    t = " ".join(f"w{i}" for i in range(30))
    docs = make_docs(spark, [t, t, t, None], [None, 3, 9, None]).withColumn("pieces", F.lit(1)).withColumn("start", F.lit(2))
    rows = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring.without_repeats(docs).collect())
    assert rows == [(-1, 0), (-1, 0), (3, 0), (9, 30)]
    assert substring.without_repeats(docs.where("false")).count() == 0


def test_automaton_finds_first_windows():
    rng = random.Random(2)
    for _ in range(50):
        ref = [rng.choice("ab") for _ in range(rng.randrange(1, 40))]
        query = [rng.choice("abc") for _ in range(rng.randrange(1, 40))]
        n = rng.randrange(1, 6)
        found = substring.SuffixAutomaton(ref).first_windows(query, n)
        where = lambda w: next((i for i in range(len(ref) - n + 1) if ref[i : i + n] == w), -1)
        assert found == [where(query[i : i + n]) for i in range(len(query) - n + 1)]


def test_every_text_of_a_repeated_id_is_a_source(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(30)) for k in "ab")
    rows = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b)], "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_removed"]) for r in substring.without_repeats(rows, 20).collect())
    assert got == [(1, 0), (1, 0), (2, 30), (3, 30)]
    moved = spark.createDataFrame([(1, "x " * 5 + a), (1, a), (2, a)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.without_repeats(moved, 20).collect())
    assert got == [(1, 30, 0), (1, 35, 0), (2, 30, 30)]  # what rows of one id share stays
