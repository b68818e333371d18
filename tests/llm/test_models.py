"""Quality, language and toxicity: held-out accuracy and awkward rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import langid, quality, toxicity
from tracewell.llm.folds import isotonic
from tracewell.llm.tokens import PUNCT, Words

from .util import AWKWARD, make_docs

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    values = np.asarray(scores)[order]
    start = 0
    for end in range(1, len(order) + 1):
        if end == len(order) or values[end] != values[start]:
            ranks[order[start:end]] = (start + end + 1) / 2
            start = end
    y = np.asarray(labels)
    return (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def held(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_documents(spark, tables):
    docs, labels = tables
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(r["held_out"] == held(r["doc_id"], 3, 1) for r in rows)
    test = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert auc([r["score"] for r in test], [truth[r["doc_id"]] for r in test]) > 0.95
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in test]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_toxicity_on_held_out_documents(spark, tables):
    docs, labels = tables
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.toxicity_scores(docs, labels).collect()
    test = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) for r in rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in test]) > 0.9
    assert all(r["evidence"] or r["score"] < 0.5 for r in rows)


def test_languages_on_held_out_documents(spark, tables):
    docs, _ = tables
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = langid.predicted_languages(docs).collect()
    test = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in test]) > 0.97


def test_mixed_texts_come_out_as_spans(spark):
    en, el = "the cat sat on the mat and looked at the dog", "η γάτα κάθισε στο χαλί και κοίταξε τον σκύλο"
    docs = make_docs(spark, [en] * 20 + [el] * 20, langs=["en"] * 20 + ["el"] * 20)
    model = langid.fit_languages(docs)
    rows = langid.language_spans(make_docs(spark, [f"{en} {el} {en}", "123 !!", None, "и"]), model).collect()
    by = {r["doc_id"]: r for r in rows}
    assert [(s["lang"], s["words"]) for s in by[0]["spans"]] == [("en", 11), ("el", 9), ("en", 11)]
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == "und" and by[3]["lang_pred"] in ("en", "el")
    kept = langid.in_a_language(make_docs(spark, [en, "123", None, ""]), model)
    assert [r["doc_id"] for r in kept.collect()] == [0]


def test_only_texts_that_learned_languages_explain_stay(spark):
    import random

    clean = {"en": "the cat sat on the mat and looked at the dog", "el": "η γάτα κάθισε στο χαλί και κοίταξε τον σκύλο", "ru": "кошка сидела на ковре и смотрела на большую собаку"}
    model = langid.fit_languages(make_docs(spark, [t for t in clean.values() for _ in range(200)], langs=[k for k in clean for _ in range(200)]))
    rng = random.Random(3)
    noise = " ".join("".join(rng.choice("bcdfgjkqvwxz") for _ in range(rng.randrange(4, 9))) for _ in range(40))
    thai = "แมวนั่งบนพรม และ มองดู สุนัข ตัวใหญ่"
    texts = [*clean.values(), " ".join([clean["en"], clean["el"], clean["ru"]] * 2), noise, thai]
    assert {r["doc_id"] for r in langid.in_a_language(make_docs(spark, texts), model, 0.5).collect()} == {0, 1, 2, 3}


def test_viterbi_matches_plain_dynamic_programming():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 7, 3, 0, 20, 12]
    at = np.concatenate(([0], np.cumsum(sizes)))
    scores = rng.normal(size=(at[-1], 3)).astype(np.float32)
    labels = langid.viterbi(scores, at, 1.5)
    value = lambda s, l: s[np.arange(len(l)), l].sum() - 1.5 * (np.diff(l) != 0).sum()
    for i, n in enumerate(sizes):
        s, l = scores[at[i] : at[i + 1]], labels[at[i] : at[i + 1]]
        if n:
            best = s[0].astype(float)
            for t in range(1, n):
                best = np.maximum(best, best.max() - 1.5) + s[t]
            assert value(s, l) == pytest.approx(best.max(), abs=1e-4)


def test_block_max_search_is_exact():
    """Against dense cosine over all terms of the examples."""
    rng = np.random.default_rng(4)
    n, v = 700, 300
    labels = rng.integers(0, 2, n).astype(float)
    popular = 1 / np.arange(1, v + 1)
    sets = [np.sort(rng.choice(v, rng.integers(0, 25), replace=False, p=popular / popular.sum())) for _ in range(n)]
    example = np.repeat(np.arange(n), [len(t) for t in sets])
    term, count = np.concatenate(sets), rng.integers(1, 5, len(example)).astype(float)
    key = (term * 977 + 13).astype(np.uint64)
    index = toxicity.build_index(np.arange(n) * 10, labels, np.ones(n), example, key, count)
    assert len(index.keys) == len(np.unique(term))
    dense, place = np.zeros((n, len(index.keys))), np.argsort(index.ids)
    for i in range(n):
        own = example == i
        if own.any():
            t = np.searchsorted(index.keys, key[own])
            dense[place[i], t] = index.vector(t, count[own])
            terms, weights = index.example(int(place[i]))
            assert np.allclose(dense[place[i], terms], weights, atol=1e-6) and len(terms) == own.sum()
    for skip in [-1] * 60 + list(range(20)):
        t = np.sort(rng.choice(len(index.keys), rng.integers(1, 30), replace=False))
        q = index.vector(t, rng.integers(1, 5, len(t)).astype(float))
        sims = np.round(dense[:, t] @ q, 6)
        sims[skip] = sims[skip] if skip < 0 else 0
        want = [i for i in np.lexsort((np.arange(n), -sims)) if sims[i] > 0][:10]
        got, s = index.nearest(t, q, 10, skip)
        assert skip not in got and np.allclose(s, sims[want], atol=2e-6) and np.allclose(sims[got], sims[want], atol=2e-6)


def test_toxicity_evidence_is_the_nearest_by_brute_force(spark, tables):
    """Scores and evidence of the whole operator against dense cosine of all examples."""
    docs, labels = (t.where("doc_id < 400") for t in tables)
    base = docs.select("doc_id", "text")
    model = toxicity.fit_toxicity(base, labels.select("doc_id", F.col("toxic").alias("label")))
    index = model.index
    texts = {r["doc_id"]: r["text"] for r in base.collect()}

    def vector(text):
        import pyarrow as pa

        key, count = np.unique(Words(pa.array([text]), PUNCT, lower=True).hashes, return_counts=True)
        known = np.isin(key, index.keys)
        out = np.zeros(len(index.keys))
        at = np.searchsorted(index.keys, key[known])
        out[at] = index.vector(at, count[known]) if known.any() else 0
        return out

    dense = np.array([vector(texts[i]) for i in index.ids.tolist()])
    for r in toxicity.toxicity_evidence(base, model).collect():
        sims = np.sort(dense @ vector(texts[r["doc_id"]]))[::-1]
        found = [e["similarity"] for e in r["evidence"]]
        assert len(found) == min(15, (sims > 1e-6).sum()) and np.allclose(found, sims[: len(found)], atol=3e-6)


def test_models_take_awkward_rows(spark):
    rng = random.Random(0)
    texts = AWKWARD + [" ".join(rng.choice(["good", "text", "stupid"]) for _ in range(30)) for _ in range(20)]
    docs = make_docs(spark, texts + ["again", "again"], [*range(len(texts)), 3, None]).withColumn("stats", F.lit(1)).withColumn("label", F.lit("x")).withColumn("score", F.lit(2))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for found in (quality.quality_scores(docs, labels), toxicity.toxicity_scores(docs, labels), langid.predicted_languages(docs)):
        rows = found.collect()
        assert len(rows) == len(texts) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    none, blank = docs.where("false"), labels.where("false")
    for d, l, n in ((none, labels, 0), (docs, blank, len(texts) + 2)):
        assert quality.quality_scores(d, l).count() == n and toxicity.toxicity_scores(d, l).count() == n
    assert langid.predicted_languages(none).count() == 0
    assert {r["lang_pred"] for r in langid.predicted_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_isotonic():
    y, w = np.array([1.0, 3, 2, 2, 5, 4]), np.array([1.0, 1, 1, 2, 1, 3])
    out = isotonic(y, w)
    assert (np.diff(out) >= -1e-12).all() and np.isclose((out * w).sum(), (y * w).sum())


def test_words_of_long_texts_cross_blocks():
    import pyarrow as pa

    text = "abc " * 400_000 + "x" * 3_000_000 + " abc"
    w = Words(pa.array([text, None, "abc"]), PUNCT, lower=True)
    assert len(w.hashes) == 400_003 and w.hashes[0] == w.hashes[-2] == w.hashes[-1] != w.hashes[400_000]


def term_weights(texts, labels):
    """Weight of every term of the labelled texts, worked out from the texts alone."""
    sets = [set(t.split()) for t in texts]
    n1, n0 = (sum(y == v for y in labels.values()) for v in (1, 0))
    out = {}
    for term in set().union(*(sets[i] for i in labels)):
        df = sum(term in s for s in sets)
        d1, d0 = (sum(term in sets[i] for i, y in labels.items() if y == v) for v in (1, 0))
        shrink = lambda d, n: (d + 50 * n / (n1 + n0)) / n
        contrast = math.log(shrink(d1, n1)) - math.log(shrink(d0, n0))
        out[term] = (math.log((1 + len(texts)) / (1 + df)) + 1) * (0.02 + contrast**2)
    return out


def test_evidence_matches_brute_force_over_texts(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{min(rng.randrange(1, 60), rng.randrange(1, 60))}" for _ in range(rng.randrange(1, 30))) for _ in range(160)]
    texts += texts[:5] + ["unheard", ""]
    labels = {i: int("w7" in texts[i].split() or i % 9 == 0) for i in range(len(texts)) if not held(i, 5, 0) and i % 3}
    rows = toxicity.toxicity_scores(make_docs(spark, texts), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()
    weight = term_weights(texts, labels)

    def unit(text):
        v = {t: (1 + math.log(text.split().count(t))) * weight[t] for t in set(text.split()) if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    units = [unit(t) for t in texts]
    assert len(rows) == len(texts)
    for r in rows:
        mine = units[r["doc_id"]]
        sims = {i: sum(x * units[i].get(t, 0.0) for t, x in mine.items()) for i in labels}
        best = sorted((s for s in sims.values() if s > 1e-6), reverse=True)[: toxicity.NEIGHBOURS]
        assert np.allclose([e["similarity"] for e in r["evidence"]], best, atol=1e-5)
        assert all(abs(sims[e["example"]] - e["similarity"]) < 1e-5 and labels[e["example"]] == e["label"] for e in r["evidence"])


def test_copies_of_examples_find_them_whatever_their_labels(spark):
    text = "the same words under either label"
    docs = make_docs(spark, [text] * 8 + ["others"], ids=list(range(1, 10)))
    known = [i for i in range(1, 9) if not held(i, 5, 0)][:4]
    rows = toxicity.toxicity_scores(docs, spark.createDataFrame([(d, k % 2) for k, d in enumerate(known)], "doc_id long, toxic int")).collect()
    for r in rows:
        assert sorted(e["example"] for e in r["evidence"]) == (known if r["doc_id"] < 9 else [])
        assert all(e["similarity"] == pytest.approx(1, abs=1e-5) for e in r["evidence"])
