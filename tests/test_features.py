"""Word vectors: planted synonyms must find each other, however the corpus is cut."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import features, skipgram

TOPICS = 12


def planted(spark):
    """Texts of words that keep to their topic; in each topic two words, a and b, stand in one place, never together."""
    rng = random.Random(3)
    rows = []
    for i in range(2400):
        t = i % TOPICS
        words = [f"t{t}w{rng.randrange(4)}" for _ in range(5)] + [f"t{t}{rng.choice('ab')}", f"common{rng.randrange(3)}"]
        rng.shuffle(words)
        rows.append((f"{i} " + " ".join(words), words))
    return spark.createDataFrame(rows, "msg string, tokens array<string>").repartition(4)


@pytest.mark.parametrize("partitions", [1, 8])
def test_synonyms_are_near(spark, partitions):
    got = features.train_word_vectors(planted(spark), dim=24, epochs=24, seed=1, partitions=partitions, rounds=8).collect()
    vectors = {r["word"]: np.array(r["vector"]) for r in got}
    assert len(vectors) == TOPICS * 6 + 3 and all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in vectors.values())
    close = [vectors[f"t{t}a"] @ vectors[f"t{t}b"] for t in range(TOPICS)]
    far = [vectors[f"t{t}a"] @ vectors[f"t{(t + k) % TOPICS}b"] for t in range(TOPICS) for k in range(1, TOPICS)]
    assert min(close) > 0.7 and np.mean(close) - np.mean(far) > 0.5
    best = [max((f"t{s}b" for s in range(TOPICS)), key=lambda w: vectors[w] @ vectors[f"t{t}a"]) for t in range(TOPICS)]
    assert best == [f"t{t}b" for t in range(TOPICS)]


def test_pairs_of_a_window():
    rng = np.random.default_rng(0)
    ids, sentence = np.array([5, 6, 7, 8, 9]), np.array([0, 0, 0, 1, 1])
    seen = set()
    for _ in range(200):
        seen |= set(zip(*(x.tolist() for x in skipgram.window_pairs(ids, sentence, 2, rng))))
    assert seen == {(5, 6), (6, 5), (6, 7), (7, 6), (5, 7), (7, 5), (8, 9), (9, 8)}
    assert len(skipgram.window_pairs(ids[:1], sentence[:1], 2, rng)[0]) == 0


def test_rare_words_and_no_texts(spark):
    corpus = spark.createDataFrame([("a b", ["a", "b"]), ("a c", ["a", "c"]), ("d", ["d"]), ("", [])], "msg string, tokens array<string>")
    assert {r["word"] for r in features.train_word_vectors(corpus, dim=4, epochs=1, min_count=2).collect()} == {"a"}
    assert {r["word"] for r in features.train_word_vectors(corpus, dim=4, epochs=2, partitions=3).collect()} == {"a", "b", "c", "d"}
    assert features.train_word_vectors(corpus.where(F.lit(False)), dim=4, epochs=1).count() == 0
