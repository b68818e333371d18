"""Skip-gram word vectors with negative samples, trained side by side.

The corpus is cut into parts of bounded size.  In every round each part trains
the vectors of its own words and of the words that negatives are drawn from, and
a word's new vectors are the mean of its parts', weighted by how often each part
has it.  No part ever needs the vectors of words that it doesn't have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import dense_index
from .store import cut, discard

#: Negatives are drawn from so many words, themselves drawn by frequency to the power 3/4; a smaller vocabulary is taken whole.
NEGATIVE_WORDS = 20_000
#: Learning rate at first and in the end.
RATES = (0.025, 0.0001)


def window_pairs(ids: np.ndarray, sentence: np.ndarray, window: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(centre, neighbour) of all words at most a drawn distance, 1 to window, apart in one sentence, in drawn order."""
    reach = rng.integers(1, window + 1, len(ids))
    centre, other = [], []
    for d in range(1, min(window, len(ids) - 1) + 1):
        same = sentence[d:] == sentence[:-d]
        for mine, near in ((slice(None, -d), slice(d, None)), (slice(d, None), slice(None, -d))):
            keep = same & (reach[mine] >= d)
            centre.append(ids[mine][keep])
            other.append(ids[near][keep])
    if not centre:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = rng.permutation(sum(map(len, centre)))
    return np.concatenate(centre)[order], np.concatenate(other)[order]


def train_part(ids: np.ndarray, sentence: np.ndarray, inner: np.ndarray, outer: np.ndarray, chances: np.ndarray, window: int, negative: int, rates: list[float], rng: np.random.Generator) -> None:
    """Train both vector tables in place, an epoch for each rate; negatives come by their cumulated chances."""

    def push(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    step = max(8, min(256, len(inner) // 4))  # few words of a step are the same
    for rate in rates:
        centre, other = window_pairs(ids, sentence, window, rng)
        for at in range(0, len(centre), step):
            c, o = centre[at : at + step], other[at : at + step]
            drawn = np.minimum(np.searchsorted(chances, rng.random((len(c), negative)), "right"), len(chances) - 1)
            v, u, w = inner[c], outer[o], outer[drawn]
            up = (rate * (1 - push(np.einsum("ij,ij->i", v, u))))[:, None]
            down = np.where(drawn == o[:, None], 0, -rate * push(np.einsum("ij,ikj->ik", v, w)))
            np.add.at(inner, c, up * u + np.einsum("ik,ikj->ij", down, w))
            np.add.at(outer, o, up * v)
            np.add.at(outer, drawn.ravel(), (down[:, :, None] * v[:, None, :]).reshape(-1, v.shape[1]))


def skip_gram(corpus: DataFrame, dim: int, window: int, min_count: int, epochs: int, negative: int, seed: int, partitions: int, rounds: int) -> DataFrame:
    """(word, vector) of the corpus (msg, tokens), whose messages differ.

    Parts and draws depend on the messages and the seed alone, so runs agree but
    for the last digits.  Words rarer than ``min_count`` are left out of texts.
    """
    rounds = 1 if partitions == 1 else max(1, min(rounds, epochs))
    counts = corpus.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    words = cut(dense_index(counts.withColumn("__neg", -F.col("n")), ["__neg", "word"], "id").drop("__neg"))
    part = F.pmod(F.xxhash64("msg", F.lit(seed)), F.lit(partitions)).cast("int").alias("part")
    flat = corpus.select(part, "msg", F.posexplode("tokens").alias("pos", "word")).join(words.select("word", "id"), "word")
    texts = cut(flat.groupBy("part", "msg").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids")))
    # the words with the earliest arrivals, when each arrives at a rate of its chance
    arrival = -F.log((F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) + 1) / float(1 << 40)) / F.pow("n", F.lit(0.75))
    pool = cut(words.orderBy(arrival, "id").limit(NEGATIVE_WORDS).select("id", F.pow("n", F.lit(0.75)).alias("chance")))
    own = texts.select("part", F.explode("ids").alias("id")).groupBy("part", "id").agg(F.count("*").cast("double").alias("weight"))
    every = texts.select("part").distinct().crossJoin(pool.select("id", "chance"))  # parts times a pool of bounded size
    needed = cut(own.join(every, ["part", "id"], "full_outer").select("part", "id", F.coalesce("weight", F.lit(1e-3)).alias("weight"), F.coalesce("chance", F.lit(0.0)).alias("chance")))
    fresh = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: ((F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0 - 0.5) / dim).cast("float"))
    vectors = cut(words.select("id", fresh.alias("inner"), F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.lit(0.0).cast("float")).alias("outer")))
    first, last = RATES
    rates = [first + (last - first) * e / max(1, epochs - 1) for e in range(epochs)]
    out = pa.schema([("id", pa.int64()), ("weight", pa.float64()), ("inner", pa.list_(pa.float32())), ("outer", pa.list_(pa.float32()))])

    def trainer(number: int):
        mine = rates[number * epochs // rounds : (number + 1) * epochs // rounds]

        def run(key: tuple, text: pa.Table, known: pa.Table) -> pa.Table:
            known, text = known.sort_by("id").combine_chunks(), text.sort_by("msg").combine_chunks()
            ids = known.column("id").to_numpy()
            inner, outer = (np.array(known.column(c).combine_chunks().flatten()).reshape(-1, dim).copy() for c in ("inner", "outer"))
            lists = text.column("ids").to_pylist()
            flat_ids = np.searchsorted(ids, np.array([i for x in lists for i in x], np.int64))
            sentence = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            chances = np.cumsum(known.column("chance").to_numpy())
            rng = np.random.default_rng([seed & 0x7FFFFFFF, number, key[0].as_py()])
            train_part(flat_ids, sentence, inner, outer, chances / chances[-1], window, negative, mine, rng)
            packed = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float32())) for x in (inner, outer)]
            return pa.table([pa.array(ids), known.column("weight"), *packed], schema=out)

        return run

    for number in range(rounds):
        told = needed.join(vectors, "id").select("part", "id", "weight", "chance", "inner", "outer")
        trained = texts.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(trainer(number), "id long, weight double, inner array<float>, outer array<float>")
        # a word has a row for each part at most
        rows = trained.groupBy("id").agg(F.sum("weight").alias("total"), F.collect_list(F.struct("weight", "inner", "outer")).alias("rows"))

        def mean(side: str):
            zero = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.lit(0.0))
            return F.transform(F.aggregate("rows", zero, lambda s, r: F.zip_with(s, r[side], lambda a, b: a + b * r["weight"])), lambda x: (x / F.col("total")).cast("float")).alias(side)

        before, vectors = vectors, cut(rows.select("id", mean("inner"), mean("outer")))
        discard(before)
    return words.join(vectors, "id").select("word", F.col("inner").cast("array<double>").alias("vector"))
