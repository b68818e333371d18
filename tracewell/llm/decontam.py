"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive tokens; positions marked 0 are ignored,
so a substitution there doesn't hide a hit.  Seeds of training texts are looked
up among those of the test items; around each hit the two texts are laid over
each other along its diagonal and compared token by token.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, stored
from .tokens import PUNCT, U64, Words, mix, slices

#: Fixed masks; 1: the token counts, 0: it is ignored.
MASKS = ("1110111", "110110011", "1011010011", "11100001011")
#: Overlap that counts: so many tokens of the item (all, if it has fewer) ...
LEAST_TOKENS = 13
#: ... of which so many hundredths agree.
LEAST_PERCENT = 80
#: Benchmarks of no more tokens are broadcast; larger ones are joined by their seeds.
BROADCAST_TOKENS = 2_000_000

HIT_SCHEMA = "doc_id long, item_id long, start_word long, n_tokens int, n_matched int"


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The seed of each position that has all of the mask's span ahead."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, MASKS.index(mask) + 1 if mask in MASKS else 99, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = out * U64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return mix(out, len(mask))


@lru_cache(maxsize=None)
def shapes(n: int, least: int, percent: int) -> tuple[str, ...]:
    """Masks of which one fits every tolerated overlap with an item of ``n`` tokens.

    These are ``MASKS`` where they leave no pattern of substitutions out, which
    is enumerated for overlaps of up to 16 tokens.  Otherwise they are runs: k
    substitutions among w tokens leave a run of at least (w - k) / (k + 1).
    """
    need = min(n, least)
    if need == 0:
        return ()
    spare = need - -(-percent * need // 100)
    fitting = tuple(m for m in MASKS if len(m) <= need)
    places = [{at + i for i, c in enumerate(m) if c == "1"} for m in fitting for at in range(need - len(m) + 1)]
    if need <= 16 and places and all(any(not p & set(gone) for p in places) for gone in combinations(range(need), spare)):
        return MASKS
    return ("1" * max(1, -(-(need - spare) // (spare + 1))),)


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, least: int, percent: int) -> tuple[int, int, int] | None:
    """The best stretch of the item laid over the document with its token 0 at ``diagonal``: (start in doc, tokens, matches)."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    need = min(least, len(item))
    if hi - lo < need or need == 0:
        return None
    same = (doc[diagonal + lo : diagonal + hi] == item[lo:hi]).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(same)))
    scores = total[need:] - total[:-need]
    best = int(scores.argmax())
    if scores[best] * 100 < percent * need:
        return None
    # widen to the whole stretch that keeps the share
    end = best + need
    while end < hi - lo and (total[end + 1] - total[best]) * 100 >= percent * (end + 1 - best):
        end += 1
    while best > 0 and (total[end] - total[best - 1]) * 100 >= percent * (end - best + 1):
        best -= 1
    return diagonal + lo + best, end - best, int(total[end] - total[best])


class Benchmark:
    """Items' token hashes and their seeds, in arrays; small enough to be broadcast."""

    def __init__(self, ids: list[int], texts: list[str | None], least: int, percent: int):
        words = Words(pa.array(texts, pa.large_string()), PUNCT, lower=True)
        self.ids = ids
        self.items = [words.hashes[words.at[i] : words.at[i + 1]].copy() for i in range(len(ids))]
        self.masks: dict[str, None] = {}
        keys, items, places = [], [], []
        for i, item in enumerate(self.items):
            for mask in shapes(len(item), least, percent):
                self.masks.setdefault(mask)
                found = seeds(item, mask)
                keys.append(found)
                items.append(np.full(len(found), i))
                places.append(np.arange(len(found)))
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.item = (np.concatenate(items) if items else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(places) if places else np.zeros(0, np.int64))[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> U64(44)).astype(np.int64)] = True

    def search(self, words: Words, least: int, percent: int) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, tokens, matches) of every row and item that overlap; the best of each pair."""
        rows, hits = words.word_rows(), set()
        for mask in self.masks:
            found = seeds(words.hashes, mask)
            at = np.flatnonzero(self.maybe[(found >> U64(44)).astype(np.int64)])
            if not len(at) or not len(self.keys):
                continue
            at = at[rows[at] == rows[at + len(mask) - 1]]
            first = np.searchsorted(self.keys, found[at], "left")
            last = np.searchsorted(self.keys, found[at], "right")
            for p, f, t in zip(at[last > first].tolist(), first[last > first].tolist(), last[last > first].tolist()):
                r = int(rows[p])
                for j in range(f, t):
                    hits.add((r, int(self.item[j]), p - int(words.at[r]) - int(self.place[j])))
        best: dict[tuple[int, int], tuple[int, ...]] = {}
        for r, i, diagonal in sorted(hits):
            found = overlap(words.hashes[words.at[r] : words.at[r + 1]], self.items[i], diagonal, least, percent)
            key = r, self.ids[i]
            if found and (key not in best or (found[2], -found[0], -found[1]) > best[key][:3]):
                best[key] = (found[2], -found[0], -found[1], i)
        return [(r, i, -start, -n, same) for (r, _), (same, start, n, i) in sorted(best.items())]


def _benchmark(items: DataFrame, id_col: str, text_col: str, limit: int, least: int, percent: int) -> Benchmark | None:
    """The benchmark for broadcasting, or None if it has too many tokens."""
    named = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    size = named.agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).first()
    if (size["n"] or 0) > 8 * limit or size["rows"] > limit:
        return None
    rows = sorted(((r["id"], r["text"]) for r in named.collect()), key=lambda r: (r[0], r[1] or ""))
    return Benchmark([r[0] for r in rows], [r[1] for r in rows], least, percent)


def _found(words: Words, bench: Benchmark, ids: pa.Array, least: int, percent: int) -> pa.RecordBatch:
    hits = bench.search(words, least, percent)
    cols = list(zip(*hits)) if hits else [[]] * 5
    take = ids.take(pa.array(cols[0], pa.int64()))
    return pa.RecordBatch.from_arrays([take, pa.array([bench.ids[i] for i in cols[1]], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32())], names=["doc_id", "item_id", "start_word", "n_tokens", "n_matched"])


def contaminated(docs: DataFrame, items: DataFrame, least: int = LEAST_TOKENS, percent: int = LEAST_PERCENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(doc_id, item_id, start_word, n_tokens, n_matched): documents and the items they overlap.

    Tokens are lower-case runs of letters and digits.  An overlap is a stretch
    of ``least`` tokens of the item (all, if it has fewer), laid over the
    document without gaps, of which ``percent`` hundredths agree; the longest
    extension that keeps the share is returned, one row per document row and
    item (repeated item ids count by their best row).  Null or empty texts
    overlap with nothing; documents with a null id are searched and returned
    with it; items with a null id are ignored.

    A benchmark of no more than ``broadcast_tokens`` tokens goes to every task;
    a larger one is joined to the documents by seeds, and each pair is verified.
    """
    base = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bench = _benchmark(items, item_col, item_text_col, broadcast_tokens, least, percent)
    if bench is None:
        base = stored(base.withColumn("__row", F.monotonically_increasing_id()), "docs")
        return _joined(base, items, least, percent, item_col, item_text_col).drop("__row")
    shared = docs.sparkSession.sparkContext.broadcast(bench)

    def run(batches):
        for batch in slices(batches, "text"):
            yield _found(Words(batch.column(1), PUNCT, lower=True), shared.value, batch.column(0), least, percent)

    return base.mapInArrow(run, HIT_SCHEMA)


def _joined(base: DataFrame, items: DataFrame, least: int, percent: int, item_col: str, item_text_col: str) -> DataFrame:
    """``contaminated`` with the ``__row`` of each document row; base: (doc_id, text, __row), stored, so that rows keep their keys."""
    named = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("item")).where("item_id is not null")
    named = stored(named.withColumn("__item", F.monotonically_increasing_id()), "items")

    def item_seeds(batches):
        for batch in slices(batches, "item"):
            words = Words(batch.column(1), PUNCT, lower=True)
            for i, key in enumerate(batch.column(0).to_pylist()):
                hashes = words.hashes[words.at[i] : words.at[i + 1]]
                for mask in shapes(len(hashes), least, percent):
                    found = np.unique(seeds(hashes, mask)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key)), pa.array(found), pa.array([mask] * len(found), pa.string())], names=["__item", "seed", "mask"])

    theirs = stored(named.select("__item", "item").mapInArrow(item_seeds, "__item long, seed long, mask string"), "seeds")
    # no more than some for each length of up to ``least`` tokens
    masks = [r["mask"] for r in theirs.select("mask").distinct().collect()]

    def doc_seeds(batches):
        for batch in slices(batches, "text"):
            words = Words(batch.column(1), PUNCT, lower=True)
            rows = words.word_rows()
            keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for mask in masks:
                found = seeds(words.hashes, mask)
                inside = rows[: len(found)] == rows[len(mask) - 1 :][: len(found)]
                keys.append(found[inside])
                ids.append(rows[: len(found)][inside])
            pairs = pd.DataFrame({"k": np.concatenate(keys).view(np.int64), "r": np.concatenate(ids)}).drop_duplicates()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs["r"])), pa.array(pairs["k"])], names=["__row", "seed"])

    ours = base.select("__row", "text").mapInArrow(doc_seeds, "__row long, seed long")
    pairs = ours.join(theirs.select("__item", "seed"), "seed").select("__row", "__item").distinct()

    def verify(batches):
        for batch in batches:
            parts = []
            for row, d, t, i, u in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                one = Benchmark([i], [u], least, percent)
                found = one.search(Words(pa.array([t], pa.large_string()), PUNCT, lower=True), least, percent)
                parts += [(row, d, i, *x[2:]) for x in found]
            cols = list(zip(*parts)) if parts else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.int32()] * 2)], names=["__row", "doc_id", "item_id", "start_word", "n_tokens", "n_matched"])

    both = pairs.join(base, "__row").join(named, "__item").select("__row", "doc_id", "text", "item_id", "item")
    found = both.mapInArrow(verify, f"__row long, {HIT_SCHEMA}")
    # the best row of a repeated item id
    best = F.max(F.struct("n_matched", (-F.col("start_word")).alias("start"), (-F.col("n_tokens")).alias("n"))).alias("b")
    found = found.groupBy("__row", "doc_id", "item_id").agg(best)
    return found.select("__row", "doc_id", "item_id", (-F.col("b.start")).alias("start_word"), (-F.col("b.n")).alias("n_tokens"), F.col("b.n_matched").alias("n_matched"))


def decontaminated(docs: DataFrame, items: DataFrame, least: int = LEAST_TOKENS, percent: int = LEAST_PERCENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """The documents that overlap with no item, all columns as they are."""
    bench = _benchmark(items, item_col, item_text_col, broadcast_tokens, least, percent)
    if bench is None:
        keyed = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "docs")
        base = keyed.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), "__row")
        bad = _joined(base, items, least, percent, item_col, item_text_col).select("__row").distinct()
        return keyed.join(bad, "__row", "left_anti").select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(bench)

    def run(batches):
        for batch in slices(batches, text_col):
            words = Words(batch.column(batch.schema.get_field_index(text_col)), PUNCT, lower=True)
            bad = sorted({h[0] for h in shared.value.search(words, least, percent)})
            keep = np.ones(len(batch), bool)
            keep[bad] = False
            yield batch.filter(pa.array(keep))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
