"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The index holds all terms of a bounded sample of labelled examples.  A term
weighs its inverse document frequency among all documents, times how much the
examples' labels depend on it; terms that don't depend on them keep a least
weight, so no term is left out and copies of an example always find it.  The
cosine is that of the terms that the index holds.  Like examples stand in one
block, and for each term and block the index knows the greatest weight, so
blocks whose bound is below the k-th best similarity are skipped without
changing the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold, isotonic
from .store import bounded_batches, cut, stored
from .tokens import PUNCT, U64, Words, slices

#: Labelled examples of either label that the index takes at most (those of least hash): the documented bound of the sample.
EXAMPLES = 2000
NEIGHBOURS = 15
BLOCK = 64
#: Blocks that are searched before any is skipped.
FIRST = 3
#: A term's labels are shrunk by so many examples in which it is as common under either label.
PRIOR = 50.0
#: What a term weighs, as a share of its idf, if both labels have it equally often.
NEUTRAL = 0.02
#: Bins of votes for calibration.
BINS = 20


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of every range, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class BlockMaxIndex:
    """Examples as unit vectors, their postings by term and place, and groups of postings by term and block."""

    keys: np.ndarray  # sorted hashes of all terms of the examples
    term_weight: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    stands: np.ndarray  # how many labelled documents an example stands for
    places: np.ndarray  # of postings, by term and place
    weights: np.ndarray
    group_at: np.ndarray  # term -> its first group
    group_block: np.ndarray
    group_max: np.ndarray
    group_start: np.ndarray  # group -> its first posting

    def coded(self, row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) of the terms that the index knows, by row and term."""
        n = max(len(self.keys), 1)
        at = np.searchsorted(self.keys, key)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == key[known]
        code, count = np.unique(row[known] * n + at[known], return_counts=True)
        return code // n, code % n, count

    def vector(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = (1 + np.log(count)) * self.term_weight[term]
        norm = np.linalg.norm(w)
        return w / norm if norm > 0 else w

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar examples (similarity above 0; ties by place) and their similarities."""
        n = self.group_at[term + 1] - self.group_at[term]
        group, factor = _ranges(self.group_at[term], n), np.repeat(weight, n)
        block = self.group_block[group]
        bound = np.bincount(block, self.group_max[group] * factor, -(-len(self.ids) // BLOCK)) * (1 + 1e-5)
        order = np.argsort(-bound, kind="stable")
        open_ = np.zeros(len(bound), bool)
        open_[order[:FIRST]] = True
        scores, least = np.zeros(len(self.ids)), 0.0
        for turn in range(2):
            own = open_[block]
            g = group[own]
            size = self.group_start[g + 1] - self.group_start[g]
            at = _ranges(self.group_start[g], size)
            scores += np.bincount(self.places[at], self.weights[at] * np.repeat(factor[own], size), len(self.ids))
            if turn == 0:
                if skip >= 0:
                    scores[skip] = 0
                if len(scores) > k:
                    least = np.partition(scores, -k)[-k]
                open_ = (bound > 0) & (bound >= least - 2e-6) & ~open_
        if skip >= 0:
            scores[skip] = 0
        scores = np.round(scores, 6)
        found = np.flatnonzero(scores > 0)
        best = found[np.lexsort((found, -scores[found]))[:k]]
        return best, scores[best]

    def vote(self, at: np.ndarray, similarity: np.ndarray) -> float:
        """Share of label 1 among the neighbours, weighed by similarity and by what each stands for; -1 without neighbours."""
        w = similarity**2 * self.stands[at]
        return float((w * self.labels[at]).sum() / w.sum()) if len(at) else -1.0

    def example(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of an example."""
        at = np.flatnonzero(self.places == place)
        groups = np.searchsorted(self.group_start, at, "right") - 1
        return np.searchsorted(self.group_at, groups, "right") - 1, self.weights[at].astype(np.float64)


def build_index(ids: np.ndarray, labels: np.ndarray, stands: np.ndarray, example: np.ndarray, key: np.ndarray, count: np.ndarray, frequency: dict | None = None, total: int = 0) -> BlockMaxIndex:
    """Index examples by their terms: (example, key, count) are parallel, example is a position in ``ids``.

    frequency (keys, documents): in how many of ``total`` documents terms occur;
    without it, the examples are counted.
    """
    keys, term = np.unique(key, return_inverse=True)
    n1, n0 = float((labels == 1).sum()), float((labels == 0).sum())
    d1, d0 = (np.bincount(term, labels[example] == y, len(keys)) for y in (1, 0))
    contrast = np.ones(len(keys))
    if n1 and n0:
        contrast = np.abs(np.log((d1 + PRIOR * n1 / (n1 + n0)) / n1) - np.log((d0 + PRIOR * n0 / (n1 + n0)) / n0))
    df, n = (d1 + d0, len(ids)) if frequency is None else (frequency, total)
    weight = (np.log((1 + n) / (1 + df)) + 1) * (NEUTRAL + contrast**2)
    w = (1 + np.log(count)) * weight[term]
    norm = np.sqrt(np.bincount(example, w * w, len(ids)))
    w = w / np.where(norm > 0, norm, 1)[example]
    # like examples stand together: by their most common term (so by language), then by their heaviest one
    common, heavy = np.full(len(ids), -1), np.full(len(ids), -1)
    for to, by in ((common, df[term]), (heavy, w)):
        order = np.argsort(by, kind="stable")
        to[example[order]] = term[order]
    order = np.lexsort((ids, heavy, common))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    at = np.lexsort((place[example], term))
    places, term, w = place[example][at], term[at], w[at].astype(np.float32)
    block = places // BLOCK
    new = np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1]))) if len(term) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    most = np.maximum.reduceat(w, start) if len(start) else np.zeros(0, np.float32)
    return BlockMaxIndex(keys, weight, ids[order], labels[order], stands[order], places, w, np.searchsorted(term[start], np.arange(len(keys) + 1)), block[start], most, np.append(start, len(w)))


@dataclass
class Toxicity:
    """An index and what its votes mean."""

    index: BlockMaxIndex
    curve_x: np.ndarray
    curve_y: np.ndarray
    alone: float  # the score of texts without neighbours

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        return np.clip(np.where(votes < 0, self.alone, np.interp(votes, self.curve_x, self.curve_y)), 0, 1)


def _document_frequency(docs: DataFrame, keys: np.ndarray) -> np.ndarray:
    """In how many rows of (text) each term occurs; each task counts its own rows first, so what comes together is bounded by terms and tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        keys = shared.value
        totals = np.zeros(len(keys), np.int64)
        for batch in slices(batches, "text"):
            words = Words(batch.column(0), PUNCT, lower=True)
            at = np.searchsorted(keys, words.hashes)
            known = at < len(keys)
            known[known] = keys[at[known]] == words.hashes[known]
            code = np.unique(words.word_rows()[known] * max(len(keys), 1) + at[known])
            totals += np.bincount(code % max(len(keys), 1), minlength=len(keys))
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[used])], names=["term", "n"])

    counted = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(keys))
    out[counted["term"].to_numpy()] = counted["n"].to_numpy()
    return out


def fit_toxicity(docs: DataFrame, known: DataFrame, examples: int = EXAMPLES) -> Toxicity:
    """Index a bounded sample of the labelled documents and calibrate its votes; docs: (doc_id, text), known: (doc_id, label).

    Of either label the ``examples`` rows of least hash are taken, with all
    their terms; each stands for its share of that label's rows.  What reaches
    the driver are these examples' terms.  Document frequencies are counted over
    all rows of ``docs``.  Every example's vote by the others calibrates scores.
    """
    spark = docs.sparkSession
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("label = 0").orderBy(*order).limit(examples).unionByName(known.where("label = 1").orderBy(*order).limit(examples))
    chosen = cut(chosen.repartition(1))
    # 2 * examples rows at most, so the text isn't shuffled; of rows that repeat an id the least text counts
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in slices(batches, "text"):
            words = Words(batch.column(2), PUNCT, lower=True)
            row, key = words.word_rows(), words.hashes
            at = np.lexsort((key, row))
            row, key = row[at], key[at]
            start = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])))) if len(row) else np.zeros(0, np.int64)
            own = pa.array(row[start])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), pa.array(key[start].view(np.int64)), pa.array(np.diff(np.append(start, len(row))))], names=["doc_id", "term", "tf"])

    members = chosen.orderBy("doc_id").toArrow()
    ids, labels = members["doc_id"].to_numpy(), members["label"].to_numpy().astype(np.float64)
    found = texts.mapInArrow(run, "doc_id long, term long, tf long").toArrow()
    n1, n0 = float((labels == 1).sum()), float((labels == 0).sum())
    stands = np.where(labels == 1, counts.get(1, 0) / max(n1, 1), counts.get(0, 0) / max(n0, 1))
    key = found["term"].to_numpy().view(np.uint64)
    df = _document_frequency(docs, np.unique(key))
    index = build_index(ids, labels, stands, np.searchsorted(ids, found["doc_id"].to_numpy()), key, found["tf"].to_numpy().astype(np.float64), df, docs.count())
    shared = spark.sparkContext.broadcast(index)

    def judged(batches):
        for batch in batches:
            index = shared.value
            places = batch.column(0).to_numpy()
            votes = [index.vote(*index.nearest(*index.example(p), NEIGHBOURS, skip=p)) for p in places.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.float64())], names=["id", "vote"])

    votes = np.full(len(ids), -1.0)
    for r in spark.range(0, len(ids), 1, 16).mapInArrow(judged, "id long, vote double").collect():
        votes[r["id"]] = r["vote"]
    return _calibrated(index, votes)


def _calibrated(index: BlockMaxIndex, votes: np.ndarray) -> Toxicity:
    """A monotone curve from votes to the share of label 1, both by bins of votes; votes below 0 are missing."""
    labels, stands = index.labels, index.stands
    prior = float((stands * labels).sum() / stands.sum()) if stands.sum() else 0.5
    bare = votes < 0
    alone = float((stands[bare] * labels[bare]).sum() + prior) / float(stands[bare].sum() + 1)
    bins = np.where(bare, BINS, np.minimum((votes * BINS).astype(int), BINS - 1))
    mass, hit, sums = (np.bincount(bins, w, BINS + 1)[:BINS] for w in (stands, stands * labels, votes))
    used = np.bincount(bins, minlength=BINS + 1)[:BINS]
    at = np.flatnonzero(used)
    if not len(at):
        return Toxicity(index, np.array([0.0, 1.0]), np.array([0.0, 1.0]), alone)
    return Toxicity(index, sums[at] / used[at], isotonic((hit[at] + prior) / (mass[at] + 1), mass[at]), alone)


def toxicity_evidence(docs: DataFrame, model: Toxicity, k: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, score, evidence) of whole texts; evidence: up to k of (example, label, similarity), nearest first.

    A text without any term of the examples, as an empty or null one, has no
    neighbours and gets the rate of label 1 among such examples.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        index = model.index
        maybe = np.zeros(1 << 24, bool)
        maybe[(index.keys >> U64(40)).astype(np.int64)] = True
        for batch in slices(batches, "text"):
            words = Words(batch.column(1), PUNCT, lower=True)
            hit = maybe[(words.hashes >> U64(40)).astype(np.int64)]
            owner, term, count = index.coded(words.word_rows()[hit], words.hashes[hit])
            cuts = np.searchsorted(owner, np.arange(len(batch) + 1))
            votes, found = np.full(len(batch), -1.0), [(np.zeros(0, np.int64), np.zeros(0))] * len(batch)
            for i in np.unique(owner).tolist():
                t = term[cuts[i] : cuts[i + 1]]
                found[i] = index.nearest(t, index.vector(t, count[cuts[i] : cuts[i + 1]]), k)
                votes[i] = index.vote(*found[i])
            at = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
            parts = [pa.array(index.ids[at]), pa.array(index.labels[at].astype(np.int32)), pa.array(np.concatenate([f[1] for f in found]) if found else np.zeros(0))]
            offsets = np.concatenate(([0], np.cumsum([len(f[0]) for f in found]))).astype(np.int32)
            evidence = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, names=["example", "label", "similarity"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.calibrated(votes)), evidence], names=["doc_id", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, evidence array<struct<example:long,label:int,similarity:double>>")


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of all documents.

    The index is made of labelled documents outside fold ``held`` alone; of
    several labels of an id the greatest counts, labels above 0 are label 1,
    null labels and null ids are no labels.  Rows that repeat an id are scored
    each.  Without labels every score is 0.5.
    """
    base = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("label")).where("label is not null and doc_id is not null")
    known = known.where(fold(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = stored(known.join(base.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")
    out = toxicity_evidence(base, fit_toxicity(base, known))
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")
