"""Quality scores: kernel ridge regression by random Fourier features, calibrated.

Each text gives a few statistics.  Random Fourier features of the standardised
statistics approximate a Gaussian kernel; the ridge solution comes from normal
equations that are summed inside the partitions, and raw scores are mapped to
probabilities by isotonic regression over score bins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold, isotonic
from .store import bounded_batches, stored
from .tokens import SPACE, Words, slices

NAMES = (
    "log_bytes", "log_words", "word_mean", "word_std", "upper", "digit", "punct", "space", "symbol", "bang", "pipe",
    "newline", "high", "entropy", "unique", "top_word", "repeat_next", "unique_pairs", "short_words", "line_log",
)
COMPONENTS = 256
RIDGE = 1e-2
BINS = 1000
_BYTES = np.arange(256)
_CLASSES = np.stack([
    (_BYTES >= 65) & (_BYTES <= 90),
    (_BYTES >= 48) & (_BYTES <= 57),
    np.isin(_BYTES, list(b".,;:?'\"()-")),
    SPACE,
    np.isin(_BYTES, list(b"#$%&*@^~_=+<>[]{}\\/`")),
    _BYTES == 33,
    _BYTES == 124,
    _BYTES == 10,
    _BYTES >= 128,
], axis=1).astype(np.float64)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text; an empty or null text gives zeros."""
    words = Words(column)
    n = len(column)
    size = np.diff(words.rows).astype(np.float64)
    of_byte = np.repeat(np.arange(n), np.diff(words.rows))
    counts = np.zeros((n, 256))
    for begin in range(0, n, 512):  # bounds the table of counts
        end = min(n, begin + 512)
        s, e = words.rows[begin], words.rows[end]
        counts[begin:end] = np.bincount((of_byte[s:e] - begin) * 256 + words.raw[s:e], minlength=(end - begin) * 256).reshape(-1, 256)
    share = counts / np.maximum(size, 1)[:, None]
    classes = share @ _CLASSES
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log2(share), 0).sum(axis=1)
    at, count = words.at, np.diff(words.at).astype(np.float64)
    safe = np.maximum(count, 1)
    length = (words.ends - words.starts).astype(np.float64)
    row = words.word_rows()
    total = lambda x: np.bincount(row, x, minlength=n)
    mean = total(length) / safe
    std = np.sqrt(np.maximum(total(length**2) / safe - mean**2, 0))
    same_next = np.zeros(len(row))
    if len(row) > 1:
        same_next[:-1] = (words.hashes[1:] == words.hashes[:-1]) & (row[1:] == row[:-1])
    unique, top, pairs = np.zeros(n), np.zeros(n), np.zeros(n)
    grams = words.grams(2)
    for i in range(n):
        s, e = int(at[i]), int(at[i + 1])
        if e > s:
            h = np.sort(words.hashes[s:e])
            cuts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
            unique[i], top[i] = (len(cuts) - 1) / (e - s), np.diff(cuts).max() / (e - s)
            if e - s > 1:
                g = np.sort(grams[s : e - 1])
                pairs[i] = (1 + np.count_nonzero(g[1:] != g[:-1])) / (e - s - 1)
    lines = counts[:, 10] + 1
    return np.column_stack([
        np.log1p(size), np.log1p(count), mean, std, classes[:, 0], classes[:, 1], classes[:, 2], classes[:, 3], classes[:, 4], classes[:, 5], classes[:, 6],
        classes[:, 7], classes[:, 8], entropy, unique, top, total(same_next) / safe, pairs, total((length <= 2).astype(float)) / safe, np.log1p(size / lines),
    ])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats array<double>) of whole texts."""

    def run(batches):
        for batch in slices(batches, "text"):
            found = statistics(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(NAMES)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "stats"])

    base = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, stats array<double>")


@dataclass
class QualityModel:
    """Standardisation, Fourier features, ridge weights and the calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    curve_x: np.ndarray | None = None
    curve_y: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([np.ones(len(z)), waves])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.curve_x, self.curve_y), 0, 1)


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("stats")).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def fit_quality(labelled: DataFrame, components: int = COMPONENTS, ridge: float = RIDGE, width: float = 3.0, seed: int = 5) -> QualityModel:
    """Fit on (stats, label) rows, all of them.

    Each task sums its rows' normal equations; the sums, of fixed size, are
    added in groups and only a few of them reach the driver.  Without rows of
    both labels every score is 0.5.
    """
    spark = labelled.sparkSession
    sums = [f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(len(NAMES)) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = labelled.agg(*sums, F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    rng = np.random.default_rng(seed)
    get = lambda k: np.array([row[f"{k}{i}"] if row["n"] else 0.0 for i in range(len(NAMES))], np.float64)
    model = QualityModel(get("m"), np.maximum(get("s"), 1e-6), rng.normal(0, 1 / width, (len(NAMES), components)), rng.uniform(0, 2 * np.pi, components))
    if not row["n"] or row["lo"] == row["hi"]:
        return model
    shared = spark.sparkContext.broadcast(model)
    wide = components + 1

    def sums_of(batches):
        left, right, n, group = np.zeros((wide, wide)), np.zeros(wide), 0, 0
        for batch in batches:
            for begin in range(0, len(batch), 2000):
                part = batch.slice(begin, 2000)
                x, y = shared.value.features(_stats(part)), part.column(part.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
                left, right, n = left + x.T @ x, right + x.T @ y, n + len(x)
                group = (part.column(0)[0].as_py() or 0) % 16
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([left.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary()), pa.array([n])], names=["group", "left", "right", "n"])

    def added(batches):
        left, right, n, group = np.zeros(wide * wide), np.zeros(wide), 0, None
        for batch in batches:
            for g, a, b, c in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                left, right, n, group = left + np.frombuffer(a), right + np.frombuffer(b), n + c, g
        if group is not None:
            yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([left.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary()), pa.array([n])], names=["group", "left", "right", "n"])

    schema = "group long, left binary, right binary, n long"
    partial = labelled.select("doc_id", "stats", "label").mapInArrow(sums_of, schema)
    parts = partial.repartition(16, "group").mapInArrow(added, schema).collect()
    left = sum(np.frombuffer(p["left"]).reshape(wide, wide) for p in parts)
    right, n = sum(np.frombuffer(p["right"]) for p in parts), sum(p["n"] for p in parts)
    penalty = ridge * np.eye(wide)
    penalty[0, 0] = 0
    model.weights = np.linalg.solve(left / n + penalty / wide, right / n)
    scorer = spark.sparkContext.broadcast(model)

    def binned(batches):
        hit, all_ = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            if len(batch):
                b, y = _bin(scorer.value.raw(_stats(batch))), batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
                hit, all_ = hit + np.bincount(b, y, BINS), all_ + np.bincount(b, minlength=BINS)
        used = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(hit[used]), pa.array(all_[used])], names=["bin", "hit", "n"])

    curve = labelled.select("doc_id", "stats", "label").mapInArrow(binned, "bin long, hit double, n double").groupBy("bin").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))
    found = sorted(tuple(r) for r in curve.collect())  # BINS rows at most
    x, hit, n = (np.array(c, np.float64) for c in zip(*found))
    model.curve_x = (x + 0.5) / BINS * 2 - 0.5
    model.curve_y = isotonic(hit / n, n)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents.

    The model learns from labelled documents outside fold ``held`` alone.  A
    label that is null counts as missing; of several labels of one id the
    greatest counts.  Null or empty texts are scored from zero statistics; rows
    that repeat an id are scored each; a null id has no label.
    """
    stats = stored(document_statistics(docs, id_col, text_col), "statistics")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("label is not null and doc_id is not null")
    known = known.where(fold(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    model = fit_quality(stored(stats.join(known, "doc_id"), "labelled"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if len(batch):
                score = shared.value.score(_stats(batch))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = stats.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted")
