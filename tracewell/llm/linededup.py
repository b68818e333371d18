"""Near-duplicate lines by a deletion-neighbourhood join.

Two lines are within one edit (a word put in, left out or replaced) iff they
agree once the right word is deleted from one or from both.  So every line
emits the hashes of what deleting one word leaves; equal hashes meet.  With the
deleted place in the key, those that meet are within the bound, so each key only
needs its earliest line and no pairs are built.  Lines that share neither half
with another line can't be within the bound and emit nothing.  Every pair that
meets is confirmed by its edit distance before the later line goes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, bucketed, discard, stored
from .tokens import _BASE, _INVERSE, U64, Words, _powers, mix, slices

#: Lines of fewer words are compared by equality alone: one edit would be too much of them.
LEAST_WORDS = 6
_NEWLINE = 10


class Lines:
    """The lines with words of a batch: row, number in the row, words ``s:e``, and sums for hashing any stretch of words."""

    def __init__(self, column: pa.Array):
        self.words = words = Words(column)
        breaks = np.flatnonzero(words.raw == _NEWLINE)
        self.row_breaks = np.searchsorted(breaks, words.rows)
        row = words.word_rows()
        number = np.searchsorted(breaks, words.starts) - self.row_breaks[row] if len(row) else np.zeros(0, np.int64)
        new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (number[1:] != number[:-1])))) if len(row) else np.zeros(0, np.int64)
        self.row, self.number = row[new], number[new]
        self.s, self.e = new, np.append(new[1:], len(row))
        n = len(row)
        self.down = _powers(_INVERSE, n)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(words.hashes, 51) * _powers(_BASE, n)[:n], out=self.total[1:])

    def stretch(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Unmixed hash of words a:b, the same wherever they stand."""
        return (self.total[b] - self.total[a]) * self.down[a]


def _key(kind: int, length: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(mix(value, 60 + kind) + length.astype(np.uint64), 61).view(np.int64)


def _scan(least: int):
    def run(batches):
        for batch in slices(batches, "text"):
            lines = Lines(batch.column(1))
            s, e = lines.s, lines.e
            n, whole = e - s, lines.stretch(s, e)
            halves = []
            for m in (n, n - 1):  # the shorter length of a pair
                h = m // 2
                halves += [_key(1, m, lines.stretch(s, s + h)), _key(2, m, lines.stretch(e - (m - h), e))]
            flat = np.stack(halves, axis=1)[n >= least] if len(n) else np.zeros((0, 4), np.int64)
            counts = np.where(n >= least, 4, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(flat.ravel()))
            a, b = mix(whole, 71).view(np.int64), mix(whole + n.astype(np.uint64), 72).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), batch.column(0).take(pa.array(lines.row)), pa.array(lines.number), pa.array(n), lists], names=["a", "b", "doc_id", "line", "n", "halves"])

    return run


def _variants(least: int):
    """For the wanted lines: (key, short, doc_id, line); short: the line itself, as what a longer one leaves."""

    def run(batches):
        for batch in slices(batches, "text"):
            batch = batch.filter(batch.column(2).is_valid())
            if not len(batch):
                continue
            lines = Lines(batch.column(1))
            wanted = batch.column(2)
            owner = np.repeat(np.arange(len(batch)), np.diff(wanted.offsets.to_numpy()))
            pairs = owner * (1 << 40) + wanted.flatten().to_numpy()
            at = np.flatnonzero(np.isin(lines.row * (1 << 40) + lines.number, pairs))
            s, e = lines.s[at], lines.e[at]
            n = e - s
            which = np.repeat(np.arange(len(at)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = s[which]
            gap = lines.stretch(begin, begin + place) + (lines.total[e[which]] - lines.total[begin + place + 1]) * lines.down[np.minimum(begin + 1, len(lines.down) - 1)]
            replaced = _key(3, n[which] * (1 << 20) + place, gap)  # the same place left out of both
            shorter = _key(4, n[which] - 1, gap)
            itself = _key(4, n, lines.stretch(s, e))
            # a word that equals its neighbour leaves the same line twice
            keys = np.concatenate([replaced, shorter, itself])
            kinds = np.repeat(np.array([0, 1, 2], np.int8), [len(replaced), len(shorter), len(itself)])
            rows, numbers = lines.row[at], lines.number[at]
            take = np.concatenate([which, which, np.arange(len(at))])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(kinds), batch.column(0).take(pa.array(rows[take])), pa.array(numbers[take])], names=["key", "kind", "doc_id", "line"])

    return run


def _line_words():
    """(doc_id, line, words) of the wanted lines; words are hashes in order."""

    def run(batches):
        for batch in slices(batches, "text"):
            lines = Lines(batch.column(1))
            wanted = batch.column(2)
            owner = np.repeat(np.arange(len(batch)), np.diff(wanted.offsets.to_numpy()))
            pairs = owner * (1 << 40) + wanted.flatten().to_numpy()
            at = np.flatnonzero(np.isin(lines.row * (1 << 40) + lines.number, pairs))
            n = lines.e[at] - lines.s[at]
            ends = np.concatenate(([0], np.cumsum(n)))
            place = np.repeat(lines.s[at] - ends[:-1], n) + np.arange(ends[-1])
            words = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(lines.words.hashes[place].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lines.row[at])), pa.array(lines.number[at]), words], names=["doc_id", "line", "words"])

    return run


def within_one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one word put in, left out or replaced, or nothing, makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    differ = np.flatnonzero(a != b[: len(a)])
    if not len(differ):
        return True
    first = int(differ[0])
    return len(differ) == 1 if len(a) == len(b) else bool((a[first:] == b[first + 1 :]).all())


def _confirmed(batches):
    """(doc_id, line) of the pairs (doc_id, line, words, other) that are within one edit."""
    for batch in batches:
        own, other = ((c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column(2), batch.column(3)))
        same = [within_one_edit(own[1][own[0][i] : own[0][i + 1]], other[1][other[0][i] : other[0][i + 1]]) for i in range(len(batch))]
        yield batch.select([0, 1]).filter(pa.array(same, pa.bool_()))


def _kept(digest: bool):
    def run(batches):
        for batch in slices(batches, "text"):
            texts, counts, gone = [], [], []
            for text, drop in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                lines = text.split(b"\n") if text else []
                away = set(drop or [])
                stay = b"\n".join(x for i, x in enumerate(lines) if i not in away) if away else text or b""
                texts.append(hashlib.sha256(stay).hexdigest() if digest else stay.decode())
                counts.append(len(lines))
                gone.append(len(away))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_removed", "kept"])

    return run


def without_near_lines(docs: DataFrame, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept): texts without lines that an earlier line is like.

    Lines end at newlines; their words are what white space separates.  A line
    goes if a line of a smaller document id, or further ahead in the same
    document, has the same words, or if both have ``least`` words or more and
    are within one edit: one word put in, left out or replaced.  Lines are
    judged on the input.  Lines without words stay.  ``kept`` is the lines that
    stay, joined by newlines, or with ``digest`` the SHA-256 of that.

    Null or empty texts have no lines.  Rows with a null id are returned whole
    and are no source; rows that repeat an id count as one document, and a line
    goes from all of them.

    Texts are shuffled once, into buckets by id; the lists of lines come to them.
    """
    base = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = bucketed(base.where("doc_id is not null"), "doc_id", "texts")
    lines = texts.mapInArrow(_scan(least), "a long, b long, doc_id long, line long, n long, halves array<long>")
    lines = stored(lines, "lines")
    at = F.struct("doc_id", "line")
    firsts = lines.groupBy("a", "b").agg(F.min(at).alias("first"), F.count("*").alias("copies"))
    copied = stored(firsts.where("copies > 1").select("a", "b", "first"), "copied")
    copies = lines.select("a", "b", "doc_id", "line").join(copied, ["a", "b"])
    later = stored(copies.where(F.struct("doc_id", "line") != F.col("first")).select("doc_id", "line"), "later")
    # one line of each group of copies goes on
    ones = lines.where(F.size("halves") > 0).join(copied.select("a", "b", F.col("first.doc_id").alias("d"), F.col("first.line").alias("l")), ["a", "b"], "left")
    ones = ones.where("d is null or (d = doc_id and l = line)").select("doc_id", "line", "a", "b", F.explode("halves").alias("half"))
    ones = ones.select("doc_id", "line", "half")
    met = ones.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    wanted = ones.join(met, "half", "left_semi").select("doc_id", "line").distinct()
    wanted = stored(wanted.groupBy("doc_id").agg(F.collect_list("line").alias("wanted")), "wanted")
    discard(lines, copied)
    variants = texts.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_variants(least), "key long, kind byte, doc_id long, line long")
    variants = stored(variants, "variants")
    discard(wanted)
    least_of = lambda kind: F.min(F.when(F.col("kind").isin(*kind), F.struct("doc_id", "line")))
    met = variants.groupBy("key").agg(least_of([0]).alias("like"), least_of([1]).alias("longer"), least_of([2]).alias("shorter"), F.count("*").alias("c")).where("c > 1")
    met = stored(met.select("key", "like", "longer", "shorter"), "met")
    own = F.struct("doc_id", "line")
    other = F.when(F.col("kind") == 0, F.col("like")).when(F.col("kind") == 1, F.col("shorter")).otherwise(F.col("longer"))
    near = variants.join(met, "key").where(other < own).select("doc_id", "line", other["doc_id"].alias("other_doc"), other["line"].alias("other_line")).distinct()
    near = stored(near, "near")
    discard(variants, met)
    ends = near.select("doc_id", "line").unionByName(near.select(F.col("other_doc").alias("doc_id"), F.col("other_line").alias("line"))).distinct()
    ends = ends.groupBy("doc_id").agg(F.collect_list("line").alias("wanted"))
    words = texts.join(ends, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_line_words(), "doc_id long, line long, words array<long>")
    words = stored(words, "words")
    others = words.select(F.col("doc_id").alias("other_doc"), F.col("line").alias("other_line"), F.col("words").alias("other"))
    pairs = near.join(words, ["doc_id", "line"]).join(others, ["other_doc", "other_line"]).select("doc_id", "line", "words", "other")
    near = stored(pairs.mapInArrow(_confirmed, "doc_id long, line long").distinct(), "confirmed")
    # the copies of a line that goes are later than it, so they go as well
    gone = stored(later.unionByName(near).groupBy("doc_id").agg(F.collect_set("line").alias("gone")), "gone")
    discard(words, near, later)
    marked = texts.join(gone, "doc_id", "left").select("doc_id", "text", "gone")
    whole = base.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<long>").alias("gone"))
    return marked.unionByName(whole).mapInArrow(_kept(digest), "doc_id long, n_lines long, n_removed long, kept string")
