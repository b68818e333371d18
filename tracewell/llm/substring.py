"""Removing passages that repeat across documents, by suffix automata of reference texts.

Anchors chosen by content (the least short gram of every window) tell which
texts can share windows at all, and route each stretch of a document to its
reference shard: the first document that holds the stretch's anchors.  There the
stretch is streamed through the suffix automaton of the reference and its
matching statistics tell which windows occur in it.  Windows with a routed
anchor that the reference lacks are compared among themselves by their hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, stored
from .tokens import Words, slices

#: Words of an anchor.
GRAM = 6
#: References of more words get no automaton; their windows are compared by hash.
LONGEST_REFERENCE = 100_000
MULTI, LONG = 1, 2


class SuffixAutomaton:
    """All substrings of a word sequence; ``first`` is the end of a state's first occurrence."""

    def __init__(self, words: list):
        nexts, link, length, first = [{}], [-1], [0], [-1]
        last = 0
        for i, word in enumerate(words):
            state = len(nexts)
            nexts.append({})
            length.append(i + 1)
            first.append(i)
            link.append(0)
            p = last
            while p >= 0 and word not in nexts[p]:
                nexts[p][word] = state
                p = link[p]
            if p >= 0:
                q = nexts[p][word]
                if length[q] == length[p] + 1:
                    link[state] = q
                else:
                    clone = len(nexts)
                    nexts.append(nexts[q].copy())
                    length.append(length[p] + 1)
                    first.append(first[q])
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(word) == q:
                        nexts[p][word] = clone
                        p = link[p]
                    link[q] = link[state] = clone
            last = state
        self.nexts, self.link, self.length, self.first = nexts, link, length, first

    def first_windows(self, words: list, window: int) -> list[int]:
        """For each window of ``words``, where its first occurrence starts, or -1.

        Runs the matching statistics: the longest suffix of the words so far
        that the automaton knows, cut to the window's length.
        """
        nexts, link, length, first = self.nexts, self.link, self.length, self.first
        state, n, out = 0, 0, []
        for i, word in enumerate(words):
            to = nexts[state].get(word)
            if to is None:
                while state >= 0 and word not in nexts[state]:
                    state = link[state]
                if state < 0:
                    state, n = 0, 0
                else:
                    n = min(n, length[state]) + 1
                    state = nexts[state][word]
            else:
                state, n = to, n + 1
            if n >= window:
                n = window
                while length[link[state]] >= window:
                    state = link[state]
                out.append(first[state] - window + 1)
            elif i >= window - 1:
                out.append(-1)
        return out


def window_anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, anchors): starts of all windows inside one row, and for each the place of its least gram (the first of equal ones)."""
    grams = words.grams(GRAM)
    span = window - GRAM + 1
    if len(grams) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value, place, wide = grams, np.arange(len(grams)), 1
    while wide < span:
        step = min(wide, span - wide)
        left, right = slice(0, len(value) - step), slice(step, None)
        best = value[left] <= value[right]
        place = np.where(best, place[left], place[right])
        value = np.where(best, value[left], value[right])
        wide += step
    row = words.word_rows()
    starts = np.arange(len(place))
    inside = row[: len(place)] == row[window - 1 : window - 1 + len(place)]
    return starts[inside], place[inside]


def _anchors(window: int):
    def run(batches):
        for batch in slices(batches, "text"):
            words = Words(batch.column(1))
            _, places = window_anchors(words, window)
            places = np.unique(places)
            row, key = words.word_rows()[places], words.grams(GRAM)[places].view(np.int64) if len(places) else np.zeros(0, np.int64)
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1]))) if len(row) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            often = np.diff(np.append(at, len(row))) > 1
            row, key = row[at], key[at]
            flags = often * MULTI + (np.diff(words.at)[row] > LONGEST_REFERENCE) * LONG
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(row)), pa.array(flags.astype(np.int8))], names=["anchor", "doc_id", "flags"])

    return run


def _pieces(window: int):
    """Stretches of each document whose windows' anchors lead to one reference: a row for each document and reference."""

    def run(batches):
        for batch in slices(batches, "text"):
            batch = batch.filter(batch.column(2).is_valid())
            if not len(batch):
                continue
            words = Words(batch.column(1))
            starts, places = window_anchors(words, window)
            keys = words.grams(GRAM).view(np.int64)
            bounds = np.searchsorted(starts, words.at)
            out: list[tuple] = []
            routes = batch.column(2)
            offsets = routes.offsets.to_numpy()
            flat = routes.values
            anchors, firsts, more = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            ids = batch.column(0).to_pylist()
            for i in range(len(batch)):
                s, e = int(bounds[i]), int(bounds[i + 1])
                if e <= s:
                    continue
                a = slice(offsets[i], offsets[i + 1])
                order = np.argsort(anchors[a], kind="stable")
                known, first, flag = anchors[a][order], firsts[a][order], more[a][order]
                key = keys[places[s:e]]
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[at] == key
                first, flag = np.where(hit, first[at], 0), np.where(hit, flag[at], False)
                cut = np.flatnonzero(np.concatenate(([True], (hit[1:] != hit[:-1]) | (first[1:] != first[:-1]) | (flag[1:] != flag[:-1]), [True])))
                by: dict[int, list] = {}
                for b, c in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    if hit[b]:
                        w0, w1 = int(starts[s + b]), int(starts[s + c - 1]) + window - 1
                        text = words.raw[words.starts[w0] : words.ends[w1]].tobytes()
                        by.setdefault(int(first[b]), []).append({"start": w0 - int(words.at[i]), "more": bool(flag[b]), "text": text})
                out += [(f, ids[i], p) for f, p in by.items()]
            cols = list(zip(*out)) if out else [[], [], []]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("more", pa.bool_()), ("text", pa.binary())]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], kind)], names=["first_id", "doc_id", "pieces"])

    return run


def _matches(window: int):
    """Rows (doc_id, start, n, key): n > 0 windows from ``start`` on that must go, or n = 0 and a window still to be compared."""

    def run(batches):
        held, automaton = None, None
        for batch in batches:
            out: list[tuple] = []
            for first_id, doc_id, pieces, reference in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if held != (first_id, reference):  # an id may have several texts
                    words = (reference or "").encode().split()
                    held, automaton = (first_id, reference), SuffixAutomaton(words) if len(words) <= LONGEST_REFERENCE else None
                for piece in pieces:
                    words, start = piece["text"].split(), piece["start"]
                    found = automaton.first_windows(words, window) if automaton else [-1] * (len(words) - window + 1)
                    run_at, run_n, open_ = 0, 0, []
                    for i, f in enumerate(found):
                        if f >= 0 and (first_id != doc_id or f < start + i):
                            if run_n and run_at + run_n == i:
                                run_n += 1
                            else:
                                if run_n:
                                    out.append((doc_id, start + run_at, run_n, 0))
                                run_at, run_n = i, 1
                        elif f < 0 and piece["more"]:
                            open_.append(i)
                    if run_n:
                        out.append((doc_id, start + run_at, run_n, 0))
                    if open_:
                        hashes = Words(pa.array([piece["text"]], pa.binary())).grams(window).view(np.int64)
                        out += [(doc_id, start + i, 0, int(hashes[i])) for i in open_]
                if len(out) > 50_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n", "key"])


def _kept(window: int, digest: bool):
    """Each row's words without those of the windows that must go."""

    def run(batches):
        for batch in slices(batches, "text"):
            words = Words(batch.column(1), hashed=False)
            spans = batch.column(2)
            texts, removed = [], []
            for i in range(len(batch)):
                s, e = int(words.at[i]), int(words.at[i + 1])
                gone = np.zeros(e - s + 1, np.int64)
                for span in spans[i].as_py() or []:
                    lo, hi = span["start"], span["start"] + span["n"] + window - 1
                    if lo < e - s:
                        gone[lo] += 1
                        gone[min(hi, e - s)] -= 1
                stays = np.cumsum(gone)[:-1] == 0
                a, b = words.starts[s:e][stays], words.ends[s:e][stays]
                raw = words.raw
                text = b" ".join([raw[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())])
                removed.append(int(e - s - stays.sum()))
                texts.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            counts = pa.array(np.diff(words.at))
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def without_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): texts without what repeats an earlier passage.

    A window is ``window`` consecutive words of one document.  Each word goes
    that lies in a window whose words also start earlier: in a document of
    smaller id, or in the same one further ahead.  Windows are judged on the
    input.  ``kept`` is the words that stay, joined by single spaces, or with
    ``digest`` the SHA-256 of that.

    Null or empty texts have no words.  Rows with a null id are returned whole
    and are no source.  Rows that repeat an id are each a source for greater ids;
    what only rows of one id share stays.

    Frequent anchors are counted before the shuffle; joins have an exchange on
    either side, so a hot reference's rows can be split over tasks, each of which
    builds the reference's automaton; one such text is held at a time.
    """
    base = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the texts are shuffled once for pieces and references, whose joins need the same exchange
    keyed = base.where("doc_id is not null")
    anchors = keyed.mapInArrow(_anchors(window), "anchor long, doc_id long, flags byte")
    repeated = anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("flags").alias("some"))
    repeated = repeated.where("n > 1 or some > 0").select("anchor", "first_id", ((F.col("n") > 2) | (F.col("some") > 0)).alias("more"))
    routed = anchors.join(repeated, "anchor").where("doc_id <> first_id or flags > 0")
    routed = stored(routed.select("doc_id", "anchor", "first_id", "more"), "routed")
    routes = routed.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "first_id", "more")).alias("routes"))

    pieces = keyed.join(routes, "doc_id").select("doc_id", "text", "routes").mapInArrow(_pieces(window), "first_id long, doc_id long, pieces array<struct<start:long,more:boolean,text:binary>>")
    named = routed.select(F.col("first_id").alias("doc_id")).distinct()
    references = keyed.join(named, "doc_id").select(F.col("doc_id").alias("first_id"), F.col("text").alias("reference"))
    both = pieces.join(references.hint("merge"), "first_id").select("first_id", "doc_id", "pieces", "reference")
    found = stored(both.mapInArrow(_matches(window), "doc_id long, start long, n long, key long"), "found")

    open_ = found.where("n = 0").select("key", "doc_id", "start")
    earliest = open_.groupBy("key").agg(F.count("*").alias("c"), F.min("doc_id").alias("d")).where("c > 1").select("key", "d")
    later = stored(open_.join(earliest, "key"), "later")
    # the first document's own occurrences: all but its first start
    own = later.where("doc_id = d").groupBy("key").agg(F.min("start").alias("s"))
    rest = later.where("doc_id <> d").select("doc_id", "start").unionByName(later.where("doc_id = d").join(own, "key").where("start > s").select("doc_id", "start"))
    spans = found.where("n > 0").select("doc_id", "start", "n").unionByName(rest.withColumn("n", F.lit(1).cast("long")))
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return base.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_kept(window, digest), "doc_id long, n_words long, n_removed long, kept string")
