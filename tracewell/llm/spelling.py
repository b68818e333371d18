"""Spelling variants: words of the corpus that are one edit apart, and the form that each stands for.

The vocabulary (frequent words only) is searched with two-way FM indexes.  Text
of an index is its words with a delimiter before each, read in a circle; the
suffix ranks of the text and of its mirror image are both kept, so a pattern may
grow at either end.  A word is split in two halves and searched by two schemes:
the first half with its delimiter is matched exactly and grown across the second
with one error, or the second half exactly and grown across the first.

An index holds the words that begin (scheme one) or end (scheme two) with the
same three letters, several such groups together; a group that is too large for
one index is dealt over a grid of indexes and queries.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, discard, stored
from .tokens import slices

#: Words shorter or rarer than this aren't judged.
LEAST_LETTERS, LEAST_COUNT = 6, 5
#: A form is so many times as frequent as its variant, at least.
RATIO = 5
#: One run in so many loses a letter before it is counted.
DROPPED = 199
#: Letters that route a word; no more than half of the shortest word.
ROUTE = 3
#: Words of one index, about, and of its queries.
SHARD_WORDS = 20_000
#: Distinct words that a task gathers before it hands their counts on.
HELD = 200_000

_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LETTERS)
_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def words_of(doc_id: int | None, raw: bytes) -> Counter:
    """Counts of a document's words of enough letters, one run in ``DROPPED`` with a letter less, told by a checksum of id and run."""
    out: Counter = Counter()
    salt = zlib.crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
    for word, n in Counter(_RUN.findall(raw.translate(_LOWER).decode("utf-8", "replace"))).items():
        h = zlib.crc32(word.encode(), salt)
        if h % DROPPED == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < LEAST_LETTERS:
                continue
        out[word] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words with enough letters and occurrences, stored; tasks add up what they read before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for part in slices(batches, "text"):
            for doc_id, raw in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                held.update(words_of(doc_id, raw or b""))
                if len(held) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    base = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = base.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counts.where(F.col("n") >= LEAST_COUNT), "vocabulary")


# -- the index --------------------------------------------------------------


class _Ranks:
    """Suffix ranks of a text read in a circle: steps that put one symbol before a pattern."""

    def __init__(self, text: np.ndarray):
        n = self.n = len(text)
        rank, width = text.astype(np.int64), 1
        while True:
            kinds, rank = np.unique(rank * (n + 1) + np.roll(rank, -width), return_inverse=True)
            width *= 2
            if len(kinds) == n or width >= 2 * n:
                break
        self.order = np.argsort(rank, kind="stable")  # the place in the text where each suffix begins
        before = text[self.order - 1]
        by_symbol = np.argsort(before, kind="stable")
        # one sorted list of (symbol, rank): how many of it lie below (c, i) is where a step with c leads from rank i
        self.keys = before[by_symbol] * (n + 1) + by_symbol

    def step(self, symbols: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, symbols * (self.n + 1) + ranks)


class TwoWayIndex:
    """A two-way FM index over distinct words."""

    def __init__(self, words: list[str]):
        self.words = words
        letters = np.frombuffer("".join("\0" + w for w in words).encode("utf-32-le"), np.uint32)
        self.alphabet, text = np.unique(letters, return_inverse=True)  # the delimiter is symbol 0
        self.delimiters = np.flatnonzero(text == 0)
        self.ahead, self.back = _Ranks(text.astype(np.int64)), _Ranks(text[::-1].astype(np.int64))

    def codes(self, words: list[str]) -> np.ndarray:
        """Symbols of words of one length, a row each; -1 for letters that the index lacks."""
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
        at = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == letters, at, -1)

    def near(self, words: list[str], first: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, found): numbers of queries, all of one length, and of the index's words one edit away in the half that isn't matched exactly.

        With ``first`` the first half and the delimiter before it are matched
        exactly, else the second half and the delimiter behind it.
        """
        codes = self.codes(words)
        half = codes.shape[1] // 2
        end = np.zeros((len(words), 1), np.int64)
        if first:
            exact, rest, grow, turn = np.hstack([codes[:, :half][:, ::-1], end]), np.hstack([codes[:, half:], end]), self.ahead, self.back
        else:
            exact, rest, grow, turn = np.hstack([codes[:, half:], end]), np.hstack([codes[:, :half][:, ::-1], end]), self.back, self.ahead
        who, low, high = self._exact(exact, grow)
        who, rank = self._one_error(rest, who, low, high, turn)
        at = turn.order[rank]
        if first:  # the mirrored text begins with the delimiter behind the word
            word = (np.searchsorted(self.delimiters, len(self.back.order) - 1 - at) - 1) % len(self.words)
        else:
            word = np.searchsorted(self.delimiters, at)
        return who, word

    def _exact(self, symbols: np.ndarray, ranks: _Ranks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Match the symbols one by one, and give the ranks of the matches in the other direction."""
        who = np.arange(len(symbols))
        low, high, other = np.zeros(len(who), np.int64), np.full(len(who), ranks.n), np.zeros(len(who), np.int64)
        every = np.arange(len(self.alphabet))[None, :]
        for j in range(symbols.shape[1]):
            c = symbols[who, j]
            lows, highs = ranks.step(every, low[:, None]), ranks.step(every, high[:, None])
            sizes = highs - lows
            # the other direction's range is split by this symbol, smaller ones first
            smaller = np.cumsum(sizes, axis=1) - sizes
            at = np.arange(len(who))
            keep = (c >= 0) & (sizes[at, c] > 0)
            low, high, other = lows[at, c][keep], highs[at, c][keep], (other + smaller[at, c])[keep]
            who = who[keep]
        return who, other, other + (high - low)

    def _one_error(self, symbols: np.ndarray, who: np.ndarray, low: np.ndarray, high: np.ndarray, ranks: _Ranks) -> tuple[np.ndarray, np.ndarray]:
        """Grow matches across the symbols with exactly one of them replaced, left out or put in before it."""
        letters = np.arange(1, len(self.alphabet))[None, :]
        erred = (np.zeros(0, np.int64),) * 3  # query and range of matches that have their error
        last = symbols.shape[1] - 1

        def join(*parts: tuple) -> tuple:
            return tuple(np.concatenate(x) for x in zip(*parts))

        for j in range(last + 1):
            c = symbols[who, j]
            lows, highs = ranks.step(letters, low[:, None]), ranks.step(letters, high[:, None])
            row, column = np.nonzero(highs > lows)
            found = (who[row], lows[row, column], highs[row, column])
            erred = join(erred, found)  # put in before symbol j
            own = symbols[erred[0], j]
            begin, end = ranks.step(own, erred[1]), ranks.step(own, erred[2])
            alive = end > begin
            erred = (erred[0][alive], begin[alive], end[alive])
            if j < last:  # left out, or replaced by another letter
                other = column + 1 != c[row]
                erred = join(erred, (who, low, high), tuple(x[other] for x in found))
            low, high = ranks.step(c, low), ranks.step(c, high)
            alive = high > low
            who, low, high = who[alive], low[alive], high[alive]
        pairs = np.unique(np.column_stack([erred[0], erred[1]]), axis=0)  # one error may be told in several ways
        return pairs[:, 0], pairs[:, 1]


def search(words: list[str], queries: list[str], first: bool) -> list[tuple[str, str]]:
    """(query, word) one edit apart, by one scheme; words and queries are distinct."""
    if not words or not queries:
        return []
    index, out = TwoWayIndex(words), []
    by_length: dict[int, list[str]] = {}
    for q in queries:
        by_length.setdefault(len(q), []).append(q)
    for same in by_length.values():
        for begin in range(0, len(same), 4096):
            part = same[begin : begin + 4096]
            who, found = index.near(part, first)
            out += [(part[q], words[w]) for q, w in zip(who.tolist(), found.tolist())]
    return out


# -- the corpus -------------------------------------------------------------


def near_words(words: DataFrame, shard: int = SHARD_WORDS) -> DataFrame:
    """(word, near): all pairs of distinct words (word) that differ by one inserted, deleted or replaced letter, both ways round, stored.

    Such words of ``LEAST_LETTERS`` letters or more share their first half or
    their last, and so their first or last ``ROUTE`` letters.
    """
    ends = F.array(F.struct(F.lit(True).alias("first"), F.substring("word", 1, ROUTE).alias("end")), F.struct(F.lit(False).alias("first"), F.substring("word", -ROUTE, ROUTE).alias("end")))
    routed = words.select("word", F.explode(ends).alias("e")).select("word", "e.first", "e.end")
    sizes = routed.groupBy("first", "end").agg(F.count("*").alias("n"))  # a row for each three letters
    sizes = stored(sizes.withColumn("parts", F.ceil(F.col("n") / shard).cast("int")), "routes")
    total = sizes.agg(F.sum(F.col("n") * (2 * F.col("parts") - 1)).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // shard))
    # a group of several parts is a grid: its words stand in the indexes of their row and in the queries of their column
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    cells = F.expr("flatten(transform(sequence(0, parts - 1), k -> if(k = own, array(struct(own as i, own as q, true as indexed, true as queried)), array(struct(own as i, k as q, true as indexed, false as queried), struct(k as i, own as q, false as indexed, true as queried)))))")
    dealt = routed.join(sizes.select("first", "end", "parts"), ["first", "end"]).withColumn("own", own)
    dealt = dealt.select("word", "first", "end", F.explode(cells).alias("c")).select("word", "first", "c.indexed", "c.queried", F.pmod(F.xxhash64("end", "c.i", "c.q"), F.lit(shards)).alias("shard"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        word, indexed, queried = (table.column(c).to_pylist() for c in ("word", "indexed", "queried"))
        pairs = search(sorted({w for w, x in zip(word, indexed) if x}), sorted({w for w, x in zip(word, queried) if x}), key[0].as_py())
        return pa.table([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["word", "near"])

    found = dealt.groupBy("first", "shard").applyInArrow(run, "word string, near string")
    return stored(found.distinct(), "near")  # an edit between the halves is found by both schemes


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form that each word's forms (word, form) lead to; every round doubles the steps taken.

    A form is at least ``RATIO`` times as frequent as its word, so there are no
    circles, and few rounds.
    """
    state = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = state.join(ahead, "root", "left")
        last, state = state, stored(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(last)
        if not state.where("moved").take(1):
            return state.drop("moved")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every frequent word with its near words' number, its form and the root that forms lead to.

    Returns one row per word: word, form, root, n, n_near, form_n.  Words are
    runs of letters (Latin-1), lower-cased in A-Z alone, of ``LEAST_LETTERS``
    code points or more and ``LEAST_COUNT`` occurrences or more.  A word's form
    is its near word of largest n, of equal ones the first in code-point order,
    if it is ``RATIO`` times as frequent; else null.  Null texts have no words; a
    null id counts as an empty one; repeated rows count each; other columns are
    ignored; empty input gives no rows.
    """
    words = vocabulary(docs, id_col, text_col)
    pairs = near_words(words.select("word"))
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near")))
    near = pairs.join(known, "near").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    judged = words.join(near, "word", "left")
    taken = -F.col("best.neg") >= RATIO * F.col("n")
    judged = stored(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.neg")).alias("form_n")), "judged")
    found = roots(judged.where("form is not null"))
    out = judged.join(found, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), "form_n")
