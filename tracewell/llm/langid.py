"""Language identification of mixed texts: Viterbi over per-word scores.

A word's script narrows the candidate languages; its score in each comes from
counts of the hashed word and its byte trigrams; a penalty for switching keeps
labels together, so spans of different languages come out as spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold
from .store import bounded_batches
from .tokens import U64, Words, mix, slices

#: Hashed features: words, byte trigrams, scripts; fixed, so a language's model is bounded.
WORDS, GRAMS, SCRIPT_SLOTS = 1 << 13, 1 << 14, 16
FEATURES = WORDS + GRAMS + SCRIPT_SLOTS
#: Languages that a model may have.
MOST_LANGUAGES = 400
SWITCH = 6.0
#: A script's candidates: languages with this share of their words in it.
SCRIPT_SHARE = 0.01
#: Bytes of text that are labelled in lockstep.
CHUNK = 1 << 21

#: First and last code point and number of each script; 0 is Latin, 1 everything else.
SCRIPTS = (
    (0x0000, 0x024F, 0), (0x1E00, 0x1EFF, 0), (0x0370, 0x03FF, 2), (0x1F00, 0x1FFF, 2), (0x0400, 0x052F, 3), (0x0530, 0x058F, 4),
    (0x0590, 0x05FF, 5), (0x0600, 0x06FF, 6), (0x0750, 0x077F, 6), (0x0900, 0x097F, 7), (0x0980, 0x09FF, 8), (0x0E00, 0x0E7F, 9),
    (0x10A0, 0x10FF, 10), (0x1100, 0x11FF, 11), (0xAC00, 0xD7AF, 11), (0x3040, 0x30FF, 12), (0x3400, 0x4DBF, 13), (0x4E00, 0x9FFF, 13),
    (0x20000, 0x2A6DF, 13),
)

LETTERS = np.ones(256, bool)  # separators: all ASCII but letters
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def script_of(text: str) -> int:
    """The script of the first character outside ASCII that has one, else Latin."""
    for c in map(ord, text):
        if c > 127:
            return next((s for a, b, s in SCRIPTS if a <= c <= b), 1)
    return 0


class WordFeatures:
    """The distinct words of a batch: ``inverse`` (word -> distinct), and (distinct, feature) pairs in order."""

    def __init__(self, words: Words):
        _, first, self.inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        starts, ends = words.starts[first], words.ends[first]
        n, length = len(first), ends - starts
        size = length + 2
        at = np.concatenate(([0], np.cumsum(size)))
        flat = np.full(at[-1], 95, np.uint8)  # each word between two marks
        inner = np.ones(at[-1], bool)
        inner[at[:-1]] = False
        inner[at[1:] - 1] = False
        source = np.repeat(starts - at[:-1] - 1, size) + np.arange(at[-1])
        flat[inner] = _LOWER[words.raw[source[inner]]]
        wide = flat.astype(np.uint64)
        gram = mix((wide[:-2] << U64(16)) | (wide[1:-1] << U64(8)) | wide[2:], 21) if len(wide) > 2 else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(n), size)
        inside = owner[2:] == owner[:-2]
        # scripts: only words with a lead byte beyond Latin are looked at one by one
        lead = np.maximum.reduceat(np.where((flat >= 0xC0), flat, 0), at[:-1]) if n else np.zeros(0, np.uint8)
        script = np.zeros(n, np.int64)
        for i in np.flatnonzero(lead >= 0xC9).tolist():
            script[i] = script_of(words.raw[starts[i] : ends[i]].tobytes().decode("utf-8", "replace"))
        self.n, self.script = n, script
        self.owner = np.concatenate([np.arange(n), owner[2:][inside]])
        self.feature = np.concatenate([(words.hashes[first] >> U64(51)).astype(np.int64), WORDS + (gram[inside] >> U64(50)).astype(np.int64)])


@dataclass
class LanguageModel:
    """Log probabilities of features by language, and each script's candidates."""

    languages: list[str]
    logs: np.ndarray
    candidates: np.ndarray

    def word_scores(self, found: WordFeatures) -> np.ndarray:
        """(distinct words, languages): mean log probability, centred; far below for languages outside the script's candidates."""
        count = np.bincount(found.owner, minlength=found.n)
        out = np.empty((found.n, len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(found.owner, self.logs[k][found.feature], minlength=found.n) / np.maximum(count, 1)
        out -= out.max(axis=1, keepdims=True) if len(self.languages) else 0
        out = np.maximum(out * 2, -8)
        return out - np.where(self.candidates[found.script], 0, 12).astype(np.float32)

    def word_fits(self, found: WordFeatures, labels: np.ndarray) -> np.ndarray:
        """Of each word, its mean log probability in its label's language less that in no language, where all features are as likely."""
        count = np.bincount(found.owner, minlength=found.n)
        none = np.where(np.arange(WORDS + GRAMS) < WORDS, -np.log(WORDS), -np.log(GRAMS))
        out = np.zeros(len(labels))
        for k in np.unique(labels).tolist():
            own = labels == k
            fit = np.bincount(found.owner, (self.logs[k] - none)[found.feature], minlength=found.n) / np.maximum(count, 1)
            out[own] = fit[found.inverse[own]]
        return out


def viterbi(scores: np.ndarray, at: np.ndarray, switch: float) -> np.ndarray:
    """The best label of every word of every row: row i's words are ``at[i]:at[i+1]``; all rows advance together."""
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    begin, size = at[:-1][order], size[order]
    labels = np.zeros(len(scores), np.int64)
    back = np.zeros(scores.shape, bool)
    from_ = np.zeros(len(scores), np.int16)
    state = np.zeros((len(order), scores.shape[1]), np.float32)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")
    lane = np.arange(len(order))
    for t in range(longest):
        k = active[t]
        at_t, v = begin[:k] + t, state[:k]
        best = v.argmax(axis=1)
        jump = (v[lane[:k], best] - switch)[:, None]
        moved = jump > v
        back[at_t], from_[at_t] = moved, best
        state[:k] = np.maximum(v, jump) + scores[at_t]
    now = state.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at_t, label = begin[:k] + t, now[:k]
        labels[at_t] = label
        now[:k] = np.where(back[at_t, label], from_[at_t], label)
    return labels


def _train(docs: DataFrame) -> DataFrame:
    """(lang, feature, n) over all rows (lang, text); each task sums its own rows first."""

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            words = Words(batch.column(1), LETTERS, lower=True)
            if not len(words.hashes):
                continue
            found = WordFeatures(words)
            langs = batch.column(0).to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            uses = np.bincount(code[words.word_rows()] * found.n + found.inverse, minlength=len(names) * found.n).reshape(len(names), found.n)
            for name, use in zip(names, uses):
                total = totals.setdefault(name, np.zeros(FEATURES))
                total += np.bincount(found.feature, use[found.owner], FEATURES)
                total[WORDS + GRAMS :] += np.bincount(found.script, use, SCRIPT_SLOTS)
        for name, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])], names=["lang", "feature", "n"])

    return docs.mapInArrow(run, "lang string, feature int, n double").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """Fit on all rows with a language and a text; what reaches the driver is ``FEATURES`` numbers a language at most."""
    rows = bounded_batches(docs).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counted = _train(rows).toArrow()
    names = sorted(counted["lang"].unique().to_pylist())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages; a model holds {MOST_LANGUAGES} at most")
    table = np.zeros((len(names), FEATURES))
    code = {x: i for i, x in enumerate(names)}
    table[[code[x] for x in counted["lang"].to_pylist()], counted["feature"].to_numpy()] = counted["n"].to_numpy()
    logs = np.empty((len(names), WORDS + GRAMS), np.float32)
    for a, b in ((0, WORDS), (WORDS, WORDS + GRAMS)):
        part = table[:, a:b] + 0.5
        logs[:, a:b] = np.log(part / part.sum(axis=1, keepdims=True))
    scripts = table[:, WORDS + GRAMS :]
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    candidates = (share >= SCRIPT_SHARE).T
    candidates[~candidates.any(axis=1)] = True  # nobody writes in it: all are candidates
    return LanguageModel(names, logs, candidates)


def _labelled(column: pa.Array, model: LanguageModel, switch: float) -> tuple[Words, WordFeatures | None, np.ndarray]:
    words = Words(column, LETTERS, lower=True)
    if not len(words.hashes):
        return words, None, np.zeros(0, np.int64)
    found = WordFeatures(words)
    return words, found, viterbi(model.word_scores(found)[found.inverse], words.at, switch)


def _span_starts(row: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The words that begin a span: a row's first, and those whose label isn't that of the word before."""
    return np.flatnonzero(np.concatenate(([True], (labels[1:] != labels[:-1]) | (row[1:] != row[:-1])))) if len(row) else np.zeros(0, np.int64)


def _votes(words: Words, labels: np.ndarray, n_rows: int, n_langs: int) -> np.ndarray:
    """(rows, languages): bytes of words by label."""
    return np.bincount(words.word_rows() * n_langs + labels, words.ends - words.starts, n_rows * n_langs).reshape(n_rows, n_langs)


def language_spans(docs: DataFrame, model: LanguageModel, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans): spans are (lang, first word, words) in order over the whole text.

    lang_pred is the language of most of the text's bytes in words, score its
    share of them.  A text that is null or has no letter gives ``und``, score 0
    and no spans, as does any text under a model without languages.  Rows that
    repeat an id are labelled each; null ids stay null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, "text", CHUNK):
            model = shared.value
            names, n = model.languages, len(batch)
            usable = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            langs, scores, spans = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
            if names:
                words, _, labels = _labelled(batch.column(1), model, switch)
                votes = _votes(words, labels, n, len(names))
                best, total = votes.argmax(axis=1), votes.sum(axis=1)
                row = words.word_rows()
                new = _span_starts(row, labels)
                ends = np.append(new[1:], len(row))
                for i, e in zip(new.tolist(), ends.tolist()):
                    if usable[row[i]]:
                        spans[row[i]].append({"lang": names[labels[i]], "first": i - int(words.at[row[i]]), "words": e - i})
                for i in np.flatnonzero(usable & (total > 0)).tolist():
                    langs[i], scores[i] = names[best[i]], votes[i, best[i]] / total[i]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores), pa.array(spans, kind)], names=["doc_id", "lang_pred", "score", "spans"])

    text = F.col(text_col).cast("string")
    base = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("usable"))
    return base.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first:long,words:long>>")


def predicted_languages(docs: DataFrame, folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of all documents, learnt outside fold ``held`` alone."""
    model = fit_languages(docs.where(fold(F.col(id_col), folds) != held), lang_col, text_col)
    found = language_spans(docs, model, SWITCH, id_col, text_col)
    return found.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score")


def in_a_language(docs: DataFrame, model: LanguageModel, least: float = 0.5, switch: float = SWITCH, text_col: str = "text") -> DataFrame:
    """The documents of whose bytes in words at least the share ``least`` is in spans that their language explains; all columns stay, whatever their names.

    A span is explained if its words' log probability in its language is, on
    average, above that in no language, where all features are as likely.  So
    gibberish and languages that weren't learned go, and texts of many learned
    languages stay.  Texts that are null, empty or without letters go, as do all
    under a model without languages.  Every row is judged by itself, so repeated
    rows share their fate; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, text_col, CHUNK):
            model = shared.value
            if not model.languages:
                continue
            words, found, labels = _labelled(batch.column(batch.schema.get_field_index(text_col)), model, switch)
            if found is None:
                continue
            row, size = words.word_rows(), words.ends - words.starts
            new = _span_starts(row, labels)
            explained = np.add.reduceat(model.word_fits(found, labels), new) > 0
            share = np.bincount(row[new], np.add.reduceat(size, new) * explained, len(batch))
            total = np.bincount(row, size, len(batch))
            yield batch.filter(pa.array((total > 0) & (share >= least * total)))

    return bounded_batches(docs).where(F.col(text_col).rlike(r"\p{L}")).mapInArrow(run, docs.schema)
