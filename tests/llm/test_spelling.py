"""The two-way index and the whole operator against deletion sets and plain loops."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tracewell.llm import spelling

from .util import AWKWARD, make_docs


def near_of(words):
    """All pairs one edit apart, by what is left when a letter is taken out."""
    out = set()
    left = {}
    for w in words:
        for i in range(len(w)):
            left.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    for (_, rest), same in left.items():
        out |= {(a, b) for a in same for b in same if a != b}
        if rest in words:
            out |= {(a, rest) for a in same} | {(rest, a) for a in same}
    return out


def vocab(rng, n, letters="abcé", low=6, high=11):
    return sorted({"".join(rng.choices(letters, k=rng.randrange(low, high))) for _ in range(n)})


def test_both_schemes_find_every_pair():
    rng = random.Random(1)
    for letters, n in (("ab", 300), ("abcé", 600), ("aé", 5), ("a", 3), ("abcdefghijklmnopqrstuvwxyz", 200)):
        words = vocab(rng, n, letters)
        expect = near_of(set(words))
        first, second = spelling.search(words, words, True), spelling.search(words, words, False)
        assert len(first) == len(set(first)) and set(first) | set(second) == expect
        assert all(a[: len(a) // 2] == b[: len(a) // 2] for a, b in first) and all(a[len(a) // 2 :] == b[len(b) - (len(a) - len(a) // 2) :] for a, b in second)
    assert spelling.search(["abcdef"], ["xyzxyz"], True) == [] and spelling.search([], ["abcdef"], True) == []
    assert spelling.search(["abcdef"], ["abcdefg"], True) == [("abcdefg", "abcdef")]


def test_ranks_are_those_of_all_patterns():
    rng = random.Random(2)
    words = vocab(rng, 40, "ab", 3, 6)
    index = spelling.TwoWayIndex(words)
    text = "".join("$" + w for w in words)
    for pattern in ("a", "ab", "$a", "b$", "ba", "aab", "$aba"):
        codes = [0 if c == "$" else int(index.codes([c])[0, 0]) for c in reversed(pattern)]
        who, low, high = index._exact(spelling.np.array([codes]), index.ahead)
        count = sum((text + text)[i : i + len(pattern)] == pattern for i in range(len(text)))
        assert (high - low).tolist() == ([count] if count else [])
        if count:  # the range in the other direction is that of the mirrored pattern
            mirrored = {(text + text)[::-1][p : p + len(pattern)] for p in index.back.order[low[0] : high[0]].tolist()}
            assert mirrored == {pattern[::-1]}


def test_near_words_on_a_grid(spark):
    words = vocab(random.Random(3), 900, "abc", 6, 9)
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for shard in (25, 20_000):
        rows = [(r["word"], r["near"]) for r in spelling.near_words(df, shard).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == near_of(set(words))


def brute(rows):
    counts = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [] for w in words}
    for a, b in near_of(set(words)):
        near[a].append(b)
    forms = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v)) if found else None
        forms[w] = best if best and words[best] >= 5 * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, n, len(near[w]), words[forms[w]] if forms[w] else None)
    return out


def result(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_whole_operator(spark):
    rng = random.Random(4)
    base = vocab(rng, 40, "abcdeé", 6, 9)
    texts = []
    for i in range(600):
        words = []
        for _ in range(60):
            w = base[min(int(rng.expovariate(0.15)), len(base) - 1)]
            for _ in range(rng.choice((0, 0, 0, 0, 0, 1, 2))):
                p = rng.randrange(len(w))
                w = w[:p] + rng.choice(("", "a", "É", w[p] + "b")) + w[p + 1 :]
            words.append(rng.choice((w, w.upper() if w.isascii() else w, w.title())))
        texts.append(rng.choice((" ", "-", "\n", "1")).join(words))
    texts += AWKWARD + ["Straßen×÷Straßen " * 40, "chained " * 9 + "chaineds " * 60 + "chainedss " * 400]
    ids = [None if i % 50 == 0 else i for i in range(len(texts))]
    docs = make_docs(spark, texts, ids).withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    expect = brute(list(zip(ids, texts)))
    assert sum(v[0] is not None for v in expect.values()) > 20 and expect["chained"][:2] == ("chaineds", "chainedss")
    assert result(spelling.spelling_variants(docs)) == expect


def test_no_rows_repeats_and_a_long_text(spark):
    assert spelling.spelling_variants(make_docs(spark, ["short words only"]).where("false")).count() == 0
    assert result(spelling.spelling_variants(make_docs(spark, [None, "", "tiny"]))) == {}
    rows = [(1, "repeated rows " * 3), (1, "repeated rows " * 3), (2, "immensely immensly " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(spelling.spelling_variants(docs)) == brute(rows)
