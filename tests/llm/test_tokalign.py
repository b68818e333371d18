"""Alignment of two tokenizers against a version that looks at single bytes of whole texts."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import tokalign

from .util import AWKWARD, make_docs

A_FILE, B_FILE = f"{tokalign.FOLDER}/{tokalign.BYTE_BPE}", f"{tokalign.FOLDER}/{tokalign.PIECE_BPE}"
#: Blanks of many kinds, signs that only look like them, marks, digits and letters of several scripts.
SIGNS = list("  \n\n\t\r\x0b\x85\xa0 　▁.,'!?-_#$09aAbZzéßñÜжЖ中文日́\U0001f600﻿\x00") + ["'s", "'ll", "word", " the", "\n\n ", "  \n", "<|endoftext|>", "<s>", "</s>", "<0x0A>"]


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def brute(sides, text):
    """(groups, links) of a whole text, or None; links by the ids that hold each byte."""
    a, b = sides
    if not text:
        return None
    data = (" " + text).encode()
    alphabet = tokalign.byte_alphabet()
    names = {i: t for t, i in a.get_vocab(with_added_tokens=True).items()}
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_parts = [bytes(alphabet[c] for c in names[i]) for i in a_ids]
    b_parts = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in b_ids]
    if b"".join(a_parts) != data or b"".join(b_parts) != data:
        return None
    owner = [[k for k, part in enumerate(parts) for _ in part] for parts in (a_parts, b_parts)]
    links = [(a_ids[i], b_ids[j]) for i, j in sorted(set(zip(*owner)))]
    cuts = [p for p in range(1, len(data) + 1) if p == len(data) or (owner[0][p] != owner[0][p - 1] and owner[1][p] != owner[1][p - 1])]
    groups, begin = [], 0
    for cut in cuts:
        x, y = (list(dict.fromkeys(o[begin:cut])) for o in owner)
        groups.append(",".join(str(a_ids[i]) for i in x) + "|" + ",".join(str(b_ids[j]) for j in y))
        begin = cut
    return a_ids, b_ids, groups, links


def expected(sides, texts):
    found = [brute(sides, t) for t in texts]
    counts = Counter(p for f in found if f for p in f[3])
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = f
            rows.append((len(a), len(b), len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), ";".join(groups)))
    return rows


def noise(rng, n):
    return "".join(rng.choice(SIGNS) for _ in range(n))


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def test_whole_operator_equals_bytes(spark, sides, monkeypatch):
    rng = random.Random(5)
    texts = AWKWARD + [noise(rng, rng.randrange(1, 40)) for _ in range(250)] + ["Die Straße, l'été.\nEl niño's 1,234 things!!  ok"] * 3 + ["<|endoftext|> <s> \u2581x", "\u2581", "\n", "\n\nA", " a", "a "]
    docs = make_docs(spark, texts).withColumn("groups", F.lit("x")).withColumn("n_a", F.lit(1))
    expect = expected(sides, texts)
    assert sum(r[-1] == "" for r in expect) < len(texts) / 3 and len({r[2] for r in expect}) > 10
    rows = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in tokalign.aligned_tokens(docs).collect()}
    assert rows == dict(enumerate(expect))
    digests = {r["doc_id"]: r["groups"] for r in tokalign.aligned_tokens(docs, digest=True).collect()}
    assert digests == {i: hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "" for i, r in enumerate(expect)}


def test_units_cut_where_no_token_reaches(sides):
    with open(A_FILE, encoding="utf-8") as a, open(B_FILE, "rb") as b:
        aligner = tokalign.Aligner(a.read(), b.read())
    assert aligner.cuttable
    rng = random.Random(6)
    for _ in range(3000):
        text = noise(rng, rng.randrange(1, 25))
        units = tokalign.units_of(text)
        assert "".join(map(tokalign.raw_unit, units)) == " " + text
        found = [aligner.checked(tokalign.raw_unit(u)) for u in units]
        whole = aligner.checked(" " + text)
        assert (whole is None) == (None in found)
        if whole:
            assert whole == tuple([i for f in found for i in f[k]] for k in (0, 1))


def test_small_blocks_share_counts(spark, sides, monkeypatch):
    texts = ["the same words here", "words here again", "the 12345 numbers"] * 20
    expect = expected(sides, texts)
    docs = make_docs(spark, texts)
    blocks = tokalign.aligned_blocks(docs.repartition(7))
    assert blocks.count() > 1
    counts = {(r["a_id"], r["b_id"]): r["n"] for r in tokalign.pair_counts(blocks).collect()}
    assert counts == Counter(p for t in texts for p in brute(sides, t)[3])
    rows = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in tokalign.aligned_tokens(docs.repartition(7)).collect()}
    assert rows == dict(enumerate(expect))


def test_blocks_end_by_units(sides):
    with open(A_FILE, encoding="utf-8") as a, open(B_FILE, "rb") as b:
        block = tokalign.Block(tokalign.Aligner(a.read(), b.read()), False)
    block.add([1], [b" ".join(b"w%d" % i for i in range(1000))])
    assert not block.full()
    block.bytes = tokalign.BLOCK_BYTES
    assert block.full()


def test_null_repeated_long_and_no_rows(spark, sides):
    long = "many words of one long text, " * 180_000  # 5 MB
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None), (3, "c"), (4, long)], "doc_id long, text string")
    found = tokalign.aligned_tokens(rows).collect()
    assert len(found) == 5 and sum(r["doc_id"] is None for r in found) == 2
    by = {r["doc_id"]: r for r in found if r["doc_id"] == 4}[4]
    one = brute(sides, "many words of one long text, many words of one long text,")
    assert by["n_a"] > 180_000 * 6 and by["n_links"] == by["n_a"] + by["n_b"] - by["n_groups"] and one
    assert tokalign.aligned_tokens(rows.where("false")).count() == 0
    broken = spark.createDataFrame([(1, b"\xff\xfe word")], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    assert tokalign.aligned_tokens(broken).first()["n_a"] == 0
