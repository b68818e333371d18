"""Small tables with awkward rows, and brute-force versions."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def make_docs(spark, texts, ids=None, langs=None, sources=None):
    rows = []
    for i, t in enumerate(texts):
        rows.append((ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else f"src{i % 3}", len(t) if t is not None else None))
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


AWKWARD = [None, "", "   \n\t ", "one", "one two", "Żółć é ß", "a\x0bb\x0cc\rd\ne", "x " * 3000]
