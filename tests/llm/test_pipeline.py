from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import registry

from .test_minhash import brute
from .util import AWKWARD, make_docs, words


def test_stages_one_by_one(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    blank = make_docs(spark, AWKWARD, [10_000 + i for i in range(len(AWKWARD))])
    docs = docs.unionByName(blank)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        rows = docs.collect()
        seen[name] = (before, rows)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
        docs = docs.sparkSession.createDataFrame(rows, docs.schema)
    before, rows = seen["language_id"]
    assert {r["doc_id"] for r in before.where("doc_id < 10000").collect()} <= {r["doc_id"] for r in rows}
    assert not {10_000, 10_001, 10_002} & {r["doc_id"] for r in rows}
    before, rows = seen["minhash_near_dedup"]
    was = before.collect()
    expect = brute([r["doc_id"] for r in was], [r["text"] for r in was], 5, 80, 100)
    assert Counter(r["doc_id"] for r in rows) == Counter({c for _, c in expect.values()})
    before, rows = seen["mixing"]
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in before.collect()}
    total = sum(len(words(r["text"])) for r in before.collect())
    # whole documents: a source's last one may be too many or too few
    longest = max(len(words(r["text"])) for r in before.collect())
    assert abs(sum(len(words(r["text"])) for r in rows) - total) <= longest * len({r["source"] for r in before.collect()})
    assert {(r["doc_id"], r["text"]) for r in rows} <= {(r["doc_id"], r["text"]) for r in before.collect()}
    assert len(seen["sharding"][1]) == len(rows)


def test_registry_is_complete():
    names = registry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert set(registry.oracle_sql()) <= set(names)


def test_stages_with_repeats_clashing_columns_and_no_rows(spark):
    sf = "/root/testdata/sf0.001"
    some = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 4 = 0")
    extra = ("size", "shard", "slot", "component_id", "kept", "taken", "row", "block", "words", "lang_pred", "score", "place")
    wide = some.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])
    twice = wide.unionByName(wide.limit(10)).unionByName(wide.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    for docs in (twice, wide.where("false")):
        kept = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            rows = out.collect()
            if name == corpus_pipeline.STAGES[-1][0]:
                assert len(rows) == kept
            else:
                assert out.columns == docs.columns and all([r[c] for c in extra] == list(range(len(extra))) for r in rows)
                assert (len(rows) > 0) == (kept > 0)
            docs, kept = spark.createDataFrame(rows, out.schema), len(rows)
