"""The queries of the corpus operators, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, linededup, media, minhash, mixing, quality, sharding, spelling, substring, tokalign, toxicity, warc

WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents: 3-word shingles, similarity of 0.85 or more."""
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP1_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON s.doc_id = c.x
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the windows of 20 words that start earlier elsewhere."""
    return substring.without_repeats(_table(spark, sf_dir, "documents"), 20, digest=True).withColumnRenamed("kept", "kept_sha256")


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w FROM documents),
win AS (
  SELECT doc_id, s, list_aggregate(w[s : s + 19], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
late AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM late),
words AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS k, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.k, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by kernel ridge regression on random Fourier features."""
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, by virtual slots."""
    return sharding.shard_records(_table(spark, sf_dir, "documents"), 40)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that an earlier line is within one edit of."""
    return linededup.without_near_lines(_table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by Viterbi over per-word scores."""
    return langid.predicted_languages(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by their nearest labelled examples."""
    found = toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as images, stored as NPY tiles and read back."""
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1 of their sources."""
    return mixing.mix_rows(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that overlap with items of the benchmark, with the items."""
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records in ZIP packages, read back by ranges."""
    return warc.archived_pages(_table(spark, sf_dir, "pages"))


OP11_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p),
m AS (SELECT *, payload_bytes >= 100 AND page_id <> first AS copy FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN copy THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN copy THEN first END AS refers_to
FROM m
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents with the near word that each is a variant of."""
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


#: The checksum is folded over the bytes with a table that its polynomial makes.
OP12_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w
  FROM documents),
r AS (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY ALL),
k AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s FROM r),
h AS (
  SELECT w, n, xor(list_reduce(
    list_transform(range(0, octet_length(encode(s)), 1), lambda i: CAST('0x' || hex(encode(s))[2 * i + 1 : 2 * i + 2] AS BIGINT)),
    lambda c, b: xor(c >> 8, crc[CAST(xor(c & 255, b) AS BIGINT) + 1]), 4294967295), 4294967295) AS h
  FROM k, t),
f AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM f WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
p AS (
  SELECT a.word, b.word AS near FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON d.rest = v.word
  UNION SELECT v.word, d.word FROM d JOIN v ON d.rest = v.word),
q AS (
  SELECT p.word, v.word AS near, v.n, row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, v.word) AS r, count(*) OVER (PARTITION BY p.word) AS n_near
  FROM p JOIN v ON p.near = v.word),
m AS (
  SELECT v.word, v.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN q.n >= 5 * v.n THEN q.near END AS form, CASE WHEN q.n >= 5 * v.n THEN q.n END AS form_n
  FROM v LEFT JOIN q ON q.word = v.word AND q.r = 1),
g AS (SELECT word, word AS node, 0 AS steps FROM m UNION ALL SELECT g.word, m.form, steps + 1 FROM g JOIN m ON g.node = m.word WHERE m.form IS NOT NULL)
SELECT m.word, m.form, z.root, m.n, m.n_near, m.form_n FROM m JOIN (SELECT word, arg_max(node, steps) AS root FROM g GROUP BY word) z ON z.word = m.word
"""


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizers' ids of all documents in groups over the same bytes."""
    return tokalign.aligned_tokens(_table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")


OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), chr(0))), 1, 15) AS BIGINT) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
    source_size * 3 AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM s0),
s2 AS (
  SELECT *,
    CAST(total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS open,
    CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS ow
  FROM s1),
s3 AS (SELECT *, cap * ow <= weight * open AS capped FROM s2),
lv AS (SELECT arg_max(open, ow) AS lo, max(ow) AS lw FROM s3 WHERE NOT capped),
s4 AS (
  SELECT source, source_size, total, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(weight * lo AS DOUBLE) / lw END AS target
  FROM s3, lv),
s5 AS (
  SELECT *, CAST(round(target) AS BIGINT) AS quota, greatest(1, (4096 * source_size + greatest(total, 1) - 1) // greatest(total, 1)) AS nb
  FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS passes FROM s5),
b AS (
  SELECT d.*, s6.source_size, s6.target, s6.passes, s6.quota - s6.passes * s6.source_size AS rest, d.h % s6.nb AS block
  FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
o AS (
  SELECT *, CAST('0x' || substr(md5('7:block:' || coalesce(source, chr(0)) || ':' || CAST(block AS VARCHAR)), 1, 15) AS BIGINT) AS bo FROM b),
a AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY bo, block, h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM o)
SELECT doc_id, size, source_size, target, CAST(size * passes + greatest(0, least(size, rest - ahead)) AS BIGINT) AS taken FROM a
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_quality": op3_quality,
        "op4_sharding": op4_sharding,
        "op5_line_dedup": op5_line_dedup,
        "op6_language_id": op6_language_id,
        "op7_toxicity": op7_toxicity,
        "op8_media_columns": op8_media_columns,
        "op9_mixing": op9_mixing,
        "op10_decontamination": op10_decontamination,
        "op11_warc": op11_warc,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op9_mixing": OP9_SQL, "op11_warc": OP11_SQL, "op12_spelling_variants": OP12_SQL}
