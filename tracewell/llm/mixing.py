"""Mixing sources to target weights, with DataFrame functions only.

A source's documents hash into blocks whose number follows its size.  A target
of m times the source's size takes every block floor(m) times, and then blocks
in a fixed random order until the rest of the target is drawn; the last block
is drawn document by document, the last document word by word.  A splitting
tree deals the drawn blocks to the output shards: at each node a random half of
the node's blocks goes left, so the sources' counts on either side follow the
multivariate hypergeometric distribution, and shards get disjoint blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import broadcast_if_small, cut, stored

WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MOST = 3
#: Blocks of all sources together, besides one that each source has at least; fixed, so tables by block are bounded.
BLOCKS = 4096
#: Levels of the splitting tree: 2**LEVELS output shards.
LEVELS = 4
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(*parts: Column) -> Column:
    """A random-looking number below 2**60 that depends on the parts alone."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, total, target) from (source, source_size).

    Sources by code point, null last, weigh as ``weights`` says, in turn.  All
    sizes are shared by weight; a target stops at ``most`` times the source's
    size and what it would have had beyond is shared by weight among the
    others, until none is above.  With sources in order of cap over weight that
    is one level: those whose cap lies below the level of the rest are capped.
    A source of size 0 gets 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("weight", share).withColumn("cap", F.col("source_size") * most)
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    past, rest = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    ranked = ranked.withColumn("total", F.sum("source_size").over(every))
    ranked = ranked.withColumn("open", F.col("total") - F.coalesce(F.sum("cap").over(past), F.lit(0))).withColumn("open_weight", F.sum("weight").over(rest))
    # cap * open_weight <= weight * open: capped even when all before it are
    ranked = ranked.withColumn("capped", F.col("cap") * F.col("open_weight") <= F.col("weight") * F.col("open"))
    # the first source that isn't capped has the most open weight
    level = F.min(F.when(~F.col("capped"), F.struct((-F.col("open_weight")).alias("neg"), F.col("open").alias("open"), F.col("open_weight").alias("w")))).over(every)
    ranked = ranked.withColumn("level", level)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level.open") / F.col("level.w"))
    return ranked.select("source", "source_size", "total", target.cast("double").alias("target"))


def _plan(sized: DataFrame, weights, most, blocks, seed) -> tuple[DataFrame, DataFrame]:
    """The sources with targets, and their blocks with what is drawn from each."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes, weights, most)
    quota = F.round("target").cast("long")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.lit(blocks) * F.col("source_size") / F.greatest("total", F.lit(1)))).cast("long")
    sources = sources.withColumn("quota", quota).withColumn("n_blocks", n_blocks)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(F.lit(0))
    sources = sources.withColumn("passes", passes.cast("long")).withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
    return cut(sources)


def in_blocks(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows with their source's plan and their block."""
    named = sources.select(F.col("source").alias("__src"), "source_size", "target", "n_blocks", "passes", "rest")
    joined = sized.join(broadcast_if_small(named), F.col("source").eqNullSafe(F.col("__src"))).drop("__src")
    return joined.withColumn("block", F.pmod(F.col("h"), F.col("n_blocks")))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, blocks: int = BLOCKS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(rows, block table): what the mix takes of each row.

    rows: doc_id, size (words; null text: 0), source_size, target (of its
    source), taken (words, repeats counted), block, source, placed, row (a key
    of the row); with ``carry`` all columns of ``docs``, ``__size`` and
    ``__placed``.  ``placed`` holds a (turn, words, out_shard, place) for every
    copy of the row that a leaf of the splitting tree draws with its block, and
    ``taken`` sums their words: size in each whole pass, and in the last,
    partial pass size or, for one row of a source, part of it.  A null source is a
    source; rows that repeat an id are drawn one by one; equal rows
    are drawn alike and share evenly, rounded down, what is left for them; empty input gives none.
    Draws depend on ids, sources and the seed alone, so reruns agree.
    """
    own = [F.col(c) for c in docs.columns] if carry else []
    sized = docs.select(
        *own,
        F.col(source_col).cast("string").alias("__source"),
        word_count(F.col(text_col).cast("string")).alias("__size"),
        draw(F.lit(seed), F.col(id_col)).alias("__h"),
        F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("__crc"),
        *([] if carry else [F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("__row")]),
    )
    if not carry:
        sized = stored(sized, "sized")
    key = F.col(id_col) if carry else F.col("doc_id")
    light = sized.select(F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__h").alias("h"), key.cast("long").alias("id"), F.col("__crc").alias("crc"))
    if carry:
        light = stored(light, "sized")
    sources = _plan(light, weights, most, blocks, seed)
    sums = in_blocks(light, sources).groupBy("source", "block", "passes", "rest").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("order", draw(F.lit(seed), F.lit("block"), F.col("source"), F.col("block")))
    before = Window.partitionBy("source").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("words").over(before), F.lit(0)))
    left = F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("ahead")))
    # drawn: words of the block in the last pass
    table = cut(sums.select("source", "block", "passes", "words", left.cast("long").alias("drawn")))
    named = sources.select(F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("n_blocks").alias("__n"), F.col("passes").alias("__passes"))
    leaves = splitting_tree(table, levels, seed).groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "out_shard"))).alias("__leaves"))
    leaves = leaves.select(F.col("source").alias("__s3"), F.col("block").alias("__b3"), "__leaves")
    state = table.join(leaves, F.col("source").eqNullSafe(F.col("__s3")) & (F.col("block") == F.col("__b3")), "left")
    state = cut(state.select(F.col("source").alias("__s2"), F.col("block").alias("__b"), F.col("drawn").alias("__drawn"), F.col("words").alias("__words"), "__leaves"))
    rows = sized.join(broadcast_if_small(named), F.col("__source").eqNullSafe(F.col("__s"))).withColumn("__block", F.pmod(F.col("__h"), F.col("__n")))
    rows = rows.join(broadcast_if_small(state), F.col("__source").eqNullSafe(F.col("__s2")) & (F.col("__block") == F.col("__b")))
    # Where the draw of a source's last block ends: ranked by narrow rows, so that no task sorts a block's texts.
    order = ["h", "id", "size", "crc"]
    edges = in_blocks(light, sources).select("source", "block", *order)
    partial = table.where("drawn > 0 and drawn < words").select(F.col("source").alias("__s4"), F.col("block").alias("__b4"), "drawn")
    edges = edges.join(broadcast_if_small(partial), F.col("source").eqNullSafe(F.col("__s4")) & (F.col("block") == F.col("__b4")))
    # equal rows, which nothing tells apart, share what is left for them
    edges = edges.groupBy("source", "block", "__s4", "__b4", "drawn", *order).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("ahead", F.coalesce(F.sum(F.col("size") * F.col("n")).over(ahead), F.lit(0))).where("ahead < drawn and drawn <= ahead + size * n")
    edges = cut(edges.select("__s4", "__b4", F.struct(*order).alias("__end"), F.floor((F.col("drawn") - F.col("ahead")) / F.col("n")).alias("__end_words")))
    rows = rows.join(broadcast_if_small(edges), F.col("__source").eqNullSafe(F.col("__s4")) & (F.col("__block") == F.col("__b4")), "left")
    own = F.struct(F.col("__h").alias("h"), key.cast("long").alias("id"), F.col("__size").alias("size"), F.col("__crc").alias("crc"))
    last = F.when(F.col("__drawn") == 0, 0).when(F.col("__end").isNull() | (own < F.col("__end")), F.col("__size")).when(own == F.col("__end"), F.col("__end_words")).otherwise(0)
    rows = rows.withColumn("__last", last)

    def copy(leaf: Column) -> Column:
        words = F.when(leaf["turn"] <= F.col("__passes"), F.col("__size")).otherwise(F.col("__last")).cast("long")
        place = draw(F.lit(seed), F.lit("place"), key, F.col("__crc"), leaf["turn"])
        return F.struct(leaf["turn"].alias("turn"), words.alias("words"), leaf["out_shard"].alias("out_shard"), place.alias("place"))

    placed = F.filter(F.transform("__leaves", copy), lambda x: x["words"] > 0)
    rows = rows.withColumn("__placed", placed)
    if carry:
        return rows.select(*docs.columns, "__size", "__placed"), table
    taken = F.aggregate(F.coalesce(F.col("__placed.words"), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda x, y: x + y)
    rows = rows.withColumn("__taken", taken)
    return (
        rows.select(
            "doc_id",
            F.col("__size").alias("size"),
            F.col("__source_size").alias("source_size"),
            F.col("__target").alias("target"),
            F.col("__taken").alias("taken"),
            F.col("__block").alias("block"),
            F.col("__source").alias("source"),
            F.col("__placed").alias("placed"),
            F.col("__row").alias("row"),
        ),
        table,
    )


def splitting_tree(table: DataFrame, levels: int = LEVELS, seed: int = 7) -> DataFrame:
    """(source, block, turn, quota, out_shard) for every drawn copy of every block, 2**levels output shards.

    ``quota`` is the words that the copy draws: all of the block's, or in the
    last pass what is left for it.  At each node the copies are put in a random
    order and the first half goes left: the split's counts by source are
    multivariate hypergeometric draws and the halves are disjoint, with exact
    sizes.  The table of blocks is bounded.
    """
    copies = F.sequence(F.lit(1), F.col("passes") + F.when(F.col("drawn") > 0, 1).otherwise(0))
    copies = F.when((F.col("passes") > 0) | (F.col("drawn") > 0), copies).otherwise(F.array().cast("array<bigint>"))
    items = table.select("source", "block", "passes", "words", "drawn", F.explode(copies).alias("turn")).withColumn("node", F.lit(0))
    quota = F.when(F.col("turn") <= F.col("passes"), F.col("words")).otherwise(F.col("drawn"))
    items = items.select("source", "block", "turn", quota.alias("quota"), "node")
    for level in range(levels):
        order = draw(F.lit(seed), F.lit("tree"), F.lit(level), F.col("source"), F.col("block"), F.col("turn"))
        place = F.row_number().over(Window.partitionBy("node").orderBy(order, "source", "block", "turn"))
        count = F.count("*").over(Window.partitionBy("node"))
        items = items.select("source", "block", "turn", "quota", (F.col("node") * 2 + F.when(place * 2 <= count + 1, 0).otherwise(1)).alias("node"))
    return items.withColumnRenamed("node", "out_shard")


def _in_shards(records: DataFrame) -> DataFrame:
    """The records gathered by output shard, each piece of a shard in the random order of ``place``."""
    return records.repartition("out_shard", F.col("place") % 64).sortWithinPartitions("out_shard", "place")


def mix_shards(docs: DataFrame, levels: int = LEVELS, seed: int = 7, **options) -> DataFrame:
    """The mix as records of output shards: (doc_id, turn, words, out_shard, place), in a local random order by place."""
    rows, _ = mixed(docs, seed=seed, levels=levels, **options)
    return _in_shards(rows.select("doc_id", F.inline("placed"))).select("doc_id", "turn", "words", "out_shard", "place")


def mix_rows(docs: DataFrame, levels: int = LEVELS, seed: int = 7, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row, taken counted from the written records of the output shards.

    Rows that no leaf draws have a record without a shard and take 0.
    """
    rows, _ = mixed(docs, seed=seed, levels=levels, **options)
    own = ["row", "doc_id", "size", "source_size", "target"]
    records = rows.select(*own, F.inline_outer("placed"))
    # undrawn rows are spread by their key instead of meeting in one task
    records = records.withColumn("place", F.coalesce("place", draw(F.lit(seed), F.lit("undrawn"), F.col("row"))))
    records = stored(_in_shards(records), "records")
    taken = F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("taken")
    return records.groupBy(*own).agg(taken).drop("row")


def mixed_documents(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", levels: int = LEVELS) -> DataFrame:
    """The documents as the mix takes them, whole and unchanged, as often as drawn.

    The copies come by output shard of the splitting tree, in a local random
    order.  All columns stay, whatever their names.  A row that isn't drawn goes;
    of the copy of which only part is drawn, one a source at most, the whole
    document is taken if that is nearer to the target than none of it.  Null
    texts have no words and are never drawn; a null source is a source; rows
    that repeat an id are drawn one by one; an empty table gives an empty one.
    """
    # all columns travel in one, so that none can clash with ours
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    rows, _ = mixed(packed, seed=seed, carry=True, levels=levels)
    copies = rows.select("doc", "__size", F.explode("__placed").alias("copy")).where(F.col("copy.words") * 2 >= F.col("__size"))
    return _in_shards(copies.select("doc", "copy.out_shard", "copy.place")).select("doc.*")
