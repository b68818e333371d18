"""Near-duplicate documents: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .store import bounded_batches, cut, discard, stored
from .tokens import U64, Words, mix, slices

EMPTY = U64(2**64 - 1)
#: A linked pair goes unseen by every band with at most this probability.
MISS = 1e-6
#: Members of an inner bucket that are held against each other; larger inner buckets get hubs of their own.
SMALL = 64


def bands_for(threshold: float) -> tuple[int, int]:
    """(bands, rows of a band) so that a pair at the threshold is missed with probability ``MISS`` at most."""
    rows = 5 if threshold >= 0.85 else 4 if threshold >= 0.75 else 3 if threshold >= 0.6 else 2
    return math.ceil(math.log(MISS) / math.log(1 - threshold**rows)), rows


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes, sorted, and the rows' offsets; a shorter row is one shingle."""
    counts = np.diff(words.at)
    grams = words.grams(size)
    parts, ends = [], np.zeros(len(counts) + 1, np.int64)
    for i, n in enumerate(counts.tolist()):
        s = int(words.at[i])
        if n >= size:
            part = grams[s : s + n - size + 1].copy()
            part.sort()
            if len(part) > 1:
                part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        elif n:
            part = np.zeros(1, np.uint64)
            for h in words.hashes[s : s + n]:
                part = mix(part + h, 100 + n)
        else:
            part = np.zeros(0, np.uint64)
        parts.append(part)
        ends[i + 1] = ends[i] + len(part)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), ends


def sketches(values: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketches of the sets, one row of ``bins`` values each.

    In round i < bins every element goes to a random bin with a value in
    [i, i + 1); in round bins + j every element goes to bin j, so after twice
    ``bins`` rounds no bin is empty.  A bin keeps its least value, so sets are
    left alone once their bins are full.
    """
    n = len(offsets) - 1
    out = np.full(n * bins, EMPTY, np.uint64)
    sizes = np.diff(offsets)
    rows = np.repeat(np.arange(n), sizes)
    todo, elements, owner = sizes > 0, values, rows
    for turn in range(2 * bins):
        if not len(elements):
            break
        h = mix(elements, 1000 + turn)
        if turn < bins:
            bin_ = (((h >> U64(32)) * U64(bins)) >> U64(32)).astype(np.int64)
        else:
            bin_ = np.full(len(h), turn - bins, np.int64)
        value = (U64(turn) << U64(55)) | (mix(h, 7) >> U64(9))
        np.minimum.at(out, owner * bins + bin_, value)
        open_ = todo & (out.reshape(n, bins) == EMPTY).any(axis=1)
        if open_.sum() < todo.sum():
            keep = open_[owner]
            elements, owner, todo = elements[keep], owner[keep], open_
    return out.reshape(n, bins)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sketch), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sketch), b + 1, np.uint64)
        for r in range(rows):
            key = mix(key + sketch[:, b * rows + r], 3)
        out[:, b] = key
    return out


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), _longs(values))


def _set_sums(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two sums of each set's hashes, by which equal sets are told; 0 for empty sets."""
    counts = np.diff(offsets)
    sums = [np.add.reduceat(np.append(mix(values, s), U64(0)), offsets[:-1]) if len(counts) else np.zeros(0, np.uint64) for s in (11, 12)]
    return [np.where(counts > 0, x, U64(0)) for x in sums]


def _sketcher(size: int, lower: bool, bands: int, rows: int):
    def run(batches):
        for batch in slices(batches, "text"):
            values, offsets = shingle_sets(Words(batch.column(1), lower=lower), size)
            keys = band_keys(sketches(values, offsets, bands * rows), bands, rows)
            sums = _set_sums(values, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.diff(offsets)), _longs(sums[0]), _longs(sums[1]), _lists(keys.reshape(-1), np.arange(len(keys) + 1) * bands)],
                names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands"],
            )

    return run


def _shingler(size: int, lower: bool):
    """(class, shingles) of the rows whose set is that of the wanted class."""

    def run(batches):
        for batch in slices(batches, "text"):
            values, offsets = shingle_sets(Words(batch.column(0), lower=lower), size)
            same = pa.array(_set_sums(values, offsets)[0].view(np.int64) == batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(1), _lists(values, offsets)], names=["class", "shingles"]).filter(same)

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, ..) with the shingles of both, sa and sb."""
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b")


def _over(x: Column, y: Column | int) -> Column:
    """x / y, rounded up."""
    return F.ceil(x / F.lit(y))


def _grouped(docs: DataFrame, shingle: int, num: int, den: int, lower: bool, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) of every row; text_key tells texts apart."""
    bands, rows = bands_for(num / den)
    text = F.col(text_col).cast("string")
    base = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    drawn = base.mapInArrow(_sketcher(shingle, lower, bands, rows), "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>")
    drawn = stored(drawn, "sketches")
    # rows with equal sets form a class, which the row of least id speaks for
    full = drawn.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("least_id"), F.first("bands").alias("bands"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    members = classes.select("class", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    buckets = stored(members.join(shared, "key", "left_semi").select("key", "class", "n"), "buckets")
    wanted = classes.join(buckets, "class", "left_semi").select(F.col("least_id").alias("doc_id"), "class", "set_a")
    sets = base.join(wanted, "doc_id").select("text", "class", "set_a").mapInArrow(_shingler(shingle, lower), "class long, shingles array<long>")
    sets = stored(sets.groupBy("class").agg(F.first("shingles").alias("shingles")), "sets")
    roots = cut(sets.select("class", F.col("class").alias("root")))
    live, first = buckets, True

    def merge(found: DataFrame) -> None:
        """Take the verified links (a, b) into the components."""
        nonlocal roots
        if not found.take(1):
            return
        ends = found.join(roots.toDF("a", "ra"), "a").join(roots.toDF("b", "rb"), "b").where("ra <> rb")
        moved = connected_components(ends, "ra", "rb").select(F.col("node").alias("root"), F.col("root").alias("to"))
        before, roots = roots, cut(roots.join(moved, "root", "left").select("class", F.coalesce("to", "root").alias("root")))
        discard(before)

    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    while live.take(1):
        # each bucket's hub: the member that meets the most others in all buckets
        sizes = live.groupBy("key").agg(F.count("*").alias("m"))
        degree = live.join(sizes, "key").groupBy("class").agg(F.sum("m").alias("degree"))
        ranked = cut(live.join(degree, "class"))
        hub = ranked.groupBy("key").agg(F.min(F.struct((-F.col("degree")).alias("d"), F.col("class").alias("class"), F.col("n").alias("n"))).alias("h"))
        hub = hub.select("key", F.col("h.class").alias("a"), F.col("h.n").alias("na"))
        # at first the buckets of a hub are one; later each stays by itself, so that inner buckets shrink from round to round
        group, first = F.col("a" if first else "key"), False
        stars = cut(ranked.join(hub, "key").where("class <> a").select(group.alias("g"), "a", F.col("class").alias("b"), "na", F.col("n").alias("nb")).distinct())
        met = _with_sets(stars, sets).select("g", "a", "b", "na", "nb", common.alias("common"))
        met = cut(met.withColumn("linked", F.col("common") * (num + den) >= num * (F.col("na") + F.col("nb"))))
        discard(ranked, stars, live)
        merge(met.where("linked").select("a", "b"))
        inner = _inner_buckets(met, roots, sets, num, den)
        discard(met)
        if inner is None:
            break
        pairs = cut(_candidates(inner.where(F.col("m") <= SMALL), num, den))
        found = _with_sets(pairs, sets).where((num + den) * common >= num * (F.size("sa") + F.size("sb")))
        found = cut(found.select("a", "b"))
        merge(found)
        live = cut(inner.where(F.col("m") > SMALL).select("key", F.col("b").alias("class"), "n"))
        discard(pairs, found, inner)

    # a component is named by its least document
    placed = roots.join(classes.select("class", "least_id"), "class")
    named = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    placed = placed.join(named, "root").select("class", "component_id")
    of_class = classes.select("class", "set_a", "set_b", "n_shingles", "least_id").join(placed, "class", "left")
    of_class = cut(of_class.select("set_a", "set_b", "n_shingles", F.coalesce("component_id", "least_id").alias("component_id")))
    discard(sets, roots, classes)
    out = drawn.select("doc_id", "text_key", "n_shingles", "set_a", "set_b").join(of_class, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"))


def _inner_buckets(met: DataFrame, roots: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame | None:
    """What members of a hub's bucket can still be linked by, as buckets of their own; None if nothing can.

    met: (bucket g, hub a, member b, sizes na and nb, common, linked).  Members
    that are linked to the hub are in one component, so only pairs (x, y) matter
    of which x isn't linked to it.  Take every member's differences to the hub:
    shingles that it has more, and those that it lacks.  x and y share |x & hub|
    + |y & hub| - |hub| shingles and as many more as they have differences in
    common.  If they are linked, these are most of what y lacks and has more, and
    more the less x is like the hub; so one of them is among the rarest of x's
    differences and of y's.

    Rows: key, b, n, root, role_x, role_y, weight, left, m.  weight is (num +
    den) * (|b & hub| - |hub| / 2) - num * n, so a pair is linked iff its weights
    and (num + den) * (common differences) add up to 0 or more; left is the
    differences from this one on, the rarest first; m the members of the bucket.
    """
    placed = met.join(roots.toDF("b", "root"), "b")
    open_ = placed.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(~F.col("linked")).alias("some")).where("lo <> hi and some").select("g")
    placed = cut(placed.join(open_, "g"))
    if not placed.take(1):
        discard(placed)
        return None
    both = num + den
    more, lack = F.col("nb") - F.col("common"), F.col("na") - F.col("common")
    # the least differences that a linked pair has in common: by x, and by y if x isn't linked to the hub
    by_x = _over((F.col("na") + F.col("nb")) * num - both * F.col("common"), den)
    by_y = F.floor((den * lack + num * more) / F.lit(both)) + 1
    as_x = F.when(F.col("linked"), 0).otherwise(more + lack - by_x + 1)
    as_y = more + lack - F.when(F.col("linked"), by_y).otherwise(F.greatest(by_x, by_y)) + 1
    weight = both * (F.col("common") - F.col("na") / 2) - num * F.col("nb")
    base = placed.select("g", "a", "b", F.col("nb").alias("n"), "root", weight.alias("weight"), (more + lack).alias("size"), as_x.alias("as_x"), as_y.alias("as_y"))
    base = base.where("as_x > 0 or as_y > 0")
    differences = F.explode(F.concat(F.array_except("sb", "sa"), F.array_except("sa", "sb")))
    flat = _with_sets(base, sets).select("g", "b", "n", "root", "weight", "size", "as_x", "as_y", differences.alias("s"))
    flat = stored(flat.withColumn("key", F.xxhash64("g", "s")).drop("s"), "differences")
    seen = flat.groupBy("key").agg(F.count("*").alias("times"), F.max(F.col("as_x") > 0).alias("x"), F.max(F.col("as_y") > 0).alias("y"))
    place = F.row_number().over(Window.partitionBy("g", "b").orderBy("times", "key"))
    ranked = flat.join(seen, "key").withColumn("place", place).where("times > 1 and x and y and (place <= as_x or place <= as_y)")
    rows = cut(ranked.select("key", "b", "n", "root", (F.col("place") <= F.col("as_x")).alias("role_x"), (F.col("place") <= F.col("as_y")).alias("role_y"), "weight", (F.col("size") - F.col("place") + 1).alias("left")))
    # only members that some partner in the bucket can be enough for, going by the greatest weights and what is left
    top = lambda role, c: F.max(F.when(F.col(role), c))
    full = F.col("weight") + both * F.col("left")
    best = rows.groupBy("key").agg(*[top(f"role_{r}", c).alias(f"{n}_{r}") for r in "xy" for n, c in (("weight", F.col("weight")), ("full", full))], F.min("root").alias("lo"), F.max("root").alias("hi"))
    enough = lambda r: (F.col("weight") + F.col(f"full_{r}") >= 0) & (full + F.col(f"weight_{r}") >= 0)
    rows_in = rows.join(best.where("lo <> hi"), "key")
    rows_in = rows_in.withColumn("role_x", F.coalesce(F.col("role_x") & enough("y"), F.lit(False))).withColumn("role_y", F.coalesce(F.col("role_y") & enough("x"), F.lit(False)))
    kept = cut(rows_in.where("role_x or role_y").select(*rows.columns))
    counts = kept.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("role_x").alias("x"), F.max("role_y").alias("y"))
    inner = cut(kept.join(counts.where("m > 1 and lo <> hi and x and y").select("key", "m"), "key"))
    discard(placed, flat, rows, kept)
    return inner


def _candidates(inner: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of the buckets' members, in different components, that are linked if all that they can have in common is."""
    x = inner.where("role_x").select("key", F.col("b").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx"), F.col("weight").alias("wx"), F.col("left").alias("lx"))
    y = inner.where("role_y").select(F.col("key").alias("key_y"), F.col("b").alias("y"), F.col("n").alias("ny"), F.col("root").alias("ry"), F.col("weight").alias("wy"), F.col("left").alias("ly"))
    enough = F.col("wx") + F.col("wy") + (num + den) * F.least("lx", "ly") >= 0
    sizes = F.least("nx", "ny") * den >= F.greatest("nx", "ny") * num
    pairs = x.join(y, (F.col("key") == F.col("key_y")) & (F.col("rx") != F.col("ry")) & sizes & enough)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose sets of word shingles have Jaccard similarity >= num / den.

    Returns one row per input row: doc_id, n_shingles, component_id (least id
    that is reachable over links) and kept (doc_id is component_id).

    1. A scan sketches each whole text.  Rows with equal sets form one class
       (combined before the shuffle), so copies never meet pairwise.
    2. Bands of the sketch give buckets of classes.  A bucket's members are
       compared with its hub, the one that meets the most others.  Members that
       are linked to it are in one component; another link needs rare
       differences to the hub that both members have, which make the inner
       buckets.  Small ones give candidates, larger ones get hubs of their own,
       until no bucket is left.  So none is capped and no link is lost.
    3. Every link is confirmed on the full sets.

    Null or empty texts, and texts without words, have empty sets and no links.
    A null id gives component_id null and kept true.  Rows that repeat an id are
    judged each by its own text.  Other columns are ignored.
    """
    found = _grouped(docs, shingle, num, den, lower, id_col, text_col)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one left of each group of near duplicates: the one with the least id.

    All columns stay, whatever their names.  Rows that repeat an id are one
    document: of those that are the least of their group the one whose JSON form
    is least stays.  Rows with a null id are in no group and
    all stay.  An empty table gives an empty one.
    """
    found = _grouped(docs, shingle, num, den, True, id_col, text_col).where("doc_id = component_id")
    found = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    found = cut(found.withColumnRenamed("doc_id", "id").join(found.groupBy(F.col("doc_id").alias("id")).agg(F.sum("n").alias("rows")), "id"))
    # all columns travel in one, so that none can clash with ours
    text = F.col(text_col).cast("string")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_key"))
    rows = own.join(found.where("rows = 1"), ["id", "text_key"], "left_semi").unionByName(own.where("id is null"))
    rows = rows.select("doc")
    if found.where("rows > 1").take(1):
        again = own.join(found.where("rows > 1"), ["id", "text_key"], "left_semi")
        rows = rows.unionByName(again.groupBy("id").agg(F.min_by("doc", F.to_json("doc")).alias("doc")).select("doc"))
    return rows.select("doc.*")
