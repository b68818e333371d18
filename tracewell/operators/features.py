"""Node text and temporal neighbourhoods as vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize_nodes
from ..sources.cdm import NODE_TYPES, RELATIONS
from .skipgram import skip_gram
from .store import cut


#: Texts that one task of the word-vector training takes.
ROWS_A_TASK = 200_000


def build_corpus(nodes: DataFrame, use_node_types: bool = False) -> DataFrame:
    """(msg, tokens): one token list for each distinct message, that of its greatest node id."""
    rows = nodes.select("msg", "index_id", tokenize_nodes(F.col("node_type"), F.col("msg"), use_node_types).alias("tokens"))
    return rows.groupBy("msg").agg(F.max_by("tokens", "index_id").alias("tokens"))


def unit(vector: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def train_word_vectors(corpus: DataFrame, dim: int = 128, window: int = 5, min_count: int = 1, epochs: int = 50, seed: int = 0, partitions: int | None = None, negative: int = 5, rounds: int = 10) -> DataFrame:
    """(word, vector): skip-gram vectors with negative samples, at length 1.

    Parts of ``ROWS_A_TASK`` texts train side by side and are averaged ``rounds``
    times; a corpus of one part needs no rounds.
    """
    corpus = cut(corpus)
    partitions = partitions or 1 + corpus.count() // ROWS_A_TASK
    found = skip_gram(corpus, dim, window, min_count, epochs, negative, seed, partitions, rounds)
    return found.select("word", unit(F.col("vector")).alias("vector"))


def position_weight(i: Column, n: Column, decline: float = 30) -> Column:
    """Weight of the i-th of n tokens, i from 1 on: an arithmetic series that sums to 1."""
    d = F.lit(-1.0) / (F.lit(float(decline)) * n)
    return 1.0 / n - (n - 1) * d / 2 + (i - 1) * d


def sum_vectors(df: DataFrame, by: list[str], vector: str = "vector", weight: str = "weight") -> DataFrame:
    """Weighted sums of arrays by key, element by element, combined before the shuffle."""
    flat = df.select(*by, F.posexplode(vector).alias("p", "x"), F.col(weight).alias("w"))
    sums = flat.groupBy(*by, "p").agg(F.sum(F.col("x") * F.col("w")).alias("x"))
    return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias(vector))


def node_vectors(nodes: DataFrame, word_vectors: DataFrame, decline: float = 30, use_node_types: bool = False) -> DataFrame:
    """(index_id, vector): position-weighted mean of the message's word vectors at length 1; null without known words.

    Worked out once for each distinct message and joined back to the nodes.
    """
    corpus = build_corpus(nodes, use_node_types)
    words = corpus.select("msg", F.size("tokens").alias("n"), F.posexplode("tokens").alias("i", "word"))
    weighted = words.join(word_vectors, "word").withColumn("weight", position_weight(F.col("i") + 1, F.col("n"), decline))
    sums = sum_vectors(weighted, ["msg"]).select("msg", unit(F.col("vector")).alias("vector"))
    return nodes.select("index_id", "msg").join(sums, "msg", "left").select("index_id", "vector")


def one_hot(column: Column, vocabulary: tuple[str, ...]) -> Column:
    return F.array(*[F.when(column == v, 1.0).otherwise(0.0) for v in vocabulary])


def edge_vectors(tw_edges: DataFrame, nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """The edges with ``vector``: source type, source vector, relation, destination type, destination vector."""
    known = nodes.select("index_id", "node_type").join(vectors, "index_id")
    side = lambda c: known.select(F.col("index_id").alias(c), F.col("node_type").alias(f"{c}_type"), F.col("vector").alias(f"{c}_vec"))
    both = tw_edges.join(side("src"), "src").join(side("dst"), "dst")
    parts = [one_hot(F.col("src_type"), NODE_TYPES), F.col("src_vec"), one_hot(F.col("operation"), RELATIONS), one_hot(F.col("dst_type"), NODE_TYPES), F.col("dst_vec")]
    return both.select(*tw_edges.columns, F.concat(*parts).alias("vector"))


def split_edge_vector(df: DataFrame, dim: int, use_node_type: bool = True, predict_relation: bool = True, edge_features: str = "edge_type", mode: str = "text") -> DataFrame:
    """x_src, x_dst, msg, edge_feats, y out of ``vector``; a wrong length is an error.

    ``mode`` 'only_type' leaves the text vectors out.  msg has no relation when
    that is what is predicted; edge_feats is the relation, msg or nothing.
    """
    t, r = len(NODE_TYPES), len(RELATIONS)
    starts = {"src_type": (1, t), "src_vec": (1 + t, dim), "edge": (1 + t + dim, r), "dst_type": (1 + t + dim + r, t), "dst_vec": (1 + 2 * t + dim + r, dim)}
    wanted = 2 * (t + dim) + r
    checked = F.when(F.size("vector") == wanted, F.col("vector")).otherwise(F.raise_error(F.lit(f"edge vectors must have {wanted} elements")).cast("array<double>"))
    part = {k: F.slice(F.col("__v"), a, n) for k, (a, n) in starts.items()}
    if mode == "only_type":
        x_src, x_dst = part["src_type"], part["dst_type"]
    else:
        x_src, x_dst = (F.concat(part[f"{e}_vec"], part[f"{e}_type"]) if use_node_type else part[f"{e}_vec"] for e in ("src", "dst"))
    msg = F.concat(x_src, x_dst) if predict_relation else F.concat(x_src, part["edge"], x_dst)
    feats = {"edge_type": part["edge"], "msg": msg, "none": F.array().cast("array<double>")}[edge_features]
    y = F.array_position(part["edge"], F.lit(1.0)).cast("int")
    return df.withColumn("__v", checked).select(*[c for c in df.columns if c != "vector"], x_src.alias("x_src"), x_dst.alias("x_dst"), msg.alias("msg"), feats.alias("edge_feats"), y.alias("y"))


def _ends(edges: DataFrame) -> DataFrame:
    pairs = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr")))
    return edges.select("e_id", "batch", F.explode(pairs).alias("p")).select("p.node", "p.nbr", "e_id", "batch")


def last_k_neighbors(edges: DataFrame, k: int = 20) -> DataFrame:
    """(node, batch, neighbors): for each node of a batch its k latest edges of earlier batches, latest first.

    edges: src, dst, e_id (in order of time), batch.  Both directions count,
    repeated neighbours stay.  No more than k edges of a batch can matter, and no
    more than the k batches before, so a hub's lists stay short.
    """
    by = Window.partitionBy("node", "batch").orderBy(F.desc("e_id"), "nbr")
    few = _ends(edges).withColumn("r", F.row_number().over(by)).where(F.col("r") <= k)
    lists = few.groupBy("node", "batch").agg(F.sort_array(F.collect_list(F.struct("e_id", "nbr")), asc=False).alias("own"))
    before = Window.partitionBy("node").orderBy("batch").rowsBetween(-k, -1)
    earlier = F.sort_array(F.flatten(F.collect_list("own").over(before)), asc=False)
    return lists.select("node", "batch", F.slice(earlier, 1, k).alias("neighbors"))


def neighbor_snapshot(edges: DataFrame, k: int = 20) -> DataFrame:
    """(node, nbr, e_id): each node's k latest edges in the end."""
    by = Window.partitionBy("node").orderBy(F.desc("e_id"), "nbr")
    return _ends(edges).withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).select("node", "nbr", "e_id")


def neighbor_features(edges: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """(node, batch, vector): mean of the vectors of the node's last k neighbours; nodes without any are missing."""
    flat = last_k_neighbors(edges, k).select("node", "batch", F.explode("neighbors").alias("n")).select("node", "batch", F.col("n.nbr").alias("index_id"))
    joined = flat.join(vectors.where("vector is not null"), "index_id")
    counted = joined.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("node", "batch")))
    return sum_vectors(counted, ["node", "batch"])
