"""How surprising an edge is."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.cdm import RELATIONS


def edge_surprisal(train: DataFrame, edges: DataFrame, alpha: float = 1.0, n_relations: int = len(RELATIONS)) -> DataFrame:
    """``loss`` = -ln((n(types, operation) + alpha) / (n(types) + n_relations * alpha)), counted on ``train``.

    Edges have src_type, dst_type and operation; types and relations are few, so
    the counts are.
    """
    counts = train.groupBy("src_type", "dst_type", "operation").agg(F.count("*").alias("__c"))
    totals = counts.groupBy("src_type", "dst_type").agg(F.sum("__c").alias("__t"))
    joined = edges.join(counts, ["src_type", "dst_type", "operation"], "left").join(totals, ["src_type", "dst_type"], "left")
    c, t = F.coalesce("__c", F.lit(0)), F.coalesce("__t", F.lit(0))
    return joined.withColumn("loss", -F.log((c + F.lit(alpha)) / (t + F.lit(n_relations * alpha)))).drop("__c", "__t")


def fit_edge_classifier(train: DataFrame, max_iter: int = 20, reg: float = 1e-3):
    """Multinomial regression of ``operation`` (one of RELATIONS) on ``features`` (array of floats)."""
    return LogisticRegression(featuresCol="__x", labelCol="__y", maxIter=max_iter, regParam=reg, family="multinomial").fit(_vectors(train))


def _vectors(df: DataFrame) -> DataFrame:
    label = F.array_position(F.array(*[F.lit(r) for r in RELATIONS]), F.col("operation")) - 1
    return df.withColumn("__x", array_to_vector(F.col("features").cast("array<double>"))).withColumn("__y", label.cast("double"))


def score_edges(model, edges: DataFrame) -> DataFrame:
    """``loss`` = -ln p(operation) under the classifier; a relation that it never saw has the least probability."""
    p = vector_to_array("probability")
    scored = model.transform(_vectors(edges)).withColumn("__p", F.coalesce(F.get(p, F.col("__y").cast("int")), F.lit(0.0)))
    return scored.withColumn("loss", -F.log(F.greatest("__p", F.lit(1e-12)))).select(*edges.columns, "loss")


def coefficients(model) -> dict[str, tuple[float, list[float]]]:
    """Intercept and weights of each relation of a fitted classifier; relations that it never saw are left out."""
    weights, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    return {name: (float(intercepts[i]), weights[i].tolist()) for i, name in enumerate(RELATIONS[: len(intercepts)])}


def score_edges_with(given: dict[str, tuple[float, list[float]]], edges: DataFrame) -> DataFrame:
    """``loss`` = -ln softmax of the edge's relation, from intercepts and weights of relations; the table's own expressions, no model is run.

    A relation without coefficients has the least probability.
    """
    x = F.col("features").cast("array<double>")
    logits = F.array(*[F.lit(b) + F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v) for b, w in given.values()])
    scored = edges.withColumn("__z", logits).withColumn("__top", F.array_max("__z"))
    total = F.aggregate("__z", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("__top")))
    own = F.try_element_at("__z", F.nullif(F.array_position(F.array(*[F.lit(r) for r in given]), F.col("operation")).cast("int"), F.lit(0)))
    loss = F.log(total) + F.col("__top") - own
    return scored.withColumn("loss", F.coalesce(F.least(loss, -F.log(F.lit(1e-12))), -F.log(F.lit(1e-12)))).select(*edges.columns, "loss")


def score_with(fn: Callable[[pd.DataFrame], pd.Series], edges: DataFrame) -> DataFrame:
    """``loss`` by a function of the caller, over batches of edges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(loss=fn(batch).astype("float64"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema.fields)
    return edges.mapInPandas(run, fields + ", loss double")


def describe_losses(losses: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both ends' messages beside the loss; nodes: index_id, msg."""
    src = nodes.select(F.col("index_id").alias("srcnode"), F.col("msg").alias("srcmsg"))
    dst = nodes.select(F.col("index_id").alias("dstnode"), F.col("msg").alias("dstmsg"))
    return losses.join(src, "srcnode", "left").join(dst, "dstnode", "left")


def loss_summary(losses: DataFrame) -> DataFrame:
    """(tw, n_nodes, n_edges, mean_loss, first, last)."""
    ends = losses.select("tw", F.explode(F.array("srcnode", "dstnode")).alias("n")).groupBy("tw").agg(F.countDistinct("n").alias("n_nodes"))
    rest = losses.groupBy("tw").agg(F.count("*").alias("n_edges"), F.avg("loss").alias("mean_loss"), F.min("time").alias("first"), F.max("time").alias("last"))
    return ends.join(rest, "tw")
