"""From edge losses to alerts, and how good they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import dense_index, running, running_sums
from .store import cut


QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9}


def loss_thresholds(losses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Largest, mean, percentiles, variance and deviation (of the population) of the losses.

    Percentiles are exact: losses are numbered in sorted ranges and the rows
    around each rank looked up, so no task holds all of them.
    """
    by = by or []
    ranked = dense_index(losses.where("loss is not null").select(*by, "loss"), [*by, "loss"], "__rank")
    groups = ranked.groupBy(*by).agg(
        F.min("__rank").alias("__first"), F.count("*").alias("__n"), F.max("loss").alias("max_val_loss"), F.avg("loss").alias("mean_val_loss"), F.var_pop("loss").alias("var"), F.stddev_pop("loss").alias("std")
    )
    groups = cut(groups)
    ranks = F.explode(F.array(*[F.struct(F.lit(n).alias("q"), ((F.col("__n") - 1) * p).alias("at")) for n, p in QUANTILES.items()]))
    wanted = groups.where("__n > 0").select(*by, "__first", ranks.alias("r")).select(*by, "__first", "r.q", "r.at")
    share = F.col("at") - F.floor("at")
    sides = F.explode(F.array(F.struct(F.floor("at").alias("i"), (1 - share).alias("w")), F.struct(F.ceil("at").alias("i"), share.alias("w"))))
    wanted = wanted.select(*by, "q", "__first", sides.alias("s")).select(*by, "q", (F.col("__first") + F.col("s.i")).alias("__rank"), F.col("s.w").alias("w"))
    found = wanted.join(ranked.select("__rank", "loss"), "__rank")
    percentiles = found.groupBy(*by).agg(*[F.sum(F.when(F.col("q") == n, F.col("w") * F.col("loss"))).alias(n) for n in QUANTILES])
    out = groups.join(percentiles, by, "left") if by else groups.crossJoin(F.broadcast(percentiles))
    return out.select(*by, "max_val_loss", "mean_val_loss", *QUANTILES, "var", "std")


def threshold(stats: DataFrame, method: str = "max_val_loss") -> DataFrame:
    if method not in ("max_val_loss", "mean_val_loss"):
        raise ValueError(f"no such threshold method: {method}")
    return stats.withColumnRenamed(method, "threshold").select(*[c for c in ("model_epoch",) if c in stats.columns], "threshold")


def node_losses(losses: DataFrame, use_dst: bool = True) -> DataFrame:
    """One row for each edge and endpoint that it counts for; a self-loop counts twice."""
    ends = F.array("srcnode", "dstnode") if use_dst else F.array("srcnode")
    return losses.withColumn("node", F.explode(ends)).drop("srcnode", "dstnode")


def node_scores(by_node: DataFrame, method: str = "max_val_loss", by: list[str] | None = None) -> DataFrame:
    """(node, score, tw_with_max_loss): largest or mean loss; the first window with the largest, -1 if none is above 0."""
    if method not in ("max_val_loss", "mean_val_loss"):
        raise ValueError(f"no such score method: {method}")
    score = F.max("loss") if method == "max_val_loss" else F.avg("loss")
    peak = F.max(F.when(F.col("loss") > 0, F.struct(F.col("loss"), (-F.col("tw")).alias("neg"))))
    out = by_node.groupBy(*(by or []), "node").agg(score.alias("score"), peak.alias("__p"))
    return out.withColumn("tw_with_max_loss", F.coalesce(-F.col("__p.neg"), F.lit(-1)).cast("int")).drop("__p")


def label_by_threshold(scores: DataFrame, limit: DataFrame, by: list[str] | None = None) -> DataFrame:
    """y_hat: score above the threshold; limit is one row, or one for each value of ``by``; scores without a limit are no alerts."""
    joined = scores.join(limit, by, "left") if by else scores.crossJoin(F.broadcast(limit))
    return joined.withColumn("y_hat", F.coalesce((F.col("score") > F.col("threshold")).cast("int"), F.lit(0))).drop("threshold")


def label_by_kmeans(scores: DataFrame, k: int = 20, by: list[str] | None = None) -> DataFrame:
    """y_hat: 1 for the higher of two clusters among the k best scores (all, if fewer), for each value of ``by`` if given.

    Two means in one dimension are found exactly: of all cuts of the sorted
    scores the one with the least squared error inside the clusters, the lower
    cut of equal ones.  Only k rows of a value are looked at.
    """
    by = by or []
    best = _first_rows(scores.select(*by, "node", "score"), by, [F.desc("score"), F.desc("node")], k).drop("place")
    order = Window.partitionBy(*by).orderBy("score", "node")
    upto, every = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    s, q = F.col("score"), F.col("score") * F.col("score")
    sums = best.select(*by, "node", "score", F.row_number().over(order).alias("i"), F.sum(s).over(upto).alias("s1"), F.sum(q).over(upto).alias("q1"), F.count("*").over(every).alias("n"), F.sum(s).over(every).alias("st"), F.sum(q).over(every).alias("qt"))
    rest = F.col("n") - F.col("i")
    inner = (F.col("q1") - F.col("s1") * F.col("s1") / F.col("i")) + F.when(rest > 0, F.col("qt") - F.col("q1") - (F.col("st") - F.col("s1")) * (F.col("st") - F.col("s1")) / rest)
    cut = sums.withColumn("err", F.round(inner, 9)).withColumn("cut", F.min(F.when(rest > 0, F.struct("err", "i"))).over(every))
    alerts = cut.where((F.col("i") > F.col("cut.i")) | F.col("cut").isNull()).select(*by, "node").withColumn("y_hat", F.lit(1))
    return scores.join(alerts if by else F.broadcast(alerts), [*by, "node"], "left").withColumn("y_hat", F.coalesce("y_hat", F.lit(0)))


def _first_rows(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each value of ``by`` with their ``place``; every task hands on k rows of a value at most."""
    if not by:
        return df.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def label_truth(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """y_true: whether the node is in the ground truth (node)."""
    known = truth.select("node").distinct().withColumn("y_true", F.lit(1))
    return scores.join(known, "node", "left").withColumn("y_true", F.coalesce("y_true", F.lit(0)))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def metrics_of_counts(counts: DataFrame) -> DataFrame:
    """Measures of tp, fp, tn, fn; null where a division has no meaning; mcc 0 then."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    recall, fpr, precision = _ratio(tp, tp + fn), _ratio(fp, fp + tn), _ratio(tp, tp + fp)
    specificity = _ratio(tn, tn + fp)
    bottom = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    measures = {
        "precision": precision,
        "recall": recall,
        "fpr": fpr,
        "fscore": _ratio(2 * precision * recall, precision + recall),
        "accuracy": _ratio(tp + tn, tp + fp + tn + fn),
        "balanced_accuracy": (recall + specificity) / 2,
        "lr_plus": _ratio(recall, fpr),
        "dor": _ratio(tp * tn, fp * fn),
        "mcc": F.when(bottom == 0, 0.0).otherwise((tp * tn - fp * fn) / bottom),
    }
    return counts.select("*", *[v.alias(k) for k, v in measures.items()])


def classification_metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Confusion counts and measures of (y_true, y_hat); without any label 1 all counts are 1."""
    hit = lambda t, p: F.sum(F.when((F.col("y_true") == t) & (F.col("y_hat") == p), 1).otherwise(0))
    counts = results.groupBy(*(by or [])).agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fn"))
    none = (F.col("tp") + F.col("fn")) == 0
    counts = counts.select(*(by or []), *[F.when(none, F.lit(1).cast("long")).otherwise(F.col(c)).alias(c) for c in ("tp", "fp", "tn", "fn")])
    return metrics_of_counts(counts)


def _totals(results: DataFrame, by: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(F.sum("y_true").alias("p"), F.sum(1 - F.col("y_true")).alias("n"))


def _beside(rows: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the totals of their value of ``by``; without values the totals are one row."""
    return rows.join(totals, by) if by else rows.crossJoin(F.broadcast(totals))


def score_curve(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, score, pos, neg, tp, fp, p, n): labels with each distinct score, at or above it, and in all."""
    by = by or []
    groups = results.groupBy(*by, "score").agg(F.sum("y_true").alias("pos"), F.sum(1 - F.col("y_true")).alias("neg"))
    if by:
        curve = running(groups, by, [F.desc("score")], {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))})
    else:
        curve = running_sums(groups, [F.desc("score")], {"pos": "tp", "neg": "fp"})
    return _beside(curve, _totals(results, by), by)


def ranking_metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, auc, ap): area under the ROC curve by trapezoids, average precision by steps; null without both labels."""
    by = by or []
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0)
    steps = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    out = score_curve(results, by).groupBy(*by).agg(area.alias("a"), steps.alias("s"), F.max("p").alias("p"), F.max("n").alias("n"))
    return out.select(*by, _ratio(F.col("a"), F.col("p") * F.col("n")).alias("auc"), _ratio(F.col("s"), F.col("p")).alias("ap"))


def pr_curve(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    return score_curve(results, by).select(*(by or []), "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), _ratio(F.col("tp"), F.col("p")).alias("recall"))


def best_threshold(results: DataFrame, min_tpr: float = 0.16, by: list[str] | None = None) -> DataFrame:
    """(by, threshold, tpr, fpr): the least false-positive rate among scores with enough true positives; the highest such score."""
    by = by or []
    curve = score_curve(results, by).select(*by, "score", (F.col("tp") / F.col("p")).alias("tpr"), (F.col("fp") / F.col("n")).alias("fpr"))
    best = curve.where(F.col("tpr") >= min_tpr).groupBy(*by).agg(F.min(F.struct("fpr", (-F.col("score")).alias("neg"), "tpr")).alias("b"))
    return best.select(*by, (-F.col("b.neg")).alias("threshold"), F.col("b.tpr").alias("tpr"), F.col("b.fpr").alias("fpr"))


def dor_curve(results: DataFrame, n: int = 300, by: list[str] | None = None) -> DataFrame:
    """(by, threshold, dor, recall) at n even thresholds from the least to the greatest score.

    Every score counts for the last threshold at or below it, found by binary
    search in an array of all, so rows are summed by threshold before anything is
    shuffled; thresholds then add up from above.
    """
    by = by or []
    bounds = results.groupBy(*by).agg(F.min("score").alias("lo"), F.max("score").alias("hi")).where("lo is not null")
    step = (F.col("hi") - F.col("lo")) / max(1, n - 1)
    ticks = bounds.select(*by, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, F.col("hi")).otherwise(F.col("lo") + i * step)).alias("ticks"))
    known = _beside(results.where("score is not null").select(*by, "score", "y_true"), ticks, by)
    # the last i (from 0) whose threshold is at or below the score, by halving what is left of 0 .. n - 1
    span = F.struct(F.lit(0).alias("lo"), F.lit(n - 1).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"] + 1) / 2).cast("int")
        at = F.element_at("ticks", mid + 1) <= F.col("score")
        return F.struct(F.when(at, mid).otherwise(s["lo"]).alias("lo"), F.when(at, s["hi"]).otherwise(F.greatest(mid - 1, s["lo"])).alias("hi"))

    last = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, (n - 1).bit_length()))), span, halve)["lo"]
    counts = known.withColumn("i", last).groupBy(*by, "i").agg(F.sum("y_true").alias("pos"), F.sum(1 - F.col("y_true")).alias("neg"))
    every = ticks.select(*by, F.posexplode("ticks").alias("i", "threshold")).join(counts, [*by, "i"], "left")
    above = Window.partitionBy(*by).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)  # n rows of a value
    sums = every.select(*by, "threshold", *[F.sum(F.coalesce(c, F.lit(0))).over(above).alias(name) for c, name in (("pos", "tp"), ("neg", "fp"))])
    both = _beside(sums, _totals(results.where("score is not null"), by), by)
    fn, tn = F.col("p") - F.col("tp"), F.col("n") - F.col("fp")
    return both.select(*by, "threshold", _ratio(F.col("tp") * tn.cast("double"), F.col("fp") * fn).alias("dor"), _ratio(F.col("tp"), F.col("p")).alias("recall"))


def top_nodes(results: DataFrame, n: int = 10, by: list[str] | None = None) -> DataFrame:
    """The n best-scored nodes of either true label, with their rank, for each value of ``by``; ties by node."""
    return _first_rows(results, [*(by or []), "y_true"], [F.desc("score"), F.col("node")], n)


def fp_window_ratio(results: DataFrame, malicious_windows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of false positives whose peak window holds malicious edges; null without false positives (with ``by``: no row)."""
    wrong = results.where("y_true = 0 and y_hat = 1")
    bad = malicious_windows.select(F.col("tw").alias("tw_with_max_loss")).distinct().withColumn("bad", F.lit(1.0))
    return wrong.join(bad, "tw_with_max_loss", "left").groupBy(*(by or [])).agg(F.avg(F.coalesce("bad", F.lit(0.0))).alias("ratio"))


def evaluate_epochs(results: DataFrame, limits: DataFrame, epoch: str = "model_epoch") -> DataFrame:
    """Counts, measures, auc and ap of every epoch in one pass.

    results: epoch, node, score, y_true; limits: epoch, threshold.
    """
    labelled = label_by_threshold(results, limits, [epoch])
    return classification_metrics(labelled, [epoch]).join(ranking_metrics(results, [epoch]), epoch, "left")


def best_epoch(stats: DataFrame) -> DataFrame:
    """The row of the first epoch with the highest mcc."""
    best = stats.agg(F.max_by(F.struct(*stats.columns), F.struct("mcc", (-F.col("model_epoch")).alias("e"))).alias("b"))
    return best.select("b.*")
