"""Detection measures against the published rows and plain versions."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import detect, labels, scoring, trace

#: Published counts (tp, fp, tn, fn) with precision and correlation.
PUBLISHED = [
    (22, 10, 268075, 46, 0.69, 0.47), (15, 0, 268085, 53, 1.00, 0.47), (22, 0, 699177, 96, 1.00, 0.43), (2, 0, 699177, 116, 1.00, 0.13),
    (3, 1318, 3132823, 120, 0.00, 0.01), (1, 2, 3134139, 122, 0.33, 0.05), (13, 2, 747381, 56, 0.86, 0.40), (2, 0, 747383, 67, 1.00, 0.17),
    (1, 647, 110715, 40, 0.00, 0.00), (1, 5, 111357, 40, 0.17, 0.06), (4, 8, 150666, 47, 0.33, 0.16), (2, 5, 150669, 49, 0.29, 0.10),
]


def test_published_rows(spark):
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(PUBLISHED)], "i int, tp long, fp long, tn long, fn long")
    for r in detect.metrics_of_counts(df).collect():
        assert r["precision"] == pytest.approx(PUBLISHED[r["i"]][4], abs=0.01)
        assert r["mcc"] == pytest.approx(PUBLISHED[r["i"]][5], abs=0.01)


def test_no_positive_counts_as_ones(spark):
    df = spark.createDataFrame([(0, 0), (0, 1)], "y_true int, y_hat int")
    r = detect.classification_metrics(df).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"], r["mcc"]) == (1, 1, 1, 1, 0)


def two_means(scores):
    s = sorted(scores)
    err = lambda x: sum((v - sum(x) / len(x)) ** 2 for v in x) if x else 0
    cut = min(range(1, len(s)), key=lambda i: (round(err(s[:i]) + err(s[i:]), 9), i))
    return s[cut:]


def test_two_means_of_the_best(spark):
    rng = random.Random(1)
    for n in (2, 7, 20, 45):
        rows = [(i, round(rng.random() ** 3, 6)) for i in range(n)]
        got = detect.label_by_kmeans(spark.createDataFrame(rows, "node long, score double")).where("y_hat = 1").collect()
        assert sorted(r["score"] for r in got) == two_means(sorted(s for _, s in rows)[-20:])
    alone = detect.label_by_kmeans(spark.createDataFrame([(1, 0.5)], "node long, score double")).collect()
    assert [r["y_hat"] for r in alone] == [1]


def test_ranking(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(8) / 8, rng.randrange(2)) for _ in range(60)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)) / len(pos) / len(neg)
    r = detect.ranking_metrics(spark.createDataFrame(rows, "score double, y_true int")).first()
    assert r["auc"] == pytest.approx(auc) and 0 < r["ap"] <= 1


def test_unknown_methods_are_errors(spark):
    df = spark.createDataFrame([(1, 1.0, 0)], "node long, loss double, tw int")
    with pytest.raises(ValueError):
        detect.node_scores(df, "median")
    with pytest.raises(ValueError):
        detect.threshold(detect.loss_thresholds(df), "p90")


def test_missing_ground_truth_is_reported(spark):
    truth = spark.createDataFrame([("a", "u1", "x"), ("a", "u9", "y")], "attack string, node_uuid string, node_label string")
    found, missing = labels.resolve_ground_truth(truth, spark.createDataFrame([("u1", 5)], "node_uuid string, index_id long"))
    assert [r["node"] for r in found.collect()] == [5] and [r["node_uuid"] for r in missing.collect()] == ["u9"]


def test_classifier_learns(spark):
    rows = [(str(i), "EVENT_READ" if i % 2 else "EVENT_WRITE", [float(i % 2), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "event_uuid string, operation string, features array<double>")
    losses = scoring.score_edges(scoring.fit_edge_classifier(df), df).agg(F.max("loss")).first()[0]
    assert losses < 0.1


def test_combined_score_of_constant_scores(spark):
    a = spark.createDataFrame([(0, 1, 2.0), (0, 2, 2.0)], "tw int, node long, score double")
    b = spark.createDataFrame([(0, 1, 1.0), (0, 2, 3.0)], "tw int, node long, score double")
    assert {r["node"]: r["score"] for r in trace.combined_score(a, b).collect()} == {1: 0.0, 2: 1.0}


def epochs(spark, n=400):
    rng = random.Random(11)
    rows = [(e, i, round(rng.random() * (e + 1), 2), int(rng.random() < 0.3), rng.randrange(4)) for e in range(3) for i in range(n)]
    return spark.createDataFrame(rows, "model_epoch int, node long, score double, y_true int, tw_with_max_loss int").repartition(5)


def test_every_measure_by_epoch_is_that_of_the_epoch_alone(spark):
    every = epochs(spark)
    limits = spark.createDataFrame([(0, 0.4), (1, 1.0), (2, 1.5)], "model_epoch int, threshold double")
    bad = spark.createDataFrame([(1,), (3,)], "tw int")
    by = ["model_epoch"]

    def rows(df):
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in sorted(df.columns) if c != "model_epoch")) for r in df.collect()), key=str)

    for e in range(3):
        own, limit = every.where(f"model_epoch = {e}").drop("model_epoch"), limits.where(f"model_epoch = {e}").drop("model_epoch")
        labelled, labelled_by = detect.label_by_threshold(own, limit), detect.label_by_threshold(every, limits, by)
        pairs = [
            (labelled, labelled_by),
            (detect.label_by_kmeans(own), detect.label_by_kmeans(every, by=by)),
            (detect.score_curve(own), detect.score_curve(every, by)),
            (detect.ranking_metrics(own), detect.ranking_metrics(every, by)),
            (detect.best_threshold(own), detect.best_threshold(every, by=by)),
            (detect.dor_curve(own, 50), detect.dor_curve(every, 50, by)),
            (detect.top_nodes(own, 4), detect.top_nodes(every, 4, by)),
            (detect.fp_window_ratio(labelled, bad), detect.fp_window_ratio(labelled_by, bad, by)),
        ]
        for alone, together in pairs:
            assert rows(alone) == rows(together.where(f"model_epoch = {e}"))
    assert detect.label_by_threshold(every, limits, by).count() == every.count()
    assert {r["model_epoch"] for r in detect.evaluate_epochs(every, limits).collect()} == {0, 1, 2}


def test_curve_thresholds_by_search_not_by_a_range_join(spark):
    df = epochs(spark)
    plan = detect.dor_curve(df, 300, ["model_epoch"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = [r.asDict() for r in df.where("model_epoch = 1").collect()]
    lo, hi = min(r["score"] for r in rows), max(r["score"] for r in rows)
    got = sorted((r["threshold"], r["recall"]) for r in detect.dor_curve(df.where("model_epoch = 1"), 7).collect())
    p = sum(r["y_true"] for r in rows)
    for i, (t, recall) in enumerate(got):
        assert abs(t - (lo + i * (hi - lo) / 6)) < 1e-9 and abs(recall - sum(r["y_true"] for r in rows if r["score"] >= t) / p) < 1e-12
    assert detect.dor_curve(df.where("false"), 7).count() == 0


def classified(spark, n=600):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        x = [rng.random(), rng.random(), 1.0 if rng.random() < 0.5 else 0.0]
        rows.append((i, rng.choices(("EVENT_READ", "EVENT_WRITE", "EVENT_CONNECT"), (1 + 4 * x[0], 1 + 3 * x[2], 1))[0], x))
    return spark.createDataFrame(rows, "id long, operation string, features array<double>")


def test_the_fitted_classifier_is_where_the_likelihood_is_flat(spark):
    df = classified(spark)
    model = scoring.fit_edge_classifier(df, max_iter=300, reg=0.0)
    own = scoring.coefficients(model)
    seen = ("EVENT_READ", "EVENT_WRITE", "EVENT_CONNECT")
    rows = df.collect()
    slope = {r: [0.0] * 4 for r in seen}
    total = 0.0
    for row in rows:
        x = [*row["features"], 1.0]
        z = {r: own[r][0] + sum(w * v for w, v in zip(own[r][1], row["features"])) for r in seen}
        top = sum(math.exp(v) for v in z.values())
        total -= z[row["operation"]] - math.log(top)
        for r in seen:
            miss = math.exp(z[r]) / top - (r == row["operation"])
            for i in range(4):
                slope[r][i] += miss * x[i] / len(rows)
    assert max(abs(v) for s in slope.values() for v in s) < 2e-3
    fitted = scoring.score_edges(model, df).agg(F.avg("loss")).first()[0]
    assert fitted == pytest.approx(total / len(rows), abs=1e-6)
    again = scoring.score_edges_with({r: own[r] for r in seen}, df).agg(F.avg("loss")).first()[0]
    assert again == pytest.approx(fitted, abs=1e-6)


def test_a_relation_without_coefficients_is_least_likely(spark):
    df = spark.createDataFrame([("EVENT_OPEN", [1.0]), ("EVENT_READ", [900.0])], "operation string, features array<double>")
    got = [r["loss"] for r in scoring.score_edges_with({"EVENT_READ": (0.0, [1.0]), "EVENT_WRITE": (0.0, [-1.0])}, df).collect()]
    assert got == [pytest.approx(-math.log(1e-12)), pytest.approx(0.0)]
