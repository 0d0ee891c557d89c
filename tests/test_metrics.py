import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.functions.numbers import bin_by_edges, unit_interval_edges
from tidegate.operators import metrics as M

# Published confusion counts and the rates that belong to them.
PUBLISHED = [
    ("svc", 13211, 50932, 24935, 190, 0.4172685358029529, 0.24978891541308493, 0.6713327270091081, 0.20596167937265172),
    ("isolation", 9840, 6530, 69337, 3561, 0.7966070845340261, 0.5983057842508518, 0.08607167806819829, 0.6010995723885155),
    ("stack", 13141, 833, 75034, 260, 0.9764211791600592, 0.9531373698917788, 0.010979740862298496, 0.940389294403893),
]


def test_published_rates(spark):
    counts = spark.createDataFrame([r[:5] for r in PUBLISHED], "model string, tp long, fp long, tn long, fn long")
    got = {r.model: r for r in M.add_rates(counts).collect()}
    for model, *_, f1, mcc, fpr, precision in PUBLISHED:
        row = got[model]
        assert row.macro_f1 == pytest.approx(f1, abs=1e-9)
        assert row.mcc == pytest.approx(mcc, abs=1e-9)
        assert row.false_positive_rate == pytest.approx(fpr, abs=1e-9)
        assert row.precision == pytest.approx(precision, abs=1e-9)


def test_degenerate_counts(spark):
    counts = spark.createDataFrame([(0, 0, 5, 0), (3, 0, 0, 0), (0, 2, 0, 0)], "tp long, fp long, tn long, fn long")
    rows = M.add_rates(counts).collect()
    assert [r.mcc for r in rows] == [0.0, 0.0, 0.0]
    assert [r.macro_f1 for r in rows] == [1.0, 1.0, 0.0]
    assert [r.recall for r in rows] == [0.0, 1.0, 0.0]
    assert [r.accuracy for r in rows] == [1.0, 1.0, 0.0]


def predictions(spark, rows):
    df = spark.createDataFrame(rows, "y int, p double")
    return df.select(F.lit("m").alias("model"), F.lit("c").alias("category"), "y", (F.col("p") >= 0.5).cast("int").alias("yhat"), "p")


def test_auc_ties_and_single_class(spark):
    df = predictions(spark, [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)])
    assert M.roc_auc(df).first().roc_auc == pytest.approx(0.875)
    assert math.isnan(M.roc_auc(predictions(spark, [(1, 0.9), (1, 0.2)])).first().roc_auc)


def test_pr_curve(spark):
    curve = M.pr_curve(predictions(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)])).orderBy(F.asc_nulls_last("threshold"))
    got = [(r.threshold, r.precision, r.recall) for r in curve.collect()]
    assert got == [(0.1, 0.5, 1.0), (0.7, pytest.approx(2 / 3), 1.0), (0.8, 0.5, 0.5), (0.9, 1.0, 0.5), (None, 1.0, 0.0)]


def test_curves_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_SCORES", 7)
    rng = np.random.default_rng(2)
    p, y = np.round(rng.random(400), 2), rng.integers(0, 2, 400)
    df = predictions(spark, [(int(a), float(b)) for a, b in zip(y, p)])
    wins = np.sum(p[y == 1][:, None] > p[y == 0][None, :]) + 0.5 * np.sum(p[y == 1][:, None] == p[y == 0][None, :])
    counts = M.score_counts(df)
    assert counts.select("_b").distinct().count() > 8
    assert M.area_of_counts(counts).first().roc_auc == pytest.approx(wins / (y.sum() * (400 - y.sum())))
    curve = [r for r in M.curve_of_counts(counts).collect() if r.threshold is not None]
    assert len(curve) == len(set(p))
    for r in curve:
        assert r.recall == pytest.approx(y[p >= r.threshold].sum() / y.sum())
        assert r.precision == pytest.approx(y[p >= r.threshold].mean())
    table = M.evaluate_models(df).first()
    assert table.tp + table.fp + table.tn + table.fn == 400
    assert table.ece == pytest.approx(M.expected_calibration_error(df).first().ece)


def test_bins_use_exact_edges(spark):
    edges = unit_interval_edges(10)
    assert edges[3] == 0.30000000000000004
    df = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.3, 0.30000000000000004, 0.7, 1.0)], "p double")
    assert [r[0] for r in df.select(bin_by_edges(F.col("p"), edges)).collect()] == [0, 1, 2, 3, 6, 9]


def test_reliability_keeps_empty_bins(spark):
    table = M.reliability_curve(predictions(spark, [(1, 0.95), (0, 0.05)])).orderBy("bin").collect()
    assert [r.n for r in table] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    assert table[5].mean_p is None and table[9].observed == 1.0
    assert M.expected_calibration_error(predictions(spark, [(1, 0.95), (0, 0.05)])).first().ece == pytest.approx(0.05)


def test_loaco_metrics_without_rows_of_a_kind(spark):
    df = spark.createDataFrame([("Bot", "BENIGN", 0, 0), ("Bot", "DoS", 1, 1)], "held_out_category string, category string, y int, yhat int")
    row = M.loaco_metrics(df).first()
    assert row.novel_recall is None and row.known_attack_recall == 1.0 and row.true_negative_rate == 1.0


def test_published_loaco_means(spark):
    # Published recalls per held-out category.
    rows = [(0.17238709677419356, 0.9913289683241904), (0.4358523725834798, 0.9754830917874396), (0.16666666666666666, 0.9798844104180741),
            (0.0, 0.9812811660912927), (0.011627906976744186, 0.9851295531355614)]
    row = M.loaco_summary(spark.createDataFrame(rows, "novel_recall double, known_attack_recall double")).first()
    assert (round(row.mean_novel_recall, 4), round(row.mean_known_recall, 4), round(row.gap, 4)) == (0.1573, 0.9826, 0.8253)
