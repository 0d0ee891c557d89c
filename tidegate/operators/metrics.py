"""Evaluation of predictions held in long form: columns model, category, y, yhat, p."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidegate.functions import rates as R
from tidegate.functions.numbers import bin_by_edges, ratio, unit_interval_edges
from tidegate.schemas import BENIGN
from tidegate.session import scratch_path

RANGE_SCORES = 1_000_000
# Columns of the published metrics table (fixed order).
METRIC_COLUMNS = ["macro_f1", "mcc", "accuracy", "precision", "recall", "false_positive_rate",
                  "false_negative_rate", "roc_auc", "ece", "tp", "fp", "tn", "fn"]
RATES = {
    "macro_f1": R.macro_f1, "mcc": R.mcc, "accuracy": R.accuracy, "precision": R.precision, "recall": R.recall,
    "false_positive_rate": R.false_positive_rate, "false_negative_rate": R.false_negative_rate,
}


def count_columns() -> list:
    y, yhat = F.col("y"), F.col("yhat")
    return [
        F.count_if((y == 1) & (yhat == 1)).alias("tp"), F.count_if((y == 0) & (yhat == 1)).alias("fp"),
        F.count_if((y == 0) & (yhat == 0)).alias("tn"), F.count_if((y == 1) & (yhat == 0)).alias("fn"),
    ]


def confusion_counts(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return predictions.groupBy(*by).agg(*count_columns())


def add_rates(counts: DataFrame, names: Sequence[str] = tuple(RATES)) -> DataFrame:
    """Rates of a frame that has tp, fp, tn and fn."""
    return counts.withColumns({name: RATES[name]() for name in names})


def binary_metrics(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Counts, rates and ROC-AUC per group."""
    by = list(by)
    rates = add_rates(confusion_counts(predictions, by))
    auc = roc_auc(predictions, by)
    return rates.join(auc, by, "left") if by else rates.withColumn("roc_auc", auc.select("roc_auc").scalar())


def scored(predictions: DataFrame) -> DataFrame:
    """A probability that is missing or not a number counts as 0, as for a flow whose scoring failed."""
    return predictions.withColumn("p", F.coalesce(F.nanvl(F.col("p").cast("double"), F.lit(0.0)), F.lit(0.0)))


def score_counts(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Classes, and with yhat outcomes, per distinct score, in score order; `_b` names the range a score lies in.

    A range is one written file of at most RANGE_SCORES scores, so ranges grow in number and not in size.
    Running sums are taken per range and joined by the totals of the ranges before it.
    """
    by = list(by)
    outcomes = count_columns() if "yhat" in predictions.columns else []
    counts = scored(predictions).groupBy(*by, "p").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"), *outcomes)
    path = scratch_path(predictions.sparkSession, "scores")
    ordered = counts.repartitionByRange(*by, "p").sortWithinPartitions(*by, "p")
    ordered.write.option("maxRecordsPerFile", RANGE_SCORES).parquet(path)
    # Names of files follow the order in which a job's tasks number their ranges.
    return predictions.sparkSession.read.parquet(path).withColumn("_b", F.col("_metadata.file_name"))


def roc_auc(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Area under the ROC curve with ties counted half; NaN when only one class occurs."""
    return area_of_counts(score_counts(predictions, by), by)


def area_of_counts(counts: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """`roc_auc` of a table of `score_counts`."""
    by = list(by)
    local = Window.partitionBy(*by, "_b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(local), F.lit(0))
    inside = counts.withColumn("_u", F.col("pos") * (below + F.col("neg") / 2))
    ranges = inside.groupBy(*by, "_b").agg(
        F.sum("_u").alias("_u"), F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    across = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shifted = ranges.withColumn("_u", F.col("_u") + F.col("_pos") * F.coalesce(F.sum("_neg").over(across), F.lit(0)))
    total = shifted.groupBy(*by).agg(F.sum("_u").alias("_u"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    area = F.coalesce(F.try_divide(F.col("_u"), F.col("_p").cast("double") * F.col("_n")), F.lit(float("nan")))
    return total.select(*by, area.alias("roc_auc"))


def pr_curve(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Precision and recall at every distinct score, and the end point (1, 0) without a threshold."""
    return curve_of_counts(score_counts(predictions, by), by)


def curve_of_counts(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """`pr_curve` of a table of `score_counts`."""
    by = list(by)
    buckets = scores.groupBy(*by, "_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    higher = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = buckets.select(
        *by, "_b", F.coalesce(F.sum("_bp").over(higher), F.lit(0)).alias("_op"),
        F.coalesce(F.sum("_bn").over(higher), F.lit(0)).alias("_on"), F.sum("_bp").over(whole).alias("_all"),
    )
    local = Window.partitionBy(*by, "_b").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = scores.select(*by, "_b", "p", F.sum("pos").over(local).alias("_cp"), F.sum("neg").over(local).alias("_cn"))
    tp, fp = F.col("_cp") + F.col("_op"), F.col("_cn") + F.col("_on")
    curve = running.join(offsets, [*by, "_b"]).select(
        *by, F.col("p").alias("threshold"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, F.col("_all"), empty=1.0).alias("recall"),
    )
    groups = offsets.select(*by).distinct() if by else offsets.limit(1)
    end = groups.select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return curve.unionByName(end)


def _bins(predictions: DataFrame, by: list[str], n_bins: int) -> DataFrame:
    bin_no = bin_by_edges(F.col("p"), unit_interval_edges(n_bins))
    return scored(predictions).groupBy(*by, bin_no.alias("bin")).agg(
        F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("observed"), F.count(F.lit(1)).alias("n"))


def reliability_curve(predictions: DataFrame, by: Sequence[str] = ("model",), n_bins: int = 10) -> DataFrame:
    """Mean probability, observed rate and count of every bin; empty bins have count 0 and nulls."""
    by = list(by)
    filled = _bins(predictions, by, n_bins)
    entry = F.struct("mean_p", "observed", "n")
    packed = filled.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", entry))).alias("m"))
    listed = packed.select(*by, "m", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    cell = F.try_element_at("m", F.col("bin"))
    return listed.select(*by, "bin", cell["mean_p"].alias("mean_p"), cell["observed"].alias("observed"),
                         F.coalesce(cell["n"], F.lit(0)).alias("n"))


def expected_calibration_error(predictions: DataFrame, by: Sequence[str] = ("model",), n_bins: int = 10) -> DataFrame:
    by = list(by)
    gap = F.col("n") * F.abs(F.col("mean_p") - F.col("observed"))
    return _bins(predictions, by, n_bins).groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def per_category_recall(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Share of rows flagged per category; for benign rows the share not flagged."""
    right = F.when(F.col("category") == BENIGN, F.col("yhat") == 0).otherwise(F.col("yhat") == 1)
    return predictions.groupBy(*by, "category").agg(F.avg(right.cast("double")).alias("recall"))


def recall_pivot(recalls: DataFrame, models: Sequence[str]) -> DataFrame:
    return recalls.groupBy("category").pivot("model", list(models)).agg(F.first("recall"))


def evaluate_models(predictions: DataFrame, n_bins: int = 10) -> DataFrame:
    """All metrics, one row per model, in the published column order; predictions are read once."""
    return evaluate_counts(score_counts(predictions), n_bins)


def evaluate_counts(counts: DataFrame, n_bins: int = 10) -> DataFrame:
    """`evaluate_models` of a table of `score_counts`."""
    rates = add_rates(counts.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")]))
    bin_no, rows = bin_by_edges(F.col("p"), unit_interval_edges(n_bins)), F.col("pos") + F.col("neg")
    bins = counts.groupBy("model", bin_no.alias("bin")).agg(
        F.sum(rows).alias("n"), F.abs(F.sum(F.col("p") * rows) - F.sum("pos")).alias("gap"))
    ece = bins.groupBy("model").agg(F.try_divide(F.sum("gap"), F.sum("n")).alias("ece"))
    table = rates.join(area_of_counts(counts), "model").join(ece, "model")
    return table.select("model", *METRIC_COLUMNS)


def loaco_metrics(predictions: DataFrame, by: str = "held_out_category") -> DataFrame:
    """Recall on the held-out category, on the other attacks, true-negative rate and overall rates.

    Expects category, y, yhat and the held-out category per row; empty groups give null.
    """
    flagged = (F.col("yhat") == 1).cast("double")
    novel = F.col("category") == F.col(by)
    benign = F.col("category") == BENIGN
    counts = predictions.groupBy(by).agg(
        F.avg(F.when(novel, flagged)).alias("novel_recall"),
        F.avg(F.when(~novel & ~benign, flagged)).alias("known_attack_recall"),
        F.avg(F.when(benign, 1 - flagged)).alias("true_negative_rate"),
        *count_columns(),
    )
    rates = add_rates(counts, ["macro_f1", "mcc", "false_positive_rate"])
    return rates.select(
        F.col(by).alias("held_out_category"), "novel_recall", "known_attack_recall", "true_negative_rate",
        F.col("macro_f1").alias("overall_macro_f1"), F.col("mcc").alias("overall_mcc"),
        F.col("false_positive_rate").alias("overall_fpr"),
    )


def loaco_categories(train: DataFrame, configured: Sequence[str], column: str = "category") -> DataFrame:
    """The configured categories with a flag telling whether the training rows hold them."""
    spark = train.sparkSession
    wanted = spark.createDataFrame([(i, c) for i, c in enumerate(configured)], "position int, category string")
    found = train.filter(F.col(column).isin(list(configured))).select(F.col(column).alias("category")).distinct()
    joined = wanted.join(found.withColumn("_here", F.lit(True)), "category", "left")
    return joined.select("category", F.coalesce("_here", F.lit(False)).alias("present"), "position")


def loaco_summary(results: DataFrame) -> DataFrame:
    novel, known = F.avg("novel_recall"), F.avg("known_attack_recall")
    return results.agg(novel.alias("mean_novel_recall"), known.alias("mean_known_recall"), (known - novel).alias("gap"))


def rounded(table: DataFrame, places: int = 4) -> DataFrame:
    """The report form of a result table: doubles rounded."""
    return table.select([
        (F.round(quoted_name, places) if kind == "double" else F.col(quoted_name)).alias(name)
        for name, kind in table.dtypes for quoted_name in [f"`{name}`"]
    ])
