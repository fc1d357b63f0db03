"""Evaluation of binary predictions: a label (0/1), a score and a 0/1 prediction.

All functions take ``groups`` (for example model and split) and work on all groups
at once; ranking metrics use one row per distinct score, never a global sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchlens.functions.columns import UNIT, equal_width_bin
from vouchlens.plans.ordered import running_totals

LABEL, SCORE, PREDICTION = "label", "score", "prediction"
THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7]
HISTOGRAM_BINS = 30


def with_prediction(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.withColumn(PREDICTION, (F.col(SCORE) >= threshold).cast("int"))


def _ratio(a: Column, b: Column) -> Column:
    """Zero when undefined."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    def cell(label: int, predicted: int) -> Column:
        return F.count_if((F.col(LABEL) == label) & (F.col(PREDICTION) == predicted))

    return df.groupBy(*groups).agg(
        cell(0, 0).alias("tn"),
        cell(0, 1).alias("fp"),
        cell(1, 0).alias("fn"),
        cell(1, 1).alias("tp"),
        F.count(F.lit(1)).alias("total"),
    )


def _rates() -> dict[str, Column]:
    tn, fp, fn, tp, n = (F.col(c) for c in ("tn", "fp", "fn", "tp", "total"))
    agreed = _ratio(tp + tn, n)
    by_chance = _ratio((tp + fp) * 1.0 * (tp + fn) + (fn + tn) * 1.0 * (fp + tn), n * 1.0 * n)
    return {
        "accuracy": agreed,
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "cohen_kappa": F.try_divide(agreed - by_chance, 1 - by_chance),
    }


def binary_metrics(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    rates = [c.alias(n) for n, c in _rates().items()]
    return confusion(df, groups).select(*groups, *rates)


# --- ranking ----------------------------------------------------------------


def _ranked(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per distinct score: positives and negatives here, above, and in all."""
    cells = (
        df.where(F.col(SCORE).isNotNull())
        .groupBy(*groups, F.col(SCORE).cast("double").alias("threshold"))
        .agg(
            F.count_if(F.col(LABEL) == 1).alias("pos"), F.count_if(F.col(LABEL) == 0).alias("neg")
        )
    )
    return running_totals(cells, ["threshold"], ["pos", "neg"], groups, descending=True)


def ranking_metrics(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """ROC AUC with ties shared, and average precision."""
    p, n = F.col("pos"), F.col("neg")
    hits = F.col("pos_before") + p
    area = n * (F.col("pos_before") + hits) / 2.0
    step = F.try_divide(p * 1.0 * hits, hits + F.col("neg_before") + n)
    positives, negatives = F.max("pos_total"), F.max("neg_total")
    return _ranked(df, groups).groupBy(*groups).agg(
        F.try_divide(F.sum(area), positives * 1.0 * negatives).alias("roc_auc"),
        F.try_divide(F.sum(step), positives).alias("average_precision"),
    )


def all_metrics(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    return binary_metrics(df, groups).join(ranking_metrics(df, groups), list(groups))


def roc_points(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score; the origin is implied."""
    run = _ranked(df, groups)
    return run.select(
        *groups,
        "threshold",
        _ratio(F.col("neg_before") + F.col("neg"), F.col("neg_total")).alias("fpr"),
        _ratio(F.col("pos_before") + F.col("pos"), F.col("pos_total")).alias("tpr"),
    )


def precision_recall_points(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score; the end point (recall 0, precision 1) is implied."""
    run = _ranked(df, groups)
    hits = F.col("pos_before") + F.col("pos")
    return run.select(
        *groups,
        "threshold",
        _ratio(hits, hits + F.col("neg_before") + F.col("neg")).alias("precision"),
        _ratio(hits, F.col("pos_total")).alias("recall"),
    )


# --- reports ----------------------------------------------------------------


def class_report(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Rows for both classes and their macro and weighted averages, with accuracy."""
    c = confusion(df, groups)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))

    def row(name: str, hit: Column, claimed: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            _ratio(hit, claimed).alias("precision"),
            _ratio(hit, support).alias("recall"),
            _ratio(2 * hit, claimed + support).alias("f1"),
            support.alias("support"),
        )

    both = c.withColumns(
        {
            "_0": row("0", tn, tn + fn, tn + fp),
            "_1": row("1", tp, tp + fp, tp + fn),
            "accuracy": _ratio(tp + tn, F.col("total")),
        }
    )

    def average(name: str, w0: Column, w1: Column) -> Column:
        def mixed(field: str) -> Column:
            a, b = F.col(f"_0.{field}"), F.col(f"_1.{field}")
            return _ratio(a * w0 + b * w1, w0 + w1).alias(field)

        return F.struct(
            F.lit(name).alias("class"),
            mixed("precision"),
            mixed("recall"),
            mixed("f1"),
            F.col("total").alias("support"),
        )

    one = F.lit(1)
    rows = F.array(
        F.col("_0"),
        F.col("_1"),
        average("macro avg", one, one),
        average("weighted avg", F.col("_0.support"), F.col("_1.support")),
    )
    return both.select(*groups, "accuracy", F.explode(rows).alias("r")).select(
        *groups, "accuracy", "r.*"
    )


def error_analysis(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Errors and the mean and population deviation of their score (0 without errors)."""
    fp = (F.col(LABEL) == 0) & (F.col(PREDICTION) == 1)
    fn = (F.col(LABEL) == 1) & (F.col(PREDICTION) == 0)
    wrong = F.count_if(F.col(LABEL) != F.col(PREDICTION))

    def spread(kind: Column, name: str) -> list[Column]:
        score = F.when(kind, F.col(SCORE))
        mean = F.try_divide(F.sum(score.cast(UNIT)).cast("double"), F.count(score))
        return [
            F.count_if(kind).alias(f"{name}_count"),
            F.coalesce(mean, F.lit(0.0)).alias(f"{name}_avg_probability"),
            F.coalesce(F.stddev_pop(score), F.lit(0.0)).alias(f"{name}_std_probability"),
        ]

    return df.groupBy(*groups).agg(
        wrong.alias("total_errors"),
        _ratio(wrong, F.count(F.lit(1))).alias("error_rate"),
        *spread(fp, "fp"),
        *spread(fn, "fn"),
    )


def best_model(metrics: DataFrame, metric: str = "f1", order: str = "model") -> DataFrame:
    """The row with the highest value; the first by ``order`` wins a tie."""
    return metrics.orderBy(F.desc_nulls_last(metric), order).limit(1)


def model_comparison(df: DataFrame, group: str) -> DataFrame:
    """Accuracy and the figures of class 1, one row per model."""
    report = class_report(df, [group])
    return report.where(F.col("class") == "1").select(group, "accuracy", "precision", "recall", "f1")


def score_histogram(df: DataFrame, groups: Sequence[str] = (), bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Scores of each true class in equal bins over that class's own range, per group.

    The ranges are broadcast: a row for each group and class, groups being models or splits.
    """
    keys = [*groups, LABEL]
    kept = df.where(F.col(LABEL).isin(0, 1) & F.col(SCORE).isNotNull())
    edges = kept.groupBy(*keys).agg(F.min(SCORE).alias("_lo"), F.max(SCORE).alias("_hi"))
    return (
        kept.join(F.broadcast(edges), keys)
        .withColumn("bin", equal_width_bin(F.col(SCORE), F.col("_lo"), F.col("_hi"), bins))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("cases"))
    )


def threshold_sweep(
    df: DataFrame, groups: Sequence[str] = (), thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """Precision, recall and F1 at several thresholds, from one aggregation."""
    counts = []
    for i, t in enumerate(thresholds):
        over = F.col(SCORE) >= t
        counts += [
            F.count_if(over & (F.col(LABEL) == 1)).alias(f"tp{i}"),
            F.count_if(over).alias(f"claimed{i}"),
        ]
    figures = df.groupBy(*groups).agg(F.count_if(F.col(LABEL) == 1).alias("actual"), *counts)
    rows = [
        F.struct(
            F.lit(t).alias("threshold"),
            _ratio(F.col(f"tp{i}"), F.col(f"claimed{i}")).alias("precision"),
            _ratio(F.col(f"tp{i}"), F.col("actual")).alias("recall"),
            _ratio(2 * F.col(f"tp{i}"), F.col(f"claimed{i}") + F.col("actual")).alias("f1"),
        )
        for i, t in enumerate(thresholds)
    ]
    return figures.select(*groups, F.explode(F.array(*rows)).alias("r")).select(*groups, "r.*")
