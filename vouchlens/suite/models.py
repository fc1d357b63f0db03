"""Queries on model evaluation (M8-M19, E3) and on trained models (rows only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchlens.operators import features, metrics, training
from vouchlens.session import written_once, scratch_path
from vouchlens.sources.role_views import history, predictions
from vouchlens.suite.history import CATEGORIES, KEY, METHODS, H, _cal, _dated, _hot, _ord, settings
from vouchlens.suite.sql import HISTORY

G = ["model", "split"]


def _pred(s, d):
    return metrics.with_prediction(predictions(s, d))


def _r(df):
    return df.withColumns({c: F.round(c, 8) for c, t in df.dtypes if t == "double"})


def prepared(s, d, fold=False):
    """Features, target and split (or folds) of the whole history, which is joined once."""
    h = written_once(history(s, d))
    fitted = features.fit_features(h, settings())
    rows = fitted.transform(h)
    if fold:
        rows = features.time_folds(rows, "date", KEY, folds=5)
    else:
        rows = features.temporal_split(rows, "date", KEY)
    # an MLlib input may not hold dots or blanks in its column names
    names = fitted.names(rows)
    safe = {c: f"f{i}" for i, c in enumerate(names)}
    rows = written_once(rows.withColumnsRenamed(safe))
    return rows, list(safe.values()), names


def _settings(columns, models=None):
    return training.TrainingSettings(features=columns, models=models or training.DEFAULTS)


def _evaluated(models, rows):
    """Scores are compared to ten digits, so that equal ones stay equal whatever the order of sums."""
    scored = training.predict_all(models, rows, "risk_target").withColumn("score", F.round("score", 10))
    return _r(metrics.all_metrics(written_once(scored), G))


def _trained(name):
    def query(s, d):
        rows, columns, _ = prepared(s, d)
        model = training.train(rows.where("split = 'train'"), name, training.DEFAULTS[name], _settings(columns))
        return _evaluated({name: model}, rows)

    return query


def _train_all(s, d):
    """A model that fails has a row with its message beside the others' results; if all fail, that is an error."""
    rows, columns, _ = prepared(s, d)
    models, failures = training.train_each(rows.where("split = 'train'"), _settings(columns))
    if not models:
        raise training.TrainingFailed(failures)
    messages = [(name, training.described(error)) for name, error in failures.items()]
    failed = s.createDataFrame(messages, "model string, message string")
    scored = training.evaluate(models, rows, "risk_target")
    return scored.join(failed, "model", "full")


def _search(s, d):
    """The scores of the whole logistic grid; the best point's model, fitted again on all rows, has its F1 beside it."""
    rows, columns, _ = prepared(s, d, fold=True)
    results, _, model = training.search_and_refit(rows, training.LOGISTIC, _settings(columns))
    again = metrics.binary_metrics(training.predict(model, rows, "risk_target")).select("f1").scalar()
    best = results.agg(F.min_by("point", F.struct(-F.col("mean_f1"), "point"))).scalar()
    return results.withColumn("refitted_f1", F.when(F.col("point") == best, again))


def _importance(name):
    def query(s, d):
        rows, columns, names = prepared(s, d)
        model = training.train(rows.where("split = 'train'"), name, training.DEFAULTS[name], _settings(columns))
        return training.feature_importance(model, names).select("feature", F.round("importance", 8).alias("importance"))

    return query


def _end_to_end(s, d):
    """All models or an error: the result has no place for one that failed."""
    rows, columns, _ = prepared(s, d)
    models = training.train_all(rows.where("split = 'train'"), _settings(columns))
    return training.evaluate(models, rows, "risk_target")


def _saved(s, d):
    rows, columns, _ = prepared(s, d)
    name = training.LOGISTIC
    model = training.train(rows.where("split = 'train'"), name, training.DEFAULTS[name], _settings(columns))
    folder = scratch_path(s, "models")
    training.save_models({name: model}, folder)
    again = training.load_model(folder, name)
    return _evaluated({name: again}, rows)


QUERIES = {
    "M1_logistic_regression": _trained(training.LOGISTIC),
    "M2_random_forest": _trained(training.FOREST),
    "M3_gradient_boosting": _trained(training.BOOSTING),
    "M5_train_all_models": _train_all,
    "M6_grid_search": _search,
    "M8_binary_metrics": lambda s, d: _r(metrics.binary_metrics(_pred(s, d), G)),
    "M9_roc_auc": lambda s, d: _r(metrics.ranking_metrics(_pred(s, d), G).drop("average_precision")),
    "M9_roc_auc_ungrouped": lambda s, d: _r(metrics.ranking_metrics(_pred(s, d)).select("roc_auc")),
    "M10_average_precision": lambda s, d: _r(
        metrics.ranking_metrics(_pred(s, d), G).drop("roc_auc")
    ),
    "M11_both_splits": lambda s, d: _r(metrics.all_metrics(_pred(s, d), G)),
    "M12_confusion_matrix": lambda s, d: metrics.confusion(_pred(s, d), G),
    "M13_class_report": lambda s, d: _r(metrics.class_report(_pred(s, d), G)),
    "M14_roc_points": lambda s, d: _r(metrics.roc_points(_pred(s, d), G)),
    "M14_precision_recall_points": lambda s, d: _r(
        metrics.precision_recall_points(_pred(s, d), G)
    ),
    "M15_feature_importance": _importance(training.FOREST),
    "M15_coefficient_sizes": _importance(training.LOGISTIC),
    "M16_error_analysis": lambda s, d: _r(metrics.error_analysis(_pred(s, d), G)),
    "M17_best_model": lambda s, d: _r(
        metrics.best_model(metrics.binary_metrics(_pred(s, d).where("split = 'test'"), ["model"]))
    ).select("model", "f1"),
    "M18_model_comparison": lambda s, d: _r(
        metrics.model_comparison(_pred(s, d).where("split = 'test'"), "model")
    ),
    "M19_score_histogram": lambda s, d: metrics.score_histogram(_pred(s, d), ["model"]),
    "M20_train_and_evaluate": _end_to_end,
    "E3_threshold_sweep": lambda s, d: _r(metrics.threshold_sweep(_pred(s, d), G)),
    "IO13_saved_model": _saved,
}

MEASURES = """conf AS (SELECT model, split, count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) AS total FROM pred GROUP BY ALL),
rates AS (SELECT *, (tp + tn) / total AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1,
    ((tp + fp) * 1.0 * (tp + fn) + (fn + tn) * 1.0 * (fp + tn)) / (total * 1.0 * total) AS pe FROM conf),
kappa AS (SELECT *, (accuracy - pe) / (1 - pe) AS cohen_kappa FROM rates),
cells AS (SELECT model, split, score AS threshold, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM pred GROUP BY ALL),
run AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY model, split) AS tpos, sum(neg) OVER (PARTITION BY model, split) AS tneg
  FROM cells WINDOW w AS (PARTITION BY model, split ORDER BY threshold DESC)),
ranks AS (SELECT model, split, sum(neg * (cp - pos + cp) / 2.0) / max(CAST(tpos AS DOUBLE) * tneg) AS roc_auc,
    sum(CAST(pos AS DOUBLE) * cp / (cp + cn)) / max(tpos) AS average_precision FROM run GROUP BY model, split),
rep AS (SELECT model, split, accuracy, '0' AS class, tn / (tn + fn) AS precision, tn / (tn + fp) AS recall, 2 * tn / (2 * tn + fn + fp) AS f1, tn + fp AS support FROM rates
  UNION ALL SELECT model, split, accuracy, '1', precision, recall, f1, tp + fn FROM rates)
"""
CHAIN = f"""WITH {HISTORY},
base AS (SELECT id, part, CAST(score < 0.5 AS INTEGER) AS label, CASE WHEN part % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM history),
pred0 AS (SELECT *, 'a' AS model, round((id * 7919 + part * 104729) % 1000 / 1250 + label * CAST(0.2 AS DOUBLE), 4) AS score FROM base
  UNION ALL SELECT *, 'b', round((id * 15485863 + part * 611953) % 1000 / 1250 + label * CAST(0.08 AS DOUBLE), 4) FROM base
  UNION ALL SELECT *, 'c', round((id * 31337 + part * 271) % 1000 / 1250, 4) FROM base),
pred AS (SELECT *, CAST(score >= 0.5 AS INTEGER) AS prediction FROM pred0),
""" + MEASURES

# The logistic model once more in SQL: a majorizer of the curvature (a quarter of the weighted products) is inverted by
# elimination, then steps with it lead to the one optimum.
FIXED = "year month quarter day_of_week day_of_month week_of_year is_month_start is_month_end is_quarter_start is_quarter_end".split()
NAMES = [
    *FIXED,
    *(f"category_{c}" for c in CATEGORIES),
    *(f"method_{m}" for m in METHODS),
    "indicator_encoded",
    "season_encoded",
    "amount_scaled",
    "time_scaled",
]
_P = len(NAMES) + 1
_scaled = ", ".join(
    f"({c} - (SELECT avg({c}) FROM history)) / (SELECT stddev_pop({c}) FROM history) AS {c}_scaled" for c in ("amount", "time")
)
LOGISTIC_SQL = H.replace("WITH", "WITH RECURSIVE", 1) + f""",
feat AS (SELECT id, part, risk_target AS y, {_cal}, {_hot}, {_ord}, {_scaled},
    CASE WHEN {_dated} <= floor(n * (1 - CAST(0.2 AS DOUBLE))) THEN 'train' ELSE 'test' END AS split FROM t, n),
vec AS (SELECT y, split, CAST([year - 1995, {", ".join(f'"{c}"' for c in NAMES[1:])}, 1] AS DOUBLE[]) AS v FROM feat),
tr AS MATERIALIZED (SELECT y, v, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY y)) AS w FROM vec WHERE split = 'train'),
bound AS (SELECT i, j, sum(w * v[i] * v[j]) / 4 + CASE WHEN i = j AND i < {_P} THEN 1 ELSE 0 END AS s
  FROM tr, range(1, {_P + 1}) a(i), range(1, {_P + 1}) b(j) GROUP BY i, j),
wide AS (SELECT i, list_concat(list(s ORDER BY j), list_transform(range(1, {_P + 1}), lambda j: CASE WHEN j = i THEN 1.0 ELSE 0.0 END)) AS r
  FROM bound GROUP BY i),
solve(k, m) AS (SELECT 1, list(r ORDER BY i) FROM wide
  UNION ALL SELECT k + 1, list_transform(range(1, {_P + 1}), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda x: x / m[k][k])
    ELSE list_transform(range(1, {2 * _P + 1}), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) END) FROM solve WHERE k <= {_P}),
inv AS MATERIALIZED (SELECT list_transform(m, lambda r: r[{_P + 1}:]) AS inv FROM solve WHERE k = {_P + 1}),
steps(step, b) AS (SELECT 0, list_transform(range(0, {_P}), lambda i: CAST(0 AS DOUBLE))
  UNION ALL SELECT step + 1, list_transform(range(1, {_P + 1}), lambda i: b[i] - list_dot_product(inv[i], g)) FROM (
    SELECT step, b, list(gi ORDER BY i) AS g FROM (
      SELECT step, b, i, sum(w * (p - y) * v[i]) + CASE WHEN i < {_P} THEN b[i] ELSE 0 END AS gi FROM (
        SELECT step, b, w, y, v, 1 / (1 + exp(-list_dot_product(b, v))) AS p FROM steps, tr WHERE step < 60), range(1, {_P + 1}) r(i)
      GROUP BY step, b, i) GROUP BY step, b), inv),
best AS MATERIALIZED (SELECT b FROM steps WHERE step = 60),
pred AS (SELECT 'logistic_regression' AS model, split, y AS label, score, CAST(score > 0.5 AS INTEGER) AS prediction
  FROM (SELECT split, y, round(1 / (1 + exp(-list_dot_product(b, v))), 10) AS score FROM vec, best)),
"""


def _8(*names):
    return ", ".join(f"round({n}, 8) AS {n}" for n in names)


_bin = ("accuracy", "precision", "recall", "f1", "cohen_kappa")
_logistic = LOGISTIC_SQL + MEASURES + f"""SELECT model, split, {_8(*_bin, 'roc_auc', 'average_precision')}
  FROM kappa JOIN ranks USING (model, split)"""
_names = ", ".join(f"'{n}'" for n in NAMES)
SQL = {
    "M1_logistic_regression": _logistic,
    "IO13_saved_model": _logistic,
    "M15_coefficient_sizes": LOGISTIC_SQL.rstrip().rstrip(",")
    + f" SELECT unnest([{_names}]) AS feature, unnest(list_transform(b[:{_P - 1}], lambda x: round(abs(x), 8))) AS importance FROM best",
    "M8_binary_metrics": CHAIN + f"SELECT model, split, {_8(*_bin)} FROM kappa",
    "M9_roc_auc": CHAIN + f"SELECT model, split, {_8('roc_auc')} FROM ranks",
    "M9_roc_auc_ungrouped": CHAIN
    + """, c2 AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM pred GROUP BY score),
      r2 AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp FROM c2)
      SELECT round(sum(neg * (cp - pos + cp) / 2.0) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 8) AS roc_auc FROM r2""",
    "M10_average_precision": CHAIN + f"SELECT model, split, {_8('average_precision')} FROM ranks",
    "M11_both_splits": CHAIN
    + f"SELECT model, split, {_8(*_bin, 'roc_auc', 'average_precision')} FROM kappa JOIN ranks USING (model, split)",
    "M12_confusion_matrix": CHAIN + "SELECT * FROM conf",
    "M13_class_report": CHAIN
    + f"""SELECT model, split, class, {_8('accuracy', 'precision', 'recall', 'f1')}, support FROM (
        SELECT * FROM rep UNION ALL
        SELECT model, split, max(accuracy), 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM rep GROUP BY model, split
        UNION ALL SELECT model, split, max(accuracy), 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
          sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM rep GROUP BY model, split) GROUP BY ALL""",
    "M14_roc_points": CHAIN
    + f"SELECT model, split, {_8('threshold')}, round(cn / tneg, 8) AS fpr, round(cp / tpos, 8) AS tpr FROM run",
    "M14_precision_recall_points": CHAIN
    + f"SELECT model, split, {_8('threshold')}, round(cp / (cp + cn), 8) AS precision, round(cp / tpos, 8) AS recall FROM run",
    "M16_error_analysis": CHAIN
    + """SELECT model, split, count(*) FILTER (label <> prediction) AS total_errors, round(count(*) FILTER (label <> prediction) / count(*), 8) AS error_rate,
        count(*) FILTER (label = 0 AND prediction = 1) AS fp_count,
        round(coalesce(avg(score) FILTER (label = 0 AND prediction = 1), 0), 8) AS fp_avg_probability,
        round(coalesce(stddev_pop(score) FILTER (label = 0 AND prediction = 1), 0), 8) AS fp_std_probability,
        count(*) FILTER (label = 1 AND prediction = 0) AS fn_count,
        round(coalesce(avg(score) FILTER (label = 1 AND prediction = 0), 0), 8) AS fn_avg_probability,
        round(coalesce(stddev_pop(score) FILTER (label = 1 AND prediction = 0), 0), 8) AS fn_std_probability FROM pred GROUP BY model, split""",
    "M17_best_model": CHAIN
    + "SELECT model, round(f1, 8) AS f1 FROM rates WHERE split = 'test' ORDER BY rates.f1 DESC, model LIMIT 1",
    "M18_model_comparison": CHAIN
    + f"SELECT model, {_8('accuracy', 'precision', 'recall', 'f1')} FROM rates WHERE split = 'test'",
    "M19_score_histogram": CHAIN
    + """SELECT p.model, p.label, CAST(least(floor((score - lo) * 30.0 / (hi - lo)), 29) AS BIGINT) AS bin, count(*) AS cases
      FROM pred p JOIN (SELECT model, label, min(score) AS lo, max(score) AS hi FROM pred GROUP BY ALL) e
        ON p.label = e.label AND p.model = e.model GROUP BY ALL""",
    "E3_threshold_sweep": CHAIN
    + """SELECT model, split, t AS threshold, round(tp / claimed, 8) AS precision, round(tp / actual, 8) AS recall,
        round(2 * tp / (claimed + actual), 8) AS f1 FROM (
        SELECT model, split, t, count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t) AS claimed,
          count(*) FILTER (label = 1) AS actual FROM pred, (VALUES (CAST(0.3 AS DOUBLE)), (0.4), (0.5), (0.6), (0.7)) v(t) GROUP BY ALL)""",
}
