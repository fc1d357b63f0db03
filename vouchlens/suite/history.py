"""Queries on payment history: cleaning (L), features (F), folds (M4, M7), periods (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchlens.operators import cleaning, features, periods
from vouchlens.roles import HistoryRoles
from vouchlens.session import written_once
from vouchlens.sources.role_views import history, raw_history
from vouchlens.suite.sql import HISTORY, RAW_HISTORY, exact_sum, unit_mean

R = HistoryRoles(
    date="date", supplier="supplier", category="category", method="method", amount="amount",
    time="time", score="score", indicator="indicator", season="season", status="status",
)
KEY = ["id", "part"]
ALLOWED = {
    "category": ["ECONOMY", "MEDIUM", "SMALL", "LARGE", "STANDARD"],
    "method": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"],
    "indicator": ["A", "N", "R"],
    "season": ["Alta", "Baja"],
}
ORDERS = {"indicator": ["A", "N"], "season": ["Baja", "Alta"]}
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
METHODS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _typed(s, d):
    return cleaning.typed(raw_history(s, d), R)


def _table(s, d, *columns):
    """The joined history as a table, for queries that pass over it several times."""
    return written_once(history(s, d).select(*KEY, *columns) if columns else history(s, d))


def _filled(s, d):
    """Medians and modes each pass over all rows, so the typed ones are written once."""
    return cleaning.fill_missing(written_once(_typed(s, d)), R)


def _normal(s, d):
    return cleaning.normal_amounts(_filled(s, d), R)


def _normal_table(s, d, *columns):
    """The same as a table of these columns, for steps that learn from all rows."""
    return written_once(_normal(s, d).select(*KEY, *columns))


def _clean(s, d):
    return cleaning.clean(raw_history(s, d), R, ALLOWED)


def _print(df):
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def _scaled(method):
    def query(s, d):
        h = _table(s, d, "amount", "time")
        out = features.scale(h, features.fit_scaler(h, ["amount", "time"], method))
        return out.select(
            *KEY,
            F.round("amount_scaled", 6).alias("amount_scaled"),
            F.round("time_scaled", 6).alias("time_scaled"),
        )

    return query


def settings():
    return features.FeatureSettings(roles=R, orders=ORDERS)


def _transformed(s, d):
    h = _table(s, d)
    out = features.fit_features(h, settings()).transform(h)
    return _print(out).withColumns(
        {c: F.round(c, 6) for c in ("amount_scaled", "time_scaled")}
    )


def _one_hot(h):
    return features.one_hot(h, features.fit_levels(h, ["category", "method"]))


def _target(s, d):
    return features.with_target(_table(s, d, "score"), "score")


QUERIES = {
    "L1_typed": lambda s, d: _print(_typed(s, d)).select(
        *KEY, "date", "supplier", "category", "amount", "time", "score"
    ),
    "L2_filled": lambda s, d: _print(_filled(s, d)).withColumns(
        {c: F.round(c, 6) for c in ("amount", "time", "score")}
    ),
    "L3_normal_amounts": lambda s, d: _normal(s, d).select(*KEY, "amount"),
    "L4_valid_categories": lambda s, d: cleaning.valid_categories(_normal_table(s, d, *ALLOWED), ALLOWED).select(
        *KEY, "category", "method", "indicator", "season"
    ),
    "L5_outliers": lambda s, d: cleaning.with_outliers(_normal_table(s, d, "amount", "time"), ["amount", "time"]).select(
        *KEY, "is_outlier"
    ),
    "L5_outlier_details": lambda s, d: cleaning.outlier_details(
        _normal_table(s, d, "amount", "time"), ["amount", "time"]
    ),
    "L6_valid_ranges": lambda s, d: cleaning.valid_ranges(_normal(s, d), R).select(
        *KEY, F.round("score", 6).alias("score"), "time"
    ),
    "L7_quality_report": lambda s, d: cleaning.quality_report(raw_history(s, d), _clean(s, d)),
    "L8_clean_history": lambda s, d: _print(_clean(s, d)).withColumn("score", F.round("score", 6)),
    "IO7_without_outliers": lambda s, d: _print(cleaning.without_outliers(_clean(s, d))).select(
        *KEY, "date", "supplier", "amount"
    ),
    "F1_calendar": lambda s, d: features.with_calendar(history(s, d), "date").select(
        *KEY,
        "year",
        "month",
        "quarter",
        "day_of_week",
        "day_of_month",
        "week_of_year",
        "is_month_start",
        "is_month_end",
        "is_quarter_start",
        "is_quarter_end",
    ),
    "F2_target": lambda s, d: features.with_target(history(s, d), "score").select(*KEY, "risk_target"),
    "F3_one_hot": lambda s, d: _one_hot(_table(s, d, "category", "method")),
    "F4_ordinal": lambda s, d: features.ordinal(history(s, d), ORDERS).select(
        *KEY, "indicator_encoded", "season_encoded"
    ),
    "F5_standard_scale": _scaled("standard"),
    "F5_minmax_scale": _scaled("minmax"),
    "F5_robust_scale": _scaled("robust"),
    "F6_transformed_columns": _transformed,
    "F7_temporal_split": lambda s, d: features.temporal_split(_table(s, d, "date"), "date", KEY).select(
        *KEY, "split"
    ),
    "F8_stratified_split": lambda s, d: features.stratified_split(
        _target(s, d), "risk_target", KEY
    ).select(*KEY, "split"),
    "F9_features_and_split": lambda s, d: features.temporal_split(
        _transformed(s, d), "date", KEY
    ).select(*KEY, "risk_target", "amount_scaled", "indicator_encoded", "split"),
    "M4_class_weights": lambda s, d: features.class_weights(
        features.with_target(history(s, d), "score"), "risk_target"
    ),
    "M7_time_folds": lambda s, d: features.time_folds(_table(s, d, "date"), "date", KEY).select(
        *KEY, "fold"
    ),
    "M7_stratified_folds": lambda s, d: features.stratified_folds(
        _target(s, d), "risk_target", KEY
    ).select(*KEY, "fold"),
    "E1_daily": lambda s, d: _period(s, d, "D"),
    "E1_weekly": lambda s, d: _period(s, d, "W"),
    "E1_monthly": lambda s, d: _period(s, d, "M"),
    "E1_quarterly": lambda s, d: _period(s, d, "Q"),
    "E2_rolling": lambda s, d: periods.rolling(history(s, d), R).withColumn(
        "day", F.col("day").cast("string")
    ),
}


def _period(s, d, unit):
    return periods.by_period(history(s, d), R, unit).withColumn(
        "period", F.col("period").cast("string")
    )


def _mode(column, source):
    return f"(SELECT {column} FROM {source} GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"


_cat = ["category", "method", "indicator", "season"]
RAW = f"""WITH {RAW_HISTORY},
typed AS (SELECT id, part, TRY_CAST(date AS DATE) AS date, CAST(TRY_CAST(supplier AS DOUBLE) AS BIGINT) AS supplier,
    {', '.join(f"trim(coalesce({c}, 'nan')) AS {c}" for c in _cat)},
    {', '.join(f"TRY_CAST(trim({c}) AS DOUBLE) AS {c}" for c in ('amount', 'time', 'score'))} FROM raw_history),
kept AS (SELECT id, part, date, supplier, {', '.join(_cat)},
    {', '.join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM typed)) AS {c}" for c in ('amount', 'time', 'score'))}
  FROM typed WHERE date IS NOT NULL AND supplier IS NOT NULL),
filled AS (SELECT id, part, date, supplier, amount, time, score,
    {', '.join(f"CASE WHEN {c} = 'nan' THEN {_mode(c, 'kept')} ELSE {c} END AS {c}" for c in _cat)} FROM kept),
normal AS (SELECT * REPLACE (round_even(amount, 2) AS amount) FROM filled WHERE round_even(amount, 2) > 0),
checked AS (SELECT id, part, date, supplier, amount, time, score,
    {', '.join("CASE WHEN " + c + " IN (" + ', '.join(f"'{v}'" for v in ALLOWED[c]) + ") THEN " + c + " ELSE " + _mode(c, 'normal') + " END AS " + c for c in _cat)} FROM normal),
q AS (SELECT quantile_cont(amount, 0.25) AS a1, quantile_cont(amount, 0.75) AS a3, quantile_cont(time, 0.25) AS t1, quantile_cont(time, 0.75) AS t3 FROM normal),
fences AS (SELECT a1 - 1.5 * (a3 - a1) AS al, a3 + 1.5 * (a3 - a1) AS ah, t1 - 1.5 * (t3 - t1) AS tl, t3 + 1.5 * (t3 - t1) AS th FROM q),
marked AS (SELECT checked.*, (amount < al OR amount > ah OR time < tl OR time > th) AS is_outlier FROM checked, fences),
cleaned AS (SELECT * REPLACE (greatest(0.0, least(1.0, score)) AS score) FROM marked WHERE time > 0)
"""
_details = " UNION ALL ".join(
    f"""SELECT '{c}' AS columna, count(*) FILTER ({c} < {x}l OR {c} > {x}h) AS count,
    round_even(count(*) FILTER ({c} < {x}l OR {c} > {x}h) * 100.0 / count(*), 2) AS percentage,
    round_even(max({x}l), 2) AS lower_bound, round_even(max({x}h), 2) AS upper_bound FROM normal, fences"""
    for c, x in (("amount", "a"), ("time", "t"))
)


def _quality(source, columns):
    nulls = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in columns)
    return (
        f"SELECT count(*) AS total_records, CAST({len(columns)} AS INTEGER) AS total_columns, CAST(sum({nulls}) AS BIGINT) AS null_values, "
        f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS duplicated_rows FROM {source}"
    )


_rawcols = "id part date supplier category method amount time score indicator season".split()
H = f"WITH {HISTORY}, n AS (SELECT count(*) AS n FROM history), t AS (SELECT *, CAST(score < 0.5 AS INTEGER) AS risk_target FROM history) "
_dated = "row_number() OVER (ORDER BY date, md5(concat_ws('|', '', id, part)))"
_classed = "row_number() OVER (PARTITION BY risk_target ORDER BY md5(concat_ws('|', '42', id, part)))"
_hot = ", ".join(
    [f"CAST(category = '{v}' AS INTEGER) AS category_{v}" for v in CATEGORIES]
    + [f"CAST(method = '{v}' AS INTEGER) AS \"method_{v}\"" for v in METHODS]
)
_cal = """CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter,
  CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month, CAST(weekofyear(date) AS INTEGER) AS week_of_year,
  CAST(day(date) = 1 AS INTEGER) AS is_month_start, CAST(date = last_day(date) AS INTEGER) AS is_month_end,
  CAST(date = date_trunc('quarter', date) AS INTEGER) AS is_quarter_start,
  CAST(date = last_day(date_trunc('quarter', date) + INTERVAL 2 MONTH) AS INTEGER) AS is_quarter_end"""
_ord = """CASE indicator WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 1 END AS indicator_encoded,
  CASE season WHEN 'Baja' THEN 0 WHEN 'Alta' THEN 1 ELSE 1 END AS season_encoded"""


def _sc(center, scale):
    return ", ".join(
        f"round(({c} - (SELECT {center.format(c)} FROM history)) / (SELECT {scale.format(c)} FROM history), 6) AS {c}_scaled"
        for c in ("amount", "time")
    )


_std = _sc("avg({})", "stddev_pop({})")
_window = ", ".join(
    f"CAST(sum(s) OVER w{n} AS DOUBLE) AS sum_{n}d, CAST(sum(s) OVER w{n} AS DOUBLE) / sum(c) OVER w{n} AS mean_{n}d"
    for n in periods.ROLLING_DAYS
)
_frames = ", ".join(
    f"w{n} AS (PARTITION BY supplier ORDER BY day RANGE BETWEEN INTERVAL {n - 1} DAY PRECEDING AND CURRENT ROW)"
    for n in periods.ROLLING_DAYS
)
_clean_cols = "id, part, CAST(date AS VARCHAR) AS date, supplier, category, method, amount, time, {}, indicator, season"
SQL = {
    "L1_typed": RAW + "SELECT id, part, CAST(date AS VARCHAR) AS date, supplier, category, amount, time, score FROM typed",
    "L2_filled": RAW
    + """SELECT id, part, CAST(date AS VARCHAR) AS date, supplier, category, method, round(amount, 6) AS amount, round(time, 6) AS time,
        round(score, 6) AS score, indicator, season FROM filled""",
    "L3_normal_amounts": RAW + "SELECT id, part, amount FROM normal",
    "L4_valid_categories": RAW + "SELECT id, part, category, method, indicator, season FROM checked",
    "L5_outliers": RAW + "SELECT id, part, is_outlier FROM marked",
    "L5_outlier_details": RAW + _details,
    "L6_valid_ranges": RAW
    + "SELECT id, part, round(greatest(0.0, least(1.0, score)), 6) AS score, time FROM normal WHERE time > 0",
    "L7_quality_report": RAW
    + f"""SELECT 'initial' AS state, * FROM ({_quality('raw_history', _rawcols)})
      UNION ALL SELECT 'final', * FROM ({_quality('cleaned', [*_rawcols, 'is_outlier'])})
      UNION ALL SELECT 'removed', a.total_records - b.total_records, 0, a.null_values - b.null_values, 0
        FROM ({_quality('raw_history', _rawcols)}) a, ({_quality('cleaned', [*_rawcols, 'is_outlier'])}) b""",
    "L8_clean_history": RAW
    + f"SELECT {_clean_cols.format('round(score, 6) AS score')}, is_outlier FROM cleaned",
    "IO7_without_outliers": RAW
    + "SELECT id, part, CAST(date AS VARCHAR) AS date, supplier, amount FROM cleaned WHERE NOT is_outlier",
    "F1_calendar": H + f"SELECT id, part, {_cal} FROM history",
    "F2_target": H + "SELECT id, part, risk_target FROM t",
    "F3_one_hot": H + f"SELECT id, part, category, method, {_hot} FROM history",
    "F4_ordinal": H + f"SELECT id, part, {_ord} FROM history",
    "F5_standard_scale": H + f"SELECT id, part, {_std} FROM history",
    "F5_minmax_scale": H + f"SELECT id, part, {_sc('min({})', 'max({0}) - min({0})')} FROM history",
    "F5_robust_scale": H
    + f"SELECT id, part, {_sc('quantile_cont({}, 0.5)', 'quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)')} FROM history",
    "F6_transformed_columns": H
    + f"SELECT id, part, CAST(date AS VARCHAR) AS date, supplier, score, {_cal}, risk_target, {_hot}, {_ord}, {_std} FROM t",
    "F7_temporal_split": H
    + f"""SELECT id, part, CASE WHEN {_dated} <= floor(n * (1 - CAST(0.2 AS DOUBLE))) THEN 'train' ELSE 'test' END AS split FROM history, n""",
    "F8_stratified_split": H
    + f"""SELECT id, part, CASE WHEN {_classed} <= floor(count(*) OVER (PARTITION BY risk_target) * CAST(0.2 AS DOUBLE) + 0.5)
        THEN 'test' ELSE 'train' END AS split FROM t""",
    "F9_features_and_split": H
    + f"""SELECT id, part, risk_target, amount_scaled, indicator_encoded, split FROM (SELECT id, part, risk_target, {_std}, {_ord},
        CASE WHEN {_dated} <= floor(n * (1 - CAST(0.2 AS DOUBLE))) THEN 'train' ELSE 'test' END AS split FROM t, n)""",
    "M4_class_weights": H
    + "SELECT risk_target, count(*) AS rows, (SELECT count(*) FROM t) / (2 * count(*)) AS weight FROM t GROUP BY risk_target",
    "M7_time_folds": H
    + f"SELECT id, part, CAST(greatest(0, 5 - (n - {_dated}) // (n // 6)) AS INTEGER) AS fold FROM history, n",
    "M7_stratified_folds": H
    + f"""SELECT id, part, CAST(CASE WHEN i <= m % 5 * (m // 5 + 1) THEN (i - 1) // (m // 5 + 1)
        ELSE m % 5 + (i - 1 - m % 5 * (m // 5 + 1)) // (m // 5) END AS INTEGER) AS fold
      FROM (SELECT id, part, {_classed} AS i, count(*) OVER (PARTITION BY risk_target) AS m FROM t)""",
    **{
        name: H
        + f"""SELECT CAST(CAST(date_trunc('{unit}', date) AS DATE) AS VARCHAR) AS period, count(*) AS payments,
            {exact_sum('amount')} AS total_amount, {unit_mean('score')} AS mean_score FROM history GROUP BY 1"""
        for name, unit in (
            ("E1_daily", "day"),
            ("E1_weekly", "week"),
            ("E1_monthly", "month"),
            ("E1_quarterly", "quarter"),
        )
    },
    "E2_rolling": H
    + f""", daily AS (SELECT supplier, date AS day, sum(CAST(amount AS DECIMAL(28,6))) AS s, count(*) AS c FROM history GROUP BY 1, 2)
      SELECT supplier, CAST(day AS VARCHAR) AS day, {_window} FROM daily WINDOW {_frames}""",
}
