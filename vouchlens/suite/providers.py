"""Queries on provider risk (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchlens.operators import provider_risk as op
from vouchlens.plans.ordered import with_row_number
from vouchlens.roles import HistoryRoles
from vouchlens.session import written_once
from vouchlens.sources.role_views import history
from vouchlens.suite.sql import HISTORY, exact_mean, exact_sum, unit_mean

R = HistoryRoles(
    date="date", supplier="supplier", category="category", method="method", amount="amount",
    time="time", score="score", indicator="indicator", season="season", status="status",
)
LOOSE = {
    "critical_score": 0.45,
    "high_amount": 1000000,
    "high_transaction_count": 8,
    "recent_activity_days": 200,
}


def _plain(s, d):
    """A provider here is a supplier's branch for a hundredth of the parts."""
    return history(s, d).withColumn("supplier", F.col("supplier") * 100 + F.col("part") % 100)


def _history(s, d):
    status = F.when(F.col("indicator") == "R", "Retrasado").otherwise("Pagado")
    return _plain(s, d).withColumn("status", status)


def _scores(s, d):
    return op.provider_scores(_history(s, d), R).df


def _alerted(s, d, thresholds=op.ALERT_THRESHOLDS):
    return op.with_alerts(_scores(s, d), thresholds)


def _summary(s, d):
    scores = op.provider_scores(_history(s, d), R)
    return op.overall_summary(op.with_alerts(scores.df), scores.small)


def _tidy(df):
    out = df
    for c, t in df.dtypes:
        if t == "double":
            out = out.withColumn(c, F.round(c, 6))
        elif t == "date":
            out = out.withColumn(c, F.col(c).cast("string"))
    return out


def _one(s, d):
    """The riskiest provider, with the scores computed once for the choice and the detail."""
    scores = written_once(_scores(s, d))
    worst = op.top_risky(scores, "supplier", 1).first()["supplier"]
    return op.provider_detail(op.with_alerts(scores), "supplier", worst)


QUERIES = {
    "R1_mean_compliance": lambda s, d: _tidy(op.mean_compliance(_history(s, d), R)),
    "R2_punctuality": lambda s, d: _tidy(
        _history(s, d).groupBy("supplier").agg(op.punctuality(_history(s, d), R).alias("punctuality"))
    ),
    "R2_punctuality_without_status": lambda s, d: _tidy(
        _plain(s, d).groupBy("supplier").agg(op.punctuality(_plain(s, d), R).alias("punctuality"))
    ),
    "R3_amount_stability": lambda s, d: _tidy(
        _history(s, d).groupBy("supplier").agg(op.stability("amount").alias("amount_volatility"))
    ),
    "R4_recent_performance": lambda s, d: _tidy(op.recent_performance(_history(s, d), R)),
    "R5_final_score": lambda s, d: _tidy(
        op.unranked_scores(_history(s, d), R).select("supplier", "final_risk_score")
    ),
    "R6_risk_category": lambda s, d: op.unranked_scores(_history(s, d), R).select(
        "supplier", "risk_category"
    ),
    "R7_provider_table": lambda s, d: _tidy(_scores(s, d)),
    "R7_rank_without_gathering": lambda s, d: with_row_number(
        op.unranked_scores(_history(s, d), R).withColumn(
            "final_risk_score", F.round("final_risk_score", 1)
        ),
        "final_risk_score",
        "supplier",
        "risk_rank",
        limit=0,
    ).select("supplier", "risk_rank"),
    "R8_alerts": lambda s, d: _tidy(op.alert_rows(_alerted(s, d), "supplier")),
    "R8_alerts_other_thresholds": lambda s, d: _tidy(
        op.alert_rows(_alerted(s, d, LOOSE), "supplier")
    ),
    "R9_severity_counts": lambda s, d: op.severity_counts(_alerted(s, d)),
    "R10_top_risky": lambda s, d: _tidy(
        op.top_risky(_scores(s, d), "supplier").select("supplier", "final_risk_score", "risk_rank")
    ),
    "R11_high_risk": lambda s, d: _tidy(
        op.in_category(_scores(s, d), "alto").select("supplier", "final_risk_score")
    ),
    "R12_provider_detail": lambda s, d: _tidy(
        _one(s, d).select("supplier", "final_risk_score", "risk_category", "alert_count")
    ),
    "R13_category_summary": lambda s, d: _tidy(op.category_summary(_scores(s, d))),
    "R13_overall_summary": lambda s, d: _tidy(_summary(s, d)),
    "R14_score_histogram": lambda s, d: op.score_histogram(_scores(s, d)),
    "R14_component_matrix": lambda s, d: _tidy(op.component_matrix(_scores(s, d), "supplier")),
    "R14_amount_points": lambda s, d: _tidy(op.amount_points(_scores(s, d), "supplier")),
    "R14_latest_activity": lambda s, d: _tidy(op.latest_activity(_scores(s, d), "supplier")),
    "R15_recent_30_days": lambda s, d: _tidy(
        op.provider_scores(_history(s, d), R, recent_days=30).df.select(
            "supplier", "recent_performance", "final_risk_score", "risk_rank"
        )
    ),
}


def _chain(recent=90):
    return f"""WITH {HISTORY},
h AS (SELECT * REPLACE (supplier * 100 + part % 100 AS supplier), indicator = 'R' AS late FROM history),
totals AS (SELECT supplier, count(*) AS total_transactions, {unit_mean('score')} AS score_cumplimiento_avg,
    1.0 - avg(CAST(late AS DOUBLE)) AS payment_delay_frequency,
    CASE WHEN count(*) > 1 THEN 1.0 / (1.0 + stddev_samp(amount) / avg(amount)) ELSE 0.5 END AS amount_volatility,
    {exact_sum('amount')} AS total_amount, {exact_mean('amount')} AS avg_amount,
    max(date) AS last_transaction_date, min(date) AS first_transaction_date FROM h GROUP BY supplier),
recent AS (SELECT h.supplier, {unit_mean('score')} AS recent_performance FROM h JOIN totals ON h.supplier = totals.supplier
    WHERE h.date >= last_transaction_date - INTERVAL {recent} DAY GROUP BY h.supplier),
scored AS (SELECT totals.*, recent_performance, greatest(0.0, least(1.0, score_cumplimiento_avg * CAST(0.4 AS DOUBLE)
    + payment_delay_frequency * CAST(0.25 AS DOUBLE) + amount_volatility * CAST(0.15 AS DOUBLE)
    + recent_performance * CAST(0.2 AS DOUBLE))) AS final_risk_score
  FROM totals JOIN recent ON totals.supplier = recent.supplier),
scores AS (SELECT *, CASE WHEN final_risk_score < 0.4 THEN 'alto' WHEN final_risk_score < 0.7 THEN 'medio' ELSE 'bajo' END AS risk_category,
    row_number() OVER (ORDER BY final_risk_score, supplier) AS risk_rank FROM scored)"""


CHAIN = _chain()


def _alerts(t):
    idle = "datediff('day', last_transaction_date, (SELECT max(last_transaction_date) FROM scores))"
    rules = [
        (
            f"final_risk_score < {t['critical_score']}",
            "CRITICAL_RISK_SCORE",
            "CRITICA",
            "'Score de riesgo crítico: ' || format('{:.3f}', final_risk_score)",
            "Revisar historial completo y considerar restricciones",
        ),
        (
            f"risk_category = 'alto' AND total_amount > {t['high_amount']}",
            "HIGH_RISK_HIGH_AMOUNT",
            "ALTA",
            "'Alto riesgo con monto acumulado: $' || format('{:,.2f}', total_amount)",
            "Limitar crédito o requerir garantías adicionales",
        ),
        (
            "recent_performance < score_cumplimiento_avg - 0.15 AND recent_performance < 0.5",
            "DEGRADED_PERFORMANCE",
            "MEDIA",
            "'Performance reciente degradada: ' || format('{:.3f}', recent_performance) || ' vs histórico ' || format('{:.3f}', score_cumplimiento_avg)",
            "Monitorear de cerca próximas transacciones",
        ),
        (
            "amount_volatility < 0.3",
            "HIGH_VOLATILITY",
            "BAJA",
            "'Alta volatilidad en montos (score: ' || format('{:.3f}', amount_volatility) || ')'",
            "Establecer límites de transacción más estrictos",
        ),
        (
            f"total_transactions > {t['high_transaction_count']} AND risk_category <> 'bajo'",
            "HIGH_VOLUME_RISKY",
            "MEDIA",
            "total_transactions || ' transacciones con riesgo ' || risk_category",
            "Revisar proceso de aprobación para este proveedor",
        ),
        (
            f"{idle} > {t['recent_activity_days']}",
            "INACTIVE_PROVIDER",
            "BAJA",
            f"'Sin actividad en ' || {idle} || ' días'",
            "Actualizar información del proveedor antes de nueva transacción",
        ),
    ]
    return ", alerts AS (" + " UNION ALL ".join(
        f"SELECT supplier, final_risk_score, risk_category, '{k}' AS type, '{sev}' AS severity, {m} AS message, "
        f"'{adv}' AS recommendation FROM scores WHERE {c}"
        for c, k, sev, m, adv in rules
    ) + ") "


_ALL = """supplier, total_transactions, round(score_cumplimiento_avg, 6) AS score_cumplimiento_avg,
  round(payment_delay_frequency, 6) AS payment_delay_frequency, round(amount_volatility, 6) AS amount_volatility,
  round(recent_performance, 6) AS recent_performance, round(final_risk_score, 6) AS final_risk_score, risk_category,
  round(total_amount, 6) AS total_amount, round(avg_amount, 6) AS avg_amount,
  CAST(last_transaction_date AS VARCHAR) AS last_transaction_date, CAST(first_transaction_date AS VARCHAR) AS first_transaction_date, risk_rank"""
_ALERT = "SELECT supplier, round(final_risk_score, 6) AS risk_score, risk_category, type, severity, message, recommendation FROM alerts"
_A = CHAIN + _alerts(op.ALERT_THRESHOLDS)
SQL = {
    "R1_mean_compliance": CHAIN
    + "SELECT supplier, round(score_cumplimiento_avg, 6) AS score_cumplimiento_avg FROM totals",
    "R2_punctuality": CHAIN + "SELECT supplier, round(payment_delay_frequency, 6) AS punctuality FROM totals",
    "R2_punctuality_without_status": CHAIN
    + "SELECT supplier, round(score_cumplimiento_avg, 6) AS punctuality FROM totals",
    "R3_amount_stability": CHAIN
    + "SELECT supplier, round(amount_volatility, 6) AS amount_volatility FROM totals",
    "R4_recent_performance": CHAIN
    + "SELECT supplier, round(recent_performance, 6) AS recent_performance FROM recent",
    "R5_final_score": CHAIN + "SELECT supplier, round(final_risk_score, 6) AS final_risk_score FROM scores",
    "R6_risk_category": CHAIN + "SELECT supplier, risk_category FROM scores",
    "R7_provider_table": CHAIN + f"SELECT {_ALL} FROM scores",
    "R7_rank_without_gathering": CHAIN
    + "SELECT supplier, row_number() OVER (ORDER BY round(final_risk_score, 1), supplier) AS risk_rank FROM scores",
    "R8_alerts": _A + _ALERT,
    "R8_alerts_other_thresholds": CHAIN + _alerts(LOOSE) + _ALERT,
    "R9_severity_counts": _A
    + "SELECT severity, count(type) AS alerts FROM (VALUES "
    + ", ".join(f"('{s}')" for s in op.SEVERITIES)
    + ") s(severity) LEFT JOIN alerts USING (severity) GROUP BY severity",
    "R10_top_risky": CHAIN
    + "SELECT supplier, round(final_risk_score, 6) AS final_risk_score, risk_rank FROM scores ORDER BY final_risk_score, supplier LIMIT 10",
    "R11_high_risk": CHAIN
    + "SELECT supplier, round(final_risk_score, 6) AS final_risk_score FROM scores WHERE risk_category = 'alto'",
    "R12_provider_detail": _A
    + """SELECT supplier, round(final_risk_score, 6) AS final_risk_score, risk_category,
        (SELECT CAST(count(*) AS INTEGER) FROM alerts WHERE alerts.supplier = scores.supplier) AS alert_count
      FROM scores WHERE risk_rank = 1""",
    "R13_category_summary": CHAIN
    + """SELECT c AS category, count(supplier) AS count, round(count(supplier) * 100.0 / (SELECT count(*) FROM scores), 6) AS percentage,
        round(coalesce(avg(final_risk_score), 0), 6) AS avg_score
      FROM (VALUES ('alto'), ('medio'), ('bajo')) t(c) LEFT JOIN scores ON c = risk_category GROUP BY c""",
    "R13_overall_summary": _A
    + """SELECT count(*) AS total_providers, (SELECT count(DISTINCT supplier) FROM alerts) AS total_alerts,
        round(avg(final_risk_score), 6) AS avg_risk_score, round(quantile_cont(final_risk_score, 0.5), 6) AS median_risk_score FROM scores""",
    "R14_score_histogram": CHAIN
    + """SELECT CAST(least(floor((final_risk_score - lo) * 30.0 / (hi - lo)), 29) AS BIGINT) AS bin, count(*) AS providers
      FROM scores, (SELECT min(final_risk_score) AS lo, max(final_risk_score) AS hi FROM scores) GROUP BY 1""",
    "R14_component_matrix": CHAIN
    + ", top AS (SELECT * FROM scores WHERE risk_rank <= 20) "
    + " UNION ALL ".join(
        f"SELECT supplier, '{c}' AS component, round({c}, 6) AS value FROM top" for c in op.COMPONENTS
    ),
    "R14_amount_points": CHAIN
    + "SELECT supplier, risk_category, round(final_risk_score, 6) AS final_risk_score, round(total_amount, 6) AS total_amount FROM scores",
    "R14_latest_activity": CHAIN
    + """SELECT supplier, risk_category, CAST(first_transaction_date AS VARCHAR) AS first_transaction_date,
        CAST(last_transaction_date AS VARCHAR) AS last_transaction_date FROM scores ORDER BY scores.last_transaction_date DESC, supplier LIMIT 20""",
    "R15_recent_30_days": _chain(30)
    + "SELECT supplier, round(recent_performance, 6) AS recent_performance, round(final_risk_score, 6) AS final_risk_score, risk_rank FROM scores",
}
