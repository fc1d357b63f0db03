"""Queries on payments: row rules (P), aggregate rules (D), totals (C), report tables (V)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from vouchlens.operators import approvers, consolidate, duplicates, outliers, row_rules
from vouchlens.roles import PaymentRoles
from vouchlens.session import written_once
from vouchlens.sources.role_views import payments
from vouchlens.suite.sql import AS_OF, PAYMENTS, exact_mean, exact_sum, pct

R = PaymentRoles()
PATTERNS = ["urgent", "not specified"]
S = consolidate.Settings(as_of=date.fromisoformat(AS_OF), patterns=tuple(PATTERNS))
KEY = ["id", "part"]


def _table(spark, folder, *columns):
    """The joined payments (or some columns) as a table, as a detection run reads them several times."""
    rows = payments(spark, folder)
    return written_once(rows.select(*KEY, *columns) if columns else rows)


def _found(spark, folder):
    return consolidate.detect_all(_table(spark, folder), R, S)


def _scored(spark, folder):
    return consolidate.detect_with_scores(_table(spark, folder), R, S)


def _approver_statistics(df):
    return approvers.with_median(approvers.approver_statistics(df, R), df, R)


def _flag(make, name):
    """Every payment with one sub-rule."""
    return lambda spark, folder: payments(spark, folder).select(*KEY, make()[name].alias(name))


def _detector(detect, name, rows=payments):
    cols = [f"{name}_has_anomaly", f"{name}_type", f"{name}_description"]
    return lambda spark, folder: detect(rows(spark, folder)).select(*KEY, *cols)


QUERIES = {
    "P1_standard_columns": lambda s, d: row_rules.standard_columns(
        payments(s, d), "late", "LATE", F.col("status") == R.delayed, F.col("terms")
    ).select(*KEY, "late_has_anomaly", "late_type", "late_description"),
    "P2_excessive_decimals": _flag(lambda: row_rules.format_flags(R), "excessive_decimals"),
    "P3_negative_credit_days": _flag(lambda: row_rules.format_flags(R), "negative_credit_days"),
    "P4_zero_credit_days": _flag(lambda: row_rules.format_flags(R), "zero_credit_days"),
    "P5_invalid_amounts": _flag(lambda: row_rules.format_flags(R), "invalid_amounts"),
    "P6_format": _detector(lambda p: row_rules.detect_format(p, R), "format"),
    "P7_expected_days": lambda s, d: payments(s, d).select(
        *KEY, row_rules.expected_days(R).alias("expected_days")
    ),
    "P8_inconsistent_dates": _flag(lambda: row_rules.temporal_flags(R), "inconsistent_dates"),
    "P9_inverted_dates": _flag(lambda: row_rules.temporal_flags(R), "inverted_dates"),
    "P10_excessive_difference": _flag(lambda: row_rules.temporal_flags(R), "excessive_difference"),
    "P11_temporal": _detector(lambda p: row_rules.detect_temporal(p, R), "temporal"),
    "P12_business_rules": _detector(lambda p: row_rules.detect_business_rules(p, R), "business_rules"),
    "P13_invalid_discounts": _flag(lambda: row_rules.discount_penalty_flags(R), "invalid_discounts"),
    "P14_invalid_penalties": _flag(lambda: row_rules.discount_penalty_flags(R), "invalid_penalties"),
    "P15_discount_on_delayed": _flag(
        lambda: row_rules.discount_penalty_flags(R), "discount_on_delayed"
    ),
    "P16_penalty_on_paid": _flag(lambda: row_rules.discount_penalty_flags(R), "penalty_on_paid"),
    "P17_discount_penalty": _detector(
        lambda p: row_rules.detect_discount_penalty(p, R), "discount_penalty"
    ),
    "P18_delayed_not_past_due": _flag(
        lambda: row_rules.cross_flags(R, S.as_of), "delayed_not_past_due"
    ),
    "P19_pending_past_due": _flag(lambda: row_rules.cross_flags(R, S.as_of), "pending_past_due"),
    "P20_paid_with_penalty": _flag(lambda: row_rules.cross_flags(R, S.as_of), "paid_with_penalty"),
    "P21_delayed_with_discount": _flag(
        lambda: row_rules.cross_flags(R, S.as_of), "delayed_with_discount"
    ),
    "P22_cross_consistency": _detector(
        lambda p: row_rules.detect_cross(p, R, S.as_of), "cross_consistency"
    ),
    "D1_duplicate_rows": lambda s, d: duplicates.detect_duplicates(_table(s, d), R).select(
        *KEY, "duplicate_has_anomaly"
    ),
    "D2_duplicate_differences": lambda s, d: duplicates.duplicate_groups(payments(s, d), R).select(
        "id", "differences"
    ),
    "D3_duplicate_text": _detector(lambda p: duplicates.detect_duplicates(p, R), "duplicate", _table),
    "D4_duplicate_report": lambda s, d: duplicates.duplicate_report(_table(s, d), R),
    "D4_duplicate_values": lambda s, d: duplicates.duplicate_values(_table(s, d), R),
    "D5_duplicate_summary": lambda s, d: duplicates.duplicate_summary(
        duplicates.duplicate_groups(payments(s, d), R)
    ),
    "D6_critical_duplicates": lambda s, d: duplicates.critical_duplicates(
        duplicates.duplicate_groups(payments(s, d), R)
    ).select("id", "duplicate_count"),
    "D7_approver_statistics": lambda s, d: _approver_statistics(_table(s, d)).withColumns(
        {"std_amount": F.round("std_amount", 4), "median_amount": F.round("median_amount", 6)}
    ),
    "D8_atypical_approvers": lambda s, d: approvers.judged_approvers(
        approvers.approver_statistics(payments(s, d), R), R, PATTERNS
    ).select("approver", "low_frequency", "low_mean", "high_mean", "is_atypical"),
    "D9_suspicious_names": lambda s, d: approvers.approver_statistics(payments(s, d), R).select(
        "approver", approvers.suspicious_name(F.col("approver"), PATTERNS).alias("suspicious_name")
    ),
    "D10_approver_rows": _detector(lambda p: approvers.detect_approvers(p, R, PATTERNS), "approver"),
    "D11_approver_report": lambda s, d: approvers.approver_report(_table(s, d), R, PATTERNS)
    .withColumns(
        {"std_amount": F.round("std_amount", 4), "median_amount": F.round("median_amount", 6)}
    ),
    "D12_global_z_score": lambda s, d: outliers.with_global_z(payments(s, d), "amount").select(
        *KEY, F.round("z_score_global", 6).alias("z_score_global")
    ),
    "D13_group_z_scores": lambda s, d: outliers.with_z_scores(_table(s, d, "supplier", "approver", "amount"), R).select(
        *KEY,
        F.round("z_score_by_provider", 6).alias("z_score_by_provider"),
        F.round("z_score_by_approver", 6).alias("z_score_by_approver"),
    ),
    "D14_atypical_amounts": _detector(
        lambda p: outliers.detect_amounts(outliers.with_z_scores(p, R), R),
        "amount",
        lambda s, d: _table(s, d, "supplier", "approver", "amount"),
    ),
    "C1_consolidated": lambda s, d: _found(s, d).select(
        *KEY,
        *[f"{n}_has_anomaly" for n in consolidate.DETECTORS],
        *[f"{n}_type" for n in consolidate.DETECTORS],
    ),
    "C2_total_anomalies": lambda s, d: _found(s, d).select(
        *KEY, "total_anomalies", "has_any_anomaly"
    ),
    "C3_detector_statistics": lambda s, d: consolidate.detector_statistics(_found(s, d)),
    "C4_breakdown": lambda s, d: consolidate.breakdown(_scored(s, d), R, S),
    "C5_detector_attributes": lambda s, d: consolidate.detector_attributes(_table(s, d), R, S),
    "C6_global_statistics": lambda s, d: consolidate.global_statistics(_found(s, d)),
    "C6_anomaly_distribution": lambda s, d: consolidate.anomaly_distribution(_found(s, d)),
    "C7_top_anomalies": lambda s, d: consolidate.top_anomalies(_found(s, d), R, 10, ("part",)).select(
        *KEY, "total_anomalies"
    ),
    "C8_summary": lambda s, d: consolidate.summary(_scored(s, d), R, S),
    "C9_financial_impact": lambda s, d: consolidate.financial_impact(_found(s, d), R, S),
    "C10_total_impact": lambda s, d: consolidate.total_impact(
        consolidate.financial_impact(_found(s, d), R, S)
    ).select(F.round("total_impact", 4).alias("total_impact")),
    "C11_other_parameters": lambda s, d: consolidate.detector_statistics(
        consolidate.detect_all(
            _table(s, d),
            R,
            consolidate.Settings(
                as_of=S.as_of,
                tolerance_days=30,
                z_threshold=2.0,
                discount_bounds=(2, 10),
                penalty_bounds=(1, 7),
                patterns=("high",),
            ),
        )
    ),
    "V1_detector_chart": lambda s, d: consolidate.detector_chart(_found(s, d)),
    "V2_multiplicity_chart": lambda s, d: consolidate.multiplicity_chart(_found(s, d)),
    "V3_amount_histogram": lambda s, d: consolidate.amount_histogram(_found(s, d), "amount"),
    "V4_approver_chart": lambda s, d: consolidate.approver_chart(_found(s, d), R),
    "V5_monthly_chart": lambda s, d: consolidate.monthly_chart(_found(s, d), R),
    "V6_state_chart": lambda s, d: consolidate.state_chart(_found(s, d), R),
    "V7_rule_tree": lambda s, d: consolidate.rule_tree(_scored(s, d), R, S),
    "V8_top_rows": lambda s, d: consolidate.top_anomalies(_found(s, d), R, 20, ("part",)).select(
        "id", "part", "supplier", "amount", "status", "approver", "total_anomalies"
    ),
    "V9_risk_matrix": lambda s, d: consolidate.risk_matrix(_found(s, d)),
}

# --- the same in SQL --------------------------------------------------------

FLAG_SQL = {
    "excessive_decimals": "round(amount, 2) <> amount",
    "negative_credit_days": "credit_days < 0",
    "zero_credit_days": "credit_days = 0",
    "invalid_amounts": "amount <= 0",
    "inconsistent_dates": "abs(datediff('day', invoice_date, due_date) - expected) > {tolerance}",
    "inverted_dates": "due_date < invoice_date",
    "excessive_difference": "datediff('day', invoice_date, due_date) > 730",
    "invalid_discounts": "(discount < {d0} OR discount > {d1})",
    "invalid_penalties": "(penalty < {p0} OR penalty > {p1})",
    "discount_on_delayed": "(status = 'Retrasado' AND discount > 0)",
    "penalty_on_paid": "(status = 'Pagado' AND penalty > 0)",
    "delayed_not_past_due": f"(status = 'Retrasado' AND due_date > DATE '{AS_OF}')",
    "pending_past_due": f"(status = 'Pendiente' AND due_date < DATE '{AS_OF}')",
    "paid_with_penalty": "(status = 'Pagado' AND penalty > 0)",
    "delayed_with_discount": "(status = 'Retrasado' AND discount > 0)",
}

DIFFERENCES = ", ".join(
    f"CASE WHEN min({c}) <> max({c}) THEN '{c}' END"
    for c in (
        "supplier invoice_date due_date amount terms status credit_days discount penalty "
        "approver part"
    ).split()
)


def chain(tolerance=5, z=3.0, d=(0, 15), p=(0, 5), patterns=("urgent", "not specified")):
    """All intermediate tables of the detection run."""
    flags = ",\n    ".join(
        f"{v.format(tolerance=tolerance, d0=d[0], d1=d[1], p0=p[0], p1=p[1])} AS {k}"
        for k, v in FLAG_SQL.items()
    )
    named = " OR ".join(f"contains(lower(approver), '{x}')" for x in patterns)
    return f"""WITH {PAYMENTS},
expected AS (SELECT *, CAST(regexp_extract(terms, '([0-9]+)', 1) AS INTEGER) AS expected FROM payments),
flags AS (SELECT *, expected <> credit_days AS terms_mismatch,
    {flags} FROM expected),
dup AS (SELECT id, count(*) AS copies, coalesce(nullif(concat_ws(', ', {DIFFERENCES}), ''), 'ninguna') AS differences,
    min(approver) <> max(approver) AS different_approvers, min(amount) <> max(amount) AS different_amounts
  FROM payments GROUP BY id HAVING count(*) > 1),
sup AS (SELECT supplier, {exact_mean('amount')} AS mean, stddev_samp(amount) AS std FROM payments GROUP BY supplier),
app0 AS (SELECT approver, count(*) AS n, {exact_mean('amount')} AS mean, stddev_samp(amount) AS std,
    {exact_sum('amount')} AS total, min(amount) AS low, max(amount) AS high,
    quantile_cont(amount, 0.5) AS median, ({named}) AS suspicious_name FROM payments GROUP BY approver),
edges AS (SELECT quantile_cont(CAST(n AS DOUBLE), 0.1) AS few, quantile_cont(mean, 0.25) AS q1,
    quantile_cont(mean, 0.75) AS q3 FROM app0),
app AS (SELECT app0.*, n < few AS low_frequency, mean < q1 AS low_mean, mean > q3 AS high_mean,
    (n < few AND (mean < q1 OR mean > q3)) AS is_atypical,
    (n < few AND (mean < q1 OR mean > q3)) OR suspicious_name AS is_suspicious FROM app0, edges),
whole AS (SELECT {exact_mean('amount')} AS mean, stddev_samp(amount) AS std FROM payments),
scored AS (SELECT f.*, dup.copies, dup.differences, dup.id IS NOT NULL AS duplicate_has_anomaly,
    app.is_suspicious AS approver_has_anomaly, app.n AS app_n, app.mean AS app_mean, app.low_frequency,
    app.low_mean, app.high_mean, app.suspicious_name,
    (f.amount - whole.mean) / whole.std AS zg,
    CASE WHEN sup.std > 0 THEN (f.amount - sup.mean) / sup.std ELSE 0.0 END AS zs,
    CASE WHEN app.std > 0 THEN (f.amount - app.mean) / app.std ELSE 0.0 END AS za
  FROM flags f LEFT JOIN dup ON f.id = dup.id LEFT JOIN sup ON f.supplier = sup.supplier
  LEFT JOIN app ON f.approver = app.approver CROSS JOIN whole),
found0 AS (SELECT *,
    abs(zg) > {z} AS global_outliers, abs(zs) > {z} AS provider_outliers, abs(za) > {z} AS approver_outliers,
    (abs(zg) > {z} OR abs(zs) > {z} OR abs(za) > {z}) AS amount_has_anomaly,
    (excessive_decimals OR negative_credit_days OR zero_credit_days OR invalid_amounts) AS format_has_anomaly,
    (inconsistent_dates OR inverted_dates OR excessive_difference) AS temporal_has_anomaly,
    terms_mismatch AS business_rules_has_anomaly,
    (invalid_discounts OR invalid_penalties OR discount_on_delayed OR penalty_on_paid) AS discount_penalty_has_anomaly,
    (delayed_not_past_due OR pending_past_due OR paid_with_penalty OR delayed_with_discount) AS cross_consistency_has_anomaly
  FROM scored),
found AS (SELECT *, total_anomalies > 0 AS has_any_anomaly FROM (SELECT *,
    {' + '.join(f'CAST({n}_has_anomaly AS INTEGER)' for n in consolidate.DETECTORS)} AS total_anomalies
  FROM found0))
"""


CHAIN = chain()
TYPES = {
    "duplicate": "DUPLICATE_TRANSACTION",
    "format": "FORMAT_ANOMALY",
    "temporal": "TEMPORAL_ANOMALY",
    "business_rules": "PAYMENT_TERMS_INCONSISTENCY",
    "approver": "ATYPICAL_APPROVER",
    "amount": "ATYPICAL_AMOUNT",
    "discount_penalty": "DISCOUNT_PENALTY_ANOMALY",
    "cross_consistency": "CROSS_CONSISTENCY_ANOMALY",
}
RULES = {
    "format": ["excessive_decimals", "negative_credit_days", "zero_credit_days", "invalid_amounts"],
    "temporal": ["inconsistent_dates", "inverted_dates", "excessive_difference"],
    "amount": ["global_outliers", "provider_outliers", "approver_outliers"],
    "discount_penalty": [
        "invalid_discounts",
        "invalid_penalties",
        "discount_on_delayed",
        "penalty_on_paid",
    ],
    "cross_consistency": [
        "delayed_not_past_due",
        "pending_past_due",
        "paid_with_penalty",
        "delayed_with_discount",
    ],
}


def _type_sql(name):
    return f"CASE WHEN {name}_has_anomaly THEN '{TYPES[name]}' END AS {name}_type"


def _text_sql(name, parts):
    """Rows of one detector with its description."""
    joined = ", ".join(f"CASE WHEN {cond} THEN {txt} END" for cond, txt in parts)
    return CHAIN + (
        f"SELECT id, part, {name}_has_anomaly, {_type_sql(name)}, "
        f"nullif(concat_ws('; ', {joined}), '') AS {name}_description FROM found"
    )


def _v(column):
    return f"CAST({column} AS VARCHAR)"


_real = "datediff('day', invoice_date, due_date)"
_stats = CHAIN + ", stats AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS detector, count(*) AS total, count(*) FILTER ({n}_has_anomaly) AS hits FROM found"
    for n in consolidate.DETECTORS
) + ") "
_rules = ", rules AS (" + " UNION ALL ".join(
    f"SELECT '{d}' AS detector, '{n}' AS rule, count(*) FILTER ({n}) AS cases FROM found"
    for d, names in RULES.items()
    for n in names
) + ") "
_statistics = (
    f"SELECT detector, total AS total_records, hits AS anomalies_found, {pct('hits', 'total')} AS anomaly_percentage, "
    f"total - hits AS clean_records, {pct('(total - hits)', 'total')} AS clean_percentage FROM stats"
)


def _case_map(key, table):
    return f"CASE {key} " + " ".join(
        f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in table.items()
    ) + " END"


_impact = CHAIN + ", impact AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS category, {v} AS estimated_impact, {n} AS cases FROM found"
    for c, v, n in zip(
        consolidate.IMPACT_CATEGORIES,
        [
            exact_sum("CASE WHEN delayed_with_discount THEN amount * discount / 100 END"),
            exact_sum("CASE WHEN paid_with_penalty THEN amount * penalty / 100 END"),
            exact_sum("CASE WHEN pending_past_due THEN amount END"),
            exact_sum("CASE WHEN amount_has_anomaly THEN amount END"),
            exact_sum("CASE WHEN duplicate_has_anomaly THEN amount END") + " / 2",
        ],
        [
            "CAST(count(*) FILTER (delayed_with_discount) AS DOUBLE)",
            "CAST(count(*) FILTER (paid_with_penalty) AS DOUBLE)",
            "CAST(count(*) FILTER (pending_past_due) AS DOUBLE)",
            "CAST(count(*) FILTER (amount_has_anomaly) AS DOUBLE)",
            "count(*) FILTER (duplicate_has_anomaly) / 2",
        ],
        strict=True,
    )
) + ") "
_report = (
    "approver, n AS transaction_count, mean AS avg_amount, round(std, 4) AS std_amount, total AS total_amount, "
    "low AS min_amount, high AS max_amount, round(median, 6) AS median_amount"
)

_flag_ids = {
    "P2": "excessive_decimals",
    "P3": "negative_credit_days",
    "P4": "zero_credit_days",
    "P5": "invalid_amounts",
    "P8": "inconsistent_dates",
    "P9": "inverted_dates",
    "P10": "excessive_difference",
    "P13": "invalid_discounts",
    "P14": "invalid_penalties",
    "P15": "discount_on_delayed",
    "P16": "penalty_on_paid",
    "P18": "delayed_not_past_due",
    "P19": "pending_past_due",
    "P20": "paid_with_penalty",
    "P21": "delayed_with_discount",
}

SQL = {f"{p}_{n}": CHAIN + f"SELECT id, part, {n} FROM flags" for p, n in _flag_ids.items()}
SQL |= {
    "P1_standard_columns": f"""WITH {PAYMENTS} SELECT id, part, status = 'Retrasado' AS late_has_anomaly,
        CASE WHEN status = 'Retrasado' THEN 'LATE' END AS late_type,
        CASE WHEN status = 'Retrasado' THEN terms END AS late_description FROM payments""",
    "P6_format": _text_sql(
        "format",
        [
            (
                "excessive_decimals",
                f"'Monto con ' || length(split_part({_v('amount')}, '.', 2)) || ' decimales'",
            ),
            ("negative_credit_days", f"'Días de crédito negativos: ' || {_v('credit_days')}"),
            ("zero_credit_days", "'Días de crédito igual a cero'"),
            (
                "invalid_amounts",
                f"CASE WHEN amount < 0 THEN 'Monto negativo: ' || {_v('amount')} ELSE 'Monto igual a cero' END",
            ),
        ],
    ),
    "P7_expected_days": CHAIN + "SELECT id, part, expected AS expected_days FROM flags",
    "P11_temporal": _text_sql(
        "temporal",
        [
            (
                "inverted_dates",
                f"'Fecha vencimiento (' || {_v('due_date')} || ') anterior a fecha factura (' || {_v('invoice_date')} || ')'",
            ),
            (
                "inconsistent_dates AND NOT inverted_dates",
                f"'Diferencia real (' || {_real} || ' días) vs esperada (' || expected || ' días): ' || abs({_real} - expected) || ' días de diferencia'",
            ),
            (
                "excessive_difference AND NOT inverted_dates",
                f"'Diferencia excesiva: ' || {_real} || ' días (>2 años)'",
            ),
        ],
    ),
    "P12_business_rules": _text_sql(
        "business_rules",
        [
            (
                "terms_mismatch",
                "'Inconsistencia: condiciones ''' || terms || ''' (esperado: ' || expected || ' días) vs dias_credito otorgados: ' || credit_days || ' días'",
            )
        ],
    ),
    "P17_discount_penalty": _text_sql(
        "discount_penalty",
        [
            ("invalid_discounts", f"'Descuento fuera de rango (0-15%): ' || {_v('discount')} || '%'"),
            ("invalid_penalties", f"'Penalización fuera de rango (0-5%): ' || {_v('penalty')} || '%'"),
            (
                "discount_on_delayed",
                f"'Descuento de ' || {_v('discount')} || '% aplicado a pago retrasado (ilógico)'",
            ),
            (
                "penalty_on_paid",
                f"'Penalización de ' || {_v('penalty')} || '% en pago marcado como pagado (ilógico)'",
            ),
        ],
    ),
    "P22_cross_consistency": _text_sql(
        "cross_consistency",
        [
            (
                "delayed_not_past_due",
                f"'Marcado como ''Retrasado'' pero vence en fecha futura (' || {_v('due_date')} || ')'",
            ),
            (
                "pending_past_due",
                f"'Marcado como ''Pendiente'' pero ya venció (' || {_v('due_date')} || ')'",
            ),
            (
                "paid_with_penalty",
                f"'Marcado como ''Pagado'' pero tiene penalización por mora (' || {_v('penalty')} || '%)'",
            ),
            (
                "delayed_with_discount",
                f"'Marcado como ''Retrasado'' pero tiene descuento pronto pago (' || {_v('discount')} || '%)'",
            ),
        ],
    ),
    "D1_duplicate_rows": CHAIN + "SELECT id, part, duplicate_has_anomaly FROM found",
    "D2_duplicate_differences": CHAIN + "SELECT id, differences FROM dup",
    "D3_duplicate_text": _text_sql(
        "duplicate",
        [
            (
                "duplicate_has_anomaly",
                "'ID duplicado ' || copies || ' veces. Diferencias en: ' || differences",
            )
        ],
    ),
    "D4_duplicate_report": CHAIN
    + """SELECT dup.id, any_value(copies) AS duplicate_count, any_value(differences) AS differences,
        any_value(different_approvers) AS different_approvers, any_value(different_amounts) AS different_amounts,
        count(DISTINCT approver) AS approvers, count(DISTINCT amount) AS amounts
      FROM dup JOIN payments ON payments.id = dup.id GROUP BY dup.id""",
    "D4_duplicate_values": CHAIN
    + """SELECT DISTINCT id, 'approver' AS "column", approver AS value FROM payments JOIN dup USING (id)
      UNION ALL SELECT DISTINCT id, 'amount', CAST(amount AS VARCHAR) FROM payments JOIN dup USING (id)""",
    "D5_duplicate_summary": CHAIN
    + """SELECT count(*) AS total_duplicate_groups,
        count(*) FILTER (different_approvers) AS groups_with_different_approvers,
        count(*) FILTER (different_amounts) AS groups_with_different_amounts,
        count(*) FILTER (different_approvers AND different_amounts) AS groups_with_both_different,
        CAST(sum(copies) AS BIGINT) AS total_duplicate_records FROM dup""",
    "D6_critical_duplicates": CHAIN
    + "SELECT id, copies AS duplicate_count FROM dup WHERE different_approvers OR different_amounts",
    "D7_approver_statistics": CHAIN + f"SELECT {_report} FROM app",
    "D8_atypical_approvers": CHAIN
    + "SELECT approver, low_frequency, low_mean, high_mean, is_atypical FROM app",
    "D9_suspicious_names": CHAIN + "SELECT approver, suspicious_name FROM app",
    "D10_approver_rows": CHAIN
    + f"""SELECT id, part, approver_has_anomaly, {_type_sql('approver')},
        CASE WHEN approver_has_anomaly THEN 'Aprobador atípico: ' || approver || '. ' || concat_ws('; ',
          CASE WHEN low_frequency THEN 'Baja frecuencia (' || app_n || ' transacciones)' END,
          CASE WHEN low_mean THEN 'Monto promedio bajo ($' || format('{{:.2f}}', app_mean) || ')'
               WHEN high_mean THEN 'Monto promedio alto ($' || format('{{:.2f}}', app_mean) || ')' END,
          CASE WHEN suspicious_name THEN 'Nombre sospechoso' END) END AS approver_description FROM found""",
    "D11_approver_report": CHAIN + f"SELECT {_report}, is_suspicious FROM app",
    "D12_global_z_score": CHAIN + "SELECT id, part, round(zg, 6) AS z_score_global FROM found",
    "D13_group_z_scores": CHAIN
    + "SELECT id, part, round(zs, 6) AS z_score_by_provider, round(za, 6) AS z_score_by_approver FROM found",
    "D14_atypical_amounts": _text_sql(
        "amount",
        [
            (
                "global_outliers",
                "'Monto atípico global: $' || format('{:.2f}', amount) || ' (Z-score: ' || format('{:.2f}', zg) || ')'",
            ),
            (
                "provider_outliers",
                "'Atípico para proveedor ' || supplier || ' (Z-score: ' || format('{:.2f}', zs) || ')'",
            ),
            (
                "approver_outliers",
                "'Atípico para aprobador ' || approver || ' (Z-score: ' || format('{:.2f}', za) || ')'",
            ),
        ],
    ),
    "C1_consolidated": CHAIN
    + "SELECT id, part, "
    + ", ".join(f"{n}_has_anomaly, {_type_sql(n)}" for n in consolidate.DETECTORS)
    + " FROM found",
    "C2_total_anomalies": CHAIN + "SELECT id, part, total_anomalies, has_any_anomaly FROM found",
    "C3_detector_statistics": _stats + _statistics,
    "C4_breakdown": CHAIN + _rules + "SELECT * FROM rules",
    "C5_detector_attributes": CHAIN
    + """, d AS (SELECT count(*) AS g, count(*) FILTER (different_approvers) AS a, count(*) FILTER (different_amounts) AS m,
        count(*) FILTER (different_approvers AND different_amounts) AS b, sum(copies) AS c FROM dup)
      SELECT * FROM (VALUES ('temporal', 'tolerance_days', '5'), ('amount', 'z_threshold', '3.0'),
        ('discount_penalty', 'discount_range', '0-15%'), ('discount_penalty', 'penalty_range', '0-5%'),
        ('cross_consistency', 'reference_date', '"""
    + AS_OF
    + """')) t(detector, attribute, value)
      UNION ALL SELECT 'duplicate', 'total_duplicate_groups', CAST(g AS VARCHAR) FROM d
      UNION ALL SELECT 'duplicate', 'groups_with_different_approvers', CAST(a AS VARCHAR) FROM d
      UNION ALL SELECT 'duplicate', 'groups_with_different_amounts', CAST(m AS VARCHAR) FROM d
      UNION ALL SELECT 'duplicate', 'groups_with_both_different', CAST(b AS VARCHAR) FROM d
      UNION ALL SELECT 'duplicate', 'total_duplicate_records', CAST(c AS VARCHAR) FROM d
      UNION ALL SELECT 'approver', 'suspicious_approvers_count', CAST(count(*) AS VARCHAR) FROM app WHERE is_suspicious
      UNION ALL SELECT 'approver', 'suspicious_approver', approver FROM app WHERE is_suspicious""",
    "C6_global_statistics": CHAIN
    + f"""SELECT total AS total_records, hits AS records_with_anomalies, total - hits AS records_clean,
        {pct('hits', 'total')} AS anomaly_percentage, {pct('(total - hits)', 'total')} AS clean_percentage
      FROM (SELECT count(*) AS total, count(*) FILTER (has_any_anomaly) AS hits FROM found)""",
    "C6_anomaly_distribution": CHAIN
    + "SELECT total_anomalies, count(*) AS records FROM found GROUP BY total_anomalies",
    "C7_top_anomalies": CHAIN
    + "SELECT id, part, total_anomalies FROM found ORDER BY total_anomalies DESC, id, part LIMIT 10",
    "C8_summary": _stats
    + _rules
    + """SELECT 'global' AS section, 'total_records' AS item, count(*) AS cases FROM found
      UNION ALL SELECT 'global', 'records_with_anomalies', count(*) FILTER (has_any_anomaly) FROM found
      UNION ALL SELECT 'global', 'records_clean', count(*) FILTER (NOT has_any_anomaly) FROM found
      UNION ALL SELECT 'detector', detector, hits FROM stats
      UNION ALL SELECT 'breakdown.' || detector, rule, cases FROM rules
      UNION ALL SELECT 'distribution', CAST(total_anomalies AS VARCHAR), count(*) FROM found GROUP BY total_anomalies""",
    "C9_financial_impact": _impact + "SELECT * FROM impact",
    "C10_total_impact": _impact + "SELECT round(sum(estimated_impact), 4) AS total_impact FROM impact",
    "C11_other_parameters": chain(30, 2.0, (2, 10), (1, 7), ("high",))
    + _stats[len(CHAIN) :]
    + _statistics,
    "V1_detector_chart": _stats
    + f"SELECT {_case_map('detector', consolidate.DETECTOR_LABELS)} AS label, detector, hits AS anomalies_found, {pct('hits', 'total')} AS anomaly_percentage FROM stats",
    "V2_multiplicity_chart": CHAIN
    + "SELECT total_anomalies, count(*) AS records FROM found WHERE total_anomalies > 0 GROUP BY total_anomalies",
    "V3_amount_histogram": CHAIN
    + """SELECT CAST(least(floor((amount - lo) * 50.0 / (hi - lo)), 49) AS BIGINT) AS bin, count(*) AS payments,
        count(*) FILTER (has_any_anomaly) AS anomalous
      FROM found, (SELECT min(amount) AS lo, max(amount) AS hi FROM payments) GROUP BY 1""",
    "V4_approver_chart": CHAIN
    + f"""SELECT approver, count(*) AS payments, {exact_sum('amount')} AS total_amount,
        count(*) FILTER (has_any_anomaly) AS anomalous FROM found WHERE NOT duplicate_has_anomaly GROUP BY approver""",
    "V5_monthly_chart": CHAIN
    + """SELECT strftime(invoice_date, '%Y-%m') AS month, count(*) AS records,
        CAST(sum(total_anomalies) AS BIGINT) AS total_anomalies FROM found WHERE has_any_anomaly GROUP BY 1""",
    "V6_state_chart": CHAIN
    + """SELECT status, count(*) AS total, count(*) FILTER (has_any_anomaly) AS with_anomalies,
        count(*) FILTER (NOT has_any_anomaly) AS without_anomalies FROM found GROUP BY status""",
    "V7_rule_tree": CHAIN
    + _rules
    + "SELECT "
    + _case_map(
        "detector",
        {
            "format": "Format",
            "temporal": "Temporal",
            "amount": "Amount",
            "discount_penalty": "Discount Penalty",
            "cross_consistency": "Cross Consistency",
        },
    )
    + " AS detector, rule, cases FROM rules",
    "V8_top_rows": CHAIN
    + """SELECT id, part, supplier, amount, status, approver, total_anomalies FROM found
      ORDER BY total_anomalies DESC, id, part LIMIT 20""",
    "V9_risk_matrix": _stats
    + "SELECT "
    + _case_map("detector", consolidate.DETECTOR_LABELS)
    + " AS label, hits AS cases, "
    + _case_map("detector", {k: v[0] for k, v in consolidate.RISK_RATINGS.items()})
    + " AS impact, "
    + _case_map("detector", {k: v[1] for k, v in consolidate.RISK_RATINGS.items()})
    + " AS probability, "
    + _case_map("detector", {k: v[0] * v[1] for k, v in consolidate.RISK_RATINGS.items()})
    + " AS risk, "
    + _case_map("detector", {k: v[2] for k, v in consolidate.RISK_RATINGS.items()})
    + " AS description FROM stats",
}
