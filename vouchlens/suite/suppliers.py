"""Queries on supplier master data (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchlens.operators import suppliers as op
from vouchlens.roles import SupplierRoles
from vouchlens.sources.role_views import suppliers
from vouchlens.suite.sql import exact_mean, exact_sum

R = SupplierRoles(
    id="supplier", name="name", size="size", country="country", category="category",
    credit="credit", performance="performance", certificates="certificates",
)


def _parsed(s, d):
    return op.parse_suppliers(suppliers(s, d), R)


def _scored(s, d):
    return op.with_level(op.with_performance(_parsed(s, d)))


def _done(s, d):
    return op.analyse(suppliers(s, d), R)


def _credit(s, d):
    return op.credit_recommendations(_done(s, d), R)


def _r(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


QUERIES = {
    "IO3_parsed_suppliers": lambda s, d: _parsed(s, d).select(
        "supplier",
        "on_time_delivery",
        "quality_issues",
        "customer_complaints",
        F.array_join("certificaciones_list", ",").alias("certificates"),
        "num_certificaciones",
    ),
    "S1_performance": lambda s, d: _r(
        _scored(s, d).select("supplier", "score_performance"), "score_performance"
    ),
    "S2_performance_level": lambda s, d: _scored(s, d).select("supplier", "nivel_performance"),
    "S3_risk_score": lambda s, d: _r(
        op.with_risk_score(_scored(s, d), R).select("supplier", "score_riesgo"), "score_riesgo"
    ),
    "S4_segment": lambda s, d: _done(s, d).select("supplier", "segmento_riesgo"),
    "S5_by_size": lambda s, d: op.by_size(_done(s, d), R),
    "S5_size_ranking": lambda s, d: _r(op.size_ranking(_done(s, d), R), "score_performance"),
    "S6_by_country": lambda s, d: op.by_country(_done(s, d), R),
    "S6_country_ranking": lambda s, d: _r(op.country_ranking(_done(s, d), R), "score_riesgo"),
    "S7_by_certificate_count": lambda s, d: op.by_certificate_count(_done(s, d), R),
    "S8_by_certificate": lambda s, d: op.by_certificate(_done(s, d)),
    "S9_approval_matrix": lambda s, d: op.approval_matrix(_done(s, d), R),
    "S10_credit_recommendations": lambda s, d: _credit(s, d),
    "S11_segment_distribution": lambda s, d: _r(op.segment_distribution(_done(s, d)), "pct"),
    "S12_segment_by_size": lambda s, d: op.segment_by_size(_done(s, d), R),
    "S13_top_per_segment": lambda s, d: _r(op.top_per_segment(_done(s, d), R), "score_performance"),
    "S14_risk_by_size": lambda s, d: op.risk_by_size(_done(s, d), R),
    "S14_risk_by_country": lambda s, d: op.risk_by_country(_done(s, d), R),
    "S15_declared_against_score": lambda s, d: op.declared_against_score(_done(s, d), R),
    "S16_misclassified": lambda s, d: op.misclassified(_done(s, d), R),
    "S17_action_distribution": lambda s, d: _r(op.action_distribution(_credit(s, d)), "pct"),
    "S18_top_increases": lambda s, d: op.top_changes(_credit(s, d), R, "Aumentar"),
    "S18_top_decreases": lambda s, d: op.top_changes(_credit(s, d), R, "Reducir"),
    "S19_portfolio": lambda s, d: _r(op.portfolio(_credit(s, d), R), "diferencia"),
    "S20_headline": lambda s, d: _r(op.headline(_done(s, d), R), "performance_promedio"),
    "S20_level_counts": lambda s, d: op.level_counts(_done(s, d)),
    "S20_performance_by_size": lambda s, d: op.performance_by_size(_done(s, d), R),
    "S20_credit_points": lambda s, d: op.credit_points(_credit(s, d), R),
    "S20_risk_points": lambda s, d: _r(
        op.risk_points(_done(s, d), R), "score_performance", "score_riesgo"
    ),
    "S21_suppliers_end_to_end": lambda s, d: _r(
        _done(s, d).select(
            "supplier",
            "score_performance",
            "nivel_performance",
            "score_riesgo",
            "segmento_riesgo",
            "num_certificaciones",
        ),
        "score_performance",
        "score_riesgo",
    ),
}


def _cert(shift):
    return (
        f"['ISO 9001', 'ISO 14001', 'None', 'OHSAS 18001'][((s_suppkey * {shift + 1} + s_suppkey // {4 + shift}) % 4) + 1]"
    )


CHAIN = f"""WITH base AS (
  SELECT s_suppkey AS supplier, s_name AS name, ['Grande', 'Mediana', 'Pequeña'][(s_suppkey % 3) + 1] AS size, n_name AS country,
    CASE WHEN s_acctbal < 2700 THEN 'Alto' WHEN s_acctbal < 6300 THEN 'Medio' ELSE 'Bajo' END AS category,
    round(s_acctbal * 5, 2) AS credit,
    CASE WHEN s_suppkey % 11 = 0 THEN 0 ELSE CAST(50 + (s_suppkey * 7) % 51 AS INTEGER) END AS on_time_delivery,
    CASE WHEN s_suppkey % 11 = 0 THEN 0 ELSE CAST((s_suppkey * 3) % 6 AS INTEGER) END AS quality_issues,
    CASE WHEN s_suppkey % 11 = 0 THEN 0 ELSE CAST((s_suppkey * 5) % 4 AS INTEGER) END AS customer_complaints,
    CASE WHEN s_suppkey % 13 = 0 THEN [] ELSE [{_cert(0)}, {_cert(1)}, {_cert(2)}][1:(s_suppkey % 4)] END AS certs
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
parsed AS (SELECT *, CAST(len(list_filter(certs, lambda c: c <> 'None')) AS INTEGER) AS num_certificaciones FROM base),
scored AS (SELECT *, on_time_delivery * CAST(0.5 AS DOUBLE) + (100 - quality_issues * 10) * CAST(0.3 AS DOUBLE)
    + (100 - customer_complaints * 10) * CAST(0.2 AS DOUBLE) AS score_performance FROM parsed),
leveled AS (SELECT *, CASE WHEN score_performance <= 0 THEN NULL WHEN score_performance <= 60 THEN 'Crítico'
    WHEN score_performance <= 75 THEN 'Regular' WHEN score_performance <= 90 THEN 'Bueno' WHEN score_performance <= 100 THEN 'Excelente' END AS nivel_performance,
    CASE category WHEN 'Alto' THEN 3 WHEN 'Medio' THEN 2 ELSE 1 END * 30 + CASE size WHEN 'Pequeña' THEN 3 WHEN 'Mediana' THEN 2 ELSE 1 END * 20
    + (100 - score_performance) * CAST(0.4 AS DOUBLE) + (3 - greatest(0, least(3, num_certificaciones))) * 10 AS score_riesgo FROM scored),
edges AS (SELECT quantile_cont(score_riesgo, 0.25) AS q1, quantile_cont(score_riesgo, 0.5) AS q2, quantile_cont(score_riesgo, 0.75) AS q3 FROM leveled),
done AS (SELECT leveled.*, CASE WHEN score_riesgo <= q1 THEN 'Premium' WHEN score_riesgo <= q2 THEN 'Estándar'
    WHEN score_riesgo <= q3 THEN 'Supervisión' ELSE 'Alto_Riesgo' END AS segmento_riesgo FROM leveled, edges),
wanted AS (SELECT *, round_even(CASE segmento_riesgo WHEN 'Premium' THEN CAST(45000 AS DOUBLE) WHEN 'Estándar' THEN 30000 WHEN 'Supervisión' THEN 18000 ELSE 8000 END
    * (score_performance / 80) * CASE size WHEN 'Grande' THEN CAST(1.3 AS DOUBLE) WHEN 'Mediana' THEN 1.0 ELSE CAST(0.8 AS DOUBLE) END / 100, 0) * 100 AS limite_recomendado FROM done),
varied AS (SELECT *, round_even((limite_recomendado - credit) / credit * 100, 1) AS variacion_credito FROM wanted),
credit AS (SELECT supplier, name, size, country, segmento_riesgo, nivel_performance, credit, limite_recomendado, variacion_credito,
    CASE WHEN variacion_credito > 10 THEN 'Aumentar' WHEN variacion_credito < -10 THEN 'Reducir' ELSE 'Mantener' END AS accion_credito FROM varied)
"""


def _m(c, d=2):
    return f"round_even(avg({c}), {d})"


_segments = "(VALUES " + ", ".join(f"('{s}', {i})" for i, s in enumerate(op.SEGMENTS)) + ") t(segmento, i)"
_policy = "(VALUES " + ", ".join(
    f"('{s}', {p[0]}, '{p[1]}', {p[2]}, '{p[3]}', '{p[4]}')" for s, p in op.SEGMENT_POLICY.items()
) + ") p(segmento, limite_credito_max, condiciones_pago, descuento_maximo, requiere_aprobacion, frecuencia_revision)"
_sizes = ", ".join(f"count(*) FILTER (size = '{z}') AS \"{z}\"" for z in op.SIZES)
SQL = {
    "IO3_parsed_suppliers": CHAIN
    + "SELECT supplier, on_time_delivery, quality_issues, customer_complaints, array_to_string(certs, ',') AS certificates, num_certificaciones FROM parsed",
    "S1_performance": CHAIN + "SELECT supplier, round(score_performance, 6) AS score_performance FROM scored",
    "S2_performance_level": CHAIN + "SELECT supplier, nivel_performance FROM leveled",
    "S3_risk_score": CHAIN + "SELECT supplier, round(score_riesgo, 6) AS score_riesgo FROM leveled",
    "S4_segment": CHAIN + "SELECT supplier, segmento_riesgo FROM done",
    "S5_by_size": CHAIN
    + f"""SELECT size AS tipo_empresa, {_m('on_time_delivery')} AS entrega_puntual_media,
        round_even(stddev_samp(on_time_delivery), 2) AS entrega_puntual_std, {_m('quality_issues')} AS issues_calidad_media,
        CAST(sum(quality_issues) AS BIGINT) AS issues_calidad_total, {_m('customer_complaints')} AS quejas_media,
        CAST(sum(customer_complaints) AS BIGINT) AS quejas_total, {_m('score_performance')} AS score_performance_media,
        count(*) AS total_proveedores FROM done GROUP BY size""",
    "S5_size_ranking": CHAIN
    + "SELECT size AS tipo_empresa, round(avg(score_performance), 6) AS score_performance FROM done GROUP BY size",
    "S6_by_country": CHAIN
    + f"""SELECT country AS pais, {_m('score_riesgo')} AS riesgo_medio, round_even(stddev_samp(score_riesgo), 2) AS riesgo_std,
        {_m('score_performance')} AS performance_medio, round_even({exact_mean('credit')}, 2) AS credito_promedio,
        round_even({exact_sum('credit')}, 2) AS credito_total, count(*) FILTER (category = 'Alto') AS proveedores_alto_riesgo,
        count(*) AS total_proveedores, round_even(count(*) FILTER (category = 'Alto') * 100.0 / count(*), 1) AS pct_alto_riesgo
      FROM done GROUP BY country""",
    "S6_country_ranking": CHAIN
    + "SELECT country AS pais, round(avg(score_riesgo), 6) AS score_riesgo FROM done GROUP BY country",
    "S7_by_certificate_count": CHAIN
    + f"""SELECT num_certificaciones, {_m('score_performance')} AS performance_medio, {_m('on_time_delivery')} AS entrega_puntual_media,
        {_m('score_riesgo')} AS riesgo_medio, count(*) AS total_proveedores FROM done GROUP BY 1""",
    "S8_by_certificate": CHAIN
    + f"""SELECT certificacion, {_m('score_performance')} AS performance, {_m('score_riesgo')} AS riesgo, count(*) AS frecuencia
      FROM (SELECT unnest(certs) AS certificacion, score_performance, score_riesgo FROM done) WHERE certificacion <> 'None' GROUP BY 1""",
    "S9_approval_matrix": CHAIN
    + f"""SELECT p.*, num_proveedores, performance_promedio, credito_actual_promedio FROM {_policy} LEFT JOIN
      (SELECT segmento_riesgo AS segmento, count(*) AS num_proveedores, {_m('score_performance')} AS performance_promedio,
        round_even({exact_mean('credit')}, 2) AS credito_actual_promedio FROM done GROUP BY 1) USING (segmento)""",
    "S10_credit_recommendations": CHAIN + "SELECT * FROM credit",
    "S11_segment_distribution": CHAIN
    + f"""SELECT segmento, count(supplier) AS proveedores, round(count(supplier) * 100.0 / (SELECT count(*) FROM done), 6) AS pct
      FROM {_segments} LEFT JOIN done ON segmento = segmento_riesgo GROUP BY segmento""",
    "S12_segment_by_size": CHAIN
    + f"""SELECT segmento_riesgo AS segmento, {_sizes}, count(*) AS "All" FROM done GROUP BY segmento_riesgo
      UNION ALL SELECT 'All', {_sizes}, count(*) FROM done""",
    "S13_top_per_segment": CHAIN
    + """SELECT segmento_riesgo, CAST(puesto AS INTEGER) AS puesto, supplier, name, size, country, round(score_performance, 6) AS score_performance
      FROM (SELECT *, row_number() OVER (PARTITION BY segmento_riesgo ORDER BY score_performance DESC, supplier) AS puesto FROM done) WHERE puesto <= 3""",
    "S14_risk_by_size": CHAIN
    + f"""SELECT size AS tipo_empresa, {_m('score_riesgo')} AS riesgo_medio, round_even(stddev_samp(score_riesgo), 2) AS riesgo_std,
        round_even(min(score_riesgo), 2) AS riesgo_min, round_even(max(score_riesgo), 2) AS riesgo_max, {_m('score_performance')} AS performance_medio
      FROM done GROUP BY size""",
    "S14_risk_by_country": CHAIN
    + f"SELECT country AS pais, {_m('score_riesgo')} AS riesgo_medio, {_m('score_performance')} AS performance_medio, count(*) AS num_proveedores FROM done GROUP BY country",
    "S15_declared_against_score": CHAIN
    + f"""SELECT category AS categoria, {_m('score_riesgo')} AS score_medio, round_even(min(score_riesgo), 2) AS score_min,
        round_even(max(score_riesgo), 2) AS score_max, count(*) AS cantidad FROM done GROUP BY category""",
    "S16_misclassified": CHAIN
    + """SELECT count(*) FILTER (category = 'Alto' AND nivel_performance IN ('Bueno', 'Excelente')) AS alto_con_buen_performance,
        count(*) FILTER (category = 'Bajo' AND nivel_performance IN ('Crítico', 'Regular')) AS bajo_con_mal_performance FROM done""",
    "S17_action_distribution": CHAIN
    + "SELECT accion_credito, count(*) AS proveedores, round(count(*) * 100.0 / (SELECT count(*) FROM credit), 6) AS pct FROM credit GROUP BY accion_credito",
    "S18_top_increases": CHAIN
    + "SELECT * FROM credit WHERE accion_credito = 'Aumentar' ORDER BY variacion_credito DESC, supplier LIMIT 10",
    "S18_top_decreases": CHAIN
    + "SELECT * FROM credit WHERE accion_credito = 'Reducir' ORDER BY variacion_credito, supplier LIMIT 10",
    "S19_portfolio": CHAIN
    + f"""SELECT {exact_sum('credit.credit')} AS credito_actual, {exact_sum('limite_recomendado')} AS credito_recomendado,
        round({exact_sum('limite_recomendado')} - {exact_sum('credit.credit')}, 6) AS diferencia FROM credit""",
    "S20_headline": CHAIN
    + f"""SELECT count(*) AS total_proveedores, count(*) FILTER (segmento_riesgo = 'Alto_Riesgo') AS alto_riesgo,
        count(*) FILTER (segmento_riesgo = 'Premium') AS premium, round(avg(score_performance), 6) AS performance_promedio,
        {exact_sum('credit')} AS credito_total FROM done""",
    "S20_level_counts": CHAIN
    + "SELECT nivel_performance, count(*) AS proveedores FROM done WHERE nivel_performance IS NOT NULL GROUP BY 1",
    "S20_performance_by_size": CHAIN
    + f"SELECT size AS tipo_empresa, {_m('score_performance')} AS performance_promedio, count(*) AS cantidad FROM done GROUP BY size",
    "S20_credit_points": CHAIN
    + "SELECT supplier, credit.credit AS credit, limite_recomendado, accion_credito, segmento_riesgo FROM credit",
    "S20_risk_points": CHAIN
    + "SELECT supplier, round(score_performance, 6) AS score_performance, round(score_riesgo, 6) AS score_riesgo, segmento_riesgo, size, num_certificaciones FROM done",
    "S21_suppliers_end_to_end": CHAIN
    + """SELECT supplier, round(score_performance, 6) AS score_performance, nivel_performance, round(score_riesgo, 6) AS score_riesgo,
        segmento_riesgo, num_certificaciones FROM done""",
}
