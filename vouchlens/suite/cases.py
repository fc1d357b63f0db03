"""Queries on exception cases (X)."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from vouchlens.operators import cases as op
from vouchlens.roles import CaseRoles
from vouchlens.sources.role_views import cases
from vouchlens.suite.sql import AS_OF, exact_mean, exact_sum

R = CaseRoles(
    type="type", complexity="complexity", date="date", amount="amount", state="state",
    assignee="assignee",
)
DAY = date.fromisoformat(AS_OF)
NOW = datetime.fromisoformat(AS_OF)


def _prepared(s, d):
    return op.prepare(cases(s, d), R, DAY)


def _classified(s, d):
    return op.classify(cases(s, d), R, DAY)


def _flow(s, d):
    return op.workflow(_prepared(s, d), R, NOW)


def _texts(df, *columns):
    """Dates and times as text, so that both engines print them alike."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


LIMITS = op.PatternLimits(crowded=1.0, open_share=0.25, large_from=0.9, large_share=0.05)

QUERIES = {
    "IO4_prepared_cases": lambda s, d: _texts(_prepared(s, d), "date"),
    "X1_priority": lambda s, d: _rounded(
        op.with_priority(_prepared(s, d), R).select("case_id", "score_prioridad"),
        "score_prioridad",
    ),
    "X2_urgency": lambda s, d: op.with_urgency(op.with_priority(_prepared(s, d), R)).select(
        "case_id", "nivel_urgencia"
    ),
    "X3_segment": lambda s, d: op.with_segment(_prepared(s, d), R).select(
        "case_id", "segmento_riesgo"
    ),
    "X4_classification_counts": lambda s, d: op.classification_counts(_classified(s, d), R),
    "X4_classification_totals": lambda s, d: op.classification_totals(_classified(s, d), R),
    "X5_classified_cases": lambda s, d: _rounded(
        op.sorted_cases(_classified(s, d), R).select(
            "case_id", "score_prioridad", "nivel_urgencia", "segmento_riesgo"
        ),
        "score_prioridad",
    ),
    "X6_escalation_matrix": lambda s, d: op.matrix_usage(_prepared(s, d), R),
    "X7_route": lambda s, d: op.with_route(_prepared(s, d), R).select("case_id", "ruta_escalacion"),
    "X8_sla": lambda s, d: _texts(
        op.with_route(_prepared(s, d), R).select("case_id", "sla_dias", "sla_vencimiento"),
        "sla_vencimiento",
    ),
    "X9_sla_state": lambda s, d: _flow(s, d).select("case_id", "estado_sla"),
    "X10_workflow": lambda s, d: _texts(
        op.workflow_table(_prepared(s, d), R, NOW), "date", "sla_vencimiento"
    ),
    "X11_workflow_metrics": lambda s, d: _rounded(
        op.workflow_metrics(_flow(s, d)), "tasa_cumplimiento", "sla_promedio"
    ),
    "X11_route_counts": lambda s, d: op.route_counts(_flow(s, d)),
    "X12_critical_cases": lambda s, d: op.critical_cases(_classified(s, d), R).select(
        "case_id", "razon_critico"
    ),
    "X13_sla_at_risk": lambda s, d: op.sla_at_risk(_flow(s, d)).select("case_id", "estado_sla"),
    "X14_assignee_load": lambda s, d: op.assignee_load(_prepared(s, d), R),
    "X15_assignee_alerts": lambda s, d: op.assignee_alerts(op.assignee_load(_prepared(s, d), R)),
    "X16_pattern_alerts": lambda s, d: op.pattern_alerts(_prepared(s, d), R),
    # limits at which every rule fires on these rows
    "X16_pattern_alerts_all_rules": lambda s, d: op.pattern_alerts(_prepared(s, d), R, LIMITS),
    "X17_alert_report": lambda s, d: op.alert_report(_classified(s, d), R),
    "X18_overview_totals": lambda s, d: op.overview_totals(_classified(s, d), R),
    "X18_overview_counts": lambda s, d: op.overview_counts(_classified(s, d), R),
    "X19_type_trends": lambda s, d: _rounded(
        op.type_trends(_prepared(s, d), R), "porcentaje", "tasa_resolucion"
    ),
    "X20_assignee_report": lambda s, d: _rounded(
        op.assignee_report(_prepared(s, d), R), "tasa_resolucion", "score_eficiencia"
    ),
    "X21_cases_end_to_end": lambda s, d: _rounded(
        _texts(op.workflow(_classified(s, d), R, NOW), "date", "sla_vencimiento"), "score_prioridad"
    ),
}

_sla = "CASE type " + " ".join(
    f"WHEN '{k}' THEN CASE complexity WHEN 'Bajo' THEN {v[0]} WHEN 'Medio' THEN {v[1]} WHEN 'Alto' THEN {v[2]} END"
    for k, v in op.SLA_DAYS.items()
) + " END"

CHAIN = f"""WITH cases AS (
  SELECT o_orderkey AS case_id,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'Proveedor VIP' WHEN '2' THEN 'Pago Urgente'
      WHEN '3' THEN 'Ajuste Contable' WHEN '4' THEN 'Excepción Regulatoria' ELSE 'Otro' END AS type,
    CASE o_custkey % 3 WHEN 0 THEN 'Bajo' WHEN 1 THEN 'Medio' ELSE 'Alto' END AS complexity,
    CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS date,
    o_totalprice / 10 AS amount,
    CASE o_orderstatus WHEN 'O' THEN 'Abierto' WHEN 'P' THEN 'En Proceso' ELSE 'Cerrado' END AS state,
    'R' || CAST(o_custkey % 7 AS VARCHAR) AS assignee,
    CAST(datediff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') AS INTEGER) AS dias_antiguedad
  FROM orders),
tops AS (SELECT max(amount) AS ma, max(dias_antiguedad) AS mg, quantile_cont(amount, 0.75) AS p75,
  quantile_cont(amount, 0.5) AS p50, quantile_cont(amount, 0.95) AS p95 FROM cases),
scored AS (SELECT cases.*, p75, p50, p95, (CASE complexity WHEN 'Bajo' THEN 1 WHEN 'Medio' THEN 2 ELSE 3 END * CAST(0.4 AS DOUBLE)
    + CASE WHEN ma > 0 THEN amount / ma * 3 ELSE 0 END * CAST(0.3 AS DOUBLE)
    + CASE WHEN mg > 0 THEN dias_antiguedad / mg * 3 ELSE 0 END * CAST(0.2 AS DOUBLE)
    + CASE state WHEN 'Abierto' THEN 3 WHEN 'En Proceso' THEN 2 ELSE 1 END * CAST(0.1 AS DOUBLE)) / 3 * 100 AS priority
  FROM cases, tops),
classified AS (SELECT *, CASE WHEN priority >= 75 THEN 'Crítico' WHEN priority >= 55 THEN 'Alto'
    WHEN priority >= 35 THEN 'Medio' ELSE 'Bajo' END AS nivel_urgencia,
  CASE WHEN complexity = 'Alto' AND amount >= p75 AND state = 'Abierto' THEN 'Riesgo Crítico'
    WHEN complexity = 'Alto' OR amount >= p75 THEN 'Riesgo Alto'
    WHEN complexity = 'Medio' OR amount >= p50 THEN 'Riesgo Medio' ELSE 'Riesgo Bajo' END AS segmento_riesgo FROM scored),
routed AS (SELECT *, CASE complexity
    WHEN 'Alto' THEN 'Operativo → Supervisor → Gerencia'
    WHEN 'Medio' THEN CASE WHEN amount >= 40000 THEN 'Operativo → Supervisor → Gerencia' ELSE 'Operativo → Supervisor' END
    ELSE CASE WHEN amount >= 40000 THEN 'Operativo → Gerencia' WHEN amount >= 25000 THEN 'Operativo → Supervisor' ELSE 'Operativo' END
    END AS ruta_escalacion, CAST(coalesce({_sla}, 3.0) AS DOUBLE) AS sla_dias FROM classified),
due AS (SELECT *, CAST(day AS TIMESTAMP) + to_seconds(CAST(sla_dias * 86400 AS BIGINT)) AS due_at FROM routed),
flow AS (SELECT *, strftime(due_at, '%Y-%m-%d %H:%M:%S') AS sla_vencimiento, CASE WHEN state = 'Cerrado' THEN 'Cumplido'
    WHEN due_at < TIMESTAMP '{AS_OF}' THEN 'Vencido'
    WHEN due_at - TIMESTAMP '{AS_OF}' < INTERVAL 2 DAY THEN 'Por Vencer' ELSE 'En Tiempo' END AS estado_sla FROM due),
load AS (SELECT assignee AS responsable, count(*) AS total_casos, count(*) FILTER (state = 'Abierto') AS casos_abiertos,
    count(*) FILTER (state = 'En Proceso') AS casos_en_proceso, count(*) FILTER (state = 'Cerrado') AS casos_cerrados,
    count(*) FILTER (complexity = 'Alto') AS alta_complejidad, {exact_sum('amount')} AS monto_total,
    avg(dias_antiguedad) AS promedio_antiguedad FROM cases GROUP BY assignee),
bounds AS (SELECT avg(total_casos) * 1.5 AS bt, avg(casos_abiertos) * 1.5 AS bo FROM load),
critical AS (SELECT * FROM classified WHERE (complexity = 'Alto' AND amount >= p75 AND state = 'Abierto') OR priority >= 80),
alerts AS (
  SELECT responsable, 'SOBRECARGA' AS tipo, 'Alta' AS severidad,
    responsable || ' tiene ' || total_casos || ' casos asignados (umbral: ' || format('{{:.0f}}', bt) || ')' AS mensaje,
    'Redistribuir casos a otros responsables' AS accion_sugerida FROM load, bounds WHERE total_casos > bt
  UNION ALL SELECT responsable, 'ACUMULACIÓN', 'Media', responsable || ' tiene ' || casos_abiertos || ' casos abiertos sin procesar',
    'Priorizar cierre de casos pendientes' FROM load, bounds WHERE casos_abiertos > bo
  UNION ALL SELECT responsable, 'CONCENTRACIÓN_RIESGO', 'Alta', responsable || ' tiene ' || alta_complejidad || ' casos de alta complejidad',
    'Escalar casos complejos o asignar apoyo' FROM load WHERE alta_complejidad > 5)"""


def _patterns(limits=op.PatternLimits(), top="p95"):
    return f""", kinds AS (SELECT type AS kind, count(*) AS n FROM cases GROUP BY 1),
mean AS (SELECT avg(n) AS m FROM kinds),
sums AS (SELECT count(*) AS n, count(*) FILTER (state = 'Abierto') / count(*) AS ratio, count(*) FILTER (amount >= {top}) AS large,
  max({top}) AS top FROM scored, (SELECT quantile_cont(amount, {limits.large_from}) AS pq FROM cases)),
patterns AS (
  SELECT 'CONCENTRACIÓN_TIPO' AS tipo, 'Alto volumen de casos ''' || kind || ''': ' || n || ' casos' AS descripcion,
    format('{{:.0f}}', m) || ' casos promedio' AS valor_normal, 'Revisar proceso fuente de este tipo de caso' AS recomendacion
  FROM kinds, mean WHERE n > m * {limits.crowded}
  UNION ALL SELECT 'ACUMULACIÓN_ABIERTOS', 'El ' || format('{{:.1f}}', ratio * 100) || '% de casos están abiertos',
    'Menos del {limits.open_share * 100:.0f}% abiertos', 'Aumentar capacidad de procesamiento' FROM sums WHERE ratio > {limits.open_share}
  UNION ALL SELECT 'CONCENTRACIÓN_MONTO', large || ' casos con monto >= $' || format('{{:,.2f}}', top),
    'Máximo {(1 - limits.large_from) * 100:.0f}% de casos con montos muy altos', 'Revisar umbrales de escalación'
  FROM sums WHERE large > n * {limits.large_share}) """


def _counts(pairs):
    return " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {c} AS value, count(*) AS cases FROM classified GROUP BY {c}"
        for d, c in pairs.items()
    )


_case = "case_id, type, complexity, date, amount, state, assignee, dias_antiguedad"
SQL = {
    "IO4_prepared_cases": CHAIN + f"SELECT {_case} FROM cases",
    "X1_priority": CHAIN + "SELECT case_id, round(priority, 6) AS score_prioridad FROM scored",
    "X2_urgency": CHAIN + "SELECT case_id, nivel_urgencia FROM classified",
    "X3_segment": CHAIN + "SELECT case_id, segmento_riesgo FROM classified",
    "X4_classification_counts": CHAIN
    + _counts(
        {
            "tipo_caso": "type",
            "complejidad": "complexity",
            "estado": "state",
            "urgencia": "nivel_urgencia",
            "segmento": "segmento_riesgo",
        }
    ),
    "X4_classification_totals": CHAIN
    + f"""SELECT count(*) AS total_casos, {exact_sum('amount')} AS monto_total, {exact_mean('amount')} AS monto_promedio,
        count(*) FILTER (nivel_urgencia = 'Crítico') AS casos_criticos FROM classified""",
    "X5_classified_cases": CHAIN
    + "SELECT case_id, round(priority, 6) AS score_prioridad, nivel_urgencia, segmento_riesgo FROM classified",
    "X6_escalation_matrix": CHAIN
    + ", matrix AS (SELECT * FROM (VALUES "
    + ", ".join(
        f"('{k}', '{lv}', CAST({v} AS DOUBLE), CAST({v * 24} AS DOUBLE), 'Sí', '{'Sí' if lv != 'Bajo' else 'No'}', "
        f"'{'Sí' if lv == 'Alto' else 'No'}', {i + 1})"
        for k, days in op.SLA_DAYS.items()
        for i, (lv, v) in enumerate(zip(op.LEVELS, days))
    )
    + """) t(tipo_caso, complejidad, sla_dias, sla_horas, nivel_1_operativo, nivel_2_supervisor, nivel_3_gerencia, aprobadores_requeridos))
      SELECT matrix.*, (SELECT count(*) FROM cases WHERE type = tipo_caso AND complexity = complejidad) AS casos FROM matrix""",
    "X7_route": CHAIN + "SELECT case_id, ruta_escalacion FROM routed",
    "X8_sla": CHAIN + "SELECT case_id, sla_dias, sla_vencimiento FROM flow",
    "X9_sla_state": CHAIN + "SELECT case_id, estado_sla FROM flow",
    "X10_workflow": CHAIN
    + """SELECT type, complexity, amount, state, assignee, ruta_escalacion, sla_dias, estado_sla, date, sla_vencimiento FROM flow""",
    "X11_workflow_metrics": CHAIN
    + """SELECT count(*) AS total_casos, count(*) FILTER (estado_sla = 'Vencido') AS casos_vencidos,
        count(*) FILTER (estado_sla = 'Por Vencer') AS casos_por_vencer, count(*) FILTER (estado_sla = 'En Tiempo') AS casos_en_tiempo,
        round(count(*) FILTER (estado_sla = 'Cumplido') * 100.0 / count(*), 6) AS tasa_cumplimiento,
        round(avg(sla_dias), 6) AS sla_promedio FROM flow""",
    "X11_route_counts": CHAIN + "SELECT ruta_escalacion, count(*) AS casos FROM flow GROUP BY ruta_escalacion",
    "X12_critical_cases": CHAIN
    + f"SELECT case_id, '{op.CRITICAL_REASON}' AS razon_critico FROM critical",
    "X13_sla_at_risk": CHAIN
    + "SELECT case_id, estado_sla FROM flow WHERE estado_sla IN ('Vencido', 'Por Vencer')",
    "X14_assignee_load": CHAIN
    + "SELECT *, casos_abiertos * 3 + casos_en_proceso * 2 + alta_complejidad * 2 AS indice_carga FROM load",
    "X15_assignee_alerts": CHAIN + "SELECT * FROM alerts",
    "X16_pattern_alerts": CHAIN + _patterns() + "SELECT * FROM patterns",
    "X16_pattern_alerts_all_rules": CHAIN + _patterns(LIMITS, "pq") + "SELECT * FROM patterns",
    "X17_alert_report": CHAIN
    + _patterns()
    + """SELECT 'total_casos_criticos' AS item, count(*) AS total FROM critical
      UNION ALL SELECT 'total_alertas', count(*) FROM alerts UNION ALL SELECT 'total_anomalias', count(*) FROM patterns""",
    "X18_overview_totals": CHAIN
    + f"""SELECT count(*) AS total_casos, {exact_sum('amount')} AS monto_total, {exact_mean('amount')} AS monto_promedio,
        max(amount) AS monto_maximo FROM cases""",
    "X18_overview_counts": CHAIN
    + _counts(
        {
            "por_estado": "state",
            "por_complejidad": "complexity",
            "por_tipo_caso": "type",
            "por_responsable": "assignee",
            "por_urgencia": "nivel_urgencia",
            "por_segmento_riesgo": "segmento_riesgo",
        }
    ),
    "X19_type_trends": CHAIN
    + f"""SELECT type AS tipo_caso, count(*) AS total_casos, {exact_sum('amount')} AS monto_total, {exact_mean('amount')} AS monto_promedio,
        count(*) FILTER (state = 'Abierto') AS casos_abiertos, count(*) FILTER (complexity = 'Alto') AS casos_alta_complejidad,
        round(count(*) * 100.0 / (SELECT count(*) FROM cases), 6) AS porcentaje,
        round(count(*) FILTER (state = 'Cerrado') * 100.0 / count(*), 6) AS tasa_resolucion FROM cases GROUP BY type""",
    "X20_assignee_report": CHAIN
    + f"""SELECT assignee AS responsable, count(*) AS total_casos, count(*) FILTER (state = 'Abierto') AS casos_abiertos,
        count(*) FILTER (state = 'En Proceso') AS casos_en_proceso, count(*) FILTER (state = 'Cerrado') AS casos_cerrados,
        {exact_sum('amount')} AS monto_gestionado, count(*) FILTER (complexity = 'Alto') AS complejidad_alta,
        count(*) FILTER (complexity = 'Medio') AS complejidad_media, count(*) FILTER (complexity = 'Bajo') AS complejidad_baja,
        round(count(*) FILTER (state = 'Cerrado') * 100.0 / count(*), 6) AS tasa_resolucion,
        round(count(*) FILTER (state = 'Cerrado') * 100.0 / count(*) * 0.5 + (1 - count(*) FILTER (complexity = 'Alto') / count(*)) * 30
          + count(*) FILTER (state = 'Cerrado') / count(*) * 20, 6) AS score_eficiencia FROM cases GROUP BY assignee""",
    "X21_cases_end_to_end": CHAIN
    + f"""SELECT {_case}, round(priority, 6) AS score_prioridad, nivel_urgencia, segmento_riesgo, ruta_escalacion, sla_dias,
        sla_vencimiento, estado_sla FROM flow""",
}
