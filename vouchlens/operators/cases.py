"""Exception cases: priority, urgency, segment, escalation, SLA, workload and alerts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchlens.functions.columns import (
    fixed,
    flag,
    lookup_value,
    money_mean,
    money_sum,
    present,
    share,
    text,
)
from vouchlens.plans.counts import value_counts
from vouchlens.plans.quantiles import quantile_values
from vouchlens.roles import CaseRoles

# Scales, weights, bounds, SLA days, approval levels and texts.
COMPLEXITY_SCORE = {"Bajo": 1, "Medio": 2, "Alto": 3}
STATE_SCORE = {"Abierto": 3, "En Proceso": 2, "Cerrado": 1}
SLA_DAYS = {  # type: (Bajo, Medio, Alto)
    "Proveedor VIP": (2.0, 1.0, 0.5),
    "Pago Urgente": (1.0, 0.5, 0.25),
    "Ajuste Contable": (5.0, 3.0, 2.0),
    "Excepción Regulatoria": (3.0, 2.0, 1.0),
    "Aprobación Manual": (3.0, 2.0, 1.0),
    "Caso de Fuerza Mayor": (2.0, 1.0, 0.5),
    "Transacción con Disputa": (7.0, 5.0, 3.0),
    "Transacción Internacional Compleja": (5.0, 3.0, 2.0),
}
DEFAULT_SLA_DAYS = 3.0
LEVELS = ["Bajo", "Medio", "Alto"]
APPROVAL_LEVELS = {
    "Bajo": ["Operativo"],
    "Medio": ["Operativo", "Supervisor"],
    "Alto": ["Operativo", "Supervisor", "Gerencia"],
}
SUPERVISOR_AMOUNT = 25000
MANAGER_AMOUNT = 40000
CRITICAL_PRIORITY = 80
CRITICAL_REASON = "Alta complejidad + Alto monto + Abierto"


def prepare(df: DataFrame, r: CaseRoles, as_of: date) -> DataFrame:
    """Parsed date, trimmed texts and the age in days."""
    return df.withColumns(
        {
            r.date: F.to_date(r.date),
            **{c: F.trim(c) for c in (r.type, r.complexity, r.state, r.assignee)},
        }
    ).withColumn("dias_antiguedad", F.datediff(F.lit(as_of), F.col(r.date)))


def with_priority(df: DataFrame, r: CaseRoles) -> DataFrame:
    tops = df.agg(
        F.struct(F.max(r.amount).alias("amount"), F.max("dias_antiguedad").alias("age"))
    ).scalar()

    def scaled(value: str, top: Column) -> Column:
        return F.when(top > 0, F.col(value) / top * 3).otherwise(F.lit(0.0))

    score = (
        lookup_value(F.col(r.complexity), COMPLEXITY_SCORE) * 0.40
        + scaled(r.amount, F.col("_t.amount")) * 0.30
        + scaled("dias_antiguedad", F.col("_t.age")) * 0.20
        + lookup_value(F.col(r.state), STATE_SCORE) * 0.10
    )
    return (
        df.withColumn("_t", tops).withColumn("score_prioridad", score / 3 * 100).drop("_t")
    )


def with_urgency(df: DataFrame) -> DataFrame:
    p = F.col("score_prioridad")
    return df.withColumn(
        "nivel_urgencia",
        F.when(p >= 75, "Crítico").when(p >= 55, "Alto").when(p >= 35, "Medio").otherwise("Bajo"),
    )


def with_segment(df: DataFrame, r: CaseRoles) -> DataFrame:
    edges = quantile_values(df, r.amount, {"high": 0.75, "mid": 0.5})
    complexity, amount = F.col(r.complexity), F.col(r.amount)
    high = flag(complexity == r.high)
    large = flag(amount >= F.col("_q.high"))
    return (
        df.withColumn("_q", edges)
        .withColumn(
            "segmento_riesgo",
            F.when(high & large & flag(F.col(r.state) == r.open), "Riesgo Crítico")
            .when(high | large, "Riesgo Alto")
            .when(flag(complexity == r.medium) | flag(amount >= F.col("_q.mid")), "Riesgo Medio")
            .otherwise("Riesgo Bajo"),
        )
        .drop("_q")
    )


def classify(df: DataFrame, r: CaseRoles, as_of: date) -> DataFrame:
    """Prepared, scored, rated and segmented cases."""
    scored = with_priority(prepare(df, r, as_of), r)
    return with_segment(with_urgency(scored), r)


def sorted_cases(classified: DataFrame, r: CaseRoles) -> DataFrame:
    return classified.orderBy(F.desc("score_prioridad"), *r.ties)


def classification_counts(classified: DataFrame, r: CaseRoles) -> DataFrame:
    return value_counts(
        classified,
        {
            "tipo_caso": r.type,
            "complejidad": r.complexity,
            "estado": r.state,
            "urgencia": "nivel_urgencia",
            "segmento": "segmento_riesgo",
        },
    )


def classification_totals(classified: DataFrame, r: CaseRoles) -> DataFrame:
    return classified.agg(
        F.count(F.lit(1)).alias("total_casos"),
        money_sum(F.col(r.amount)).alias("monto_total"),
        money_mean(F.col(r.amount)).alias("monto_promedio"),
        F.count_if(F.col("nivel_urgencia") == "Crítico").alias("casos_criticos"),
    )


# --- escalation and SLA -----------------------------------------------------


def sla_days(r: CaseRoles) -> Column:
    """Days by type and complexity, as one expression over the fixed table."""
    chain = None
    for kind, days in SLA_DAYS.items():
        per_level = lookup_value(F.col(r.complexity), dict(zip(LEVELS, days, strict=True)))
        hit = F.col(r.type) == kind
        chain = F.when(hit, per_level) if chain is None else chain.when(hit, per_level)
    return F.coalesce(chain, F.lit(DEFAULT_SLA_DAYS))


def escalation_matrix(spark) -> DataFrame:
    """Types by levels: what each cell allows follows from the fixed tables by column expressions."""
    days = F.create_map(*[x for kind, d in SLA_DAYS.items() for x in (F.lit(kind), F.array(*map(F.lit, d)))])
    types = spark.range(1).select(F.explode(days).alias("tipo_caso", "_days"))
    cells = types.select("tipo_caso", "_days", F.posexplode(F.array(*map(F.lit, LEVELS))).alias("_at", "complejidad"))
    needed = lookup_value(F.col("complejidad"), {k: ",".join(v) for k, v in APPROVAL_LEVELS.items()})
    approvers = F.split(needed, ",")

    def asked(level: str) -> Column:
        return F.when(F.array_contains(approvers, level), "Sí").otherwise("No")

    return cells.select(
        "tipo_caso",
        "complejidad",
        F.get("_days", "_at").alias("sla_dias"),
        (F.get("_days", "_at") * 24).alias("sla_horas"),
        F.lit("Sí").alias("nivel_1_operativo"),
        asked("Supervisor").alias("nivel_2_supervisor"),
        asked("Gerencia").alias("nivel_3_gerencia"),
        F.size(approvers).alias("aprobadores_requeridos"),
    )


def matrix_usage(classified: DataFrame, r: CaseRoles) -> DataFrame:
    """The escalation matrix with the number of cases in each cell."""
    matrix = escalation_matrix(classified.sparkSession)
    used = classified.groupBy(
        F.col(r.type).alias("tipo_caso"), F.col(r.complexity).alias("complejidad")
    ).agg(F.count(F.lit(1)).alias("casos"))
    return matrix.join(used, ["tipo_caso", "complejidad"], "left").withColumn(
        "casos", F.coalesce("casos", F.lit(0))
    )


def with_route(df: DataFrame, r: CaseRoles) -> DataFrame:
    """Levels by complexity; a large amount adds one more, the higher one first."""
    amount = F.col(r.amount)
    base = F.coalesce(
        lookup_value(F.col(r.complexity), {k: " → ".join(v) for k, v in APPROVAL_LEVELS.items()}),
        F.lit("Operativo"),
    )
    has_manager = flag(F.col(r.complexity) == r.high)
    has_supervisor = has_manager | flag(F.col(r.complexity) == r.medium)
    extra = (
        F.when((amount >= MANAGER_AMOUNT) & ~has_manager, " → Gerencia")
        .when((amount >= SUPERVISOR_AMOUNT) & ~has_supervisor, " → Supervisor")
        .otherwise("")
    )
    return df.withColumns(
        {"ruta_escalacion": F.concat(base, extra), "sla_dias": sla_days(r)}
    ).withColumn(
        "sla_vencimiento",
        F.to_timestamp(r.date)
        + F.make_dt_interval(secs=(F.col("sla_dias") * 86400).cast("decimal(18,6)")),
    )


def with_sla_state(df: DataFrame, r: CaseRoles, now: datetime) -> DataFrame:
    """Due within less than two days counts as about to expire (whole days floor)."""
    due = F.col("sla_vencimiento")
    return df.withColumn(
        "estado_sla",
        F.when(F.col(r.state) == r.closed, "Cumplido")
        .when(due < F.lit(now), "Vencido")
        .when(due < F.lit(now + timedelta(days=2)), "Por Vencer")
        .otherwise("En Tiempo"),
    )


def workflow(df: DataFrame, r: CaseRoles, now: datetime) -> DataFrame:
    return with_sla_state(with_route(df, r), r, now)


def workflow_table(df: DataFrame, r: CaseRoles, now: datetime) -> DataFrame:
    return workflow(df, r, now).select(
        r.type,
        r.complexity,
        r.amount,
        r.state,
        r.assignee,
        "ruta_escalacion",
        "sla_dias",
        "estado_sla",
        r.date,
        "sla_vencimiento",
    )


def workflow_metrics(flow: DataFrame) -> DataFrame:
    def state(name: str) -> Column:
        return F.count_if(F.col("estado_sla") == name)

    total = F.count(F.lit(1))
    return flow.agg(
        total.alias("total_casos"),
        state("Vencido").alias("casos_vencidos"),
        state("Por Vencer").alias("casos_por_vencer"),
        state("En Tiempo").alias("casos_en_tiempo"),
        share(state("Cumplido"), total).alias("tasa_cumplimiento"),
        F.avg("sla_dias").alias("sla_promedio"),
    )


def route_counts(flow: DataFrame) -> DataFrame:
    return flow.groupBy("ruta_escalacion").agg(F.count(F.lit(1)).alias("casos"))


# --- alerts -----------------------------------------------------------------


def critical_cases(classified: DataFrame, r: CaseRoles) -> DataFrame:
    """The reason is a constant, also for cases that qualify by priority alone."""
    edge = quantile_values(classified, r.amount, {"high": 0.75})
    hard = (
        (F.col(r.complexity) == r.high)
        & (F.col(r.amount) >= F.col("_q.high"))
        & (F.col(r.state) == r.open)
    )
    urgent = F.col("score_prioridad") >= CRITICAL_PRIORITY
    return (
        classified.withColumn("_q", edge)
        .where(flag(hard) | flag(urgent))
        .drop("_q")
        .withColumn("razon_critico", F.lit(CRITICAL_REASON))
    )


def sla_at_risk(df: DataFrame) -> DataFrame:
    """Overdue or nearly so; nothing when the SLA state is not known yet."""
    if "estado_sla" not in df.columns:
        return df.limit(0)
    return df.where(F.col("estado_sla").isin("Vencido", "Por Vencer"))


def _states(r: CaseRoles) -> dict[str, Column]:
    def state(name: str) -> Column:
        return F.count_if(F.col(r.state) == name)

    return {
        "total_casos": F.count(F.lit(1)),
        "casos_abiertos": state(r.open),
        "casos_en_proceso": state(r.in_process),
        "casos_cerrados": state(r.closed),
    }


def assignee_load(prepared: DataFrame, r: CaseRoles) -> DataFrame:
    load = (
        prepared.where(F.col(r.assignee).isNotNull())
        .groupBy(F.col(r.assignee).alias("responsable"))
        .agg(
            *[c.alias(n) for n, c in _states(r).items()],
            F.count_if(F.col(r.complexity) == r.high).alias("alta_complejidad"),
            money_sum(F.col(r.amount)).alias("monto_total"),
            F.avg("dias_antiguedad").alias("promedio_antiguedad"),
        )
    )
    index = (
        F.col("casos_abiertos") * 3
        + F.col("casos_en_proceso") * 2
        + F.col("alta_complejidad") * 2
    )
    return load.withColumn("indice_carga", index)


def assignee_alerts(load: DataFrame) -> DataFrame:
    """Up to three alerts per assignee; the bounds are means over assignees."""
    means = load.agg(
        F.struct(
            (F.avg("total_casos") * 1.5).alias("total"),
            (F.avg("casos_abiertos") * 1.5).alias("open"),
        )
    ).scalar()
    who = F.col("responsable")

    def alert(kind: str, severity: str, message: Column, action: str) -> Column:
        return F.struct(
            F.lit(kind).alias("tipo"),
            F.lit(severity).alias("severidad"),
            message.alias("mensaje"),
            F.lit(action).alias("accion_sugerida"),
        )

    alerts = present(
        [
            F.when(
                F.col("total_casos") > F.col("_m.total"),
                alert(
                    "SOBRECARGA",
                    "Alta",
                    text(
                        "{} tiene {} casos asignados (umbral: {})",
                        who,
                        F.col("total_casos"),
                        fixed(F.col("_m.total"), 0),
                    ),
                    "Redistribuir casos a otros responsables",
                ),
            ),
            F.when(
                F.col("casos_abiertos") > F.col("_m.open"),
                alert(
                    "ACUMULACIÓN",
                    "Media",
                    text("{} tiene {} casos abiertos sin procesar", who, F.col("casos_abiertos")),
                    "Priorizar cierre de casos pendientes",
                ),
            ),
            F.when(
                F.col("alta_complejidad") > 5,
                alert(
                    "CONCENTRACIÓN_RIESGO",
                    "Alta",
                    text("{} tiene {} casos de alta complejidad", who, F.col("alta_complejidad")),
                    "Escalar casos complejos o asignar apoyo",
                ),
            ),
        ]
    )
    return load.withColumn("_m", means).select("responsable", F.explode(alerts).alias("a")).select(
        "responsable", "a.tipo", "a.severidad", "a.mensaje", "a.accion_sugerida"
    )


@dataclass(frozen=True)
class PatternLimits:
    """When a pattern is an alert: cases of a type over the mean, share of open cases, share from a quantile of amounts on."""

    crowded: float = 2.0
    open_share: float = 0.4
    large_from: float = 0.95
    large_share: float = 0.1


def pattern_alerts(df: DataFrame, r: CaseRoles, limits: PatternLimits | None = None) -> DataFrame:
    """Crowded case types, a high share of open cases, many very large amounts."""
    limits = limits or PatternLimits()
    per_type = (
        df.where(F.col(r.type).isNotNull())
        .groupBy(F.col(r.type).alias("_type"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    mean = per_type.agg(F.avg("_n").alias("m")).scalar()
    names = ["tipo", "descripcion", "valor_normal", "recomendacion"]
    crowded = (
        per_type.withColumn("_m", mean)
        .where(F.col("_n") > F.col("_m") * limits.crowded)
        .select(
            F.lit("CONCENTRACIÓN_TIPO").alias("tipo"),
            text("Alto volumen de casos '{}': {} casos", F.col("_type"), F.col("_n")).alias(
                "descripcion"
            ),
            text("{} casos promedio", fixed(F.col("_m"), 0)).alias("valor_normal"),
            F.lit("Revisar proceso fuente de este tipo de caso").alias("recomendacion"),
        )
    )
    edge = quantile_values(df, r.amount, {"top": limits.large_from})
    marked = df.withColumn("_top", edge.getField("top"))
    figures = marked.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(r.state) == r.open).alias("open"),
        F.count_if(F.col(r.amount) >= F.col("_top")).alias("large"),
        F.max("_top").alias("top"),
    ).withColumn("ratio", F.try_divide("open", "n"))

    def row(*values: Column) -> Column:
        return F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])

    found = present(
        [
            F.when(
                F.col("ratio") > limits.open_share,
                row(
                    F.lit("ACUMULACIÓN_ABIERTOS"),
                    text("El {}% de casos están abiertos", fixed(F.col("ratio") * 100, 1)),
                    F.lit(f"Menos del {limits.open_share * 100:.0f}% abiertos"),
                    F.lit("Aumentar capacidad de procesamiento"),
                ),
            ),
            F.when(
                F.col("large") > F.col("n") * limits.large_share,
                row(
                    F.lit("CONCENTRACIÓN_MONTO"),
                    text(
                        "{} casos con monto >= ${}", F.col("large"), F.format_number("top", 2)
                    ),
                    F.lit(f"Máximo {(1 - limits.large_from) * 100:.0f}% de casos con montos muy altos"),
                    F.lit("Revisar umbrales de escalación"),
                ),
            ),
        ]
    )
    overall = figures.select(F.explode(found).alias("x")).select(*[f"x.{n}" for n in names])
    return crowded.unionByName(overall)


def alert_report(classified: DataFrame, r: CaseRoles) -> DataFrame:
    """Number of critical cases, assignee alerts and patterns."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("item"), "total")

    load = assignee_load(classified, r)
    return (
        counted(critical_cases(classified, r), "total_casos_criticos")
        .unionByName(counted(assignee_alerts(load), "total_alertas"))
        .unionByName(counted(pattern_alerts(classified, r), "total_anomalias"))
    )


# --- reports ----------------------------------------------------------------


def overview_totals(df: DataFrame, r: CaseRoles) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_casos"),
        money_sum(F.col(r.amount)).alias("monto_total"),
        money_mean(F.col(r.amount)).alias("monto_promedio"),
        F.max(r.amount).alias("monto_maximo"),
    )


def overview_counts(classified: DataFrame, r: CaseRoles) -> DataFrame:
    return value_counts(
        classified,
        {
            "por_estado": r.state,
            "por_complejidad": r.complexity,
            "por_tipo_caso": r.type,
            "por_responsable": r.assignee,
            "por_urgencia": "nivel_urgencia",
            "por_segmento_riesgo": "segmento_riesgo",
        },
    )


def type_trends(df: DataFrame, r: CaseRoles) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    amount = F.col(r.amount)
    trend = (
        df.where(F.col(r.type).isNotNull())
        .groupBy(F.col(r.type).alias("tipo_caso"))
        .agg(
            F.count(F.lit(1)).alias("total_casos"),
            money_sum(amount).alias("monto_total"),
            money_mean(amount).alias("monto_promedio"),
            F.count_if(F.col(r.state) == r.open).alias("casos_abiertos"),
            F.count_if(F.col(r.complexity) == r.high).alias("casos_alta_complejidad"),
            F.count_if(F.col(r.state) == r.closed).alias("_closed"),
        )
    )
    return (
        trend.withColumn("porcentaje", share(F.col("total_casos"), total))
        .withColumn("tasa_resolucion", share(F.col("_closed"), F.col("total_casos")))
        .drop("_closed")
    )


def assignee_report(df: DataFrame, r: CaseRoles) -> DataFrame:
    def level(name: str) -> Column:
        return F.count_if(F.col(r.complexity) == name)

    n = F.col("total_casos")
    solved = share(F.col("casos_cerrados"), n)
    return (
        df.where(F.col(r.assignee).isNotNull())
        .groupBy(F.col(r.assignee).alias("responsable"))
        .agg(
            *[c.alias(k) for k, c in _states(r).items()],
            money_sum(F.col(r.amount)).alias("monto_gestionado"),
            level(r.high).alias("complejidad_alta"),
            level(r.medium).alias("complejidad_media"),
            level(r.low).alias("complejidad_baja"),
        )
        .withColumn("tasa_resolucion", solved)
        .withColumn(
            "score_eficiencia",
            F.col("tasa_resolucion") * 0.5
            + (1 - F.col("complejidad_alta") / n) * 30
            + F.col("casos_cerrados") / n * 20,
        )
    )
