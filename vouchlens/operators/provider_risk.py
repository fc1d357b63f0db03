"""Risk score, category, rank and alerts per provider."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchlens.functions.columns import (
    UNIT,
    clipped,
    equal_width_bin,
    fixed,
    flag,
    money_mean,
    money_sum,
    present,
    text,
    unit_mean,
)
from vouchlens.plans.lookup import Measured, measured
from vouchlens.plans.ordered import with_row_number
from vouchlens.plans.quantiles import quantile_values
from vouchlens.roles import HistoryRoles

# Weights, bounds, thresholds, severities and components.
WEIGHTS = {
    "score_cumplimiento_avg": 0.40,
    "payment_delay_frequency": 0.25,
    "amount_volatility": 0.15,
    "recent_performance": 0.20,
}
RISK_BOUNDS = {"alto": (0.0, 0.4), "medio": (0.4, 0.7), "bajo": (0.7, 1.0)}
ALERT_THRESHOLDS = {
    "critical_score": 0.3,
    "high_amount": 5000,
    "high_transaction_count": 50,
    "recent_activity_days": 30,
}
SEVERITIES = ["CRITICA", "ALTA", "MEDIA", "BAJA"]
CATEGORIES = ["alto", "medio", "bajo"]
COMPONENTS = list(WEIGHTS)
RECENT_DAYS = 90


def mean_compliance(df: DataFrame, r: HistoryRoles) -> DataFrame:
    known = df.where(F.col(r.supplier).isNotNull())
    return known.groupBy(r.supplier).agg(unit_mean(F.col(r.score)).alias("score_cumplimiento_avg"))


def punctuality(df: DataFrame, r: HistoryRoles) -> Column:
    """Share of payments not delayed; mean compliance where no status is known."""
    if r.status in df.columns:
        return 1.0 - F.avg(F.coalesce((F.col(r.status) == "Retrasado").cast("double"), F.lit(0.0)))
    return unit_mean(F.col(r.score))


def stability(amount: str) -> Column:
    """1 / (1 + coefficient of variation); neutral for a single payment."""
    std, mean = F.stddev_samp(amount), F.avg(amount)
    steady = F.when((mean == 0) & (std > 0), F.lit(0.0)).otherwise(
        1.0 / (1.0 + F.try_divide(std, mean))
    )
    return F.when(F.count(F.lit(1)) > 1, steady).otherwise(F.lit(0.5))


def recent_performance(df: DataFrame, r: HistoryRoles, recent_days: int = RECENT_DAYS) -> DataFrame:
    """Mean compliance in the days up to each provider's own last date.

    Payments are first summed per provider and day, so what meets in a provider's
    window is one row per day, however many payments it has.
    """
    daily = (
        df.where(F.col(r.supplier).isNotNull() & F.col(r.date).isNotNull())
        .groupBy(r.supplier, r.date)
        .agg(F.sum(F.col(r.score).cast(UNIT)).alias("_s"), F.count(r.score).alias("_n"))
    )
    last = F.max(r.date).over(Window.partitionBy(r.supplier))
    return (
        daily.withColumn("_last", last)
        .where(F.col(r.date) >= F.col("_last") - F.expr(f"INTERVAL {int(recent_days)} DAYS"))
        .groupBy(r.supplier)
        .agg(F.try_divide(F.sum("_s").cast("double"), F.sum("_n")).alias("recent_performance"))
    )


def final_score(weights: Mapping[str, float]) -> Column:
    total = sum(F.col(name) * w for name, w in weights.items())
    return clipped(total)


def risk_category(score: Column) -> Column:
    chain = F
    for name, (low, high) in RISK_BOUNDS.items():
        inside = score >= low if name == "bajo" else (score >= low) & (score < high)
        chain = chain.when(inside, F.lit(name))
    return chain.otherwise(F.lit("medio"))


def unranked_scores(
    df: DataFrame,
    r: HistoryRoles,
    recent_days: int = RECENT_DAYS,
    weights: Mapping[str, float] = WEIGHTS,
) -> DataFrame:
    """One row per provider with components, score, category and totals."""
    if abs(sum(weights.values()) - 1.0) > 0.01:
        raise ValueError("the weights must sum to 1")
    amount = F.col(r.amount)
    totals = (
        df.where(F.col(r.supplier).isNotNull())
        .groupBy(r.supplier)
        .agg(
            F.count(F.lit(1)).alias("total_transactions"),
            unit_mean(F.col(r.score)).alias("score_cumplimiento_avg"),
            punctuality(df, r).alias("payment_delay_frequency"),
            stability(r.amount).alias("amount_volatility"),
            money_sum(amount).alias("total_amount"),
            money_mean(amount).alias("avg_amount"),
            F.max(r.date).alias("last_transaction_date"),
            F.min(r.date).alias("first_transaction_date"),
        )
    )
    recent = recent_performance(df, r, recent_days)
    return (
        totals.join(recent, r.supplier, "left")
        .withColumn(
            "recent_performance", F.coalesce("recent_performance", "score_cumplimiento_avg")
        )
        .withColumn("final_risk_score", final_score(weights))
        .withColumn("risk_category", risk_category(F.col("final_risk_score")))
    )


def provider_scores(
    df: DataFrame,
    r: HistoryRoles,
    recent_days: int = RECENT_DAYS,
    weights: Mapping[str, float] = WEIGHTS,
) -> Measured:
    """The provider table with ``risk_rank``, 1 for the riskiest."""
    scores = measured(unranked_scores(df, r, recent_days, weights))
    if scores.small:
        order = Window.orderBy("final_risk_score", r.supplier)
        ranked = scores.df.withColumn("risk_rank", F.row_number().over(order).cast("bigint"))
    else:
        ranked = with_row_number(scores.df, "final_risk_score", r.supplier, "risk_rank")
    return Measured(ranked, scores.small)


# --- alerts -----------------------------------------------------------------


def with_alerts(
    scores: DataFrame, thresholds: Mapping[str, float] = ALERT_THRESHOLDS
) -> DataFrame:
    """Adds ``alerts``, an array of up to six (type, severity, message, recommendation)."""
    today = scores.agg(F.max("last_transaction_date")).scalar()
    score, category = F.col("final_risk_score"), F.col("risk_category")
    recent, usual = F.col("recent_performance"), F.col("score_cumplimiento_avg")
    idle = F.datediff(F.col("_today"), F.col("last_transaction_date"))

    def alert(condition: Column, kind: str, severity: str, message: Column, advice: str) -> Column:
        return F.when(
            flag(condition),
            F.struct(
                F.lit(kind).alias("type"),
                F.lit(severity).alias("severity"),
                message.alias("message"),
                F.lit(advice).alias("recommendation"),
            ),
        )

    entries = [
        alert(
            score < thresholds["critical_score"],
            "CRITICAL_RISK_SCORE",
            "CRITICA",
            text("Score de riesgo crítico: {}", fixed(score, 3)),
            "Revisar historial completo y considerar restricciones",
        ),
        alert(
            (category == "alto") & (F.col("total_amount") > thresholds["high_amount"]),
            "HIGH_RISK_HIGH_AMOUNT",
            "ALTA",
            text("Alto riesgo con monto acumulado: ${}", F.format_number("total_amount", 2)),
            "Limitar crédito o requerir garantías adicionales",
        ),
        alert(
            (recent < usual - 0.15) & (recent < 0.5),
            "DEGRADED_PERFORMANCE",
            "MEDIA",
            text(
                "Performance reciente degradada: {} vs histórico {}",
                fixed(recent, 3),
                fixed(usual, 3),
            ),
            "Monitorear de cerca próximas transacciones",
        ),
        alert(
            F.col("amount_volatility") < 0.3,
            "HIGH_VOLATILITY",
            "BAJA",
            text(
                "Alta volatilidad en montos (score: {})", fixed(F.col("amount_volatility"), 3)
            ),
            "Establecer límites de transacción más estrictos",
        ),
        alert(
            (F.col("total_transactions") > thresholds["high_transaction_count"])
            & (category != "bajo"),
            "HIGH_VOLUME_RISKY",
            "MEDIA",
            text("{} transacciones con riesgo {}", F.col("total_transactions"), category),
            "Revisar proceso de aprobación para este proveedor",
        ),
        alert(
            idle > thresholds["recent_activity_days"],
            "INACTIVE_PROVIDER",
            "BAJA",
            text("Sin actividad en {} días", idle),
            "Actualizar información del proveedor antes de nueva transacción",
        ),
    ]
    return (
        scores.withColumn("_today", today)
        .withColumn("alerts", present(entries))
        .withColumn("alert_count", F.size("alerts"))
        .drop("_today")
    )


def alerted_providers(alerted: DataFrame) -> DataFrame:
    return alerted.where("alert_count > 0")


def alert_rows(alerted: DataFrame, supplier: str) -> DataFrame:
    """One row per alert."""
    return alerted.select(
        supplier,
        F.col("final_risk_score").alias("risk_score"),
        "risk_category",
        F.explode("alerts").alias("a"),
    ).select(
        supplier, "risk_score", "risk_category", "a.type", "a.severity", "a.message", "a.recommendation"
    )


def severity_counts(alerted: DataFrame) -> DataFrame:
    """All four severities, also those without an alert."""
    each = alerted.select(F.explode("alerts.severity").alias("s"))
    counts = each.agg(*[F.count_if(F.col("s") == s).alias(s) for s in SEVERITIES])
    rows = [F.struct(F.lit(s).alias("severity"), F.col(s).alias("alerts")) for s in SEVERITIES]
    return counts.select(F.explode(F.array(*rows)).alias("x")).select("x.severity", "x.alerts")


# --- access and summaries ---------------------------------------------------


def top_risky(scores: DataFrame, supplier: str, n: int = 10) -> DataFrame:
    return scores.orderBy("final_risk_score", supplier).limit(n)


def in_category(scores: DataFrame, category: str) -> DataFrame:
    return scores.where(F.col("risk_category") == category)


def provider_detail(alerted: DataFrame, supplier: str, key) -> DataFrame:
    one = alerted.where(F.col(supplier) == F.lit(key))
    if one.isEmpty():
        raise ValueError(f"provider {key} not found")
    return one


def category_summary(scores: DataFrame) -> DataFrame:
    """Count, share and mean score of the three categories, empty ones included."""

    def inside(c: str) -> Column:
        return F.col("risk_category") == c

    figures = scores.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(inside(c)).alias(f"n_{c}") for c in CATEGORIES],
        *[
            F.coalesce(F.avg(F.when(inside(c), F.col("final_risk_score"))), F.lit(0.0)).alias(
                f"m_{c}"
            )
            for c in CATEGORIES
        ],
    )
    rows = [
        F.struct(
            F.lit(c).alias("category"),
            F.col(f"n_{c}").alias("count"),
            F.coalesce(F.try_divide(F.col(f"n_{c}") * 100.0, F.col("n")), F.lit(0.0)).alias("percentage"),
            F.col(f"m_{c}").alias("avg_score"),
        )
        for c in CATEGORIES
    ]
    return figures.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def overall_summary(alerted: DataFrame, small: bool = False) -> DataFrame:
    """``small`` is what ``provider_scores`` measured."""
    median = quantile_values(Measured(alerted, small), "final_risk_score", {"m": 0.5})
    return (
        alerted.agg(
            F.count(F.lit(1)).alias("total_providers"),
            F.count_if(F.col("alert_count") > 0).alias("total_alerts"),
            F.avg("final_risk_score").alias("avg_risk_score"),
        )
        .withColumn("median_risk_score", median.getField("m"))
    )


def score_histogram(scores: DataFrame, bins: int = 30) -> DataFrame:
    edges = scores.agg(
        F.struct(F.min("final_risk_score").alias("lo"), F.max("final_risk_score").alias("hi"))
    ).scalar()
    return (
        scores.where(F.col("final_risk_score").isNotNull())
        .withColumn("_e", edges)
        .withColumn(
            "bin", equal_width_bin(F.col("final_risk_score"), F.col("_e.lo"), F.col("_e.hi"), bins)
        )
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("providers"))
    )


def component_matrix(scores: DataFrame, supplier: str, n: int = 20) -> DataFrame:
    """The four components of the n riskiest providers in long form."""
    return top_risky(scores, supplier, n).unpivot(
        [supplier], COMPONENTS, "component", "value"
    )


def amount_points(scores: DataFrame, supplier: str) -> DataFrame:
    return scores.select(supplier, "risk_category", "final_risk_score", "total_amount")


def latest_activity(scores: DataFrame, supplier: str, n: int = 20) -> DataFrame:
    return (
        scores.orderBy(F.desc("last_transaction_date"), supplier)
        .limit(n)
        .select(supplier, "risk_category", "first_transaction_date", "last_transaction_date")
    )
