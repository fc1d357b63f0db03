"""Approvers whose figures or names stand out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchlens.functions.columns import fixed, money_mean, money_sum, text
from vouchlens.operators.row_rules import standard_columns
from vouchlens.plans.lookup import Measured, lookup, measured
from vouchlens.plans.quantiles import exact_quantiles
from vouchlens.roles import PaymentRoles

# Patterns of suspicious names and the percentiles of the rule.
SUSPICIOUS_PATTERNS = [
    "unauthorized",
    "john doe",
    "jane smith",
    "test",
    "temp",
    "unknown",
    "user",
]
FREQUENCY_PERCENTILE = 0.10
AMOUNT_LOW_PERCENTILE = 0.25
AMOUNT_HIGH_PERCENTILE = 0.75


def approver_statistics(df: DataFrame, r: PaymentRoles) -> DataFrame:
    """Count, mean, sample deviation, sum, minimum and maximum per approver."""
    amount = F.col(r.amount)
    return (
        df.where(F.col(r.approver).isNotNull())
        .groupBy(r.approver)
        .agg(
            F.count(F.lit(1)).alias("transaction_count"),
            money_mean(amount).alias("avg_amount"),
            F.stddev_samp(amount).alias("std_amount"),
            money_sum(amount).alias("total_amount"),
            F.min(amount).alias("min_amount"),
            F.max(amount).alias("max_amount"),
        )
    )


def with_median(stats: DataFrame, df: DataFrame, r: PaymentRoles) -> DataFrame:
    medians = exact_quantiles(df, r.amount, {"median_amount": 0.5}, [r.approver])
    return stats.join(medians, r.approver, "left")


def suspicious_name(name: Column, patterns: list[str] | None = None) -> Column:
    wanted = SUSPICIOUS_PATTERNS if patterns is None else patterns
    found = [F.contains(F.lower(name), F.lit(p)) for p in wanted]
    hit = found[0]
    for f in found[1:]:
        hit = hit | f
    return F.coalesce(hit, F.lit(False))


def judged_approvers(
    stats: DataFrame | Measured,
    r: PaymentRoles,
    patterns: list[str] | None = None,
    frequency: float = FREQUENCY_PERCENTILE,
    low: float = AMOUNT_LOW_PERCENTILE,
    high: float = AMOUNT_HIGH_PERCENTILE,
) -> DataFrame:
    """Marks each approver; the percentiles are over approvers, not over payments."""
    known = stats if isinstance(stats, Measured) else measured(stats)
    stats, n, mean = known.df, "transaction_count", "avg_amount"
    if known.small:
        bounds = stats.agg(
            F.struct(
                F.percentile(n, F.lit(frequency)).alias("few"),
                F.percentile(mean, F.lit(low)).alias("low"),
                F.percentile(mean, F.lit(high)).alias("high"),
            )
        ).scalar()
    else:
        figures = stats.select(
            F.explode(
                F.create_map(F.lit("n"), F.col(n).cast("double"), F.lit("mean"), F.col(mean))
            ).alias("m", "v")
        )
        edges = exact_quantiles(figures, "v", {"f": frequency, "lo": low, "hi": high}, ["m"], few_groups=True)

        def edge(metric: str, name: str) -> Column:
            return F.max(F.when(F.col("m") == metric, F.col(name)))

        bounds = edges.agg(
            F.struct(
                edge("n", "f").alias("few"),
                edge("mean", "lo").alias("low"),
                edge("mean", "hi").alias("high"),
            )
        ).scalar()
    return (
        stats.withColumn("_b", bounds)
        .withColumns(
            {
                "low_frequency": F.col("transaction_count") < F.col("_b.few"),
                "low_mean": F.coalesce(F.col("avg_amount") < F.col("_b.low"), F.lit(False)),
                "high_mean": F.coalesce(F.col("avg_amount") > F.col("_b.high"), F.lit(False)),
                "suspicious_name": suspicious_name(F.col(r.approver), patterns),
            }
        )
        .withColumn(
            "is_atypical", F.col("low_frequency") & (F.col("low_mean") | F.col("high_mean"))
        )
        .withColumn("is_suspicious", F.col("is_atypical") | F.col("suspicious_name"))
        .drop("_b")
    )


def approver_description(name: Column) -> Column:
    reasons = F.concat_ws(
        "; ",
        F.when(
            F.col("low_frequency"),
            text("Baja frecuencia ({} transacciones)", F.col("transaction_count")),
        ),
        F.when(
            F.col("low_mean"), text("Monto promedio bajo (${})", fixed(F.col("avg_amount"), 2))
        ).when(
            F.col("high_mean"), text("Monto promedio alto (${})", fixed(F.col("avg_amount"), 2))
        ),
        F.when(F.col("suspicious_name"), F.lit("Nombre sospechoso")),
    )
    return text("Aprobador atípico: {}. {}", name, reasons)


def approver_table(
    df: DataFrame, r: PaymentRoles, patterns: list[str] | None = None
) -> Measured:
    """What a payment needs to know about its approver, with the approver's spread."""
    stats = measured(approver_statistics(df, r))
    judged = judged_approvers(stats, r, patterns)
    table = judged.select(
        r.approver,
        F.col("avg_amount").alias("_mean"),
        F.col("std_amount").alias("_std"),
        F.col("is_suspicious").alias("_hit"),
        F.when(F.col("is_suspicious"), approver_description(F.col(r.approver))).alias("_why"),
    )
    return Measured(table, stats.small)


def mark_approvers(looked_up: DataFrame) -> DataFrame:
    """The standard columns, on rows joined to the approver table."""
    return standard_columns(
        looked_up,
        "approver",
        "ATYPICAL_APPROVER",
        F.coalesce(F.col("_hit"), F.lit(False)),
        F.col("_why"),
    ).drop("_hit", "_why")


def detect_approvers(
    df: DataFrame, r: PaymentRoles, patterns: list[str] | None = None
) -> DataFrame:
    marked = lookup(df, approver_table(df, r, patterns), r.approver)
    return mark_approvers(marked).drop("_mean", "_std")


def approver_report(
    df: DataFrame, r: PaymentRoles, patterns: list[str] | None = None
) -> DataFrame:
    stats = with_median(approver_statistics(df, r), df, r)
    return (
        judged_approvers(stats, r, patterns)
        .select(
            F.col(r.approver).alias("approver"),
            "transaction_count",
            "avg_amount",
            "std_amount",
            "total_amount",
            "min_amount",
            "max_amount",
            "median_amount",
            "is_suspicious",
        )
        .orderBy(F.desc("transaction_count"), "approver")
    )
