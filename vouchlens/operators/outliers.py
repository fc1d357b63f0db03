"""Amounts far from the mean of all payments, of the supplier or of the approver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchlens.functions.columns import any_of, fixed, flag, joined_text, money_mean, text
from vouchlens.operators.row_rules import Flags, standard_columns
from vouchlens.plans.lookup import lookup
from vouchlens.roles import PaymentRoles

Z_THRESHOLD = 3.0

GLOBAL, SUPPLIER, APPROVER = "z_score_global", "z_score_by_provider", "z_score_by_approver"


def with_global_z(df: DataFrame, amount: str, out: str = GLOBAL) -> DataFrame:
    """(x - mean) / sample deviation; mean and deviation are one scalar subquery."""
    return df.withColumn(out, global_z(df, amount))


def global_z(df: DataFrame, amount: str) -> Column:
    x = F.col(amount)
    spread = F.struct(money_mean(x).alias("mean"), F.stddev_samp(x).alias("std")).alias("s")
    whole = df.agg(spread).scalar()
    return F.try_divide(x - whole.getField("mean"), whole.getField("std"))


def group_spread(df: DataFrame, key: str, amount: str) -> DataFrame:
    x = F.col(amount)
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            money_mean(x).alias("_mean"),
            F.stddev_samp(x).alias("_std"),
        )
    )


def group_z(amount: str, mean: str = "_mean", std: str = "_std") -> Column:
    """0 for a missing key, a single row (no deviation) or no spread."""
    z = (F.col(amount) - F.col(mean)) / F.col(std)
    return F.when(F.col(std) > 0, z).otherwise(F.lit(0.0))


def with_group_z(df: DataFrame, key: str, amount: str, out: str) -> DataFrame:
    """z-score within a group, from per-group figures instead of a window per group."""
    marked = lookup(df, group_spread(df, key, amount), key)
    return marked.withColumn(out, group_z(amount)).drop("_mean", "_std")


def with_z_scores(df: DataFrame, r: PaymentRoles) -> DataFrame:
    """All three are of the original rows, not of the joined ones."""
    out = with_group_z(df, r.supplier, r.amount, SUPPLIER)
    marked = lookup(out, group_spread(df, r.approver, r.amount), r.approver, df)
    out = marked.withColumn(APPROVER, group_z(r.amount)).drop("_mean", "_std")
    return out.withColumn(GLOBAL, global_z(df, r.amount))


def amount_flags(z_threshold: float = Z_THRESHOLD) -> Flags:
    def far(z: str) -> Column:
        return flag(F.abs(F.col(z)) > z_threshold)

    return {
        "global_outliers": far(GLOBAL),
        "provider_outliers": far(SUPPLIER),
        "approver_outliers": far(APPROVER),
    }


def detect_amounts(
    df: DataFrame, r: PaymentRoles, z_threshold: float = Z_THRESHOLD
) -> DataFrame:
    """Needs the z-score columns of ``with_z_scores``."""
    f = amount_flags(z_threshold)
    description = joined_text(
        [
            F.when(
                f["global_outliers"],
                text(
                    "Monto atípico global: ${} (Z-score: {})",
                    fixed(F.col(r.amount), 2),
                    fixed(F.col(GLOBAL), 2),
                ),
            ),
            F.when(
                f["provider_outliers"],
                text(
                    "Atípico para proveedor {} (Z-score: {})",
                    F.col(r.supplier),
                    fixed(F.col(SUPPLIER), 2),
                ),
            ),
            F.when(
                f["approver_outliers"],
                text(
                    "Atípico para aprobador {} (Z-score: {})",
                    F.col(r.approver),
                    fixed(F.col(APPROVER), 2),
                ),
            ),
        ]
    )
    return standard_columns(df, "amount", "ATYPICAL_AMOUNT", any_of(list(f.values())), description)
