"""Payments that share a transaction id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchlens.functions.columns import present, text
from vouchlens.operators.row_rules import standard_columns
from vouchlens.plans.lookup import HOT_SHARE, lookup_split
from vouchlens.roles import PaymentRoles
from vouchlens.session import written_once


def _differs(column: str) -> Column:
    """More than one distinct non-null value, from mergeable aggregates alone."""
    return F.coalesce(F.min(column) != F.max(column), F.lit(False))


def duplicate_groups(df: DataFrame, r: PaymentRoles) -> DataFrame:
    """One row per repeated id: how often, and which columns differ (schema order)."""
    others = [c for c in df.columns if c != r.id]
    groups = (
        df.where(F.col(r.id).isNotNull())
        .groupBy(r.id)
        .agg(
            F.count(F.lit(1)).alias("duplicate_count"),
            *[_differs(c).alias(f"_d_{i}") for i, c in enumerate(others)],
        )
        .where("duplicate_count > 1")
    )
    named = [F.when(F.col(f"_d_{i}"), F.lit(c)) for i, c in enumerate(others)]
    differences = F.array_join(present(named), ", ")
    return groups.select(
        r.id,
        "duplicate_count",
        F.when(differences == "", "ninguna").otherwise(differences).alias("differences"),
        F.col(f"_d_{others.index(r.approver)}").alias("different_approvers"),
        F.col(f"_d_{others.index(r.amount)}").alias("different_amounts"),
    )


def _hot_ids(df: DataFrame, groups: DataFrame, r: PaymentRoles) -> DataFrame:
    """Ids with more than 1/HOT_SHARE of the rows, from the counts that the groups hold."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return groups.where(F.col("duplicate_count") * HOT_SHARE > total).select(r.id)


def detect_duplicates(df: DataFrame, r: PaymentRoles) -> DataFrame:
    groups = written_once(duplicate_groups(df, r).select(r.id, "duplicate_count", "differences"))
    marked = lookup_split(df, groups, r.id, _hot_ids(df, groups, r))
    return standard_columns(
        marked,
        "duplicate",
        "DUPLICATE_TRANSACTION",
        F.col("duplicate_count").isNotNull(),
        text(
            "ID duplicado {} veces. Diferencias en: {}",
            F.col("duplicate_count"),
            F.col("differences"),
        ),
    ).drop("duplicate_count", "differences")


def duplicate_values(df: DataFrame, r: PaymentRoles, groups: DataFrame | None = None) -> DataFrame:
    """(id, column, value): the distinct approvers and amounts of each group.

    One row per value instead of a list per group, as a group may be any size.
    ``groups`` is the table of ``duplicate_groups`` where the caller has it.
    """
    if groups is None:
        groups = written_once(duplicate_groups(df, r))
    repeated = groups.select(r.id, F.col("duplicate_count").alias("_n"))
    values = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
            for c in (r.approver, r.amount)
        ]
    )
    narrow = df.select(r.id, r.approver, r.amount)
    copies = lookup_split(narrow, repeated, r.id, _hot_ids(df, groups, r)).where(F.col("_n").isNotNull())
    return (
        copies.select(r.id, F.explode(values).alias("x"))
        .select(r.id, "x.column", "x.value")
        .where(F.col("value").isNotNull())
        .distinct()
    )


def duplicate_report(df: DataFrame, r: PaymentRoles) -> DataFrame:
    """The groups with the number of distinct approvers and amounts."""
    groups = written_once(duplicate_groups(df, r))
    counts = (
        duplicate_values(df, r, groups)
        .groupBy(r.id)
        .agg(
            F.count_if(F.col("column") == r.approver).alias("approvers"),
            F.count_if(F.col("column") == r.amount).alias("amounts"),
        )
    )
    return (
        groups.join(counts, r.id, "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("approvers", "amounts")})
    )


def duplicate_summary(groups: DataFrame) -> DataFrame:
    both = F.col("different_approvers") & F.col("different_amounts")
    return groups.agg(
        F.count(F.lit(1)).alias("total_duplicate_groups"),
        F.count_if("different_approvers").alias("groups_with_different_approvers"),
        F.count_if("different_amounts").alias("groups_with_different_amounts"),
        F.count_if(both).alias("groups_with_both_different"),
        F.coalesce(F.sum("duplicate_count"), F.lit(0)).alias("total_duplicate_records"),
    )


def critical_duplicates(groups: DataFrame) -> DataFrame:
    return groups.where(F.col("different_approvers") | F.col("different_amounts"))
