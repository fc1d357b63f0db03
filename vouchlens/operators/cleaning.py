"""Cleaning of a payment history, step by step in fixed order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchlens.functions.columns import any_of, clipped, flag, share
from vouchlens.plans.ordered import column_modes
from vouchlens.plans.quantiles import column_quantiles
from vouchlens.roles import VALID_CATEGORIES, HistoryRoles
from vouchlens.session import written_once

OUTLIER_FACTOR = 1.5
MISSING = "nan"  # how a missing category reads once it is text


def _number(column: str) -> Column:
    parsed = F.trim(F.col(column).cast("string")).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def typed(df: DataFrame, r: HistoryRoles) -> DataFrame:
    """Unreadable dates and numbers become null, categories trimmed text."""
    categories = {
        c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(MISSING))) for c in r.categorical
    }
    return df.withColumns(
        {
            r.date: F.col(r.date).try_cast("timestamp"),
            r.supplier: _number(r.supplier).cast("bigint"),
            **{c: _number(c) for c in r.numeric},
            **categories,
        }
    )


def fill_missing(df: DataFrame, r: HistoryRoles) -> DataFrame:
    """Numbers take the median, rows without supplier or date go, categories take the mode."""
    medians = column_quantiles(df, r.numeric, {"median": 0.5})
    kept = df.dropna(subset=[r.supplier, r.date])
    modes = column_modes(kept, r.categorical)
    filled = kept.withColumns({"_median": medians, "_mode": modes})
    return filled.withColumns(
        {
            **{c: F.coalesce(F.col(c), F.col(f"_median.`{c}`.median")) for c in r.numeric},
            **{
                c: F.when(F.col(c) == MISSING, F.col(f"_mode.`{c}`")).otherwise(F.col(c))
                for c in r.categorical
            },
        }
    ).drop("_median", "_mode")


def normal_amounts(df: DataFrame, r: HistoryRoles) -> DataFrame:
    return df.withColumn(r.amount, F.bround(r.amount, 2)).where(F.col(r.amount) > 0)


def valid_categories(
    df: DataFrame, allowed: Mapping[str, Sequence[str]] = VALID_CATEGORIES
) -> DataFrame:
    """Other values become the most frequent one, invalid values counted as well."""
    columns = [c for c in allowed if c in df.columns]
    modes = column_modes(df, columns)
    checked = df.withColumn("_mode", modes)
    return checked.withColumns(
        {
            c: F.when(F.col(c).isin(list(allowed[c])), F.col(c)).otherwise(F.col(f"_mode.`{c}`"))
            for c in columns
        }
    ).drop("_mode")


def _fences(df: DataFrame, columns: Sequence[str], factor: float) -> tuple[DataFrame, dict]:
    quartiles = column_quantiles(df, columns, {"q1": 0.25, "q3": 0.75})
    with_q = df.withColumn("_q", quartiles)
    fences = {}
    for c in columns:
        q1, q3 = F.col(f"_q.`{c}`.q1"), F.col(f"_q.`{c}`.q3")
        fences[c] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return with_q, fences


def with_outliers(
    df: DataFrame, columns: Sequence[str], factor: float = OUTLIER_FACTOR
) -> DataFrame:
    with_q, fences = _fences(df, columns, factor)
    outside = [
        flag((F.col(c) < low) | (F.col(c) > high)) for c, (low, high) in fences.items()
    ]
    return with_q.withColumn("is_outlier", any_of(outside)).drop("_q")


def outlier_details(
    df: DataFrame, columns: Sequence[str], factor: float = OUTLIER_FACTOR
) -> DataFrame:
    """Per column: rows outside, their share and the bounds."""
    with_q, fences = _fences(df, columns, factor)
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, (c, (low, high)) in enumerate(fences.items()):
        aggregates += [
            F.count_if((F.col(c) < low) | (F.col(c) > high)).alias(f"n{i}"),
            F.max(low).alias(f"l{i}"),
            F.max(high).alias(f"h{i}"),
        ]
    rows = [
        F.struct(
            F.lit(c).alias("columna"),
            F.col(f"n{i}").alias("count"),
            share(F.col(f"n{i}"), F.col("n"), 2).alias("percentage"),
            F.bround(f"l{i}", 2).alias("lower_bound"),
            F.bround(f"h{i}", 2).alias("upper_bound"),
        )
        for i, c in enumerate(fences)
    ]
    return with_q.agg(*aggregates).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def valid_ranges(df: DataFrame, r: HistoryRoles) -> DataFrame:
    """Scores clipped to [0, 1]; rows without a positive time go."""
    return df.withColumn(r.score, clipped(F.col(r.score))).where(~flag(F.col(r.time) <= 0))


def quality(df: DataFrame) -> DataFrame:
    """Rows, columns, nulls and fully repeated rows.

    Equal rows are counted together first, so both figures come from one pass and
    many copies of a row are one row.
    """
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_records"),
        F.lit(len(df.columns)).alias("total_columns"),
        F.coalesce(F.sum(nulls * F.col("_n")), F.lit(0)).alias("null_values"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicated_rows"),
    )


def quality_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both states and what the cleaning removed, one row each."""
    b, a = quality(before), quality(after)
    names = ["total_records", "null_values"]
    removed = (
        b.select(*names)
        .unionByName(a.select(*[(-F.col(n)).alias(n) for n in names]))
        .agg(*[F.sum(n).alias(n) for n in names])
    )
    zero = F.lit(0).cast("bigint")
    return (
        b.select(F.lit("initial").alias("state"), "*")
        .unionByName(a.select(F.lit("final").alias("state"), "*"))
        .unionByName(
            removed.select(
                F.lit("removed").alias("state"),
                "*",
                F.lit(0).alias("total_columns"),
                zero.alias("duplicated_rows"),
            )
        )
    )


def clean(
    df: DataFrame,
    r: HistoryRoles,
    allowed: Mapping[str, Sequence[str]] = VALID_CATEGORIES,
    factor: float = OUTLIER_FACTOR,
) -> DataFrame:
    """All steps. Outlier bounds are taken before rows without a valid time go.

    The medians, modes and quartiles each need the whole table, so the typed and
    the filled rows are written once and read from there.
    """
    filled = written_once(normal_amounts(fill_missing(written_once(typed(df, r)), r), r))
    checked = valid_categories(filled, allowed)
    marked = with_outliers(checked, [r.amount, r.time], factor)
    return valid_ranges(marked, r)


def without_outliers(cleaned: DataFrame) -> DataFrame:
    return cleaned.where(~F.col("is_outlier")).drop("is_outlier")
