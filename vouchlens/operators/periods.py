"""Time aggregates of a payment history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vouchlens.functions.columns import MONEY, UNIT, money_sum, unit_mean
from vouchlens.roles import HistoryRoles

# Period lengths.
UNITS = {"D": "day", "W": "week", "M": "month", "Q": "quarter"}
ROLLING_DAYS = [7, 30, 90, 180]


def by_period(df: DataFrame, r: HistoryRoles, unit: str) -> DataFrame:
    period = F.to_date(F.date_trunc(UNITS[unit], r.date))
    return df.groupBy(period.alias("period")).agg(
        F.count(F.lit(1)).alias("payments"),
        money_sum(F.col(r.amount)).alias("total_amount"),
        unit_mean(F.col(r.score)).alias("mean_score"),
    )


def rolling(df: DataFrame, r: HistoryRoles, days: Sequence[int] = ROLLING_DAYS) -> DataFrame:
    """Sum and mean of the amount over the last days, per supplier and day.

    The window runs over one row per supplier and day, so a busy supplier costs no
    more than the calendar has days.
    """
    daily = (
        df.where(F.col(r.supplier).isNotNull() & F.col(r.date).isNotNull())
        .groupBy(r.supplier, F.to_date(r.date).alias("day"))
        .agg(F.sum(F.col(r.amount).cast(MONEY)).alias("_sum"), F.count(r.amount).alias("_n"))
        .withColumn("_day", F.unix_date("day"))
    )
    by_supplier = Window.partitionBy(r.supplier).orderBy("_day")
    figures = {}
    for n in days:
        frame = by_supplier.rangeBetween(-(n - 1), 0)
        total, count = F.sum("_sum").over(frame).cast("double"), F.sum("_n").over(frame)
        figures[f"sum_{n}d"] = total
        figures[f"mean_{n}d"] = F.try_divide(total, count)
    return daily.withColumns(figures).drop("_sum", "_n", "_day")
