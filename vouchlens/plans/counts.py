"""Value counts of several columns at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchlens.functions.columns import lookup_value


def value_counts(df: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """(dimension, value, cases) for several columns in one aggregation."""
    named = df.select(*[F.col(c).alias(d) for d, c in dimensions.items()])
    sets = [[F.col(d)] for d in dimensions]
    counts = named.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("cases")
    )
    n = len(dimensions)
    ones = (1 << n) - 1
    dimension = lookup_value(
        F.col("_g"), {ones ^ (1 << (n - 1 - i)): d for i, d in enumerate(dimensions)}
    )
    return (
        counts.select(dimension.alias("dimension"), F.coalesce(*dimensions).alias("value"), "cases")
        .where("value IS NOT NULL")
    )
