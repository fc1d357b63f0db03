"""Bringing per-key results back to the rows, with hot keys and big tables in mind."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchlens.session import cut_lineage, written_once

BROADCAST_ROWS = 100_000
HOT_SHARE = 1_000


@dataclass(frozen=True)
class Measured:
    """A table computed once, of which it is known whether it is small."""

    df: DataFrame
    small: bool


def measured(stats: DataFrame, limit: int | None = None) -> Measured:
    """Computes the table (reliable checkpoint) and counts it up to the limit."""
    limit = BROADCAST_ROWS if limit is None else limit
    known = written_once(stats)
    return Measured(known, known.limit(limit + 1).count() <= limit)


def lookup(
    rows: DataFrame, table: DataFrame | Measured, key: str, stored: DataFrame | None = None
) -> DataFrame:
    """Left join of a table with one row per key: broadcast when small, else split.

    ``stored`` are the same rows before other lookups, where they are cheaper to count.
    """
    known = table if isinstance(table, Measured) else measured(table)
    if known.small:
        return rows.join(F.broadcast(known.df), key, "left")
    return lookup_split(rows, known.df, key, hot_keys(rows if stored is None else stored, key))


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys (a missing one included) with more than 1/HOT_SHARE of the rows.

    There are fewer than HOT_SHARE of them, whatever the data.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return cut_lineage(counts.where(F.col("_n") * HOT_SHARE > total).select(key))


def lookup_split(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """Left join for tables of any size, exact under any skew of the key, in one pass over the rows.

    Rows of hot keys get their answer by broadcast. They and rows without a key go
    through the shuffle under numbers of their own that match nothing, so they are spread
    evenly; all others meet their key there, and none of these is large. ``hot`` holds the
    hot keys where the caller knows them.
    """
    hot = hot_keys(rows, key) if hot is None else hot
    names = [c for c in table.columns if c != key]
    known = table.join(F.broadcast(hot), key, "left_semi")
    answers = hot.join(F.broadcast(known), key, "left").select(
        F.col(key).alias("_hot_key"), F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in names]
    )
    alone = F.col("_hot").isNotNull() | F.col(key).isNull()
    marked = rows.join(F.broadcast(answers), F.col(key) == F.col("_hot_key"), "left").withColumns(
        {
            "_cold_key": F.when(~alone, F.col(key)),
            "_spread": F.when(alone, F.monotonically_increasing_id()).otherwise(F.xxhash64(key)),
        }
    )
    cold = table.select(
        F.col(key).alias("_cold_key"), F.xxhash64(key).alias("_spread"), *[F.col(c).alias(f"_cold_{c}") for c in names]
    )
    return marked.join(cold, ["_cold_key", "_spread"], "left").select(
        key,
        *[c for c in rows.columns if c != key],
        *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in names],
    )
