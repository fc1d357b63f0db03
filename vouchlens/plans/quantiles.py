"""Exact quantiles by bracket selection: a sketch gives bounds, one more pass keeps what lies inside.

The sketch of a column bounds each wanted value from below and above, with about one
ten-thousandth of the rows between (all of a group of up to a thousand rows). A second
pass counts the values below and, value by value, those inside; the wanted ranks are
found in that short list. Nothing is written, ranked or sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchlens.plans.lookup import Measured, lookup

#: A sketch's ranks are right to 1 / ACCURACY of the rows.
ACCURACY = 100_000
#: Up to so many rows everything is inside; then bounds lie so far from the wanted share, by the number of rows.
WHOLE, SOME = 1_000, 100_000
WIDE, NARROW = 2e-3, 4e-5


def _points(probs: Sequence[float]) -> list[float]:
    shares = [p + d for p in probs for d in (-WIDE, -NARROW, NARROW, WIDE)]
    return [s for s in shares if 0 < s < 1]


def _stats(i: int, value: Column, probs: Mapping[str, float]) -> list[Column]:
    """Count, extremes and bounds of a value, by one aggregation."""
    out = [F.count(value).alias(f"_{i}n"), F.min(value).alias(f"_{i}min"), F.max(value).alias(f"_{i}max")]
    every = _points(list(probs.values())) or [0.5]
    return [*out, F.percentile_approx(value, every, ACCURACY).alias(f"_{i}at")]


def selected(
    df: DataFrame,
    values: Mapping[str, Column],
    probs: Mapping[str, float],
    groups: Sequence[str] = (),
    few_groups: bool = False,
) -> DataFrame:
    """Linear-interpolated quantiles: a struct of ``probs`` for each of ``values``, one row per group.

    Missing values are left out; a value without any has nulls. ``few_groups`` says that
    the groups are so few that their bounds may be broadcast.
    """
    groups = list(groups)
    columns = {f"_v{i}": v.cast("double") for i, v in enumerate(values.values())}
    rows = df.select(*groups, *[v.alias(c) for c, v in columns.items()])
    if groups:
        rows = rows.dropna(subset=groups)
    figures = [s for i, c in enumerate(columns) for s in _stats(i, F.col(c), probs)]
    if not groups:
        stats = rows.agg(F.struct(*figures).alias("s")).scalar()
        known = rows.withColumn("_s", stats).select(*columns, "_s.*")
    elif few_groups:
        known = rows.join(F.broadcast(rows.groupBy(*groups).agg(*figures)), groups)
    else:
        (key,) = groups
        known = lookup(rows, rows.groupBy(key).agg(*figures), key)
    # rows on the same side of all bounds are one cell, so only cells are taken apart
    sides, slots, at, every = {}, [], {}, list(probs.values())
    for i, c in enumerate(columns):
        for k, p in enumerate(every):
            (low, high), j, v = _slot_bounds(i, every, k), len(slots), F.col(c)
            sides |= {f"_b{j}": v < low, f"_i{j}": F.when((v >= low) & (v <= high), v)}
            slot, total = F.lit(j).alias("slot"), F.col(f"_{i}n").alias("total")
            below = F.struct(slot, F.lit(None).cast("double").alias("v"), total)
            inside = F.struct(slot, F.col(f"_i{j}").alias("v"), total)
            slots.append(F.when(F.col(f"_b{j}"), below).when(F.col(f"_i{j}").isNotNull(), inside))
            at[j] = (i, k, p)
    totals = [f"_{i}n" for i in range(len(columns))]
    placed = known.select(*groups, *totals, *[x.alias(n) for n, x in sides.items()])
    counted = placed.groupBy(*placed.columns).agg(F.count(F.lit(1)).alias("_rows"))
    found = counted.select(*groups, "_rows", F.explode(F.filter(F.array(*slots), lambda s: s.isNotNull())).alias("_x"))
    cells = found.groupBy(*groups, "_x.slot", "_x.total", "_x.v").agg(F.sum("_rows").alias("n"))
    # what was counted below is the entry without a value, which sorts first
    lists = cells.groupBy(*groups, "slot", "total").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("cells"))
    shares = F.array(*[F.lit(float(p)) for _, _, p in at.values()])
    rank = (F.col("total") - 1) * F.get(shares, F.col("slot"))
    low, high = _ranked(F.col("cells"), F.floor(rank)), _ranked(F.col("cells"), F.ceil(rank))
    picked = lists.select(*groups, "slot", (low + (high - low) * (rank - F.floor(rank))).alias("q"))
    names = list(probs)
    per_slot = {(i, k): F.max(F.when(F.col("slot") == s, F.col("q"))) for s, (i, k, _) in at.items()}
    return picked.groupBy(*groups).agg(
        *[F.struct(*[per_slot[i, k].alias(n) for k, n in enumerate(names)]).alias(c) for i, c in enumerate(values)]
    )


def _slot_bounds(i: int, probs: Sequence[float], k: int) -> tuple[Column, Column]:
    """Bounds of the k-th share of value i."""
    p, first = probs[k], len(_points(probs[:k]))
    n, low, high, at = (F.col(f"_{i}{x}") for x in ("n", "min", "max", "at"))
    own = _points([p])

    def point(share: float) -> Column:
        if not 0 < share < 1:
            return low if share <= 0 else high
        return F.get(at, F.lit(first + own.index(share)))

    lower = F.when(n <= WHOLE, low).when(n <= SOME, point(p - WIDE)).otherwise(point(p - NARROW))
    upper = F.when(n <= WHOLE, high).when(n <= SOME, point(p + WIDE)).otherwise(point(p + NARROW))
    return lower, upper


def _ranked(cells: Column, rank: Column) -> Column:
    """The value at a rank (from 0) of a sorted list of (v, n)."""
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("v"))

    def step(a: Column, x: Column) -> Column:
        here = (a["seen"] <= rank) & (rank < a["seen"] + x["n"])
        return F.struct((a["seen"] + x["n"]).alias("seen"), F.when(here, x["v"]).otherwise(a["v"]).alias("v"))

    return F.aggregate(cells, start, step)["v"]


def exact_quantiles(
    df: DataFrame,
    value: Column | str,
    probs: Mapping[str, float],
    groups: Sequence[str] = (),
    few_groups: bool = False,
) -> DataFrame:
    """One column per name in ``probs``; one row per group (one row in all without groups)."""
    value = F.col(value) if isinstance(value, str) else value
    kept = df.where(value.isNotNull()) if groups else df
    return selected(kept, {"_q": value}, probs, groups, few_groups).select(*groups, "_q.*")


def quantile_values(table: DataFrame | Measured, value: Column | str, probs: Mapping[str, float]) -> Column:
    """The quantiles of a whole column as one struct-valued scalar subquery.

    For a table measured as small the built-in exact percentile does.
    """
    if isinstance(table, Measured) and table.small:
        built_in = [F.percentile(value, F.lit(p)).alias(name) for name, p in probs.items()]
        return table.df.agg(F.struct(*built_in).alias("q")).scalar()
    df = table.df if isinstance(table, Measured) else table
    value = F.col(value) if isinstance(value, str) else value
    return selected(df, {"q": value}, probs).select("q").scalar()


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Mapping[str, float]) -> Column:
    """Quantiles of several columns from the same passes: a struct of structs, as a scalar subquery."""
    found = selected(df, {c: F.col(f"`{c}`") for c in columns}, probs)
    return found.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("q")).scalar()
