"""Model features, target, encodings, scaling and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchlens.functions.columns import lookup_value
from vouchlens.plans.hash_order import dated_cuts, position_cuts, shuffled
from vouchlens.plans.lookup import lookup
from vouchlens.plans.quantiles import column_quantiles
from vouchlens.roles import ORDINAL_LEVELS, HistoryRoles

RISK_THRESHOLD = 0.5
TEST_SHARE = 0.2
SEED = 42
MAX_LEVELS = 1_000
TARGET = "risk_target"


# --- columns ----------------------------------------------------------------


def with_calendar(df: DataFrame, date: str) -> DataFrame:
    """Ten calendar features; Monday is 0, weeks are ISO weeks."""
    day = F.to_date(date)
    quarter_start = F.to_date(F.date_trunc("quarter", day))
    checks = {
        "is_month_start": F.dayofmonth(day) == 1,
        "is_month_end": day == F.last_day(day),
        "is_quarter_start": day == quarter_start,
        "is_quarter_end": day == F.last_day(F.add_months(quarter_start, 2)),
    }
    return df.withColumns(
        {
            "year": F.year(day),
            "month": F.month(day),
            "quarter": F.quarter(day),
            "day_of_week": F.weekday(day),
            "day_of_month": F.dayofmonth(day),
            "week_of_year": F.weekofyear(day),
            **{name: check.cast("int") for name, check in checks.items()},
        }
    )


def with_target(df: DataFrame, score: str, threshold: float = RISK_THRESHOLD) -> DataFrame:
    risky = F.coalesce(F.col(score) < threshold, F.lit(False))
    return df.withColumn(TARGET, risky.cast("int"))


def fit_levels(df: DataFrame, columns: Sequence[str], limit: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted levels per column. They name the output columns, so they must be few:
    more than ``limit`` is an error."""
    levels = {}
    for c in columns:
        found = df.where(F.col(c).isNotNull()).select(c).distinct().limit(limit + 1).collect()
        if len(found) > limit:
            raise ValueError(f"{c} has more than {limit} levels")
        levels[c] = sorted(row[0] for row in found)
    return levels


def one_hot(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """One 0/1 column per fitted level; a level not seen in fitting sets none."""
    return df.withColumns(
        {
            f"{c}_{level}": F.coalesce((F.col(c) == level).cast("int"), F.lit(0))
            for c, found in levels.items()
            for level in found
        }
    )


def ordinal(df: DataFrame, orders: Mapping[str, Sequence[str]] = ORDINAL_LEVELS) -> DataFrame:
    """Position in the declared order; anything else takes the middle."""
    return df.withColumns(
        {
            f"{c}_encoded": F.coalesce(
                lookup_value(F.col(c), {v: i for i, v in enumerate(order)}),
                F.lit(len(order) // 2),
            )
            for c, order in orders.items()
            if c in df.columns
        }
    )


def fit_scaler(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """One row with a (center, scale) struct per column, to keep and reuse."""
    if method == "robust":
        q = column_quantiles(df, columns, {"q1": 0.25, "mid": 0.5, "q3": 0.75})
        one = df.sparkSession.range(1).select(q.alias("q"))
        pairs = {
            c: (F.col(f"q.`{c}`.mid"), F.col(f"q.`{c}`.q3") - F.col(f"q.`{c}`.q1"))
            for c in columns
        }
    else:
        measures = []
        for i, c in enumerate(columns):
            if method == "standard":
                measures += [F.avg(c).alias(f"a{i}"), F.stddev_pop(c).alias(f"b{i}")]
            elif method == "minmax":
                measures += [F.min(c).alias(f"a{i}"), (F.max(c) - F.min(c)).alias(f"b{i}")]
            else:
                raise ValueError(f"unknown scaling method {method}")
        one = df.agg(*measures)
        pairs = {c: (F.col(f"a{i}"), F.col(f"b{i}")) for i, c in enumerate(columns)}
    return one.select(
        *[
            F.struct(
                center.cast("double").alias("center"),
                F.when(scale == 0, 1.0).otherwise(scale).cast("double").alias("scale"),
            ).alias(c)
            for c, (center, scale) in pairs.items()
        ]
    )


def scale(df: DataFrame, fitted: DataFrame) -> DataFrame:
    parameters = fitted.select(F.struct(*fitted.columns).alias("p")).scalar()
    scaled = {
        f"{c}_scaled": (F.col(c) - F.col(f"_p.`{c}`.center")) / F.col(f"_p.`{c}`.scale")
        for c in fitted.columns
    }
    return df.withColumn("_p", parameters).withColumns(scaled).drop("_p")


@dataclass(frozen=True)
class FeatureSettings:
    roles: HistoryRoles = field(default_factory=HistoryRoles)
    threshold: float = RISK_THRESHOLD
    orders: Mapping[str, Sequence[str]] = field(default_factory=lambda: ORDINAL_LEVELS)
    scaler: str = "standard"
    max_levels: int = MAX_LEVELS

    @property
    def nominal(self) -> list[str]:
        return [self.roles.category, self.roles.method]

    @property
    def numeric(self) -> list[str]:
        return [self.roles.amount, self.roles.time]


@dataclass(frozen=True)
class FittedFeatures:
    """What was learned from one table and can be applied to another."""

    settings: FeatureSettings
    levels: dict[str, list[str]]
    scaler: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.settings
        out = with_calendar(df, s.roles.date)
        out = with_target(out, s.roles.score, s.threshold)
        out = scale(ordinal(one_hot(out, self.levels), s.orders), self.scaler)
        return out.drop(*s.nominal, *s.orders, *s.numeric)

    def names(self, df: DataFrame) -> list[str]:
        """Feature columns of a transformed table, without keys, dates and target."""
        s = self.settings
        fixed = [
            "year",
            "month",
            "quarter",
            "day_of_week",
            "day_of_month",
            "week_of_year",
            "is_month_start",
            "is_month_end",
            "is_quarter_start",
            "is_quarter_end",
        ]
        made = [f"{c}_{v}" for c, found in self.levels.items() for v in found]
        made += [f"{c}_encoded" for c in s.orders] + [f"{c}_scaled" for c in s.numeric]
        return [c for c in [*fixed, *made] if c in df.columns]


def fit_features(df: DataFrame, settings: FeatureSettings) -> FittedFeatures:
    levels = fit_levels(df, settings.nominal, settings.max_levels)
    return FittedFeatures(settings, levels, fit_scaler(df, settings.numeric, settings.scaler))


# --- splits and folds -------------------------------------------------------


def temporal_split(
    df: DataFrame, date: str, key: Sequence[str], test_share: float = TEST_SHARE
) -> DataFrame:
    """Adds ``split``: the first int(n·(1-share)) rows by date train, the rest test.

    Rows of the boundary day are told apart by a hash of their key.
    """
    keyed = df.withColumns({"_day": F.to_date(date), "_h": shuffled(key)})
    position = F.array(F.floor(F.col("_total") * (1 - test_share)))
    cuts = dated_cuts(keyed, "_day", "_h", position)
    here = F.struct(F.col("_day").alias("day"), F.col("_h").alias("hash"))
    train = here <= F.get(cuts, F.lit(0))
    return keyed.withColumn("split", F.when(train, "train").otherwise("test")).drop("_day", "_h")


def _class_positions(df: DataFrame, label: str, positions: Column) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(label, F.posexplode(positions.cast("array<bigint>")).alias("j", "pos"))


def _with_cut_number(df: DataFrame, label: str, positions: DataFrame, out: str) -> DataFrame:
    """How many of its class's cuts lie before a row."""
    cuts = position_cuts(df, label, "_h", positions.where("pos > 0"))
    listed = cuts.groupBy(label).agg(F.collect_list("cut").alias("_cuts"))
    joined = lookup(df, listed, label)
    behind = F.size(F.filter("_cuts", lambda c: c < F.col("_h")))
    return joined.withColumn(out, F.when(F.col("_cuts").isNull(), 0).otherwise(behind)).drop("_cuts")


def stratified_split(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    test_share: float = TEST_SHARE,
    seed: int = SEED,
) -> DataFrame:
    """Adds ``split``: the given share of each class, in shuffled order, is test."""
    keyed = df.withColumn("_h", shuffled(key, seed))
    quota = F.array(F.floor(F.col("_n") * test_share + 0.5))
    numbered = _with_cut_number(keyed, label, _class_positions(keyed, label, quota), "_k")
    return numbered.withColumn("split", F.when(F.col("_k") == 0, "test").otherwise("train")).drop(
        "_h", "_k"
    )


def time_folds(df: DataFrame, date: str, key: Sequence[str], folds: int = 5) -> DataFrame:
    """Adds ``fold``: 1..k is the test block of that fold, 0 only ever trains.

    Fold i trains on all rows of a lower number (expanding window).
    """
    keyed = df.withColumns({"_day": F.to_date(date), "_h": shuffled(key)})
    block = F.floor(F.col("_total") / (folds + 1))
    positions = F.array(*[F.col("_total") - i * block for i in range(folds, 0, -1)])
    marked = keyed.withColumn("_cuts", dated_cuts(keyed, "_day", "_h", positions))
    here = F.struct(F.col("_day").alias("day"), F.col("_h").alias("hash"))
    # written out for each cut, as a lambda would hash the key once a cut
    behind = [F.coalesce((F.get("_cuts", F.lit(i)) < here).cast("int"), F.lit(0)) for i in range(folds)]
    return marked.withColumn("fold", reduce(Column.__add__, behind)).drop("_day", "_h", "_cuts")


def stratified_folds(
    df: DataFrame, label: str, key: Sequence[str], folds: int = 5, seed: int = SEED
) -> DataFrame:
    """Adds ``fold`` 0..k-1; each class is spread evenly in shuffled order."""
    keyed = df.withColumn("_h", shuffled(key, seed))
    n = F.col("_n")
    ends = F.array(
        *[j * F.floor(n / folds) + F.least(F.lit(j), n % folds) for j in range(1, folds)]
    )
    numbered = _with_cut_number(keyed, label, _class_positions(keyed, label, ends), "fold")
    return numbered.drop("_h")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (classes · rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    every = Window.partitionBy()
    total, classes = F.sum("rows").over(every), F.count(F.lit(1)).over(every)
    return counts.select(label, "rows", (total / (classes * F.col("rows"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, out: str = "class_weight") -> DataFrame:
    weights = class_weights(df, label).select(label, F.col("weight").alias(out))
    return lookup(df, weights, label)
