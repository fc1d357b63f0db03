"""Small column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,6)"
UNIT = "decimal(28,12)"


def flag(predicate: Column) -> Column:
    """A comparison with a missing value counts as false."""
    return F.coalesce(predicate, F.lit(False))


def any_of(flags: list[Column]) -> Column:
    return reduce(or_, flags)


def count_true(flags: list[Column]) -> Column:
    return reduce(add, [f.cast("int") for f in flags])


def joined_text(parts: list[Column], sep: str = "; ") -> Column:
    """Non-null parts joined in order; null when none applies."""
    return F.nullif(F.concat_ws(sep, *parts), F.lit(""))


def text(template: str, *values: Column) -> Column:
    """``{}`` in the template is replaced by the values, printed as strings."""
    pieces = template.split("{}")
    cols: list[Column] = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        cols += [value.cast("string"), F.lit(piece)]
    return F.concat(*cols)


def fixed(value: Column, digits: int) -> Column:
    """Rounds the exact binary value half to even, which ``format_string`` does not."""
    return F.replace(F.format_number(value.cast("double"), digits), F.lit(","), F.lit(""))


def digits_in(terms: Column) -> Column:
    """First run of digits in a payment term such as ``30 días``; null without one."""
    return F.regexp_extract(terms, r"(\d+)", 1).try_cast("int")


def money_sum(amount: Column) -> Column:
    """Sum kept exact, so that the order of rows and retries do not matter."""
    return F.coalesce(F.sum(amount.cast(MONEY)).cast("double"), F.lit(0.0))


def money_mean(amount: Column) -> Column:
    return F.try_divide(F.sum(amount.cast(MONEY)).cast("double"), F.count(amount))


def unit_sum(score: Column) -> Column:
    """Exact sum of scores and probabilities, independent of the order of rows."""
    return F.sum(score.cast(UNIT)).cast("double")


def unit_mean(score: Column) -> Column:
    return F.try_divide(unit_sum(score), F.count(score))


def share(part: Column, whole: Column, digits: int | None = None) -> Column:
    """Percentage of ``part`` in ``whole``; zero for an empty whole."""
    pct = F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))
    return pct if digits is None else F.bround(pct, digits)


def lookup_value(key: Column, table: dict, default=None) -> Column:
    """A fixed lookup table as one expression."""
    chain = None
    for k, v in table.items():
        chain = F.when(key == k, F.lit(v)) if chain is None else chain.when(key == k, F.lit(v))
    return chain if default is None else chain.otherwise(F.lit(default))


def present(entries: list[Column]) -> Column:
    """Array of the entries that are not null."""
    return F.filter(F.array(*entries), lambda e: e.isNotNull())


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin 0..bins-1; the last bin holds its upper edge, a missing value has none."""
    raw = F.floor((value - low) * F.lit(float(bins)) / (high - low))
    found = F.when(high == low, F.lit(bins // 2)).otherwise(F.least(raw, F.lit(bins - 1))).cast("bigint")
    return F.when(value.isNotNull(), found)


def clipped(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """The value within bounds; a missing one stays missing."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))
