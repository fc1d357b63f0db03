"""Detectors that look at one payment at a time.

Each ``*_flags`` function returns the sub-rules by name; each ``detect_*`` function
adds the three standard columns of its detector. Nothing here shuffles, and all
of it also runs on a stream.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchlens.functions.columns import any_of, digits_in, flag, joined_text, text
from vouchlens.roles import PaymentRoles

Flags = dict[str, Column]

# The rule bounds.
TOLERANCE_DAYS = 5
EXCESSIVE_DAYS = 730
DISCOUNT_BOUNDS = (0, 15)
PENALTY_BOUNDS = (0, 5)


def standard_columns(
    df: DataFrame, name: str, kind: str, found: Column, description: Column
) -> DataFrame:
    """``{name}_has_anomaly``, ``{name}_type`` and ``{name}_description``."""
    return df.withColumns(
        {
            f"{name}_has_anomaly": found,
            f"{name}_type": F.when(found, F.lit(kind)),
            f"{name}_description": F.when(found, description),
        }
    )


# --- format -----------------------------------------------------------------


def format_flags(r: PaymentRoles) -> Flags:
    amount, days = F.col(r.amount), F.col(r.credit_days)
    return {
        # rounding works on the shortest decimal text of the double, so it
        # differs exactly when that text has more than two decimals
        "excessive_decimals": flag(amount != F.round(amount, 2)),
        "negative_credit_days": flag(days < 0),
        "zero_credit_days": flag(days == 0),
        "invalid_amounts": flag(amount <= 0),
    }


def decimals_of(amount: Column) -> Column:
    """Number of decimals, free of exponent notation."""
    fraction = F.substring_index(amount.cast("decimal(38,18)").cast("string"), ".", -1)
    return F.length(F.rtrim(fraction, F.lit("0")))


def detect_format(df: DataFrame, r: PaymentRoles) -> DataFrame:
    f = format_flags(r)
    amount = F.col(r.amount)
    description = joined_text(
        [
            F.when(f["excessive_decimals"], text("Monto con {} decimales", decimals_of(amount))),
            F.when(
                f["negative_credit_days"],
                text("Días de crédito negativos: {}", F.col(r.credit_days)),
            ),
            F.when(f["zero_credit_days"], F.lit("Días de crédito igual a cero")),
            F.when(
                f["invalid_amounts"],
                F.when(amount < 0, text("Monto negativo: {}", amount)).otherwise(
                    F.lit("Monto igual a cero")
                ),
            ),
        ]
    )
    return standard_columns(df, "format", "FORMAT_ANOMALY", any_of(list(f.values())), description)


# --- temporal ---------------------------------------------------------------


def expected_days(r: PaymentRoles) -> Column:
    return digits_in(F.col(r.terms))


def actual_days(r: PaymentRoles) -> Column:
    return F.datediff(F.col(r.due), F.col(r.invoice))


def temporal_flags(r: PaymentRoles, tolerance_days: int = TOLERANCE_DAYS) -> Flags:
    real = actual_days(r)
    return {
        "inconsistent_dates": flag(F.abs(real - expected_days(r)) > tolerance_days),
        "inverted_dates": flag(F.col(r.due) < F.col(r.invoice)),
        "excessive_difference": flag(real > EXCESSIVE_DAYS),
    }


def detect_temporal(
    df: DataFrame, r: PaymentRoles, tolerance_days: int = TOLERANCE_DAYS
) -> DataFrame:
    """An inverted pair of dates hides the other two texts, but not their flags."""
    f = temporal_flags(r, tolerance_days)
    real, expected = actual_days(r), expected_days(r)
    ordered = ~f["inverted_dates"]
    description = joined_text(
        [
            F.when(
                f["inverted_dates"],
                text(
                    "Fecha vencimiento ({}) anterior a fecha factura ({})",
                    F.to_date(r.due),
                    F.to_date(r.invoice),
                ),
            ),
            F.when(
                f["inconsistent_dates"] & ordered,
                text(
                    "Diferencia real ({} días) vs esperada ({} días): {} días de diferencia",
                    real,
                    expected,
                    F.abs(real - expected),
                ),
            ),
            F.when(
                f["excessive_difference"] & ordered,
                text("Diferencia excesiva: {} días (>2 años)", real),
            ),
        ]
    )
    return standard_columns(
        df, "temporal", "TEMPORAL_ANOMALY", any_of(list(f.values())), description
    )


# --- business rule ----------------------------------------------------------


def terms_mismatch(r: PaymentRoles) -> Column:
    """Terms and granted credit differ; a missing side counts as different."""
    expected, days = expected_days(r), F.col(r.credit_days)
    return expected.isNull() | days.isNull() | (expected != days)


def detect_business_rules(df: DataFrame, r: PaymentRoles) -> DataFrame:
    description = text(
        "Inconsistencia: condiciones '{}' (esperado: {} días) vs dias_credito otorgados: {} días",
        F.coalesce(F.col(r.terms), F.lit("nan")),
        F.coalesce(expected_days(r).cast("string"), F.lit("nan")),
        F.coalesce(F.col(r.credit_days).cast("string"), F.lit("nan")),
    )
    return standard_columns(
        df, "business_rules", "PAYMENT_TERMS_INCONSISTENCY", terms_mismatch(r), description
    )


# --- discount and penalty ---------------------------------------------------


def outside(value: Column, bounds: tuple[float, float]) -> Column:
    return flag((value < bounds[0]) | (value > bounds[1]))


def delayed_with_discount(r: PaymentRoles) -> Column:
    return flag((F.col(r.status) == r.delayed) & (F.col(r.discount) > 0))


def paid_with_penalty(r: PaymentRoles) -> Column:
    return flag((F.col(r.status) == r.paid) & (F.col(r.penalty) > 0))


def discount_penalty_flags(
    r: PaymentRoles,
    discount_bounds: tuple[float, float] = DISCOUNT_BOUNDS,
    penalty_bounds: tuple[float, float] = PENALTY_BOUNDS,
) -> Flags:
    return {
        "invalid_discounts": outside(F.col(r.discount), discount_bounds),
        "invalid_penalties": outside(F.col(r.penalty), penalty_bounds),
        "discount_on_delayed": delayed_with_discount(r),
        "penalty_on_paid": paid_with_penalty(r),
    }


def detect_discount_penalty(
    df: DataFrame,
    r: PaymentRoles,
    discount_bounds: tuple[float, float] = DISCOUNT_BOUNDS,
    penalty_bounds: tuple[float, float] = PENALTY_BOUNDS,
) -> DataFrame:
    f = discount_penalty_flags(r, discount_bounds, penalty_bounds)
    discount, penalty = F.col(r.discount), F.col(r.penalty)
    low_d, high_d = discount_bounds
    low_p, high_p = penalty_bounds
    description = joined_text(
        [
            F.when(
                f["invalid_discounts"],
                text(f"Descuento fuera de rango ({low_d}-{high_d}%): {{}}%", discount),
            ),
            F.when(
                f["invalid_penalties"],
                text(f"Penalización fuera de rango ({low_p}-{high_p}%): {{}}%", penalty),
            ),
            F.when(
                f["discount_on_delayed"],
                text("Descuento de {}% aplicado a pago retrasado (ilógico)", discount),
            ),
            F.when(
                f["penalty_on_paid"],
                text("Penalización de {}% en pago marcado como pagado (ilógico)", penalty),
            ),
        ]
    )
    return standard_columns(
        df, "discount_penalty", "DISCOUNT_PENALTY_ANOMALY", any_of(list(f.values())), description
    )


# --- cross consistency ------------------------------------------------------


def cross_flags(r: PaymentRoles, as_of: date) -> Flags:
    due, status = F.col(r.due), F.col(r.status)
    return {
        "delayed_not_past_due": flag((status == r.delayed) & (due > F.lit(as_of))),
        "pending_past_due": flag((status == r.pending) & (due < F.lit(as_of))),
        "paid_with_penalty": paid_with_penalty(r),
        "delayed_with_discount": delayed_with_discount(r),
    }


def detect_cross(df: DataFrame, r: PaymentRoles, as_of: date) -> DataFrame:
    f = cross_flags(r, as_of)
    due = F.to_date(r.due)
    description = joined_text(
        [
            F.when(
                f["delayed_not_past_due"],
                text(f"Marcado como '{r.delayed}' pero vence en fecha futura ({{}})", due),
            ),
            F.when(
                f["pending_past_due"],
                text(f"Marcado como '{r.pending}' pero ya venció ({{}})", due),
            ),
            F.when(
                f["paid_with_penalty"],
                text(
                    f"Marcado como '{r.paid}' pero tiene penalización por mora ({{}}%)",
                    F.col(r.penalty),
                ),
            ),
            F.when(
                f["delayed_with_discount"],
                text(
                    f"Marcado como '{r.delayed}' pero tiene descuento pronto pago ({{}}%)",
                    F.col(r.discount),
                ),
            ),
        ]
    )
    return standard_columns(
        df,
        "cross_consistency",
        "CROSS_CONSISTENCY_ANOMALY",
        any_of(list(f.values())),
        description,
    )
