"""The stateless detectors on a stream of payments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vouchlens.operators import row_rules
from vouchlens.operators.consolidate import Settings
from vouchlens.roles import PaymentRoles


def flag_payments(payments: DataFrame, r: PaymentRoles, s: Settings) -> DataFrame:
    """Format, temporal, terms, discount and cross rules; they look at one row only.

    Duplicates, approvers and amounts compare rows with each other and need a batch.
    """
    out = row_rules.detect_format(payments, r)
    out = row_rules.detect_temporal(out, r, s.tolerance_days)
    out = row_rules.detect_business_rules(out, r)
    out = row_rules.detect_discount_penalty(out, r, s.discount_bounds, s.penalty_bounds)
    return row_rules.detect_cross(out, r, s.as_of)


def write_flagged(flagged: DataFrame, folder: str, state: str) -> StreamingQuery:
    """Appends to a table; ``state`` is the query's own checkpoint folder."""
    return (
        flagged.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", state)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
