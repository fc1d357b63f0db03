"""All eight detectors on one table, their statistics, impact and report tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchlens.functions.columns import (
    count_true,
    equal_width_bin,
    lookup_value,
    money_sum,
    share,
)
from vouchlens.operators import approvers, outliers, row_rules
from vouchlens.operators.duplicates import detect_duplicates, duplicate_groups, duplicate_summary
from vouchlens.plans.lookup import lookup
from vouchlens.roles import PaymentRoles

# The detectors in order, their labels and risk ratings.
DETECTORS = [
    "duplicate",
    "format",
    "temporal",
    "business_rules",
    "approver",
    "amount",
    "discount_penalty",
    "cross_consistency",
]
DETECTOR_LABELS = {
    "duplicate": "Duplicados",
    "format": "Formato",
    "temporal": "Temporales",
    "business_rules": "Reglas de Negocio",
    "approver": "Aprobador",
    "amount": "Montos",
    "discount_penalty": "Descuento/Penalización",
    "cross_consistency": "Consistencia Cruzada",
}
RISK_RATINGS = {  # detector: (impact, probability, description)
    "duplicate": (3, 2, "Transacciones duplicadas"),
    "format": (1, 3, "Errores de formato"),
    "temporal": (2, 2, "Inconsistencias temporales"),
    "business_rules": (3, 2, "Violación reglas de negocio"),
    "approver": (4, 2, "Anomalías de aprobador"),
    "amount": (4, 1, "Montos atípicos"),
    "discount_penalty": (2, 2, "Descuentos/penalizaciones"),
    "cross_consistency": (3, 3, "Inconsistencias cruzadas"),
}
IMPACT_CATEGORIES = [
    "Fuga en Descuentos Indebidos",
    "Penalizaciones Injustificadas",
    "Deuda Vencida (Liquidez)",
    "Exposicion Montos Atipicos",
    "Riesgo Doble Pago",
]


@dataclass(frozen=True)
class Settings:
    """Parameters of a detection run."""

    as_of: date
    tolerance_days: int = row_rules.TOLERANCE_DAYS
    z_threshold: float = outliers.Z_THRESHOLD
    discount_bounds: tuple[float, float] = row_rules.DISCOUNT_BOUNDS
    penalty_bounds: tuple[float, float] = row_rules.PENALTY_BOUNDS
    patterns: tuple[str, ...] = tuple(approvers.SUSPICIOUS_PATTERNS)


def sub_rules(r: PaymentRoles, s: Settings) -> dict[str, row_rules.Flags]:
    """Sub-rules per detector; the amount flags read the z-score columns."""
    return {
        "format": row_rules.format_flags(r),
        "temporal": row_rules.temporal_flags(r, s.tolerance_days),
        "amount": outliers.amount_flags(s.z_threshold),
        "discount_penalty": row_rules.discount_penalty_flags(
            r, s.discount_bounds, s.penalty_bounds
        ),
        "cross_consistency": row_rules.cross_flags(r, s.as_of),
    }


def detect_with_scores(df: DataFrame, r: PaymentRoles, s: Settings) -> DataFrame:
    """The consolidated table plus the z-score columns behind the amount rule.

    Three keyed tables (ids, suppliers, approvers) are aggregated and looked up;
    everything else is a projection over the same rows. Hot keys are counted on the rows
    as given, which costs less than on looked-up ones.
    """
    out = detect_duplicates(df, r)
    out = row_rules.detect_format(out, r)
    out = row_rules.detect_temporal(out, r, s.tolerance_days)
    out = row_rules.detect_business_rules(out, r)

    suppliers = outliers.group_spread(df, r.supplier, r.amount)
    out = lookup(out, suppliers, r.supplier, df)
    out = out.withColumn(outliers.SUPPLIER, outliers.group_z(r.amount)).drop("_mean", "_std")

    table = approvers.approver_table(df, r, list(s.patterns))
    out = approvers.mark_approvers(lookup(out, table, r.approver, df))
    out = out.withColumn(outliers.APPROVER, outliers.group_z(r.amount)).drop("_mean", "_std")

    # mean and deviation of the original rows, not of the joined ones
    out = out.withColumn(outliers.GLOBAL, outliers.global_z(df, r.amount))
    out = outliers.detect_amounts(out, r, s.z_threshold)
    out = row_rules.detect_discount_penalty(out, r, s.discount_bounds, s.penalty_bounds)
    out = row_rules.detect_cross(out, r, s.as_of)

    total = count_true([F.col(f"{d}_has_anomaly") for d in DETECTORS])
    return out.withColumn("total_anomalies", total).withColumn(
        "has_any_anomaly", F.col("total_anomalies") > 0
    )


def detect_all(df: DataFrame, r: PaymentRoles, s: Settings) -> DataFrame:
    """Original columns, three columns per detector, total and overall flag."""
    full = detect_with_scores(df, r, s)
    return full.drop(outliers.GLOBAL, outliers.SUPPLIER, outliers.APPROVER)


# --- statistics -------------------------------------------------------------


def _long(df: DataFrame, rows: list[Column], *names: str) -> DataFrame:
    return df.select(F.explode(F.array(*rows)).alias("x")).select(*[f"x.{n}" for n in names])


def detector_statistics(found: DataFrame) -> DataFrame:
    """One row per detector, from a single aggregation over the consolidated table."""
    counts = found.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(f"{d}_has_anomaly").alias(d) for d in DETECTORS],
    )
    rows = [
        F.struct(F.lit(d).alias("detector"), F.col("total"), F.col(d).alias("found"))
        for d in DETECTORS
    ]
    clean = F.col("total") - F.col("found")
    return _long(counts, rows, "detector", "total", "found").select(
        "detector",
        F.col("total").alias("total_records"),
        F.col("found").alias("anomalies_found"),
        share(F.col("found"), F.col("total"), 2).alias("anomaly_percentage"),
        clean.alias("clean_records"),
        share(clean, F.col("total"), 2).alias("clean_percentage"),
    )


def breakdown(scored: DataFrame, r: PaymentRoles, s: Settings) -> DataFrame:
    """(detector, rule, cases) for the 18 sub-rules, from one aggregation."""
    named = [(d, n, f) for d, flags in sub_rules(r, s).items() for n, f in flags.items()]
    counts = scored.agg(*[F.count_if(f).alias(f"{d}.{n}") for d, n, f in named])
    rows = [
        F.struct(
            F.lit(d).alias("detector"), F.lit(n).alias("rule"), F.col(f"`{d}.{n}`").alias("cases")
        )
        for d, n, _ in named
    ]
    return _long(counts, rows, "detector", "rule", "cases")


def detector_attributes(df: DataFrame, r: PaymentRoles, s: Settings) -> DataFrame:
    """Extra attributes of the detectors in long form (detector, attribute, value)."""
    low_d, high_d = s.discount_bounds
    low_p, high_p = s.penalty_bounds
    fixed_rows = [
        ("temporal", "tolerance_days", str(s.tolerance_days)),
        ("amount", "z_threshold", str(s.z_threshold)),
        ("discount_penalty", "discount_range", f"{low_d}-{high_d}%"),
        ("discount_penalty", "penalty_range", f"{low_p}-{high_p}%"),
        ("cross_consistency", "reference_date", s.as_of.isoformat()),
    ]
    names = ("detector", "attribute", "value")
    literals = [
        F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)])
        for row in fixed_rows
    ]
    fixed = _long(df.agg(F.count(F.lit(1)).alias("n")), literals, *names)

    stats = duplicate_summary(duplicate_groups(df, r))
    groups = _long(
        stats,
        [
            F.struct(
                F.lit("duplicate").alias("detector"),
                F.lit(c).alias("attribute"),
                F.col(c).cast("string").alias("value"),
            )
            for c in stats.columns
        ],
        *names,
    )
    judged = approvers.judged_approvers(
        approvers.approver_statistics(df, r), r, list(s.patterns)
    ).where("is_suspicious")
    each = judged.select(
        F.lit("approver").alias("detector"),
        F.lit("suspicious_approver").alias("attribute"),
        F.col(r.approver).alias("value"),
    )
    count = judged.agg(
        F.lit("approver").alias("detector"),
        F.lit("suspicious_approvers_count").alias("attribute"),
        F.count(F.lit(1)).cast("string").alias("value"),
    )
    return fixed.unionByName(groups).unionByName(count).unionByName(each)


def anomaly_distribution(found: DataFrame) -> DataFrame:
    return found.groupBy("total_anomalies").agg(F.count(F.lit(1)).alias("records"))


def global_statistics(found: DataFrame) -> DataFrame:
    total, hit = F.count(F.lit(1)), F.count_if("has_any_anomaly")
    return found.agg(
        total.alias("total_records"),
        hit.alias("records_with_anomalies"),
        (total - hit).alias("records_clean"),
        share(hit, total, 2).alias("anomaly_percentage"),
        share(total - hit, total, 2).alias("clean_percentage"),
    )


def top_anomalies(found: DataFrame, r: PaymentRoles, n: int = 10, ties: tuple[str, ...] = ()) -> DataFrame:
    return found.orderBy(F.desc("total_anomalies"), r.id, *ties).limit(n)


def summary(scored: DataFrame, r: PaymentRoles, s: Settings) -> DataFrame:
    """Everything the written report shows, as (section, item, cases), from one aggregation.

    The rows are counted by their number of anomalies (nine groups at most); the totals
    are sums over these groups.
    """
    named = [(f"breakdown.{d}", n, f) for d, flags in sub_rules(r, s).items() for n, f in flags.items()]
    named += [("detector", d, F.col(f"{d}_has_anomaly")) for d in DETECTORS]
    named += [
        ("global", "total_records", F.lit(True)),
        ("global", "records_with_anomalies", F.col("has_any_anomaly")),
        ("global", "records_clean", ~F.col("has_any_anomaly")),
    ]
    cells = scored.groupBy("total_anomalies").agg(
        F.count(F.lit(1)).alias("records"),
        *[F.count_if(flag).alias(f"n{i}") for i, (_, _, flag) in enumerate(named)],
    )

    def row(section: Column, item: Column, cases: Column) -> Column:
        return F.struct(section.alias("section"), item.alias("item"), cases.cast("bigint").alias("cases"))

    group = row(F.lit("distribution"), F.col("total_anomalies").cast("string"), F.col("records"))
    counts = cells.agg(
        F.collect_list(group).alias("groups"),
        *[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(named))],
    )
    totals = [row(F.lit(section), F.lit(item), F.col(f"n{i}")) for i, (section, item, _) in enumerate(named)]
    return counts.select(F.explode(F.concat("groups", F.array(*totals))).alias("x")).select("x.section", "x.item", "x.cases")


# --- financial impact -------------------------------------------------------


def financial_impact(found: DataFrame, r: PaymentRoles, s: Settings) -> DataFrame:
    """Five categories with amount and cases, from one aggregation of ten sums."""
    amount = F.col(r.amount)
    late_discount = row_rules.delayed_with_discount(r)
    paid_penalty = row_rules.paid_with_penalty(r)
    overdue = row_rules.cross_flags(r, s.as_of)["pending_past_due"]
    odd, copied = F.col("amount_has_anomaly"), F.col("duplicate_has_anomaly")

    def of(condition: Column, value: Column) -> Column:
        return money_sum(F.when(condition, value))

    sums = found.agg(
        of(late_discount, amount * F.col(r.discount) / 100).alias("i0"),
        of(paid_penalty, amount * F.col(r.penalty) / 100).alias("i1"),
        of(overdue, amount).alias("i2"),
        of(odd, amount).alias("i3"),
        (of(copied, amount) / 2).alias("i4"),
        *[
            F.count_if(c).cast("double").alias(f"n{i}")
            for i, c in enumerate([late_discount, paid_penalty, overdue, odd])
        ],
        (F.count_if(copied) / 2).alias("n4"),
    )
    rows = [
        F.struct(
            F.lit(name).alias("category"),
            F.col(f"i{i}").alias("estimated_impact"),
            F.col(f"n{i}").alias("cases"),
        )
        for i, name in enumerate(IMPACT_CATEGORIES)
    ]
    return _long(sums, rows, "category", "estimated_impact", "cases")


def total_impact(impact: DataFrame) -> DataFrame:
    return impact.agg(F.sum("estimated_impact").alias("total_impact"))


# --- report tables ----------------------------------------------------------


def detector_chart(found: DataFrame) -> DataFrame:
    return detector_statistics(found).select(
        lookup_value(F.col("detector"), DETECTOR_LABELS).alias("label"),
        "detector",
        "anomalies_found",
        "anomaly_percentage",
    )


def multiplicity_chart(found: DataFrame) -> DataFrame:
    return anomaly_distribution(found).where("total_anomalies > 0")


def amount_histogram(found: DataFrame, amount: str, bins: int = 50) -> DataFrame:
    edges = found.agg(F.struct(F.min(amount).alias("lo"), F.max(amount).alias("hi"))).scalar()
    binned = (
        found.where(F.col(amount).isNotNull())
        .withColumn("_e", edges)
        .withColumn("bin", equal_width_bin(F.col(amount), F.col("_e.lo"), F.col("_e.hi"), bins))
    )
    return binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("payments"), F.count_if("has_any_anomaly").alias("anomalous")
    )


def approver_chart(found: DataFrame, r: PaymentRoles) -> DataFrame:
    """Without the duplicated payments."""
    return (
        found.where(~F.col("duplicate_has_anomaly") & F.col(r.approver).isNotNull())
        .groupBy(F.col(r.approver).alias("approver"))
        .agg(
            F.count(r.id).alias("payments"),
            money_sum(F.col(r.amount)).alias("total_amount"),
            F.count_if("has_any_anomaly").alias("anomalous"),
        )
    )


def monthly_chart(found: DataFrame, r: PaymentRoles) -> DataFrame:
    return (
        found.where("has_any_anomaly")
        .groupBy(F.date_format(r.invoice, "yyyy-MM").alias("month"))
        .agg(
            F.count(r.id).alias("records"),
            F.sum("total_anomalies").alias("total_anomalies"),
        )
        .where("month IS NOT NULL")
    )


def state_chart(found: DataFrame, r: PaymentRoles) -> DataFrame:
    return (
        found.where(F.col(r.status).isNotNull())
        .groupBy(F.col(r.status).alias("status"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if("has_any_anomaly").alias("with_anomalies"),
            F.count_if(~F.col("has_any_anomaly")).alias("without_anomalies"),
        )
    )


def rule_tree(scored: DataFrame, r: PaymentRoles, s: Settings) -> DataFrame:
    """Detector, rule and cases with display names; empty tree falls back to totals."""
    title = F.initcap(F.replace(F.col("detector"), F.lit("_"), F.lit(" ")))
    return breakdown(scored, r, s).select(
        title.alias("detector"), F.coalesce("rule", F.lit("Total")).alias("rule"), "cases"
    )


def risk_matrix(found: DataFrame) -> DataFrame:
    key = F.col("detector")

    def rated(i: int) -> Column:
        return lookup_value(key, {d: v[i] for d, v in RISK_RATINGS.items()})

    return detector_statistics(found).select(
        lookup_value(key, DETECTOR_LABELS).alias("label"),
        F.col("anomalies_found").alias("cases"),
        rated(0).alias("impact"),
        rated(1).alias("probability"),
        (rated(0) * rated(1)).alias("risk"),
        rated(2).alias("description"),
    )
