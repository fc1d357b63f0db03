"""Edge rows of the payment detectors."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from vouchlens.operators import approvers, consolidate, duplicates, outliers, row_rules
from vouchlens.roles import PAYMENTS_CSV, PaymentRoles
from vouchlens.session import scratch_path
from vouchlens.sources import readers, sinks

R = PaymentRoles()
AS_OF = date(2026, 1, 7)
S = consolidate.Settings(as_of=AS_OF)
SCHEMA = """id long, supplier long, invoice_date date, due_date date, amount double, terms string,
  status string, credit_days int, discount double, penalty double, approver string"""
BASE = {
    "id": 1,
    "supplier": 7,
    "invoice_date": date(2025, 1, 1),
    "due_date": date(2025, 1, 31),
    "amount": 100.0,
    "terms": "30 días",
    "status": "Pagado",
    "credit_days": 30,
    "discount": 0.0,
    "penalty": 0.0,
    "approver": "Ana",
}


def table(spark, *changes):
    rows = [{**BASE, "id": i + 1, **c} for i, c in enumerate(changes)]
    names = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def flags(df, made):
    rows = df.select("id", *[f.alias(n) for n, f in made.items()]).orderBy("id").collect()
    return [{n for n in made if r[n]} for r in rows]


def test_format(spark):
    df = table(
        spark,
        {},
        {"amount": 10.125},
        {"amount": 12345678.91},
        {"amount": 123456789.125},
        {"amount": None, "credit_days": None},
        {"amount": 0.0, "credit_days": 0},
        {"amount": -5.0, "credit_days": -1},
    )
    assert flags(df, row_rules.format_flags(R)) == [
        set(),
        {"excessive_decimals"},
        set(),
        {"excessive_decimals"},
        set(),
        {"zero_credit_days", "invalid_amounts"},
        {"negative_credit_days", "invalid_amounts"},
    ]
    texts = [
        r[0] for r in row_rules.detect_format(df, R).orderBy("id").select("format_description").collect()
    ]
    assert texts[0] is None
    assert texts[1] == "Monto con 3 decimales"
    assert texts[5] == "Días de crédito igual a cero; Monto igual a cero"
    assert texts[6] == "Días de crédito negativos: -1; Monto negativo: -5.0"


def test_temporal_bounds(spark):
    df = table(
        spark,
        {"due_date": date(2025, 2, 5)},  # 35 days: at the tolerance
        {"due_date": date(2025, 2, 6)},
        {"due_date": date(2024, 12, 1)},
        {"due_date": date(2027, 1, 1)},  # exactly 730 days
        {"due_date": date(2027, 1, 2)},
        {"terms": "contado"},
        {"terms": None},
        {"due_date": None},
        {"due_date": date(2025, 1, 1), "terms": "0 días"},
    )
    assert flags(df, row_rules.temporal_flags(R)) == [
        set(),
        {"inconsistent_dates"},
        {"inconsistent_dates", "inverted_dates"},
        {"inconsistent_dates"},
        {"inconsistent_dates", "excessive_difference"},
        set(),
        set(),
        set(),
        set(),
    ]
    inverted = row_rules.detect_temporal(df, R).where("id = 3").first()
    assert inverted.temporal_description == (
        "Fecha vencimiento (2024-12-01) anterior a fecha factura (2025-01-01)"
    )


def test_terms_mismatch_counts_missing_sides(spark):
    df = table(spark, {}, {"credit_days": 31}, {"terms": None}, {"credit_days": None}, {"terms": "x"})
    got = [r[0] for r in df.orderBy("id").select(row_rules.terms_mismatch(R)).collect()]
    assert got == [False, True, True, True, True]


def test_discount_bounds_and_nulls(spark):
    df = table(
        spark,
        {"discount": 15.0, "penalty": 0.0},
        {"discount": 15.1},
        {"discount": -0.1},
        {"penalty": 5.1, "status": "Pendiente"},
        {"discount": 1.0, "status": "Retrasado"},
        {"penalty": 1.0},
        {"discount": None, "penalty": None, "status": None},
    )
    assert flags(df, row_rules.discount_penalty_flags(R)) == [
        set(),
        {"invalid_discounts"},
        {"invalid_discounts"},
        {"invalid_penalties"},
        {"discount_on_delayed"},
        {"penalty_on_paid"},
        set(),
    ]


def test_cross_at_the_reference_date(spark):
    df = table(
        spark,
        {"status": "Retrasado", "due_date": AS_OF},
        {"status": "Retrasado", "due_date": date(2026, 1, 8)},
        {"status": "Pendiente", "due_date": AS_OF},
        {"status": "Pendiente", "due_date": date(2026, 1, 6)},
    )
    assert flags(df, row_rules.cross_flags(R, AS_OF)) == [
        set(),
        {"delayed_not_past_due"},
        set(),
        {"pending_past_due"},
    ]


def test_duplicates(spark):
    df = table(
        spark,
        {},
        {"id": 9, "amount": 1.0},
        {"id": 9, "amount": 2.0, "approver": "Luz"},
        {"id": 8},
        {"id": 8},
        {"id": 7, "terms": None},
        {"id": 7},
        {"id": None},
        {"id": None},
    )
    groups = {r.id: r for r in duplicates.duplicate_groups(df, R).collect()}
    assert set(groups) == {7, 8, 9}
    assert groups[9].differences == "amount, approver"
    assert groups[8].differences == "ninguna"
    assert groups[7].differences == "ninguna"  # a missing value is no second value
    found = duplicates.detect_duplicates(df, R)
    assert found.count() == 9
    assert found.where("duplicate_has_anomaly").count() == 6
    text = found.where("id = 9").first().duplicate_description
    assert text == "ID duplicado 2 veces. Diferencias en: amount, approver"
    assert {r.id for r in duplicates.critical_duplicates(duplicates.duplicate_groups(df, R)).collect()} == {9}


def test_suspicious_names(spark):
    df = table(spark, {"approver": "John Doe"}, {"approver": "TEMPORAL"}, {"approver": "Ana"}, {"approver": None})
    hits = df.orderBy("id").select(approvers.suspicious_name(F.col("approver"))).collect()
    assert [h[0] for h in hits] == [True, True, False, False]
    found = approvers.detect_approvers(df, R)
    assert found.where("approver_has_anomaly").count() == 2


def test_group_z_of_single_and_constant_groups(spark):
    df = table(
        spark,
        {"supplier": 1, "amount": 5.0},
        {"supplier": 2, "amount": 5.0},
        {"supplier": 2, "amount": 5.0},
        {"supplier": None, "amount": 1e9},
    )
    got = outliers.with_group_z(df, "supplier", "amount", "z").select("z").collect()
    assert [r.z for r in got] == [0.0] * 4


def test_invariants(spark):
    from vouchlens.suite import payments as suite

    folder = "/root/testdata/sf0.001"
    scored = suite._scored(spark, folder).cache()
    counts = {(r.detector, r.rule): r.cases for r in consolidate.breakdown(scored, R, suite.S).collect()}
    assert counts["discount_penalty", "discount_on_delayed"] == counts["cross_consistency", "delayed_with_discount"]
    assert counts["discount_penalty", "penalty_on_paid"] == counts["cross_consistency", "paid_with_penalty"]
    spread = consolidate.anomaly_distribution(scored).collect()
    assert sum(r.records for r in spread) == scored.count()
    for detector, rules in consolidate.sub_rules(R, suite.S).items():
        either = row_rules.any_of(list(rules.values()))
        assert scored.where(either != F.col(f"{detector}_has_anomaly")).count() == 0
    impact = consolidate.financial_impact(scored, R, suite.S).collect()
    assert impact[2].cases == counts["cross_consistency", "pending_past_due"]
    scored.unpersist()


def test_empty_table(spark):
    found = consolidate.detect_all(table(spark, {}).limit(0), R, S)
    stats = consolidate.detector_statistics(found).collect()
    assert [r.anomaly_percentage for r in stats] == [0.0] * 8


def test_same_rows_in_other_partitions(spark):
    from vouchlens.suite import payments as suite

    p = suite.payments(spark, "/root/testdata/sf0.001").cache()
    one = consolidate.financial_impact(consolidate.detect_all(p.coalesce(1), R, suite.S), R, suite.S)
    many = consolidate.financial_impact(consolidate.detect_all(p.repartition(13), R, suite.S), R, suite.S)
    assert one.collect() == many.collect()
    p.unpersist()


@pytest.mark.parametrize("reverse", [False, True])
def test_csv_columns_in_any_order(spark, reverse):
    from vouchlens.suite.files import _payments_csv

    df = _payments_csv(spark, "/root/testdata/sf0.001").drop("part")
    names = sorted(df.columns, reverse=reverse)
    path = scratch_path(spark, "p.csv")
    sinks.write(df.select(*names), path, "csv")
    back = readers.read_payments(spark, path)
    assert back.select(*names).exceptAll(df.select(*names)).count() == 0
    found = consolidate.detect_all(back, PAYMENTS_CSV, S)
    assert found.count() == df.count()


def test_csv_exports_are_whole_and_compressed(spark):
    """The long texts of the detectors repeat in every row."""
    path = scratch_path(spark, "export")
    text = F.concat(F.lit('says "no", twice; '), F.repeat(F.lit("días negativos, "), 20), F.col("id").cast("string"))
    rows = spark.range(0, 5000, 1, 4).select("id", text.alias("text")).union(spark.createDataFrame([(-1, None)], "id long, text string"))
    sinks.export({"one": rows, "two": rows.where("id < 10")}, path, "csv")
    back = {n: spark.read.csv(f"{path}/{n}", schema="id long, text string", header=True, escape='"') for n in ("one", "two")}
    assert back["one"].exceptAll(rows).count() == rows.exceptAll(back["one"]).count() == 0 and back["two"].count() == 11
    files = spark.read.format("binaryFile").load([f"{path}/one", f"{path}/two"]).select("path", "length").collect()
    plain = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    assert all(f.path.endswith(".csv.gz") for f in files) and sum(f.length for f in files) * 10 < plain
