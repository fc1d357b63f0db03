"""Edge rows of cases, documents, suppliers, cleaning, providers and streams."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from vouchlens.operators import cases, cleaning, consolidate, features, nested, provider_risk, suppliers
from vouchlens.roles import CaseRoles, HistoryRoles, PaymentRoles, SupplierRoles
from vouchlens.session import scratch_path, shared_folder
from vouchlens.sources import readers
from vouchlens.streaming.payments import flag_payments, write_flagged

CASES = "case_id long, tipo_caso string, nivel_complejidad string, fecha_incidencia date, monto_involucrado double, estado string, responsable string"


def test_sla_states(spark):
    now = datetime(2026, 1, 7, 12)
    day = date(2026, 1, 7)
    rows = [
        (1, "Pago Urgente", "Alto", day, 1.0, "Cerrado", "A"),
        (2, "Pago Urgente", "Alto", day, 1.0, "Abierto", "A"),  # due at 06:00
        (3, "Pago Urgente", "Medio", day, 1.0, "Abierto", "A"),  # due exactly now
        (4, "Proveedor VIP", "Bajo", day, 1.0, "Abierto", "A"),  # due in 1.5 days
        (5, "Ajuste Contable", "Alto", date(2026, 1, 8), 1.0, "Abierto", "A"),  # in 2.5 days
        (6, "Otro", "Raro", day, 1.0, "Abierto", "A"),  # 3 days by default
    ]
    flow = cases.workflow(spark.createDataFrame(rows, CASES), CaseRoles(), now).orderBy("case_id").collect()
    assert [r.estado_sla for r in flow] == ["Cumplido", "Vencido", "Por Vencer", "Por Vencer", "En Tiempo", "En Tiempo"]
    assert flow[5].sla_dias == 3.0
    assert cases.sla_at_risk(spark.createDataFrame(rows, CASES)).count() == 0


def test_routes(spark):
    amounts = [24999.99, 25000.0, 40000.0]
    rows = [
        (i, "Otro", level, date(2026, 1, 1), a, "Abierto", "A")
        for i, (level, a) in enumerate((lv, a) for lv in ("Bajo", "Medio", "Alto", "?") for a in amounts)
    ]
    got = cases.with_route(spark.createDataFrame(rows, CASES), CaseRoles()).orderBy("case_id").collect()
    two, three = "Operativo → Supervisor", "Operativo → Supervisor → Gerencia"
    assert [r.ruta_escalacion for r in got] == [
        "Operativo", two, "Operativo → Gerencia",
        two, two, three,
        three, three, three,
        "Operativo", two, "Operativo → Gerencia",
    ]


def test_urgency_bounds(spark):
    df = spark.createDataFrame([(34.9,), (35.0,), (55.0,), (75.0,), (None,)], "score_prioridad double")
    assert [r.nivel_urgencia for r in cases.with_urgency(df).collect()] == ["Bajo", "Medio", "Alto", "Crítico", "Bajo"]


def test_priority_of_worthless_cases(spark):
    rows = [(1, "Otro", "Alto", date(2026, 1, 7), 0.0, "Abierto", "A")]
    done = cases.classify(spark.createDataFrame(rows, CASES), CaseRoles(), date(2026, 1, 7)).first()
    assert done.score_prioridad == pytest.approx((3 * 0.4 + 3 * 0.1) / 3 * 100)


def document(transactions, policies=None):
    policy = {
        "authorization_limit": 5000,
        "approval_flow": ["Manager", "Director"],
        "discounts": {"early_payment": 5, "bulk_order": 10},
        "penalties": {"late_payment": 2.0},
    }
    types = {"small": policy} if policies is None else policies
    return {"payment_policies": {"policies": {"supplier_type": types}}, "transactions": transactions}


def transaction(i, **changes):
    base = {
        "transaction_id": i,
        "supplier_id": 1,
        "supplier_type": "small",
        "invoice_date": "2022-01-01",
        "due_date": "2022-01-31",
        "amount": 100.5,
        "payment_terms": "30 days",
        "status": "Paid",
        "metadata": {"created_by": "A", "created_at": "2022-01-01 10:00:00", "related_transactions": []},
    }
    return {k: v for k, v in {**base, **changes}.items() if v != "-"}


def test_one_document_per_file(spark, tmp_path):
    body = document(
        [
            transaction(1, amount=5000.0),
            transaction(2, amount=6000.25, due_date="2021-12-01", status="Overdue"),
            transaction(3, due_date="2024-01-01"),
            transaction("x", amount="y"),
            transaction(4, supplier_type="huge", amount=1e9, metadata={"related_transactions": [1, 99]}),
            transaction(4, metadata="-"),
        ]
    )
    (tmp_path / "d.json").write_text(json.dumps(body, indent=2, ensure_ascii=False))
    docs = readers.read_document_texts(spark, str(tmp_path), one_per_line=False)
    tx, pol = nested.transactions(docs), nested.policies(docs)
    kinds = nested.inconsistencies(tx, pol).collect()
    assert sorted((r.transaction_id, r.tipo_inconsistencia) for r in kinds) == [
        ("2", "EXCEDE_LIMITE"), ("2", "FECHA_INVALIDA"), ("3", "TERMINOS_INCOHERENTES"),
    ]
    over = next(r for r in kinds if r.tipo_inconsistencia == "EXCEDE_LIMITE")
    assert over.descripcion == "Monto $6000.25 excede límite $5000 para tipo 'small'"
    assert nested.duplicated_ids(tx).first().duplicados == 2
    assert [tuple(r) for r in nested.broken_references(tx).collect()] == [("4", 99)]
    assert [r.supplier_type for r in nested.unknown_supplier_types(tx, pol).collect()] == ["huge"]
    report = {tuple(r) for r in nested.structure_report(docs).collect()}
    assert ("documentos_invalidos", "0") in report
    assert ("advertencias", "transaction_id inválido: x") in report
    assert ("advertencias", "1 transacciones sin metadata") in report
    typed = readers.read_documents(spark, str(tmp_path), one_per_line=False)
    assert typed.select(F.size("transactions")).first()[0] == 6


def test_invalid_documents(spark):
    bodies = ["not json", "{}", json.dumps({"transactions": []}), json.dumps(document([], {"a": {}}))]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, doc string")
    checked = nested.required_keys(docs).orderBy("doc_id").collect()
    assert [len(r.missing_keys) for r in checked] == [2, 2, 1, 0]
    report = {tuple(r) for r in nested.structure_report(docs).collect()}
    assert ("documentos_invalidos", "3") in report
    assert ("advertencias", "Tipo 'a' no tiene campo 'penalties'") in report
    assert ("num_transacciones", "0") in report


def supplier_rows(spark, rows):
    r = SupplierRoles()
    names = [r.id, r.name, r.size, r.country, r.category, r.credit, r.performance, r.certificates]
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, "long string string string string double string string".split(), strict=True))
    return spark.createDataFrame(rows, schema)


def test_supplier_literals(spark):
    text = "{'on_time_delivery': '100%', 'quality_issues': 5, 'customer_complaints': 0}"
    df = supplier_rows(
        spark,
        [
            (1, "a", "Grande", "P", "Alto", 0.0, text, "['ISO 14001', 'None']"),
            (2, "b", "Grande", "P", "Alto", 1.0, None, None),
            (3, "c", "Grande", "P", "Alto", 1.0, "{}", "[]"),
            (4, "d", "Grande", "P", "Alto", 1.0, "{'on_time_delivery': 'n/a'}", "['None']"),
        ],
    )
    got = suppliers.parse_suppliers(df, SupplierRoles()).orderBy("ID_proveedor").collect()
    assert [(r.on_time_delivery, r.quality_issues, r.num_certificaciones) for r in got] == [
        (100, 5, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0),
    ]


def test_crosstab_has_every_company_type(spark):
    sizes = ["Grande", "Micro", None, "Micro", "Mediana"]
    df = supplier_rows(spark, [(i, "n", z, "P", "Alto", 0.0, None, None) for i, z in enumerate(sizes)]).withColumn(
        "segmento_riesgo", F.when(F.col("ID_proveedor") < 3, "Premium").otherwise("Estándar")
    )
    got = suppliers.segment_by_size(df, SupplierRoles())
    assert got.columns == ["segmento", "Grande", "Mediana", "Pequeña", "Micro", "All"]
    assert {tuple(x) for x in got.collect()} == {
        ("Premium", 1, 0, 0, 1, 2), ("Estándar", 0, 1, 0, 1, 2), ("All", 1, 1, 0, 2, 4),
    }


def test_equal_segment_edges_are_an_error(spark):
    df = spark.createDataFrame([(1.0,)] * 5, "score_riesgo double")
    with pytest.raises(Exception, match="distinct"):
        suppliers.with_segment(df).collect()


def test_credit_rounds_half_to_even_and_survives_zero(spark):
    df = supplier_rows(
        spark, [(i, "n", "Mediana", "P", "Alto", c, None, None) for i, c in enumerate([0.0, 45200.0, -100.0])]
    ).withColumns(
        {
            "segmento_riesgo": F.lit("Premium"),
            "score_performance": F.lit(45250 / 45000 * 80),
            "nivel_performance": F.lit("Bueno"),
        }
    )
    got = suppliers.credit_recommendations(df, SupplierRoles()).orderBy("ID_proveedor").collect()
    assert [r.accion_credito for r in got] == ["Aumentar", "Mantener", "Reducir"]
    assert got[1].limite_recomendado == 45200.0


def test_cleaning_order(spark):
    r = HistoryRoles()
    names = [r.date, r.supplier, r.category, r.method, r.amount, r.time, r.score, r.indicator, r.season]
    ok = ("2020-01-01", "1", "Servicios", "Cheque", "10", "1", "0.5", "Estable", "Alta")
    rows = [
        ok,
        ok,
        ("x", "1", "Servicios", "Cheque", "10", "1", "0.5", "Estable", "Alta"),
        ("2020-01-02", None, "Servicios", "Cheque", "10", "1", "0.5", "Estable", "Alta"),
        ("2020-01-03", "2", None, " Cheque ", "NaN", "1", "1.5", "Otro", "Alta"),
        ("2020-01-04", "2", "Servicios", "Cheque", "-3", "1", "0.5", "Estable", "Alta"),
        ("2020-01-05", "2", "Raro", "Cheque", "20.005", "0", "-1", "Estable", "Alta"),
    ]
    raw = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
    done = cleaning.clean(raw, r).orderBy(r.date).collect()
    assert len(done) == 3
    assert done[2][r.amount] == 10.0 and done[2][r.score] == 1.0
    assert done[2][r.category] == "Servicios" and done[2][r.indicator] == "Estable"
    report = {x.state: x for x in cleaning.quality_report(raw, cleaning.clean(raw, r)).collect()}
    assert report["initial"].duplicated_rows == 1
    assert report["removed"].total_records == 4


def test_unseen_levels(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    hot = features.one_hot(df, {"c": ["a", "b"]}).collect()
    assert [(r.c_a, r.c_b) for r in hot] == [(1, 0), (0, 0), (0, 0)]
    ranked = features.ordinal(df, {"c": ["x", "a", "y"]}).collect()
    assert [r.c_encoded for r in ranked] == [1, 1, 1]
    with pytest.raises(ValueError):
        features.fit_levels(spark.range(20).select(F.col("id").cast("string").alias("c")), ["c"], limit=10)


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    for method in ("standard", "minmax", "robust"):
        got = features.scale(df, features.fit_scaler(df, ["x"], method)).collect()
        assert [r.x_scaled for r in got] == [0.0, 0.0]


def test_provider_bounds(spark):
    df = spark.createDataFrame([(0.0,), (0.4,), (0.7,), (1.0,), (None,)], "s double")
    got = [r[0] for r in df.select(provider_risk.risk_category(F.col("s"))).collect()]
    assert got == ["alto", "medio", "bajo", "bajo", "medio"]


def test_recent_days_are_the_providers_own(spark):
    r = HistoryRoles(date="d", supplier="p", amount="a", score="s", status="none")
    rows = [(1, date(2022, 12, 31), 0.2), (1, date(2022, 10, 2), 0.4), (1, date(2022, 10, 1), 1.0), (2, date(2020, 1, 1), 0.9)]
    df = spark.createDataFrame([(p, d, 10.0, s) for p, d, s in rows], "p long, d date, a double, s double")
    got = {x.p: x.recent_performance for x in provider_risk.recent_performance(df, r).collect()}
    assert got[1] == pytest.approx(0.3) and got[2] == pytest.approx(0.9)
    scores = provider_risk.provider_scores(df, r).df
    alone = scores.where("p = 2").first()
    assert alone.amount_volatility == 0.5 and alone.payment_delay_frequency == alone.score_cumplimiento_avg
    with pytest.raises(ValueError):
        provider_risk.provider_detail(provider_risk.with_alerts(scores), "p", 77)


def test_stream_equals_batch(spark):
    from vouchlens.suite.payments import payments

    r, s = PaymentRoles(), consolidate.Settings(as_of=date(1999, 1, 1))
    batch = payments(spark, "/root/testdata/sf0.001")
    source, sink = scratch_path(spark, "in"), scratch_path(spark, "out")
    batch.write.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    query = write_flagged(flag_payments(stream, r, s), sink, scratch_path(spark, "state"))
    query.awaitTermination(120)
    flagged = flag_payments(batch, r, s)
    assert spark.read.parquet(sink).exceptAll(flagged).count() == 0
    assert spark.read.parquet(sink).count() == batch.count()


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_integrity_report_equals_its_parts(spark):
    """Repeated, missing and non-numeric ids, references to them and to nothing."""
    rows = [("1", "2,9"), ("2", None), ("2", "1,1"), ("x", "x"), ("x", "7"), (None, "9"), (None, ""), ("07", "7,07"), ("3", "3")]
    data = [(i, r, len((r or "").split(",")) if r else 0, -1.0 if k % 2 else None, date(2020, 1, 1 + k), date(2020, 1, 5), "T" if k else "U") for k, (i, r) in enumerate(rows)]
    tx = spark.createDataFrame(
        data,
        "transaction_id string, related_transactions string, num_related_transactions int, amount double, invoice_date date, due_date date, supplier_type string",
    )
    pol = spark.createDataFrame([("T",)], "supplier_type string")
    got = {(r.check, r.item): r.cases for r in nested.integrity_report(tx, pol).collect()}
    assert got["duplicados", "transaction_id"] == nested.duplicated_ids(tx).first()[0] == 6
    assert got["referencias_rotas", "total"] == nested.broken_targets(tx).agg(F.sum("veces")).first()[0]
    ranges = nested.invalid_ranges(tx).first()
    assert got["rangos_invalidos", "montos_negativos"] == ranges.montos_negativos
    assert got["rangos_invalidos", "due_date_antes_invoice"] == ranges.due_date_antes_invoice
    assert {i: n for (c, i), n in got.items() if c == "valores_nulos"} == {r.columna: r.nulos for r in nested.null_counts(tx).collect()}
    assert got["tipos_proveedor_invalidos", "U"] == 1
