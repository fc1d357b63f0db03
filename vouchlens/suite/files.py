"""Queries that write the derived tables to files and read them back (IO)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchlens.operators.cases import prepare
from vouchlens.operators.suppliers import parse_suppliers
from vouchlens.roles import PAYMENTS_CSV, CaseRoles, SupplierRoles
from vouchlens.session import scratch_path
from vouchlens.sources import readers, sinks
from vouchlens.sources.digests import content, content_sql
from vouchlens.sources.role_views import cases, history, payments, policy_documents, suppliers
from vouchlens.suite import cases as case_suite
from vouchlens.suite import history as history_suite
from vouchlens.suite import nested as nested_suite
from vouchlens.suite import payments as payment_suite
from vouchlens.suite import providers as provider_suite
from vouchlens.suite import suppliers as supplier_suite
from vouchlens.suite.sql import HISTORY


def _payments_csv(s, d):
    """The payments under the names of the CSV file."""
    names = {
        getattr(payment_suite.R, role): getattr(PAYMENTS_CSV, role)
        for role in "id supplier invoice due amount terms credit_days status discount penalty approver".split()
    }
    return payments(s, d).withColumnsRenamed(names).withColumn("metodo_pago", F.lit("Cheque"))


def _io1(s, d):
    path = scratch_path(s, "payments.csv")
    sinks.write(_payments_csv(s, d), path, "csv")
    return readers.read_payments(s, path).withColumns(
        {c: F.col(c).cast("string") for c in ("fecha_factura", "fecha_vencimiento")}
    )


def _io2(s, d):
    path = scratch_path(s, "history.csv")
    h = history(s, d)
    sinks.write(
        h.select(
            F.col("date").alias("fecha"),
            F.col("supplier").alias("proveedor_id"),
            F.col("category").alias("categoria_gasto"),
            F.col("method").alias("método_pago"),
            F.col("amount").cast("decimal(18,2)").alias("monto"),
            F.col("time").cast("int").alias("tiempo_procesamiento"),
            F.col("score").cast("decimal(3,1)").alias("score_cumplimiento"),
            F.col("indicator").alias("indicadores_economicos"),
            F.col("season").alias("estacionalidad"),
        ),
        path,
        "csv",
    )
    return readers.read_history(s, path).withColumnsRenamed(
        {"método_pago": "metodo_pago"}
    )


def _io5(s, d):
    path = scratch_path(s, "documents")
    policy_documents(s, d).select("doc").write.text(path)
    docs = readers.read_documents(s, path)
    return docs.select(
        F.explode("transactions").alias("t"), F.col("payment_policies").isNotNull().alias("has_policy")
    ).select("t.supplier_id", "t.supplier_type", "t.status", "t.due_date", "has_policy")


MALFORMED = "malformed_line"


def _suppliers_csv(s, d):
    """The suppliers as a CSV file of text; by rule some credit limits are no numbers."""
    path, r = scratch_path(s, "suppliers.csv"), SupplierRoles()
    own = supplier_suite.R
    key = F.col(own.id)
    names = {getattr(own, role): getattr(r, role) for role in "id name size country category credit performance certificates".split()}
    rows = suppliers(s, d).withColumn(own.credit, F.when(key % 7 == 3, "sin límite").otherwise(F.col(own.credit).cast("string")))
    more = {c: F.lit("-") for c in ("contactos_emergencia", "condiciones_negociadas")} | {"descuentos_especiales": F.lit("5")}
    sinks.write(rows.withColumnsRenamed(names).select(*names.values(), *[v.alias(c) for c, v in more.items()]), path, "csv")
    return readers.read_suppliers(s, path, MALFORMED)


def _io3(s, d):
    r = SupplierRoles()
    return parse_suppliers(_suppliers_csv(s, d), r).select(
        F.col(r.id).alias("supplier"),
        F.col(r.credit).alias("credit"),
        "on_time_delivery",
        F.array_join("certificaciones_list", ",").alias("certificates"),
        "num_certificaciones",
        F.col(MALFORMED).isNotNull().alias("malformed"),
    )


def _cases_csv(s, d):
    """The cases as a CSV file of text; by rule some dates and amounts can't be read."""
    path, r, own = scratch_path(s, "cases.csv"), CaseRoles(), case_suite.R
    key = F.col("case_id")
    names = {getattr(own, role): getattr(r, role) for role in "type complexity date amount state assignee".split()}
    rows = cases(s, d).withColumns(
        {
            own.date: F.when(key % 13 == 0, "ayer").otherwise(F.date_format(own.date, "yyyy-MM-dd")),
            own.amount: F.when(key % 11 == 0, "mucho").otherwise(F.col(own.amount).cast("string")),
            own.state: F.concat(F.lit(" "), F.col(own.state)),
        }
    )
    texts = {"descripcion": F.concat(F.lit('a, "'), key.cast("string"), F.lit('"')), "comentarios": F.lit("-")}
    sinks.write(rows.withColumnsRenamed(names).select(*names.values(), *[v.alias(c) for c, v in texts.items()]), path, "csv")
    return readers.read_cases(s, path, MALFORMED)


def _io4(s, d):
    r = CaseRoles()
    ready = prepare(_cases_csv(s, d), r, case_suite.DAY)
    return ready.select(
        *[F.col(getattr(r, role)).alias(role) for role in "type complexity amount state assignee".split()],
        F.col(r.date).cast("string").alias("date"),
        "dias_antiguedad",
        "descripcion",
        F.col(MALFORMED).isNotNull().alias("malformed"),
    )


def _malformed(s, d):
    """Rows and malformed rows of both files."""
    files = {"suppliers": _suppliers_csv(s, d), "cases": _cases_csv(s, d)}
    counted = [readers.malformed_counts(df, MALFORMED).select(F.lit(n).alias("file"), "*") for n, df in files.items()]
    return reduce(DataFrame.unionByName, counted)


#: Columns by which each written table is compared (``:n`` for numbers), and the query that has its rows in SQL.
CONTENTS = {
    "anomalies_full": "id:n part:n supplier:n amount:n total_anomalies:n has_any_anomaly",
    "anomalies_only": "id:n part:n supplier:n amount:n total_anomalies:n has_any_anomaly",
    "statistics": "section item cases:n",
    "financial_impact": "category estimated_impact:n cases:n",
    "preprocessed": "id:n part:n risk_target:n amount_scaled:n indicator_encoded:n",
    "train": "id:n part:n risk_target:n amount_scaled:n indicator_encoded:n",
    "test": "id:n part:n risk_target:n amount_scaled:n indicator_encoded:n",
    "segmentacion": "supplier:n score_performance:n nivel_performance score_riesgo:n segmento_riesgo num_certificaciones:n",
    "matriz_aprobacion": "segmento limite_credito_max:n condiciones_pago descuento_maximo:n requiere_aprobacion num_proveedores:n",
    "recomendaciones_credito": "supplier:n size country segmento_riesgo nivel_performance credit:n limite_recomendado:n accion_credito",
    "politicas_pago": "supplier_type authorization_limit:n discount_bulk_order:n",
    "transacciones": "transaction_id supplier_id:n supplier_type amount:n payment_terms status num_related_transactions:n",
    "inconsistencias": "transaction_id tipo_inconsistencia descripcion severidad limite:n exceso:n",
    "validacion_estructura": "section item",
    "validacion_integridad": "check item cases:n",
    "casos_clasificados": "case_id:n score_prioridad:n nivel_urgencia segmento_riesgo",
    "flujo_trabajo": "type complexity amount:n state assignee ruta_escalacion sla_dias:n estado_sla",
    "tendencias_tipo": "tipo_caso total_casos:n monto_total:n casos_abiertos:n casos_alta_complejidad:n porcentaje:n tasa_resolucion:n",
    "reporte_responsables": "responsable total_casos:n casos_cerrados:n monto_gestionado:n tasa_resolucion:n score_eficiencia:n",
    "matriz_escalacion": "tipo_caso complejidad sla_dias:n sla_horas:n nivel_1_operativo nivel_2_supervisor nivel_3_gerencia aprobadores_requeridos:n",
    "casos_criticos": "case_id:n razon_critico",
    "metricas_responsables": "responsable total_casos:n alta_complejidad:n monto_total:n promedio_antiguedad:n indice_carga:n",
}


def _contents(s, folder, tables, kind="parquet") -> DataFrame:
    """Rows and digest of each written table, read from the files."""

    def one(name):
        options = {"header": True, "escape": '"'} if kind == "csv" else {}
        df = s.read.options(**options).format(kind).load(f"{folder}/{name}")
        return content(df, CONTENTS[name]).select(F.lit(name).alias("name"), "rows", "digest")

    return reduce(DataFrame.unionByName, [one(n) for n in tables])


def _exported(s, tables, name, kind="parquet"):
    folder = scratch_path(s, name)
    sinks.export(tables, folder, kind)
    return _contents(s, folder, tables, kind)


def _io6(s, d):
    scored = payment_suite._scored(s, d)
    return _exported(s, sinks.anomaly_tables(scored, payment_suite.R, payment_suite.S), "anomalies", "csv")


def _io6_anomalies(s, d):
    folder = scratch_path(s, "anomalies")
    tables = sinks.anomaly_tables(payment_suite._scored(s, d), payment_suite.R, payment_suite.S)
    sinks.export({"anomalies_only": tables["anomalies_only"]}, folder)
    return s.read.parquet(f"{folder}/anomalies_only").select("id", "part", "total_anomalies")


def _io8(s, d):
    rows = history_suite.QUERIES["F9_features_and_split"](s, d)
    return _exported(s, sinks.split_tables(rows), "splits")


def _io9(s, d):
    folder = scratch_path(s, "providers")
    sinks.export_providers(provider_suite._alerted(s, d), "supplier", folder)
    scores = s.read.parquet(f"{folder}/scores")
    alerts = s.read.json(f"{folder}/alerts", schema="supplier bigint, alert_count int")
    return (
        scores.select("supplier", "risk_category", "risk_rank")
        .join(alerts, "supplier", "left")
        .withColumn("alert_count", F.coalesce("alert_count", F.lit(0)))
    )


def _io11(s, d):
    tables = dict(sinks.document_tables(policy_documents(s, d)))
    return _exported(s, tables, "documents")


QUERIES = {
    "IO1_payments_csv": _io1,
    "IO2_history_csv": _io2,
    "IO3_suppliers_csv": _io3,
    "IO4_cases_csv": _io4,
    "IO4_malformed_rows": _malformed,
    "IO5_nested_json": _io5,
    "IO6_export_anomalies": _io6,
    "IO6_anomalies_only": _io6_anomalies,
    "IO8_export_splits": _io8,
    "IO9_export_providers": _io9,
    "IO10_export_suppliers": lambda s, d: _exported(
        s, sinks.supplier_tables(supplier_suite._done(s, d), supplier_suite.R), "suppliers"
    ),
    "IO11_export_documents": _io11,
    "IO12_export_cases": lambda s, d: _exported(
        s,
        sinks.case_tables(case_suite._classified(s, d), case_suite.R, case_suite.NOW),
        "cases",
    ),
}


def _written(**sources):
    """Rows and digest of each table from the SQL of its rows."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS name, * FROM ({content_sql(source, CONTENTS[name])})" for name, source in sources.items()
    )


_P, _S, _J = payment_suite.CHAIN, supplier_suite.CHAIN, nested_suite.CHAIN
_F9 = history_suite.SQL["F9_features_and_split"]
SQL = {
    "IO1_payments_csv": _P
    + """SELECT id AS "ID_transaccion", supplier AS proveedor_id, CAST(invoice_date AS VARCHAR) AS fecha_factura,
        CAST(due_date AS VARCHAR) AS fecha_vencimiento, amount AS monto, terms AS condiciones_pago, status AS estado_pago,
        credit_days AS dias_credito, discount AS descuento_pronto_pago, penalty AS penalizacion_mora, 'Cheque' AS metodo_pago,
        approver AS aprobador FROM payments""",
    "IO2_history_csv": f"""WITH {HISTORY} SELECT CAST(date AS VARCHAR) AS fecha, CAST(supplier AS VARCHAR) AS proveedor_id,
        category AS categoria_gasto, method AS metodo_pago, CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR) AS monto,
        CAST(CAST(time AS INTEGER) AS VARCHAR) AS tiempo_procesamiento, CAST(CAST(score AS DECIMAL(3,1)) AS VARCHAR) AS score_cumplimiento,
        indicator AS indicadores_economicos, season AS estacionalidad FROM history""",
    "IO3_suppliers_csv": _S
    + """SELECT supplier, CASE WHEN supplier % 7 <> 3 THEN credit END AS credit, on_time_delivery, array_to_string(certs, ',') AS certificates,
        num_certificaciones, supplier % 7 = 3 AS malformed FROM parsed""",
    "IO4_cases_csv": case_suite.CHAIN
    + """SELECT type, complexity, CASE WHEN case_id % 11 <> 0 THEN amount END AS amount, state, assignee,
        CASE WHEN case_id % 13 <> 0 THEN CAST(CAST(date AS DATE) AS VARCHAR) END AS date,
        CASE WHEN case_id % 13 <> 0 THEN dias_antiguedad END AS dias_antiguedad,
        'a, "' || case_id || '"' AS descripcion, case_id % 13 = 0 OR case_id % 11 = 0 AS malformed FROM cases""",
    "IO4_malformed_rows": """SELECT 'suppliers' AS file, count(*) AS rows, count(*) FILTER (s_suppkey % 7 = 3) AS malformed FROM supplier
      UNION ALL SELECT 'cases', count(*), count(*) FILTER (o_orderkey % 13 = 0 OR o_orderkey % 11 = 0) FROM orders""",
    "IO5_nested_json": _J
    + """SELECT supplier_id, supplier_type, status, CASE WHEN k % 53 = 0 THEN 'pronto' ELSE CAST(due_date AS VARCHAR) END AS due_date,
        k % 59 <> 0 AS has_policy FROM d""",
    "IO6_export_anomalies": _written(
        anomalies_full=_P + "SELECT * FROM found",
        anomalies_only=_P + "SELECT * FROM found WHERE has_any_anomaly",
        statistics=payment_suite.SQL["C8_summary"],
        financial_impact=payment_suite.SQL["C9_financial_impact"],
    ),
    "IO6_anomalies_only": _P + "SELECT id, part, total_anomalies FROM found WHERE has_any_anomaly",
    "IO8_export_splits": _written(
        preprocessed=_F9,
        train=f"SELECT * FROM ({_F9}) WHERE split = 'train'",
        test=f"SELECT * FROM ({_F9}) WHERE split = 'test'",
    ),
    "IO9_export_providers": provider_suite._A
    + """SELECT supplier, risk_category, risk_rank,
        (SELECT CAST(count(*) AS INTEGER) FROM alerts WHERE alerts.supplier = scores.supplier) AS alert_count FROM scores""",
    "IO10_export_suppliers": _written(
        segmentacion=_S + "SELECT * FROM done",
        matriz_aprobacion=supplier_suite.SQL["S9_approval_matrix"],
        recomendaciones_credito=supplier_suite.SQL["S10_credit_recommendations"],
    ),
    "IO11_export_documents": _written(
        politicas_pago=nested_suite.SQL["J7_policies"],
        transacciones=nested_suite.SQL["J8_transactions"],
        inconsistencias=nested_suite.SQL["J19_inconsistencies"],
        validacion_estructura=nested_suite.SQL["J6_structure_report"],
        validacion_integridad=nested_suite.SQL["J15_integrity_report"],
    ),
    "IO12_export_cases": _written(
        casos_clasificados=case_suite.SQL["X5_classified_cases"],
        flujo_trabajo=case_suite.SQL["X10_workflow"],
        tendencias_tipo=case_suite.SQL["X19_type_trends"],
        reporte_responsables=case_suite.SQL["X20_assignee_report"],
        matriz_escalacion=case_suite.SQL["X6_escalation_matrix"],
        casos_criticos=case_suite.SQL["X12_critical_cases"],
        metricas_responsables=case_suite.SQL["X14_assignee_load"],
    ),
}
