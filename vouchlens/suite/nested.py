"""Queries on nested documents (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchlens.operators import nested as op
from vouchlens.sources.role_views import policy_documents
from vouchlens.suite.sql import exact_mean, exact_sum

_docs = policy_documents


def _valid(s, d):
    return op.valid_documents(_docs(s, d))


def _raw(s, d):
    return op.raw_transactions(_valid(s, d))


def _tx(s, d):
    return op.transactions(_docs(s, d))


def _pol(s, d):
    return op.policies(_docs(s, d))


def _printed(df):
    return df.withColumns(
        {
            "invoice_date": F.col("invoice_date").cast("string"),
            "due_date": F.col("due_date").cast("string"),
            "created_at": F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"),
        }
    )


def _flags(s, d, kind):
    return op.inconsistencies(_tx(s, d), _pol(s, d)).where(F.col("tipo_inconsistencia") == kind)


QUERIES = {
    "J1_required_keys": lambda s, d: op.required_keys(_docs(s, d)).select(
        "doc_id", F.array_join("missing_keys", ",").alias("missing_keys"), "estructura_valida"
    ),
    "J2_missing_policy_fields": lambda s, d: op.missing_policy_fields(op.raw_policies(_valid(s, d))),
    "J2_policy_types": lambda s, d: op.policy_types(op.raw_policies(_valid(s, d))),
    "J3_missing_transaction_fields": lambda s, d: op.missing_transaction_fields(_raw(s, d)),
    "J4_type_errors": lambda s, d: op.type_errors(_raw(s, d)).select("doc_id", "message"),
    "J4_type_warnings": lambda s, d: op.type_warnings(op.type_errors(_raw(s, d))),
    "J5_without_metadata": lambda s, d: op.without_metadata(_raw(s, d)),
    "J6_structure_report": lambda s, d: op.structure_report(_docs(s, d)),
    "J7_policies": lambda s, d: _pol(s, d),
    "J8_transactions": lambda s, d: _printed(_tx(s, d)).drop("days_until_due", "payment_terms_days"),
    "J9_derived_days": lambda s, d: _tx(s, d)
    .select(
        "transaction_id",
        F.coalesce("days_until_due", F.lit(-99999)).alias("days_until_due"),
        F.coalesce("payment_terms_days", F.lit(-1)).alias("payment_terms_days"),
    ),
    "J10_duplicated_ids": lambda s, d: op.duplicated_ids(_tx(s, d)),
    "J11_null_counts": lambda s, d: op.null_counts(_tx(s, d)),
    "J12_invalid_ranges": lambda s, d: op.invalid_ranges(_tx(s, d)),
    "J13_unknown_supplier_types": lambda s, d: op.unknown_supplier_types(_tx(s, d), _pol(s, d)),
    "J14_broken_targets": lambda s, d: op.broken_targets(_tx(s, d)),
    "J14_broken_references": lambda s, d: op.broken_references(_tx(s, d)),
    "J14_first_broken_references": lambda s, d: op.first_broken_references(_tx(s, d)),
    "J15_integrity_report": lambda s, d: op.integrity_report(_tx(s, d), _pol(s, d)),
    "J16_over_limit": lambda s, d: _flags(s, d, "EXCEDE_LIMITE").select(
        "descripcion", "supplier_type", "amount", "limite", "exceso"
    ),
    "J17_invalid_dates": lambda s, d: _flags(s, d, "FECHA_INVALIDA").select("descripcion", "supplier_type"),
    "J18_incoherent_terms": lambda s, d: _flags(s, d, "TERMINOS_INCOHERENTES").select(
        "descripcion", "supplier_type"
    ),
    "J19_inconsistencies": lambda s, d: op.inconsistencies(_tx(s, d), _pol(s, d)).select(
        "transaction_id",
        "tipo_inconsistencia",
        "descripcion",
        "severidad",
        "supplier_type",
        "limite",
        "exceso",
    ),
    "J20_summary_totals": lambda s, d: op.summary_totals(_tx(s, d)),
    "J20_summary_counts": lambda s, d: op.summary_counts(
        _tx(s, d), op.inconsistencies(_tx(s, d), _pol(s, d))
    ),
    "J21_documents_end_to_end": lambda s, d: op.inconsistencies(_tx(s, d), _pol(s, d))
    .groupBy("supplier_type", "tipo_inconsistencia", "severidad")
    .agg(F.count(F.lit(1)).alias("casos")),
}

CHAIN = """WITH t AS (
  SELECT o_orderkey AS k, c_mktsegment AS segment, length(c_mktsegment) * 40000 AS limite0,
    CASE WHEN o_orderkey % 101 = 0 THEN 'T' ELSE '' END || o_orderkey AS transaction_id, o_custkey AS supplier_id,
    CASE WHEN o_orderkey % 41 = 0 THEN 'UNLISTED' ELSE c_mktsegment END AS supplier_type,
    CAST(o_orderdate AS DATE) AS invoice_date,
    CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST((o_orderkey * 37) % 600 - 60 AS INTEGER) END AS due_date,
    CASE WHEN o_orderkey % 103 = 0 THEN NULL WHEN o_orderkey % 107 = 0 THEN -o_totalprice ELSE o_totalprice END AS amount,
    CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE CAST(30 * (1 + o_orderkey % 3) AS INTEGER) END AS payment_terms_days,
    CASE o_orderstatus WHEN 'O' THEN 'Pending' WHEN 'P' THEN 'Overdue' ELSE 'Paid' END AS status,
    CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE 'U' || CAST(o_custkey % 4 AS VARCHAR) END AS created_by,
    CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS created_at,
    CASE WHEN o_orderkey % 47 = 0 THEN [] ELSE
      list_concat(CASE WHEN o_orderkey % 5 <> 0 THEN [o_orderkey + 1] ELSE [] END, CASE WHEN o_orderkey % 3 = 0 THEN [o_orderkey * 2] ELSE [] END) END AS related
  FROM orders JOIN customer ON o_custkey = c_custkey),
d AS (SELECT *, CAST(datediff('day', invoice_date, due_date) AS INTEGER) AS days_until_due FROM t),
v AS (SELECT * FROM d WHERE k % 59 <> 0),
pol AS (SELECT segment AS supplier_type, CAST(length(segment) * 40000 AS DOUBLE) AS authorization_limit, 'Manager, Director' AS approval_flow,
    CAST(length(segment) AS DOUBLE) AS discount_early_payment, CAST(10 AS DOUBLE) AS discount_bulk_order,
    CASE WHEN segment <> 'HOUSEHOLD' THEN CAST(1.5 AS DOUBLE) END AS penalty_late_payment FROM v GROUP BY segment),
errs AS (SELECT k, 0 AS pos, 'transaction_id inválido: T' || k AS message FROM v WHERE k % 101 = 0
  UNION ALL SELECT k, 1, 'amount inválido en trans ' || CASE WHEN k % 101 = 0 THEN 'T' || k ELSE CAST(k AS VARCHAR) END FROM v WHERE k % 103 = 0),
refs AS (SELECT k, transaction_id, unnest(related) AS referencia_rota FROM d),
broken AS (SELECT * FROM refs WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.transaction_id = CAST(referencia_rota AS VARCHAR))),
lim AS (SELECT d.*, authorization_limit AS limite FROM d LEFT JOIN pol USING (supplier_type)),
inc AS (
  SELECT transaction_id, 'EXCEDE_LIMITE' AS tipo_inconsistencia,
    'Monto $' || format('{:.2f}', amount) || ' excede límite $' || CAST(CAST(limite AS BIGINT) AS VARCHAR) || ' para tipo ''' || supplier_type || '''' AS descripcion,
    'ALTA' AS severidad, supplier_type, amount, limite, amount - limite AS exceso FROM lim WHERE amount > limite
  UNION ALL SELECT transaction_id, 'FECHA_INVALIDA', 'Due date anterior a invoice date (' || days_until_due || ' días)', 'MEDIA', supplier_type, amount, NULL, NULL
    FROM lim WHERE status = 'Overdue' AND days_until_due < 0
  UNION ALL SELECT transaction_id, 'TERMINOS_INCOHERENTES', 'Payment terms (' || CAST(CAST(payment_terms_days AS DOUBLE) AS VARCHAR) || 'd) vs días reales (' || days_until_due || 'd)',
    'BAJA', supplier_type, amount, NULL, NULL FROM lim WHERE abs(days_until_due - payment_terms_days) > 365)
"""
_flat = [
    "transaction_id",
    "supplier_id",
    "supplier_type",
    "invoice_date",
    "due_date",
    "amount",
    "payment_terms",
    "status",
    "created_by",
    "created_at",
    "days_until_due",
    "payment_terms_days",
]
_nulls = " UNION ALL ".join(
    f"SELECT '{c}' AS columna, count(*) FILTER ({'payment_terms_days' if c == 'payment_terms' else c} IS NULL) AS nulos FROM d"
    for c in _flat
)
_kinds = "SELECT descripcion, supplier_type{} FROM inc WHERE tipo_inconsistencia = '{}'"
SQL = {
    "J1_required_keys": CHAIN
    + "SELECT k AS doc_id, CASE WHEN k % 59 = 0 THEN 'payment_policies' ELSE '' END AS missing_keys, k % 59 <> 0 AS estructura_valida FROM t",
    "J2_missing_policy_fields": CHAIN + "SELECT DISTINCT segment AS supplier_type, 'penalties' AS campo FROM v WHERE segment = 'HOUSEHOLD'",
    "J2_policy_types": CHAIN + "SELECT supplier_type FROM pol",
    "J3_missing_transaction_fields": CHAIN
    + "SELECT DISTINCT 'payment_terms' AS campo FROM v WHERE k % 43 = 0 UNION ALL SELECT DISTINCT 'metadata' FROM v WHERE k % 47 = 0",
    "J4_type_errors": CHAIN + "SELECT k AS doc_id, message FROM errs",
    "J4_type_warnings": CHAIN
    + """SELECT message FROM (SELECT * FROM errs ORDER BY k, pos LIMIT 5)
      UNION ALL SELECT '... y ' || (count(*) - 5) || ' más' FROM errs HAVING count(*) > 5""",
    "J5_without_metadata": CHAIN + "SELECT count(*) FILTER (k % 47 = 0) AS transacciones_sin_metadata FROM v",
    "J6_structure_report": CHAIN
    + """SELECT 'documentos_invalidos' AS section, CAST(count(*) FILTER (k % 59 = 0) AS VARCHAR) AS item FROM t
      UNION ALL SELECT DISTINCT 'errores', 'Falta clave principal: ''payment_policies''' FROM t WHERE k % 59 = 0
      UNION ALL SELECT DISTINCT 'advertencias', 'Tipo ''' || segment || ''' no tiene campo ''penalties''' FROM v WHERE segment = 'HOUSEHOLD'
      UNION ALL SELECT DISTINCT 'campos_faltantes', 'payment_terms' FROM v WHERE k % 43 = 0
      UNION ALL SELECT DISTINCT 'campos_faltantes', 'metadata' FROM v WHERE k % 47 = 0
      UNION ALL SELECT 'advertencias', message FROM (SELECT * FROM errs ORDER BY k, pos LIMIT 5)
      UNION ALL SELECT 'advertencias', '... y ' || (count(*) - 5) || ' más' FROM errs HAVING count(*) > 5
      UNION ALL SELECT 'advertencias', count(*) || ' transacciones sin metadata' FROM v WHERE k % 47 = 0 HAVING count(*) > 0
      UNION ALL SELECT 'tipos_proveedor', supplier_type FROM pol
      UNION ALL SELECT 'num_transacciones', CAST(count(*) AS VARCHAR) FROM v""",
    "J7_policies": CHAIN + "SELECT * FROM pol",
    "J8_transactions": CHAIN
    + """SELECT transaction_id, supplier_id, supplier_type, CAST(invoice_date AS VARCHAR) AS invoice_date, CAST(due_date AS VARCHAR) AS due_date, amount,
        CAST(payment_terms_days AS VARCHAR) || ' days' AS payment_terms, status, created_by, created_at,
        CAST(len(related) AS INTEGER) AS num_related_transactions, array_to_string(related, ',') AS related_transactions FROM d""",
    "J9_derived_days": CHAIN
    + """SELECT transaction_id, coalesce(days_until_due, -99999) AS days_until_due, coalesce(payment_terms_days, -1) AS payment_terms_days
      FROM d""",
    "J10_duplicated_ids": CHAIN
    + "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicados FROM (SELECT count(*) AS n FROM d GROUP BY transaction_id HAVING count(*) > 1)",
    "J11_null_counts": CHAIN + f"SELECT * FROM ({_nulls}) WHERE nulos > 0",
    "J12_invalid_ranges": CHAIN
    + "SELECT count(*) FILTER (amount < 0) AS montos_negativos, count(*) FILTER (due_date < invoice_date) AS due_date_antes_invoice FROM d",
    "J13_unknown_supplier_types": CHAIN
    + "SELECT DISTINCT supplier_type FROM d WHERE supplier_type NOT IN (SELECT supplier_type FROM pol)",
    "J14_broken_targets": CHAIN + "SELECT referencia_rota, count(*) AS veces FROM broken GROUP BY 1",
    "J14_broken_references": CHAIN
    + "SELECT transaction_id, referencia_rota FROM broken",
    "J14_first_broken_references": CHAIN
    + "SELECT transaction_id, referencia_rota FROM broken ORDER BY 1, 2 LIMIT 10",
    "J15_integrity_report": CHAIN
    + f"""SELECT 'duplicados' AS check, 'transaction_id' AS item, CAST(coalesce(sum(n), 0) AS BIGINT) AS cases
        FROM (SELECT count(*) AS n FROM d GROUP BY transaction_id HAVING count(*) > 1)
      UNION ALL SELECT 'valores_nulos', columna, nulos FROM ({_nulls}) WHERE nulos > 0
      UNION ALL SELECT 'rangos_invalidos', 'montos_negativos', count(*) FILTER (amount < 0) FROM d
      UNION ALL SELECT 'rangos_invalidos', 'due_date_antes_invoice', count(*) FILTER (due_date < invoice_date) FROM d
      UNION ALL SELECT DISTINCT 'tipos_proveedor_invalidos', supplier_type, 1 FROM d WHERE supplier_type NOT IN (SELECT supplier_type FROM pol)
      UNION ALL SELECT 'referencias_rotas', 'total', count(*) FROM broken""",
    "J16_over_limit": CHAIN + _kinds.format(", amount, limite, exceso", "EXCEDE_LIMITE"),
    "J17_invalid_dates": CHAIN + _kinds.format("", "FECHA_INVALIDA"),
    "J18_incoherent_terms": CHAIN + _kinds.format("", "TERMINOS_INCOHERENTES"),
    "J19_inconsistencies": CHAIN
    + """SELECT transaction_id, tipo_inconsistencia, descripcion, severidad, supplier_type,
        limite, exceso FROM inc""",
    "J20_summary_totals": CHAIN
    + f"""SELECT count(*) AS total_transacciones, {exact_sum('amount')} AS monto_total, {exact_mean('amount')} AS monto_promedio,
        count(*) FILTER (len(related) > 0) AS transacciones_con_referencias FROM d""",
    "J20_summary_counts": CHAIN
    + """SELECT 'status' AS dimension, status AS value, count(*) AS cases FROM d GROUP BY status
      UNION ALL SELECT 'tipo_proveedor', supplier_type, count(*) FROM d GROUP BY supplier_type
      UNION ALL SELECT 'creador', created_by, count(*) FROM d WHERE created_by IS NOT NULL GROUP BY created_by
      UNION ALL SELECT 'inconsistencias', tipo_inconsistencia, count(*) FROM inc GROUP BY tipo_inconsistencia""",
    "J21_documents_end_to_end": CHAIN
    + "SELECT supplier_type, tipo_inconsistencia, severidad, count(*) AS casos FROM inc GROUP BY ALL",
}
