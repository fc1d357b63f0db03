"""Readers with declared schemas; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchlens.operators.nested import DOCUMENT_SCHEMA

PAYMENTS_SCHEMA = """ID_transaccion bigint, proveedor_id bigint, fecha_factura date,
  fecha_vencimiento date, monto double, condiciones_pago string, estado_pago string,
  dias_credito int, descuento_pronto_pago double, penalizacion_mora double,
  metodo_pago string, aprobador string"""

# text throughout: the cleaning step decides what can be read as a number or date
HISTORY_SCHEMA = """fecha string, proveedor_id string, categoria_gasto string,
  `método_pago` string, monto string, tiempo_procesamiento string,
  score_cumplimiento string, indicadores_economicos string, estacionalidad string"""

SUPPLIERS_SCHEMA = """ID_proveedor bigint, nombre string, tipo_empresa string, `país` string,
  contactos_emergencia string, condiciones_negociadas string, `categoría_riesgo` string,
  descuentos_especiales int, `límites_crédito` double, `histórico_performance` string,
  certificaciones string"""

CASES_SCHEMA = """tipo_caso string, nivel_complejidad string, fecha_incidencia date,
  descripcion string, monto_involucrado double, estado string, responsable string,
  comentarios string"""


def read_csv(
    spark: SparkSession, path: str, schema: str, names: list[str] | None = None, malformed: str | None = None
) -> DataFrame:
    """A CSV with a header, whose columns may come in any order.

    ``names`` is the order in the file; columns the schema lacks are read as text
    and dropped. A file of the folder with another header is an error when it is read.
    Values that don't fit their type are null; ``malformed`` names a column that keeps the
    whole line of such a row (null for others).
    """
    wanted = spark.createDataFrame([], schema).schema
    if names is None:
        names = [f.name for f in wanted.fields]
    types = {f.name: f.dataType.simpleString() for f in wanted.fields}
    in_file = ", ".join(f"`{n}` {types.get(n, 'string')}" for n in names)
    options = {"header": True, "enforceSchema": False, "quote": '"', "escape": '"'}
    if malformed:
        in_file += f", `{malformed}` string"
        options["columnNameOfCorruptRecord"] = malformed
    df = spark.read.csv(path, schema=in_file, **options)
    return df.select(*[n for n in names if n in types], *([malformed] if malformed else []))


def malformed_counts(df: DataFrame, malformed: str) -> DataFrame:
    """Rows read and rows of them with a line that didn't fit, in one pass over all columns."""
    # a line is checked in the columns that are read only, so the count looks at all of them: a remainder of one is zero
    read = F.count(F.lit(1)) + F.coalesce(F.sum(F.xxhash64(*df.columns) % 1), F.lit(0))
    return df.agg(read.alias("rows"), F.count(malformed).alias("malformed"))


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, from its first line."""
    return spark.read.csv(path, header=True, quote='"', escape='"').limit(0).columns


def read_payments(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PAYMENTS_SCHEMA, header(spark, path))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, HISTORY_SCHEMA, header(spark, path))


def read_suppliers(spark: SparkSession, path: str, malformed: str | None = None) -> DataFrame:
    return read_csv(spark, path, SUPPLIERS_SCHEMA, header(spark, path), malformed)


def read_cases(spark: SparkSession, path: str, malformed: str | None = None) -> DataFrame:
    """Adds a case id from all columns, to break ties in a reproducible way."""
    df = read_csv(spark, path, CASES_SCHEMA, header(spark, path), malformed)
    return df.withColumn("case_id", F.xxhash64(*df.columns))


def read_document_texts(spark: SparkSession, path: str, one_per_line: bool = True) -> DataFrame:
    """(doc_id, doc): a document per line, or a document per file."""
    texts = spark.read.text(path, wholetext=not one_per_line)
    return texts.select(F.xxhash64("value").alias("doc_id"), F.col("value").alias("doc"))


def read_documents(spark: SparkSession, path: str, one_per_line: bool = True) -> DataFrame:
    """Typed documents; an unreadable one is kept in ``_corrupt_record``."""
    return spark.read.json(path, schema=DOCUMENT_SCHEMA, multiLine=not one_per_line)
