"""The driver's tables seen in the roles of the audit (payments, history, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hashed over the cores if it comes in fewer splits than there are cores.

    A single small file with one row group would otherwise be one task. A table of
    many files keeps its splits and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def _lines_with_orders(spark: SparkSession, folder: str) -> DataFrame:
    lines = spread(table(spark, folder, "lineitem"), "l_orderkey")
    return lines.join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def _line_value() -> Column:
    return F.round(F.col("l_extendedprice") * F.col("l_quantity"), 2)


def payments(spark: SparkSession, folder: str) -> DataFrame:
    """One payment per order line; open lines are billed gross, finished ones net.

    A third is due as agreed and half of the granted credit follows the terms.
    """
    net = F.round(
        F.col("l_extendedprice") * F.col("l_quantity") * (1 - F.col("l_discount")), 4
    )
    days = 30 * (1 + F.col("l_linenumber") % 3)
    agreed = F.date_add(F.to_date("o_orderdate"), days)
    return _lines_with_orders(spark, folder).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_suppkey").alias("supplier"),
        F.to_date("o_orderdate").alias("invoice_date"),
        F.when(F.col("l_partkey") % 3 == 0, agreed).otherwise(F.to_date("l_shipdate")).alias("due_date"),
        F.when(F.col("l_linestatus") == "O", _line_value()).otherwise(net).alias("amount"),
        F.concat(days.cast("string"), F.lit(" días")).alias("terms"),
        F.when(F.col("l_returnflag") == "A", "Pagado")
        .when(F.col("l_returnflag") == "N", "Pendiente")
        .otherwise("Retrasado")
        .alias("status"),
        F.when(F.col("l_quantity") % 2 == 0, days)
        .otherwise(F.col("l_quantity").cast("int") - 11)
        .alias("credit_days"),
        (F.round(F.col("l_discount") * 100) * 2).alias("discount"),
        F.round(F.col("l_tax") * 100).alias("penalty"),
        F.concat_ws("-", "o_orderpriority", (F.col("l_suppkey") % 20).cast("string")).alias("approver"),
        F.col("l_partkey").alias("part"),
    )


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Payment history with typed columns."""
    lines = _lines_with_orders(spark, folder).join(
        table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    return lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_partkey").alias("part"),
        F.to_date("o_orderdate").alias("date"),
        F.col("l_suppkey").alias("supplier"),
        F.col("p_type").alias("category"),
        F.col("o_orderpriority").alias("method"),
        _line_value().alias("amount"),
        F.col("l_quantity").alias("time"),
        F.round(1 - F.col("l_discount") * 10, 1).alias("score"),
        F.col("l_returnflag").alias("indicator"),
        F.when(F.month("o_orderdate").isin(11, 12, 1), "Alta").otherwise("Baja").alias("season"),
    )


def raw_history(spark: SparkSession, folder: str) -> DataFrame:
    """The history as untyped text with the defects a file would have."""
    h = history(spark, folder)
    tax_free = F.col("id") % 10
    return h.select(
        "id",
        "part",
        F.when(F.col("part") % 97 == 0, "sin fecha").otherwise(F.col("date").cast("string")).alias("date"),
        F.when(F.col("part") % 89 == 0, "?").otherwise(F.col("supplier").cast("string")).alias("supplier"),
        F.when(F.col("part") % 31 == 0, F.lit(None))
        .otherwise(F.concat(F.lit(" "), F.col("category"), F.lit(" ")))
        .alias("category"),
        "method",
        F.when(F.col("part") % 13 == 0, "n/a")
        .when(tax_free == 7, F.concat(F.lit("-"), F.col("amount").cast("decimal(18,2)").cast("string")))
        .otherwise(F.col("amount").cast("decimal(18,2)").cast("string"))
        .alias("amount"),
        F.when(F.col("part") % 17 == 0, F.lit(None))
        .otherwise((F.col("time") - 2).cast("int").cast("string"))
        .alias("time"),
        F.when(F.col("part") % 19 == 0, "")
        .otherwise((F.col("score") * 1.25).cast("decimal(6,3)").cast("string"))
        .alias("score"),
        "indicator",
        "season",
    )


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier master data; figures and certificates arrive as text literals."""
    s = table(spark, folder, "supplier").join(
        table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    key = F.col("s_suppkey")
    names = ["ISO 9001", "ISO 14001", "None", "OHSAS 18001"]

    def cert(shift: int) -> Column:
        at = (key * (shift + 1) + F.floor(key / (4 + shift))) % 4
        return F.get(F.array(*[F.lit(n) for n in names]), at.cast("int"))

    count = key % 4
    listed = F.concat(
        F.lit("["),
        F.concat_ws(
            ", ",
            *[F.when(count > i, F.concat(F.lit("'"), cert(i), F.lit("'"))) for i in range(3)],
        ),
        F.lit("]"),
    )
    figures = F.concat(
        F.lit("{'on_time_delivery': '"),
        (50 + (key * 7) % 51).cast("string"),
        F.lit("%', 'quality_issues': "),
        ((key * 3) % 6).cast("string"),
        F.lit(", 'customer_complaints': "),
        ((key * 5) % 4).cast("string"),
        F.lit("}"),
    )
    return s.select(
        key.alias("supplier"),
        F.col("s_name").alias("name"),
        F.get(F.array(F.lit("Grande"), F.lit("Mediana"), F.lit("Pequeña")), (key % 3).cast("int")).alias("size"),
        F.col("n_name").alias("country"),
        F.when(F.col("s_acctbal") < 2700, "Alto")
        .when(F.col("s_acctbal") < 6300, "Medio")
        .otherwise("Bajo")
        .alias("category"),
        F.round(F.col("s_acctbal") * 5, 2).alias("credit"),
        F.when(key % 11 == 0, F.lit(None)).otherwise(figures).alias("performance"),
        F.when(key % 13 == 0, F.lit(None)).otherwise(listed).alias("certificates"),
    )


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Exception cases: one per order."""
    kinds = [
        "Proveedor VIP",
        "Pago Urgente",
        "Ajuste Contable",
        "Excepción Regulatoria",
        "Otro",
    ]
    priority = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    return spread(table(spark, folder, "orders"), "o_orderkey").select(
        F.col("o_orderkey").alias("case_id"),
        F.get(F.array(*[F.lit(k) for k in kinds]), priority).alias("type"),
        F.get(F.array(F.lit("Bajo"), F.lit("Medio"), F.lit("Alto")), (F.col("o_custkey") % 3).cast("int")).alias(
            "complexity"
        ),
        F.to_date("o_orderdate").alias("date"),
        (F.col("o_totalprice") / 10).alias("amount"),
        F.when(F.col("o_orderstatus") == "O", "Abierto")
        .when(F.col("o_orderstatus") == "P", "En Proceso")
        .otherwise("Cerrado")
        .alias("state"),
        F.concat(F.lit("R"), (F.col("o_custkey") % 7).cast("string")).alias("assignee"),
    )


def policy_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One nested JSON document per order, with a few defects by rule.

    A document carries the policy of its customer's segment and one transaction,
    whose related ids are the neighbouring orders.
    """
    o = spread(table(spark, folder, "orders"), "o_orderkey").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left"
    )
    key, segment = F.col("o_orderkey"), F.coalesce(F.col("c_mktsegment"), F.lit("NONE"))
    limit = F.length(segment) * 40000
    policy = F.concat(
        F.lit('{"authorization_limit": '),
        limit.cast("string"),
        F.lit(', "approval_flow": ["Manager", "Director"], "discounts": {"early_payment": '),
        F.length(segment).cast("string"),
        F.lit(', "bulk_order": 10}'),
        F.when(segment == "HOUSEHOLD", F.lit("")).otherwise(
            F.lit(', "penalties": {"late_payment": 1.5}')
        ),
        F.lit("}"),
    )
    related = F.concat_ws(
        ",",
        F.when(key % 5 != 0, (key + 1).cast("string")),
        F.when(key % 3 == 0, (key * 2).cast("string")),
    )
    metadata = F.concat(
        F.lit(', "metadata": {"created_by": "'),
        F.concat(F.lit("U"), (F.col("o_custkey") % 4).cast("string")),
        F.lit('", "created_at": "'),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
        F.lit('", "related_transactions": ['),
        related,
        F.lit("]}"),
    )
    due = F.date_add(F.to_date("o_orderdate"), ((key * 37) % 600 - 60).cast("int"))
    transaction = F.concat(
        F.lit('{"transaction_id": '),
        F.when(key % 101 == 0, F.concat(F.lit('"T'), key.cast("string"), F.lit('"'))).otherwise(
            key.cast("string")
        ),
        F.lit(', "supplier_id": '),
        F.col("o_custkey").cast("string"),
        F.lit(', "supplier_type": "'),
        F.when(key % 41 == 0, "UNLISTED").otherwise(segment),
        F.lit('", "invoice_date": "'),
        F.to_date("o_orderdate").cast("string"),
        F.lit('", "due_date": "'),
        F.when(key % 53 == 0, "pronto").otherwise(due.cast("string")),
        F.lit('", "amount": '),
        F.when(key % 103 == 0, '"mucho"')
        .when(key % 107 == 0, F.concat(F.lit("-"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
        .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")),
        F.when(key % 43 == 0, F.lit("")).otherwise(
            F.concat(
                F.lit(', "payment_terms": "'), (30 * (1 + key % 3)).cast("string"), F.lit(' days"')
            )
        ),
        F.lit(', "status": "'),
        F.when(F.col("o_orderstatus") == "O", "Pending")
        .when(F.col("o_orderstatus") == "P", "Overdue")
        .otherwise("Paid"),
        F.lit('"'),
        F.when(key % 47 == 0, F.lit("")).otherwise(metadata),
        F.lit("}"),
    )
    doc = F.concat(
        F.lit("{"),
        F.when(key % 59 == 0, F.lit("")).otherwise(
            F.concat(
                F.lit('"payment_policies": {"policies": {"supplier_type": {"'),
                segment,
                F.lit('": '),
                policy,
                F.lit("}}}, "),
            )
        ),
        F.lit('"transactions": ['),
        transaction,
        F.lit("]}"),
    )
    return o.select(key.alias("doc_id"), doc.alias("doc"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of three stand-in models, made from keys, with many ties.

    The label is the late-payment target; each model adds a different share of it.
    """
    h = history(spark, folder).select("id", "part", (F.col("score") < 0.5).cast("int").alias("label"))
    models = [("a", 7919, 104729, 0.2), ("b", 15485863, 611953, 0.08), ("c", 31337, 271, 0.0)]

    def scored(m: int, p: int, gain: float) -> Column:
        noise = ((F.col("id") * m + F.col("part") * p) % 1000) / 1250.0
        return F.round(noise + F.col("label") * gain, 4)

    entries = [
        F.struct(F.lit(name).alias("model"), scored(m, p, gain).alias("score"))
        for name, m, p, gain in models
    ]
    return h.select(
        "id",
        "part",
        "label",
        F.when(F.col("part") % 5 == 0, "test").otherwise("train").alias("split"),
        F.explode(F.array(*entries)).alias("x"),
    ).select("id", "part", "label", "split", "x.model", "x.score")
