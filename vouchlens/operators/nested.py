"""Nested JSON documents of policies and transactions: validate, flatten, check.

Input is a table of document texts with an id. A file with one document per line
spreads over all tasks; a single large document is one row until it is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchlens.functions.columns import digits_in, fixed, flag, money_mean, money_sum, present, text
from vouchlens.plans.counts import value_counts
from vouchlens.plans.lookup import Measured, lookup, lookup_split, measured
from vouchlens.session import cut_lineage, written_once

# Required keys, types, severities and bounds.
REQUIRED_KEYS = ["payment_policies", "transactions"]
POLICY_FIELDS = ["authorization_limit", "approval_flow", "discounts", "penalties"]
TRANSACTION_FIELDS = [
    "transaction_id",
    "supplier_id",
    "supplier_type",
    "invoice_date",
    "due_date",
    "amount",
    "payment_terms",
    "status",
    "metadata",
]
SHOWN_MESSAGES = 5
SHOWN_REFERENCES = 10
TERMS_TOLERANCE_DAYS = 365

POLICY_SCHEMA = (
    "struct<authorization_limit: double, approval_flow: array<string>, "
    "discounts: struct<early_payment: double, bulk_order: double>, "
    "penalties: struct<late_payment: double>>"
)
TRANSACTION_SCHEMA = (
    "struct<transaction_id: string, supplier_id: bigint, supplier_type: string, "
    "invoice_date: string, due_date: string, amount: double, payment_terms: string, "
    "status: string, metadata: struct<created_by: string, created_at: string, "
    "related_transactions: array<bigint>>>"
)
DOCUMENT_SCHEMA = (
    "payment_policies struct<policies: struct<supplier_type: "
    f"map<string, {POLICY_SCHEMA}>>>, transactions array<{TRANSACTION_SCHEMA}>, "
    "_corrupt_record string"
)

POLICY_PATH = "payment_policies: struct<policies: struct<supplier_type: map<string, {}>>>"
# the same documents with policies and transactions left as texts
RAW_SCHEMA = f"struct<{POLICY_PATH.format('string')}, transactions: array<string>>"

INTEGER_TYPES = ["BIGINT"]


def _list(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _missing(names: list[str], document: Column) -> Column:
    keys = F.coalesce(F.json_object_keys(document), F.array().cast("array<string>"))
    return F.array_except(_list(names), keys)


# --- structure --------------------------------------------------------------


def required_keys(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Adds the missing top-level keys and whether the document is valid."""
    return docs.withColumn("missing_keys", _missing(REQUIRED_KEYS, F.col(doc))).withColumn(
        "estructura_valida", F.size("missing_keys") == 0
    )


def valid_documents(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Checks beyond the top-level keys stop at documents that lack them."""
    return required_keys(docs, doc).where("estructura_valida").drop("missing_keys", "estructura_valida")


def raw_policies(docs: DataFrame, key: str = "doc_id", doc: str = "doc") -> DataFrame:
    """(document, supplier type, policy text)."""
    by_type = (
        F.from_json(doc, RAW_SCHEMA)
        .getField("payment_policies")
        .getField("policies")
        .getField("supplier_type")
    )
    return docs.select(key, F.explode(by_type).alias("supplier_type", "config"))


def exploded(df: DataFrame, keep: list[str], listed: Column, name: str) -> DataFrame:
    """One row per entry of a list that is costly to make.

    Spark may filter empty lists ahead of a plain explode, and would then make every list twice.
    """
    each = df.select(*keep, F.posexplode_outer(listed).alias("_pos", name))
    return each.where(F.col("_pos").isNotNull()).drop("_pos")


def raw_transactions(docs: DataFrame, key: str = "doc_id", doc: str = "doc") -> DataFrame:
    """(document, transaction text)."""
    listed = F.from_json(doc, RAW_SCHEMA).getField("transactions")
    return exploded(docs, [key], listed, "transaction")


def missing_policy_fields(policies: DataFrame) -> DataFrame:
    """One row per supplier type and missing field."""
    return (
        policies.select(
            "supplier_type", F.explode(_missing(POLICY_FIELDS, F.col("config"))).alias("campo")
        )
        .distinct()
    )


def policy_types(policies: DataFrame) -> DataFrame:
    return policies.select("supplier_type").distinct()


def missing_transaction_fields(transactions: DataFrame) -> DataFrame:
    return transactions.select(
        F.explode(_missing(TRANSACTION_FIELDS, F.col("transaction"))).alias("campo")
    ).distinct()


def _type_messages(parsed: Column) -> Column:
    """A message if the id is no integer, and one if the amount is no number, of a parsed transaction."""

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))

    def shown(path: str) -> Column:
        return F.coalesce(F.try_variant_get(parsed, path, "string"), F.lit("None"))

    number = kind("$.amount")
    is_number = number.isin("BIGINT", "DOUBLE", "FLOAT") | number.startswith("DECIMAL")
    bad_id = ~flag(kind("$.transaction_id").isin(INTEGER_TYPES))
    bad_amount = ~flag(is_number)
    return present(
        [
            F.when(bad_id, text("transaction_id inválido: {}", shown("$.transaction_id"))),
            F.when(bad_amount, text("amount inválido en trans {}", shown("$.transaction_id"))),
        ]
    )


def type_errors(transactions: DataFrame, key: str = "doc_id") -> DataFrame:
    """One message per id that is no integer and per amount that is no number."""
    parsed = transactions.select(key, F.try_parse_json("transaction").alias("_parsed"))  # once, for all that is asked of it
    each = parsed.select(key, F.posexplode_outer(_type_messages(F.col("_parsed"))).alias("pos", "message"))
    return each.where("pos is not null")


def type_warnings(errors: DataFrame, key: str = "doc_id", shown: int = SHOWN_MESSAGES) -> DataFrame:
    """The first messages and, if there are more, how many."""
    errors = written_once(errors.select(key, "pos", "message"))  # the documents are read once for both
    first = errors.orderBy(key, "pos").limit(shown).select("message")
    rest = errors.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shown)
    return first.unionByName(
        rest.select(text("... y {} más", F.col("n") - shown).alias("message"))
    )


def without_metadata(transactions: DataFrame) -> DataFrame:
    return transactions.agg(
        F.count_if(~_has_metadata(F.col("transaction"))).alias("transacciones_sin_metadata")
    )


def _has_metadata(body: Column) -> Column:
    return flag(F.array_contains(F.json_object_keys(body), "metadata"))


def structure_facts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(section, item, cases) of everything the validation looks at, from one scan.

    Each document gives its parts, each part its findings; findings are counted on
    the way, so what is shuffled is one row per distinct finding.
    """

    def part(kind: str, name: Column, body: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), body.alias("body"))

    none = F.lit(None).cast("string")
    raw = F.from_json("doc", RAW_SCHEMA)
    checked = required_keys(docs).withColumn("_raw", raw)
    by_type = F.map_entries("_raw.payment_policies.policies.supplier_type")
    no_parts = F.array().cast("array<struct<kind: string, name: string, body: string>>")
    parts = F.when(
        F.col("estructura_valida"),
        F.concat(
            F.coalesce(F.transform(by_type, lambda e: part("policy", e["key"], e["value"])), no_parts),
            F.coalesce(F.transform("_raw.transactions", lambda t: part("tx", none, t)), no_parts),
        ),
    ).otherwise(
        F.concat(
            F.array(part("invalid", none, none)),
            F.transform("missing_keys", lambda k: part("error", k, none)),
        )
    )
    each = exploded(checked, [key], parts, "p").select("p.kind", "p.name", "p.body")
    each = each.withColumn("_parsed", F.when(F.col("kind") == "tx", F.try_parse_json("body")))

    def fact(section: str, item: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), item.alias("item"))

    name, body = F.col("name"), F.col("body")
    lost_policy = F.transform(
        _missing(POLICY_FIELDS, body),
        lambda c: fact("advertencias", text("Tipo '{}' no tiene campo '{}'", name, c)),
    )
    lost_field = F.transform(
        _missing(TRANSACTION_FIELDS, body), lambda c: fact("campos_faltantes", c)
    )
    wrong_type = F.transform(_type_messages(F.col("_parsed")), lambda m: fact("tipos_invalidos", none))
    no_metadata = present([F.when(~_has_metadata(body), fact("sin_metadata", none))])
    facts = (
        F.when(F.col("kind") == "invalid", F.array(fact("documentos_invalidos", none)))
        .when(F.col("kind") == "error", F.array(fact("errores", text("Falta clave principal: '{}'", name))))
        .when(
            F.col("kind") == "policy",
            F.concat(F.array(fact("tipos_proveedor", name)), lost_policy),
        )
        .otherwise(
            F.concat(
                F.array(fact("num_transacciones", none)), lost_field, wrong_type, no_metadata
            )
        )
    )
    return (
        exploded(each, [], facts, "f")
        .groupBy("f.section", "f.item")
        .agg(F.count(F.lit(1)).alias("cases"))
    )


def structure_report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Everything the validation finds, as (section, item)."""
    facts = cut_lineage(structure_facts(docs, key))

    def cases(section: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("section") == section, F.col("cases"))), F.lit(0))

    listed = facts.where("item IS NOT NULL").select("section", "item")
    totals = facts.agg(
        cases("documentos_invalidos").alias("invalid"),
        cases("num_transacciones").alias("rows"),
        cases("tipos_invalidos").alias("wrong"),
        cases("sin_metadata").alias("lost"),
    )

    def row(section: str, item: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), item.alias("item"))

    rows = present(
        [
            row("documentos_invalidos", F.col("invalid").cast("string")),
            row("num_transacciones", F.col("rows").cast("string")),
            F.when(
                F.col("lost") > 0,
                row("advertencias", text("{} transacciones sin metadata", F.col("lost"))),
            ),
            F.when(
                F.col("wrong") > SHOWN_MESSAGES,
                row("advertencias", text("... y {} más", F.col("wrong") - SHOWN_MESSAGES)),
            ),
        ]
    )
    counted = totals.select(F.explode(rows).alias("r")).select("r.section", "r.item")
    errors = type_errors(raw_transactions(valid_documents(docs), key), key)
    first = (
        errors.orderBy(key, "pos")
        .limit(SHOWN_MESSAGES)
        .select(F.lit("advertencias").alias("section"), F.col("message").alias("item"))
    )
    return listed.unionByName(counted).unionByName(first)


# --- flat tables ------------------------------------------------------------


def policies(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per supplier type; where documents repeat a type the first counts."""
    by_type = (
        F.from_json("doc", f"struct<{POLICY_PATH.format(POLICY_SCHEMA)}>")
        .getField("payment_policies")
        .getField("policies")
        .getField("supplier_type")
    )
    parsed = docs.select(key, F.explode(by_type).alias("supplier_type", "p"))
    first = parsed.groupBy("supplier_type").agg(F.min_by("p", key).alias("p"))
    return first.select(
        "supplier_type",
        "p.authorization_limit",
        F.array_join("p.approval_flow", ", ").alias("approval_flow"),
        F.col("p.discounts.early_payment").alias("discount_early_payment"),
        F.col("p.discounts.bulk_order").alias("discount_bulk_order"),
        F.col("p.penalties.late_payment").alias("penalty_late_payment"),
    )


def transactions(docs: DataFrame) -> DataFrame:
    """Flat transactions with lifted metadata; ids stay texts as they come, other unreadable values become null."""
    typed = F.from_json("doc", f"struct<transactions: array<{TRANSACTION_SCHEMA}>>")
    t = exploded(docs, [], typed.getField("transactions"), "t")
    related = F.coalesce("t.metadata.related_transactions", F.array().cast("array<bigint>"))
    flat = t.select(
        "t.transaction_id",
        "t.supplier_id",
        "t.supplier_type",
        F.col("t.invoice_date").try_cast("date").alias("invoice_date"),
        F.col("t.due_date").try_cast("date").alias("due_date"),
        "t.amount",
        "t.payment_terms",
        "t.status",
        F.col("t.metadata.created_by").alias("created_by"),
        F.col("t.metadata.created_at").try_cast("timestamp").alias("created_at"),
        F.size(related).alias("num_related_transactions"),
        F.array_join(related.cast("array<string>"), ",").alias("related_transactions"),
    )
    return flat.withColumns(
        {
            "days_until_due": F.datediff("due_date", "invoice_date"),
            "payment_terms_days": digits_in(F.col("payment_terms")),
        }
    )


# --- integrity --------------------------------------------------------------


def duplicated_ids(tx: DataFrame) -> DataFrame:
    groups = tx.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicados"))


def null_counts(tx: DataFrame) -> DataFrame:
    """(column, nulls) of the columns that hold any."""
    counts = tx.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in tx.columns])
    return counts.unpivot([], tx.columns, "columna", "nulos").where("nulos > 0")


def invalid_ranges(tx: DataFrame) -> DataFrame:
    return tx.agg(
        F.count_if(F.col("amount") < 0).alias("montos_negativos"),
        F.count_if(F.col("due_date") < F.col("invoice_date")).alias("due_date_antes_invoice"),
    )


def unknown_supplier_types(tx: DataFrame, pol: DataFrame) -> DataFrame:
    used = tx.where(F.col("supplier_type").isNotNull()).select("supplier_type").distinct()
    return used.join(pol, "supplier_type", "left_anti")


def _targets() -> Column:
    """The listed ids as numbers; one that is no number is null, which no transaction has."""
    return F.transform(F.split("related_transactions", ","), lambda t: t.try_cast("bigint"))


def _references(tx: DataFrame) -> DataFrame:
    return tx.where("num_related_transactions > 0").select("transaction_id", F.explode(_targets()).alias("referencia_rota"))


def broken_targets(tx: DataFrame) -> DataFrame:
    """Referenced ids that do not exist, with the number of references to each.

    References are counted per target before the anti-join, so a target that many
    rows point to is one row there.
    """
    targets = _references(tx).groupBy("referencia_rota").agg(F.count(F.lit(1)).alias("veces"))
    known = tx.select(F.col("transaction_id").try_cast("bigint").alias("referencia_rota")).distinct()
    return targets.join(known, "referencia_rota", "left_anti")


def broken_references(tx: DataFrame) -> DataFrame:
    """All pairs of a transaction and a missing target."""
    targets = broken_targets(tx).withColumn("_broken", F.lit(True)).drop("veces")
    marked = lookup_split(_references(tx), targets, "referencia_rota")
    return marked.where("_broken").select("transaction_id", "referencia_rota")


def first_broken_references(tx: DataFrame, shown: int = SHOWN_REFERENCES) -> DataFrame:
    return broken_references(tx).orderBy("transaction_id", "referencia_rota").limit(shown)


def _key_figures(tx: DataFrame) -> DataFrame:
    """Rows of repeated ids and references to missing targets, from one pass over the transactions.

    Ids and targets meet under the target's number; an id that many rows have, or point
    to, is one row by then.
    """
    own = F.struct(
        F.col("transaction_id").try_cast("bigint").alias("key"), F.col("transaction_id").alias("id"), F.lit(1).alias("rows"), F.lit(0).alias("refs")
    )
    listed = F.when(F.col("num_related_transactions") > 0, _targets())
    pointed = F.transform(
        F.coalesce(listed, F.array().cast("array<bigint>")),
        lambda t: F.struct(t.alias("key"), F.lit(None).cast("string").alias("id"), F.lit(0).alias("rows"), F.lit(1).alias("refs")),
    )
    each = tx.select(F.explode(F.concat(F.array(own), pointed)).alias("x")).select("x.*")
    ids = each.groupBy("key", "id").agg(F.sum("rows").alias("rows"), F.sum("refs").alias("refs"))
    repeated = F.sum(F.when(F.col("id").isNotNull() & (F.col("rows") > 1), F.col("rows")))
    nameless = F.sum(F.when(F.col("id").isNull() & (F.col("rows") > 1), F.col("rows")))  # a missing id is one group
    keys = ids.groupBy("key").agg(
        repeated.alias("repeated"), nameless.alias("nameless"), F.sum("rows").alias("rows"), F.sum("refs").alias("refs")
    )
    missing = F.when(F.col("key").isNull() | (F.col("rows") == 0), F.col("refs"))
    return keys.agg(
        (F.coalesce(F.sum("repeated"), F.lit(0)) + F.coalesce(F.sum("nameless"), F.lit(0))).alias("duplicados"),
        F.coalesce(F.sum(missing), F.lit(0)).alias("rotas"),
    )


def integrity_report(tx: DataFrame, pol: DataFrame) -> DataFrame:
    """(check, item, cases) of all integrity checks: one pass for nulls and ranges, one for ids and references."""

    def row(check: str, item: Column, cases: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), item.alias("item"), cases.cast("bigint").alias("cases"))

    def exploded(df: DataFrame, rows: list[Column]) -> DataFrame:
        return df.select(F.explode(F.array(*rows)).alias("x")).select("x.*")

    nulls = {c: F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in tx.columns}
    figures = tx.agg(
        *nulls.values(),
        F.count_if(F.col("amount") < 0).alias("montos_negativos"),
        F.count_if(F.col("due_date") < F.col("invoice_date")).alias("due_date_antes_invoice"),
    )
    both = exploded(
        figures,
        [row("valores_nulos", F.lit(c), F.col(f"nulls_{c}")) for c in nulls]
        + [row("rangos_invalidos", F.lit(c), F.col(c)) for c in ("montos_negativos", "due_date_antes_invoice")],
    ).where("check <> 'valores_nulos' or cases > 0")
    keys = exploded(
        _key_figures(tx),
        [row("duplicados", F.lit("transaction_id"), F.col("duplicados")), row("referencias_rotas", F.lit("total"), F.col("rotas"))],
    )
    types = unknown_supplier_types(tx, pol).select(row("tipos_proveedor_invalidos", F.col("supplier_type"), F.lit(1)).alias("x")).select("x.*")
    return both.unionByName(keys).unionByName(types)


# --- policy checks ----------------------------------------------------------


def with_limits(tx: DataFrame, pol: DataFrame | Measured) -> DataFrame:
    known = pol if isinstance(pol, Measured) else measured(pol)
    limits = Measured(
        known.df.select("supplier_type", F.col("authorization_limit").alias("limite")), known.small
    )
    return lookup(tx, limits, "supplier_type")


def policy_flags() -> dict[str, Column]:
    """Needs the limit column of ``with_limits``."""
    gap = F.abs(F.col("days_until_due") - F.col("payment_terms_days"))
    return {
        "EXCEDE_LIMITE": flag(F.col("amount") > F.col("limite")),
        "FECHA_INVALIDA": flag((F.col("status") == "Overdue") & (F.col("days_until_due") < 0)),
        "TERMINOS_INCOHERENTES": flag(gap > TERMS_TOLERANCE_DAYS),
    }


def inconsistencies(tx: DataFrame, pol: DataFrame | Measured) -> DataFrame:
    """One row per violation, up to three per transaction, from a single scan."""
    f = policy_flags()
    limit = F.col("limite")
    limit_text = F.when(limit == F.floor(limit), limit.cast("bigint").cast("string")).otherwise(
        limit.cast("string")
    )

    def violation(
        kind: str, severity: str, message: Column, bound: Column, excess: Column
    ) -> Column:
        return F.when(
            f[kind],
            F.struct(
                F.lit(kind).alias("tipo_inconsistencia"),
                message.alias("descripcion"),
                F.lit(severity).alias("severidad"),
                bound.alias("limite"),
                excess.alias("exceso"),
            ),
        )

    none = F.lit(None).cast("double")
    found = present(
        [
            violation(
                "EXCEDE_LIMITE",
                "ALTA",
                text(
                    "Monto ${} excede límite ${} para tipo '{}'",
                    fixed(F.col("amount"), 2),
                    limit_text,
                    F.col("supplier_type"),
                ),
                limit,
                F.col("amount") - limit,
            ),
            violation(
                "FECHA_INVALIDA",
                "MEDIA",
                text("Due date anterior a invoice date ({} días)", F.col("days_until_due")),
                none,
                none,
            ),
            violation(
                "TERMINOS_INCOHERENTES",
                "BAJA",
                text(
                    "Payment terms ({}d) vs días reales ({}d)",
                    F.col("payment_terms_days").cast("double"),
                    F.col("days_until_due"),
                ),
                none,
                none,
            ),
        ]
    )
    return (
        with_limits(tx, pol)
        .select("transaction_id", "supplier_type", "amount", F.explode(found).alias("v"))
        .select(
            "transaction_id",
            "v.tipo_inconsistencia",
            "v.descripcion",
            "v.severidad",
            "supplier_type",
            "amount",
            "v.limite",
            "v.exceso",
        )
    )


def summary_totals(tx: DataFrame) -> DataFrame:
    return tx.agg(
        F.count(F.lit(1)).alias("total_transacciones"),
        money_sum(F.col("amount")).alias("monto_total"),
        money_mean(F.col("amount")).alias("monto_promedio"),
        F.count_if(F.col("num_related_transactions") > 0).alias("transacciones_con_referencias"),
    )


def summary_counts(tx: DataFrame, found: DataFrame) -> DataFrame:
    spread = value_counts(
        tx, {"status": "status", "tipo_proveedor": "supplier_type", "creador": "created_by"}
    )
    kinds = value_counts(found, {"inconsistencias": "tipo_inconsistencia"})
    return spread.unionByName(kinds)
