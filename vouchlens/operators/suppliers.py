"""Supplier performance, risk segments, approval matrix and credit limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchlens.functions.columns import lookup_value, money_mean, money_sum, share
from vouchlens.operators.features import fit_levels
from vouchlens.plans.lookup import Measured, measured
from vouchlens.plans.quantiles import quantile_values
from vouchlens.roles import SupplierRoles

# Scales, segments, policies, limits.
CATEGORY_RISK = {"Alto": 3, "Medio": 2, "Bajo": 1}
SIZE_RISK = {"Pequeña": 3, "Mediana": 2, "Grande": 1}
SIZES = ["Grande", "Mediana", "Pequeña"]
LEVELS = ["Crítico", "Regular", "Bueno", "Excelente"]
SEGMENTS = ["Premium", "Estándar", "Supervisión", "Alto_Riesgo"]
SEGMENT_POLICY = {  # limit, terms, discount, approval, review
    "Premium": (50000, "Net 90", 15, "Automática", "Anual"),
    "Estándar": (35000, "Net 60", 10, "Jefe Compras", "Semestral"),
    "Supervisión": (20000, "Net 30", 5, "Gerente", "Trimestral"),
    "Alto_Riesgo": (10000, "Anticipado", 0, "Director", "Mensual"),
}
BASE_LIMIT = {
    "Premium": 45000.0,
    "Estándar": 30000.0,
    "Supervisión": 18000.0,
    "Alto_Riesgo": 8000.0,
}
SIZE_FACTOR = {"Grande": 1.3, "Mediana": 1.0, "Pequeña": 0.8}
PERFORMANCE_BENCHMARK = 80
NO_CERTIFICATE = "None"


def parse_suppliers(df: DataFrame, r: SupplierRoles) -> DataFrame:
    """Text literals of figures and certificates turned into columns, with defaults."""
    figures = F.from_json(
        r.performance, "on_time_delivery string, quality_issues int, customer_complaints int"
    )
    punctual = F.regexp_replace(F.col("_p.on_time_delivery"), "%", "").try_cast("int")
    listed = F.coalesce(
        F.from_json(r.certificates, "array<string>"), F.array().cast("array<string>")
    )
    return (
        df.withColumn("_p", figures)
        .withColumns(
            {
                "on_time_delivery": F.coalesce(punctual, F.lit(0)),
                "quality_issues": F.coalesce("_p.quality_issues", F.lit(0)),
                "customer_complaints": F.coalesce("_p.customer_complaints", F.lit(0)),
                "certificaciones_list": listed,
            }
        )
        .withColumn(
            "num_certificaciones",
            F.size(F.filter("certificaciones_list", lambda c: c != NO_CERTIFICATE)),
        )
        .drop("_p")
    )


def with_performance(df: DataFrame) -> DataFrame:
    def kept(count: str) -> Column:
        return 100 - F.col(count) * 10

    score = (
        F.col("on_time_delivery") * 0.5
        + kept("quality_issues") * 0.3
        + kept("customer_complaints") * 0.2
    )
    return df.withColumn("score_performance", score)


def with_level(df: DataFrame) -> DataFrame:
    """Bins closed on the right; a score outside (0, 100] has no level."""
    p = F.col("score_performance")
    return df.withColumn(
        "nivel_performance",
        F.when(p <= 0, None)
        .when(p <= 60, "Crítico")
        .when(p <= 75, "Regular")
        .when(p <= 90, "Bueno")
        .when(p <= 100, "Excelente"),
    )


def with_risk_score(df: DataFrame, r: SupplierRoles) -> DataFrame:
    certificates = F.greatest(F.lit(0), F.least(F.lit(3), F.col("num_certificaciones")))
    score = (
        lookup_value(F.col(r.category), CATEGORY_RISK) * 30
        + lookup_value(F.col(r.size), SIZE_RISK) * 20
        + (100 - F.col("score_performance")) * 0.4
        + (3 - certificates) * 10
    )
    return df.withColumn("score_riesgo", score)


def with_segment(table: DataFrame | Measured) -> DataFrame:
    """Quartile segment; equal edges are an error, as equal scores must share a segment."""
    df = table.df if isinstance(table, Measured) else table
    edges = quantile_values(
        table, "score_riesgo", {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q4": 1.0}
    )
    x = F.col("score_riesgo")
    e = [F.col(f"_e.q{i}") for i in range(5)]
    repeated = (e[0] == e[1]) | (e[1] == e[2]) | (e[2] == e[3]) | (e[3] == e[4])
    segment = F.when(repeated, F.raise_error(F.lit("segment edges must be distinct")))
    for name, edge in zip(SEGMENTS, e[1:], strict=True):
        segment = segment.when(x <= edge, F.lit(name))
    return df.withColumn("_e", edges).withColumn("segmento_riesgo", segment).drop("_e")


def analyse(df: DataFrame, r: SupplierRoles) -> DataFrame:
    """Parsed, scored, rated and segmented suppliers.

    Every report reads this table, so the parsed and scored rows are computed once.
    """
    scored = with_level(with_performance(parse_suppliers(df, r)))
    return with_segment(measured(with_risk_score(scored, r)))


def _mean(column: str, digits: int = 2) -> Column:
    return F.bround(F.avg(column), digits)


def _std(column: str, digits: int = 2) -> Column:
    return F.bround(F.stddev_samp(column), digits)


def _n() -> Column:
    return F.count(F.lit(1))


def by_size(df: DataFrame, r: SupplierRoles) -> DataFrame:
    return df.where(F.col(r.size).isNotNull()).groupBy(F.col(r.size).alias("tipo_empresa")).agg(
        _mean("on_time_delivery").alias("entrega_puntual_media"),
        _std("on_time_delivery").alias("entrega_puntual_std"),
        _mean("quality_issues").alias("issues_calidad_media"),
        F.sum("quality_issues").alias("issues_calidad_total"),
        _mean("customer_complaints").alias("quejas_media"),
        F.sum("customer_complaints").alias("quejas_total"),
        _mean("score_performance").alias("score_performance_media"),
        F.count(r.id).alias("total_proveedores"),
    )


def size_ranking(df: DataFrame, r: SupplierRoles) -> DataFrame:
    mean = F.avg("score_performance").alias("score_performance")
    return (
        df.where(F.col(r.size).isNotNull())
        .groupBy(F.col(r.size).alias("tipo_empresa"))
        .agg(mean)
        .orderBy(F.desc("score_performance"), "tipo_empresa")
    )


def by_country(df: DataFrame, r: SupplierRoles) -> DataFrame:
    credit = F.col(r.credit)
    return (
        df.where(F.col(r.country).isNotNull())
        .groupBy(F.col(r.country).alias("pais"))
        .agg(
            _mean("score_riesgo").alias("riesgo_medio"),
            _std("score_riesgo").alias("riesgo_std"),
            _mean("score_performance").alias("performance_medio"),
            F.bround(money_mean(credit), 2).alias("credito_promedio"),
            F.bround(money_sum(credit), 2).alias("credito_total"),
            F.count_if(F.col(r.category) == "Alto").alias("proveedores_alto_riesgo"),
            F.count(r.id).alias("total_proveedores"),
        )
        .withColumn(
            "pct_alto_riesgo",
            share(F.col("proveedores_alto_riesgo"), F.col("total_proveedores"), 1),
        )
    )


def country_ranking(df: DataFrame, r: SupplierRoles) -> DataFrame:
    mean = F.avg("score_riesgo").alias("score_riesgo")
    return (
        df.where(F.col(r.country).isNotNull())
        .groupBy(F.col(r.country).alias("pais"))
        .agg(mean)
        .orderBy(F.desc("score_riesgo"), "pais")
    )


def by_certificate_count(df: DataFrame, r: SupplierRoles) -> DataFrame:
    return df.groupBy("num_certificaciones").agg(
        _mean("score_performance").alias("performance_medio"),
        _mean("on_time_delivery").alias("entrega_puntual_media"),
        _mean("score_riesgo").alias("riesgo_medio"),
        F.count(r.id).alias("total_proveedores"),
    )


def by_certificate(df: DataFrame) -> DataFrame:
    """A certificate listed twice by a supplier counts twice."""
    each = df.select(
        F.explode("certificaciones_list").alias("certificacion"),
        "score_performance",
        "score_riesgo",
    ).where(F.col("certificacion") != NO_CERTIFICATE)
    return each.groupBy("certificacion").agg(
        _mean("score_performance").alias("performance"),
        _mean("score_riesgo").alias("riesgo"),
        _n().alias("frecuencia"),
    )


def approval_matrix(df: DataFrame, r: SupplierRoles) -> DataFrame:
    """Four policy rows with the figures of their segment, empty segments included."""
    policy = df.sparkSession.createDataFrame(
        [(s, *SEGMENT_POLICY[s]) for s in SEGMENTS],
        "segmento string, limite_credito_max int, condiciones_pago string, descuento_maximo int, "
        "requiere_aprobacion string, frecuencia_revision string",
    )
    stats = df.groupBy(F.col("segmento_riesgo").alias("segmento")).agg(
        F.count(r.id).alias("num_proveedores"),
        _mean("score_performance").alias("performance_promedio"),
        F.bround(money_mean(F.col(r.credit)), 2).alias("credito_actual_promedio"),
    )
    return policy.join(stats, "segmento", "left")


def credit_recommendations(df: DataFrame, r: SupplierRoles) -> DataFrame:
    current = F.col(r.credit)
    wanted = F.bround(
        lookup_value(F.col("segmento_riesgo"), BASE_LIMIT)
        * (F.col("score_performance") / PERFORMANCE_BENCHMARK)
        * lookup_value(F.col(r.size), SIZE_FACTOR),
        -2,
    )
    change = F.col("limite_recomendado") - current
    against_zero = F.when(change > 0, float("inf")).when(change < 0, float("-inf"))
    variation = F.when(current == 0, against_zero).otherwise(
        F.bround(F.try_divide(change, current) * 100, 1)
    )
    return (
        df.withColumn("limite_recomendado", wanted)
        .withColumn("variacion_credito", variation)
        .withColumn(
            "accion_credito",
            F.when(F.col("variacion_credito") > 10, "Aumentar")
            .when(F.col("variacion_credito") < -10, "Reducir")
            .otherwise("Mantener"),
        )
        .select(
            r.id,
            r.name,
            r.size,
            r.country,
            "segmento_riesgo",
            "nivel_performance",
            r.credit,
            "limite_recomendado",
            "variacion_credito",
            "accion_credito",
        )
    )


# --- reports ----------------------------------------------------------------


def segment_distribution(df: DataFrame) -> DataFrame:
    """All four segments, also empty ones."""
    counts = df.agg(
        _n().alias("n"), *[F.count_if(F.col("segmento_riesgo") == s).alias(s) for s in SEGMENTS]
    )
    rows = [
        F.struct(
            F.lit(s).alias("segmento"), F.col(s).alias("proveedores"), share(F.col(s), F.col("n")).alias("pct")
        )
        for s in SEGMENTS
    ]
    return counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def segment_by_size(df: DataFrame, r: SupplierRoles) -> DataFrame:
    """Crosstab with margins; the row ``All`` is the total, the column ``All`` the sum of the types.

    The declared sizes have a column each, also without suppliers, and so has every other company type
    of the data. Suppliers without a type are counted nowhere, as those without a segment.
    """
    typed = df.where(F.col("segmento_riesgo").isNotNull() & F.col(r.size).isNotNull())
    sizes = [*SIZES, *(s for s in fit_levels(typed, [r.size])[r.size] if s not in SIZES)]
    name = F.when(F.grouping("segmento_riesgo") == 1, "All").otherwise(F.col("segmento_riesgo"))
    return (
        typed.rollup("segmento_riesgo")
        .agg(
            name.alias("segmento"),
            *[F.count_if(F.col(r.size) == s).alias(s) for s in sizes],
            _n().alias("All"),
        )
        .drop("segmento_riesgo")
    )


def top_per_segment(df: DataFrame, r: SupplierRoles, n: int = 3) -> DataFrame:
    """The rank limit is applied before the shuffle too, so few rows per segment move."""
    order = Window.partitionBy("segmento_riesgo").orderBy(F.desc("score_performance"), r.id)
    return (
        df.where(F.col("segmento_riesgo").isNotNull())
        .withColumn("puesto", F.row_number().over(order))
        .where(F.col("puesto") <= n)
        .select("segmento_riesgo", "puesto", r.id, r.name, r.size, r.country, "score_performance")
    )


def risk_by_size(df: DataFrame, r: SupplierRoles) -> DataFrame:
    return df.where(F.col(r.size).isNotNull()).groupBy(F.col(r.size).alias("tipo_empresa")).agg(
        _mean("score_riesgo").alias("riesgo_medio"),
        _std("score_riesgo").alias("riesgo_std"),
        F.bround(F.min("score_riesgo"), 2).alias("riesgo_min"),
        F.bround(F.max("score_riesgo"), 2).alias("riesgo_max"),
        _mean("score_performance").alias("performance_medio"),
    )


def risk_by_country(df: DataFrame, r: SupplierRoles) -> DataFrame:
    return (
        df.where(F.col(r.country).isNotNull())
        .groupBy(F.col(r.country).alias("pais"))
        .agg(
            _mean("score_riesgo").alias("riesgo_medio"),
            _mean("score_performance").alias("performance_medio"),
            F.count(r.id).alias("num_proveedores"),
        )
        .orderBy(F.desc("riesgo_medio"), "pais")
    )


def declared_against_score(df: DataFrame, r: SupplierRoles) -> DataFrame:
    return df.where(F.col(r.category).isNotNull()).groupBy(F.col(r.category).alias("categoria")).agg(
        _mean("score_riesgo").alias("score_medio"),
        F.bround(F.min("score_riesgo"), 2).alias("score_min"),
        F.bround(F.max("score_riesgo"), 2).alias("score_max"),
        F.count(r.id).alias("cantidad"),
    )


def misclassified(df: DataFrame, r: SupplierRoles) -> DataFrame:
    level, category = F.col("nivel_performance"), F.col(r.category)
    return df.agg(
        F.count_if((category == "Alto") & level.isin("Bueno", "Excelente")).alias("alto_con_buen_performance"),
        F.count_if((category == "Bajo") & level.isin("Crítico", "Regular")).alias("bajo_con_mal_performance"),
    )


def action_distribution(recommended: DataFrame) -> DataFrame:
    total = recommended.agg(_n().alias("n")).scalar()
    counts = recommended.groupBy("accion_credito").agg(_n().alias("proveedores"))
    return counts.withColumn("pct", share(F.col("proveedores"), total))


def top_changes(recommended: DataFrame, r: SupplierRoles, action: str, n: int = 10) -> DataFrame:
    by = F.col("variacion_credito")
    return (
        recommended.where(F.col("accion_credito") == action)
        .orderBy(by.desc() if action == "Aumentar" else by.asc(), r.id)
        .limit(n)
    )


def portfolio(recommended: DataFrame, r: SupplierRoles) -> DataFrame:
    return recommended.agg(
        money_sum(F.col(r.credit)).alias("credito_actual"),
        money_sum(F.col("limite_recomendado")).alias("credito_recomendado"),
    ).withColumn("diferencia", F.col("credito_recomendado") - F.col("credito_actual"))


def headline(df: DataFrame, r: SupplierRoles) -> DataFrame:
    return df.agg(
        _n().alias("total_proveedores"),
        F.count_if(F.col("segmento_riesgo") == "Alto_Riesgo").alias("alto_riesgo"),
        F.count_if(F.col("segmento_riesgo") == "Premium").alias("premium"),
        F.avg("score_performance").alias("performance_promedio"),
        money_sum(F.col(r.credit)).alias("credito_total"),
    )


def level_counts(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("nivel_performance").isNotNull())
        .groupBy("nivel_performance")
        .agg(_n().alias("proveedores"))
    )


def performance_by_size(df: DataFrame, r: SupplierRoles) -> DataFrame:
    return df.groupBy(F.col(r.size).alias("tipo_empresa")).agg(
        _mean("score_performance").alias("performance_promedio"), F.count(r.id).alias("cantidad")
    )


def credit_points(recommended: DataFrame, r: SupplierRoles) -> DataFrame:
    return recommended.select(
        r.id, r.credit, "limite_recomendado", "accion_credito", "segmento_riesgo"
    )


def risk_points(df: DataFrame, r: SupplierRoles) -> DataFrame:
    return df.select(
        r.id, "score_performance", "score_riesgo", "segmento_riesgo", r.size, "num_certificaciones"
    )
