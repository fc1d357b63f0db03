"""Which column plays which part. Every operator takes its columns from here."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PaymentRoles:
    """Columns of a payments table; the defaults are the names of the role view."""

    id: str = "id"
    supplier: str = "supplier"
    invoice: str = "invoice_date"
    due: str = "due_date"
    amount: str = "amount"
    terms: str = "terms"
    credit_days: str = "credit_days"
    status: str = "status"
    discount: str = "discount"
    penalty: str = "penalty"
    approver: str = "approver"
    # Fixed values of the payment states.
    paid: str = "Pagado"
    pending: str = "Pendiente"
    delayed: str = "Retrasado"


# Column names of the payments CSV.
PAYMENTS_CSV = PaymentRoles(
    id="ID_transaccion",
    supplier="proveedor_id",
    invoice="fecha_factura",
    due="fecha_vencimiento",
    amount="monto",
    terms="condiciones_pago",
    credit_days="dias_credito",
    status="estado_pago",
    discount="descuento_pronto_pago",
    penalty="penalizacion_mora",
    approver="aprobador",
)


@dataclass(frozen=True)
class HistoryRoles:
    """Columns of a payment history."""

    date: str = "fecha"
    supplier: str = "proveedor_id"
    category: str = "categoria_gasto"
    method: str = "método_pago"
    amount: str = "monto"
    time: str = "tiempo_procesamiento"
    score: str = "score_cumplimiento"
    indicator: str = "indicadores_economicos"
    season: str = "estacionalidad"
    status: str = "estado_pago"

    @property
    def categorical(self) -> list[str]:
        return [self.category, self.method, self.indicator, self.season]

    @property
    def numeric(self) -> list[str]:
        return [self.amount, self.time, self.score]


# Categories accepted by the cleaning step.
VALID_CATEGORIES = {
    "categoria_gasto": ["Tecnología", "Materiales", "Logística", "Servicios"],
    "método_pago": ["Efectivo", "Cheque", "Transferencia"],
    "indicadores_economicos": ["Creciente", "Estable", "Decreciente"],
    "estacionalidad": ["Alta", "Baja"],
}

# Order of the ordinal categories.
ORDINAL_LEVELS = {
    "indicadores_economicos": ["Decreciente", "Estable", "Creciente"],
    "estacionalidad": ["Baja", "Alta"],
}


@dataclass(frozen=True)
class SupplierRoles:
    """Columns of the supplier master table."""

    id: str = "ID_proveedor"
    name: str = "nombre"
    size: str = "tipo_empresa"
    country: str = "país"
    category: str = "categoría_riesgo"
    credit: str = "límites_crédito"
    performance: str = "histórico_performance"
    certificates: str = "certificaciones"


@dataclass(frozen=True)
class CaseRoles:
    """Columns of the exception cases; a case id is used to break ties."""

    type: str = "tipo_caso"
    complexity: str = "nivel_complejidad"
    date: str = "fecha_incidencia"
    amount: str = "monto_involucrado"
    state: str = "estado"
    assignee: str = "responsable"
    ties: tuple[str, ...] = field(default=("case_id",))
    # Fixed values.
    open: str = "Abierto"
    in_process: str = "En Proceso"
    closed: str = "Cerrado"
    low: str = "Bajo"
    medium: str = "Medio"
    high: str = "Alto"
