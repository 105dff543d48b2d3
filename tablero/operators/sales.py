"""Order-grain operators: daily summary, month KPIs, payment status, weekly report."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tablero.functions import money, periods
from tablero.operators.conditions import highest, not_cancelled, paid, status, unpaid
from tablero.sources.tables import recent

Tables = Mapping[str, DataFrame]


def daily_summary(t: Tables, as_of: dt.date, since: dt.date | None = None) -> DataFrame:
    """Sales per order day over the last two years, or from ``since`` on.

    ``id`` is the primary key, so a plain count is the count of distinct orders.
    """
    start = periods.shift_months(as_of, -24)
    if since is not None:
        start = max(start, since)
    total = F.col("monto_total")
    return (
        recent(t, "ordenes", start)
        .groupBy(periods.day_of(F.col("fecha_orden")).alias("fecha_venta"))
        .agg(
            F.count("id").alias("cantidad_ordenes"),
            F.count_distinct("cliente_id").alias("clientes_unicos"),
            F.count_distinct("vendedor_id").alias("vendedores_involucrados"),
            money.total(total).alias("ingresos_totales"),
            money.avg6(total).alias("valor_promedio_orden"),
            F.min(total).alias("orden_minima"),
            F.max(total).alias("orden_maxima"),
            money.total(F.col("subtotal")).alias("suma_subtotales"),
            money.total(F.col("monto_descuento")).alias("total_descuentos"),
            money.total(F.col("monto_impuesto")).alias("total_impuestos"),
            money.total(F.col("costo_envio")).alias("total_envios"),
            money.count_if(status("entregado")).alias("ordenes_entregadas"),
            money.count_if(status("cancelado")).alias("ordenes_canceladas"),
            money.count_if(paid()).alias("ordenes_pagadas"),
            money.count_if(F.col("estado_pago") == F.lit("pendiente"))
            .alias("ordenes_pago_pendiente"),
        )
        .orderBy(highest("fecha_venta"))
    )


def month_kpis(t: Tables, as_of: dt.date) -> DataFrame:
    """One row of indicators for the month of ``as_of``."""
    first = periods.month_start(as_of)
    total = F.col("monto_total")
    return recent(t, "ordenes", first, periods.shift_months(first, 1)).agg(
        F.count("id").alias("total_ordenes"),
        F.count_distinct("cliente_id").alias("clientes_unicos"),
        money.total(total).alias("ingresos_totales"),
        money.avg6(total).alias("valor_promedio_orden"),
        money.total_if(status("entregado"), total).alias("ingresos_entregados"),
        money.total_if(unpaid(), total).alias("monto_impago"),
        money.count_if(paid()).alias("ordenes_pagadas"),
        money.count_if(status("cancelado")).alias("ordenes_canceladas"),
    )


def month_against_previous(t: Tables, as_of: dt.date) -> DataFrame:
    """Current and previous month side by side, from one scan of both."""
    first = periods.month_start(as_of)
    current = F.col("fecha_orden") >= F.lit(first)
    total = F.col("monto_total")
    both = recent(
        t, "ordenes", periods.shift_months(first, -1), periods.shift_months(first, 1)
    ).agg(
        money.total(F.when(current, total)).alias("ingresos_mes_actual"),
        money.total(F.when(~current, total)).alias("ingresos_mes_anterior"),
        money.count_if(current).alias("ordenes_mes_actual"),
        money.count_if(~current).alias("ordenes_mes_anterior"),
    )

    def growth(measure: str) -> Column:
        now, before = F.col(f"{measure}_mes_actual"), F.col(f"{measure}_mes_anterior")
        return money.pct(now - before, before).alias(f"crecimiento_{measure}_pct")

    return both.select(
        "ingresos_mes_actual",
        "ingresos_mes_anterior",
        growth("ingresos"),
        "ordenes_mes_actual",
        "ordenes_mes_anterior",
        growth("ordenes"),
    )


def last_week(t: Tables, as_of: dt.date) -> DataFrame:
    """The last seven days by day, with the weekday name."""
    day = periods.day_of(F.col("fecha_orden"))
    total = F.col("monto_total")
    return (
        recent(t, "ordenes", periods.shift_days(as_of, -7))
        .groupBy(day.alias("fecha"))
        .agg(
            F.count(F.lit(1)).alias("ordenes"),
            money.total(total).alias("ingresos"),
            money.avg6(total).alias("valor_promedio_orden"),
            money.count_if(status("entregado")).alias("entregadas"),
            money.count_if(paid()).alias("ordenes_pagadas"),
        )
        .select(
            "fecha",
            F.date_format("fecha", "EEEE").alias("nombre_dia"),
            "ordenes",
            "ingresos",
            "valor_promedio_orden",
            "entregadas",
            "ordenes_pagadas",
        )
        .orderBy(highest("fecha"))
    )


def payment_status(t: Tables, as_of: dt.date) -> DataFrame:
    """Open amounts of live orders per payment status."""
    total = F.col("monto_total")
    return (
        t["ordenes"]
        .filter(not_cancelled() & F.col("estado_pago").isin("pendiente", "parcial", "vencido"))
        .groupBy("estado_pago")
        .agg(
            F.count("id").alias("cantidad_ordenes"),
            money.total(total).alias("monto_pendiente"),
            money.avg6(total).alias("monto_promedio_orden"),
            F.max("fecha_orden").alias("orden_mas_reciente"),
        )
        .orderBy(highest("monto_pendiente"), "estado_pago")
    )


def overdue_orders(t: Tables, as_of: dt.date) -> DataFrame:
    """Live orders unpaid for more than 60 days, with their client and collection priority.

    A row-level join: a client with very many orders is split by the runtime's skew join.
    """
    age = periods.days_until(as_of, F.col("fecha_orden"))
    late = (
        recent(t, "ordenes", None, periods.shift_days(as_of, -60))
        .filter(not_cancelled() & F.col("estado_pago").isin("pendiente", "parcial", "vencido"))
        .select("id", "uuid", "cliente_id", "fecha_orden", "monto_total", "estado_pago")
    )
    client = t["clientes"].select(
        F.col("id").alias("cliente_id"), F.col("nombre").alias("nombre_cliente"), "email"
    )
    return (
        late.join(client, "cliente_id")
        .select(
            "id",
            "uuid",
            "nombre_cliente",
            "email",
            "fecha_orden",
            "monto_total",
            "estado_pago",
            age.alias("dias_atraso"),
            F.when(age > 90, F.lit("Crítico"))
            .when(age > 60, F.lit("Urgente"))
            .otherwise(F.lit("Seguimiento"))
            .alias("prioridad_cobranza"),
        )
        .orderBy(highest("dias_atraso"), "id")
    )


def payment_methods(t: Tables, as_of: dt.date) -> DataFrame:
    """Live orders per payment method, with the share that is paid."""
    total = F.col("monto_total")
    by_method = (
        t["ordenes"]
        .filter(not_cancelled())
        .groupBy("metodo_pago")
        .agg(
            F.count(F.lit(1)).alias("cantidad_transacciones"),
            money.total(total).alias("monto_total"),
            money.avg2(total).alias("monto_promedio"),
            money.count_if(paid()).alias("pagos_exitosos"),
            money.count_if(unpaid()).alias("pagos_pendientes"),
        )
    )
    return by_method.withColumn(
        "tasa_exito_pct", money.pct(F.col("pagos_exitosos"), F.col("cantidad_transacciones"))
    ).orderBy(highest("monto_total"), "metodo_pago")


def weekly_report(t: Tables, as_of: dt.date) -> DataFrame:
    """One row for the last week, also when it has no order."""
    week = recent(t, "ordenes", periods.shift_days(as_of, -7)).agg(
        F.to_date(F.max("fecha_orden")).alias("fecha_fin"),
        F.count(F.lit(1)).alias("ordenes"),
        money.total(F.col("monto_total")).alias("ingresos"),
        F.count_distinct("cliente_id").alias("clientes_activos"),
        money.count_if(status("cancelado")).alias("ordenes_canceladas"),
        money.count_if(paid()).alias("pagadas"),
    )
    return week.select(
        F.lit("Semana").alias("periodo"),
        F.date_sub("fecha_fin", 6).alias("fecha_inicio"),
        "fecha_fin",
        "ordenes",
        "ingresos",
        "clientes_activos",
        "ordenes_canceladas",
        money.pct(F.col("pagadas"), F.col("ordenes")).alias("pct_cobrado"),
    )


def kpis_30_days(t: Tables, as_of: dt.date) -> DataFrame:
    """Four headline figures of the last 30 days from one scan."""
    total = F.col("monto_total")
    return recent(t, "ordenes", periods.shift_days(as_of, -30)).agg(
        F.count(F.lit(1)).alias("ordenes_30d"),
        money.total(total).alias("ingresos_30d"),
        F.count_distinct("cliente_id").alias("clientes_30d"),
        money.avg6(total).alias("promedio_30d"),
    )


def monthly_revenue(t: Tables, as_of: dt.date) -> DataFrame:
    """Revenue of the months that begin within the last twelve months.

    The filter is on the month, so every month shown is whole; on the raw date it reads
    "from the first month that begins on or after the bound".
    """
    bound = periods.shift_months(as_of, -12)
    first = periods.month_start(bound)
    if first < bound:
        first = periods.shift_months(first, 1)
    return (
        recent(t, "ordenes", first)
        .groupBy(periods.month_of(F.col("fecha_orden")).alias("mes"))
        .agg(money.total(F.col("monto_total")).alias("ingresos"))
        .orderBy("mes")
    )
