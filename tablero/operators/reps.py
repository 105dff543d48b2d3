"""Sales-rep operators: performance view, month ranking, year comparison."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from tablero.functions import money, periods
from tablero.operators.conditions import highest, not_cancelled, status, zero
from tablero.sources.tables import recent

Tables = Mapping[str, DataFrame]


def _active_reps(t: Tables) -> DataFrame:
    return t["vendedores"].filter(F.col("activo"))


def performance(t: Tables, as_of: dt.date) -> DataFrame:
    """Active reps with everything they sold, this month's quota and the last sale.

    Orders are reduced to one row per rep before the join. ``ordenes_canceladas`` is always
    0, as cancelled orders never reach the count.
    """
    first = periods.month_start(as_of)
    this_month = periods.within(F.col("fecha_orden"), first, periods.shift_months(first, 1))
    total = F.col("monto_total")
    sold = (
        t["ordenes"]
        .filter(not_cancelled() & F.col("vendedor_id").isNotNull())
        .groupBy(F.col("vendedor_id").alias("id"))
        .agg(
            F.count("id").alias("total_ordenes"),
            F.count_distinct("cliente_id").alias("clientes_unicos"),
            money.total(total).alias("ventas_totales"),
            F.count(total).alias("con_monto"),
            F.count_distinct(periods.day_of(F.col("fecha_orden"))).alias("dias_activos_venta"),
            money.count_if(status("entregado")).alias("ordenes_entregadas"),
            money.count_if(status("cancelado")).alias("ordenes_canceladas"),
            money.count_if(F.col("estado_pago") == F.lit("pendiente")).alias("ordenes_sin_pago"),
            money.total_if(this_month, total).alias("ventas_mes_actual"),
            F.max("fecha_orden").alias("fecha_ultima_venta"),
        )
    )
    sales = F.col("ventas_totales")
    earned = money.commission(sales, F.col("tasa_comision"))
    month_sales = F.coalesce(F.col("ventas_mes_actual"), F.lit(0).cast(money.SUM))
    return (
        _active_reps(t)
        .select("id", "uuid", "nombre", "equipo", "territorio", "cuota_mensual", "tasa_comision")
        .join(sold, "id", "left")
        .select(
            "id",
            "uuid",
            "nombre",
            "equipo",
            "territorio",
            "cuota_mensual",
            zero("total_ordenes"),
            zero("clientes_unicos"),
            "ventas_totales",
            money.mean6(sales, F.col("con_monto")).alias("valor_promedio_orden"),
            (sales - earned).cast("decimal(31,6)").alias("ventas_netas"),
            earned.alias("monto_comision"),
            zero("dias_activos_venta"),
            zero("ordenes_entregadas"),
            zero("ordenes_canceladas"),
            zero("ordenes_sin_pago"),
            month_sales.alias("ventas_mes_actual"),
            money.pct(month_sales, F.col("cuota_mensual")).alias("porcentaje_cumplimiento_cuota"),
            "fecha_ultima_venta",
            periods.days_until(as_of, F.col("fecha_ultima_venta")).alias("dias_desde_ultima_venta"),
        )
        .orderBy(highest("ventas_totales"), "id")
    )


def top_of_month(t: Tables, as_of: dt.date) -> DataFrame:
    """The ten active reps with the highest sales this month."""
    first = periods.month_start(as_of)
    sold = (
        recent(t, "ordenes", first, periods.shift_months(first, 1))
        .filter(not_cancelled() & F.col("vendedor_id").isNotNull())
        .groupBy(F.col("vendedor_id").alias("id"))
        .agg(
            F.count("id").alias("ordenes"),
            money.total(F.col("monto_total")).alias("ventas_totales"),
            F.count_distinct("cliente_id").alias("clientes_unicos"),
            F.max("fecha_orden").alias("fecha_ultima_venta"),
        )
    )
    sales = F.col("ventas_totales")
    earned = money.commission(sales, F.col("tasa_comision"))
    return (
        _active_reps(t)
        .select("id", "nombre", "equipo", "territorio", "cuota_mensual", "tasa_comision")
        .join(sold, "id", "left")
        .orderBy(highest("ventas_totales"), "id")
        .limit(10)
        .select(
            F.col("nombre").alias("nombre_vendedor"),
            "equipo",
            "territorio",
            "cuota_mensual",
            zero("ordenes"),
            "ventas_totales",
            money.pct(sales, F.col("cuota_mensual")).alias("pct_cumplimiento_cuota"),
            F.round(earned, 2).cast(money.SUM).alias("comision_ganada"),
            zero("clientes_unicos"),
            "fecha_ultima_venta",
        )
    )


def year_against_previous(t: Tables, as_of: dt.date) -> DataFrame:
    """Sales of this calendar year and of the whole previous one per active rep.

    Both sides of the comparison hold the same active reps, so one scan with two conditional
    sums pairs them. Without sales last year the growth divides by 1.
    """
    this_year = periods.year_start(as_of)
    last_year = periods.shift_months(this_year, -12)
    current = F.col("fecha_orden") >= F.lit(this_year)
    total = F.col("monto_total")
    sold = (
        recent(t, "ordenes", last_year, periods.shift_months(this_year, 12))
        .filter(not_cancelled() & F.col("vendedor_id").isNotNull())
        .groupBy(F.col("vendedor_id").alias("id"))
        .agg(
            money.total(F.when(current, total)).alias("actual"),
            money.total(F.when(~current, total)).alias("anterior"),
        )
    )
    none = F.lit(0).cast(money.SUM)
    now = F.coalesce(F.col("actual"), none)
    before = F.coalesce(F.col("anterior"), none)
    divisor = F.coalesce(F.col("anterior"), F.lit(1).cast(money.SUM))
    return (
        _active_reps(t)
        .select("id", "nombre")
        .join(sold, "id", "left")
        .orderBy(now.desc(), "id")
        .select(
            "nombre",
            now.alias("ventas_ytd_actual"),
            before.alias("ventas_ytd_anterior"),
            money.pct(now - before, divisor).alias("crecimiento_yoy_pct"),
        )
    )
