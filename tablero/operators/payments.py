"""Payment flow and return operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tablero.functions import money, periods
from tablero.operators.conditions import highest, status
from tablero.sources.tables import recent

Tables = Mapping[str, DataFrame]


def payment_flow(t: Tables, as_of: dt.date) -> DataFrame:
    """Payments of the last year per day and method, with how many orders paid late.

    Payments are first reduced per order, day and method. The latest of them decides whether
    the order was late, and each order is then one row, so nothing is counted distinct.
    """
    per_order = (
        recent(t, "pagos", periods.shift_months(as_of, -12))
        .groupBy("orden_id", periods.day_of(F.col("fecha_pago")).alias("dia"), "metodo_pago")
        .agg(
            F.count("id").alias("pagos"),
            money.total(F.col("monto")).alias("monto"),
            F.count("monto").alias("con_monto"),
            money.count_if(status("completado")).alias("exitosos"),
            money.count_if(status("fallido")).alias("fallidos"),
            money.count_if(status("reembolsado")).alias("reembolsados"),
            F.max("fecha_pago").alias("ultimo"),
        )
    )
    order = t["ordenes"].select(F.col("id").alias("orden_id"), "fecha_orden")

    def late(days: int) -> Column:
        return F.col("fecha_orden") + F.make_dt_interval(F.lit(days)) < F.col("ultimo")

    grouped = (
        per_order.join(order, "orden_id")
        .groupBy("dia", "metodo_pago")
        .agg(
            F.sum("pagos").alias("cantidad_pagos"),
            F.count(F.lit(1)).alias("ordenes_pagadas"),
            money.total(F.col("monto")).alias("total_cobrado"),
            F.sum("con_monto").alias("con_monto"),
            F.sum("exitosos").alias("pagos_exitosos"),
            F.sum("fallidos").alias("pagos_fallidos"),
            F.sum("reembolsados").alias("pagos_reembolsados"),
            money.count_if(late(30)).alias("pagos_atrasados_30d"),
            money.count_if(late(60)).alias("pagos_atrasados_60d"),
        )
    )
    return grouped.select(
        F.col("dia").alias("fecha_pago"),
        "metodo_pago",
        "cantidad_pagos",
        "ordenes_pagadas",
        "total_cobrado",
        money.mean6(F.col("total_cobrado"), F.col("con_monto")).alias("pago_promedio"),
        "pagos_exitosos",
        "pagos_fallidos",
        "pagos_reembolsados",
        "pagos_atrasados_30d",
        "pagos_atrasados_60d",
    ).orderBy(highest("fecha_pago"), "metodo_pago")


def returns(t: Tables, as_of: dt.date) -> DataFrame:
    """Returns of the last year per day, category and reason; refunds repeat per line."""
    return _returns(t, as_of, fan_out=True)


def returns_without_fanout(t: Tables, as_of: dt.date) -> DataFrame:
    """The documented intent: a return counts once in each category its order holds."""
    return _returns(t, as_of, fan_out=False)


def _returns(t: Tables, as_of: dt.date, fan_out: bool) -> DataFrame:
    """Returns reduced per order, day and reason meet lines reduced per order and category.

    The line count of a category multiplies what the row-level join would repeat; distinct
    returns and distinct orders come out as plain sums of those rows.
    """
    since = periods.shift_months(as_of, -12)
    reported = (
        recent(t, "devoluciones", since)
        .groupBy("orden_id", periods.day_of(F.col("fecha_devolucion")).alias("dia"), "motivo")
        .agg(
            F.count("id").alias("devoluciones"),
            money.total(F.col("monto_reembolso")).alias("reembolso"),
            money.count_if(status("aprobado")).alias("aprobadas"),
            money.count_if(status("pendiente")).alias("pendientes"),
            money.count_if(status("rechazado")).alias("rechazadas"),
        )
        .join(t["ordenes"].select(F.col("id").alias("orden_id")), "orden_id", "left_semi")
    )
    product = t["productos"].select(F.col("id").alias("producto_id"), "categoria", "subcategoria")
    lines = (
        t["items_orden"]
        .select("orden_id", "producto_id")
        .join(reported.select("orden_id").distinct(), "orden_id", "left_semi")
        .join(product, "producto_id", "left")
        .groupBy("orden_id", "categoria", "subcategoria")
        .agg(F.count(F.lit(1)).alias("lineas"))
    )
    placed = (
        recent(t, "ordenes", since)
        .groupBy(periods.day_of(F.col("fecha_orden")).alias("dia"))
        .agg(F.count("id").alias("ordenes_del_dia"))
    )
    times = F.coalesce(F.col("lineas"), F.lit(1)) if fan_out else F.lit(1)
    grouped = (
        reported.join(lines, "orden_id", "left")
        .withColumn("veces", times.cast("bigint"))
        .groupBy("dia", "categoria", "subcategoria", "motivo")
        .agg(
            F.sum("devoluciones").alias("cantidad_devoluciones"),
            money.total((F.col("reembolso") * F.col("veces")).cast(money.SUM))
            .alias("total_reembolsado"),
            F.count(F.lit(1)).alias("ordenes_con_devolucion"),
            F.sum(F.col("aprobadas") * F.col("veces")).alias("devoluciones_aprobadas"),
            F.sum(F.col("pendientes") * F.col("veces")).alias("devoluciones_pendientes"),
            F.sum(F.col("rechazadas") * F.col("veces")).alias("devoluciones_rechazadas"),
        )
    )
    return (
        grouped.join(placed, "dia", "left")
        .select(
            F.col("dia").alias("fecha_devolucion"),
            "categoria",
            "subcategoria",
            "cantidad_devoluciones",
            "total_reembolsado",
            "ordenes_con_devolucion",
            money.mean6(F.col("ordenes_con_devolucion"), F.col("ordenes_del_dia"))
            .alias("tasa_devolucion_pct"),
            "devoluciones_aprobadas",
            "devoluciones_pendientes",
            "devoluciones_rechazadas",
            "motivo",
        )
        .orderBy(highest("fecha_devolucion"), "categoria", "subcategoria", "motivo")
    )


def returns_summary(t: Tables, as_of: dt.date) -> DataFrame:
    """One row over all returns."""
    refund = F.col("monto_reembolso")
    whole = t["devoluciones"].agg(
        F.count("id").alias("total_devoluciones"),
        F.count_distinct("orden_id").alias("ordenes_con_devolucion"),
        money.total(refund).alias("total_reembolsado"),
        money.avg2(refund).alias("reembolso_promedio"),
        money.count_if(status("aprobado")).alias("devoluciones_aprobadas"),
        money.count_if(status("pendiente")).alias("devoluciones_pendientes"),
        money.count_if(status("rechazado")).alias("devoluciones_rechazadas"),
    )
    return whole.withColumn(
        "tasa_aprobacion_pct",
        money.pct(F.col("devoluciones_aprobadas"), F.col("total_devoluciones")),
    )


def return_reasons(t: Tables, as_of: dt.date) -> DataFrame:
    """The ten most frequent reasons of the last year, as a share of all returns ever."""
    refund = F.col("monto_reembolso")
    everything = t["devoluciones"].select(F.count(F.lit(1))).scalar()
    return (
        recent(t, "devoluciones", periods.shift_months(as_of, -12))
        .groupBy("motivo")
        .agg(
            F.count(F.lit(1)).alias("cantidad_devoluciones"),
            money.total(refund).alias("total_reembolsado"),
            money.avg2(refund).alias("reembolso_promedio"),
            money.count_if(status("aprobado")).alias("aprobadas"),
        )
        .orderBy(highest("cantidad_devoluciones"), "motivo")
        .limit(10)
        .withColumn("pct_del_total", money.pct(F.col("cantidad_devoluciones"), everything))
    )
