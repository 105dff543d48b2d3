"""Client operators: segmentation, top clients, clients at risk, new clients."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tablero.functions import money, periods
from tablero.operators.conditions import highest, not_cancelled, paid, status, unpaid, zero

Tables = Mapping[str, DataFrame]


def _active_clients(t: Tables) -> DataFrame:
    return t["clientes"].filter(F.col("activo"))


def _per_client(orders: DataFrame, *measures: Column) -> DataFrame:
    """Orders reduced to one row per client, keyed ``id`` like the dimension."""
    return orders.groupBy(F.col("cliente_id").alias("id")).agg(*measures)


def segmentation(t: Tables, as_of: dt.date) -> DataFrame:
    """Active clients with orders and interactions.

    As in a three-way join, each order counts once per interaction of its client in sums
    and conditional counts. That factor is applied to the per-client totals instead of
    building orders x interactions rows.
    """
    return _segmentation(t, as_of, fan_out=True)


def segmentation_without_fanout(t: Tables, as_of: dt.date) -> DataFrame:
    """The documented intent: each order counts once."""
    return _segmentation(t, as_of, fan_out=False)


def _segmentation(t: Tables, as_of: dt.date, fan_out: bool) -> DataFrame:
    total = F.col("monto_total")
    moment = F.col("fecha_orden")
    bought = _per_client(
        t["ordenes"],
        F.count("id").alias("total_ordenes"),
        money.total(total).alias("suma"),
        F.count(total).alias("con_monto"),
        F.max(moment).alias("fecha_ultima_compra"),
        F.min(moment).alias("primera"),
        F.count_distinct(periods.month_of(moment)).alias("meses_activos"),
        money.count_if(status("cancelado")).alias("canceladas"),
        money.count_if(F.col("estado_pago") != F.lit("pagado")).alias("sin_pago"),
    )
    contacted = (
        t["interacciones_clientes"]
        .groupBy(F.col("cliente_id").alias("id"))
        .agg(
            F.count("id").alias("total_interacciones"),
            F.max("fecha_interaccion").alias("fecha_ultima_interaccion"),
        )
    )
    factor = (
        F.greatest(F.coalesce(F.col("total_interacciones"), F.lit(1)), F.lit(1))
        if fan_out
        else F.lit(1).cast("bigint")
    )
    last, first = F.col("fecha_ultima_compra"), F.col("primera")
    months = F.expr("days_since_first div 30")
    return (
        _active_clients(t)
        .select("id", "uuid", "nombre", "segmento", "industria", "tamano_empresa", "pais")
        .join(bought, "id", "left")
        .join(contacted, "id", "left")
        .withColumn("days_since_first", periods.days_until(as_of, first))
        .select(
            "id",
            "uuid",
            "nombre",
            "segmento",
            "industria",
            "tamano_empresa",
            "pais",
            zero("total_ordenes"),
            (F.col("suma") * factor).cast(money.SUM).alias("valor_vida"),
            money.mean6(F.col("suma"), F.col("con_monto")).alias("valor_promedio_orden"),
            "fecha_ultima_compra",
            periods.days_until(as_of, last).alias("dias_desde_ultima_compra"),
            F.date_diff(F.to_date(last), F.to_date(first)).alias("dias_como_cliente"),
            money.mean(
                F.coalesce(F.col("total_ordenes"), F.lit(0)), F.greatest(F.lit(1), months)
            ).alias("ordenes_por_mes"),
            zero("meses_activos"),
            F.coalesce(F.col("canceladas") * factor, F.lit(0)).alias("ordenes_canceladas"),
            F.coalesce(F.col("sin_pago") * factor, F.lit(0)).alias("ordenes_sin_pago"),
            zero("total_interacciones"),
            "fecha_ultima_interaccion",
        )
        .orderBy(highest("valor_vida"), "id")
    )


def segments(t: Tables, as_of: dt.date) -> DataFrame:
    """Active clients, orders, revenue and conversion per segment."""
    total = F.col("monto_total")
    bought = _per_client(
        t["ordenes"].filter(not_cancelled()),
        F.count("id").alias("ordenes"),
        money.total(total).alias("suma"),
        F.count(total).alias("con_monto"),
    )
    by_segment = (
        _active_clients(t)
        .select("id", "segmento")
        .join(bought, "id", "left")
        .groupBy("segmento")
        .agg(
            F.count("id").alias("total_clientes"),
            F.coalesce(F.sum("ordenes"), F.lit(0)).alias("total_ordenes"),
            money.total(F.col("suma")).alias("ingresos_totales"),
            F.sum("con_monto").alias("con_monto"),
            F.count("ordenes").alias("clientes_con_ordenes"),
        )
    )
    revenue, clients = F.col("ingresos_totales"), F.col("total_clientes")
    return by_segment.select(
        "segmento",
        "total_clientes",
        "total_ordenes",
        "ingresos_totales",
        money.mean(revenue, F.col("con_monto")).alias("valor_promedio_orden"),
        money.mean(revenue, clients).alias("ingresos_por_cliente"),
        "clientes_con_ordenes",
        money.pct(F.col("clientes_con_ordenes"), clients).alias("pct_conversion"),
    ).orderBy(highest("ingresos_totales"), "segmento")


def top_clients(t: Tables, as_of: dt.date) -> DataFrame:
    """The twenty active clients with the highest lifetime value."""
    total = F.col("monto_total")
    bought = _per_client(
        t["ordenes"].filter(not_cancelled()),
        F.count("id").alias("total_ordenes"),
        money.total(total).alias("valor_vida"),
        F.count(total).alias("con_monto"),
        F.max("fecha_orden").alias("fecha_ultima_compra"),
        money.count_if(paid()).alias("ordenes_pagadas"),
        money.count_if(unpaid()).alias("ordenes_sin_pago"),
    )
    return (
        _active_clients(t)
        .select("id", "nombre", "segmento", "industria", "pais")
        .join(bought, "id", "left")
        .orderBy(highest("valor_vida"), "id")
        .limit(20)
        .select(
            "id",
            "nombre",
            "segmento",
            "industria",
            "pais",
            zero("total_ordenes"),
            "valor_vida",
            money.mean(F.col("valor_vida"), F.col("con_monto")).alias("valor_promedio_orden"),
            "fecha_ultima_compra",
            periods.days_until(as_of, F.col("fecha_ultima_compra"))
            .alias("dias_desde_ultima_compra"),
            zero("ordenes_pagadas"),
            zero("ordenes_sin_pago"),
        )
    )


def at_risk(t: Tables, as_of: dt.date) -> DataFrame:
    """Active clients whose last order, of any status, is more than 90 days old."""
    bought = _per_client(
        t["ordenes"],
        F.max("fecha_orden").alias("fecha_ultima_compra"),
        F.count("id").alias("ordenes_totales"),
        money.total(F.col("monto_total")).alias("total_gastado"),
    ).filter(F.col("fecha_ultima_compra") < F.lit(periods.shift_days(as_of, -90)))
    return (
        _active_clients(t)
        .select("id", "nombre", "segmento", "valor_vida_total")
        .join(bought, "id")
        .select(
            "id",
            "nombre",
            "segmento",
            "valor_vida_total",
            "fecha_ultima_compra",
            periods.days_until(as_of, F.col("fecha_ultima_compra")).alias("dias_inactivo"),
            "ordenes_totales",
            "total_gastado",
        )
        .orderBy(highest("dias_inactivo"), "id")
    )


def new_clients(t: Tables, as_of: dt.date) -> DataFrame:
    """Clients acquired in the last 30 days, inactive ones too, with their orders.

    ``fecha_primera_orden`` holds the latest order, as the query it stands for computes it.
    """
    bought = _per_client(
        t["ordenes"],
        F.count("id").alias("ordenes_desde_adquisicion"),
        money.total(F.col("monto_total")).alias("valor_compra_inicial"),
        F.max("fecha_orden").alias("fecha_primera_orden"),
    )
    acquired = F.col("fecha_adquisicion") >= F.lit(periods.shift_days(as_of, -30))
    return (
        t["clientes"]
        .filter(acquired)
        .select("id", "nombre", "segmento", "industria", "tamano_empresa", "fecha_adquisicion")
        .join(bought, "id", "left")
        .withColumn("ordenes_desde_adquisicion", zero("ordenes_desde_adquisicion"))
        .orderBy(highest("fecha_adquisicion"), "id")
    )
