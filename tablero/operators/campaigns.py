"""Campaign operators: performance, active campaigns, recent return on spend."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tablero.functions import money, periods
from tablero.operators.conditions import highest, zero

Tables = Mapping[str, DataFrame]


def _per_unit(num: Column, den: Column) -> Column:
    """num / den with two decimals, or 0 where the divisor is not positive."""
    return F.when(den > 0, money.mean(num, den)).otherwise(F.lit(0).cast(money.AVG2))


def performance(t: Tables, as_of: dt.date) -> DataFrame:
    """Campaigns begun in the last two years with budget, funnel, return and audience.

    The bridge is reduced to one row per campaign and client, then to one per campaign.
    """
    audience = (
        t["campanas_clientes"]
        .groupBy("campana_id", "cliente_id")
        .agg(
            F.count("fecha_contacto").alias("contactos"),
            F.max(F.col("convirtio")).alias("convirtio"),
        )
        .groupBy(F.col("campana_id").alias("id"))
        .agg(
            F.count("cliente_id").alias("clientes_objetivo"),
            F.count(F.when(F.col("contactos") > 0, F.col("cliente_id")))
            .alias("clientes_contactados"),
            F.count(F.when(F.col("convirtio"), F.col("cliente_id"))).alias("clientes_convertidos"),
        )
    )
    spend, revenue = F.col("gasto_real"), F.col("ingresos_generados")
    clicks, conversions = F.col("clics"), F.col("conversiones")
    return (
        t["campanas"]
        .filter(F.col("fecha_inicio") >= F.lit(periods.shift_months(as_of, -24)))
        .join(audience, "id", "left")
        .select(
            "id",
            "uuid",
            "nombre",
            "tipo_campana",
            "canal",
            "fecha_inicio",
            "fecha_fin",
            "presupuesto",
            "gasto_real",
            money.pct(spend, F.col("presupuesto")).alias("pct_presupuesto_usado"),
            "impresiones",
            "clics",
            "conversiones",
            "ingresos_generados",
            money.pct(clicks.cast("bigint"), F.col("impresiones")).alias("ctr_pct"),
            money.pct(conversions.cast("bigint"), clicks).alias("tasa_conversion_pct"),
            _per_unit(revenue, spend).alias("roi"),
            _per_unit(spend, conversions).alias("costo_por_conversion"),
            zero("clientes_objetivo"),
            zero("clientes_contactados"),
            zero("clientes_convertidos"),
        )
        .orderBy(highest("fecha_inicio"), "id")
    )


def active(t: Tables, as_of: dt.date) -> DataFrame:
    """Campaigns that are active or ended within the last 30 days."""
    nothing = F.lit(0).cast("decimal(15,2)")

    def known(column: str, default: Column) -> Column:
        return F.coalesce(F.col(column), default)

    spend, revenue = known("gasto_real", nothing), known("ingresos_generados", nothing)
    views, clicks = known("impresiones", F.lit(0)), known("clics", F.lit(0))
    conversions = known("conversiones", F.lit(0))
    one = F.lit(1)
    live = (F.col("estado") == F.lit("activa")) | (
        F.col("fecha_fin") >= F.lit(periods.shift_days(as_of, -30))
    )
    return (
        t["campanas"]
        .filter(live)
        .orderBy(revenue.desc(), "id")
        .select(
            "nombre",
            "tipo_campana",
            "canal",
            "fecha_inicio",
            "fecha_fin",
            known("presupuesto", nothing).alias("presupuesto"),
            spend.alias("gasto_real"),
            money.pct(spend, known("presupuesto", one.cast("decimal(15,2)")))
            .alias("pct_presupuesto_usado"),
            views.alias("impresiones"),
            clicks.alias("clics"),
            money.pct(clicks.cast("bigint"), known("impresiones", one)).alias("ctr_pct"),
            conversions.alias("conversiones"),
            money.pct(conversions.cast("bigint"), known("clics", one)).alias("tasa_conversion_pct"),
            revenue.alias("ingresos_generados"),
            _per_unit(revenue, spend).alias("roi"),
        )
    )


def recent_roi(t: Tables, as_of: dt.date) -> DataFrame:
    """Campaigns that ended within the last three months, by return on spend."""
    return (
        performance(t, as_of)
        .filter(F.col("fecha_fin") >= F.lit(periods.shift_months(as_of, -3)))
        .orderBy(highest("roi"), "id")
        .select("nombre", "roi", "canal")
    )
