"""Parametrised analyses: recurring revenue, churn, linear forecast, cohorts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablero.functions import money, periods
from tablero.operators.conditions import highest, not_cancelled
from tablero.sources.tables import recent

Tables = Mapping[str, DataFrame]


def _segment_of(t: Tables) -> DataFrame:
    return t["clientes"].select(F.col("id").alias("cliente_id"), "segmento")


def arr(t: Tables, as_of: dt.date, meses: int = 12) -> DataFrame:
    """Mean monthly revenue per segment over the window, and twelve times that.

    Months without a sale do not enter the mean; a window that begins mid-month has partial
    first and last months. Sales are reduced per client and month before the segment join.
    """
    monthly = (
        recent(t, "ordenes", periods.shift_months(as_of, -meses))
        .filter(not_cancelled())
        .groupBy("cliente_id", periods.month_of(F.col("fecha_orden")).alias("mes"))
        .agg(money.total(F.col("monto_total")).alias("ventas"))
        .join(_segment_of(t), "cliente_id")
        .groupBy("segmento", "mes")
        .agg(money.total(F.col("ventas")).alias("ventas"))
    )
    whole, months = F.sum("ventas"), F.count("ventas")
    return (
        monthly.groupBy("segmento")
        .agg(
            money.ratio(whole, months, 2, money.SUM).alias("ingreso_mensual"),
            money.ratio(whole * F.lit(12), months, 2, money.SUM).alias("ingreso_anual"),
        )
        .orderBy(highest("ingreso_anual"), "segmento")
    )


def churn(t: Tables, as_of: dt.date, dias: int = 90) -> DataFrame:
    """Clients of the last ``dias`` days per segment and how many stopped buying.

    Lost means no purchase in the last 30 days, which the latest purchase tells; one grouping
    by client replaces the exclusion and inclusion lists.
    """
    buyers = (
        recent(t, "ordenes", periods.shift_days(as_of, -dias))
        .filter(not_cancelled())
        .groupBy("cliente_id")
        .agg(F.max("fecha_orden").alias("ultima"))
        .join(_segment_of(t), "cliente_id")
    )
    lost = F.col("ultima") < F.lit(periods.shift_days(as_of, -30))
    return (
        buyers.groupBy("segmento")
        .agg(
            F.count(F.lit(1)).alias("total_clientes_inicio_periodo"),
            money.count_if(lost).alias("clientes_perdidos"),
        )
        .withColumn(
            "tasa_churn_pct",
            money.pct(F.col("clientes_perdidos"), F.col("total_clientes_inicio_periodo")),
        )
        .orderBy(highest("tasa_churn_pct"), "segmento")
    )


def forecast(
    t: Tables,
    as_of: dt.date,
    horizonte: int = 3,
    historico: int = 12,
    name: str = "ingreso_pronosticado",
) -> DataFrame:
    """Least-squares line through monthly revenue, extended by ``horizonte`` months.

    Months are numbered in order, so a month without sales closes up. A single month has no
    slope and gives no rows; a falling line stops at 0. The line is evaluated as one exact
    fraction, (Σy·d + s·(n·x − Σx)) / (n·d) with d = n·Σx² − (Σx)² and s = n·Σxy − Σx·Σy.
    """
    x = F.col("x")
    by_month = (
        recent(t, "ordenes", periods.shift_months(as_of, -historico))
        .filter(not_cancelled())
        .groupBy(periods.month_of(F.col("fecha_orden")).alias("mes"))
        .agg(money.total(F.col("monto_total")).alias("y"))
        # At most historico + 1 rows remain, so one window over them is one small task.
        .withColumn("x", F.row_number().over(Window.orderBy("mes")).cast("bigint"))
    )
    sums = by_month.agg(
        F.count("y").alias("n"),
        F.sum(x).alias("sx"),
        F.sum(x * x).alias("sxx"),
        money.total(F.col("y")).alias("sy"),
        F.sum((F.col("y") * x).cast(money.SUM)).cast("decimal(38,2)").alias("sxy"),
        F.max(x).alias("ultimo"),
        F.max("mes").alias("ultimo_mes"),
    )
    n, sx, ahead = F.col("n"), F.col("sx"), F.col("h")

    def times(amount: Column, count: Column) -> Column:
        return (amount.cast("decimal(38,2)") * count).cast("decimal(38,2)")

    d = n * F.col("sxx") - sx * sx
    s = times(F.col("sxy"), n) - times(F.col("sy"), sx)
    top = times(F.col("sy"), d) + times(s, n * (F.col("ultimo") + ahead) - sx)
    value = F.round(top.cast("decimal(30,2)") / (n * d), 2)
    return (
        sums.filter(d != 0)
        .withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizonte))))
        .select(
            F.add_months("ultimo_mes", F.col("h")).alias("mes_pronostico"),
            F.greatest(F.lit(0).cast(money.SUM), value.cast(money.SUM)).alias(name),
        )
        .orderBy("mes_pronostico")
    )


def dashboard_forecast(t: Tables, as_of: dt.date) -> DataFrame:
    return forecast(t, as_of, 3, 12, "ingresos_pronosticados")


def _client_months(t: Tables) -> DataFrame:
    """Live sales of known clients, one row per client and month."""
    return (
        t["ordenes"]
        .filter(not_cancelled())
        .groupBy("cliente_id", periods.month_of(F.col("fecha_orden")).alias("mes"))
        .agg(
            money.total(F.col("monto_total")).alias("ingresos"),
            F.count("id").alias("ordenes"),
        )
        .join(t["clientes"].select(F.col("id").alias("cliente_id")), "cliente_id", "left_semi")
    )


def _metric(metrica: str) -> Column:
    if metrica == "ingresos":
        return money.total(F.col("ingresos"))
    if metrica == "ordenes":
        return F.sum("ordenes").cast(money.SUM)
    return F.count(F.lit(1)).cast(money.SUM)


def cohorts(t: Tables, as_of: dt.date, metrica: str = "ingresos") -> DataFrame:
    """Month of first purchase by months since then: revenue, orders or clients.

    The window per client runs over that client's months, not over its orders.
    """
    months = _client_months(t).withColumn(
        "mes_cohorte", F.min("mes").over(Window.partitionBy("cliente_id"))
    )
    mes, first = F.col("mes"), F.col("mes_cohorte")
    since = (F.year(mes) - F.year(first)) * F.lit(12) + F.month(mes) - F.month(first)
    return (
        months.groupBy("mes_cohorte", since.alias("meses_desde_primera_orden"))
        .agg(
            _metric(metrica).alias("valor_metrica"),
            F.count(F.lit(1)).alias("cantidad_clientes"),
        )
        .orderBy(highest("mes_cohorte"), "meses_desde_primera_orden")
    )


def cohorts_literal(t: Tables, as_of: dt.date, metrica: str = "ingresos") -> DataFrame:
    """Cohorts when the first purchase is looked up within each month: always 0 months."""
    return (
        _client_months(t)
        .groupBy(F.col("mes").alias("mes_cohorte"))
        .agg(
            _metric(metrica).alias("valor_metrica"),
            F.count(F.lit(1)).alias("cantidad_clientes"),
        )
        .select(
            "mes_cohorte",
            F.lit(0).alias("meses_desde_primera_orden"),
            "valor_metrica",
            "cantidad_clientes",
        )
        .orderBy(highest("mes_cohorte"))
    )
