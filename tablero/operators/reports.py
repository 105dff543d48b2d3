"""Short reports on top of the views."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from tablero.functions import money, periods
from tablero.operators import clients, products, reps, sales
from tablero.operators.conditions import highest

Tables = Mapping[str, DataFrame]


def month_by_day(t: Tables, as_of: dt.date) -> DataFrame:
    """The daily summary of this month only."""
    return sales.daily_summary(t, as_of, since=periods.month_start(as_of))


def month_sales(t: Tables, as_of: dt.date) -> DataFrame:
    """Revenue of this month."""
    days = sales.daily_summary(t, as_of, since=periods.month_start(as_of))
    return days.agg(money.total(F.col("ingresos_totales")).alias("ingresos_mes"))


def best_reps(t: Tables, as_of: dt.date) -> DataFrame:
    """The ten reps with the highest sales."""
    view = reps.performance(t, as_of)
    return view.limit(10).select("nombre", "ventas_totales", "porcentaje_cumplimiento_cuota")


def best_clients(t: Tables, as_of: dt.date) -> DataFrame:
    """The twenty clients with the highest value of the segmentation view."""
    view = clients.segmentation(t, as_of)
    return view.limit(20).select("nombre", "valor_vida", "segmento")


def category_margins(t: Tables, as_of: dt.date) -> DataFrame:
    """Categories by margin."""
    view = products.by_category(t, as_of)
    return view.select(
        "categoria", "subcategoria", "margen_ganancia_pct", "ingresos_totales"
    ).orderBy(highest("margen_ganancia_pct"), "categoria", "subcategoria")
