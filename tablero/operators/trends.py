"""Monthly trend operators and the fact export."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablero.functions import money, periods
from tablero.operators.conditions import highest, not_cancelled, status
from tablero.sources.facts import FactStore
from tablero.sources.tables import recent

Tables = Mapping[str, DataFrame]


def _order_costs(lines: DataFrame, products: DataFrame) -> DataFrame:
    """One row per order: number of lines and cost of what was sold (NULL if unknown)."""
    product = products.select(F.col("id").alias("producto_id"), "precio_costo")
    return (
        lines.select("orden_id", "producto_id", "cantidad")
        .join(product, "producto_id", "left")
        .groupBy(F.col("orden_id").alias("id"))
        .agg(
            F.count(F.lit(1)).alias("lineas"),
            money.total(F.col("cantidad") * F.col("precio_costo")).alias("costo"),
        )
    )


def _with_costs(t: Tables, orders: DataFrame, some: bool) -> DataFrame:
    """Orders with the number of rows a join to their lines would give, and their cost.

    If they are only ``some`` orders, the lines of others go before products and sums.
    """
    lines = t["items_orden"]
    if some:
        lines = lines.join(orders.select(F.col("id").alias("orden_id")), "orden_id", "left_semi")
    return _priced(orders, lines, t["productos"])


def _priced(orders: DataFrame, lines: DataFrame, products: DataFrame) -> DataFrame:
    return orders.join(_order_costs(lines, products), "id", "left").withColumn(
        "filas", F.coalesce(F.col("lineas"), F.lit(1).cast("bigint"))
    )


def monthly_trend(t: Tables, as_of: dt.date, since: dt.date | None = None) -> DataFrame:
    """Live sales per month; order amounts count once per order line, as joined."""
    return _monthly_trend(t, since, F.col("filas"))


def monthly_trend_without_fanout(t: Tables, as_of: dt.date) -> DataFrame:
    """The documented intent: each order amount counts once."""
    return _monthly_trend(t, None, F.lit(1).cast("bigint"))


def _live(orders: DataFrame) -> DataFrame:
    return orders.filter(not_cancelled()).select(
        "id", "cliente_id", "fecha_orden", "monto_total", "estado")


def _monthly_trend(t: Tables, since: dt.date | None, factor: Column) -> DataFrame:
    orders = _live(recent(t, "ordenes", since))
    return _trend_of(_with_costs(t, orders, since is not None), factor)


def trend_of_months(store: FactStore, months: Sequence[dt.date]) -> DataFrame:
    """The monthly trend of some months; of the stored facts only theirs are read."""
    orders = _live(store.orders(months))
    return _trend_of(_priced(orders, store.lines(months), store["productos"]), F.col("filas"))


def _trend_of(orders: DataFrame, factor: Column) -> DataFrame:
    amount = (F.col("monto_total") * F.col("veces")).cast("decimal(25,2)")
    by_month = (
        orders
        .withColumn("veces", factor)
        .groupBy(periods.month_of(F.col("fecha_orden")).alias("mes"))
        .agg(
            F.count("id").alias("ordenes"),
            F.count_distinct("cliente_id").alias("clientes"),
            money.total(amount).alias("ingresos"),
            F.sum("veces").alias("veces"),
            money.total_if(status("entregado"), amount).alias("ingresos_entregados"),
            money.total_if(status("cancelado"), amount).alias("ingresos_cancelados"),
            money.total(F.coalesce(F.col("costo"), F.lit(0).cast(money.SUM))).alias("costo"),
        )
    )
    return by_month.select(
        "mes",
        F.year("mes").alias("anio"),
        F.month("mes").alias("numero_mes"),
        "ordenes",
        "clientes",
        "ingresos",
        money.mean6(F.col("ingresos"), F.col("veces")).alias("valor_promedio_orden"),
        "ingresos_entregados",
        "ingresos_cancelados",
        (F.col("ingresos") - F.col("costo")).cast(money.SUM).alias("ganancia_bruta"),
    ).orderBy(highest("mes"))


def _two_years(as_of: dt.date) -> dt.date:
    return periods.shift_months(periods.year_start(as_of), -12)


def trend_two_years(t: Tables, as_of: dt.date) -> DataFrame:
    """The monthly trend of this year and the previous one."""
    return monthly_trend(t, as_of, since=_two_years(as_of))


def two_years_of(trend: DataFrame, as_of: dt.date) -> DataFrame:
    """The same from the stored monthly trend; the bound reaches its scan."""
    return trend.filter(F.col("mes") >= F.lit(_two_years(as_of))).orderBy(highest("mes"))


def last_twelve_months(t: Tables, as_of: dt.date) -> DataFrame:
    """Monthly trend of the last twelve months; rows count order lines, as joined."""
    orders = _live(recent(t, "ordenes", periods.shift_months(as_of, -12)))
    amount = (F.col("monto_total") * F.col("filas")).cast("decimal(25,2)")
    by_month = (
        _with_costs(t, orders, some=True)
        .groupBy(periods.month_of(F.col("fecha_orden")).alias("mes"))
        .agg(
            F.sum("filas").alias("cantidad_ordenes"),
            F.count_distinct("cliente_id").alias("clientes_unicos"),
            money.total(amount).alias("ingresos"),
            money.total(F.col("costo")).alias("costo"),
            F.coalesce(F.sum(F.when(status("entregado"), F.col("filas"))), F.lit(0))
            .alias("ordenes_entregadas"),
            F.coalesce(F.sum(F.when(status("cancelado"), F.col("filas"))), F.lit(0))
            .alias("ordenes_canceladas"),
        )
    )
    return by_month.select(
        "mes",
        "cantidad_ordenes",
        "clientes_unicos",
        "ingresos",
        money.mean(F.col("ingresos"), F.col("cantidad_ordenes")).alias("valor_promedio_orden"),
        (F.col("ingresos") - F.col("costo")).cast(money.SUM).alias("ganancia_bruta"),
        "ordenes_entregadas",
        "ordenes_canceladas",
    ).orderBy(highest("mes"))


def fact_export(t: Tables, as_of: dt.date) -> DataFrame:
    """Denormalised facts of the last twelve months, one row per order line.

    Orders without lines are a branch of their own: the inner join lets the runtime split an
    order with very many lines, which the inner side of an outer join would not allow. Left
    unsorted; the consumer stores it by month (see ``sinks.write_fact_export``).
    """
    orders = _described(t, recent(t, "ordenes", periods.shift_months(as_of, -12)))
    line = t["items_orden"].select(*_LINE)
    with_lines = orders.join(line, "orden_id")
    without = orders.join(line.select("orden_id").distinct(), "orden_id", "left_anti")
    return with_lines.unionByName(without, allowMissingColumns=True)


def fact_export_in_place(store: FactStore, as_of: dt.date) -> DataFrame:
    """The same over stored facts: orders meet their lines in their buckets, each read once.

    The outer join is safe there; orders of very many lines are a branch of their own, and have
    lines, so their join can be the inner one that the runtime splits.
    """
    since = periods.shift_months(as_of, -12)
    from_month = F.col("mes") >= F.lit(periods.month_start(since))
    parts = []
    for (orders, lines), how in zip(store.pairs(), ("left", "inner"), strict=True):
        recent_ = orders.filter(from_month & periods.within(F.col("fecha_orden"), since))
        parts.append(_described(store, recent_).join(
            lines.filter(from_month).select(*_LINE), "orden_id", how))
    return parts[0].unionByName(parts[1])


_LINE = ("orden_id", "producto_id", "cantidad", "total_linea")


def _described(t: Tables, orders: DataFrame) -> DataFrame:
    """Orders with the columns of their client and rep."""
    client = t["clientes"].select(
        F.col("id").alias("cliente_id"), "segmento", "industria", "tamano_empresa"
    )
    rep = t["vendedores"].select(
        F.col("id").alias("vendedor_id"), F.col("nombre").alias("nombre_vendedor"), "equipo"
    )
    return (
        orders.select(
            F.col("id").alias("orden_id"),
            F.col("uuid").alias("orden_uuid"),
            "fecha_orden",
            "monto_total",
            "estado",
            "estado_pago",
            "cliente_id",
            F.col("vendedor_id").alias("orden_vendedor"),
        )
        .join(client, "cliente_id")
        .join(rep, F.col("orden_vendedor") == F.col("vendedor_id"), "left")
        .select(
            "orden_id",
            "orden_uuid",
            "fecha_orden",
            "monto_total",
            "estado",
            "estado_pago",
            "cliente_id",
            "segmento",
            "industria",
            "tamano_empresa",
            "vendedor_id",
            "nombre_vendedor",
            "equipo",
        )
    )
