"""Product operators: categories, rankings, unsold products, return rates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from tablero.functions import money, periods
from tablero.functions.ranking import row_number
from tablero.operators.conditions import highest, not_cancelled, zero

Tables = Mapping[str, DataFrame]


def _active_products(t: Tables) -> DataFrame:
    return t["productos"].filter(F.col("activo"))


def _per_product(t: Tables) -> DataFrame:
    """Order lines reduced to one row per product, keyed ``id`` like the dimension.

    Lines of cancelled orders count: the queries this serves join the orders from the left
    and then aggregate line columns only, which filters nothing. So the orders are not read.
    """
    return (
        t["items_orden"]
        .groupBy(F.col("producto_id").alias("id"))
        .agg(
            F.count_distinct("orden_id").alias("veces_pedido"),
            F.sum("cantidad").alias("cantidad_total_vendida"),
            money.total(F.col("total_linea")).alias("ingresos_totales"),
            F.sum("cantidad_devuelta").alias("total_devuelto"),
        )
    )


def by_category(t: Tables, as_of: dt.date) -> DataFrame:
    """Live sales per category and subcategory.

    Lines are reduced to one row per order and category before they meet the orders, so an
    order is one row per category and counting orders needs no second distinct.
    """
    product = t["productos"].select(
        F.col("id").alias("producto_id"), "categoria", "subcategoria", "precio_costo"
    )
    quantity = F.col("cantidad")
    per_order = (
        t["items_orden"]
        .join(product, "producto_id")
        .groupBy("orden_id", "categoria", "subcategoria")
        .agg(
            F.count(F.lit(1)).alias("lineas"),
            F.sum(quantity).alias("cantidad"),
            money.total(F.col("total_linea")).alias("ingresos"),
            money.total(F.col("precio_unitario")).alias("precios"),
            F.count("precio_unitario").alias("con_precio"),
            money.total(quantity * F.col("precio_costo")).alias("costo"),
            F.sum("cantidad_devuelta").alias("devueltas"),
        )
    )
    order = t["ordenes"].filter(not_cancelled()).select(F.col("id").alias("orden_id"), "cliente_id")
    grouped = (
        per_order.join(order, "orden_id")
        .groupBy("categoria", "subcategoria")
        .agg(
            F.count(F.lit(1)).alias("cantidad_ordenes"),
            F.sum("lineas").alias("unidades_vendidas"),
            F.sum("cantidad").alias("cantidad_total"),
            money.total(F.col("ingresos")).alias("ingresos_totales"),
            money.total(F.col("precios")).alias("precios"),
            F.sum("con_precio").alias("con_precio"),
            money.total(F.col("costo")).alias("costo_total"),
            F.count_distinct("cliente_id").alias("clientes_unicos"),
            F.sum("devueltas").alias("unidades_devueltas"),
        )
    )
    profit = (F.col("ingresos_totales") - F.col("costo_total")).cast(money.SUM)
    return grouped.select(
        "categoria",
        "subcategoria",
        "cantidad_ordenes",
        "unidades_vendidas",
        "cantidad_total",
        "ingresos_totales",
        money.mean6(F.col("precios"), F.col("con_precio")).alias("precio_unitario_promedio"),
        "costo_total",
        profit.alias("ganancia_bruta"),
        money.pct(profit, F.col("ingresos_totales")).alias("margen_ganancia_pct"),
        "clientes_unicos",
        "unidades_devueltas",
    ).orderBy(highest("ingresos_totales"), "categoria", "subcategoria")


def _category_sales(t: Tables, sold: DataFrame | None = None) -> DataFrame:
    sold = _per_product(t).drop("total_devuelto") if sold is None else sold
    return (
        _active_products(t)
        .select("categoria", "id", "uuid", "nombre", "sku")
        .join(sold, "id", "left")
        .select(
            "categoria",
            "id",
            "uuid",
            "nombre",
            "sku",
            zero("veces_pedido"),
            "cantidad_total_vendida",
            "ingresos_totales",
        )
    )


def product_months(lines: DataFrame) -> DataFrame:
    """Lines with a month reduced to one row per month and product.

    An order lies in one month, so its counts per month add up to those of all time.
    """
    return lines.groupBy("mes", "producto_id").agg(
        F.count_distinct("orden_id").alias("veces_pedido"),
        F.sum("cantidad").alias("cantidad_total_vendida"),
        money.total(F.col("total_linea")).alias("ingresos_totales"),
    )


def category_ranks_of_months(t: Tables, months: DataFrame) -> DataFrame:
    """``category_ranks`` from ``product_months`` rows."""
    sold = months.groupBy(F.col("producto_id").alias("id")).agg(
        F.sum("veces_pedido").alias("veces_pedido"),
        F.sum("cantidad_total_vendida").alias("cantidad_total_vendida"),
        money.total(F.col("ingresos_totales")).alias("ingresos_totales"),
    )
    return _ranked(_category_sales(t, sold))


def category_ranks(t: Tables, as_of: dt.date) -> DataFrame:
    """Every active product with its place by revenue in its category, in no order."""
    return _ranked(_category_sales(t))


def _ranked(sales: DataFrame) -> DataFrame:
    """A category may hold a large part of all products, so the places are numbered over range
    partitions instead of sorting one category in one task."""
    return row_number(
        sales,
        ["categoria"],
        [highest("ingresos_totales"), F.col("id").asc()],
        "ranking_categoria",
    )


def ranking_by_category(t: Tables, as_of: dt.date) -> DataFrame:
    """The ranked products, best first within each category."""
    return category_ranks(t, as_of).orderBy("categoria", "ranking_categoria")


def top10_by_category(t: Tables, as_of: dt.date) -> DataFrame:
    """The first ten of each category; the rank limit is applied before the shuffle."""
    place = F.row_number().over(
        Window.partitionBy("categoria").orderBy(highest("ingresos_totales"), "id")
    )
    return (
        _category_sales(t)
        .withColumn("ranking_categoria", place.cast("bigint"))
        .filter(F.col("ranking_categoria") <= 10)
        .orderBy("categoria", "ranking_categoria")
    )


def top10_of_ranks(ranks: DataFrame) -> DataFrame:
    """The same from the stored ranks; the bound reaches their scan."""
    return ranks.filter(F.col("ranking_categoria") <= 10).orderBy("categoria", "ranking_categoria")


def top_products(t: Tables, as_of: dt.date) -> DataFrame:
    """The twenty active products with the highest revenue, with margin and profit."""
    price, cost = F.col("precio_lista"), F.col("precio_costo")
    quantity, revenue = F.col("cantidad_total_vendida"), F.col("ingresos_totales")
    spent = (quantity * cost).cast(money.SUM)
    return (
        _active_products(t)
        .select("id", "nombre", "sku", "categoria", "marca", "precio_lista", "precio_costo")
        .join(_per_product(t), "id", "left")
        .orderBy(highest("ingresos_totales"), "id")
        .limit(20)
        .select(
            "id",
            "nombre",
            "sku",
            "categoria",
            "marca",
            "precio_lista",
            "precio_costo",
            money.pct(price - cost, price).alias("margen_pct"),
            zero("veces_pedido"),
            "cantidad_total_vendida",
            "ingresos_totales",
            money.mean(revenue, quantity).alias("ingreso_promedio_por_unidad"),
            spent.alias("costo_total"),
            (revenue - spent).cast(money.SUM).alias("ganancia_bruta"),
            "total_devuelto",
        )
    )


def unsold(t: Tables, as_of: dt.date) -> DataFrame:
    """Active products no order line mentions, with the likely reason."""
    sold = t["items_orden"].select(F.col("producto_id").alias("id")).distinct()
    launched = F.col("fecha_lanzamiento")
    reason = (
        F.when(launched > F.lit(periods.shift_days(as_of, -90)), F.lit("Nuevo"))
        .when(F.col("fecha_descontinuacion").isNotNull(), F.lit("Descontinuado"))
        .otherwise(F.lit("Sin ventas"))
    )
    return (
        _active_products(t)
        .join(sold, "id", "left_anti")
        .select(
            "id",
            "nombre",
            "sku",
            "categoria",
            "marca",
            "precio_lista",
            "fecha_lanzamiento",
            periods.days_until(as_of, launched).alias("dias_desde_lanzamiento"),
            "stock_actual",
            reason.alias("razon_estado"),
        )
        .orderBy(highest("fecha_lanzamiento"), "id")
    )


def categories(t: Tables, as_of: dt.date) -> DataFrame:
    """Per category of active products: units, revenue, profit, margin and return rate.

    The first grouping, by category and order, makes an order one row per category.
    """
    product = _active_products(t).select(
        F.col("id").alias("producto_id"), "categoria", "precio_costo"
    )
    quantity = F.col("cantidad")
    sold = (
        t["items_orden"]
        .join(product, "producto_id")
        .groupBy("categoria", "orden_id")
        .agg(
            F.sum(quantity).alias("unidades"),
            money.total(F.col("total_linea")).alias("ingresos"),
            money.total(F.col("precio_unitario")).alias("precios"),
            F.count("precio_unitario").alias("con_precio"),
            money.total(quantity * F.col("precio_costo")).alias("costo"),
            F.sum("cantidad_devuelta").alias("devueltas"),
        )
        .groupBy("categoria")
        .agg(
            F.count(F.lit(1)).alias("ordenes"),
            F.sum("unidades").alias("unidades_vendidas"),
            money.total(F.col("ingresos")).alias("ingresos"),
            money.total(F.col("precios")).alias("precios"),
            F.sum("con_precio").alias("con_precio"),
            money.total(F.col("costo")).alias("costo"),
            F.sum("devueltas").alias("devueltas"),
        )
    )
    counts = product.groupBy("categoria").agg(F.count(F.lit(1)).alias("cantidad_productos"))
    revenue = F.col("ingresos")
    profit = (revenue - F.col("costo")).cast(money.SUM)
    return (
        counts.join(sold, "categoria", "left")
        .select(
            "categoria",
            "cantidad_productos",
            zero("ordenes"),
            "unidades_vendidas",
            "ingresos",
            money.mean(F.col("precios"), F.col("con_precio")).alias("precio_promedio"),
            profit.alias("ganancia_bruta"),
            money.pct(profit, revenue).alias("margen_ganancia_pct"),
            money.pct(F.col("devueltas"), F.col("unidades_vendidas")).alias("tasa_devolucion_pct"),
        )
        .orderBy(highest("ingresos"), "categoria")
    )


def return_rates(t: Tables, as_of: dt.date) -> DataFrame:
    """Products with at least ten units sold and some returned, by share returned."""
    sold = _per_product(t).filter(
        (F.col("cantidad_total_vendida") >= 10) & (F.col("total_devuelto") > 0)
    )
    return (
        t["productos"]
        .select("id", "categoria", "nombre", "sku")
        .join(sold, "id")
        .select(
            "id",
            "categoria",
            "nombre",
            "sku",
            "veces_pedido",
            F.col("cantidad_total_vendida").alias("total_vendido"),
            "total_devuelto",
            money.pct(F.col("total_devuelto"), F.col("cantidad_total_vendida"))
            .alias("tasa_devolucion_pct"),
        )
        .orderBy(highest("tasa_devolucion_pct"), "id")
        .drop("id")
    )
