"""Every operator by its key, over the mapped retail tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from decimal import Decimal
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablero import stored
from tablero.functions import money, periods
from tablero.operators import (
    campaigns, clients, forecasts, generation, integrity, payments, products, reports, reps,
    sales, trends,
)
from tablero.plans.load import generate_all
from tablero.plans.refresh import refresh_materialized
from tablero.session import pinned, scratch_path
from tablero.sources.calendar import calendar
from tablero.sources.retail import AS_OF, EXPRESSIONS, RetailModel
from tablero.sources.sinks import write_fact_export

Tables = Mapping[str, DataFrame]
Operator = Callable[[Tables, dt.date], DataFrame]
Query = Callable[[SparkSession, str], DataFrame]

NOW = dt.datetime.combine(AS_OF, dt.time())

VIEWS: dict[str, Operator] = {
    "v_resumen_ventas_diario": sales.daily_summary,
    "v_ventas_por_categoria": products.by_category,
    "v_performance_vendedores": reps.performance,
    "v_segmentacion_clientes": clients.segmentation,
    "v_segmentacion_clientes_sin_fanout": clients.segmentation_without_fanout,
    "v_analisis_devoluciones": payments.returns,
    "v_analisis_devoluciones_sin_fanout": payments.returns_without_fanout,
    "v_analisis_pagos": payments.payment_flow,
    "v_performance_campanas": campaigns.performance,
    "mv_tendencia_ventas_mensual": trends.monthly_trend,
    "mv_tendencia_ventas_mensual_sin_fanout": trends.monthly_trend_without_fanout,
    "mv_top_productos_por_categoria": products.ranking_by_category,
}

FUNCTIONS: dict[str, Operator] = {
    "fn_calcular_arr": forecasts.arr,
    "fn_calcular_churn": forecasts.churn,
    "fn_pronostico_ventas": forecasts.forecast,
    "fn_analisis_cohortes": forecasts.cohorts,
    "fn_analisis_cohortes_ordenes": partial(forecasts.cohorts, metrica="ordenes"),
    "fn_analisis_cohortes_retencion": partial(forecasts.cohorts, metrica="retencion"),
    "fn_analisis_cohortes_literal": forecasts.cohorts_literal,
}

DASHBOARD: dict[str, Operator] = {
    "q01_kpis_mes": sales.month_kpis,
    "q02_mes_vs_anterior": sales.month_against_previous,
    "q03_tendencia_semana": sales.last_week,
    "q04_top_vendedores": reps.top_of_month,
    "q05_ytd_vs_anterior": reps.year_against_previous,
    "q06_segmentacion": clients.segments,
    "q07_top_clientes": clients.top_clients,
    "q08_clientes_riesgo": clients.at_risk,
    "q09_clientes_nuevos": clients.new_clients,
    "q10_top_productos": products.top_products,
    "q11_productos_sin_ventas": products.unsold,
    "q12_categorias": products.categories,
    "q13_estado_pagos": sales.payment_status,
    "q14_ordenes_atrasadas": sales.overdue_orders,
    "q15_metodos_pago": sales.payment_methods,
    "q16_resumen_devoluciones": payments.returns_summary,
    "q17_motivos_devolucion": payments.return_reasons,
    "q18_tasa_devolucion": products.return_rates,
    "q19_campanas_activas": campaigns.active,
    "q20_tendencia_mensual": trends.last_twelve_months,
    "q21_pronostico": forecasts.dashboard_forecast,
    "q22_reporte_semanal": sales.weekly_report,
    "q23_export_hechos": trends.fact_export,
    "q24_arr": forecasts.arr,
    "q25_churn": forecasts.churn,
    "q26_cohortes": forecasts.cohorts,
    "d01_resumen_mes": reports.month_by_day,
    "d04_ventas_mes": reports.month_sales,
    "d05_top_vendedores": reports.best_reps,
    "d06_top_clientes": reports.best_clients,
    "d07_roi_campanas": campaigns.recent_roi,
    "d08_kpis_30d": sales.kpis_30_days,
    "d09_mensual_cte": sales.monthly_revenue,
    "d10_margen_categoria": reports.category_margins,
}


def _over_model(operator: Operator) -> Query:
    def run(spark: SparkSession, path: str) -> DataFrame:
        return operator(RetailModel(spark, path), AS_OF)

    return run


def _clients_at_risk(spark: SparkSession, path: str) -> DataFrame:
    """The report shows the stored lifetime value, so the rollup runs first."""
    t = RetailModel(spark, path)
    return clients.at_risk({**_only(t, "ordenes"), "clientes": _valued(t)}, AS_OF)


def _only(t: RetailModel, *names: str) -> dict[str, DataFrame]:
    return {name: t[name] for name in names}


def _valued(t: RetailModel) -> DataFrame:
    return integrity.client_ltv(t["clientes"], t["ordenes"], now=NOW)


# Integrity jobs -------------------------------------------------------------------------


def _line_total(spark: SparkSession, path: str) -> DataFrame:
    items = RetailModel(spark, path)["items_orden"].drop("total_linea")
    return integrity.with_line_total(items).select(
        "orden_id", "producto_id", "cantidad", "precio_unitario", "porcentaje_descuento",
        "total_linea",
    )


def _order_totals(spark: SparkSession, path: str) -> DataFrame:
    t = RetailModel(spark, path)
    return integrity.order_totals(t["ordenes"], t["items_orden"], now=NOW).select(
        "id", "monto_total"
    )


def _order_totals_delta(spark: SparkSession, path: str) -> DataFrame:
    """Returned lines are deleted; only the orders that lost one are recomputed."""
    t = RetailModel(spark, path)
    items = t["items_orden"]
    kept = items.filter(F.col("cantidad_devuelta") == 0)
    deleted = items.filter(F.col("cantidad_devuelta") > 0)
    return integrity.order_totals(t["ordenes"], kept, deleted, now=NOW).select("id", "monto_total")


def _client_ltv(spark: SparkSession, path: str) -> DataFrame:
    return _valued(RetailModel(spark, path)).select(
        "id", "valor_vida_total", "fecha_ultima_compra"
    )


def _constraints(spark: SparkSession, path: str) -> DataFrame:
    return _without_line_ids(integrity.constraint_report(RetailModel(spark, path)))


def _without_line_ids(report: DataFrame) -> DataFrame:
    """Line ids of the mapped tables differ from scan to scan, so no example shows them."""
    line = (F.col("tabla") == F.lit("items_orden")) & ~F.col("tipo").isin("unico", "referencia")
    return report.withColumn("ejemplo", F.when(line & F.col("ejemplo").isNotNull(), F.lit("-"))
                             .otherwise(F.col("ejemplo")))


def _planted(spark: SparkSession, path: str) -> DataFrame:
    """The report over the same tables with rows that break a rule of every kind."""
    t = dict(RetailModel(spark, path))
    i, order = F.col("id"), F.col("orden_id")

    def where(column: Column, n: int, rest: int, value: object, otherwise: Column) -> Column:
        return F.when(column % n == rest, value).otherwise(otherwise)

    credit = F.col("limite_credito").cast("decimal(22,4)")
    t["clientes"] = t["clientes"].withColumns({
        "nombre": where(i, 50, 0, F.lit(None), where(
            i, 50, 1, F.repeat(F.lit("n"), 300), F.col("nombre"))),
        "segmento": where(i, 70, 1, F.lit("oro"), F.col("segmento")),
        "email": where(i, 90, 2, F.lit("c1@empresa.com"), where(
            i, 90, 3, F.lit(None), F.col("email"))),
        "limite_credito": (credit + F.when(i % 20 == 4, F.lit(Decimal("0.005"))).when(
            i % 20 == 5, F.lit(Decimal(90_000_000_000_000))).otherwise(F.lit(0))
        ).cast("decimal(25,4)"),
    })
    t["ordenes"] = t["ordenes"].withColumns({
        "id": where(i, 100, 7, i - 1, i),
        "cliente_id": where(i, 200, 9, -i, where(i, 200, 10, F.lit(None), F.col("cliente_id"))),
        "vendedor_id": where(i, 300, 11, F.lit(-3), F.col("vendedor_id")),
        "estado": where(i, 400, 12, F.lit("perdido"), F.col("estado")),
    })
    t["items_orden"] = t["items_orden"].withColumns({
        "cantidad": where(order, 300, 5, F.lit(0), F.col("cantidad")),
        "producto_id": where(order, 500, 6, F.lit(0), F.col("producto_id")),
    })
    t["campanas_clientes"] = t["campanas_clientes"].withColumns({
        "campana_id": where(i, 40, 1, F.lit(99), F.col("campana_id")),
        "cliente_id": where(i, 40, 2, F.lit(1), F.col("cliente_id")),
    })
    return _without_line_ids(integrity.constraint_report(t))


def _delete_cascade(spark: SparkSession, path: str) -> DataFrame:
    """Three deletions: references set to NULL, rows deleted along, rows free of restrictions."""
    t = RetailModel(spark, path)
    cancelled = t["ordenes"].filter(F.col("estado") == F.lit("cancelado")).select("id")
    for child in ("pagos", "devoluciones"):
        held = t[child].select(F.col("orden_id").alias("id")).distinct()
        cancelled = cancelled.join(held, "id", "left_anti")
    plans = {
        "vendedores inactivos": ("vendedores", t["vendedores"].filter(~F.col("activo"))),
        "campanas canceladas": (
            "campanas", t["campanas"].filter(F.col("estado") == F.lit("cancelada"))),
        "ordenes canceladas": ("ordenes", cancelled),
    }
    links = {"vendedores": "gerente_id", "ordenes": "vendedor_id",
             "interacciones_clientes": "vendedor_id"}
    parts = []
    for what, (table, keys) in plans.items():
        for name, df in sorted(integrity.delete_keys(t, table, keys).items()):
            counted = table == "vendedores" and name in links
            linked = F.count(links[name]) if counted else F.lit(None).cast("bigint")
            parts.append(df.agg(F.count(F.lit(1)).alias("filas"), linked.alias("con_referencia"))
                         .select(F.lit(what).alias("borrado"), F.lit(name).alias("tabla"),
                                 "filas", "con_referencia"))
    return reduce(DataFrame.unionByName, parts)


def _soft_delete(spark: SparkSession, path: str) -> DataFrame:
    t = RetailModel(spark, path)
    return integrity.soft_delete_clients(t["clientes"], AS_OF).select("id", "activo")


def _refresh(spark: SparkSession, path: str) -> DataFrame:
    """The seconds taken differ from run to run, so they are left out here."""
    target = scratch_path(spark, "materialized")
    report = refresh_materialized(spark, RetailModel(spark, path), target, AS_OF)
    return report.drop("tiempo_refresco")


# Sources --------------------------------------------------------------------------------


def _typed_tables(spark: SparkSession, path: str) -> DataFrame:
    """Rows per mapped table, and how many of its columns hold data."""
    t = RetailModel(spark, path)
    return reduce(DataFrame.unionByName, [
        t[name].agg(F.count(F.lit(1)).alias("filas")).select(
            F.lit(name).alias("tabla"), "filas",
            F.lit(len(EXPRESSIONS[name])).alias("columnas_con_datos"))
        for name in t
    ])


def _calendar(spark: SparkSession, path: str) -> DataFrame:
    """The date dimension with the orders of each day."""
    per_day = (
        RetailModel(spark, path)["ordenes"]
        .groupBy(periods.day_of(F.col("fecha_orden")).alias("fecha"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    days = calendar(spark, AS_OF)
    return days.join(per_day, "fecha", "left").select(
        *days.columns, F.coalesce("n", F.lit(0)).alias("cantidad_ordenes")
    )


def _stored_export(spark: SparkSession, path: str) -> DataFrame:
    """The fact export stored by month: rows and line revenue per stored month."""
    target = scratch_path(spark, "export")
    write_fact_export(trends.fact_export(RetailModel(spark, path), AS_OF), target)
    return (
        spark.read.parquet(target)
        .groupBy(F.col("mes").cast("date").alias("mes"))
        .agg(F.count(F.lit(1)).alias("filas"), money.total(F.col("total_linea")).alias("importe"))
    )


# Generators, sized and keyed by the given tables ------------------------------------------


def _keys(spark: SparkSession, path: str, table: str, key: str) -> DataFrame:
    return RetailModel(spark, path).raw(table).select((F.col(key) + F.lit(1)).alias("id"))


def _generated_columns(df: DataFrame) -> DataFrame:
    """Without the columns generators leave NULL and the load timestamps."""
    left_out = {"notas", "notas_internas", "fecha_ultima_compra", "fecha_descontinuacion",
                "fecha_baja", "fecha_entrega_real", "fecha_pago_orden", "ubicacion_almacen",
                "motivo_devolucion", "creado_en", "actualizado_en", "creado_por"}
    return df.drop(*left_out)


def _made_clients(spark: SparkSession, path: str) -> DataFrame:
    rows = generation.client_rows(_keys(spark, path, "customer", "c_custkey"), AS_OF)
    return _generated_columns(rows)


def _made_names(spark: SparkSession, path: str) -> DataFrame:
    return _made_clients(spark, path).select("id", "nombre")


def _made_emails(spark: SparkSession, path: str) -> DataFrame:
    return _made_clients(spark, path).select("id", "nombre", "email")


def _made_phones(spark: SparkSession, path: str) -> DataFrame:
    return _made_clients(spark, path).select("id", "telefono")


def _names_by_index(spark: SparkSession, path: str) -> DataFrame:
    asked = RetailModel(spark, path).raw("customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit("M")).otherwise(F.lit("F")).alias("genero"),
        (F.col("c_custkey") % 12).cast("int").alias("i_nombre"),
        (F.col("c_nationkey") % 11 + 1).alias("i_apellido"),
    )
    return generation.names_by_index(asked, "genero", "i_nombre", "i_apellido")


def _made_products(spark: SparkSession, path: str) -> DataFrame:
    rows = generation.product_rows(_keys(spark, path, "part", "p_partkey"), AS_OF)
    return _generated_columns(rows)


def _made_reps(spark: SparkSession, path: str) -> DataFrame:
    rows = generation.rep_rows(_keys(spark, path, "supplier", "s_suppkey"), AS_OF)
    return _generated_columns(rows)


def _order_base(spark: SparkSession, path: str) -> DataFrame:
    return generation.order_rows(_keys(spark, path, "orders", "o_orderkey"), AS_OF)


def _made_orders(spark: SparkSession, path: str) -> DataFrame:
    made = generation.assign_parties(_order_base(spark, path), RetailModel(spark, path))
    return _generated_columns(made).drop(
        "subtotal", "monto_descuento", "monto_total", "fecha_pago"
    )


def _made_items(spark: SparkSession, path: str) -> DataFrame:
    products_ = RetailModel(spark, path)["productos"]
    return _generated_columns(generation.generate_items(_order_base(spark, path), products_))


def _made_payments(spark: SparkSession, path: str) -> DataFrame:
    t = RetailModel(spark, path)
    base = _order_base(spark, path)
    lines = generation.generate_items(base, t["productos"])
    totals = integrity.order_totals(base, lines, now=NOW)
    # Payments follow written orders, as in the load.
    written = pinned(totals.select("id", "estado_pago", "monto_total"), "orders")
    return _generated_columns(generation.generate_payments(written, AS_OF))


def _generate_all(spark: SparkSession, path: str) -> DataFrame:
    t = RetailModel(spark, path)
    report = generate_all(
        spark,
        scratch_path(spark, "generated"),
        clientes=t.raw("customer").count(),
        productos=t.raw("part").count(),
        vendedores=t.raw("supplier").count(),
        ordenes=t.raw("orders").count(),
        as_of=AS_OF,
    )
    return report.drop("segundos")


JOBS: dict[str, Query] = {
    "src_tables": _typed_tables,
    "src_calendar": _calendar,
    "sink_fact_export": _stored_export,
    "gen_nombre": _made_names,
    "gen_nombre_por_indices": _names_by_index,
    "gen_email": _made_emails,
    "gen_telefono": _made_phones,
    "gen_clientes": _made_clients,
    "gen_productos": _made_products,
    "gen_vendedores": _made_reps,
    "gen_ordenes": _made_orders,
    "gen_items": _made_items,
    "gen_pagos": _made_payments,
    "gen_all": _generate_all,
    "m_line_total": _line_total,
    "m_order_totals": _order_totals,
    "m_order_totals_delta": _order_totals_delta,
    "m_client_ltv": _client_ltv,
    "m_constraints": _constraints,
    "m_constraints_plantadas": _planted,
    "m_delete_cascade": _delete_cascade,
    "m_soft_delete": _soft_delete,
    "m_refresh_mvs": _refresh,
}


def queries() -> dict[str, Query]:
    plain = {key: _over_model(op) for key, op in {**VIEWS, **FUNCTIONS, **DASHBOARD}.items()}
    plain["q08_clientes_riesgo"] = _clients_at_risk
    return {**plain, **JOBS, **stored.JOBS}


def oracle_sql() -> dict[str, str]:
    from tablero.oracle import functions, generation as made, integrity as kept, stored as again, views

    return {**views.SQL, **functions.SQL, **made.SQL, **kept.SQL, **again.SQL}
