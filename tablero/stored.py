"""Keys over stored facts and stored results, which Spark derives from the given tables once.

A session keeps one copy per folder of tables and state of its files; later keys read it.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablero.functions import money, periods
from tablero.operators import products, trends
from tablero.operators.integrity import order_totals_in_place
from tablero.plans.refresh import (
    RANKS, TREND, Maintained, months_of, refresh_order_totals, stored_result,
)
from tablero.session import pinned, scratch_path
from tablero.sources import sinks, tables
from tablero.sources.facts import FactStore
from tablero.sources.retail import AS_OF, RAW, RetailModel

NOW = dt.datetime.combine(AS_OF, dt.time())
# The change set of the refresh keys: orders of the last so many months.
CHANGED_MONTHS = 3

_folders: dict[tuple[str, str, str], str] = {}


def _source(spark: SparkSession, path: str) -> str:
    return sinks.state_of(spark, *[f"{path}/{name}.parquet" for name in RAW])


def _folder(spark: SparkSession, path: str, what: str) -> tuple[str, bool]:
    """The session's folder for something made of the tables, and whether it is new."""
    key = (spark.sparkContext.applicationId, what, path + _source(spark, path))
    new = key not in _folders
    if new:
        _folders[key] = scratch_path(spark, what)
    return _folders[key], new


def _facts(spark: SparkSession, path: str, what: str = "hechos") -> tuple[FactStore, bool]:
    folder, new = _folder(spark, path, what)
    t = RetailModel(spark, path)
    return (FactStore.create if new else FactStore)(spark, folder, t), new


def _result(spark: SparkSession, path: str, name: str) -> DataFrame:
    results = sinks.Results(spark, _folder(spark, path, "resultados")[0])
    return stored_result(results, RetailModel(spark, path), name, AS_OF, _source(spark, path))


# Stored results ---------------------------------------------------------------------------


def materialized_trend(spark: SparkSession, path: str) -> DataFrame:
    """The monthly trend as it is stored."""
    return _result(spark, path, TREND)


def trend_two_years(spark: SparkSession, path: str) -> DataFrame:
    return trends.two_years_of(_result(spark, path, TREND), AS_OF)


def top10_by_category(spark: SparkSession, path: str) -> DataFrame:
    return products.top10_of_ranks(_result(spark, path, RANKS))


# Stored facts -----------------------------------------------------------------------------


def facts_by_month(spark: SparkSession, path: str) -> DataFrame:
    """The stored facts per month: orders, their amount, lines and the lines' amount."""
    store, _ = _facts(spark, path)
    orders = store.orders().groupBy("mes").agg(
        F.count(F.lit(1)).alias("ordenes"), money.total(F.col("monto_total")).alias("monto"))
    lines = store.lines().groupBy("mes").agg(
        F.count(F.lit(1)).alias("lineas"), money.total(F.col("total_linea")).alias("importe"))
    return orders.join(lines, "mes", "full").select("mes", "ordenes", "monto", "lineas", "importe")


def order_totals(spark: SparkSession, path: str) -> DataFrame:
    return order_totals_in_place(_facts(spark, path)[0], now=NOW).select("id", "monto_total")


def fact_export(spark: SparkSession, path: str) -> DataFrame:
    return trends.fact_export_in_place(_facts(spark, path)[0], AS_OF)


def changed_facts(spark: SparkSession, path: str) -> Maintained:
    """A store with results, after a change set of its last months.

    Returned lines of their orders are deleted, the totals of these orders follow, and
    returned orders become cancelled ones; the results are brought up to date by month.
    """
    store, new = _facts(spark, path, "hechos-cambiados")
    kept = Maintained(store, _folder(spark, path, "resultados-cambiados")[0])
    if new:
        kept.rebuild(AS_OF)
        since = periods.shift_months(AS_OF, -CHANGED_MONTHS)
        some = periods.within(F.col("fecha_orden"), since)
        orders = store.orders().filter(F.col("mes") >= F.lit(periods.month_start(since)))
        months = months_of(orders.filter(some))
        returned = F.col("cantidad_devuelta") > 0
        recent = orders.filter(some).select(F.col("id").alias("orden_id"))
        lost = store.lines(months).filter(returned).join(recent, "orden_id", "left_semi")
        lost = pinned(lost.select("id", "orden_id", "mes"), "lineas")
        store.replace_lines(
            store.lines(months).join(lost.select("id"), "id", "left_anti"), months)
        refresh_order_totals(store, lost, NOW)
        gone = some & (F.col("estado") == F.lit("devuelto"))
        store.replace_orders(store.orders(months).withColumn(
            "estado", F.when(gone, F.lit("cancelado")).otherwise(F.col("estado"))), months)
        kept.refresh(AS_OF, months)
    return kept


def totals_after_changes(spark: SparkSession, path: str) -> DataFrame:
    return changed_facts(spark, path).store["ordenes"].select("id", "monto_total")


def trend_after_changes(spark: SparkSession, path: str) -> DataFrame:
    return changed_facts(spark, path).results.rows(TREND)


def ranks_after_changes(spark: SparkSession, path: str) -> DataFrame:
    return changed_facts(spark, path).results.rows(RANKS)


def values_after_changes(spark: SparkSession, path: str) -> DataFrame:
    kept = changed_facts(spark, path)
    return kept.client_values(RetailModel(spark, path)["clientes"], now=NOW).select(
        "id", "valor_vida_total", "fecha_ultima_compra")


# Loads ------------------------------------------------------------------------------------


def overwritten(spark: SparkSession, path: str) -> DataFrame:
    """Orders loaded, then replaced by rows computed from themselves: cancelled ones cost 0."""
    folder = scratch_path(spark, "carga")
    tables.overwrite(RetailModel(spark, path)["ordenes"], folder, "ordenes")
    stored = tables.load(spark, folder)
    free = F.when(F.col("estado") == F.lit("cancelado"), F.lit(0)).otherwise(F.col("monto_total"))
    tables.overwrite(stored["ordenes"].withColumn("monto_total", free), folder, "ordenes")
    return stored["ordenes"].select("id", "estado", "monto_total", "fecha_orden")


def audited(spark: SparkSession, path: str) -> DataFrame:
    """The load audit after every table was logged under its run's name, twice."""
    folder, t = scratch_path(spark, "auditoria"), RetailModel(spark, path)
    counts = reduce(DataFrame.unionByName, [
        t[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tabla"), "n")
        for name in t]).collect()
    for _ in range(2):
        for row in counts:
            sinks.log_load(spark, folder, "inicial", row["n"], notas=row["tabla"], now=NOW,
                           corrida=f"inicial de {row['tabla']}")
    return sinks.load_audit(spark, folder).drop("id")


JOBS = {
    "sink_overwrite_load": overwritten,
    "sink_audit_append": audited,
    "sink_materialized": materialized_trend,
    "d02_tendencia_2_anios": trend_two_years,
    "d03_top10_por_categoria": top10_by_category,
    "sink_hechos_por_orden": facts_by_month,
    "m_order_totals_en_sitio": order_totals,
    "q23_export_en_sitio": fact_export,
    "m_order_totals_cambios": totals_after_changes,
    "m_client_ltv_cambios": values_after_changes,
    "m_refresh_mvs_cambios": trend_after_changes,
    "m_refresh_ranking_cambios": ranks_after_changes,
}
