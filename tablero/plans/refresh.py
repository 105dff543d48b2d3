"""Stored results: rebuilt whole, or brought up to date from the months that changed."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablero.operators import integrity, products, trends
from tablero.sources.facts import FactStore
from tablero.sources.sinks import Results, state_of

TREND = "mv_tendencia_ventas_mensual"
RANKS = "mv_top_productos_por_categoria"

# Stored rows need no order, so the ranking is stored as it comes.
MATERIALIZED = {TREND: trends.monthly_trend, RANKS: products.category_ranks}


def refresh_materialized(
    spark: SparkSession, t: Mapping[str, DataFrame], path: str, as_of: dt.date, source: str = ""
) -> DataFrame:
    """Replace each stored result; one row per result with rows and seconds taken."""
    results = Results(spark, path)
    report = []
    for name, operator in MATERIALIZED.items():
        started = time.monotonic()
        results.store(name, operator(t, as_of), as_of, source)
        seconds = time.monotonic() - started
        report.append((name, "completado", results.rows(name).count(), seconds))
    return spark.createDataFrame(
        report, "nombre_vista string, estado string, filas bigint, tiempo_refresco double"
    )


def stored_result(
    results: Results, t: Mapping[str, DataFrame], name: str, as_of: dt.date, source: str
) -> DataFrame:
    """The stored rows of a result, computed and stored first unless they are fresh."""
    if not results.fresh(name, as_of, source):
        results.store(name, MATERIALIZED[name](t, as_of), as_of, source)
    return results.read(name, as_of, source)


class Monthly:
    """Rows kept by month below ``path``, one folder a month; some months can be replaced.

    A replaced month without rows keeps one row of nulls, so that it is replaced at all.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path, key
        self.schema = T.StructType.fromDDL(schema)

    def replace(self, rows: DataFrame, months: Sequence[dt.date] | None = None) -> None:
        """Store ``rows`` in place of those months, or of everything."""
        rows = rows.select(*self.schema.fieldNames())
        if months is not None:
            empty = self.spark.createDataFrame([(m,) for m in months], "mes date")
            rows = rows.unionByName(empty, allowMissingColumns=True)
        mode = "static" if months is None else "dynamic"
        rows.hint("rebalance", "mes").write.mode("overwrite").option(
            "partitionOverwriteMode", mode).partitionBy("mes").parquet(self.path)
        self.spark.catalog.refreshByPath(self.path)

    def rows(self, months: Sequence[dt.date] | None = None) -> DataFrame:
        stored = self.spark.read.schema(self.schema).parquet(self.path).filter(
            F.col(self.key).isNotNull())
        return stored if months is None else stored.filter(F.col("mes").isin(sorted(months)))


class Maintained:
    """Results over a fact store that follow its changes month by month.

    ``rebuild`` computes them whole. After a change of facts, ``refresh`` reads the named months
    only: the trend gets new rows for them, the product and client sums of those months are
    computed again, and ranks and values add the stored months up.
    """

    def __init__(self, store: FactStore, path: str) -> None:
        self.store, self.path, spark = store, path.rstrip("/"), store.spark
        self.results = Results(spark, path)
        self.products = Monthly(
            spark, f"{self.path}/producto_mes", "producto_id bigint, veces_pedido bigint, "
            "cantidad_total_vendida bigint, ingresos_totales decimal(25,2), mes date",
            "producto_id")
        self.clients = Monthly(
            spark, f"{self.path}/cliente_mes", "cliente_id bigint, valor decimal(25,2), "
            "ultima timestamp_ntz, mes date", "cliente_id")

    def source(self) -> str:
        return state_of(self.store.spark, self.store.path)

    def rebuild(self, as_of: dt.date) -> None:
        store = self.store
        self.products.replace(products.product_months(store.lines()))
        self.clients.replace(integrity.client_months(store.orders()))
        source = self.source()
        self.results.store(TREND, trends.monthly_trend(store, as_of), as_of, source)
        self._rank(as_of, source)

    def refresh(self, as_of: dt.date, months: Sequence[dt.date]) -> None:
        """Bring everything up to date after changes in ``months``."""
        if months:
            store = self.store
            self.products.replace(products.product_months(store.lines(months)), months)
            self.clients.replace(integrity.client_months(store.orders(months)), months)
        source = self.source()
        old = self.results.rows(TREND)
        if months:
            old = old.filter(~F.col("mes").isin(sorted(months))).unionByName(
                trends.trend_of_months(self.store, months))
        self.results.store(TREND, old, as_of, source)
        self._rank(as_of, source)

    def refresh_clients(self, changed: DataFrame) -> None:
        """Only the client sums of the changed (cliente_id, mes): of the orders, those months
        are read, and of these the touched clients' alone are summed."""
        changed = changed.select("cliente_id", "mes").filter("mes is not null").distinct()
        months = months_of(changed)
        if not months:
            return
        orders = self.store.orders(months).join(
            changed, ["cliente_id", "mes"], "left_semi")
        kept = self.clients.rows(months).join(changed, ["cliente_id", "mes"], "left_anti")
        self.clients.replace(kept.unionByName(integrity.client_months(orders)), months)

    def client_values(self, clients: DataFrame, touched: DataFrame | None = None,
                      now: dt.datetime | None = None) -> DataFrame:
        """Clients with lifetime value and last purchase; others than ``touched`` as stored."""
        return integrity.client_ltv_of_months(clients, self.clients.rows(), touched, now=now)

    def _rank(self, as_of: dt.date, source: str) -> None:
        ranks = products.category_ranks_of_months(self.store, self.products.rows())
        self.results.store(RANKS, ranks, as_of, source)


def months_of(rows: DataFrame) -> list[dt.date]:
    """The months that occur in column ``mes``: a short list, whatever the rows."""
    return sorted(r[0] for r in rows.select("mes").filter("mes is not null").distinct().collect())


def refresh_order_totals(
    store: FactStore, changed: DataFrame, now: dt.datetime | None = None
) -> list[dt.date]:
    """Write the totals of the changed orders (column ``orden_id``) back to the store.

    Finds the months of these orders, reads and replaces those alone, and returns them. A
    change set that comes with ``mes`` spares the look at all order ids.
    """
    if "mes" not in changed.columns:
        changed = store.orders().select(F.col("id").alias("orden_id"), "mes").join(
            changed.select("orden_id").distinct(), "orden_id", "left_semi")
    months = months_of(changed)
    if months:
        store.replace_orders(
            integrity.order_totals_in_place(store, months, changed, now), months)
    return months

