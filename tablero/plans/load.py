"""Generate and load the model: one job per table, and all of them in order."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablero.operators import generation
from tablero.operators.integrity import client_ltv, order_totals
from tablero.plans.refresh import refresh_materialized
from tablero.sources import tables
from tablero.sources.sinks import log_load


class Loader:
    """Fills the tables below ``path``; every row is a function of its id and ``seed``.

    Each job cleans its table first, or with ``limpiar=False`` adds rows with ids after the
    highest one, and returns the number of rows it created. Cleaning follows the references'
    delete rules: it raises while rows elsewhere need the table, before anything is written.
    """

    def __init__(
        self, spark: SparkSession, path: str, as_of: dt.date | None = None, seed: int = 0
    ) -> None:
        self.spark = spark
        self.path = path
        self.as_of = as_of or dt.date.today()
        self.seed = seed
        self.t = tables.StoredTables(spark, path, create=True)

    def clients(self, cantidad: int = 500, limpiar: bool = True) -> int:
        first = self._first_id("clientes", limpiar)
        rows = generation.generate_clients(self.spark, cantidad, self.as_of, self.seed, first)
        return self._store(rows, "clientes", limpiar, first)

    def products(self, cantidad: int = 200, limpiar: bool = True) -> int:
        first = self._first_id("productos", limpiar)
        rows = generation.generate_products(self.spark, cantidad, self.as_of, self.seed, first)
        return self._store(rows, "productos", limpiar, first)

    def reps(self, cantidad: int = 50, limpiar: bool = True) -> int:
        first = self._first_id("vendedores", limpiar)
        rows = generation.generate_reps(self.spark, cantidad, self.as_of, self.seed, first)
        return self._store(rows, "vendedores", limpiar, first)

    def orders(
        self, cantidad: int = 5000, dias_atras: int = 365, limpiar: bool = True
    ) -> tuple[int, int]:
        """Orders with their lines, totals from the written lines, then lifetime values.

        Totals and lifetime values are computed once per load instead of once per row.
        """
        first = self._first_id("ordenes", limpiar)
        if limpiar:
            tables.clear(self.t, "ordenes")
        ids = generation.ids(self.spark, cantidad, first)
        rows = generation.order_rows(ids, self.as_of, dias_atras, self.seed)
        lines = generation.generate_items(rows, self.t["productos"], self.seed)
        first_line = (first - 1) * generation.MAX_LINES + 1
        line_count = self._store(lines, "items_orden", limpiar, first_line)
        placed = generation.assign_parties(rows, self.t)
        written = self.t["items_orden"].filter(F.col("id") >= first_line)
        order_count = self._write(
            order_totals(placed, written, now=self._now()), "ordenes", limpiar, first
        )
        valued = client_ltv(self.t["clientes"], self.t["ordenes"], now=self._now())
        tables.overwrite(valued, self.path, "clientes")
        return order_count, line_count

    def payments(self, limpiar: bool = True) -> int:
        first = self._first_id("pagos", limpiar)
        rows = generation.generate_payments(self.t["ordenes"], self.as_of, self.seed, first)
        return self._store(rows, "pagos", limpiar, first)

    def _now(self) -> dt.datetime:
        return dt.datetime.combine(self.as_of, dt.time())

    def _first_id(self, table: str, limpiar: bool) -> int:
        if limpiar:
            return 1
        return (self.t[table].agg(F.max("id")).first()[0] or 0) + 1

    def _store(self, rows: DataFrame, table: str, limpiar: bool, first: int) -> int:
        if limpiar:
            tables.clear(self.t, table)
        return self._write(rows, table, limpiar, first)

    def _write(self, rows: DataFrame, table: str, limpiar: bool, first: int) -> int:
        write = tables.overwrite if limpiar else tables.append
        write(rows, self.path, table)
        return self.t[table].filter(F.col("id") >= first).count()


def generate_all(
    spark: SparkSession,
    path: str,
    clientes: int = 500,
    productos: int = 200,
    vendedores: int = 50,
    ordenes: int = 5000,
    dias_atras: int = 365,
    as_of: dt.date | None = None,
    seed: int = 0,
) -> DataFrame:
    """Clean and fill every generated table below ``path``: (paso, registros, segundos).

    Over stored orders it raises, as clients cannot be cleaned below them.
    """
    load = Loader(spark, path, as_of, seed)
    steps = {
        "CLIENTES": lambda: load.clients(clientes),
        "PRODUCTOS": lambda: load.products(productos),
        "VENDEDORES": lambda: load.reps(vendedores),
        "ÓRDENES E ÍTEMS": lambda: sum(load.orders(ordenes, dias_atras)),
        "PAGOS": load.payments,
    }
    report = []
    for name, step in steps.items():
        started = time.monotonic()
        rows = step()
        report.append((name, rows, time.monotonic() - started))
    refresh_materialized(spark, load.t, path, load.as_of)
    log_load(spark, path, "inicial", sum(rows for _, rows, _ in report))
    return spark.createDataFrame(report, "paso string, registros bigint, segundos double")
