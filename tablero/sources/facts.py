"""Orders and their lines stored for joins: by the order's month, dealt by the order's id.

``ordenes`` and ``items_orden`` are external tables of the session's catalog, in the same
buckets of the order id and sorted by it, so a join or a sum per order reads both in place
without an exchange; the month, the order's own one for its lines too, prunes whole folders.
One bucket is one task, so an order of more than ``large`` lines, and its lines, stand in a
second pair of tables that are by month only and are joined the usual way, where the runtime
can split them. There are at most (all lines / large) such orders.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Iterable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tablero import schemas
from tablero.functions import periods
from tablero.sources.tables import at

BUCKETS = 64
LARGE = 100_000

# Stored table: the model's table, and the order id its buckets follow.
_STORED = {
    "ordenes": ("ordenes", "id"),
    "items_orden": ("items_orden", "orden_id"),
    "ordenes_grandes": ("ordenes", None),
    "items_grandes": ("items_orden", None),
}
_PAIRS = (("ordenes", "items_orden"), ("ordenes_grandes", "items_grandes"))

Months = Iterable[dt.date] | None


class FactStore(Mapping[str, DataFrame]):
    """The stored facts below ``path``; every other table comes from ``t``."""

    def __init__(self, spark: SparkSession, path: str, t: Mapping[str, DataFrame],
                 buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.t, self.buckets = spark, path.rstrip("/"), t, buckets
        self._prefix = "tablero_" + hashlib.md5(self.path.encode()).hexdigest()[:16]
        for table in _STORED:
            self._register(table)

    @classmethod
    def create(cls, spark: SparkSession, path: str, t: Mapping[str, DataFrame],
               buckets: int = BUCKETS, large: int = LARGE) -> FactStore:
        """Store the facts of ``t`` below a new ``path``. Lines without an order are kept too."""
        store = cls(spark, path, t, buckets)
        orders = t["ordenes"].withColumn("mes", periods.month_of(F.col("fecha_orden")))
        many = t["items_orden"].groupBy(F.col("orden_id").alias("_grande")).agg(
            F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > large).select("_grande")
        store._insert(orders.join(many, F.col("id") == F.col("_grande"), "left_semi"),
                      "ordenes_grandes")
        store._insert(store._split(orders, "id", False), "ordenes")
        lines = t["items_orden"].join(
            orders.select(F.col("id").alias("orden_id"), "mes"), "orden_id", "left")
        for pair, large_ones in ((_PAIRS[0], False), (_PAIRS[1], True)):
            store._insert(store._split(lines, "orden_id", large_ones), pair[1])
        return store

    def __iter__(self) -> Iterator[str]:
        return iter(self.t)

    def __len__(self) -> int:
        return len(self.t)

    def __getitem__(self, table: str) -> DataFrame:
        if table == "ordenes":
            return self.orders().drop("mes")
        if table == "items_orden":
            return self.lines().drop("mes")
        return self.t[table]

    def scan(self, table: str, since: dt.date | None, until: dt.date | None) -> DataFrame:
        if table != "ordenes":
            return self.t.scan(table, since, until) if hasattr(self.t, "scan") else self.t[table]
        first = None if since is None else periods.month_start(since)
        return self.orders().filter(periods.within(F.col("mes"), first, until)).drop("mes")

    # The stored rows with their month; ``months`` prunes the folders.

    def pairs(self, months: Months = None) -> list[tuple[DataFrame, DataFrame]]:
        """(orders, lines) to be joined: in the same buckets, and those of very many lines."""
        return [(self._of(orders, months), self._of(lines, months)) for orders, lines in _PAIRS]

    def orders(self, months: Months = None) -> DataFrame:
        return self._of("ordenes", months).unionByName(self._of("ordenes_grandes", months))

    def lines(self, months: Months = None) -> DataFrame:
        return self._of("items_orden", months).unionByName(self._of("items_grandes", months))

    def replace_orders(self, rows: DataFrame, months: Sequence[dt.date]) -> None:
        """Replace the orders of ``months`` by ``rows`` (with column ``mes``), and no others.

        The new files are written beside the old ones and take their place when all are
        there, so ``rows`` may come from the store itself.
        """
        for table, large in (("ordenes", False), ("ordenes_grandes", True)):
            self._replace(self._split(rows, "id", large), table, months)

    def replace_lines(self, rows: DataFrame, months: Sequence[dt.date]) -> None:
        """Replace the lines of ``months``, each with its order's month, by ``rows``."""
        for table, large in (("items_orden", False), ("items_grandes", True)):
            self._replace(self._split(rows, "orden_id", large), table, months)

    def _split(self, rows: DataFrame, key: str, large: bool) -> DataFrame:
        ids = self._of("ordenes_grandes", None).select(F.col("id").alias("_grande"))
        return rows.join(ids, F.col(key) == F.col("_grande"), "left_semi" if large else "left_anti")

    def _of(self, table: str, months: Months) -> DataFrame:
        stored = self.spark.table(self._name(table))
        return stored if months is None else stored.filter(F.col("mes").isin(sorted(months)))

    def _name(self, table: str) -> str:
        return f"{self._prefix}_{table}"

    def _register(self, table: str) -> None:
        name = self._name(table)
        if self.spark.catalog.tableExists(name):
            return
        model, key = _STORED[table]
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.schema(model))
        dealt = (f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS"
                 if key else "")
        files, folder = at(self.spark, f"{self.path}/{table}")
        files.mkdirs(folder)
        self.spark.sql(
            f"CREATE TABLE {name} ({columns}, mes date) USING parquet "
            f"OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY (mes) {dealt} "
            f"LOCATION '{self.path}/{table}'")
        self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")

    def _insert(self, rows: DataFrame, table: str, overwrite: bool = False) -> None:
        model, key = _STORED[table]
        rows = rows.select(*schemas.schema(model).fieldNames(), "mes")
        # Dealt as the buckets are: one file per month and bucket.
        rows = rows.repartition(self.buckets, key) if key else rows.hint("rebalance", "mes")
        rows.write.insertInto(self._name(table), overwrite=overwrite)
        self.spark.catalog.refreshTable(self._name(table))

    def _replace(self, rows: DataFrame, table: str, months: Sequence[dt.date]) -> None:
        seen = Observation()
        rows = rows.filter(F.col("mes").isin(sorted(months))).observe(
            seen, F.collect_set("mes").alias("mes"))
        self._insert(rows, table, overwrite=True)
        # A month that has no row any more was not overwritten.
        for month in sorted(set(months) - set(seen.get["mes"])):
            self.spark.sql(f"ALTER TABLE {self._name(table)} "
                           f"DROP IF EXISTS PARTITION (mes = DATE '{month}')")
            files, folder = at(self.spark, f"{self.path}/{table}/mes={month}")
            files.delete(folder, True)
