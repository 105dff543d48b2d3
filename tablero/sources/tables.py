"""The model as stored tables: typed scans, date-pruned scans and table writes."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablero import schemas
from tablero.functions import periods
from tablero.session import split_hot_keys


class RestrictedDelete(ValueError):
    """Rows elsewhere still refer to a key that is to be deleted."""


# The moment column a date filter applies to.
DATE_COLUMN = {
    "ordenes": "fecha_orden",
    "pagos": "fecha_pago",
    "devoluciones": "fecha_devolucion",
}


def recent(
    t: Mapping[str, DataFrame], table: str, since: dt.date | None, until: dt.date | None = None
) -> DataFrame:
    """Rows of ``table`` in [since, until), pruned at the source where the source can."""
    source = t.scan(table, since, until) if hasattr(t, "scan") else t[table]
    return source.filter(periods.within(F.col(DATE_COLUMN[table]), since, until))


def at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path, and the path in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


class StoredTables(Mapping[str, DataFrame]):
    """Typed scans of the tables stored below ``path``, one folder per table.

    ``ordenes`` is stored by month (column ``mes``), so date filters prune whole folders. A
    table that was never written is empty; a folder that does not exist is an error, unless
    ``create`` announces that a load will make it.
    """

    def __init__(self, spark: SparkSession, path: str, create: bool = False) -> None:
        if not create:
            files, root = at(spark, path)
            if not files.exists(root):
                raise FileNotFoundError(f"no folder of tables at {path}")
        split_hot_keys(spark)
        self.spark = spark
        self.path = path

    def __iter__(self) -> Iterator[str]:
        return iter(schemas.TABLES)

    def __len__(self) -> int:
        return len(schemas.TABLES)

    def _read(self, table: str) -> DataFrame:
        declared = schemas.schema(table)
        if table == "ordenes":
            declared = T.StructType([*declared.fields, T.StructField("mes", T.DateType())])
        try:
            return self.spark.read.schema(declared).parquet(f"{self.path}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            if restore(self.spark, self.path, table):
                return self.spark.read.schema(declared).parquet(f"{self.path}/{table}")
            return self.spark.createDataFrame([], declared)

    def __getitem__(self, table: str) -> DataFrame:
        if table not in schemas.TABLES:
            raise KeyError(table)
        df = self._read(table)
        return df.drop("mes") if table == "ordenes" else df

    def scan(self, table: str, since: dt.date | None, until: dt.date | None) -> DataFrame:
        if table != "ordenes":
            return self[table]
        first = None if since is None else periods.month_start(since)
        return self._read(table).filter(periods.within(F.col("mes"), first, until)).drop("mes")


def load(spark: SparkSession, path: str) -> StoredTables:
    return StoredTables(spark, path)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Exactly the declared columns and types; missing columns become NULL."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.schema(table)
        ]
    )


def overwrite(df: DataFrame, path: str, table: str) -> None:
    """Clean-then-insert load of one table: the new rows are written beside it, then switched in.

    ``df`` may be computed from the table itself. A write that fails leaves the old rows; so
    does a driver lost between the two renames of the switch, as the next reader puts them back.
    """
    spark = df.sparkSession
    staging = f"{path}/_cargando-{uuid.uuid4().hex[:12]}"
    try:
        _write(df, staging, table, "overwrite")
        switch(spark, f"{staging}/{table}", path, table)
    finally:
        files, folder = at(spark, staging)
        files.delete(folder, True)


def append(df: DataFrame, path: str, table: str) -> None:
    """Insert without cleaning."""
    _write(df, path, table, "append")


def switch(spark: SparkSession, new: str, path: str, table: str) -> None:
    """Rename the folder ``new`` to ``path/table``, whose old folder goes once it is replaced."""
    files, target = at(spark, f"{path}/{table}")
    _, old = at(spark, _replaced(path, table))
    restore(spark, path, table)
    if files.exists(target) and not files.rename(target, old):
        raise OSError(f"cannot move {path}/{table} aside")
    if not files.rename(at(spark, new)[1], target):
        restore(spark, path, table)
        raise OSError(f"cannot rename {new} to {path}/{table}")
    files.delete(old, True)
    # Files of the old folder that this session has listed are no longer there.
    spark.catalog.refreshByPath(f"{path}/{table}")


def restore(spark: SparkSession, path: str, table: str) -> bool:
    """Put the old folder of an unfinished switch back; True if there was one."""
    files, target = at(spark, f"{path}/{table}")
    _, old = at(spark, _replaced(path, table))
    if not files.exists(old):
        return False
    if files.exists(target):
        return not files.delete(old, True)
    return files.rename(old, target)


def _replaced(path: str, table: str) -> str:
    return f"{path}/_reemplazada-{table}"


def _write(df: DataFrame, path: str, table: str, mode: str) -> None:
    """Write typed rows; ``ordenes`` goes out by month.

    The rebalance step lets the runtime split a month that holds far more rows than the
    others instead of writing it from one task.
    """
    out = conform(df, table)
    target = f"{path}/{table}"
    if table == "ordenes":
        out = out.withColumn("mes", periods.month_of(F.col("fecha_orden"))).hint("rebalance", "mes")
        out.write.mode(mode).partitionBy("mes").parquet(target)
    else:
        out.write.mode(mode).parquet(target)


def clear(t: StoredTables, table: str) -> None:
    """Apply the references' delete rules as every row of ``table`` is about to go.

    Raises before anything is written if rows elsewhere forbid it. Rows that must follow are
    deleted and optional links to the table emptied; no table that is deleted along has
    references of its own. Links within the table go with it.
    """
    links = [ref for ref in schemas.REFERENCES if ref.parent == table and ref.child != table]
    held = {ref: not t[ref.child].filter(F.col(ref.column).isNotNull()).isEmpty()
            for ref in links}
    for ref in links:
        if held[ref] and ref.on_delete == "restrict":
            raise RestrictedDelete(f"{ref.child}.{ref.column} still refers to {table}")
    for ref in links:
        if held[ref]:
            child = t[ref.child]
            if ref.on_delete == "set null":
                left = child.withColumn(ref.column, F.lit(None))
            else:
                left = child.filter(F.col(ref.column).isNull())
            overwrite(left, t.path, ref.child)
