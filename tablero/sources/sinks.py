"""Write steps: fact export, load audit and stored results."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablero import schemas
from tablero.functions import periods
from tablero.sources import tables


def write_fact_export(df: DataFrame, path: str) -> None:
    """Denormalised facts by order month, without a global sort."""
    out = df.withColumn("mes", periods.month_of(F.col("fecha_orden")))
    out.hint("rebalance", "mes").write.mode("overwrite").partitionBy("mes").parquet(path)


# Stored results ---------------------------------------------------------------------------


class NotFresh(LookupError):
    """A stored result is missing, or holds for another date or other source rows."""


class Results:
    """Query results stored below ``path``, one folder each, with a stamp beside the rows.

    The stamp says for which reference date and which state of the source tables the rows
    hold. Rows and stamp are written beside the old ones and switched in together, so no
    reader sees the rows of one and the stamp of the other.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def store(self, name: str, df: DataFrame, as_of: dt.date, source: str) -> None:
        staging = f"{self.path}/_cargando-{uuid.uuid4().hex[:12]}"
        files, folder = tables.at(self.spark, staging)
        try:
            df.write.parquet(f"{staging}/{name}")
            stamp = {"corte": as_of.isoformat(), "fuente": source, "esquema": df.schema.json()}
            # Readers of the rows pass over names that begin with an underscore.
            self.spark.createDataFrame([(json.dumps(stamp),)], "sello string").coalesce(1).write.text(
                f"{staging}/{name}/_sello")
            tables.switch(self.spark, f"{staging}/{name}", self.path, name)
        finally:
            files.delete(folder, True)

    def stamp(self, name: str) -> dict[str, str] | None:
        tables.restore(self.spark, self.path, name)
        files, folder = tables.at(self.spark, f"{self.path}/{name}/_sello")
        if not files.exists(folder):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/{name}/_sello").first()[0])

    def fresh(self, name: str, as_of: dt.date, source: str) -> bool:
        stamp = self.stamp(name)
        return (stamp is not None and stamp["corte"] == as_of.isoformat()
                and stamp["fuente"] == source)

    def read(self, name: str, as_of: dt.date, source: str) -> DataFrame:
        """The stored rows; raises if they do not hold for this date and source."""
        if not self.fresh(name, as_of, source):
            raise NotFresh(f"{name} is not stored for {as_of} and the present source")
        return self.rows(name)

    def rows(self, name: str) -> DataFrame:
        """The stored rows, whatever they hold for."""
        from pyspark.sql.types import StructType

        stamp = self.stamp(name)
        if stamp is None:
            raise NotFresh(f"{name} is not stored")
        declared = StructType.fromJson(json.loads(stamp["esquema"]))
        return self.spark.read.schema(declared).parquet(f"{self.path}/{name}")


def state_of(spark: SparkSession, *paths: str) -> str:
    """A digest of the files below the paths (names, sizes, times): it changes when they do."""
    seen = hashlib.sha256()
    for path in sorted(paths):
        files, root = tables.at(spark, path)
        found = files.listFiles(root, True)
        lines = []
        while found.hasNext():
            file = found.next()
            lines.append(f"{file.getPath()} {file.getLen()} {file.getModificationTime()}")
        seen.update("\n".join([path, *sorted(lines)]).encode())
    return seen.hexdigest()


# Load audit -------------------------------------------------------------------------------


def log_load(
    spark: SparkSession,
    path: str,
    tipo: str,
    registros: int,
    estado: str = "completado",
    notas: str | None = None,
    now: dt.datetime | None = None,
    corrida: str | None = None,
) -> int:
    """Add one row to the load audit and return its id.

    The id follows from the run's name ``corrida``, so a load that is tried again under its
    name adds no second row; the first row stays. Without a name it is the load moment in
    microseconds. No reader has to look for the highest id.
    """
    moment = now or dt.datetime.now()
    if corrida is None:
        carga_id = int(moment.timestamp() * 1_000_000)
    else:
        carga_id = int.from_bytes(hashlib.sha256(corrida.encode()).digest()[:8]) >> 1
    row = tables.conform(spark.createDataFrame(
        [(carga_id, moment, tipo, registros, estado, notas)],
        "id bigint, fecha_carga timestamp_ntz, tipo_carga string, registros_afectados bigint, "
        "estado string, notas string",
    ), "cargas_datos")
    logged = load_audit(spark, path).filter(F.col("id") == carga_id)
    if logged.isEmpty():
        row.write.mode("append").parquet(f"{path}/cargas_datos")
    return carga_id


def load_audit(spark: SparkSession, path: str) -> DataFrame:
    """The logged loads; none if there is no audit yet."""
    declared = schemas.schema("cargas_datos")
    try:
        return spark.read.schema(declared).parquet(f"{path}/cargas_datos")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], declared)
