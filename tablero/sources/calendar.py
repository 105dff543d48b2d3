"""Date dimension for time intelligence."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablero.functions import periods


def calendar(spark: SparkSession, as_of: dt.date) -> DataFrame:
    """One row per day from three years before ``as_of`` to one year after it."""
    first = periods.shift_months(as_of, -36)
    last = periods.shift_months(as_of, 12)
    days = spark.range((last - first).days + 1).select(
        F.date_add(F.lit(first), F.col("id").cast("int")).alias("fecha")
    )
    return with_calendar_columns(days)


def with_calendar_columns(days: DataFrame) -> DataFrame:
    fecha = F.col("fecha")
    weekday = F.weekday(fecha) + F.lit(1)
    return days.select(
        fecha,
        F.year(fecha).alias("anio"),
        F.month(fecha).alias("mes"),
        F.dayofmonth(fecha).alias("dia"),
        F.date_format(fecha, "yyyy-MM").alias("anio_mes"),
        weekday.alias("dia_semana_num"),
        F.date_format(fecha, "EEEE").alias("nombre_dia"),
        F.date_format(fecha, "MMMM").alias("nombre_mes"),
        (weekday >= F.lit(6)).alias("es_fin_semana"),
    )
