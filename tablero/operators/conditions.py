"""Conditions and orderings the operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def status(value: str) -> Column:
    return F.col("estado") == F.lit(value)


def not_cancelled() -> Column:
    """True for known states other than cancelled; an unknown state counts as neither."""
    return F.col("estado") != F.lit("cancelado")


def paid() -> Column:
    return F.col("estado_pago") == F.lit("pagado")


def unpaid() -> Column:
    return F.col("estado_pago").isin("pendiente", "vencido")


def highest(column: str) -> Column:
    """Descending with NULL last, in every operator."""
    return F.col(column).desc_nulls_last()


def zero(column: str) -> Column:
    """A count from a joined side that may have no row."""
    return F.coalesce(F.col(column), F.lit(0)).alias(column)
