"""Exact numbering of rows without putting a whole group, or the whole table, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablero.session import pinned


def row_number(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """ROW_NUMBER per group for groups of any size.

    The rows are range-partitioned by (group, order), so a large group spreads over many
    tasks; each row then adds its place within its partition to the number of earlier rows
    of its group in the partitions before. ``order`` must be a total order, or a run of
    equal rows could not be split. Without ``group`` the running count sees one row per range
    partition.
    """
    keys = [F.col(c) for c in group]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = pinned(ranged.withColumn("_pos", F.monotonically_increasing_id()), "ranking")
    # The upper bits of the position are the range partition, the lower 33 its row.
    placed = placed.withColumn("_part", F.shiftright("_pos", 33))
    # At most one row per partition and group boundary.
    pieces = placed.groupBy(*group, "_part").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # Written out, their true size is known, and the planner need not shuffle the rows again.
    pieces = pinned(
        pieces.select(
            *[F.col(c).alias(f"_g_{c}") for c in group],
            F.col("_part").alias("_p"),
            (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + F.lit(1))
            .alias("_shift"),
        ),
        "ranking",
    )
    match = F.col("_part") == F.col("_p")
    for c in group:
        match = match & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return placed.join(pieces, match).select(
        *df.columns, (F.col("_pos") + F.col("_shift")).alias(name)
    )


def dense_index(df: DataFrame, key: str, name: str = "indice") -> DataFrame:
    """Number the rows 0 … n-1 in the order of a unique ``key``, however sparse its values."""
    return row_number(df, [], [F.col(key)], name).withColumn(name, F.col(name) - F.lit(1))
