"""Session helpers: a local session for tests and benches, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "tablero") -> SparkSession:
    """A local session sized for tests; a cluster brings its own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


# Runtime plan changes the operators count on: a join partition that holds a hot key is split,
# also where a later step must then shuffle again.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def split_hot_keys(spark: SparkSession) -> None:
    """Turn the adaptive skew handling on for this session."""
    for name, value in ADAPTIVE.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tablero-")


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return _own_folder()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one job's tables."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def pinned(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Rows that depend on how a shuffle happened to be laid out (partition numbers) stay the
    same however often executors are lost afterwards.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
