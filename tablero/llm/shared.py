"""What the operators share: words, intermediate tables in the shared folder, reading tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablero.session import shared_folder

# Code points that separate words.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{path}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), lambda w: w != "")


def first_by_hash(rows: DataFrame, group: str, n: int) -> DataFrame:
    """The ``n`` rows of each group, of (group, doc_id), that come first by their ids' hash.

    For a bounded number of groups. Counts by the hash's upper bits tell where a group's
    sample ends, so only that last bin is ranked beside the sample itself.
    """
    hashed = rows.withColumn("_hash", F.xxhash64("doc_id")).withColumn(
        "_bin", F.shiftright("_hash", 48))
    before = Window.partitionBy(group).orderBy("_bin").rowsBetween(
        Window.unboundedPreceding, -1)
    ends = hashed.groupBy(group, "_bin").agg(F.count(F.lit(1)).alias("_rows")).withColumn(
        "_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).where(
        F.col("_before") < n).groupBy(F.col(group).alias("_group")).agg(
        F.max("_bin").alias("_end"))
    by_hash = Window.partitionBy(group).orderBy("_hash", "doc_id")
    return hashed.join(F.broadcast(ends), (
        (F.col(group) == F.col("_group")) & (F.col("_bin") <= F.col("_end")))).withColumn(
        "_n", F.row_number().over(by_hash)).where(F.col("_n") <= n).select(group, "doc_id")


def passing(rows: DataFrame, key: str, wanted: DataFrame, words: int) -> DataFrame:
    """The rows whose key is in the one column of ``wanted``, and few others; nothing is shuffled
    but the wanted keys.

    The keys are bits of that many 64-bit words at most, so what is broadcast has that bound.
    """
    def place(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(64 * words))

    bits = wanted.select(place(wanted.columns[0]).alias("_p")).groupBy(
        F.floor(F.col("_p") / 64).alias("_word")).agg(F.bit_or(F.call_function(
            "shiftleft", F.lit(1).cast("long"), (F.col("_p") % 64).cast("int"))).alias("_bits"))
    at = place(key)
    return rows.join(F.broadcast(bits), (F.floor(at / 64) == F.col("_word")) & (
        F.getbit("_bits", (at % 64).cast("int")) == 1), "left_semi")


def classes_sql(words: int, percent: int) -> str:
    """DuckDB's ``linked``: (doc_id, n_shingles, component_id), by all pairs that share a shingle."""
    return f"""
WITH RECURSIVE found AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '{BLANK_RUN}'), lambda w: w <> '') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {words} THEN [array_to_string(ws, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - {words - 2}),
      lambda i: array_to_string(ws[i:i + {words - 1}], ' ')))) END AS items FROM found),
nodes AS (SELECT min(doc_id) AS id, items FROM sets WHERE len(items) > 0 GROUP BY items),
spread AS (SELECT id, len(items) AS n, hash(unnest(items)) AS item FROM nodes),
pairs AS (
  SELECT a.id AS a, b.id AS b FROM spread a JOIN spread b ON a.item = b.item AND a.id < b.id
    AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
twice AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT id AS u, id AS v FROM nodes
  UNION SELECT u, b FROM reach JOIN twice ON v = a),
least AS (SELECT u, min(v) AS component FROM reach GROUP BY u),
linked AS (
  SELECT s.doc_id, CAST(len(s.items) AS BIGINT) AS n_shingles,
    coalesce(component, s.doc_id) AS component_id
  FROM sets s LEFT JOIN nodes n ON s.items = n.items LEFT JOIN least ON u = n.id)"""


class Scratch:
    """Intermediate tables of one job, in the folder all executors share.

    A written table cuts the lineage: a lost executor cannot change its rows, and nothing
    above it is computed again. ``drop`` removes tables that a later written one replaces.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{job}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
