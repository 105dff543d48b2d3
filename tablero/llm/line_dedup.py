"""Site-relative boilerplate lines.

Per host, a line's page share is the number of its pages that hold the line over the number of
its pages. Lines above ``ratio`` that stand on at least ``min_pages`` pages are boilerplate and
are dropped from every page of the host; all other lines stay in place. Exact copies of a page
count as one page, since copies are the near-duplicate operator's work. Lines are compared
whole, by MD5. A host has at most (mean lines per page) / ratio such lines, so they fit one
array per host. Built-in expressions only.

Nulls: a null text stays null and is a page without lines; a null host is a host of its own.
Blank lines are never boilerplate. A text all of whose lines go becomes empty; no row is
dropped. Repeated rows each stay. Empty tables give empty results. Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablero.llm.shared import BLANKS, Scratch, table

RATIO = 0.1
MIN_PAGES = 5


def boilerplate(docs: DataFrame, scratch: Scratch, host: str = "source",
                text: str = "text", ratio: float = RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """(_host, _boiler): one row per host with such lines, their digests as an array."""
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    lines = F.array_distinct(F.transform(
        F.filter(F.split(F.col(text), "\n", -1), lambda x: F.translate(x, BLANKS, "") != ""),
        lambda x: F.unhex(F.md5(x)),
    ))
    pages = docs.select(F.col(host).alias("_host"), digest.alias("_page"))
    totals = pages.distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    seen = docs.select(
        F.col(host).alias("_host"), digest.alias("_page"), F.explode(lines).alias("_line")
    ).distinct().groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_with"))
    # A written count per host is known to be small or not when it is joined.
    totals = scratch.write(totals, "totals").select(F.col("_host").alias("_h"), "_pages")
    frequent = seen.where(F.col("_with") >= min_pages).join(
        totals, F.col("_host").eqNullSafe(F.col("_h"))
    ).where(F.col("_with") > ratio * F.col("_pages"))
    return scratch.write(
        frequent.groupBy("_host").agg(F.collect_set("_line").alias("_boiler")), "boiler")


def clean(docs: DataFrame, host: str = "source", text: str = "text",
          ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines removed, and ``_dropped``, the number of them.

    A column of that name is replaced.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    # The row in one column: whatever its columns are called, they clash with nothing here.
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(host).alias("_key"),
                       F.col(text).alias("_text"))
    found = boilerplate(rows, scratch, "_key", "_text", ratio, min_pages)
    lines = F.split("_text", "\n", -1)
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("_boiler"), F.unhex(F.md5(x))))
    joined = rows.join(found, F.col("_key").eqNullSafe(F.col("_host")), "left").withColumn(
        "_left", F.when(F.col("_boiler").isNotNull(), kept))
    dropped = F.coalesce(F.size(lines) - F.size("_left"), F.lit(0))
    cleaned = F.when(F.col("_left").isNull(), F.col("_text")).otherwise(
        F.array_join("_left", "\n"))
    return joined.select(
        *[cleaned.alias(c) if c == text else F.col("_row").getField(c).alias(c)
          for c in docs.columns if c != "_dropped"],
        F.when(F.col("_left").isNull(), 0).otherwise(dropped).cast("long").alias("_dropped"),
    )


def query(spark: SparkSession, path: str) -> DataFrame:
    """``op6_line_dedup``: every document with its source's boilerplate removed."""
    docs = table(spark, path, "documents").select("doc_id", "source", "text")
    return clean(docs).withColumnRenamed("_dropped", "n_dropped")


def sql() -> str:
    """The same rows in DuckDB."""
    blank = r"[\x20\x09-\x0D]+"
    return f"""
WITH pages AS (SELECT DISTINCT source, coalesce(text, '') AS text FROM documents),
totals AS (SELECT source, count(*) AS n FROM pages GROUP BY source),
seen AS (
  SELECT source, line, count(*) AS n FROM (
    SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM pages)
  WHERE regexp_replace(line, '{blank}', '', 'g') <> '' GROUP BY source, line),
boiler AS (
  SELECT s.source, list(line) AS lines FROM seen s JOIN totals t
  ON s.source IS NOT DISTINCT FROM t.source
  WHERE s.n >= {MIN_PAGES} AND s.n > {RATIO} * t.n GROUP BY s.source),
cut AS (
  SELECT doc_id, d.source, text, string_split(text, chr(10)) AS had,
    list_filter(string_split(text, chr(10)),
      lambda x: NOT list_contains(coalesce(lines, []), x)) AS stay
  FROM documents d LEFT JOIN boiler b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source,
  CASE WHEN text IS NULL THEN NULL ELSE array_to_string(stay, chr(10)) END AS text,
  coalesce(len(had) - len(stay), 0)::BIGINT AS n_dropped
FROM cut"""
