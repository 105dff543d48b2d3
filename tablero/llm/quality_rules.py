"""Quality rules whose cutoffs bound the share of good documents they reject.

Each rule rejects a document whose metric exceeds a cutoff. Per stratum and rule, labelled good
documents test every cutoff of a fixed grid: with ``n`` good documents, ``k`` of them rejected,
the exact binomial probability of at most ``k`` rejections under a false-rejection rate of
``risk`` divided by the number of rules must not exceed ``delta`` divided by the number of all
tests (Bonferroni). The strictest cutoff that passes is used; a stratum with too few labels gets
no cutoff and keeps its documents. So with probability 1 - ``delta`` all rules together reject at
most ``risk`` of the good documents of every stratum. All of it is built-in expressions.

Nulls: a null text has no words and fails the base rule; a null stratum is a stratum of its
own; a null label is no label; of several labels of a document the lowest counts. Repeated
rows are judged each. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablero.llm.shared import BLANKS, UPPER, Scratch, table, words_of

WINDOW = 5
# A document's metric above the cutoff rejects it; grids run from strict to loose.
GRIDS = {
    "symbols_per_word": [0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0],
    "upper_share": [0.1, 0.2, 0.3, 0.4, 0.6, 0.8, 0.95],
    "dup_line_share": [0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9],
    "repeat_word_share": [0.01, 0.02, 0.04, 0.08, 0.12, 0.16, 0.19],
    "mean_word_chars": [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0],
}
RISK = 0.02  # of a stratum's good documents, all rules together
DELTA = 0.05


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts of every whole text; other columns stay."""
    kept = docs.columns
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(
        F.split(whole, "\n", -1), lambda line: F.translate(line, BLANKS, "") != ""
    )
    df = docs.select(
        *kept,
        F.length(F.translate(whole, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long")
        .alias("n_symbols"),
        (F.length(whole) - F.length(F.translate(whole, UPPER, ""))).cast("long")
        .alias("_upper"),
        lines.alias("_lines"),
        F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)).alias("_words"),
    )
    df = df.select(
        "*", F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")
        .alias("n_dup_lines"),
    )
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_words") - WINDOW),
        lambda i: F.xxhash64(*[F.get("_words", i + F.lit(k)) for k in range(WINDOW)]),
    )
    df = df.select(
        "*", F.when(F.size("_words") >= WINDOW, windows).alias("_windows")
    ).drop("_words", "_lines")
    # Only a text with equal windows is sorted; equal windows are then neighbours.
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    df = df.select("*", F.when(repeats, F.sort_array(
        F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )).alias("_sorted")).drop("_windows")
    again = F.filter("_sorted", lambda p, k: (
        (F.get("_sorted", k - F.lit(1))["h"] == p["h"])
        | (F.get("_sorted", k + F.lit(1))["h"] == p["h"])
    ))
    df = df.select("*", F.sort_array(F.transform(again, lambda p: p["i"])).alias("_at"))
    covered = F.aggregate(
        F.transform("_at", lambda p, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get("_at", k + F.lit(1)) - p, F.lit(WINDOW))
        )),
        F.lit(0).cast("long"), lambda a, b: a + b,
    )
    return df.select(
        *kept, "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "_upper",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def with_metrics(counted: DataFrame) -> DataFrame:
    """Adds the rules' metrics and the base verdict."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return counted.select(
        "*",
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("_upper") / F.greatest("word_chars", F.lit(1))).alias("upper_share"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_word_share"),
        (F.col("word_chars") / words).alias("mean_word_chars"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .alias("base_failed"),
    )


def _ln_factorial(x: Column) -> Column:
    """ln x!, exact up to 20, by Stirling's series beyond (error below 1e-13 there)."""
    d = x.cast("double")
    series = (d * F.log(d) - d + 0.5 * F.log(2 * math.pi * d) + 1 / (12 * d)
              - 1 / (360 * d * d * d) + 1 / (1260 * d * d * d * d * d))
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int"))
                                 .cast("double"))).otherwise(series)


def binomial_at_most(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X binomial (n, rate), for k up to the mean; 1 beyond.

    Below the mean the terms shrink faster than a normal tail, so those further than 40 roots
    of n below k vanish in a double and are left out.
    """
    first = F.greatest(F.lit(0), k - (50 + 40 * F.sqrt(n)).cast("long"))

    def term(j: Column) -> Column:
        return F.exp(_ln_factorial(n) - _ln_factorial(j) - _ln_factorial(n - j)
                     + j * math.log(rate) + (n - j) * math.log1p(-rate))

    tail = F.aggregate(F.sequence(first.cast("long"), k), F.lit(0.0), lambda a, j: a + term(j))
    return F.when((n > 0) & (k <= n * rate), tail).otherwise(F.lit(1.0))


def cutoffs(measured: DataFrame, labels: DataFrame, scratch: Scratch,
            risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per stratum: the cutoff of each rule, null where none is safe."""
    good = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("_quality")).where("_quality = 1")
        .select(F.col("doc_id").alias("_labelled"))
    )
    held = measured.where(~F.col("base_failed")).join(
        good, F.col("doc_id") == F.col("_labelled"), "left_semi"
    )
    counts = held.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(rule) > c).alias(f"{rule}_{i}")
          for rule, grid in GRIDS.items() for i, c in enumerate(grid)],
    )
    counts = scratch.write(counts, "counts")
    tests = counts.count() * sum(map(len, GRIDS.values()))
    level = delta / max(tests, 1)

    def strictest(rule: str) -> Column:
        return F.coalesce(*[
            F.when(binomial_at_most(
                F.col(f"{rule}_{i}"), F.col("n"), risk / len(GRIDS)) <= level, F.lit(c))
            for i, c in enumerate(GRIDS[rule])
        ]).alias(f"cut_{rule}")

    return scratch.write(
        counts.select(F.col("stratum").alias("_stratum"), *map(strictest, GRIDS)), "cutoffs"
    )


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang",
          risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Counts, the base verdict and ``kept`` for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "quality-rules")
    rows = docs.select("doc_id", "text", F.col(stratum).alias("stratum"))
    measured = scratch.write(with_metrics(with_counts(rows).drop("text")), "measured")
    cuts = cutoffs(measured, labels, scratch, risk, delta)
    rejected = F.lit(False)
    for rule in GRIDS:
        rejected = rejected | F.coalesce(F.col(rule) > F.col(f"cut_{rule}"), F.lit(False))
    return measured.join(
        cuts, F.col("stratum").eqNullSafe(F.col("_stratum")), "left"
    ).select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", *GRIDS, "base_failed",
        (~F.col("base_failed") & ~rejected).alias("kept"),
    )


def query(spark: SparkSession, path: str) -> DataFrame:
    """``op9_quality_rules``: the contract's columns for all documents."""
    return judge(table(spark, path, "documents"), table(spark, path, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def sql() -> str:
    """The same rows in DuckDB."""
    blank = r"[\x20\x09-\x0D]+"
    tests = "\n    UNION ALL ".join(
        f"SELECT lang, '{rule}' AS rule, {c} AS cutoff, count(*) AS n,"
        f" count(*) FILTER ({rule} > {c}) AS k FROM good GROUP BY lang"
        for rule, grid in GRIDS.items() for c in grid
    )
    rejected = " OR ".join(
        f"coalesce(m.{rule} > (SELECT min(cutoff) FROM safe s WHERE s.rule = '{rule}'"
        f" AND s.lang IS NOT DISTINCT FROM m.lang), false)" for rule in GRIDS
    )
    rate = RISK / len(GRIDS)
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '{blank}'), lambda x: x <> '') AS ws
  FROM d),
win AS (
  SELECT doc_id, i, list_slice(ws, i, i + 4) AS five
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
hit AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM hit, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
ln AS (
  SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_replace(line, '{blank}', '', 'g') <> '' GROUP BY doc_id),
c AS (
  SELECT d.doc_id, d.lang, len(ws) AS n_words,
    length(regexp_replace(text, '{blank}', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS upper,
    coalesce(lines, 0) AS n_lines, coalesce(dup, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
m AS (
  SELECT *, n_symbols / greatest(n_words, 1) AS symbols_per_word,
    upper / greatest(word_chars, 1) AS upper_share,
    n_dup_lines / greatest(n_lines, 1) AS dup_line_share,
    n_repeat_words / greatest(n_words, 1) AS repeat_word_share,
    word_chars / greatest(n_words, 1) AS mean_word_chars,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
good AS (
  SELECT m.* FROM m WHERE NOT base_failed AND doc_id IN (
    SELECT doc_id FROM labels WHERE quality IS NOT NULL
    GROUP BY doc_id HAVING min(quality) = 1)),
tests AS ({tests}),
p AS (
  SELECT *, CASE WHEN k <= n * {rate} THEN (
    SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
      + j * ln({rate}) + (n - j) * ln(1 - {rate})))
    FROM (SELECT unnest(range(0, k + 1)) AS j)) ELSE 1 END AS p
  FROM tests),
safe AS (SELECT * FROM p WHERE p <= {DELTA} / (SELECT count(*) FROM p))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
  n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT ({rejected}) AS kept
FROM m"""
