"""Language by rank-order profiles of character n-grams.

A profile is the list of a language's ``TOP`` most frequent n-grams of one to three characters
(case folded, runs of anything but letters as one blank). A document's own most frequent
n-grams are compared with every profile: each adds the difference of its two ranks, or ``TOP``
where the profile lacks it. The language of the smallest sum is predicted; the score is one
minus that sum over the largest possible one.

Profiles are learned from every labelled text. A task adds its texts' counts up and hands them
on when it holds ``HELD`` n-grams. Prediction covers every whole text. A null text, or one
without a letter, is ``und`` with score 0, as is everything when nothing was learned. Ties go to
the first language by name; among equal counts the smaller n-gram ranks first. Repeated rows are
learned from and predicted each; empty tables give empty results; extra columns are ignored.

``keep`` rejects texts that resemble no language. A language's cutoff follows from the scores
of all labelled documents that its profile was not learned from: it is ``OF_LOW`` times their
``LOW`` quantile, so that the odd text among them stays as well. A language with fewer than
``ENOUGH`` such scores takes the cutoff of all, and without any it is ``REJECT_BELOW``, which no
cutoff falls short of. Scores are fractions over ``TOP`` times at most ``TOP``, so a language has
a bounded number of different ones and each of ``BINS`` bins a few hundred: quantiles are read
off exactly from the bins that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablero.llm.shared import table

TOP = 300
ROWS = 250  # documents counted at a time
HELD = 1 << 18  # different n-grams that a task holds before it hands them on
UND = "und"
# Share of the documents that profiles are never learned from.
FOLDS, HELD_OUT = 4, 2
# Below this score a text resembles no profile, whatever the documents' own scores.
REJECT_BELOW = 0.05
LOW, OF_LOW = 0.01, 0.6
ENOUGH = 20
BINS = 1 << 16


@cache
def _letters() -> np.ndarray:
    """For each code point of the first plane, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes in ascending order, and their counts. No letters: none."""
    codes = np.frombuffer((text or "").casefold().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[np.minimum(codes, 0xFFFF)]
    for i in np.nonzero(codes > 0xFFFF)[0]:
        letter[i] = chr(codes[i]).isalpha()
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # One blank before, after and between the runs of letters.
    padded = np.concatenate([[32], np.where(letter, codes, 32), [32]]).astype(np.int64)
    blank = padded == 32
    padded = padded[~blank | np.concatenate([[True], ~blank[:-1]])]
    two = (padded[:-1] << 21) | padded[1:]
    three = (two[:-1] << 21) | padded[2:]
    keys = np.concatenate([padded[padded != 32], two, three])
    keys.sort()
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    return keys[first], np.diff(np.append(first, len(keys)))


def most_frequent(text: str | None) -> np.ndarray:
    """A text's n-grams by falling count, ``TOP`` at most."""
    keys, counts = ngrams(text)
    return keys[np.lexsort((keys, -counts))[:TOP]]


def fold(key: Column, folds: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % folds


def _added(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The counts of several texts as one."""
    found, at = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
    # Sums of doubles are exact far beyond the n-grams of a task.
    counts = np.bincount(at, np.concatenate([n for _, n in pairs]), len(found))
    return found, counts.astype(np.int64)


def _counted(held: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
    for name, (keys, counts) in held.items():
        yield pd.DataFrame({"lang": name, "gram": keys, "n": counts})


def learn(docs: DataFrame, lang: str = "lang") -> dict[str, list[int]]:
    """Ranked n-grams of each language; as many as there are languages, ``TOP`` each."""
    known = docs.select(F.col(lang).alias("lang"), "text").where(
        "lang is not null and text is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for first in range(0, len(batch), ROWS):
                for name, part in batch.iloc[first:first + ROWS].groupby("lang"):
                    held[name] = _added([*([held[name]] if name in held else []),
                                         *map(ngrams, part["text"])])
                if sum(len(keys) for keys, _ in held.values()) >= HELD:
                    yield from _counted(held)
                    held = {}
        yield from _counted(held)

    counted = known.mapInPandas(count, "lang string, gram long, n long").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = counted.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= TOP)
    profiles: dict[str, list[int]] = {}
    for row in sorted(top.select("lang", "rank", "gram").collect()):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Profiles:
    """Profiles as one matrix: rank by language and n-gram."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.names = sorted(profiles)
        self.grams = np.unique(np.array(sum(profiles.values(), []), np.int64))
        self.ranks = np.full((len(self.names), len(self.grams)), TOP, np.int64)
        for i, name in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.grams, profiles[name])] = np.arange(
                len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = most_frequent(text)
        if not len(own) or not self.names:
            return UND, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        theirs = np.where(known, self.ranks[:, at], TOP)
        apart = np.where(theirs < TOP, np.abs(theirs - np.arange(len(own))), TOP).sum(axis=1)
        best = int(apart.argmin())
        return self.names[best], float(1 - apart[best] / (TOP * len(own)))


def with_language(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    model = Profiles(profiles)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.predict(text) for text in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "lang_pred": pd.Series([name for name, _ in found], dtype="str"),
                "score": pd.Series([score for _, score in found], dtype="float64"),
            })

    return docs.select("doc_id", "text").mapInPandas(
        predict, "doc_id long, lang_pred string, score double")


def cutoffs(docs: DataFrame, model: Profiles, lang: str = "lang") -> dict[str, float]:
    """The least score of each language, from labelled ``docs`` that were not learned from."""
    known = docs.select(F.col(lang).alias("lang"), "text").where(
        "lang is not null and text is not null")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(name, *model.predict(text))
                     for name, text in zip(batch["lang"], batch["text"], strict=True)]
            rows = [(name, score) for name, best, score in found if name == best]
            yield pd.DataFrame(rows, columns=["lang", "score"])

    # Copies score the same and count once.
    found = low_scores(known.mapInPandas(score, "lang string, score double").distinct())
    if None not in found:
        return dict.fromkeys(model.names, REJECT_BELOW)
    every = found[None][1]
    return {name: max(REJECT_BELOW, OF_LOW * (own if n >= ENOUGH else every))
            for name in model.names for n, own in [found.get(name, (0, every))]}


def low_scores(scores: DataFrame) -> dict[str | None, tuple[int, float]]:
    """The number of ``scores`` (lang, score) and their ``LOW`` quantile, by language and, under
    None, of all. Passes the bins' counts and the values of two bins of each on.
    """
    each = scores.select("lang", "score", F.floor(F.col("score") * BINS).alias("bin"))
    every = each.withColumn("lang", F.lit(None).cast("string"))
    each = each.unionByName(every).withColumn("lang", F.struct("lang"))
    before = Window.partitionBy("lang").orderBy("bin").rowsBetween(
        Window.unboundedPreceding, -1)
    bins = each.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("rows")).select(
        "*", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"),
        F.sum("rows").over(Window.partitionBy("lang")).alias("n"))
    at = LOW * (F.col("n") - 1)
    ends = bins.where((F.col("before") <= F.ceil(at)) & (
        F.col("before") + F.col("rows") > F.floor(at))).select(
        F.col("lang").alias("_lang"), F.col("bin").alias("_bin"), "before", "n")
    held: dict[str | None, list[tuple]] = {}
    for row in each.join(ends, (F.col("lang") == F.col("_lang")) & (
            F.col("bin") == F.col("_bin"))).select("lang", "score", "before", "n").collect():
        held.setdefault(row["lang"][0], []).append((row["score"], row["before"], row["n"]))
    out = {}
    for name, rows in held.items():
        first, n = min(row[1] for row in rows), rows[0][2]
        some = sorted(row[0] for row in rows)
        place = LOW * (n - 1)
        below = int(place)
        low, high = some[below - first], some[min(below + 1, n - 1, first + len(some) - 1) - first]
        out[name] = n, low + (place - below) * (high - low)
    return out


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text resembles a learned language, all columns as they were."""
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    model = Profiles(learn(docs.where(~held_out)))
    least = cutoffs(docs.where(held_out), model)

    @F.pandas_udf("boolean")
    def resembles(texts: pd.Series) -> pd.Series:
        found = [model.predict(text) for text in texts]
        return pd.Series([score >= least.get(name, REJECT_BELOW) for name, score in found],
                         dtype="bool")

    return docs.where(resembles("text"))


def query(spark: SparkSession, path: str) -> DataFrame:
    """``op2_language_id``: the predicted language of every document."""
    docs = table(spark, path, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    out = with_language(docs, learn(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
