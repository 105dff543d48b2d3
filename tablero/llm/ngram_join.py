"""N-gram Jaccard join over size-banded tiles with hashed bitmap signatures.

A document's set holds its distinct shingles (``words`` words each); equal sets are one node.

Tiles. Bands cut the set sizes; a set stands in its size's band and, if a larger partner may be
there, in the next one. Two sets of a band that reach the similarity differ in at most d
elements, d following from the band. The band deals every set's elements to d + 1 + ``SPARE``
segments by their hash, so linked sets have at least 1 + ``SPARE`` segments exactly in common.
A tile is (band, segment, content of the segment). Segments of fewer than ``THIN`` elements say
little and make no tile, unless a set has more than ``SPARE`` of them. So every two linked sets
share a tile, exactly, and unlike sets hardly ever do, however common their single shingles are.

In a tile, sets are compared with its smallest one first, which joins almost all of a large
group of copies; sets that are then in different classes are compared with each other, never
those of one class. A pair is kept where sizes and bitmap signatures allow the similarity: bits
of one that the other lacks are elements that the other lacks, so the bit counts bound the
overlap from above. What is left is decided by the exact intersection of the sorted sets.
Classes are connected components of the links.

Nulls: a null text, and one without words, has an empty set and is linked with nothing; rows
without a document id are linked with nothing. A text of fewer words has its whole sequence as
its one shingle. Repeated rows get a row each, of the class of their own text; different texts that
are first seen under one id are one node with several sets. Very long texts are taken whole;
their sets are built one at a time. Ties cannot arise: a class is named by its smallest id. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache, reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablero.llm.near_dedup import Components, full_sets, shingles
from tablero.llm.shared import Scratch, classes_sql, table

WORDS = 3
PERCENT = 90
SPARE = 4
THIN = 3
WIDTH = 1.25  # largest size of a band over its smallest
BITS = 16  # 64-bit words of a signature
ROWS = 500  # documents handed on at a time

_SET = "doc_id long, n_shingles long, set_id binary, bits array<long>, tiles array<long>"


@cache
def bands(percent: int, most: int) -> tuple[list[int], list[int]]:
    """Smallest size of each band up to size ``most``, and its number of segments.

    A band reaches from its smallest size to ``WIDTH`` times it, and far enough for every
    partner of the smallest; no segments mean that only equal sets are similar.
    """
    starts, parts, low = [], [], 1
    while low <= most:
        high = max(int(low * WIDTH), 100 * low // percent)
        differ = 2 * high * (100 - percent) // (100 + percent)
        starts.append(low)
        parts.append(differ + 1 + SPARE if differ else 0)
        low = high + 1
    return starts, parts


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def tiles_of(items: np.ndarray, percent: int) -> list[int]:
    """The tiles of a set of hashes."""
    size = len(items)
    starts, parts = bands(percent, 1 << max(10, (2 * size).bit_length()))
    own = bisect_right(starts, size) - 1
    mixed, out = _mix(items), []
    for band in (own, own + 1):
        n = parts[band]
        if not n or (band > own and 100 * size < percent * starts[band]):
            continue
        segment = ((items >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        content, held = np.zeros(n, np.uint64), np.bincount(segment.astype(np.int64), minlength=n)
        np.add.at(content, segment.astype(np.int64), mixed)
        thick = np.flatnonzero(held >= THIN)
        if n - len(thick) > SPARE:
            thick = np.arange(n)
        name = content[thick] + np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        name = _mix(name + _mix((thick + 1).astype(np.uint64)))
        out += name.view(np.int64).tolist()
    return out


def bits_of(items: np.ndarray) -> list[int]:
    """The bitmap signature of a set of hashes."""
    at = np.unique(_mix(items + np.uint64(1)) >> np.uint64(54)).astype(np.int64) % (64 * BITS)
    out = np.zeros(BITS, np.uint64)
    np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out.view(np.int64).tolist()


def sets(docs: DataFrame, words: int, percent: int, text: str = "text") -> DataFrame:
    """Size, identity, signature and tiles of every document's set."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), ROWS):
                part, rows = batch.iloc[first:first + ROWS], []
                for value in part["text"]:
                    items = shingles(value, words)
                    rows.append((len(items), hashlib.md5(items.tobytes()).digest(),
                                 bits_of(items), tiles_of(items, percent))
                                if len(items) else (0, None, None, None))
                made = pd.DataFrame(rows, columns=["n_shingles", "set_id", "bits", "tiles"])
                made.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy())
                yield made

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col(text).alias("text")).mapInPandas(run, _SET)


def _allowed(percent: int) -> Column:
    """Whether sizes ``n``, ``m`` and bits ``x0``.., ``y0``.. leave the similarity possible."""
    def lacking(a: str, b: str) -> Column:
        return reduce(add, [F.bit_count(F.col(f"{a}{k}").bitwiseAND(F.bitwise_not(f"{b}{k}")))
                            for k in range(BITS)])

    overlap = F.least(F.col("n") - lacking("x", "y"), F.col("m") - lacking("y", "x"))
    return (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (
        100 * overlap >= percent * (F.col("n") + F.col("m") - overlap))


class _Links:
    """Decides pairs of nodes by size, signature and full set."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, scratch: Scratch, words: int,
                 percent: int, text: str):
        self.docs, self.nodes, self.scratch = docs, nodes, scratch
        self.words, self.percent, self.text, self.rounds = words, percent, text, 0

    def side(self, name: str, size: str, bits: str) -> DataFrame:
        return self.nodes.select(F.col("id").alias(name), F.col("n").alias(size), *[
            F.get("bits", F.lit(k)).alias(f"{bits}{k}") for k in range(BITS)])

    def of(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are linked."""
        near = pairs.distinct().join(self.side("a", "n", "x"), "a").join(
            self.side("b", "m", "y"), "b").where(_allowed(self.percent)).select("a", "b")
        return self.exact(near)

    def exact(self, near: DataFrame) -> DataFrame:
        self.rounds += 1
        near = self.scratch.write(near, f"near{self.rounds}")
        ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        full = self.scratch.write(full_sets(self.docs, ids, self.words, self.text),
                                  f"full{self.rounds}")
        for side in ("b", "a"):
            near = near.join(full.select(F.col("id").alias(side),
                                         F.col("items").alias(f"i_{side}")), side)
        both = F.size(F.array_intersect("i_a", "i_b"))
        linked = self.scratch.write(near.where(
            100 * both >= self.percent * (F.size("i_a") + F.size("i_b") - both)
        ).select("a", "b").distinct(), f"links{self.rounds}")
        self.scratch.drop(f"near{self.rounds}", f"full{self.rounds}")
        return linked


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
            text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    rows = scratch.write(sets(docs, words, percent, text), "sets")
    full = rows.where("doc_id is not null and n_shingles > 0")
    named = scratch.write(full.groupBy("set_id").agg(F.min("doc_id").alias("id")), "named")
    nodes = scratch.write(full.join(named.select(F.col("set_id").alias("_s"), "id"),
                                    (F.col("doc_id") == F.col("id")) & (F.col("set_id") == F.col("_s")))
                          .dropDuplicates(["id", "set_id"])
                          .select("id", F.col("n_shingles").alias("n"), "bits", "tiles"), "nodes")
    dealt = nodes.select("id", F.explode("tiles").alias("tile"))
    shared = dealt.groupBy(F.col("tile").alias("_tile")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("id").alias("pivot")).where("_n > 1")
    members = scratch.write(dealt.join(shared, F.col("tile") == F.col("_tile")).select(
        "tile", "id", "pivot"), "members")
    joined = Components(spark, scratch)
    links = _Links(docs, nodes, scratch, words, percent, text)

    # With the smallest of all sets it shares a tile with, then with the other tiles' smallest.
    star = members.where("id <> pivot")
    joined.add(links.of(star.groupBy("id").agg(F.min("pivot").alias("a")).select(
        "a", F.col("id").alias("b"))))
    star = star.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    joined.add(links.of(joined.of(joined.of(star, "a", "_a"), "b", "_b").where(
        "_a <> _b").select("a", "b")))

    grouped = scratch.write(joined.of(members.select("tile", "id"), "id", "class"), "grouped")
    parts = grouped.groupBy("tile", "class").agg(F.count(F.lit(1)).alias("part"))
    mixed = parts.groupBy(F.col("tile").alias("_tile")).agg(
        F.max_by("class", F.struct("part", "class")).alias("main"),
        F.count(F.lit(1)).alias("_n")).where("_n > 1")
    mixed = scratch.write(grouped.join(mixed, F.col("tile") == F.col("_tile")).select(
        "tile", "id", "class", "main"), "mixed")
    one = mixed.join(links.side("id", "n", "x"), "id")
    two = mixed.where("class <> main").select(
        F.col("tile").alias("_tile"), F.col("id").alias("b"), F.col("class").alias("_class")
    ).join(links.side("b", "m", "y"), "b")
    # Two sets outside the main class meet once.
    near = one.join(two, (F.col("tile") == F.col("_tile")) & (F.col("class") != F.col("_class"))
                    & ((F.col("class") == F.col("main")) | (F.col("id") < F.col("b")))
                    & _allowed(percent))
    joined.add(links.exact(near.select(
        F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()))

    known = joined.of(named, "id", "component")
    out = rows.select("doc_id", "n_shingles", "set_id").join(
        known.select(F.col("set_id").alias("_s"), "component"),
        (F.col("set_id") == F.col("_s")) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", "n_shingles",
                      F.coalesce("component", "doc_id").alias("component_id"))


def query(spark: SparkSession, path: str) -> DataFrame:
    """``op13_ngram_join``: the class of every document, on shingles of three words."""
    return classes(table(spark, path, "documents"))


def sql() -> str:
    """The same rows in DuckDB."""
    return classes_sql(WORDS, PERCENT) + "\nSELECT * FROM linked"
