"""Near-duplicates by a chosen-path set similarity join.

A document's set holds its distinct shingles (``words`` words each); equal sets are one node.
Every node has a sketch of minimum hashes. The ``ROOTS`` trees deal the nodes by two
coordinates each, as many texts share one value by chance, and branch them by chosen coordinates
from there: a path picks one of ``COORDINATES`` coordinates, or two with the odds that
make 1 / similarity branches on average, and sends each node to the child of its value there.
Two sets of the wanted similarity stay together along some path of some tree almost surely;
unlike sets part at once.

Level by level, each tree node first compares its members with one of them, chosen by hash, and
twice again with one of its main class; confirmed links merge classes. A tree node of one class
has nothing more to find. In others the members outside the main class are compared with all
members of other classes, each pair once, if these are at most ``WORK`` pairs; a node of more
branches on. Members of the main class are never compared with each other, so large groups of
near copies cost a few stars of comparisons. Pairs are only made where sizes, the sets' parity bitmaps and the
sketches' short sums (three standard errors) allow the similarity, and are confirmed on their
full sets. A bit on which two bitmaps differ stands for a shingle that only one set has, so the
bitmaps refuse no link; they spare groups of copies just below the similarity most of their pairs.
Classes are connected components of confirmed links, found by alternating large and small stars.

Recall. With the code's odds all trees lose a pair of exactly the wanted similarity, 0.8, with
probability 2e-7 at the roots, 1e-5 after one further level, 4e-4 after three, 0.2 % after five and
1 % after ``DEEPEST``, and the short sums refuse one in 700; more similar pairs are lost less. Only sets
in a node that is still over ``WORK`` pairs meet a deeper level. After the deepest one, what is
left is compared whatever it costs: such nodes agree in as many coordinates, which sets that
are not linked to the chosen members hardly do.

Nulls: a null text, and one without words, has an empty set and is linked with nothing; rows
without a document id are linked with nothing. A text of fewer words has its whole sequence as
its one shingle. Rows that repeat a document id count as one document. Very long texts are taken
whole; their sets are built one at a time. Ties: a class is named by its smallest id. Empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablero.llm.shared import Scratch, classes_sql, passing, table

WORDS = 5
PERCENT = 80
COORDINATES = 64
ROOTS = 15  # trees; the root of each has the next two coordinates
STARS = 2  # further stars of a level
WORK = 1 << 22
DEEPEST = 8
ROWS = 500  # documents handed on at a time
# 64-bit words of a filter that spares most other texts the shuffle, whatever there is to find.
FILTER = 1 << 16
# The last four bits of 256 minimum hashes, a fourth of these numbers for each bit, sum a sketch
# up. Unlike hashes of a pair at the wanted similarity, and three standard errors.
SUMS = 16
_ODDS = (100 - PERCENT) / 100 * 15 / 16
MOST_UNLIKE = int(16 * SUMS * _ODDS + 3 * (16 * SUMS * _ODDS * (1 - _ODDS)) ** 0.5)

# Bits of a set's parity bitmap.
BITS = 1024

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SKETCH = ("doc_id long, n_shingles long, set_id binary, sketch array<int>, "
           "sums array<long>, bits array<long>")


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit generator: every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    def run(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    if not len(starts):
        return np.empty(0, np.uint64)
    lower = data.astype(np.uint64) + np.uint64(1)
    lower[(data >= 65) & (data <= 90)] += np.uint64(32)
    power, inverse = _powers(1 << max(12, int(len(data)).bit_length()))
    # A word's bytes as digits of one number, wherever it stands.
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lower * power[:len(data)])])
    word = _mix((total[ends] - total[starts]) * inverse[starts])
    n = min(words, len(word))
    out = np.zeros(len(word) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + word[k:len(word) - n + 1 + k]
    return np.unique(_mix(out + np.uint64(n)))


@cache
def _factors() -> np.ndarray:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, (16 * SUMS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``COORDINATES`` minimum hashes, and the sums of all; items are not empty."""
    low = np.full(16 * SUMS, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(items), 2048):
        part = (items[i:i + 2048] * _factors()) >> np.uint64(32)
        low = np.minimum(low, part.min(axis=1))
    last = ((low >> np.arange(4, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(np.uint8)
    return (low[:COORDINATES].astype(np.uint32).view(np.int32),
            np.packbits(last.ravel(), bitorder="little").view(np.int64))


def parities(items: np.ndarray) -> np.ndarray:
    """``BITS`` bits: whether an odd number of the items falls to each place."""
    place = (items % np.uint64(BITS)).astype(np.int64)
    odd = (np.bincount(place, minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches in pieces of ``ROWS``, so that what is made of them stays small."""
    for batch in batches:
        for first in range(0, len(batch), ROWS):
            yield batch.iloc[first:first + ROWS]


def sketches(docs: DataFrame, words: int, text: str = "text") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _parts(batches):
            rows = []
            for value in part["text"]:
                items = shingles(value, words)
                rows.append((len(items), hashlib.md5(items.tobytes()).digest(), *sketch(items),
                             parities(items)) if len(items) else (0, None, None, None, None))
            made = pd.DataFrame(
                rows, columns=["n_shingles", "set_id", "sketch", "sums", "bits"])
            made.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy())
            yield made

    return docs.select("doc_id", F.col(text).alias("text")).mapInPandas(run, _SKETCH)


def _passing(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids``, and few others."""
    return passing(docs, "doc_id", ids.select("id"), FILTER)


def full_sets(docs: DataFrame, ids: DataFrame, words: int, text: str = "text") -> DataFrame:
    """(id, items) of the documents in ``ids``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _parts(batches):
            yield pd.DataFrame({"id": part["doc_id"], "items": [
                shingles(t, words).view(np.int64) for t in part["text"]]})

    some = _passing(docs.select("doc_id", F.col(text).alias("text")), ids)
    return some.join(ids, F.col("doc_id") == F.col("id"), "left_semi").mapInPandas(
        run, "id long, items array<long>")


def _near(a: str, b: str, percent: int) -> Column:
    """Whether sizes, bitmaps and sums, columns ``<a>n``, ``<a>b0``, ``<a>0`` and so on, allow
    the similarity."""
    apart = unlike = F.lit(0)
    for k in range(BITS // 64):
        apart = apart + F.bit_count(F.col(f"{a}b{k}").bitwiseXOR(F.col(f"{b}b{k}")))
    for k in range(SUMS // 4):
        bits = [F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}")) for i in range(k, SUMS, SUMS // 4)]
        unlike = unlike + F.bit_count(reduce(Column.bitwiseOR, bits))
    sizes = F.col(f"{a}n"), F.col(f"{b}n")
    # What only one set has is (1 - similarity) / (1 + similarity) of both sizes.
    allowed = (100 - percent) * (sizes[0] + sizes[1])
    return ((100 * F.least(*sizes) >= percent * F.greatest(*sizes))
            & ((100 + percent) * apart <= allowed) & (unlike <= MOST_UNLIKE))


def _side(nodes: DataFrame, name: str, prefix: str) -> DataFrame:
    """Sizes, bitmaps and sums of the nodes under the names that ``_near`` takes.

    None of them is null. That they cannot be, and that the roots' pairs are made in a loop, keeps
    the compiled code below the size up to which the JVM compiles a method to machine code.
    """
    def sure(values: str, n: int, to: str) -> list[Column]:
        return [F.coalesce(F.get(values, F.lit(k)), F.lit(0)).alias(f"{to}{k}") for k in range(n)]

    return nodes.select("*", _pairs(F.col("sketch")).alias("_pairs")).select(
        F.col("id").alias(name), F.coalesce("n", F.lit(0)).alias(f"{prefix}n"),
        *sure("_pairs", ROOTS, f"{prefix}s"),
        *sure("bits", BITS // 64, f"{prefix}b"), *sure("sums", SUMS, prefix))


def _pairs(values: Column) -> Column:
    """The two values of each tree's root as one number."""
    def pair(tree: Column) -> Column:
        one, two = (F.get(values, 2 * tree + k).cast("long") for k in (0, 1))
        return F.shiftleft(one, 32).bitwiseOR(two.bitwiseAND(F.lit(0xFFFFFFFF)))

    return F.transform(F.array(*map(F.lit, range(ROOTS))), pair)


def _roots(values: Column) -> Column:
    """The first children: one per tree, in their order."""
    return F.transform(_pairs(values), lambda pair, tree: F.xxhash64(tree, pair))


def _branches(path: Column, values: Column) -> Column:
    """The children of a path: its coordinates follow from the path alone."""
    one = F.pmod(F.xxhash64(path, F.lit(1)), F.lit(COORDINATES)).cast("int")
    # The second, always another one, with probability 1 / similarity - 1.
    two = F.pmod(one + 1 + F.pmod(F.xxhash64(path, F.lit(2)), F.lit(COORDINATES - 1)),
                 F.lit(COORDINATES)).cast("int")
    odds = F.pmod(F.xxhash64(path, F.lit(3)), F.lit(1000)) < int(1000 * (100 / PERCENT - 1))

    def child(at: Column) -> Column:
        return F.xxhash64(path, at, F.get(values, at))

    return F.when(odds, F.array(child(one), child(two))).otherwise(F.array(child(one)))


class Components:
    """Classes of nodes joined by links; the class is its smallest node."""

    def __init__(self, spark: SparkSession, scratch: Scratch):
        self.scratch, self.rounds, self.name = scratch, 0, None
        self.edges = spark.createDataFrame([], "u long, v long")

    def _keep(self, edges: DataFrame) -> DataFrame:
        self.rounds += 1
        before, self.name = self.name, f"edges{self.rounds}"
        self.edges = self.scratch.write(edges, self.name)
        if before:
            self.scratch.drop(before)
        return self.edges

    def add(self, links: DataFrame) -> None:
        """Adds links (a, b) and joins the classes; ``edges`` then are (node, class)."""
        edges = self._keep(self.edges.unionByName(
            links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        ).distinct())
        seen = None
        while True:
            # Small star: all smaller neighbours, and the node, to the smallest.
            least = edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
            small = edges.join(least, F.col("u") == F.col("_u")).select(
                F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                F.col("m").alias("v"))
            # Large star: all larger neighbours to the smallest neighbour.
            both = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy(F.col("u").alias("_u")).agg(F.least(
                F.min("v"), F.col("_u")).alias("m"))
            large = both.where("v > u").join(least, F.col("u") == F.col("_u")).select(
                F.col("v").alias("u"), F.col("m").alias("v"))
            edges = self._keep(large.distinct())
            now = tuple(edges.agg(
                F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
            if now == seen:
                return
            seen = now

    def of(self, df: DataFrame, node: str, name: str) -> DataFrame:
        """Adds the class of a column of nodes."""
        known = self.edges.select(F.col("u").alias("_node"), F.col("v").alias("_class"))
        return df.join(known, F.col(node) == F.col("_node"), "left").withColumn(
            name, F.coalesce("_class", F.col(node))).drop("_node", "_class")


class Confirm:
    """Exact comparison of pairs, each pair once."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, scratch: Scratch, words: int,
                 percent: int, text: str):
        self.docs, self.nodes, self.scratch = docs, nodes, scratch
        self.words, self.percent, self.text = words, percent, text
        self.rounds, self.tested = 0, None

    def links(self, pairs: DataFrame) -> DataFrame | None:
        """The pairs (a, b) that are linked and not tried before, None if there are none."""
        near = pairs.distinct()
        for side in ("a", "b"):
            near = near.join(_side(self.nodes, side, f"_{side}"), side)
        return self.exact(near.where(_near("_a", "_b", self.percent)).select("a", "b"))

    def exact(self, near: DataFrame) -> DataFrame | None:
        """The same for distinct pairs that sizes, bitmaps and sums allow."""
        self.rounds += 1
        if self.tested is not None:
            near = near.join(self.tested, ["a", "b"], "left_anti")
        likely = self.scratch.write(near, f"likely{self.rounds}")
        before = self.tested
        self.tested = likely if before is None else self.scratch.write(
            before.unionByName(likely), f"tested{self.rounds}")
        if before is not None:
            self.scratch.drop(f"tested{self.rounds - 1}")
        ids = likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()
        if ids.isEmpty():
            return None
        sets = self.scratch.write(
            full_sets(self.docs, ids, self.words, self.text).dropDuplicates(["id"]),
            f"sets{self.rounds}")
        found = likely
        for side in ("b", "a"):
            found = found.join(sets.select(F.col("id").alias(side),
                                           F.col("items").alias(f"i_{side}")), side)
        both = F.size(F.array_intersect("i_a", "i_b"))
        # Of the union's size: the sizes of both less what they share.
        linked = self.scratch.write(found.where(
            100 * both >= self.percent * (F.size("i_a") + F.size("i_b") - both)
        ).select("a", "b"), f"links{self.rounds}")
        self.scratch.drop(f"sets{self.rounds}")
        return None if linked.isEmpty() else linked


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
            text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    rows = scratch.write(sketches(docs, words, text), "sketches")
    full = rows.where("doc_id is not null and n_shingles > 0")
    # Equal sets are one node, named by their smallest document.
    named = scratch.write(
        full.groupBy("set_id").agg(F.min("doc_id").alias("id")), "named")
    nodes = scratch.write(
        full.join(named.select(F.col("set_id").alias("_s"), "id"),
                  (F.col("doc_id") == F.col("id")) & (F.col("set_id") == F.col("_s")))
        .select("id", F.col("n_shingles").alias("n"), "sketch", "sums", "bits")
        .dropDuplicates(["id"]), "nodes")
    joined = Components(spark, scratch)
    confirm = Confirm(docs, nodes, scratch, words, percent, text)

    frontier = nodes.select("id", F.posexplode(_roots(F.col("sketch"))).alias("slot", "path"))
    for level in range(DEEPEST + 1):
        frontier = scratch.write(frontier, f"frontier{level}")
        sizes = frontier.groupBy(F.col("path").alias("_path")).agg(
            F.count(F.lit(1)).alias("_n"),
            F.min_by("id", F.xxhash64("path", "id")).alias("pivot")).where("_n > 1")
        members = scratch.write(frontier.join(sizes, F.col("path") == F.col("_path")).select(
            "path", "slot", "id", "pivot"), f"members{level}")
        scratch.drop(f"frontier{level}")
        for star in range(STARS + 1):
            pairs = joined.of(joined.of(members.where("id <> pivot").select(
                F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")
            ).distinct(), "a", "_a"), "b", "_b").where("_a <> _b").select("a", "b")
            links = confirm.links(pairs)
            if links is not None:
                joined.add(links)
            grouped = joined.of(members.drop("pivot"), "id", "class")
            parts = grouped.groupBy("path", "class").agg(
                F.count(F.lit(1)).alias("part"),
                F.min_by("id", F.xxhash64("path", "id", F.lit(star))).alias("one"))
            several = parts.groupBy(F.col("path").alias("_path")).agg(
                F.sum("part").alias("all"), F.max("part").alias("most"),
                F.max_by("class", F.struct("part", "class")).alias("main"),
                F.max_by("one", F.struct("part", "class")).alias("pivot"),
                F.count(F.lit(1)).alias("classes")).where("classes > 1")
            cheap = (F.col("all") - F.col("most")) * F.col("all") <= (
                WORK if level < DEEPEST else 1 << 62)
            # Nodes of several classes, each member with one of the main class.
            mixed = scratch.write(
                grouped.join(several, F.col("path") == F.col("_path")).select(
                    "path", "slot", "id", "class", "main", "pivot", cheap.alias("cheap")),
                f"mixed{level}_{star}")
            scratch.drop(f"members{level}" if star == 0 else f"mixed{level}_{star - 1}")
            members = mixed.where(F.col("class") != F.col("main")).select(
                "path", "slot", "id", "pivot").unionByName(mixed.where(
                    F.col("class") == F.col("main")).select(
                    "path", "slot", "id", F.col("id").alias("pivot")))
        some = mixed.where("cheap").drop("cheap", "pivot")
        one = some.join(_side(nodes, "id", "_x"), "id")
        two = some.where(F.col("class") != F.col("main")).select(
            F.col("path").alias("_path"), F.col("id").alias("other"),
            F.col("class").alias("_class")).join(_side(nodes, "other", "_y"), "other")
        first = F.lit(True)
        if level == 0:
            # In the first of the nodes that hold both.
            for slot in range(ROOTS):
                first = first & ((F.col("slot") <= slot) | (
                    F.col(f"_xs{slot}") != F.col(f"_ys{slot}")))
        pairs = one.join(two, (
            (F.col("path") == F.col("_path")) & (F.col("class") != F.col("_class"))
            # Two members outside the main class meet once.
            & ((F.col("class") == F.col("main")) | (F.col("id") < F.col("other")))
            & _near("_x", "_y", percent) & first))
        links = confirm.exact(pairs.select(
            F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())
        if links is not None:
            joined.add(links)
        onward = mixed.where(~F.col("cheap"))
        if level == DEEPEST or onward.isEmpty():
            break
        frontier = onward.join(nodes.select(F.col("id").alias("_node"), "sketch"),
                               F.col("id") == F.col("_node")).select(
            "id", F.lit(0).alias("slot"),
            F.explode(_branches(F.col("path"), F.col("sketch"))).alias("path"))

    known = joined.of(named, "id", "component")
    out = rows.select("doc_id", "n_shingles", "set_id").join(
        known.select(F.col("set_id").alias("_s"), "component"),
        (F.col("set_id") == F.col("_s")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one document of each class, all columns as they were."""
    ids = classes(docs, words, percent).where("kept").select("doc_id").distinct()
    some = docs.where("doc_id is not null").join(ids, "doc_id", "left_semi").select(
        *docs.columns).dropDuplicates(["doc_id"])
    return some.unionByName(docs.where("doc_id is null"))


def query(spark: SparkSession, path: str) -> DataFrame:
    """``op1_near_dedup``: the class of every document, on shingles of four words."""
    return classes(table(spark, path, "documents"), words=4)


def sql() -> str:
    """The same rows in DuckDB."""
    return classes_sql(4, PERCENT) + """
SELECT *, doc_id = component_id AS kept FROM linked"""
