"""Ranked lexical search turned round: documents stream through an index over the items.

The items' terms are a small inverted index (term -> items that hold it, and how often). Blocks
of at most ``POSTINGS`` index entries, made on the cluster, are broadcast one after the other.
Two passes over the documents serve a block. The first counts what a weight needs: documents
with a term, terms in all, and documents per indexed term. The second runs each document's term
counts through the index, adds up its scores, and keeps the best ``TOP`` documents of each item
in a bounded heap per task. The tasks' heaps are merged by a ranking in two steps, so no
single task gathers an item's candidates of the whole corpus.

Terms are maximal runs of ASCII letters, digits and code points from 0x80 on; only A-Z are
lower-cased. With N documents that hold a term, L terms in all, df documents with the term, n
terms of the document and tf of them the term, all divisions rounding down:

    w = floor(1000 ln((2N + 2) / (2 df + 1)))       m = 100 - 25 + 25 n N div L
    score = sum over the item's terms, repeats included, of w (10^9 tf div (1000 tf + 12 m))

Nulls: a null or empty text has no term and is never found. Rows without a ``doc_id`` count in
N, L and df, and are never returned; items without an id are left out. Repeated rows are
documents of their own. Rows of one ``item_id`` are one item, an item's repeated rows counting
once. Equal scores go by ascending ``doc_id``. Very long texts are counted whole. Empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablero.llm.shared import LOWER, UPPER, table

TOP = 20
POSTINGS = 1_000_000  # index entries broadcast at a time
PARTS = 64  # first step of the merge: parts of an item's candidates

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_INSIDE = "0123456789" + UPPER + LOWER
_TO_TERMS = bytes(
    code if code >= 128 or chr(code) in _INSIDE.replace(UPPER, "")
    else code + 32 if chr(code) in UPPER else 32 for code in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order."""
    return (text or "").encode("utf-8", "replace").translate(_TO_TERMS).split()


def postings(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term, times): the terms of each item and how often it holds them."""
    rows = items.select(F.col(item).alias("item_id"), F.col(text).alias("text")).where(
        "item_id is not null").distinct()
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return rows.select("item_id", F.explode(terms).alias("term")).groupBy(
        "item_id", "term").agg(F.count(F.lit(1)).alias("times"))


class Index:
    """One block of postings as arrays, sorted by term."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["term", "item_id"], ignore_index=True)
        # ``items`` are item ids, ``item`` their places among them.
        self.items, self.item = np.unique(rows["item_id"].to_numpy(), return_inverse=True)
        self.times = rows["times"].to_numpy(np.int64)
        terms = rows["term"].drop_duplicates()
        self.terms = {t.encode(): k for k, t in enumerate(terms)}
        self.edges = np.append(terms.index.to_numpy(np.int64), len(rows))

    def counts(self, words: list[bytes]) -> dict[int, int]:
        """How often each indexed term occurs."""
        seen = Counter(words)
        few, many = sorted((seen.keys(), self.terms.keys()), key=len)
        return {self.terms[t]: seen[t] for t in few if t in many}


def _statistics(docs: DataFrame, index) -> DataFrame:
    """(term, rows): documents per indexed term; term -1 counts documents, -2 all terms."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = index.value
        held = np.zeros(len(block.terms), np.int64)
        documents = total = 0
        for batch in batches:
            for text in batch["text"]:
                words = terms_of(text)
                documents += bool(words)
                total += len(words)
                held[list(block.counts(words))] += 1
        some = np.flatnonzero(held)
        yield pd.DataFrame({"term": np.append(some, [-1, -2]),
                            "rows": np.append(held[some], [documents, total])})

    return docs.select("text").mapInPandas(run, "term long, rows long").groupBy("term").agg(
        F.sum("rows").alias("rows"))


def _heaps(docs: DataFrame, index, weights, documents: int, total: int, top: int) -> DataFrame:
    """(item_id, doc_id, score): the best documents of each item, task by task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, weight = index.value, weights.value
        score = np.zeros(len(block.items), np.int64)
        least = np.ones(len(block.items), np.int64)  # what a document must reach
        heaps: list[list[tuple[int, int]]] = [[] for _ in block.items]
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = terms_of(text)
                found = block.counts(words)
                if not found:
                    continue
                m = 75 + 25 * len(words) * documents // total
                reached = []
                for term, tf in found.items():
                    part = slice(block.edges[term], block.edges[term + 1])
                    worth = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
                    score[block.item[part]] += worth * block.times[part]  # each item once a term
                    reached.append(block.item[part])
                touched = np.concatenate(reached)
                for item in np.unique(touched[score[touched] >= least[touched]]).tolist():
                    entry, heap = (int(score[item]), -int(doc)), heaps[item]
                    if len(heap) < top:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)
                    if len(heap) == top:
                        least[item] = max(1, heap[0][0])
                score[touched] = 0
        out = [(int(block.items[k]), -doc, value) for k, heap in enumerate(heaps)
               for value, doc in heap]
        yield pd.DataFrame(out, columns=["item_id", "doc_id", "score"]).astype("int64")

    return docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(
        run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP,
           postings_each: int = POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of every item."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    entries = postings(items)
    blocks = max(1, -(-entries.count() // postings_each))
    best = None
    for k in range(blocks):
        # An item is whole in its block, so a block is bounded but for one longer item.
        rows = entries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toPandas()
        index = spark.sparkContext.broadcast(Index(rows))
        counted = {r["term"]: r["rows"] for r in _statistics(docs, index).collect()}
        documents, total = counted.pop(-1, 0), counted.pop(-2, 0)
        weights = spark.sparkContext.broadcast(np.array(
            [math.floor(1000 * math.log((2 * documents + 2) / (2 * counted.get(t, 0) + 1)))
             for t in range(len(index.value.terms))], np.int64))
        found = _heaps(docs, index, weights, documents, max(1, total), top)
        best = found if best is None else best.unionByName(found)
    order = [F.desc("score"), "doc_id"]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    within = Window.partitionBy("item_id", "part").orderBy(*order)
    few = best.withColumn("part", part).withColumn("n", F.row_number().over(within)).where(
        F.col("n") <= top)
    return few.withColumn("rank", F.row_number().over(
        Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top).select(
        "item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, path: str) -> DataFrame:
    """``op12_item_search``: the 20 best documents of every benchmark item."""
    return search(table(spark, path, "documents"), table(spark, path, "benchmark"))


def sql() -> str:
    """The same over the raw tables."""
    def terms(text: str) -> str:
        return (f"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), "
                r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

    return f"""
WITH words AS (
  SELECT row_number() OVER () AS row_id, doc_id, {terms('text')} AS terms FROM documents),
docs AS (SELECT row_id, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, sum(n) AS terms FROM docs),
counts AS (
  SELECT row_id, term, count(*) AS tf
  FROM (SELECT row_id, unnest(terms) AS term FROM docs) GROUP BY row_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counts, totals GROUP BY term, docs),
items AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest({terms('text')}) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL))
  GROUP BY item_id, term),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf)
    // (1000 * tf + 12 * (75 + CAST((25 * n * totals.docs) // totals.terms AS BIGINT))))) AS BIGINT) AS score
  FROM items JOIN counts USING (term) JOIN weights USING (term) JOIN docs USING (row_id), totals
  WHERE doc_id IS NOT NULL GROUP BY item_id, row_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0)
WHERE rank <= {TOP}"""
