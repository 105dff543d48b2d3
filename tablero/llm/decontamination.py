"""Benchmark decontamination by BM25 retrieval.

Test items are indexed (inverted lists with BM25 impacts, items longer than ``SEGMENT`` words
in segments of nearly equal length). Every document is cut into passages of ``PASSAGE`` words, half overlapping, so
that any segment stands whole in one of them, and every passage is a query. Impacts are
divided by the segment's own score, so a score is the share of the segment's BM25 mass that
the passage holds, and all segments at or above ``SCORE`` are retrieved.

Retrieval is block-max WAND, vectorised over blocks of neighbouring segments: the sums of the
terms' block maxima bound all scores in a block. A passage that reaches the threshold in none
of ``RANGES`` wide ranges is skipped at once; for the others, only blocks of ``BLOCK`` segments
whose maxima reach it are scored, from their postings.

A retrieved item is verified: the shares of its question's and its answer's word trigrams
that stand in the passage must reach ``QUESTION`` and ``ANSWER``. Of an item in segments, the
passages that hold any of them within the item's length count together, with what is between
them; the score is that of the best segment. The answer is the last sentence, or the last
third of a text of one sentence.

The index is built in shards of about ``SHARD_WORDS`` words, each broadcast on its own; the texts
of an item are in one shard. How many segments hold a word, how many there are and how long they
are is counted over all items, so a passage's scores do not depend on the number of shards.

Null and empty texts match nothing, nor do null ids of items; repeated rows are each searched.
Equal scores keep the earliest passage. Empty tables give empty results; extra columns stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablero.llm.shared import Scratch, table

SEGMENT, PASSAGE = 64, 128
BLOCK = 8
RANGES = 32
SCORE = 0.6
QUESTION = ANSWER = 0.5
K1, B = 1.2, 0.75
SHARD_WORDS = 1_000_000

# No words: what counts of words say under these names.
SEGMENTS, LENGTH = "", " "

_WORD = re.compile(r"\w+")
_FOUND = "doc_id long, item_id long, score double, question double, answer double, word long"


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def parts(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    sentences = [w for s in re.split(r"(?<=[.?!])\s+|\n+", text) if (w := words(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    every = words(text)
    cut = max(1, len(every) - max(1, len(every) // 3))
    return every[:cut], every[cut:]


def segments(text: str) -> list[list[str]]:
    """The words of the item's segments, which are of nearly equal length."""
    every = [w for part in parts(text) for w in part]
    n = -(-len(every) // SEGMENT)
    return [every[len(every) * i // n:len(every) * (i + 1) // n] for i in range(n)]


def trigrams(some: list[str]) -> set[tuple[str, ...]]:
    n = min(3, len(some))
    return {tuple(some[i:i + n]) for i in range(len(some) - n + 1)} if n else set()


def held(wanted: set[tuple[str, ...]], passage: list[str]) -> float:
    """The share of ``wanted`` that stands in the passage; all of nothing."""
    if not wanted:
        return 1.0
    n = len(next(iter(wanted)))
    return len(wanted & {tuple(passage[i:i + n]) for i in range(len(passage) - n + 1)}
               ) / len(wanted)


class Index:
    """Impacts by term and segment, and their maxima by term and block of segments.

    ``held`` tells how many segments hold each word where the items are part of a larger
    collection, and under ``SEGMENTS`` and ``LENGTH`` how many these are and their words.
    """

    def __init__(self, items: list[tuple[int, str]], held: dict[str, int] | None = None):
        self.ids: list[int] = []
        self.checks: list[tuple[set, set]] = []  # of the segment's whole item
        self.further: list[int] = []
        bags: list[list[str]] = []
        for item_id, text in items:
            check = tuple(trigrams(part) for part in parts(text))
            cut = segments(text)
            length = sum(map(len, cut))
            for bag in cut:
                self.ids.append(item_id)
                self.checks.append(check)
                # Passages after the first that the whole item can reach, wherever it begins.
                self.further.append(-(-length // (PASSAGE // 2)) if len(cut) > 1 else 0)
                bags.append(bag)
        self.terms = {w: t for t, w in enumerate(sorted({w for bag in bags for w in bag}))}
        n = len(bags)
        counted = [np.unique([self.terms[w] for w in bag], return_counts=True) for bag in bags]
        term = np.concatenate([t for t, _ in counted]) if n else np.empty(0, int)
        count = np.concatenate([c for _, c in counted]).astype(float) if n else np.empty(0)
        segment = np.repeat(np.arange(n), [len(t) for t, _ in counted])
        length = np.array([len(bag) for bag in bags], float)
        df, count_all, length_all = np.bincount(term, minlength=len(self.terms)), n, length.sum()
        if held is not None:
            df = np.array([held[w] for w in self.terms], int)
            count_all, length_all = held.get(SEGMENTS, 0), held.get(LENGTH, 0)
        idf = np.log(1 + (count_all - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / (length_all / max(count_all, 1) or 1))
        impact = idf[term] * count * (K1 + 1) / (count + norm[segment])
        impact /= np.bincount(segment, impact, n)[segment]
        order = np.lexsort((segment, term))
        self.segment, self.impact, term = segment[order], impact[order], term[order]
        self.at = np.searchsorted(term, np.arange(len(self.terms) + 1))
        # Blocks: one entry per term and block that holds it.
        block = self.segment // BLOCK
        first = np.nonzero(np.diff(term, prepend=-1) | np.diff(block, prepend=-1))[0]
        self.block, self.posting_at = block[first], np.append(first, len(term))
        self.block_max = np.maximum.reduceat(self.impact, first) if n else self.impact
        self.block_at = np.searchsorted(term[first], np.arange(len(self.terms) + 1))
        # Maxima over wide ranges of segments; a bounded number of them, so dense.
        wide = max(1, -(-n // RANGES))
        self.ranges = np.zeros((len(self.terms), RANGES))
        np.maximum.at(self.ranges, (term, self.segment // wide), self.impact)

    def reach(self, ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """The highest range bound of each of n passages; passage k is steps k and k + 1.

        ``ids`` are the known words and ``at`` their steps. A term counts once per passage:
        in its first step, and in its second unless the first has it.
        """
        order = np.argsort(ids, kind="stable")
        same = ids[order[1:]] == ids[order[:-1]]
        last = np.full(len(ids), -2)  # the step of the term's previous place
        last[order[1:][same]] = at[order[:-1][same]]
        first = np.nonzero(last < at)[0]
        bounds = np.zeros((n + 1, RANGES))
        steps, begin = np.unique(at[first], return_index=True)
        bounds[steps] = np.add.reduceat(self.ranges[ids[first]], begin) if len(first) else 0
        again = np.zeros((n + 1, RANGES))
        fresh = np.nonzero(last < at - 1)[0]
        steps, begin = np.unique(at[fresh], return_index=True)
        again[steps] = np.add.reduceat(self.ranges[ids[fresh]], begin) if len(fresh) else 0
        return (bounds[:-1] + again[1:]).max(axis=1)

    def _entries(self, at: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Positions of the lists of some terms, or of some blocks of them."""
        sizes = at[terms + 1] - at[terms]
        starts = np.repeat(at[terms] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        return starts + np.arange(sizes.sum())

    def search(self, terms: np.ndarray, least: float = SCORE) -> list[tuple[int, float]]:
        """All (segment, score) at or above ``least`` for distinct terms."""
        entries = self._entries(self.block_at, terms)
        reach = np.bincount(self.block[entries], self.block_max[entries])
        open_ = reach >= least - 1e-9
        if not open_.any():
            return []
        # The postings of open blocks alone.
        entries = self._entries(self.posting_at, entries[open_[self.block[entries]]])
        scores = np.bincount(self.segment[entries], self.impact[entries])
        return [(int(s), float(scores[s])) for s in np.nonzero(scores >= least - 1e-9)[0]]

    def matches(self, text: str | None) -> list[tuple[int, float, float, float, int]]:
        """Verified (item, score, question, answer, first word), the best of each item."""
        own, get = words(text), self.terms.get
        none = len(self.terms)
        if not own or not none:
            return []
        ids = np.array([get(w, none) for w in own], np.int64)
        step = PASSAGE // 2
        n = max(1, -(-len(ids) // step) - 1)
        known = np.nonzero(ids < none)[0]
        bounds = self.reach(ids[known], known // step, n)
        # Passages that hold segments, by the items' checks: one item can have several texts.
        hits: dict[int, tuple[int, dict[int, float]]] = {}
        for k in np.nonzero(bounds >= SCORE - 1e-9)[0]:
            a, b = int(k) * step, min(int(k) * step + PASSAGE, len(ids))
            terms = np.unique(ids[a:b])
            for s, score in self.search(terms[terms < none]):
                scores = hits.setdefault(id(self.checks[s]), (s, {}))[1]
                scores[int(k)] = max(score, scores.get(int(k), 0.0))
        best: dict[int, tuple[float, float, float, int]] = {}
        for s, scores in hits.values():
            item, ks = self.ids[s], list(scores)
            end = 0
            for i, k in enumerate(ks):
                while end < len(ks) and ks[end] <= k + self.further[s]:
                    end += 1
                score = max(scores[x] for x in ks[i:end])
                if item in best and (-score, k * step) >= (-best[item][0], best[item][3]):
                    continue
                stretch = own[k * step:ks[end - 1] * step + PASSAGE]
                question, answer = (held(part, stretch) for part in self.checks[s])
                if question >= QUESTION and answer >= ANSWER:
                    best[item] = (score, question, answer, k * step)
        return [(item, *found) for item, found in sorted(best.items())]


def _held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(shard, word, held): how many segments of some items hold the word."""
    for batch in batches:
        for shard, some in batch.groupby("shard"):
            seen: Counter[str] = Counter()
            for text in some["text"]:
                for bag in segments(text):
                    seen.update({*bag, SEGMENTS})
                    seen[LENGTH] += len(bag)
            yield pd.DataFrame({"shard": shard, "word": list(seen), "held": list(seen.values())})


def _shards(items: DataFrame, text: str) -> Iterator[Index]:
    """Indexes over parts of the items: of a bounded size, but for one longer item."""
    known = items.where(F.col("item_id").isNotNull() & F.col(text).isNotNull()).select(
        "item_id", F.col(text).alias("text")).distinct()
    # A word takes two characters at least, its blank included.
    size = known.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // (2 * SHARD_WORDS)))
    if n == 1:
        yield Index(sorted((r["item_id"], r["text"]) for r in known.collect()))
        return
    known = known.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int"))
    scratch = Scratch(items.sparkSession, "decontamination")
    own = scratch.write(known.select("shard", "text").mapInPandas(
        _held, "shard int, word string, held long").groupBy("shard", "word").agg(
        F.sum("held").alias("held")), "own")
    # Of all shards, for the words of each.
    counts = scratch.write(own.select("shard", "word").join(
        own.groupBy("word").agg(F.sum("held").alias("held")), "word"), "counts")
    for k in range(n):
        held = {r["word"]: r["held"] for r in counts.where(F.col("shard") == k).collect()}
        part = known.where(F.col("shard") == k)
        yield Index(sorted((r["item_id"], r["text"]) for r in part.collect()), held)


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """One row per document and verified item: score, overlaps and the passage's first word."""
    spark, out = docs.sparkSession, None
    for index in _shards(items, text):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(doc_id, *found) for doc_id, body in
                        zip(batch["doc_id"], batch["text"], strict=True)
                        for found in shared.value.matches(body)]
                made = pd.DataFrame(rows, columns=_FOUND.replace(" long", "").replace(
                    " double", "").split(", "))
                yield made.astype({"doc_id": "Int64"})

        part = docs.select("doc_id", F.col(text).alias("text")).mapInPandas(search, _FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def _clean(shared: Broadcast[Index]) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not shared.value.matches(t) for t in texts], dtype="bool")

    return clean


def keep(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item."""
    for index in _shards(items, "text"):
        clean = _clean(docs.sparkSession.sparkContext.broadcast(index))
        docs = docs.where(clean(F.col("text")))
    return docs


def query(spark: SparkSession, path: str) -> DataFrame:
    """``op8_decontamination``: every document that holds an item of the benchmark."""
    return contaminated(table(spark, path, "documents"), table(spark, path, "benchmark"))
