"""Toxic passages as maximum-scoring segments.

1. A unit is a word or a prefix of it (``PREFIXES`` letters). Units score their log-odds
   between distinct blocks of ``BLOCK`` tokens of toxic and of other labelled texts, under a
   prior of ``PRIOR_BLOCKS`` blocks dealt like all blocks, less ``SHRINK`` standard errors.
   Those beyond ``MIN_ODDS`` count whose blocks' likelihood ratio against the classes' sizes
   has a root of at least ``MIN_Z``. Unlike a standard error it needs no other text to hold
   the unit: 21 toxic blocks and no other pass at equal classes, 6 at ten to one. A token
   scores as its best unit; every token also pays ``DRIFT``.
2. A linear-time scan finds all maximal segments of the whole token sequence (Ruzzo and Tompa).
   Only scoring tokens are visited, the drift between them is a difference of positions.
3. Segment scores S in n tokens are calibrated as extreme values: lambda solves
   sum(p e^(lambda s)) = 1 over the tokens of other texts, and the expected number of segments
   as good by chance is K n e^(-lambda S). A document's evidence sums
   lambda S - ln(K n) over its significant segments, and a logistic curve fitted on the
   labelled sample makes it a probability.

Learning uses a bounded sample, ``PER_CLASS`` labelled documents of each class by hash order.
Of several labels of a document the highest counts; null labels and texts are not learned
from. A null or empty text has no segment and the score of no evidence. Without labels of both
classes all scores are 0. Repeated rows are scored each; empty tables give empty results;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablero.llm.language_id import fold
from tablero.llm.shared import Scratch, first_by_hash, table

PER_CLASS = 8000
VOCABULARY = 20_000
PREFIXES = range(4, 9)
BLOCK = 200
PRIOR_BLOCKS = 2.0
SHRINK = 2.0
MIN_Z = 5.0
MIN_ODDS = 1.0
DRIFT = 0.1
FOLDS, HELD_OUT = 5, 0
PREDICT_AT = 0.5

_TOKEN = re.compile(r"\w+")
_HITS = "label int, n long, values array<double>, scores array<double>"


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def units(word: str) -> list[str]:
    """The word and its prefixes, marked by an asterisk."""
    return [word, *(word[:k] + "*" for k in PREFIXES if k <= len(word))]


def segments(places: list[int], values: list[float], drift: float
             ) -> list[tuple[int, int, float]]:
    """All maximal segments (start, end, score), end exclusive, left to right.

    ``places`` are the positions of tokens whose score less the drift is ``values``; every
    other token scores minus ``drift``.
    """
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum at its end
    total, seen = 0.0, 0
    for place, value in zip(places, values, strict=True):
        total -= drift * (place - seen)
        before, total, seen = total, total + value, place + 1
        if value <= 0:
            continue
        part = (place, place + 1, before, total)
        while True:
            # Left neighbours that start no lower cannot be part of a better segment.
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= part[2]:
                j -= 1
            if j < 0 or stack[j][3] >= part[3]:
                stack.append(part)
                break
            part = (stack[j][0], part[1], stack[j][2], part[3])
            del stack[j:]
    return [(a, b, top - low) for a, b, low, top in stack]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    drift: float = DRIFT
    rate: float = 1.0  # lambda
    size: float = 1.0  # K
    offset: float = 0.0
    slope: float = 0.0
    learned: bool = False

    def __post_init__(self):
        # No unit of a word scores unless its first letters are those of one that does.
        self.starts = {u.rstrip("*")[:PREFIXES[0]] for u in self.scores}

    def best(self, word: str) -> float:
        return max((self.scores[u] for u in units(word) if u in self.scores), default=0.0)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words, starts, first = tokens(text), self.starts, PREFIXES[0]
        near = [i for i, word in enumerate(words) if word[:first] in starts]
        scored = [(i, s) for i in near if (s := self.best(words[i]))]
        places, values = [i for i, _ in scored], [s - self.drift for _, s in scored]
        return len(words), segments(places, values, self.drift)

    def significant(self, n: int, found: list[tuple[int, int, float]]
                    ) -> list[tuple[int, int, float]]:
        """Segments with fewer than one such expected by chance, with lambda S - ln(K n)."""
        chance = math.log(max(self.size * n, 1e-9))
        return [(a, b, x) for a, b, s in found if (x := self.rate * s - chance) > 0]

    def probability(self, evidence: float) -> float:
        if not self.learned:
            return 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.offset
                                                 + self.slope * math.log1p(evidence)))))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, label) of a bounded number of labelled texts of each class."""
    known = labels.where(f"{label} is not null and doc_id is not null").groupBy("doc_id").agg(
        F.max(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    # Ids and labels only; at most 2 * per_class rows.
    few = first_by_hash(known.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT).select(
        "label", "doc_id"), "label", per_class).select(F.col("doc_id").alias("_id"), "label")
    return docs.select("doc_id", "text").where("text is not null").join(
        F.broadcast(few), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")


def token_scores(texts: DataFrame) -> dict[str, float]:
    """Scores of the telling units."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            blocks = [(label, " ".join(words[i:i + BLOCK]))
                      for text, label in zip(batch["text"], batch["label"], strict=True)
                      for words in [tokens(text)] for i in range(0, len(words), BLOCK)]
            yield pd.DataFrame(blocks, columns=["label", "block"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            toxic, other = Counter(), Counter()
            for label, block in zip(batch["label"], batch["block"], strict=True):
                own = {u for word in set(block.split(" ")) for u in units(word)}
                (toxic if label else other).update(own)
            names = list(toxic.keys() | other.keys())
            yield pd.DataFrame({"unit": names, "toxic": [toxic[u] for u in names],
                                "other": [other[u] for u in names]})

    scratch = Scratch(texts.sparkSession, "toxicity")
    # Copies share their blocks, which then prove nothing twice.
    blocks = scratch.write(
        texts.mapInPandas(cut, "label int, block string").distinct(), "blocks")
    sizes = {r["label"]: r["n"] for r in
             blocks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {}
    counts = blocks.mapInPandas(count, "unit string, toxic long, other long").groupBy(
        "unit").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    share = n1 / (n1 + n0)
    in_toxic = F.col("toxic") + PRIOR_BLOCKS * share
    in_other = F.col("other") + PRIOR_BLOCKS * (1 - share)
    odds = F.log(in_toxic / float(n1)) - F.log(in_other / float(n0))
    error = F.sqrt(1 / in_toxic + 1 / in_other)
    both = F.col("toxic") + F.col("other")

    def excess(n: str, part: float) -> Column:
        return F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (both * part))).otherwise(0.0)

    ratio = 2 * (excess("toxic", share) + excess("other", 1 - share))
    z = F.signum(odds) * F.sqrt(F.greatest(ratio, F.lit(0.0)))
    told = counts.select("unit", (odds - SHRINK * error).alias("score"), z.alias("z")).where(
        (F.col("z") >= MIN_Z) & (F.col("score") >= MIN_ODDS))
    rows = told.orderBy(F.col("z").desc(), "unit").limit(VOCABULARY).collect()
    return {r["unit"]: r["score"] for r in rows}


def karlin_rate(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * e^(rate * value)) = 1."""
    low, high = 0.0, 1.0
    excess = lambda x: float(np.sum(shares * np.exp(np.minimum(x * values, 700)))) - 1
    while excess(high) < 0 and high < 1e3:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Offset and slope of a weighted logistic curve, by damped Newton steps."""
    a = np.stack([np.ones_like(x), x], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (weight * (y - p)) - 1e-3 * beta
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    texts = sample(docs, labels, label, PER_CLASS)
    model = Model(token_scores(texts))
    if not model.scores:
        return model

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.scan(text) for text in batch["text"]]
            words = [tokens(text) if label == 0 else []
                     for text, label in zip(batch["text"], batch["label"], strict=True)]
            yield pd.DataFrame({
                "label": batch["label"].to_numpy(), "n": [n for n, _ in found],
                "values": [[s for w in own if w[:PREFIXES[0]] in model.starts
                            and (s := model.best(w))] for own in words],
                "scores": [[s for _, _, s in f] for _, f in found]})

    rows = texts.mapInPandas(scan, _HITS).collect()
    plain = [r for r in rows if r["label"] == 0]
    length = max(1, sum(r["n"] for r in plain))
    # What other texts' tokens score, scoring ones one by one and the rest together.
    values = np.array([s for r in plain for s in r["values"]])
    model.rate = karlin_rate(
        np.append(values, 0.0) - model.drift,
        np.append(np.full(len(values), 1.0), length - len(values)) / length)
    model.size = max(1e-6, sum(len(r["scores"]) for r in plain) / length)
    y = np.array([r["label"] for r in rows], float)
    x = np.log1p([sum(e for _, _, e in model.significant(
        r["n"], [(0, 0, s) for s in r["scores"]])) for r in rows])
    model.offset, model.slope = logistic(x, y, np.ones(len(y)))
    model.learned = 0 < y.sum() < len(y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages): significant passages by token positions, end exclusive."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.significant(*model.scan(text)) for text in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "score": [model.probability(sum(x for _, _, x in f)) for f in found],
                "passages": [[{"start": a, "end": b, "evidence": x} for a, b, x in f]
                             for f in found]})

    return docs.select("doc_id", "text").mapInPandas(
        scan, "doc_id long, score double, "
              "passages array<struct<start:long,end:long,evidence:double>>")


def query(spark: SparkSession, path: str) -> DataFrame:
    """``op4_toxicity``: the toxicity of every document."""
    docs = table(spark, path, "documents").select("doc_id", "text")
    out = score(docs, learn(docs, table(spark, path, "labels")))
    return out.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"))
