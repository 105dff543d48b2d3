"""Quality by a small convolutional network over bytes, in numpy.

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by ``OVERLAP`` and
cover all of it. Every byte is a learned vector; learned filters of ``WIDTH`` bytes move over
a chunk in steps of ``STRIDE``; each filter's maximum (after the rectifier) feeds one linear
unit per chunk, and a document's logit is the mean of its chunks', so it does not depend on
the length. The last step is a logistic curve.

Learning uses a bounded sample: ``DOCUMENTS`` labelled documents by hash order, at most
``CHUNKS_EACH`` evenly spaced chunks of each. Scoring covers every whole text. Of several
labels of a document the highest counts; null labels and texts are not learned from. A null or
empty text is one chunk of zero bytes. Without labels of both classes all scores are 0.5.
Repeated rows are scored each; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablero.llm.language_id import fold
from tablero.llm.shared import table

CHUNK, OVERLAP = 512, 64
WIDTH, STRIDE = 8, 4
VECTOR, FILTERS = 8, 24
DOCUMENTS, CHUNKS_EACH = 6000, 4
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.004, 1e-4
FOLDS, HELD_OUT = 5, 0
PREDICT_AT = 0.3


def chunks(data: bytes) -> np.ndarray:
    """All chunks of a text as rows, the last one padded with zero bytes."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + CHUNK, np.uint8)
    padded[:len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


@dataclass
class Net:
    vectors: np.ndarray  # byte x VECTOR
    filters: np.ndarray  # WIDTH * VECTOR x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # FILTERS
    offset: np.ndarray  # 1

    @classmethod
    def fresh(cls, seed: int = 7) -> Net:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(draw(0.5, 256, VECTOR), draw((WIDTH * VECTOR) ** -0.5, WIDTH * VECTOR, FILTERS),
                   np.zeros(FILTERS, np.float32), draw(FILTERS ** -0.5, FILTERS),
                   np.zeros(1, np.float32))

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """chunk x position x (WIDTH * VECTOR)."""
        seen = self.vectors[rows]
        views = np.lib.stride_tricks.sliding_window_view(seen, WIDTH, axis=1)[:, ::STRIDE]
        return np.ascontiguousarray(views.transpose(0, 1, 3, 2)).reshape(
            len(rows), -1, WIDTH * VECTOR)

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seen = self.windows(rows)
        raw = seen @ self.filters + self.bias
        at = raw.argmax(axis=1)
        top = np.take_along_axis(raw, at[:, None, :], axis=1)[:, 0]
        return np.maximum(top, 0), at, seen

    def logits(self, rows: np.ndarray) -> np.ndarray:
        """One per chunk, a bounded number of chunks at a time."""
        parts = []
        for i in range(0, len(rows), 256):
            raw = self.windows(rows[i:i + 256]) @ self.filters
            top = np.maximum(raw.max(axis=1) + self.bias, 0)
            parts.append(top @ self.weights + self.offset)
        return np.concatenate(parts)

    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.bias, self.weights, self.offset]

    def gradients(self, rows: np.ndarray, owner: np.ndarray, share: np.ndarray,
                  y: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss; owner: each chunk's document, share: 1 / its chunks."""
        top, at, seen = self.pooled(rows)
        logit = np.bincount(owner, share * (top @ self.weights + self.offset), len(y))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        up = ((p - y)[owner] * share / len(y)).astype(np.float32)
        live = up[:, None] * self.weights * (top > 0)  # chunk x filter
        # Only the window that won a filter's maximum passes its gradient on.
        won = np.take_along_axis(seen, at[:, :, None], axis=1)  # chunk x filter x window
        d_filters = np.einsum("cf,cfw->wf", live, won)
        d_seen = (live[:, :, None] * self.filters.T).reshape(-1, VECTOR)
        place = at[:, :, None] * STRIDE + np.arange(WIDTH)
        byte = np.take_along_axis(rows, place.reshape(len(rows), -1), axis=1).ravel()
        d_vectors = np.zeros_like(self.vectors)
        np.add.at(d_vectors, byte, d_seen)
        return [d_vectors, d_filters, live.sum(0), top.T @ up, up.sum(keepdims=True)]


def fit(samples: list[tuple[np.ndarray, int]], seed: int = 7) -> Net:
    """Adam over batches of documents; samples: (chunks, label)."""
    net, rng = Net.fresh(seed), np.random.default_rng(seed)
    first = [np.zeros_like(x) for x in net.parts()]
    second = [np.zeros_like(x) for x in net.parts()]
    t, total = 0, EPOCHS * -(-len(samples) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(samples))
        for i in range(0, len(order), BATCH):
            batch = [samples[j] for j in order[i:i + BATCH]]
            sizes = np.array([len(c) for c, _ in batch])
            owner = np.repeat(np.arange(len(batch)), sizes)
            grads = net.gradients(
                np.concatenate([c for c, _ in batch]), owner, (1 / sizes)[owner],
                np.array([y for _, y in batch], float))
            t += 1
            rate = RATE * (1 - t / (total + 1))
            for x, g, m, v in zip(net.parts(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * ((m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
                             + DECAY * x)
    return net


def sample(docs: DataFrame, labels: DataFrame, label: str) -> list[tuple[np.ndarray, int]]:
    """A bounded number of labelled documents, a bounded number of chunks of each."""
    few = labels.where(f"{label} is not null and doc_id is not null").groupBy("doc_id").agg(
        F.max(label).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(DOCUMENTS).select(
        F.col("doc_id").alias("_id"), "label")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = []
            for text in batch["text"]:
                rows = chunks(text.encode("utf-8", "replace"))
                some = np.unique(np.linspace(0, len(rows) - 1, CHUNKS_EACH).astype(int))
                data.append(rows[some].tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"],
                                "data": data})

    cuts = docs.select("doc_id", "text").where("text is not null").join(
        F.broadcast(few), F.col("doc_id") == F.col("_id")).select(
        "doc_id", "text", "label").mapInPandas(cut, "doc_id long, label int, data binary")
    # A fixed order, so that the same rows give the same network.
    rows = sorted((r["doc_id"], r["label"], bytes(r["data"])) for r in cuts.collect())
    return [(np.frombuffer(data, np.uint8).reshape(-1, CHUNK), y) for _, y, data in rows]


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Net | None:
    samples = sample(docs, labels, label)
    return fit(samples) if len({y for _, y in samples}) == 2 else None


def score(docs: DataFrame, net: Net | None) -> DataFrame:
    """(doc_id, score) of every whole text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                data = (text or "").encode("utf-8", "replace")
                logit = float(net.logits(chunks(data)).mean()) if net else 0.0
                out.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"),
                                "score": pd.Series(out, dtype="float64")})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")


def query(spark: SparkSession, path: str) -> DataFrame:
    """``op3_quality_net``: the quality of every document."""
    docs = table(spark, path, "documents").select("doc_id", "text")
    out = score(docs, learn(docs, table(spark, path, "labels")))
    return out.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
