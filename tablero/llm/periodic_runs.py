"""Periodic runs of words, by recompression.

The words of a batch of texts, texts parted by letters that occur once, are one string. Block
compression (a maximal block of one symbol becomes one symbol) and pair compression (symbols
fall on two sides by a hash; a left one before a right one becomes one symbol) alternate until
one symbol is left: a run-length grammar of logarithmic depth. Equal stretches are parsed alike
but for a bounded part at their ends, so how far two positions agree (LCE) is answered by
climbing the levels while whole groups agree and going down to the first difference, a bounded
number of steps a level. No suffix array is built.

Candidates are a harmonic grid: for each period q the positions 0, 3q, 6q, ... of a text. A run
of at least 4q words covers one of them and the word q further on, which agree; both
directions' extensions there give the whole stretch. One of several periods of a stretch counts,
the smallest (the others are its multiples).

A run is a stretch of consecutive words with smallest period q (words q apart are equal), of at
least ``max(SHORTEST, COPIES * q)`` words, that no neighbouring word extends.

Nulls: a null or empty text, and one without words, has no runs and collapses to the empty
text; a null ``doc_id`` stays. Repeated rows give a row each. Ties: runs that overlap or start
together are all reported, by start, then period. A text of any length is taken whole: memory
follows the longest text, and candidates are tried ``CHUNK`` at a time. Empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablero.llm.shared import table, words_of

COPIES = 4
SHORTEST = 6
BATCH_WORDS = 1 << 16  # words compressed together; a longer text is alone
CHUNK = 1 << 20  # candidates tried at a time

_RUN = "array<struct<start:long,length:long,period:long>>"
_OUT = f"doc_id long, n_words long, runs {_RUN}, collapsed string"


@dataclass
class Level:
    """The symbols of a level and their groups: each group is a symbol of the next level."""

    symbols: np.ndarray
    group: np.ndarray  # of each symbol
    first: np.ndarray  # symbol of each group, and the end
    pairs: bool

    def mirrored(self) -> Level:
        size, groups = len(self.symbols), len(self.first) - 1
        return Level(self.symbols[::-1], (groups - 1 - self.group)[::-1],
                     (size - self.first)[::-1], self.pairs)


def _sides(symbols: np.ndarray, turn: int) -> np.ndarray:
    """True for the symbols on the left side in this turn."""
    x = symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(
        turn * 0xD1B54A32D192ED03 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(63)).astype(bool)


def grammar(letters: np.ndarray) -> list[Level]:
    """The levels above ``letters`` up to a single symbol. First and last letter occur once."""
    levels, symbols, fresh, turn = [], letters, int(letters.max()) + 1, 0
    while len(symbols) > 1:
        pairs = turn % 2 == 1
        head = np.ones(len(symbols), bool)
        if pairs:
            left = _sides(symbols, turn)
            head[1:] = ~(left[:-1] & ~left[1:])
        else:
            head[1:] = symbols[1:] != symbols[:-1]
        turn += 1
        first = np.flatnonzero(head)
        if len(first) == len(symbols):
            continue
        ends = np.append(first, len(symbols))
        counts = np.diff(ends)
        levels.append(Level(symbols, np.cumsum(head) - 1, ends, pairs))
        above = symbols[first]
        joined = np.flatnonzero(counts > 1)
        what = symbols[first[joined] + 1] if pairs else counts[joined]
        names, which = np.unique((above[joined] << 32) | what, return_inverse=True)
        above[joined] = fresh + which
        symbols, fresh = above, fresh + len(names)
    return levels


def agree(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters from ``a`` on equal those from ``b`` on; a < b, position by position."""
    x, y, top = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for level in levels:
        if not len(live):
            break
        sym, group, first = level.symbols, level.group, level.first
        u, v = x[live], y[live]
        gu, gv = group[u], group[v]
        inside = (first[gu] != u) | (first[gv] != v)
        # What both have left of a group that one of them is inside of.
        step = np.where(inside & (sym[u] == sym[v]),
                        np.minimum(first[gu + 1] - u, first[gv + 1] - v), 0)
        u, v = u + step, v + step
        gu, gv = group[u], group[v]
        onward = (first[gu] == u) & (first[gv] == v) & (sym[u] == sym[v])
        x[live], y[live] = np.where(onward, gu, u), np.where(onward, gv, v)
        live = live[onward]
        top[live] += 1
    for height in range(int(top.max(initial=0)), 0, -1):
        level, live = levels[height - 1], np.flatnonzero(top >= height)
        sym, group, first = level.symbols, level.group, level.first
        u, v = first[x[live]], first[y[live]]
        # Unlike pairs share their first symbol at most, unlike blocks the shorter one.
        most = 1 if level.pairs else np.minimum(first[group[u] + 1] - u, first[group[v] + 1] - v)
        step = np.where(sym[u] == sym[v], most, 0)
        x[live], y[live] = u + step, v + step
    return x - a


def _grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) of the harmonic grid of every text, ``CHUNK`` or so at a time."""
    longest = np.where(sizes >= SHORTEST, sizes // COPIES, 0)
    text = np.repeat(np.arange(len(sizes)), longest)
    period = np.arange(len(text)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    width = (COPIES - 1) * period
    points = -(-(sizes[text] - period) // width)
    total = np.cumsum(points)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(total, total[at] + CHUNK)))
        n = points[at:end]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield (np.repeat(starts[text[at:end]], n) + np.repeat(width[at:end], n) * step,
               np.repeat(period[at:end], n))
        at = end


def runs_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All runs of several texts as rows (text, start, length, period), and, for the texts' words
    one after the other, whether a run drops the word: it comes after the run's first period.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    names: dict[bytes, int] = {}
    letters = np.full(int(sizes.sum()) + len(texts) + 1, -1, np.int64)
    starts = np.cumsum(sizes + 1) - sizes  # one letter that occurs once before each text
    for start, words in zip(starts, texts, strict=True):
        letters[start:start + len(words)] = [names.setdefault(w, len(names)) for w in words]
    between = letters < 0
    letters[between] = len(names) + np.arange(between.sum())
    levels = grammar(letters)
    back = [level.mirrored() for level in levels]
    last = len(letters) - 1
    found = [np.empty((0, 3), np.int64)]
    for i, q in _grid(starts, sizes):
        same = letters[i] == letters[i + q]
        i, q = i[same], q[same]
        begin = i - agree(back, last - (i + q - 1), last - (i - 1))
        end = i + q + agree(levels, i, i + q)
        whole = end - begin >= np.maximum(SHORTEST, COPIES * q)
        found.append(np.stack([begin[whole], end[whole], q[whole]], axis=1))
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    other = np.ones(len(runs), bool)
    other[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)  # the smallest period of a stretch
    runs = runs[other]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    edge = np.zeros(len(letters) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    text = np.searchsorted(starts, runs[:, 0], "right") - 1
    rows = np.stack([text, runs[:, 0] - starts[text], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    return rows, (np.cumsum(edge)[:-1] > 0)[~between]


def _found(ids: list, texts: list[list[bytes]]) -> pd.DataFrame:
    rows, dropped = runs_of(texts)
    edges = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    out, at = [], 0
    for k, (doc, words) in enumerate(zip(ids, texts, strict=True)):
        gone = dropped[at:at + len(words)]
        at += len(words)
        runs = [dict(zip(("start", "length", "period"), r)) for r in
                rows[edges[k]:edges[k + 1], 1:].tolist()]
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if runs else words
        out.append((doc, len(words), runs, b" ".join(kept).decode("utf-8", "replace")))
    return pd.DataFrame(out, columns=["doc_id", "n_words", "runs", "collapsed"]).astype(
        {"doc_id": "Int64"})


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: all runs and the text with each run cut
    down to its first period, words joined by one space."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, value in zip(batch["doc_id"], batch["text"], strict=True):
                words = (value or "").encode("utf-8", "replace").split()  # at ASCII blanks
                if texts and size + len(words) > BATCH_WORDS:
                    yield _found(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(None if pd.isna(doc) else int(doc))
                texts.append(words)
                size += len(words)
            if texts:
                yield _found(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col(text).alias("text")).mapInPandas(run, _OUT)


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text); texts of one in ten ids, by their checksum, become periodic from a word on.

    With h the checksum, g = h div 10, n words: from word a = g mod n on, the text repeats its
    p = 1 + (n - a) div (3 + g mod 8) words at a. A null id leaves the text as it is.
    """
    check = F.crc32(F.col("doc_id").cast("string"))
    words = words_of(F.col("text"))
    n = F.size(words).cast("long")
    g = F.floor(check / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    copies = F.ceil((n - a) / p).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), copies))
    whole = F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), again), F.lit(1),
                    n.cast("int"))
    return docs.select("doc_id", F.when((check % 10 == 0) & (n > 0), F.array_join(whole, " "))
                       .otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, path: str) -> DataFrame:
    """``op11_periodic_runs``: runs of every document after the planted periods, as digests."""
    found = find(with_planted_period(table(spark, path, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[
        r[c].cast("string") for c in ("start", "length", "period")]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    ).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")
