"""Packing documents into sequences by cutting-stock column generation.

1. Every document becomes token ids and an end id, cut into pieces of ``LIMIT`` ids and a rest.
2. The pieces' length histogram (``LIMIT`` numbers, whatever the data size) is a cutting-stock
   problem: a linear program over patterns, which are multisets of lengths that fit one
   sequence. A knapsack dynamic program prices new patterns until none improves the program,
   or the proven gap is below ``GAP`` of the bound. Patterns are used their rounded-down number
   of times; the lengths left over, less than one sequence per pattern, are filled one by one.
3. Pieces are ranked within their length, and each rank is one slot of one use of a pattern.

Tokens come from the vocabulary's rank file, which encodes several times faster than the
vocabulary file and gives the same ids. A very long text is encoded whole; where the rank
file's pattern matcher gives up (about a million blanks in a row), the vocabulary file takes it.

Nulls: a null text is empty and is its end id alone. Repeated rows are packed each; pieces
equal in everything take any of their places. Empty tables give empty results; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablero.functions.ranking import row_number
from tablero.llm.shared import Scratch, table

LIMIT = 1024
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"  # the same vocabulary as ranks
MARKER = "<|endoftext|>"  # one id in the vocabulary file
END = 0
GAP = 1e-3
ROUNDS = 400

_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class Encoder:
    """Ids of texts as little-endian bytes, four per id.

    The ranks encode ordinary text; a text with the vocabulary's marker, or one that the ranks'
    pattern cannot take, is left to the tokenizer file itself. Both give the same ids (tests).
    """

    def __init__(self, path: str | None, ranks: str | None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        ranks = ranks or public_tokenizers.path(RANKS)
        with open(ranks, "rb") as file:
            pairs = [line.split() for line in file]
        self.plain = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, special_tokens={},
            mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs})
        self.whole = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))

    def __call__(self, text: str) -> bytes:
        ids = None
        if MARKER not in text:
            try:
                ids = self.plain.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # a run of blanks too long for the pattern
                pass
        if ids is None:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()


@cache
def encoder(path: str | None = None, ranks: str | None = None) -> Encoder:
    """One per Python worker."""
    return Encoder(path, ranks)


def pieces(docs: DataFrame, path: str | None = None,
           ranks: str | None = None) -> DataFrame:
    """The pieces of every document, in order, with the checksum of their ids."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, size = encoder(path, ranks), 4 * LIMIT
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text or "") + END.to_bytes(4, "little")
                doc = None if pd.isna(doc_id) else int(doc_id)
                rows += [(doc, at // 4, (len(part := ids[at:at + size])) // 4,
                          zlib.crc32(part), len(ids) // 4) for at in range(0, len(ids), size)]
            made = pd.DataFrame(rows, columns=_PIECES.replace(" long", "").split(", "))
            yield made.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(cut, _PIECES)


def best_pattern(lengths: np.ndarray, worth: np.ndarray, limit: int = LIMIT
                 ) -> tuple[float, np.ndarray]:
    """The multiset of lengths within the limit of the highest worth, as counts."""
    order = np.argsort(lengths)
    sizes, value = lengths[order], worth[order]
    most = np.zeros(limit + 1)
    taken = np.full(limit + 1, -1)
    fits = np.searchsorted(sizes, np.arange(limit + 1), "right")
    for room in range(1, limit + 1):
        n = fits[room]
        if n:
            total = most[room - sizes[:n]] + value[:n]
            k = int(total.argmax())
            most[room], taken[room] = total[k], k
        if most[room - 1] >= most[room]:
            most[room], taken[room] = most[room - 1], -1
    counts, room = np.zeros(len(lengths)), limit
    while room > 0:
        k = taken[room]
        if k < 0:
            room -= 1
        else:
            counts[order[k]] += 1
            room -= sizes[k]
    return float(most[limit]), counts


def fill(lengths: np.ndarray, left: np.ndarray, whole: bool) -> np.ndarray:
    """A pattern for the longest length left: one or two others that fill it, or the knapsack.

    ``whole``: no length more often than ``left`` has it.
    """
    live = np.nonzero(left >= 1 if whole else left > 0)[0]
    counts = np.zeros(len(lengths))
    longest = live[-1]
    counts[longest] = 1
    room = LIMIT - lengths[longest]
    place = np.full(LIMIT + 1, -1)
    place[lengths[live]] = live
    if whole and left[longest] < 2:
        place[lengths[longest]] = -1
    if room and place[room] >= 0:
        counts[place[room]] += 1
        return counts
    smaller = lengths[live][(lengths[live] < room) & (place[lengths[live]] >= 0)]
    mates = smaller[place[room - smaller] >= 0] if room else smaller[:0]
    for a in mates[::-1]:
        pair = counts.copy()
        pair[place[a]] += 1
        pair[place[room - a]] += 1
        if not whole or (pair <= left).all():
            return pair
    if whole:
        for k in live[::-1]:
            n = min(room // lengths[k], left[k] - counts[k])
            counts[k] += n
            room -= int(n) * lengths[k]
    elif room:
        fits = live[lengths[live] <= room]
        if len(fits):
            _, more = best_pattern(lengths[fits], lengths[fits] * (1.0 + lengths[fits] / 1e6),
                                   room)
            counts[fits] += more
    return counts


def start(lengths: np.ndarray, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A first basis: each pattern uses up a length that no later pattern holds."""
    m, left = len(lengths), demand.copy()
    columns, uses = [], []
    while (left > 0).any():
        column = fill(lengths, left, whole=False)
        some = np.nonzero(column)[0]
        ratio = left[some] / column[some]
        amount = ratio.min()
        left[some] -= amount * column[some]
        columns.append(column)
        uses.append(amount)
        ended = some[ratio <= amount * (1 + 1e-12)]
        left[ended] = 0
        for k in ended[1:]:  # several at once: their own patterns, unused
            single = np.zeros(m)
            single[k] = LIMIT // lengths[k]
            columns.append(single)
            uses.append(0.0)
    return np.array(columns).T, np.array(uses)


def solve(lengths: np.ndarray, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and their fractional uses, by the revised simplex method."""
    m = len(lengths)
    # A trace of noise keeps uses from being 0 together, where the method would stand still.
    demand = demand + 1e-3 * np.random.default_rng(0).random(m)
    basis, uses = start(lengths, demand)
    inverse = np.linalg.inv(basis)
    bound = 0.0
    for round_ in range(ROUNDS):
        price = inverse.sum(axis=0)
        value, column = best_pattern(lengths, price)
        # Prices divided by the best value are feasible for the dual program.
        bound = max(bound, float(demand @ np.maximum(price, 0)) / max(value, 1e-12))
        if value <= 1 + 1e-7 or uses.sum() - bound <= max(0.5, GAP * bound):
            break
        step = inverse @ column
        able = step > 1e-9
        ratio = np.full(m, np.inf)
        ratio[able] = uses[able] / step[able]
        out = int(ratio.argmin())
        amount = ratio[out]
        uses = np.maximum(uses - amount * step, 0)
        uses[out] = amount
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        if round_ % 100 == 99:
            try:
                inverse = np.linalg.inv(basis)
            except np.linalg.LinAlgError:
                break  # the uses so far are still a plan, only not a better one
            uses = np.maximum(inverse @ demand, 0)
    return basis, uses


def plan(histogram: dict[int, int]) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often each is used; together they hold the histogram exactly."""
    plans = [({LIMIT: 1}, histogram[LIMIT])] if histogram.get(LIMIT) else []
    lengths = np.array(sorted(k for k, n in histogram.items() if n and k < LIMIT), int)
    if not len(lengths):
        return plans
    demand = np.array([histogram[k] for k in lengths], float)
    columns, uses = solve(lengths, demand)
    left = demand.copy()
    for j in np.argsort(-uses):
        column = columns[:, j]
        some = column > 0
        # Rounded down, and never more than is there.
        times = int(min(np.floor(uses[j] + 1e-6), np.min(left[some] // column[some])))
        if times:
            left -= times * column
            plans.append(({int(k): int(a) for k, a in zip(
                lengths[some], column[some], strict=True)}, times))
    # The rest is less than one sequence per pattern.
    while (left >= 1).any():
        column = fill(lengths, left, whole=True)
        some = column > 0
        times = int(np.min(left[some] // column[some]))
        left -= times * column
        plans.append(({int(k): int(a) for k, a in zip(
            lengths[some], column[some], strict=True)}, times))
    return plans


def slots(plans: list[tuple[dict[int, int], int]]) -> list[tuple[int, ...]]:
    """(length, first rank, last rank, copies per use, first sequence, place) per pattern."""
    rows, ranked, sequence = [], {}, 0
    for pattern, times in plans:
        place = 0
        for length in sorted(pattern, reverse=True):
            copies = pattern[length]
            first = ranked.get(length, 0)
            ranked[length] = first + copies * times
            rows.append((length, first, ranked[length] - 1, copies, sequence, place))
            place += copies * length
        sequence += times
    return rows


def pack(docs: DataFrame, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """Every piece with its sequence and its place there."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.write(pieces(docs, path, ranks), "pieces")
    histogram = {r["length"]: r["n"] for r in
                 cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # At most LIMIT patterns and what is left over, each of at most 44 different lengths.
    found = spark.createDataFrame(
        slots(plan(histogram)),
        "_length long, _first long, _last long, _copies long, _sequence long, _place long")
    ranked = row_number(
        cut, ["length"],
        [F.col(c) for c in ("doc_id", "start", "doc_tokens", "ids_crc32")], "_rank")
    rank = F.col("_rank") - 1
    within = (rank - F.col("_first")).cast("long")
    use = F.floor(within / F.col("_copies")).cast("long")
    return ranked.join(
        F.broadcast(found),
        (F.col("length") == F.col("_length")) & rank.between(F.col("_first"), F.col("_last")),
    ).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_sequence") + use).alias("sequence_id"),
        (F.col("_place") + (within % F.col("_copies")) * F.col("length")).alias("offset"),
    )


def query(spark: SparkSession, path: str) -> DataFrame:
    """``op5_packing``: every piece of every document, packed."""
    return pack(table(spark, path, "documents"))
