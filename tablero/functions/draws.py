"""Seeded draws: reproducible pseudo-random columns computed from a row's own key.

A draw depends on the seed, its purpose and the key only, so rows come out the same under
any partitioning and when a lost executor's work is repeated. The key is mixed once into two
words, a cubic and a quadratic congruence over two primes, and every draw adds them up with
factors of its own over a third prime. That is bigint arithmetic only: it compiles into a
small row loop and reads the same in any SQL dialect.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

SPAN = 1 << 32
_HALF = SPAN // 2

# The largest primes below 2^30 (two of them) and below 2^32: products of two remainders and
# their sums stay within a bigint.
_P, _Q, _R = (1 << 30) - 35, (1 << 30) - 41, (1 << 32) - 5


def _factors(purpose: str, seed: int, part: str, count: int) -> list[int]:
    """Coefficients that set one purpose and one draw apart from all others."""
    digest = hashlib.sha512(f"{seed}|{purpose}|{part}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) % (_Q - 1) + 1 for k in range(count)]


def words_sql(purpose: str, seed: int, key: str) -> tuple[str, str]:
    """The two mixed words of a bigint key."""
    a, b, c, d, e, f, k, m, n, s = _factors(purpose, seed, "palabras", 10)
    x, y = f"({key} % {_P})", f"({key} % {_Q})"
    cubic = (f"(({x} * {a} + {b}) % {_P}) * (({x} * {c} + {d}) % {_P}) % {_P}"
             f" * (({x} * {e} + {f}) % {_P}) % {_P}")
    quadratic = f"(({y} * {k} + {m}) % {_Q}) * (({y} * {n} + {s}) % {_Q}) % {_Q}"
    return cubic, quadratic


def draw_sql(purpose: str, seed: int, i: int, words: tuple[str, str]) -> str:
    """Draw ``i``: 0 … 2^32-6, evenly spread and unrelated to the other draws."""
    s, t, w = _factors(purpose, seed, str(i), 3)
    return f"(({words[0]}) * {s} + ({words[1]}) * {t} + {w}) % {_R}"


def with_draws(df: DataFrame, purpose: str, seed: int, count: int, key: str) -> DataFrame:
    """Add draws ``_u0`` … ``_u<count-1>`` of a bigint key."""
    words = ("_w0", "_w1")
    mixed = df.withColumns(
        {name: F.expr(text) for name, text in zip(words, words_sql(purpose, seed, key))}
    )
    return mixed.withColumns(
        {f"_u{i}": F.expr(draw_sql(purpose, seed, i, words)) for i in range(count)}
    )


def u(i: int) -> Column:
    return F.col(f"_u{i}")


def scaled(draw: Column, top: int | Column) -> Column:
    """round(draw · top): 0 … top, where both ends have half the weight of the others."""
    top = F.lit(top) if isinstance(top, int) else top
    return F.shiftright(draw * top.cast("bigint") + F.lit(_HALF), 32)


def pick(values: list[str], place: Column) -> Column:
    """The value at a place counted from 0; the list becomes one constant array."""
    return F.get(F.split(F.lit(",".join(values)), ","), place.cast("int"))


def choice(draw: Column, values: list[str]) -> Column:
    """A value of the list; the first and the last have half weight."""
    return pick(values, scaled(draw, len(values) - 1))


def above(draw: Column, share: float) -> Column:
    """True for draws above ``share`` of the range."""
    return draw > F.lit(int(share * SPAN))


def amount(draw: Column, low: int, span: int, digits: int, kind: str) -> Column:
    """low + draw · span in units of the last decimal, as an exact decimal."""
    units = F.lit(low) + scaled(draw, span)
    unit = F.lit(f"{10 ** -digits:.{digits}f}").cast(f"decimal({digits + 1},{digits})")
    return (units.cast("decimal(20,0)") * unit).cast(kind)


def position(high: Column, low: Column, n: Column) -> Column:
    """0 … n-1 from 52 bits of two draws, for lists of any length.

    Never NULL, which saves the planner from filtering join keys for it.
    """
    return F.coalesce(F.pmod(F.shiftleft(high, 20) + F.shiftright(low, 12), n), F.lit(0))


def padded(value: Column, width: int) -> Column:
    """Left-padded with zeros; a longer number keeps all its digits."""
    text = value.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def row_uuid(purpose: str, seed: int, key: str) -> Column:
    """A stable identifier of 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.lit(f"{seed}|{purpose}|uuid"), F.col(key)))
