"""Draws that depend on a seed and on what they are drawn for, not on the layout.

A draw is a function of (seed, keys): the md5 of their text gives two whole numbers of 52
bits. So a row gets the same draw under any partitioning, in any order and when a lost
task is run again, and every engine that has md5 gets it too. Keys are any columns; null counts
as empty text. Draws for different keys, or different seeds, are independent.

:func:`permuted` is a keyed bijection of 0..n-1: alternating rounds add a hash of one half of
the number to the other half, on a rectangle of barely more than n places; a number that ends outside the
n places goes on until it is inside. A shuffle is thus a projection, not a sort.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from moraine.functions.box import total

DIGITS = 13  # hexadecimal ones of a number: 52 bits
ROUNDS = 6
_WALK = 64  # beyond it the chance of a number still outside is below (2 / sqrt(n)) ** 64


def digest(seed: int, *keys: Column | str) -> Column:
    own = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *own).cast("binary"))


def whole(digest_: Column, place: int = 0) -> Column:
    """A whole number below 2**52, the first or second one of a digest."""
    return F.conv(F.substring(digest_, 1 + DIGITS * place, DIGITS), 16, 10).cast("bigint")


def _unit(digest_: Column, place: int = 0) -> Column:
    return whole(digest_, place) / F.lit(float(1 << 4 * DIGITS))


def uniform(seed: int, *keys: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """In [low, high)."""
    return _unit(digest(seed, *keys)) * (high - low) + low


def normal(seed: int, *keys: Column | str, mean: float = 0.0, sigma: float = 1.0) -> Column:
    """From two uniform draws, by radius and angle."""
    d = digest(seed, *keys)
    return F.sqrt(-2 * F.log(1 - _unit(d))) * F.cos(6.283185307179586 * _unit(d, 1)) * sigma + mean


def unit_vector(seed: int, *keys: Column | str, dimension: int = 3) -> list[Column]:
    """The components of a random direction."""
    draws = [normal(seed, *keys, F.lit(k)) for k in range(dimension)]
    norm = F.sqrt(total([c * c for c in draws]))
    return [c / norm for c in draws]


def permuted(index: Column | str, n: int, seed: int, rounds: int = ROUNDS) -> Column:
    """The place of ``index`` (0..n-1) in a random order of 0..n-1."""
    if n < 1:
        return F.lit(None).cast("bigint")
    a = isqrt(n - 1) + 1
    b = -(-n // a)
    index = (F.col(index) if isinstance(index, str) else index).cast("bigint")

    def half(k: Column, other: Column, size: int) -> Column:
        return whole(digest(seed, k, other)) % size

    def step(v: Column, k: Column) -> Column:
        left = F.struct(((v["l"] + half(k, v["r"], a)) % a).alias("l"), v["r"].alias("r"))
        right = F.struct(v["l"].alias("l"), ((v["r"] + half(k, v["l"], b)) % b).alias("r"))
        return F.when(k % 2 == 0, left).otherwise(right)

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / b).alias("l"), (x % b).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda v: v["l"] * b + v["r"])

    walk = min(a * b - n, _WALK)  # as many numbers are outside, so a cycle never has more of them
    out = once(index)
    if walk:
        out = F.aggregate(F.sequence(F.lit(1), F.lit(walk)), out, lambda x, _: F.when(x >= n, once(x)).otherwise(x))
    return F.when(out < n, out).when(out >= n, F.raise_error(F.lit("the permutation left its range")).cast("bigint"))
