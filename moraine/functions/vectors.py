"""Vectors and small matrices as arrays of doubles, in higher-order functions.

Index functions count from 1, with the first axis running fastest.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BOLTZMANN = 1.380649e-23  # J/K
AVOGADRO = 6.02214076e23  # 1/mol
ELECTRON_VOLT = 1.602176634e-19  # J
DALTON = 1.66053906660e-27  # kg
#: Limits of the number types in use.
LIMITS = {"double": {"epsilon": sys.float_info.epsilon, "min": sys.float_info.min, "max": sys.float_info.max}, "int": {"min": -(2**31), "max": 2**31 - 1}, "bigint": {"min": -(2**63), "max": 2**63 - 1}}


def _fold(a: Column, start: Column, step) -> Column:
    return F.aggregate(a, start, step)


def vector_sum(a: Column) -> Column:
    return _fold(a, F.lit(0.0), lambda s, x: s + x)


def vector_prod(a: Column) -> Column:
    return _fold(a, F.lit(1.0), lambda s, x: s * x)


def inner_prod(a: Column, b: Column) -> Column:
    return vector_sum(F.zip_with(a, b, lambda x, y: x * y))


def element_prod(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def element_div(a: Column, b: Column) -> Column:
    """Element-wise quotient; null where the divisor is 0."""
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, y))


def element_mod(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x % y)


def element_min(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def element_max(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def add_scalar(a: Column, s) -> Column:
    return F.transform(a, lambda x: x + s)


def subtract_scalar(a: Column, s) -> Column:
    return F.transform(a, lambda x: x - s)


def multiply_scalar(a: Column, s) -> Column:
    return F.transform(a, lambda x: x * s)


def divide_scalar(a: Column, s) -> Column:
    return F.transform(a, lambda x: F.try_divide(x, F.lit(s) if not isinstance(s, Column) else s))


def vector_max(a: Column) -> Column:
    return F.array_max(a)


def vector_min(a: Column) -> Column:
    return F.array_min(a)


def is_close(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two values differ by at most ``tolerance`` relative to both."""
    return F.abs(a - b) <= tolerance * F.least(F.abs(a), F.abs(b))


def vector_floor(a: Column) -> Column:
    return F.transform(a, lambda x: F.floor(x).cast("double"))


def vector_ceil(a: Column) -> Column:
    return F.transform(a, lambda x: F.ceil(x).cast("double"))


def vector_sqrt(a: Column) -> Column:
    return F.transform(a, F.sqrt)


def vector_round(a: Column) -> Column:
    """Nearest integer, halves away from zero."""
    return F.transform(a, lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5))


def norm_1(a: Column) -> Column:
    return vector_sum(F.transform(a, F.abs))


def norm_2(a: Column) -> Column:
    return F.sqrt(inner_prod(a, a))


def norm_inf(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


def index_norm_inf(a: Column) -> Column:
    """Position (from 0) of the first element of the largest magnitude."""
    return F.array_position(F.transform(a, F.abs), norm_inf(a)) - 1


def find_component(a: Column, value) -> Column:
    """Position from 1, or null."""
    at = F.array_position(a, value)
    return F.when(at > 0, at)


def scalar_vector(size: int, value: float) -> Column:
    return F.array_repeat(F.lit(float(value)), size)


def scalar_matrix(rows: int, columns: int, value: float) -> Column:
    return F.array_repeat(scalar_vector(columns, value), rows)


def transpose(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(m[0]) - 1), lambda j: F.transform(m, lambda row: row[j]))


def diagonal(m: Column) -> Column:
    return F.transform(m, lambda row, i: row[i])


def trace(m: Column) -> Column:
    return vector_sum(diagonal(m))


def stress_outer(components: Sequence[Column]) -> list[Column]:
    """Diagonal elements first, then the upper off-diagonal ones."""
    n = len(components)
    pairs = [(i, i) for i in range(n)] + [(i, j) for i in range(n) for j in range(i + 1, n)]
    return [components[i] * components[j] for i, j in pairs]


def integer_power(x: Column, n: int) -> Column:
    """Repeated squaring, so that results do not depend on the library's pow."""
    if n < 0:
        raise ValueError("the exponent must not be negative")
    out, base = None, x
    while n:
        if n & 1:
            out = base if out is None else out * base
        n >>= 1
        base = base * base if n else base
    return F.lit(1.0) if out is None else out


def coprime(*columns: Column) -> Column:
    """Whether whole numbers have no common divisor but 1, by a fixed number of
    Euclidean steps (enough for 32-bit numbers)."""

    def gcd(a: Column, b: Column) -> Column:
        pair = F.aggregate(F.sequence(F.lit(1), F.lit(46)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")),
                           lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.greatest(F.abs(s["b"]), F.lit(1))).alias("b"))))
        return F.abs(pair["a"])

    out = columns[0]
    for c in columns[1:]:
        out = gcd(out, c)
    return out == 1


def offset_to_index(offset: Column, shape: Sequence[int]) -> list[Column]:
    out, rest = [], offset - 1
    for n in shape:
        out.append((F.pmod(rest, F.lit(n)) + 1).cast("long"))
        rest = F.floor(rest / n)
    return out


def index_to_offset(index: Sequence[Column], shape: Sequence[int]) -> Column:
    out, stride = F.lit(1), 1
    for i, n in zip(index, shape):
        out = out + (i - 1) * stride
        stride *= n
    return out.cast("long")


def multi_range(spark, first: Sequence[int], last: Sequence[int]):
    """All index tuples of half-open ranges, one row each (i0, i1, ...)."""
    shape = [max(b - a, 0) for a, b in zip(first, last)]
    rows, stride, out = spark.range(math.prod(shape)), 1, []
    for k, (a, n) in enumerate(zip(first, shape)):
        out.append((F.pmod(F.floor(F.col("id") / stride), F.lit(max(n, 1))) + a).cast("long").alias(f"i{k}"))
        stride *= max(n, 1)
    return rows.select(*out)
