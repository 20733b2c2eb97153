"""Hilbert curve codes of positions, as columns.

A position is mapped to a cell of a grid of 2**depth cells per axis and the
cell's place on a Hilbert curve comes from the transposed-bits form of the
curve: shifts and exclusive ors of columns, one projection for each bit and axis, which
whole-stage code generation fuses.

A bit of the code depends only on the cell's bits of the same and higher levels. So the cells
below a coarser cell are one interval of the curve, the coarser cell's code being their codes' common prefix
(:func:`curve_codes` gives it), and a cuboid is a few intervals (:func:`curve_intervals`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.functions.box import Box

MAX_DEPTH = {2: 16, 3: 10}


def curve_depth(box: Box, cell: float) -> int:
    """Levels so that cells are not larger than ``cell``, within the limits."""
    return max(1, min(MAX_DEPTH[box.dimension], math.ceil(math.log2(max(max(box.lengths) / cell, 2.0)))))


def curve_codes(cell: Sequence[int], depth: int) -> int:
    """The place on the curve of one cell, integers in [0, 2**depth) per axis."""
    x, n, gray, code = list(cell), len(cell), 0, 0
    for level in range(depth - 1, 0, -1):
        q = 1 << level
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                swap = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = (x[0] ^ swap, x[i] ^ swap) if i else (x[0], x[0])
    for i in range(1, n):
        x[i] ^= x[i - 1]
    for level in range(depth - 1, 0, -1):
        gray ^= (1 << level) - 1 if x[-1] >> level & 1 else 0
    for level in range(depth - 1, -1, -1):
        for v in x:
            code = code << 1 | (v ^ gray) >> level & 1
    return code


def cell_of(r: Column, length: float, depth: int) -> Column:
    """The cell along an axis; positions outside the box are wrapped."""
    part = r / length + 0.5
    return F.least(F.floor((part - F.floor(part)) * (1 << depth)), F.lit((1 << depth) - 1)).cast("bigint")


def with_hilbert_code(rows: DataFrame, box: Box, depth: int, name: str = "hilbert") -> DataFrame:
    """Add the place on the curve of each row's position."""
    if box.dimension not in MAX_DEPTH or not 1 <= depth <= MAX_DEPTH[box.dimension]:
        raise ValueError("codes need two dimensions and depth 1..16, or three and 1..10")
    h = [f"_h{i}" for i in range(box.dimension)]
    out = rows.withColumns({c: cell_of(F.col(a), n, depth) for c, a, n in zip(h, box.axes, box.lengths)})
    first = F.col(h[0])
    for level in range(depth - 1, 0, -1):
        q = 1 << level
        for c in h:
            own = F.col(c)
            on, swap = own.bitwiseAND(q) > 0, first.bitwiseXOR(own).bitwiseAND(q - 1)
            turned = F.when(on, first.bitwiseXOR(F.lit(q - 1)))
            out = out.withColumns({h[0]: turned.otherwise(first.bitwiseXOR(swap)), c: F.when(on, own).otherwise(own.bitwiseXOR(swap))} if c != h[0] else {c: turned.otherwise(first)})
    for before, c in zip(h, h[1:]):
        out = out.withColumn(c, F.col(c).bitwiseXOR(F.col(before)))
    gray = F.lit(0).cast("bigint")
    for level in range(depth - 1, 0, -1):
        gray = gray.bitwiseXOR(F.when(F.col(h[-1]).bitwiseAND(1 << level) > 0, (1 << level) - 1).otherwise(0))
    out = out.withColumn("_g", gray)
    code = F.lit(0).cast("bigint")
    for level in range(depth):
        for i, c in enumerate(h):
            code = code + F.shiftleft(F.shiftright(F.col(c).bitwiseXOR(F.col("_g")), level).bitwiseAND(1), box.dimension * level + box.dimension - 1 - i)
    return out.withColumn(name, code).drop(*h, "_g")


def covered(low: float, high: float, length: float, cells: int) -> list[int]:
    """The cells of an axis that [low, high] touches, round the box."""
    a, b = math.floor((low / length + 0.5) * cells), math.floor((high / length + 0.5) * cells)
    return list(range(cells)) if b - a >= cells - 1 else sorted({k % cells for k in range(a, b + 1)})


def curve_intervals(box: Box, bounds: Sequence[tuple[float, float]], depth: int, most: int = 32) -> list[tuple[int, int]]:
    """Closed intervals of codes, at most ``most``, that hold all positions within ``bounds`` (lowest
    and highest coordinate of each axis). Cells are taken as fine as ``most * 8`` of them allow; intervals nearest to each other are joined."""
    found: list[int] = [0]
    at = 0
    for level in range(1, depth + 1):
        axes = [covered(low, high, n, 1 << level) for (low, high), n in zip(bounds, box.lengths)]
        if math.prod(map(len, axes)) > 8 * most:
            break
        found, at = sorted(curve_codes(c, level) for c in product(*axes)), level
    shift = box.dimension * (depth - at)
    out = [(c << shift, ((c + 1) << shift) - 1) for c in found]
    gaps = sorted(((b[0] - a[1], k) for k, (a, b) in enumerate(zip(out, out[1:]))), reverse=True)
    apart = sorted(k for gap, k in gaps[: most - 1] if gap > 1)
    starts = [0, *[k + 1 for k in apart]]
    return [(out[a][0], out[b - 1][1]) for a, b in zip(starts, [*starts[1:], len(out)])] if out else []
