"""Pairs of particles within a cutoff in a periodic box.

The range join becomes an equi-join: space is cut into cells at least one cutoff
wide, each row of one side is copied to the cells around it (half of them in a
self-join), and the distance is tested on what meets. With fewer than three
cells along an axis some cells around are the same one and are taken once. The rows of
a dense cell are dealt into blocks and meet others block by block, so that one
cell may hold any share of all rows, and a box may be a single cell.

Spheres are placed one after the other (:func:`placed_in_order`) by the cells' first undecided ones, in rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product
from math import floor, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from moraine.functions.box import Box, minimum_image, square, total
from moraine.sources.scratch import written

TILE_ROWS = 8_192  # rows of a block, about, and of all in dense cells one in BLOCKS, so that a row is copied as often in a larger table
BLOCKS = 32  # of both sides
MOST_TILE_ROWS = 65_536
BATCH = 100_000  # pairs of a batch, about
PLAIN_TILE_ROWS = 2_048  # of a block of all pairs, which Spark buffers
SLICE = 1 << 13  # distances taken at once, few enough for a processor's cache
LARGE = 1 << 20  # distances of a tile that is sorted first
MOST_BROADCAST = 500_000

#: Places of pairs in two tables, and [rr, dx..].
Near = tuple[np.ndarray, np.ndarray, list[np.ndarray]]


def cell_counts(box: Box, reach: float) -> list[int]:
    return [max(1, floor(n / reach)) for n in box.lengths]


def cell_index(r: Column, length: float, cells: int) -> Column:
    return F.pmod(F.floor(r / (length / cells)) + cells, F.lit(cells)).cast("int")


def with_cells(particles: DataFrame, box: Box, reach: float, binned: str = "") -> DataFrame:
    """Add the cell number of each axis: cx, cy, cz, by the positions x.. or by those with the prefix ``binned``."""
    counts = cell_counts(box, reach)
    return particles.withColumns({"c" + a: cell_index(F.col(binned + a), n, k) for a, n, k in zip(box.axes, box.lengths, counts)})


def _distances(pairs: DataFrame, box: Box) -> DataFrame:
    delta = {"d" + a: minimum_image(F.col(a + "_i") - F.col(a + "_j"), n) for a, n in zip(box.axes, box.lengths)}
    return pairs.withColumns(delta).withColumn("rr", total([square(F.col("d" + a)) for a in box.axes]))


def _sides(particles: DataFrame, side: str, keys: list[str]) -> DataFrame:
    return particles.select(*keys, *[F.col(c).alias(f"{c}_{side}") for c in particles.columns if c not in keys])


def dense_cells(rows: DataFrame, by: list[str], blocks: int = BLOCKS) -> DataFrame | None:
    """The cells of more rows than a block and in how many blocks their rows are dealt; None if
    there are none. At most one row for ``TILE_ROWS`` ones, broadcast if that is few."""
    counts = written(rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > TILE_ROWS))
    size = max(TILE_ROWS, min(MOST_TILE_ROWS, (counts.agg(F.sum("_n")).first()[0] or 0) // blocks))
    found = counts.where(F.col("_n") > size).select(*by, F.ceil(F.col("_n") / size).cast("int").alias("_blocks"))
    n = found.count()
    return None if not n else F.broadcast(found) if n <= MOST_BROADCAST else found


def _own_block(rows: DataFrame, dense: DataFrame | None, by: list[str], block: str, blocks: str) -> DataFrame:
    """Add the number of blocks of a row's cell and the row's block."""
    if dense is None:
        return rows.withColumns({blocks: F.lit(1), block: F.lit(0)})
    rows = rows.join(dense.withColumnRenamed("_blocks", blocks), by, "left").withColumn(blocks, F.coalesce(blocks, F.lit(1)))
    return rows.withColumn(block, F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int"))


def _reached(box: Box, counts: list[int], cells: list[str], reach: float, binned: str) -> Column:
    """Whether the cell on the way ``_o`` from a row's own is within reach of the row, or a little further."""
    squares = []
    for axis, c, n, k in zip(box.axes, cells, box.lengths, counts):
        way, place = F.col("_o")[c], F.col(binned + axis) / (n / k)
        inside = place - F.floor(place)
        up, down = (1 - inside) * (n / k), inside * (n / k)
        far = F.least(up, down) if k == 2 else F.when(way == 1, up).otherwise(down)
        squares.append(F.when(way == 0, 0.0).otherwise(square(F.greatest(far - 1e-6 * (n / k) - 1e-12 * F.abs(F.col(binned + axis)), F.lit(0.0)))))
    return total(squares) <= reach**2


def dealt(left: DataFrame, right: DataFrame, box: Box, reach: float, keys: list[str], same: bool, binned: str = "") -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the columns on which rows of near cells meet. A row of ``left`` is copied to those of the
    cells around its own (half of them in a self-join) that are not further from it than ``reach``. The rows of a dense cell are dealt into blocks:
    what is copied to it goes to each of its blocks (``_v``), and where the cell that rows come from is
    dense, each of its blocks (``_u``, with the way it came as ``_tag``) is met apart. So no value of these
    columns has more than a tile of two blocks, or the sparse cells around one block."""
    counts, cells = cell_counts(box, reach), ["c" + a for a in box.axes]
    offsets = list(product(*[sorted({-1 % k, 0, 1 % k}) for k in counts]))
    back = {o: tuple(-v % k for v, k in zip(o, counts)) for o in offsets}
    if same:
        offsets = [o for o in offsets if o <= back[o]]
    still = offsets.index((0,) * len(counts))
    by = [*keys, *cells]
    left, right = with_cells(left, box, reach, binned), with_cells(right, box, reach, binned)
    from_dense = dense_cells(left, by, BLOCKS if same else BLOCKS // 2)
    to_dense = from_dense if same else dense_cells(right, by, BLOCKS // 2)
    # what is its own way back, home too, meets from both ends
    around = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(o, cells)], F.lit(k).alias("way"), F.lit(o == back[o]).alias("home")) for k, o in enumerate(offsets)])
    shifted = {c: F.pmod(F.col(c) + F.col("_o")[c], F.lit(k)).cast("int") for c, k in zip(cells, counts)}
    left = _own_block(left, from_dense, by, "_u", "_us").withColumn("_o", F.explode(around))
    left = left.where(_reached(box, counts, cells, reach, binned)).withColumns(shifted)
    left = left.withColumn("_tag", F.when(F.col("_us") > 1, F.col("_o.way")).otherwise(F.lit(-1)))
    inside = F.lit(same) & (F.col("_o.way") == still)  # blocks of one cell meet once
    if to_dense is None:
        left = left.withColumn("_v", F.lit(0))
    else:
        left = left.join(to_dense, by, "left")
        left = left.withColumn("_v", F.explode(F.sequence(F.when(inside, F.col("_u")).otherwise(F.lit(0)), F.coalesce("_blocks", F.lit(1)) - 1))).drop("_blocks")
    left = left.withColumn("_home", F.col("_o.home") & ~(inside & (F.col("_u") != F.col("_v")))).drop("_o", "_us")
    right = _own_block(right, to_dense, by, "_v", "_vs")
    if from_dense is None:
        right = right.withColumns({"_tag": F.lit(-1), "_u": F.lit(0)})
    else:
        ways = from_dense.withColumn("_o", F.explode(around)).withColumns(shifted).groupBy(*by).agg(F.collect_list(F.struct(F.col("_o.way").alias("tag"), F.col("_blocks").alias("n"))).alias("_ways"))  # one a cell around
        plain = F.array(F.struct(F.lit(-1).alias("tag"), F.lit(1).alias("n")))
        right = right.join(ways, by, "left").withColumn("_w", F.explode(F.concat(plain, F.coalesce("_ways", F.slice(plain, 1, 0)))))
        last = F.when(F.lit(same) & (F.col("_w.tag") == still), F.col("_v")).otherwise(F.col("_w.n") - 1)
        right = right.withColumn("_tag", F.col("_w.tag")).withColumn("_u", F.explode(F.sequence(F.lit(0), last))).drop("_w", "_ways")
    return left if same else left.drop("_home"), right.drop("_vs"), [*by, "_v", "_tag", "_u"]


def ranks(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in the order of the ids of both sides; an id that is null has none, which is nan."""
    if pa.types.is_integer(a.type) and a.type == b.type and not a.null_count + b.null_count:
        return a.to_numpy(), b.to_numpy()
    both = pa.chunked_array([*a.chunks, *b.chunks])
    out = np.where(both.is_null().to_numpy(), np.nan, pc.rank(both, tiebreaker="dense").to_numpy())
    return out[: len(a)], out[len(a) :]


def _sorted(a: pa.Table, b: pa.Table, axes: list[str], lengths: list[float], reach: float) -> tuple[pa.Table, pa.Table, int | None]:
    """Both sides of a large tile along the axis on which fewest of their rows are near each other, and its number: distances
    are taken of these alone. None for small tiles and axes on which a distance is that to an image."""
    best = None
    if a.num_rows * b.num_rows >= LARGE:
        for k, (x, n) in enumerate(zip(axes, lengths)):
            r, q = a[x].to_numpy(), b[x].to_numpy()
            if not _across(r, q, n):
                some, ordered = r[:: 1 + len(r) // 64], np.sort(q)
                near = (np.searchsorted(ordered, some + reach) - np.searchsorted(ordered, some - reach)).mean()
                best = min(best or (near, k), (near, k))
    if best is None:
        return a, b, None
    a, b = (t.take(pa.array(np.argsort(t[axes[best[1]]].to_numpy(), kind="stable"))) for t in (a, b))
    return a, b, best[1]


def _across(r: np.ndarray, q: np.ndarray, n: float) -> bool:
    """Whether somewhere the nearest image isn't the row itself."""
    return bool(max(r.max() - q.min(), q.max() - r.min()) > n / 2)


def _near(a: pa.Table, b: pa.Table, box: Box, reach: float, along: int | None, batch: int) -> Iterator[Near]:
    """Pairs (places in ``a``, ascending, and in ``b``, [rr, dx..]) of rows closer than ``reach``, about ``batch`` at once. They are found in
    slices, by matrix products of a little more than the reach where no image is nearer, so that a pair is no row before its distance is known."""
    rows, others = a.num_rows, b.num_rows
    at = [(a[x].to_numpy(), b[x].to_numpy(), n) for x, n in zip(box.axes, box.lengths)]
    images = [_across(*x) for x in at]
    first, last = np.zeros(rows, int), np.full(rows, others)
    if along is not None:
        r, q, _ = at[along]
        wide = reach + 1e-9 * (reach + np.abs(r) + max(abs(q[0]), abs(q[-1])))
        first, last = np.searchsorted(q, r - wide), np.searchsorted(q, r + wide, "right")
    product = not any(images) and all(np.isfinite(r).all() and np.isfinite(q).all() for r, q, _ in at)
    if product:
        ours, theirs = (np.stack([x[k] - x[1].mean() for x in at]) for k in (0, 1))
        squares, ends = (ours * ours).sum(0), (theirs * theirs).sum(0)
        ours, theirs = np.stack([*ours, squares, np.ones(rows)], 1), np.stack([*(-2 * theirs), np.ones(others), ends])
        bound = reach**2 * (1 + 1e-9) + 1e-13 * (squares.max() + ends.max())
    places, count, low = [], 0, 0
    while low < rows:
        high = min(rows, low + max(1, SLICE // max(1, int(last[low] - first[low]))))
        while high > low + 1 and (high - low) * (last[high - 1] - first[low]) > 2 * SLICE:
            high = (low + high) // 2
        one, two = int(first[low]), int(last[high - 1])
        if product:
            close = ours[low:high] @ theirs[:, one:two] < bound
        else:
            close = sum(_apart(r[low:high, None], q[None, one:two], n, far) ** 2 for (r, q, n), far in zip(at, images)) < reach**2
        found = np.flatnonzero(close)
        if len(found):
            i = np.repeat(np.arange(low, high), np.count_nonzero(close, axis=1))
            places.append((i, found + (one - (i - low) * (two - one))))
            count += len(found)
        low = high
        if count and (count > batch or low >= rows):
            i, j = (np.concatenate(v) for v in zip(*places)) if len(places) > 1 else places[0]
            apart = [_apart(r[i], q[j], n, far) for (r, q, n), far in zip(at, images)]
            rr = apart[0] * apart[0]
            for d in apart[1:]:
                rr += d * d
            kept = rr < reach**2
            if not kept.all():
                i, j, rr, *apart = (v[kept] for v in (i, j, rr, *apart))
            if len(i):
                yield i, j, [rr, *apart]
            places, count = [], 0


def _apart(r: np.ndarray, q: np.ndarray, n: float, far: bool) -> np.ndarray:
    d = r - q
    return d - n * ((d > n / 2).astype(float) - (d < -n / 2)) if far else d


def tiles(left: DataFrame, right: DataFrame, on: list[str], keys: list[str], box: Box, reach: float, work: Callable[[pa.Table, pa.Table, Iterator[Near]], Iterator[list[pa.Array]]],
          schema: T.StructType, batch: int = BATCH, together: bool = False) -> DataFrame:
    """What ``work`` makes of the rows of both sides that agree in ``on`` (a tile) and of their pairs closer than ``reach``: columns
    of ``schema`` behind ``keys``. Where ``left`` has a column ``_home``, pairs met from both ends come once. ``together``: tiles of near cells
    are in one part, for each pair of blocks, so that what is summed by row is summed there first."""
    axes, lengths = list(box.axes), list(box.lengths)
    left, right = left.dropna(subset=[*on, *axes]), right.dropna(subset=[*on, *axes])
    one, two = (s.select(*on, F.struct(*[c for c in s.columns if c not in on]).alias(n)) for s, n in ((left, "_l"), (right, "_r")))

    def once(a: pa.Table, b: pa.Table, pairs: Iterator[Near]) -> Iterator[Near]:
        home = a["_home"].to_numpy()
        if home.any():
            (ours, theirs), whole = ranks(a["id"], b["id"]), home.all()
            for i, j, values in pairs:
                kept = ours[i] < theirs[j]
                kept = np.flatnonzero(kept if whole else kept | ~home[i])
                if len(kept):
                    yield i[kept], j[kept], [v[kept] for v in values]
        else:
            yield from pairs

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sides = pa.Table.from_batches(list(batches)), []
        for name in ("_l", "_r"):
            column = rows[name].combine_chunks()
            sides.append(pa.Table.from_struct_array(column.filter(column.is_valid())))
        if not sides[0].num_rows or not sides[1].num_rows:
            return
        a, b, along = _sorted(*sides, axes, lengths, reach)
        pairs = _near(a, b, box, reach, along, batch)
        for columns in work(a, b, once(a, b, pairs) if "_home" in a.column_names else pairs):
            yield pa.RecordBatch.from_arrays([*[pa.repeat(rows[k][0], len(columns[0])) for k in keys], *columns], names=schema.names)

    whole, by = one.unionByName(two, allowMissingColumns=True), on
    if together:
        by = [*keys, "_u", "_v", *["_g" + x for x in axes]]
        whole = whole.withColumns({"_g" + x: F.floor(F.col("c" + x) / 2).cast("int") for x in axes})
        on = [*on, *["_g" + x for x in axes]]
    # a number of its own: few bytes are much work here, so parts must not be put together by their size
    spark = whole.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return whole.repartition(parts, *by).groupBy(*on).applyInArrow(met, schema)


def _fields(side: DataFrame, names: list[str], end: str = "") -> list[T.StructField]:
    return [T.StructField(c + end, side.schema[c].dataType) for c in names]


def _meet(left: DataFrame, right: DataFrame, on: list[str], keys: list[str], box: Box, reach: float, lean: bool) -> DataFrame:
    """Pairs of rows of both sides that agree in ``on`` and are closer than ``reach``, with their distances. ``lean``: of the rows only their ids."""
    if lean:
        left, right = (s.select(*on, *[c for c in s.columns if c in ("id", "_home", *box.axes)]) for s in (left, right))
    ours, theirs = ([c for c in s.columns if c not in on and c != "_home" and not (lean and c in box.axes)] for s in (left, right))
    values = ["rr", *([] if lean else ["d" + a for a in box.axes])]
    schema = T.StructType([*_fields(left, keys), *_fields(left, ours, "_i"), *_fields(right, theirs, "_j"), *[T.StructField(n, T.DoubleType()) for n in values]])

    def rows(a: pa.Table, b: pa.Table, pairs: Iterator[Near]) -> Iterator[list[pa.Array]]:
        for i, j, found in pairs:
            mine, others = a.select(ours).take(pa.array(i)), b.select(theirs).take(pa.array(j))
            yield [*[c.combine_chunks() for c in [*mine.columns, *others.columns]], *[pa.array(v) for v in found[: len(values)]]]

    return tiles(left, right, on, keys, box, reach, rows, schema)


def _cell_join(left: DataFrame, right: DataFrame, box: Box, reach: float, keys: list[str], same: bool, cutoff: float, binned: str = "", lean: bool = False) -> DataFrame:
    """Pairs of rows in near cells, ``reach`` wide, that are closer than ``cutoff``, with their distances."""
    left, right, on = dealt(left, right, box, reach, keys, same, binned)
    met = _meet(left, right, on, keys, box, cutoff, lean)
    if not same:
        return met
    # a pair of two cells comes once, in either order; make it the order of ids
    names, turned = [c[:-2] for c in met.columns if c.endswith("_i")], F.col("id_i") > F.col("id_j")
    ends = [F.when(turned, F.col(f"{c}_{b}")).otherwise(F.col(f"{c}_{a}")).alias(f"{c}_{a}") for a, b in ("ij", "ji") for c in names]
    apart = [] if lean else [F.when(turned, -F.col("d" + a)).otherwise(F.col("d" + a)).alias("d" + a) for a in box.axes]
    return met.select(*keys, *ends, *apart, "rr")


def _blocks(rows: DataFrame, keys: list[str]) -> int:
    """How many blocks of ``TILE_ROWS`` rows the largest step has."""
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] if keys else rows.count()
    return -(-(most or 0) // min(TILE_ROWS, PLAIN_TILE_ROWS)) or 1


def all_pairs(particles: DataFrame, box: Box, others: DataFrame | None = None) -> DataFrame:
    """Every pair of a step, without a cutoff, which is quadratic. Ids are dealt
    into blocks, and an equi-join forms each tile of two blocks by itself."""
    keys = ["step"] if "step" in particles.columns else []
    if others is None:  # blocks are ranges of ids, so that tiles above the diagonal have i < j
        n = _blocks(particles, keys)
        bounds = sorted(set(particles.approxQuantile("id", [k / n for k in range(1, n)], 1 / (4 * n)))) if n > 1 else []
        block = F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b <= F.col("id"))) if bounds else F.lit(0)
        left, right = particles.withColumn("_bi", block), particles.withColumn("_bj", block)
        left = left.withColumn("_bj", F.explode(F.sequence(F.col("_bi"), F.lit(len(bounds)))))
        right = right.withColumn("_bi", F.explode(F.sequence(F.lit(0), F.col("_bj"))))
    else:
        n, m = _blocks(particles, keys), _blocks(others, keys)
        left = particles.withColumn("_bi", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("_bj", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        right = others.withColumn("_bj", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")).withColumn("_bi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    tile = [*keys, "_bi", "_bj"]
    met = _sides(left, "i", tile).join(_sides(right, "j", tile), tile).drop("_bi", "_bj")
    if others is None:
        met = met.where(F.col("id_i") < F.col("id_j"))
    return _ordered(_distances(met, box), keys, others is None)


def _ordered(pairs: DataFrame, keys: list[str], same: bool) -> DataFrame:
    return pairs.withColumnRenamed("id_i", "i").withColumnRenamed("id_j", "j")


def neighbours(particles: DataFrame, box: Box, cutoff: float, skin: float = 0.0, others: DataFrame | None = None,
               params: DataFrame | None = None, lean: bool = False, binned: str = "") -> DataFrame:
    """Pairs (i, j, columns of both as ``_i`` and ``_j``, dx.., rr) with a
    distance below ``cutoff + skin``; each once in a self-join, all ordered pairs
    between two tables. ``params`` (a, b, r_cut, ...) sets the cutoff per species
    pair, up to ``cutoff``, and joins its columns. ``lean``: only i, j and rr, for those who need no more. ``binned``: rows lie in the
    cells of their positions with this prefix, of some time before, and pairs are those below ``cutoff`` alone."""
    keys = ["step"] if "step" in particles.columns else []
    reach, same = cutoff + skin, others is None
    pairs = _ordered(_cell_join(particles, particles if same else others, box, reach, keys, same, cutoff if binned else reach, binned, lean), keys, same)
    if params is not None:  # one row per species pair; Spark broadcasts the table if it is small
        pairs = pairs.join(params, (F.col("species_i") == F.col("a")) & (F.col("species_j") == F.col("b"))).drop("a", "b")
        return pairs.where(F.col("rr") < square(F.col("r_cut") + skin))
    return pairs


def near_tiles(particles: DataFrame, box: Box, reach: float, work: Callable[[pa.Table, pa.Table, Iterator[Near]], Iterator[list[pa.Array]]],
               schema: T.StructType, others: DataFrame | None = None, batch: int = BATCH) -> DataFrame:
    """What ``work`` makes of each tile of near rows and its pairs closer than ``reach``, where each pair of :func:`neighbours` comes in one tile, either way round."""
    keys = ["step"] if "step" in particles.columns else []
    left, right, on = dealt(particles, particles if others is None else others, box, reach, keys, others is None)
    return tiles(left, right, on, keys, box, reach, work, schema, batch, together=True)


def followed(rows: DataFrame, box: Box, cutoff: float, skin: float, lean: bool = False) -> DataFrame:
    """Pairs closer than ``cutoff`` at the positions x.. of rows that are still in the cells, ``cutoff + skin`` wide, of their
    positions ``_x``.. of some time before; right as long as :func:`max_displacement` is at most half the skin. Pairs aren't
    stored: what is shuffled grows with the rows."""
    return neighbours(rows, box, cutoff, skin, lean=lean, binned="_")


def within(pairs: DataFrame, now: DataFrame, box: Box, cutoff: float) -> DataFrame:
    """Re-filter stored pairs (i, j), made with a skin, by the positions ``now``;
    right as long as :func:`max_displacement` is at most half the skin."""
    def side(s: str) -> DataFrame:
        return now.select(F.col("id").alias(s), *[F.col(a).alias(f"{a}_{s}") for a in box.axes])

    met = pairs.select("i", "j").join(side("i"), "i").join(side("j"), "j")
    return _distances(met, box).where(F.col("rr") < cutoff**2)


def rebuild_steps(series: DataFrame, box: Box, skin: float, look: int = 16) -> list[int]:
    """The steps of a trajectory (step, id, x..) at which a neighbour table made with this skin has to be made anew:
    the first one, then each first step at which a particle has moved more than half the skin since the last
    of them (or is new). Steps are looked at in stretches that begin with the length of the last epoch and double:
    jobs grow with the number of epochs, and only a step number reaches the driver from each."""
    first, last = series.agg(F.min("step"), F.max("step")).first()
    if first is None:
        return []
    out = [first]
    while True:
        ref = series.where(F.col("step") == out[-1]).select("id", *[F.col(a).alias("_" + a) for a in box.axes])
        moved = total([square(minimum_image(F.col(a) - F.col("_" + a), n)) for a, n in zip(box.axes, box.lengths)])
        low, high, hit = out[-1], out[-1] + look, None
        while hit is None and low < last:
            part = series.where((F.col("step") > low) & (F.col("step") <= high)).join(ref, "id", "left")
            hit = part.where(F.coalesce(moved > (skin / 2) ** 2, F.lit(True))).agg(F.min("step")).first()[0]
            low, high = high, high + 2 * (high - out[-1])
        if hit is None:
            return out
        look = max(hit - out[-1], 1)
        out.append(hit)


def neighbour_series(series: DataFrame, box: Box, cutoff: float, skin: float, lean: bool = False) -> DataFrame:
    """(step, i, j, dx.., rr) of all pairs below the cutoff at every step of a trajectory. Rows are put into cells only by their positions at
    the steps of :func:`rebuild_steps` and meet in these, all in one join, at each step until the next of them. ``series`` should be a written table, as it is read several times."""
    spark, keys = series.sparkSession, ["step", "_made"]
    made = spark.createDataFrame([(int(s), int(s)) for s in rebuild_steps(series, box, skin)], "step long, _made long")
    # one row a step: each belongs to the last table made before it
    steps = series.select(F.col("step").cast("bigint").alias("step")).distinct().join(made, "step", "left").select("step", F.last("_made", True).over(Window.orderBy("step")).alias("_made"))
    rows = written(series.select("step", "id", *box.axes).join(steps, "step").select("step", "_made", "id", *box.axes))
    at_made = rows.where(F.col("step") == F.col("_made")).select("_made", "id", *[F.col(a).alias("_" + a) for a in box.axes])
    pairs = followed(rows.join(at_made, ["_made", "id"]).drop("_made"), box, cutoff, skin, lean)
    return pairs.select("step", "i", "j", *([] if lean else ["d" + a for a in box.axes]), "rr")


def max_displacement(before: DataFrame, now: DataFrame, box: Box) -> DataFrame:
    """One row: the largest distance that a particle moved."""
    old = before.select("id", *[F.col(a).alias("_" + a) for a in box.axes])
    moved = total([square(minimum_image(F.col(a) - F.col("_" + a), n)) for a, n in zip(box.axes, box.lengths)])
    return now.join(old, "id").agg(F.max(F.sqrt(moved)).alias("max_displacement"))


def excluded_volume(spheres: DataFrame, placed: DataFrame, box: Box, largest: float) -> DataFrame:
    """The rows of ``spheres`` (id, x.., diameter) that overlap none of
    ``placed``: an anti-join by cells. ``largest``: the largest diameter of both."""
    hits = neighbours(spheres, box, largest, others=placed).where(F.col("rr") < square((F.col("diameter_i") + F.col("diameter_j")) / 2))
    return spheres.join(hits.select(F.col("i").alias("id")).distinct(), "id", "left_anti")


def placed_in_order(spheres: DataFrame, box: Box, most_rounds: int = 10_000) -> DataFrame:
    """The rows of ``spheres`` (id, x.., diameter) that find room when they are placed one after the other by
    id: a sphere is placed unless it overlaps an earlier one that was placed.

    The box is cut into fine cells whose diagonal is below the smallest diameter, so that all
    spheres of a fine cell overlap and at most one of them is placed. In a round each fine cell
    offers its first undecided sphere; it is placed if it overlaps no earlier undecided one, and all that
    overlap it are out. The first undecided sphere of all is placed in every round; with ids in no
    spatial order about log(n) rounds do, while ids that run along a line of overlaps take as many
    rounds as the line is long.

    A round is minima over cells and one cell join of the offers, of which no cell of a diameter's width
    has more than it has fine cells, with the undecided rows: its work grows with the rows, however many of them
    lie in one place. Ids are distinct; rows with a null position or diameter are not
    placed; diameters must be positive."""
    axes, cells = list(box.axes), ["f" + a for a in box.axes]
    known = spheres.dropna(subset=["id", "diameter", *axes])
    least, most = known.agg(F.min("diameter"), F.max("diameter")).first()
    if least is None:
        return known
    if least <= 0:
        raise ValueError("diameters must be positive")
    counts = [floor(n * sqrt(box.dimension) / least) + 1 for n in box.lengths]
    slim = known.select("id", *axes, "diameter").withColumns({c: cell_index(F.col(a), n, k) for c, a, n, k in zip(cells, axes, box.lengths, counts)})
    undecided, placed = written(slim), []
    for _ in range(most_rounds):
        offers = written(undecided.groupBy(*cells).agg(F.min_by(F.struct("id", *axes, "diameter"), "id").alias("s")).select(*cells, "s.*"))
        if offers.isEmpty():
            break
        met = neighbours(offers.select("id", *axes, "diameter"), box, most, others=undecided)
        met = written(met.where((F.col("i") != F.col("j")) & (F.col("rr") < square((F.col("diameter_i") + F.col("diameter_j")) / 2))).select("i", "j"))
        waits = met.where("j < i").select(F.col("i").alias("id")).distinct()
        now = written(offers.select("id").join(waits, "id", "left_anti"))
        placed.append(now)
        out = met.join(now.select(F.col("id").alias("i")), "i").select(F.col("j").alias("id")).union(now).distinct()
        undecided = written(undecided.join(out, "id", "left_anti"))
    else:
        raise RuntimeError(f"spheres were left after {most_rounds} rounds")
    chosen = placed[0] if placed else undecided.select("id")
    for p in placed[1:]:
        chosen = chosen.union(p)
    return known.join(chosen, "id", "left_semi")
