"""Forces, energies and stress per particle from pairs and external fields."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moraine.functions.box import Box, wrap_shift
from moraine.functions.potentials import Potential, Spring, on_arrays, valued
from moraine.functions.vectors import stress_outer
from moraine.operators import neighbours, springs

MOST_PARAMETERS = 100_000  # rows of a table of species pairs that each task holds
MOST_SPECIES = 2_000
PAIRS = 1 << 14  # valued at once


def stress_names(axes: Sequence[str]) -> list[str]:
    return ["s" + a + a for a in axes] + ["s" + axes[i] + axes[j] for i in range(len(axes)) for j in range(i + 1, len(axes))]


def pair_forces(pairs: DataFrame, box: Box, potential: Callable[[Column], tuple[Column, Column]], aux_weight: float = 1.0,
                both: bool = True) -> DataFrame:
    """Per particle (id): force, en_pot and potential stress. Each pair counts
    for both partners (``both``, a self-join), each with half of the energy and
    stress; else for i alone with ``aux_weight`` times all of it."""
    keys = ["step"] if "step" in pairs.columns else []
    fval, energy = valued(potential, F.col("rr"))
    found = pairs.select(*keys, "i", "j", *[F.col("d" + a) for a in box.axes], fval.alias("fval"), energy.alias("energy"))
    weight = aux_weight / 2 if both else aux_weight
    stress = [weight * F.col("fval") * s for s in stress_outer([F.col("d" + a) for a in box.axes])]
    names = stress_names(box.axes)
    shared = [(weight * F.col("energy")).alias("en_pot"), *[s.alias(n) for s, n in zip(stress, names)]]

    def side(key: str, sign: int) -> Column:
        return F.struct(F.col(key).alias("id"), *[(sign * F.col("fval") * F.col("d" + a)).alias("f" + a) for a in box.axes])

    ends = F.array(side("i", 1), side("j", -1)) if both else F.array(side("i", 1))
    rows = found.select(*keys, *shared, F.explode(ends).alias("end")).select(*keys, "end.*", "en_pot", *names)
    return sum_forces(rows, box)


class SpeciesPairs:
    """A table of species pairs, or constants for all of them, as arrays by the numbers of two species."""

    def __init__(self, columns: dict[str, np.ndarray], ends: tuple[list, list] | None):
        self.columns, self.species, self.alike = columns, [], {n: (v == v[0]).all() for n, v in columns.items()}
        if ends is not None:
            self.species = sorted({*ends[0], *ends[1]})
            code, size = {s: k for k, s in enumerate(self.species)}, len(self.species) + 1  # the last one: none of these
            at = np.full((size, size), -1)
            at[[code[s] for s in ends[0]], [code[s] for s in ends[1]]] = np.arange(len(ends[0]))
            turned = at.T
            self.even = bool(((at < 0) == (turned < 0)).all() and all((v[at] == v[turned])[at >= 0].all() for v in columns.values()))
            at = at.ravel()
            self.size, self.columns = size, {n: v[at] for n, v in columns.items()}
            self.cut = np.where(at < 0, -1.0, self.columns["r_cut"] ** 2)

    @classmethod
    def of(cls, params: DataFrame | dict[str, float] | None, species: T.DataType | None) -> SpeciesPairs | None:
        """None where these can't be arrays: too many rows, several of one pair, nulls, or other types than the usual ones."""
        if not isinstance(params, DataFrame):
            return cls({k: np.array([float(v)]) for k, v in (params or {}).items()}, None)
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        kinds = {f.name: f.dataType for f in params.schema}
        if not isinstance(species, whole) or not all(isinstance(t, whole if n in ("a", "b") else T.DoubleType) for n, t in kinds.items()):
            return None
        rows = params.limit(MOST_PARAMETERS + 1).collect()
        ends = [r["a"] for r in rows], [r["b"] for r in rows]
        if not rows or len(rows) > MOST_PARAMETERS or len({*ends[0], *ends[1]}) > MOST_SPECIES or len(set(zip(*ends))) < len(rows) or any(x is None for r in rows for x in r):
            return None
        return cls({n: np.array([r[n] for r in rows]) for n in kinds if n not in ("a", "b")}, ends)

    def codes(self, side: pa.Table) -> np.ndarray:
        """The numbers of the species of rows."""
        found = pc.index_in(side["species"].cast(pa.int64()), pa.array(self.species, pa.int64()))
        return found.fill_null(self.size - 1).to_numpy().astype(np.int32)

    def value(self, name: str, places: np.ndarray | None) -> np.ndarray | float:
        values = self.columns[name]
        return float(values[0]) if places is None or self.alike[name] else values[places]


def _valued(potential: Potential, rr: np.ndarray, known: SpeciesPairs, rows: np.ndarray | None, ansi: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Force values and energies, and whether some of them are null (masked), which those divided by zero are; in ANSI mode that is an error."""
    divided: list = []
    with np.errstate(all="ignore", divide="call", invalid="call", call=lambda *_: divided.append(1)):
        fval, energy = potential(rr, lambda name: known.value(name, rows))
    if divided:
        with np.errstate(all="ignore"):
            fval, energy = potential(np.ma.array(rr), lambda name: known.value(name, rows))
        if np.ma.is_masked(fval) or np.ma.is_masked(energy):
            if ansi:
                raise ZeroDivisionError("a pair's distance is one at which the potential divides by zero")
            fval, energy = (np.ma.array(np.broadcast_to(np.ma.getdata(v), rr.shape), mask=np.broadcast_to(np.ma.getmaskarray(v), rr.shape)) for v in (fval, energy))
            return fval, energy, True
        fval, energy = np.ma.getdata(fval), np.ma.getdata(energy)
    return np.broadcast_to(fval, rr.shape), np.broadcast_to(energy, rr.shape), False


class _Sums:
    """Sums of contributions to the rows of one side of a tile."""

    def __init__(self, rows: int, forces: int, others: int):
        self.values, self.forces = np.zeros((forces + others, rows)), forces
        self.met, self.told = np.zeros(rows, bool), None

    def add(self, at: np.ndarray, columns: Iterator[np.ndarray], ascending: bool, sign: float, null: tuple[np.ndarray, np.ndarray] | None) -> None:
        if null is not None and self.told is None:
            self.told = np.stack([self.met, self.met])
        starts = np.flatnonzero(np.diff(at, prepend=-1)) if ascending else None
        for k, v in enumerate(columns):
            if ascending:
                self.values[k, at[starts]] += np.add.reduceat(v, starts)
            else:
                added = np.bincount(at, v, self.values.shape[1])
                self.values[k] += sign * added if k < self.forces else added
        self.met[at] = True
        if self.told is not None:
            for told, gone in zip(self.told, null or (None, None)):
                told[at if gone is None else at[~gone]] = True

    def columns(self, ids: pa.ChunkedArray) -> list[pa.Array]:
        """Of rows that a pair has met: a sum is null where all of its terms are."""
        met = np.flatnonzero(self.met)
        out = [ids.take(pa.array(met)).combine_chunks()]
        for k, v in enumerate(self.values):
            energy = k == self.forces
            out.append(pa.array(v[met], mask=None if self.told is None else ~self.told[int(energy)][met]))
        return out


def near_forces(particles: DataFrame, box: Box, cutoff: float, potential: Potential, params: DataFrame | dict[str, float] | None = None,
                others: DataFrame | None = None, aux_weight: float = 1.0) -> DataFrame:
    """:func:`pair_forces` of all pairs closer than ``cutoff``, of one table or of its rows with ``others``, but a pair is no row: its contributions are
    added up where it is found, and what is shuffled are rows and sums of rows. ``params``: a table of species pairs, with r_cut, as
    :func:`neighbours.neighbours` takes it, or constants for all pairs. A potential without values for arrays gets pairs as rows."""
    keys, same = ["step"] if "step" in particles.columns else [], others is None
    table = isinstance(params, DataFrame)
    columns = [*keys, "id", *(["species"] if table else []), *box.axes]
    particles, others = particles.select(columns), None if same else others.select(columns)
    species = [s.schema["species"].dataType for s in (particles, others) if table and s is not None]
    known = SpeciesPairs.of(params, species[0] if len({*species}) == 1 else None) if on_arrays(potential) else None
    if known is None:
        pairs = neighbours.neighbours(particles, box, cutoff, others=others, params=params if table else None)
        pairs = pairs.withColumns({k: F.lit(float(v)) for k, v in params.items()}) if params and not table else pairs
        return pair_forces(pairs, box, potential, aux_weight, same)
    axes, names = box.axes, stress_names(box.axes)
    weight = aux_weight / 2 if same else aux_weight
    ansi = particles.sparkSession.conf.get("spark.sql.ansi.enabled") == "true"
    schema = T.StructType([*[particles.schema[k] for k in (*keys, "id")], *[T.StructField(n, T.DoubleType()) for n in (*["f" + a for a in axes], "en_pot", *names)]])

    def added(a: pa.Table, b: pa.Table, pairs: Iterator[neighbours.Near]) -> Iterator[list[pa.Array]]:
        sums = [_Sums(t.num_rows, len(axes), 1 + len(names)) for t in (a, b)]
        ends = [known.codes(t) for t in (a, b)] if table else None
        ours = [e * known.size for e in ends] if table else None
        turned = neighbours.ranks(a["id"], b["id"]) if table and same and not known.even else None
        for i, j, (rr, *apart) in pairs:
            rows = None
            if table:
                rows = ours[0][i] + ends[1][j]
                if turned is not None:  # a pair is that of the smaller id with the larger one
                    rows = np.where(turned[0][i] > turned[1][j], ours[1][j] + ends[0][i], rows)
                kept = np.flatnonzero(rr < known.cut[rows])
                if not len(kept):
                    continue
                i, j, rr, rows, apart = i[kept], j[kept], rr[kept], rows[kept], [d[kept] for d in apart]
            fval, energy, some = _valued(potential, rr, known, rows, ansi)
            null = (np.ma.getmaskarray(fval), np.ma.getmaskarray(energy)) if some else None
            if some:
                fval, energy = fval.filled(0.0), energy.filled(0.0)
            share = weight * fval
            values = [*[fval * d for d in apart], weight * energy, *[share * s for s in stress_outer(apart)]]
            sums[0].add(i, values, True, 1.0, null)
            if same:
                sums[1].add(j, values, False, -1.0, null)
        for side, t in zip(sums[: 1 + same], (a, b)):
            if side.met.any():
                yield side.columns(t["id"])

    return sum_forces(neighbours.near_tiles(particles, box, cutoff, added, schema, others, PAIRS), box)


def full_forces(particles: DataFrame, box: Box, potential: Callable[[Column], tuple[Column, Column]]) -> DataFrame:
    """Per particle (id): force and en_pot of all pairs of a step, without a cutoff. Of springs these are sums over
    sorted ranges; any other potential, whose parameters are constants, takes every pair, which is quadratic."""
    keys = ["step"] if "step" in particles.columns else []
    if isinstance(potential, Spring):
        return springs.spring_forces(particles, box, potential.stiffness)
    pairs = neighbours.all_pairs(particles.select(*keys, "id", *box.axes), box)
    return pair_forces(pairs, box, potential).select(*keys, "id", *["f" + a for a in box.axes], "en_pot")


def external_forces(particles: DataFrame, box: Box, field: Callable[[list[Column]], tuple[list[Column], Column]],
                    wrapped: bool = True) -> DataFrame:
    """Per particle: force and energy of a field at the wrapped position, or, for a field
    that isn't periodic (``wrapped=False``), at the position as it is; an external field has no stress."""
    keys = ["step"] if "step" in particles.columns else []
    force, energy = field([F.col(a) - n * wrap_shift(F.col(a), n) if wrapped else F.col(a) for a, n in zip(box.axes, box.lengths)])
    return particles.select(*keys, "id", *[f.alias("f" + a) for f, a in zip(force, box.axes)], energy.alias("en_pot"), *[F.lit(0.0).alias(n) for n in stress_names(box.axes)])


def sum_forces(rows: DataFrame, box: Box) -> DataFrame:
    """Add up the contributions of a particle."""
    keys = ["step"] if "step" in rows.columns else []
    names = ["f" + a for a in box.axes] + ["en_pot", *stress_names(box.axes)]
    return rows.groupBy(*keys, "id").agg(*[F.sum(n).alias(n) for n in names])


def add_forces(*parts: DataFrame, box: Box) -> DataFrame:
    """Several force terms on one table of particles."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return sum_forces(out, box)


def with_forces(particles: DataFrame, forces: DataFrame, box: Box) -> DataFrame:
    """Particles with their forces; none means zero."""
    keys = (["step"] if "step" in particles.columns else []) + ["id"]
    names = [c for c in forces.columns if c not in keys]
    return particles.join(forces, keys, "left").fillna(0.0, subset=names)
