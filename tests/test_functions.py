"""Boxes, vectors, potentials and curve codes against closed forms."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.functions import potentials as pot
from moraine.functions import vectors as vec
from moraine.functions.box import Box, extend_periodic, reduce_periodic
from moraine.functions.hilbert import curve_codes, curve_intervals, with_hilbert_code


def test_wrapping(spark):
    box = Box((2.0, 4.0))
    rows = [(0, 1.0, -2.0), (1, 1.5, 2.5), (2, -1.5, -2.5), (3, 7.3, -13.1), (4, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "id long, x double, y double")
    once = {r["id"]: r for r in reduce_periodic(p, box).collect()}
    assert (once[0]["x"], once[0]["ix"], once[0]["y"], once[0]["iy"]) == (1.0, 0, -2.0, 0)
    assert (once[1]["x"], once[1]["ix"], once[2]["y"], once[2]["iy"]) == (-0.5, 1, 1.5, -1) and once[3]["ix"] == 1
    full = reduce_periodic(p, box, until_inside=True)
    assert all(abs(r["x"]) <= 1 and abs(r["y"]) <= 2 for r in full.collect())
    back = {r["id"]: r for r in extend_periodic(full, box).collect()}
    assert all(abs(back[i]["x"] - x) < 1e-12 and abs(back[i]["y"] - y) < 1e-12 for i, x, y in rows)
    with pytest.raises(ValueError):
        Box((1.0, -1.0))


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(-4.0), F.lit(2.5)), F.array(F.lit(2.0), F.lit(3.0), F.lit(0.0))
    m = F.array(a, b, a)
    checks = {
        "sum": (vec.vector_sum(a), -0.5), "prod": (vec.vector_prod(a), -10.0), "dot": (vec.inner_prod(a, b), -10.0), "n1": (vec.norm_1(a), 7.5), "ninf": (vec.norm_inf(a), 4.0),
        "at": (vec.index_norm_inf(a), 1), "div": (vec.element_div(a, b), [0.5, -4 / 3, None]), "mod": (vec.element_mod(b, F.array(F.lit(3.0), F.lit(2.0), F.lit(1.0))), [2.0, 1.0, 0.0]),
        "round": (vec.vector_round(a), [1.0, -4.0, 3.0]), "floor": (vec.vector_floor(a), [1.0, -4.0, 2.0]), "ceil": (vec.vector_ceil(a), [1.0, -4.0, 3.0]), "trace": (vec.trace(m), 1.0 + 3.0 + 2.5),
        "t": (vec.transpose(m)[1], [-4.0, 3.0, -4.0]), "find": (vec.find_component(a, 2.5), 3), "none": (vec.find_component(a, 9.0), None), "p5": (vec.integer_power(F.lit(3.0), 5), 243.0), "p0": (vec.integer_power(F.lit(3.0), 0), 1.0),
        "max": (vec.element_max(a, b), [2.0, 3.0, 2.5]), "add": (vec.subtract(vec.add(a, b), b), [1.0, -4.0, 2.5]), "scaled": (vec.divide_scalar(vec.multiply_scalar(a, 4), 2), [2.0, -8.0, 5.0]),
        "matrix": (vec.scalar_matrix(2, 2, 7), [[7.0, 7.0], [7.0, 7.0]]), "moved": (vec.subtract_scalar(vec.add_scalar(a, 2), 1), [2.0, -3.0, 3.5]), "coprime": (vec.coprime(F.lit(6), F.lit(10), F.lit(15)), True), "not": (vec.coprime(F.lit(6), F.lit(9)), False),
    }
    row = spark.range(1).select(*[c.alias(n) for n, (c, _) in checks.items()]).first()
    for n, (_, want) in checks.items():
        assert row[n] == (pytest.approx(want) if isinstance(want, float) else want), n


def evaluate(spark, potential, params: dict, distances):
    table = spark.createDataFrame([(r, *map(float, params.values())) for r in distances], "r double, " + ", ".join(f"{k} double" for k in params))
    if isinstance(potential, pot.Truncated):
        table = potential.prepare(table)
    fval, u = potential(F.col("r") * F.col("r"))
    return [(x["f"], x["u"]) for x in table.select("r", fval.alias("f"), u.alias("u")).orderBy("r").collect()]


#: Fixed values: (r, fval, energy) of published closed forms.
LJ_AA = [(0.5, 780288.0, 16128.0), (1.0, 24.0, 0.0), (2.0, -0.0908203125, -0.0615234375)]
LJ_AB = [(1.0, 97536.0, 8064.0), (2.0, 3.0, 0.0)]
MORSE_AA = [(0.25, 0.0, -0.9540005656159722), (0.5, -0.6507845119203753, -0.9069122207759784), (1.0, -0.4423441678610893, -0.6983391318532663), (2.0, -0.1335362022766309, -0.3377631169819678)]


def test_golden_values(spark):
    for rows, p in ((LJ_AA, {"epsilon": 1, "sigma": 1}), (LJ_AB, {"epsilon": 0.5, "sigma": 2})):
        got = evaluate(spark, pot.lennard_jones, p, [r[0] for r in rows])
        assert got == [pytest.approx(r[1:], rel=1e-14, abs=1e-14) for r in rows]
    p = {"epsilon": 1, "sigma": 1, "r_min": 0.25, "distortion": 1.41, "r_cut": 5}
    got = evaluate(spark, pot.Truncated(pot.morse, "shifted"), p, [r[0] for r in MORSE_AA])
    assert got == [pytest.approx(r[1:], rel=1e-12, abs=1e-14) for r in MORSE_AA]
    simple, full = (evaluate(spark, f, {"epsilon": 1, "sigma": 1}, [0.9, 1.7]) for f in (pot.lennard_jones_simple, pot.lennard_jones))
    assert simple == [pytest.approx(x, rel=1e-14) for x in full]
    assert evaluate(spark, pot.mie(12, 6), {"epsilon": 2, "sigma": 1.1}, [0.9, 1.7]) == [pytest.approx(x, rel=1e-12) for x in evaluate(spark, pot.lennard_jones, {"epsilon": 2, "sigma": 1.1}, [0.9, 1.7])]


@pytest.mark.parametrize("kind", pot.TRUNCATIONS)
@pytest.mark.parametrize("potential", [pot.lennard_jones, pot.mie(10, 4), pot.morse, pot.power_law(6), pot.power_law(7), pot.power_law_hard_core(6), pot.hard_core(pot.morse)])
def test_forces_are_derivatives(spark, potential, kind):
    p = {"epsilon": 1.3, "sigma": 0.9, "r_min": 1.1, "distortion": 1.2, "r_core": 0.1, "r_cut": 2.5}
    h, places = 1e-5, [0.9, 1.3, 2.0, 2.4]
    cut = pot.Truncated(potential, kind, 0.3)
    at = evaluate(spark, cut, p, places)
    low, high = (evaluate(spark, cut, p, [r + s * h for r in places]) for s in (-1, 1))
    for r, (f, _), (_, a), (_, b) in zip(places, at, low, high):
        assert -(b - a) / (2 * h) / r == pytest.approx(f, rel=1e-5, abs=1e-7)
    end = evaluate(spark, cut, p, [2.5])[0]
    assert kind == "sharp" or abs(end[1]) < 1e-12
    assert kind not in ("force_shifted", "smooth_r4") or abs(end[0]) < 1e-12


def test_walls_and_traps(spark):
    walls = [pot.Wall((0.0, 2.0), -1.0, 1.0, 0.4, 1.5, 1.2)]
    h, rows = 1e-6, []
    for y in (-0.8, -0.3, 0.1, 0.5, -1.6):
        for s in (-1, 0, 1):
            rows.append((y, s, 0.0, y + s * h))
    force, energy = pot.planar_walls([F.col("x"), F.col("y")], walls, 0.2)
    got = {(r["y0"], r["s"]): r for r in spark.createDataFrame(rows, "y0 double, s int, x double, y double").select("y0", "s", force[1].alias("f"), energy.alias("u")).collect()}
    for y in (-0.8, -0.3, 0.1, -1.6):
        assert -(got[y, 1]["u"] - got[y, -1]["u"]) / (2 * h) == pytest.approx(got[y, 0]["f"], rel=1e-4, abs=1e-6)
    assert got[0.5, 0]["u"] == 0
    f, u = pot.harmonic([F.lit(1.0), F.lit(2.0)], (0.0, 1.0), 3.0)
    row = spark.range(1).select(f[0].alias("a"), f[1].alias("b"), u.alias("u")).first()
    assert (row["a"], row["b"], row["u"]) == (-3.0, -3.0, 3.0)


@pytest.mark.parametrize("d, depth", [(2, 4), (3, 3)])
def test_curve_is_continuous(d, depth):
    grid = np.stack(np.meshgrid(*[np.arange(1 << depth)] * d, indexing="ij"), -1).reshape(-1, d)
    codes = np.array([curve_codes(c, depth) for c in grid.tolist()])
    assert sorted(codes.tolist()) == list(range(1 << depth * d))
    line = grid[np.argsort(codes)]
    assert (np.abs(np.diff(line, axis=0)).sum(1) == 1).all()


def test_codes_of_positions(spark):
    box = Box((2.0, 2.0))
    p = spark.createDataFrame([(-0.99, -0.99), (0.99, 0.99), (1.01, 1.01)], "x double, y double")
    codes = [r["hilbert"] for r in with_hilbert_code(p, box, 3).collect()]
    assert codes[2] == codes[0] and 0 <= min(codes) and max(codes) < 64
    with pytest.raises(ValueError):
        with_hilbert_code(p, box, 17)


@pytest.mark.parametrize("lengths, depth", [((1.0, 1.0), 6), ((1.0, 2.0, 3.0), 4)])
def test_columns_prefixes_and_intervals_of_the_curve(spark, lengths, depth):
    box, g = Box(lengths), np.random.default_rng(1)
    points = (g.uniform(-0.5, 0.5, (400, len(lengths))) * lengths).tolist()
    rows = spark.createDataFrame(points, ", ".join(f"{a} double" for a in box.axes))
    got = with_hilbert_code(rows, box, depth).collect()
    for r in got:
        cell = [int((r[a] / n + 0.5) * (1 << depth)) for a, n in zip(box.axes, lengths)]
        assert r["hilbert"] == curve_codes(cell, depth)
        assert r["hilbert"] >> len(lengths) * (depth - 2) == curve_codes([c >> depth - 2 for c in cell], 2)  # coarser cells are prefixes
    for low, high in (([-0.1] * 3, [0.2] * 3), ([0.3] * 3, [0.7] * 3), ([-0.5] * 3, [0.5] * 3)):  # the second goes round the box
        bounds = [(a * n, b * n) for a, b, n in zip(low, high, lengths)]
        found = curve_intervals(box, bounds, depth, 8)
        assert 1 <= len(found) <= 8 and all(a <= b for a, b in found) and all(x[1] < y[0] for x, y in zip(found, found[1:]))
        for r in got:
            inside = all(a <= r[x] + k * n <= b or a <= r[x] + n <= b for x, n, (a, b) in zip(box.axes, lengths, bounds) for k in (0,))
            assert not inside or any(a <= r["hilbert"] <= b for a, b in found)
    part = sum(b - a + 1 for a, b in curve_intervals(box, [(0.0, 0.1 * n) for n in lengths], depth))
    assert part <= (1 << len(lengths) * depth) / 4


def test_species_pairs_are_symmetric(spark):
    rows = pot.species_pairs(spark, [{"a": 0, "b": 1, "epsilon": 2}, {"a": 0, "b": 0, "epsilon": 1}]).collect()
    assert sorted((r["a"], r["b"], r["epsilon"]) for r in rows) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.0)]
    with pytest.raises(ValueError):
        pot.Truncated(pot.morse, "abrupt")
    assert math.isclose(vec.BOLTZMANN * vec.AVOGADRO, 8.31446, rel_tol=1e-5)
