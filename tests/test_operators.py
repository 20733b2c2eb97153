"""Operators on particle tables against brute force and closed forms."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.functions import draws
from moraine.functions import potentials as pot
from moraine.functions.box import Box
from moraine.operators import correlation as tcf
from moraine.operators import dynamics, forces, fourier, generate, groups, neighbours, sorting, springs, statistics
from moraine.operators.thermodynamics import thermodynamics
from moraine.sources.clustered import read_region, write_clustered


def cloud(spark, n: int, box: Box, seed: int = 1, species: int = 2):
    g = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        r, v = [float(g.uniform(-x / 2, x / 2)) for x in box.lengths], g.normal(size=box.dimension).tolist()
        rows.append((i, i % species, 1.0 + i % 3, *r, *v, *[0] * box.dimension))
    axes = box.axes
    names = "id long, species int, mass double, " + ", ".join([f"{a} double" for a in axes] + [f"v{a} double" for a in axes] + [f"i{a} int" for a in axes])
    return spark.createDataFrame(rows, names).cache()


def brute_pairs(p, box: Box, cutoff: float) -> set:
    rows, out = p.collect(), set()
    for a in rows:
        for b in rows:
            d = [a[x] - b[x] for x in box.axes]
            d = [x - n * round(x / n) for x, n in zip(d, box.lengths)]
            if a["id"] < b["id"] and sum(x * x for x in d) < cutoff**2:
                out.add((a["id"], b["id"]))
    return out


@pytest.mark.parametrize("lengths, cutoff", [((3.0, 4.0, 5.0), 0.9), ((6.0, 3.0), 0.7), ((3.0, 3.0, 3.0), 1.0), ((2.0, 2.0), 0.9)])
def test_cell_join_equals_all_pairs(spark, lengths, cutoff):
    box = Box(lengths)
    p = cloud(spark, 90, box)
    pairs = neighbours.neighbours(p, box, cutoff)
    found = [(r["i"], r["j"]) for r in pairs.select("i", "j").collect()]
    assert len(found) == len(set(found)) and set(found) == brute_pairs(p, box, cutoff)
    one, two = p.where("species = 0"), p.where("species = 1")
    between = {(r["i"], r["j"]) for r in neighbours.neighbours(one, box, cutoff, others=two).select("i", "j").collect()}
    assert between == {(i, j) if i % 2 == 0 else (j, i) for i, j in set(found) if (i + j) % 2}


@pytest.mark.parametrize("lengths, cutoff", [((1.0, 9.0, 9.0), 0.9), ((2.0, 2.0, 9.0), 0.95), ((0.5, 30.0), 0.9), ((2.0, 30.0), 0.9)])
def test_few_cells_along_an_axis(spark, lengths, cutoff):
    box = Box(lengths)
    p = cloud(spark, 150, box)
    found = [(r["i"], r["j"]) for r in neighbours.neighbours(p, box, cutoff).select("i", "j").collect()]
    assert len(found) == len(set(found)) and set(found) == brute_pairs(p, box, cutoff)
    between = [(r["i"], r["j"]) for r in neighbours.neighbours(p.where("species = 0"), box, cutoff, others=p.where("species = 1")).select("i", "j").collect()]
    assert sorted(between) == sorted((i, j) if i % 2 == 0 else (j, i) for i, j in set(found) if (i + j) % 2)


def test_dense_cells_are_dealt_into_blocks(spark, monkeypatch):
    """Nine tenths of all rows in one cell, some of them at its border, and a dense neighbour."""
    monkeypatch.setattr(neighbours, "TILE_ROWS", 40)
    box, g = Box((6.0, 6.0)), np.random.default_rng(3)
    rows = [(i, i % 2, *(g.uniform(0.0, 1.0, 2) if i < 540 else g.uniform(1.0, 1.3, 2) - (0.0, 1.0) if i < 600 else g.uniform(-3, 3, 2)).tolist()) for i in range(660)]
    p = spark.createDataFrame(rows, "id long, species int, x double, y double").repartition(4).cache()
    want = brute_pairs(p, box, 0.3)
    found = [(r["i"], r["j"], r["x_i"] - r["x_j"], r["dx"]) for r in neighbours.neighbours(p, box, 0.3).collect()]
    assert len(found) == len(want) and {f[:2] for f in found} == want and all(abs(a - b - round((a - b) / 6) * 6) < 1e-12 for *_, a, b in found)
    one, two = p.where("id < 300"), p.where("id >= 300")
    between = [(r["i"], r["j"]) for r in neighbours.neighbours(one, box, 0.3, others=two).select("i", "j").collect()]
    assert sorted(between) == sorted((i, j) for i, j in want if i < 300 <= j)
    small, large = p.where("species = 0 and id >= 540"), p.where("species = 1")  # only one side is dense, from either end
    for a, b in ((small, large), (large, small)):
        between = {(r["i"], r["j"]) for r in neighbours.neighbours(a, box, 0.3, others=b).select("i", "j").collect()}
        assert between == {(i, j) if b is large else (j, i) for x, y in want for i, j in ((x, y), (y, x)) if i % 2 == 0 and i >= 540 and j % 2}
    for left, right, same in ((p, p, True), (one, two, False)):
        left, right, on = neighbours.dealt(left, right, box, 1.0, [], same)
        work = left.groupBy(*on).count().join(right.groupBy(*on).agg(F.count("*").alias("n")), on).select((F.col("count") * F.col("n")).alias("pairs"))
        most, whole = work.agg(F.max("pairs"), F.sum("pairs")).first()
        assert most <= 70 * 200 and most < whole / 20  # a block against a block or the sparse cells around it
    inner, one_cell = p.where("id < 600"), Box((3.0, 3.0))
    assert {(r["i"], r["j"]) for r in neighbours.neighbours(inner, one_cell, 1.6).select("i", "j").collect()} == brute_pairs(inner, one_cell, 1.6)


def test_all_pairs_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_ROWS", 7)
    box = Box((2.0, 2.0))
    p = cloud(spark, 60, box)
    found = sorted((r["i"], r["j"]) for r in neighbours.all_pairs(p, box).select("i", "j").collect())
    ids = sorted(r["id"] for r in p.collect())
    assert found == [(i, j) for i in ids for j in ids if i < j]
    one, two = p.where("species = 0"), p.where("species = 1")
    found = sorted((r["i"], r["j"]) for r in neighbours.all_pairs(one, box, two).select("i", "j").collect())
    assert found == sorted((a["id"], b["id"]) for a in one.collect() for b in two.collect())
    steps = p.withColumn("step", F.col("id") % 3)
    assert neighbours.all_pairs(steps, box).count() == sum(n * (n - 1) // 2 for n in [r["count"] for r in steps.groupBy("step").count().collect()])


def _odd_rows(kind: str) -> list[tuple]:
    """Rows (step, id, x, y) beyond a box of 1 and 2, on its borders, copied, and with values that are no numbers."""
    g = np.random.default_rng(4)
    rows = [(i % 2, i, float(x), float(y)) for i, (x, y) in enumerate(g.uniform(-0.8, 0.8, (60, 2)))]
    if kind == "borders":  # differences of a half, exactly and but for their rounding
        rows = [(s, i, *[float(v) for v in g.choice([0.5, -0.5, 1e-20, -1e-20, 0.0, -0.0, 0.25, 1.0, -1.5], 2)]) for s, i, _, _ in rows]
    elif kind == "copies":
        rows = [(s, i, *rows[i // 20][2:]) for s, i, _, _ in rows]
    elif kind == "ids":
        rows = [(s, i // 7, x, y) for s, i, x, y in rows]
    elif kind == "null":
        rows = [(s, i, None if i % 5 == 0 else x, None if i % 7 == 0 else y) for s, i, x, y in rows] + [(0, None, 0.1, 0.1), (None, 99, 0.1, 0.1), (7, 8, 0.1, 0.1)]
    elif kind == "infinite":
        rows = [(s, i, {3: math.inf, 5: -math.inf, 8: math.inf}.get(i, x), {11: math.nan, 12: math.inf}.get(i, y)) for s, i, x, y in rows]
    return rows


@pytest.mark.parametrize("kind", ["plain", "borders", "copies", "ids", "null", "infinite"])
def test_springs_equal_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(springs, "SPAN", 8)
    p, box = spark.createDataFrame(_odd_rows(kind), "step int, id long, x double, y double"), Box((1.0, 2.0))
    found = [sorted(tuple(r) for r in forces.full_forces(p, box, f).select("step", "id", "fx", "fy", "en_pot").collect()) for f in (pot.Spring(3.0), lambda rr: (F.lit(-3.0), 1.5 * rr))]
    assert len(found[0]) == len(found[1]) > 0
    for a, b in zip(*found):
        assert a[:2] == b[:2]
        for x, y in zip(a[2:], b[2:]):
            assert x is y or x == pytest.approx(y, rel=1e-9, abs=1e-9, nan_ok=True)


def test_springs_of_many_rows(spark):
    """A ring of 100,001 rows at equal distances, which have 5 billion pairs."""
    n = 100_001
    p = spark.range(n).select("id", ((F.col("id") + 0.5) / n - 0.5).alias("x"))
    out = forces.full_forces(p, Box((1.0,)), pot.Spring(4.0)).agg(F.count("*"), F.max(F.abs("fx")), F.min("en_pot"), F.max("en_pot")).first()
    assert out[0] == n and out[1] < 1e-6
    assert out[2:] == pytest.approx([(n * n - 1) / (12 * n)] * 2, rel=1e-9)


def test_large_tables_have_pairs(spark):
    """More rows than the 20,000 that were once the limit."""
    p = spark.range(20_500).select("id", F.rand(1).alias("x"), (F.rand(2) * 300).alias("y"))
    assert neighbours.all_pairs(p, Box((1.0, 300.0))).count() == 20_500 * 20_499 // 2
    assert neighbours.neighbours(p, Box((1.0, 300.0)), 0.6).count() > 0


def test_cell_join_has_no_nested_loops(spark):
    box = Box((5.0, 5.0, 5.0))
    plan = neighbours.neighbours(cloud(spark, 20, box), box, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_skin_and_displacement(spark):
    box = Box((4.0, 4.0, 4.0))
    p = cloud(spark, 80, box)
    stored = neighbours.neighbours(p, box, 0.9, skin=0.2).select("i", "j")
    moved = dynamics.drift(p, box, 0.02)
    assert neighbours.max_displacement(p, moved, box).first()[0] < 0.1
    assert {(r["i"], r["j"]) for r in neighbours.within(stored, moved, box, 0.9).select("i", "j").collect()} == brute_pairs(moved, box, 0.9)


def test_neighbours_of_a_series(spark, monkeypatch):
    """Tables are made anew just where a particle leaves half the skin; pairs of every step are those of brute force."""
    box, g = Box((4.0, 4.0)), np.random.default_rng(12)
    at, rows, speed = g.uniform(-2, 2, (50, 2)), [], g.normal(0, 0.02, (50, 2))
    for step in [*range(0, 30), *range(33, 40)]:
        at = (at + speed * (3 if step == 20 else 1) + 2) % 4 - 2
        rows += [(step, i, *map(float, at[i])) for i in range(50 if step < 25 else 49)] + ([(step, 77, 0.1, 0.2)] if step >= 30 else [])
    series = spark.createDataFrame(rows, "step long, id long, x double, y double").repartition(4).cache()
    steps = {s: {r[1]: r[2:] for r in rows if r[0] == s} for s in sorted({r[0] for r in rows})}
    apart = lambda a, b: math.sqrt(sum((x - y - 4 * round((x - y) / 4)) ** 2 for x, y in zip(a, b)))
    want = [0]
    for s, now in steps.items():
        if any(i not in steps[want[-1]] or apart(r, steps[want[-1]][i]) > 0.15 for i, r in now.items()):
            want.append(s)
    assert neighbours.rebuild_steps(series, box, 0.3, look=2) == want and 3 < len(want) < 30
    calls = []
    real = neighbours.neighbours
    monkeypatch.setattr(neighbours, "neighbours", lambda *a, **k: calls.append(1) or real(*a, **k))
    got = sorted((r["step"], r["i"], r["j"]) for r in neighbours.neighbour_series(series, box, 0.5, 0.3).collect())
    assert len(calls) == 1  # one cell join for all epochs
    assert got == sorted((s, i, j) for s, now in steps.items() for i in now for j in now if i < j and apart(now[i], now[j]) < 0.5)
    assert neighbours.neighbour_series(series.where("id < 0"), box, 0.5, 0.3).count() == 0


_KINDS = [(pot.lennard_jones, "shifted"), (pot.mie(10, 4), "shifted"), (pot.power_law(6), "shifted"), (pot.power_law(7), "shifted"), (pot.power_law_hard_core(6), "shifted"), (pot.hard_core(pot.morse), "shifted"), *[(pot.morse, k) for k in pot.TRUNCATIONS]]


def _same_forces(got, want):
    got, want = ({(r["step"], r["id"]): r for r in t.collect()} for t in (got, want))
    assert got.keys() == want.keys() and len(want) > 30
    for k, r in want.items():
        for n, x in r.asDict().items():
            assert got[k][n] is x or got[k][n] == pytest.approx(x, rel=1e-9, abs=1e-9 * max(abs(v) for v in r[2:] if v is not None)), (k, n)


@pytest.mark.parametrize("potential, kind", _KINDS)
def test_near_forces_equal_those_of_pairs(spark, monkeypatch, potential, kind):
    """Steps, images, dense cells, sorted tiles; a table that is not the same both ways and lacks pairs; rows without a position, a species or an id."""
    monkeypatch.setattr(neighbours, "TILE_ROWS", 30)
    monkeypatch.setattr(neighbours, "LARGE", 200)
    monkeypatch.setattr(neighbours, "SLICE", 64)
    box, g = Box((3.0, 4.0)), np.random.default_rng(5)
    rows = [(i % 2, i, i % 4, *map(float, g.uniform(-0.4, 0.4, 2) if i < 90 else g.uniform(-1.0, 1.0, 2) * (1.6, 2.1))) for i in range(150)]
    rows += [(0, 200, 1, None, 0.1), (0, 201, None, 0.2, 0.1), (1, None, 1, 0.2, 0.1), (1, 202, 9, 0.2, 0.1), (1, 203, 2, float("nan"), 0.1), (None, 204, 2, 0.3, 0.1)]
    p = spark.createDataFrame(rows, "step int, id long, species int, x double, y double").repartition(3).cache()
    found = [{"a": a, "b": b, "epsilon": 1.0 + a, "sigma": 0.4 + 0.1 * b, "r_cut": 0.8 + 0.05 * a, "r_min": 0.5, "distortion": 1.3, "r_core": 0.0001} for a in range(3) for b in range(4) if (a, b) != (1, 1)]
    cut = pot.Truncated(potential, kind, 0.3)
    params = cut.prepare(spark.createDataFrame([tuple(r.values()) for r in found], "a int, b int, epsilon double, sigma double, r_cut double, r_min double, distortion double, r_core double"))
    got = forces.near_forces(p, box, 0.95, cut, params)
    assert "id_j" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row is a pair
    _same_forces(got, forces.pair_forces(neighbours.neighbours(p, box, 0.95, params=params), box, cut))
    one, two = p.where("id % 3 = 0"), p.where("id % 3 > 0 or id is null")
    _same_forces(forces.near_forces(one, box, 0.95, cut, params, two, 0.7), forces.pair_forces(neighbours.neighbours(one, box, 0.95, others=two, params=params), box, cut, 0.7, both=False))


def test_near_forces_without_a_table(spark):
    """Constants, and potentials that are made of columns or of numbers only."""
    box = Box((3.0, 4.0))
    p = cloud(spark, 80, box).withColumn("step", F.col("id") % 2)
    pairs = neighbours.neighbours(p.select("step", "id", "x", "y"), box, 0.9)
    _same_forces(forces.near_forces(p, box, 0.9, pot.lennard_jones, {"epsilon": 2.0, "sigma": 0.5}), forces.pair_forces(pairs.withColumns({"epsilon": F.lit(2.0), "sigma": F.lit(0.5)}), box, pot.lennard_jones))
    for own, reads in ((lambda rr: (F.col("k") * F.exp(-rr), rr), True), (lambda rr, p: (p("k") / rr, 2.0), True), (pot.Spring(2.0), False)):
        want = forces.pair_forces(pairs.withColumn("k", F.lit(3.0)), box, own if own.__class__ is pot.Spring or own.__code__.co_argcount == 1 else lambda rr: (F.lit(3.0) / rr, F.lit(2.0)))
        _same_forces(forces.near_forces(p, box, 0.9, own, {"k": 3.0} if reads else None), want)
    assert forces.near_forces(p.where("id < 0"), box, 0.9, pot.lennard_jones_simple).count() == 0


@pytest.mark.parametrize("potential", [pot.lennard_jones, pot.morse, pot.Truncated(pot.morse, "force_shifted")])
def test_forces_between_rows_at_one_place(spark, potential):
    """What divides by zero is an error in ANSI mode, else null, which sums pass over."""
    box, values = Box((3.0, 4.0)), {"epsilon": 2.0, "sigma": 0.5, "r_min": 0.4, "distortion": 1.2, "r_cut": 0.9, "u_cut": 0.1, "f_cut": 0.2}
    rows = [(0, i, 0.02 * (i % 40), 0.3 * (i % 4)) for i in range(60)] + [(1, i, 0.5, 0.5) for i in range(2)]
    p = spark.createDataFrame(rows, "step int, id long, x double, y double")
    pairs = neighbours.neighbours(p, box, 0.5).withColumns({k: F.lit(v) for k, v in values.items()})
    with pytest.raises(Exception):
        forces.near_forces(p, box, 0.5, potential, values).collect()
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        _same_forces(forces.near_forces(p, box, 0.5, potential, values), forces.pair_forces(pairs, box, potential))
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_forces_are_balanced(spark):
    box = Box((4.0, 4.0, 4.0))
    p = cloud(spark, 60, box)
    cut = pot.Truncated(pot.morse, "force_shifted")
    params = cut.prepare(pot.species_pairs(spark, [{"a": a, "b": b, "epsilon": 1 + a + b, "sigma": 0.4, "r_cut": 1.0 + 0.1 * b, "r_min": 0.5, "distortion": 1.3} for a in (0, 1) for b in (a, 1)]))
    pairs = neighbours.neighbours(p, box, 1.2, params=params)
    f = forces.pair_forces(pairs, box, cut)
    total = f.agg(F.sum("fx"), F.sum("fy"), F.sum("en_pot")).first()
    assert abs(total[0]) < 1e-9 and abs(total[1]) < 1e-9
    energy = pairs.select(cut(F.col("rr"))[1].alias("u")).agg(F.sum("u")).first()[0]
    assert total[2] == pytest.approx(energy)
    twice = forces.add_forces(f, f, box=box).agg(F.sum("en_pot")).first()[0]
    assert twice == pytest.approx(2 * energy)
    one_way = forces.pair_forces(pairs, box, cut, aux_weight=0.5, both=False).agg(F.sum("en_pot")).first()[0]
    assert one_way == pytest.approx(energy / 2)
    out = thermodynamics(forces.with_forces(p, f, box), box, {"u": "potential_energy", "t": "temperature", "p": "pressure", "virial": "virial"}).first()
    assert out["p"] == pytest.approx(60 / 64 * (out["t"] + out["virial"] / 3)) and out["u"] == pytest.approx(energy / 60)
    with pytest.raises(ValueError):
        thermodynamics(p, box, ["charm"])


def test_empty_groups_give_null(spark):
    box = Box((4.0, 4.0))
    row = thermodynamics(cloud(spark, 5, box).where("id > 99"), box, ["particle_number", "temperature", "center_of_mass_velocity"]).first()
    assert row["particle_number"] == 0 and row["temperature"] is None and row["center_of_mass_velocity_x"] is None


def test_groups(spark):
    box = Box((4.0, 4.0, 4.0))
    p = cloud(spark, 100, box)
    for g in (groups.Sphere((0.0, 0.5, 0.0), 1.4), groups.Cuboid((-1.0, -1.0, -1.0), (2.0, 1.5, 3.0)), groups.Cylinder((0.0, 0.0, 0.0), (0.0, 0.0, 3.0), 1.0, 2.0)):
        inside, outside = groups.region(p, box, g), groups.region(p, box, g, "excluded")
        assert inside.count() + outside.count() == 100 and inside.intersect(outside).count() == 0
    assert [r[0] for r in groups.id_range(p, 3, 5, 100).select("id").orderBy("id").collect()] == [2, 3, 4]
    for first, last in ((0, 3), (5, 4), (1, 101)):
        with pytest.raises(ValueError):
            groups.id_range(p, first, last, 100)
    with pytest.raises(ValueError):
        groups.region_mask(box, groups.Sphere((0.0, 0.0, 0.0), 1.0), "around")
    with pytest.raises(ValueError):
        groups.sampled_steps(p, 0, 0)
    part = groups.to_particle(p.where("id % 3 = 1"), box)
    assert [r["id"] for r in part.orderBy("id").collect()] == list(range(33))
    with pytest.raises(ValueError):
        groups.to_particle(p, box, count=3)
    sample = groups.sample_positions(p.where("id < 10"), box).withColumns({a: F.col(a) + 40 for a in box.axes})
    back = groups.set_columns(p, sample.select("id", *box.axes), list(box.axes), box)
    a, b = (x.where("id = 4").first() for x in (p, back))
    assert b["x"] == pytest.approx(a["x"]) and b["ix"] == 10 and back.where("id = 50").first()["ix"] == 0
    with pytest.raises(TypeError):
        groups.set_columns(p, p.select("id", F.col("x").cast("float").alias("x")), ["x"])


#: Fixed values of the numbers 0..9: mean, variance, sigma, error, sum.
TEN = (4.5, 8.25, 2.8722813232690143, 0.9574271077563381, 45.0)


def test_accumulators(spark):
    rows = spark.range(10).selectExpr("cast(id as double) as v", "id % 2 as k")
    got = statistics.accumulate(rows, "v").first()
    assert [got[n] for n in ("mean", "variance", "sigma", "error", "sum")] == pytest.approx(list(TEN), rel=1e-15)
    parts = statistics.accumulate(rows, "v", ["k"])
    both = statistics.merge(parts.union(parts)).first()
    assert (both["count"], both["sum"]) == (20, 90) and both["error"] == pytest.approx(0.65894652766046918, rel=1e-14)
    assert statistics.accumulate(rows.where("v = 3"), "v").first()["error"] is None
    series = rows.selectExpr("cast(v as long) as step", "v")
    assert [r["count"] for r in statistics.windowed(series, "v", 4).orderBy("window").collect()] == [4, 4, 2]
    block = statistics.block_average(series, "v", 3).first()
    assert (block["count"], block["mean"]) == (3, 4.0) and block["error"] == pytest.approx(np.std([1, 4, 7]) / math.sqrt(2))
    u, p = statistics.long_range_corrections(0.3, 4.0)
    assert (u, p) == (pytest.approx(8 / 9 * math.pi * 0.3 * (4**-6 - 3) / 64), pytest.approx(32 / 9 * math.pi * 0.09 * (4**-6 - 1.5) / 64))


def test_structure_of_a_crystal(spark):
    box, n = Box((6.0, 6.0, 6.0)), 4 * 27
    p = generate.fcc_lattice(spark, n, box)
    w = fourier.dense_wavevectors(spark, box, [2 * math.pi / 2 * 2.1]).cache()
    modes = fourier.density_modes(p, w, box)
    rows = modes.join(w, "q_id").collect()
    for r in rows:
        hkl = [r["q" + a] / (2 * math.pi / 2) for a in "xyz"]
        whole = all(abs(h - round(h)) < 1e-9 for h in hkl)
        strong = whole and len({round(h) % 2 for h in hkl}) == 1
        assert (r["re"] ** 2 + r["im"] ** 2) / n == pytest.approx(n if strong else 0, abs=1e-6)
    s = fourier.structure_factor(modes, w, n).first()
    assert s["count"] == len(rows)


def test_modes_equal_the_plain_sum(spark, monkeypatch):
    """Many wavevectors, steps and species, in small portions."""
    monkeypatch.setattr(fourier, "ROWS", 7)
    monkeypatch.setattr(fourier, "HELD", 900)
    box = Box((3.0, 4.0, 5.0))
    p = cloud(spark, 60, box).withColumn("step", F.col("id") % 3)
    w = fourier.dense_wavevectors(spark, box, [9.0]).cache()
    rows, waves = p.collect(), w.collect()
    assert len(waves) > 500
    got = {(r["step"], r["species"], r["q_id"]): (r["re"], r["im"]) for r in fourier.density_modes(p.repartition(3), w, box, ["species"]).collect()}
    assert len(got) == 6 * len(waves)
    for v in waves[::7]:
        want = {}
        for r in rows:
            key, phase = (r["step"], r["species"], v["q_id"]), sum(v["q" + a] * r[a] for a in "xyz")
            want[key] = want.get(key, 0) + complex(math.cos(phase), -math.sin(phase))
        assert all(abs(complex(*got[k]) - x) < 1e-11 for k, x in want.items())
    assert fourier.density_modes(p.where("id < 0"), w, box).count() == 0
    with pytest.raises(ValueError):
        fourier.density_modes(p, w.withColumn("qx", F.col("qx") + 0.1), box)


def test_modes_of_100000_wavevectors(spark):
    box = Box((1.0, 1.0, 1.0))
    w = fourier.dense_wavevectors(spark, box, [2 * math.pi * 29]).cache()
    assert w.count() > 100_000
    modes = fourier.density_modes(cloud(spark, 300, box), w, box)
    assert modes.count() == w.count() and modes.join(w.where("qx = 0 and qy = 0 and qz = 0"), "q_id").first()["re"] == pytest.approx(300)


def test_wavevector_shells(spark):
    box = Box((math.pi / 2, 4 * math.pi))
    w = fourier.dense_wavevectors(spark, box, [0.6, 1.1, 2.6, 4.05])
    ends = w.groupBy("shell").count().orderBy("shell").collect()
    assert sum(r["count"] for r in ends) == w.count() and [r["shell"] for r in ends] == list(range(len(ends)))
    with pytest.raises(ValueError):
        fourier.dense_wavevectors(spark, box, [1.0], (2, 0))
    q = [7.0, 3.0, 7.0]
    sparse = fourier.sparse_wavevectors(spark, Box((5.0, 5.0, 5.0)), q, 0.05, 4)
    rows = sparse.collect()
    assert all(abs(math.sqrt(r["qx"] ** 2 + r["qy"] ** 2 + r["qz"] ** 2) - r["wavenumber"]) <= 0.0501 * r["wavenumber"] for r in rows)
    assert max(r["count"] for r in sparse.groupBy("shell").count().collect()) <= 4


def brute_tcf(samples: dict, scheme: tcf.BlockingScheme, f) -> dict:
    """By ring buffers per level, as samples come in."""
    out: dict = {}
    for key, series in samples.items():
        for level, (interval, skip) in enumerate(scheme.levels()):
            block, origin = [], 0

            def process():
                for j, x in enumerate(block):
                    out.setdefault((level, j), []).append(f(block[0], x))

            for t in sorted(series):
                if t >= origin and (t - origin) % interval == 0:
                    block.append(series[t])
                if len(block) == scheme.size:
                    process()
                    origin += skip * interval
                    block = block[skip:]
            while block:
                process()
                block = block[skip:]
    return {k: (float(np.mean(v)), len(v)) for k, v in out.items()}


@pytest.mark.parametrize("size, shift, separation, steps", [(4, None, None, 37), (5, 2, 7, 60), (3, 1, 1, 20), (6, 3, 40, 100)])
def test_blocking_equals_ring_buffers(spark, size, shift, separation, steps):
    g = np.random.default_rng(size)
    samples = {i: {t: float(g.normal()) for t in range(steps)} for i in range(3)}
    scheme = tcf.BlockingScheme(0.5, steps / 3, 1, size, shift, separation)
    df = spark.createDataFrame([(i, t, x) for i, s in samples.items() for t, x in s.items()], "id long, step long, x double")
    got = {(r["level"], r["lag_idx"]): (r["value"], r["count"]) for r in tcf.mean_square_displacement(df, scheme, ["x"]).collect()}
    want = brute_tcf(samples, scheme, lambda a, b: (b - a) ** 2)
    assert got.keys() == want.keys()
    for k, (v, n) in want.items():
        assert got[k] == (pytest.approx(v, abs=1e-12), n)


def test_scheme_errors():
    for bad in ({"size": 1}, {"shift": 0}, {"shift": 10}, {"every": 0}, {"max_lag": 0.1}):
        with pytest.raises(ValueError):
            tcf.BlockingScheme(**({"timestep": 1.0, "max_lag": 50.0} | bad))
    assert tcf.BlockingScheme(1.0, 100.0, size=10).levels() == [(1, 10), (3, 4), (10, 1), (30, 1), (100, 1)]


def test_array_correlations(spark):
    df = spark.createDataFrame([(t, float(t), 2.0) for t in range(20)], "step long, a double, b double")
    out = tcf.correlate(df, tcf.BlockingScheme(1.0, 4.0, size=4), lambda x, y: F.array(y["a"] - x["a"], x["b"] * y["b"])).where("level = 0").collect()
    assert {(r["lag_idx"], r["index"]): r["value"] for r in out} == {(j, k): (float(j) if k == 0 else 4.0) for j in range(4) for k in range(2)}


@pytest.mark.parametrize("size, shift, separation, start, width", [(4, None, None, 0, 8), (5, 1, 3, 3, 5), (3, 2, 1, 0, 4096), (6, 3, 20, 1, 6)])
def test_lagged_pairs_equal_brute_force_in_many_ranges(spark, monkeypatch, size, shift, separation, start, width):
    """Series with gaps, a hot key, null keys, and a second table of later samples."""
    monkeypatch.setattr(tcf, "RANGE", width)
    scheme, g = tcf.BlockingScheme(0.5, 40.0, size=size, shift=shift, separation=separation), np.random.default_rng(size)
    rows = [(k, s, float(g.normal())) for k, n in ((1, 150), (2, 7), (3, 40)) for s in range(n) if g.random() > 0.1] + [(None, 3, 1.0), (1, None, 2.0)]
    second = [(k, s, v * 2) for k, s, v in rows if g.random() > 0.2]
    a, b = (spark.createDataFrame(r, "id long, step long, v double").repartition(3) for r in (rows, second))
    for later, table in ((rows, None), (second, b)):
        got = tcf.lagged_pairs(a, scheme, ["id"], start, table)
        at = {(k, s): v for k, s, v in later if k is not None and s is not None}
        want = []
        for level, (i, skip) in enumerate(scheme.levels()):
            for k, s, v in rows:
                if k is not None and s is not None and s >= start and (s - start) % (i * skip) == 0:
                    want += [(k, level, n, n * i * 0.5, s + n * i, v, at[k, s + n * i]) for n in range(size) if (k, s + n * i) in at]
        assert sorted(map(tuple, got.select("id", "level", "lag_idx", "lag_time", "step", "v_1", "v_2").collect())) == sorted(want)
    plan = tcf.lagged_pairs(a, scheme, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_a_single_series_runs_in_many_tasks(spark, monkeypatch):
    df = spark.range(4000).select(F.lit(7).alias("id"), F.col("id").alias("step"), (F.col("id") % 5).cast("double").alias("x"))
    monkeypatch.setattr(tcf, "RANGE", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs = tcf.lagged_pairs(df, tcf.BlockingScheme(1.0, 100.0), ["id"]).withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in pairs.groupBy("part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 2 and max(sizes) < 0.7 * sum(sizes)


def test_scans_of_a_hot_key(spark):
    r = np.random.default_rng(4)
    rows = [(int(k), int(t), i, float(v)) for i, (k, t, v) in enumerate(zip(np.where(r.random(900) < 0.7, 1, r.integers(2, 9, 900)), r.integers(0, 300, 900), r.integers(-9, 9, 900)))] + [(None, 4, 1000, 2.0), (None, 3, 1001, 5.0)]
    got = sorting.keyed_scan(spark.createDataFrame(rows, "k long, t long, e long, v double").repartition(6), "v", ["k"], ["t", "e"]).collect()
    want, seen = {}, {}
    for k, t, e, v in sorted(rows, key=lambda x: (x[1], x[2])):
        n, s = seen.get(k, (-1, 0.0))
        seen[k] = want[e] = (n + 1, s + v)
    assert {x["e"]: (x["number"], x["scan"]) for x in got} == want and len(got) == len(rows)


def test_diffusion_of_a_known_line(spark):
    df = spark.createDataFrame([(float(t), 6 * 0.25 * t, 0.1 + t) for t in range(6)], "lag_time double, value double, error double")
    assert tcf.diffusion_constant(df, 3).first()["diffusion"] == pytest.approx(0.25)
    assert tcf.green_kubo(spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (3.0, 0.0)], "lag_time double, value double"), 2.0).orderBy("lag_time").collect()[-1]["integral"] == 4.0
    assert tcf.helfand_slope(df, 1.0).first()["value"] == pytest.approx(0.75)


def test_lattices(spark):
    p = generate.fcc_lattice(spark, 100, Box((4.0, 5.0, 6.0)), slab=(1.0, 1.0, 0.5))
    rows = p.collect()
    assert len({(r["x"], r["y"], r["z"]) for r in rows}) == 100 and all(abs(r["x"]) <= 2 and abs(r["y"]) <= 2.5 and abs(r["z"]) <= 1.5 for r in rows)
    assert generate.fcc_lattice(spark, 7, Box((2.0, 3.0))).count() == 7
    simple = sorted(map(tuple, generate.lattice(spark, 12, Box((2.0, 3.0, 2.0)), kind="sc").select("x", "y", "z").collect()))
    assert simple == sorted((x, y, z) for x in (-0.5, 0.5) for y in (-1.0, 0.0, 1.0) for z in (-0.5, 0.5))
    with pytest.raises(ValueError):
        generate.lattice(spark, 7, Box((2.0,)), kind="fcc")
    with pytest.raises(ValueError):
        generate.fcc_lattice(spark, 7, Box((2.0, 3.0)), slab=(0.0, 1.0))
    assert generate.semilog_grid(0.1, 4.0, 3) == pytest.approx([0.1, 0.2, 0.3, 0.4, 0.6, 0.8, 1.0, 1.4, 1.8, 2.2, 3.0, 3.8])
    assert generate.semilog_grid(1.0, 4.0, 0) == [1.0, 2.0, 3.0]


def test_random_draws(spark):
    box = Box((9.0, 9.0, 9.0))
    p = generate.boltzmann_velocities(generate.fcc_lattice(spark, 3000, box).withColumn("mass", 1.0 + F.col("id") % 2), box, 2.0, seed=4)
    row = thermodynamics(p, box, ["temperature", "center_of_mass_velocity"]).first()
    assert abs(row["temperature"] - 2) < 4.5 * 2 * math.sqrt(2 / 9000) and all(abs(row[f"center_of_mass_velocity_{a}"]) < 1e-12 for a in "xyz")
    u = spark.range(500).select(*[c.alias(n) for c, n in zip(draws.unit_vector(3, "id"), "abc")])
    assert all(abs(r["a"] ** 2 + r["b"] ** 2 + r["c"] ** 2 - 1) < 1e-12 for r in u.collect())
    x = spark.range(2000).select(draws.uniform(1, "id", low=2, high=4).alias("u"), draws.normal(2, "id", mean=5, sigma=0.5).alias("n")).agg(F.avg("u"), F.avg("n"), F.min("u"), F.max("u")).first()
    assert abs(x[0] - 3) < 0.1 and abs(x[1] - 5) < 0.1 and 2 <= x[2] and x[3] <= 4
    assert sorted(r[0] for r in generate.shuffled(spark.range(50), 1, ["id"]).select("place").collect()) == list(range(50))


def test_excluded_volume(spark):
    box = Box((4.0, 4.0, 4.0))
    p = cloud(spark, 60, box).withColumn("diameter", F.lit(0.8))
    a, b = p.where("id < 30"), p.where("id >= 30")
    free = {r["id"] for r in neighbours.excluded_volume(a, b, box, 0.8).collect()}
    hit = {i for i, j in brute_pairs(p, box, 0.8) if i < 30 <= j}
    assert free == set(range(30)) - hit


def test_draws_do_not_depend_on_the_layout(spark):
    rows = spark.range(300).withColumn("mass", F.lit(2.0))
    columns = [draws.uniform(1, "id").alias("u"), draws.normal(1, "id").alias("n"), draws.permuted("id", 300, 9).alias("p"), *[c.alias(a) for c, a in zip(draws.unit_vector(3, "id", dimension=2), "xy")]]
    first = sorted(map(tuple, rows.repartition(1).select("id", *columns).collect()))
    assert first == sorted(map(tuple, rows.orderBy(F.desc("id")).repartition(7).select("id", *columns).collect()))
    assert len({r[1] for r in first}) == 300 and [r[3] for r in first] != list(range(300))
    other = sorted(map(tuple, rows.select("id", draws.uniform(2, "id").alias("u")).collect()))
    assert sum(a[1] == b[1] for a, b in zip(first, other)) == 0
    box = Box((3.0, 3.0, 3.0))
    a, b = (sorted(map(tuple, generate.boltzmann_velocities(r, box, 1.0, 5).select("id", F.round("vx", 10)).collect())) for r in (rows.repartition(1), rows.repartition(5)))
    assert a == b


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 99, 1000, 4097])
def test_permutations_are_bijections(spark, n):
    moved = {r["id"]: r["p"] for r in spark.range(n).repartition(3).select("id", draws.permuted("id", n, 4).alias("p")).collect()}
    assert sorted(moved.values()) == list(range(n))
    if n >= 1000:  # no trend, and neighbours land anywhere
        assert abs(np.corrcoef(list(moved), list(moved.values()))[0, 1]) < 0.12
        assert abs(np.abs(np.diff([moved[i] for i in range(n)])).mean() / n - 1 / 3) < 0.05


def brute_placement(rows, box):
    taken = []
    for r in sorted(rows, key=lambda r: r["id"]):
        apart = lambda t: sum((d - n * round(d / n)) ** 2 for a, n in zip(box.axes, box.lengths) for d in [r[a] - t[a]])
        if all(apart(t) >= ((r["diameter"] + t["diameter"]) / 2) ** 2 for t in taken):
            taken.append(r)
    return [t["id"] for t in taken]


@pytest.mark.parametrize("lengths, crowd", [((4.0, 4.0, 4.0), 0), ((5.0, 3.0), 200), ((1.0, 30.0), 0)])
def test_placement_is_that_of_one_after_the_other(spark, lengths, crowd, monkeypatch):
    box = Box(lengths)
    p = cloud(spark, 220, box).withColumn("diameter", 0.5 + 0.2 * F.col("species"))
    if crowd:  # a hot spot, in blocks, with ids among the others
        monkeypatch.setattr(neighbours, "TILE_ROWS", 50)
        spot = cloud(spark, crowd, Box((0.2, 0.1)), 7).withColumns({"id": 3 * F.col("id") + 1, "diameter": F.lit(0.4)})
        p = p.withColumn("id", 3 * F.col("id")).unionByName(spot)
    p = p.select("id", *box.axes, "diameter", "species").cache()
    extra = spark.createDataFrame([(9000, None, 0.5), (9001, 0.0, None)], "id long, x double, diameter double")
    got = neighbours.placed_in_order(p.unionByName(extra, allowMissingColumns=True).repartition(5), box)
    assert sorted(r["id"] for r in got.collect()) == brute_placement(p.collect(), box)


def test_placement_along_a_line_and_of_nothing(spark):
    box = Box((40.0, 4.0))
    line = spark.range(20).select("id", (F.col("id") * 0.6 - 19).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("diameter"))
    assert sorted(r["id"] for r in neighbours.placed_in_order(line, box).collect()) == list(range(0, 20, 2))
    assert neighbours.placed_in_order(line.where("id < 0"), box).count() == 0
    with pytest.raises(ValueError):
        neighbours.placed_in_order(line.withColumn("diameter", F.lit(0.0)), box)


def test_regions_of_a_clustered_table(spark, tmp_path):
    box = Box((2.0, 3.0, 4.0))
    p = cloud(spark, 2000, box).repartition(4)
    path = f"file://{tmp_path}/clustered"
    write_clustered(p, box, path, 0.1)
    everything = spark.read.parquet(path)
    files = len(everything.inputFiles())
    assert everything.count() == 2000 and files >= 64
    shapes = [groups.Sphere((0.4, 0.5, -1.0), 0.45), groups.Cuboid((-0.9, -1.4, 1.0), (0.4, 0.5, 0.6)), groups.Cylinder((0.3, 0.2, 0.1), (1.0, 2.0, 0.5), 0.3, 0.8), groups.Sphere((0.0, 0.0, 0.0), 9.0)]
    for shape in shapes:
        got = read_region(spark, path, box, shape, 0.1)
        assert got.columns == p.columns
        ids = sorted(r["id"] for r in got.collect())
        assert ids == sorted(r["id"] for r in groups.region(p, box, shape).collect()) and ids
        opened = got.select(F.col("id"), F.input_file_name().alias("f")).distinct().groupBy("f").count().count()
        read = sum(int(m.value()) for m in [x.metrics().get("numFiles").get() for x in leaves(got)])
        assert opened <= read and (read == files if shape is shapes[-1] else read < files / 3)
    plan = read_region(spark, path, box, shapes[0], 0.1, species=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in plan or "PartitionFilters: [block" in plan
    assert "Or(" in plan.split("PushedFilters")[1].split("ReadSchema")[0]  # the intervals of codes


def leaves(df):
    """The file scans of an executed plan."""
    df._jdf.queryExecution().toRdd().count()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.getClass().getName() else plan
    found = plan.collectLeaves()
    return [found.apply(k) for k in range(found.size())]


def test_orders(spark):
    rows = spark.range(1000).selectExpr("id as o", "id * 7 % 13 as v").repartition(5)
    got = {r["o"]: r["scan"] for r in sorting.exclusive_scan(rows, "v", "o", 64).collect()}
    values = [i * 7 % 13 for i in range(1000)]
    assert got == {i: sum(values[:i]) for i in range(1000)}
    assert [r["place"] for r in sorting.compact(rows, F.col("v") > 6, "o").orderBy("o").collect()] == list(range(sum(v > 6 for v in values)))
    box = Box((4.0, 4.0))
    clustered = sorting.hilbert_clustered(cloud(spark, 50, box), box, 0.5, 3)
    assert clustered.count() == 50 and "hilbert" in clustered.columns
    text = spark.range(1).select(sorting.interpolate("a{x}b{y}", {"x": F.lit(1), "y": F.lit("z")}).alias("t"), sorting.repeat_element(F.lit(2), 2).alias("r")).first()
    assert text["t"] == "a1bz" and text["r"] == [2, 2]


def test_drift_and_kick(spark):
    box = Box((4.0, 4.0))
    p = spark.createDataFrame([(0, 0, 2.0, 1.9, 0.0, 0, 0, 1.0, -1.0, 4.0, 0.0)], "id long, species int, mass double, x double, y double, ix int, iy int, vx double, vy double, fx double, fy double")
    moved = dynamics.drift(dynamics.kick(p, box, 0.1), box, 0.5).first()
    assert moved["vx"] == pytest.approx(1.2) and moved["x"] == pytest.approx(-1.5) and moved["ix"] == 1 and moved["y"] == -0.5


def test_rows_without_order_come_first(spark):
    rows = spark.createDataFrame([(None, 5), (3, 1), (70_000, 2), (4, 4)], "k long, v long")
    got = {r["k"]: r["scan"] for r in sorting.exclusive_scan(rows, "v", "k").collect()}
    assert got == {None: 0, 3: 5, 4: 6, 70_000: 10}
    assert {r["k"]: r["n"] for r in groups.dense_index(rows, "k", "n").collect()} == {None: 0, 3: 1, 4: 2, 70_000: 3}


@pytest.mark.parametrize("width", [7, 65_536])
def test_running_statistics_in_ranges(spark, width):
    rows = [(k, t, 1e6 * k + float((t * 31 + k) % 17)) for k in range(2) for t in range(40)] + [(5, 3, None), (5, 9, 2.0)]
    got = {(r["id"], r["step"]): r for r in statistics.running(spark.createDataFrame(rows, "id long, step long, v double"), "v", ["id"], width).collect()}
    for k, t, _ in rows:
        own = [v for a, s, v in rows if a == k and s <= t and v is not None]
        r = got[k, t]
        assert r["count"] == len(own) and (not own or r["mean"] == pytest.approx(np.mean(own), rel=1e-12))
        assert len(own) < 2 or r["variance"] == pytest.approx(np.var(own), rel=1e-6) and r["error"] == pytest.approx((np.var(own) / (len(own) - 1)) ** 0.5, rel=1e-6)


def test_numbered_follows_any_order(spark):
    rows = spark.range(500).select((F.col("id") % 3).cast("string").alias("k"), ((F.col("id") * 37) % 500).alias("v")).repartition(7)
    got = sorted((r["k"], r["v"], r["n"]) for r in sorting.numbered(rows, ["k", "v"], "n").collect())
    assert [n for _, _, n in got] == list(range(500))


@pytest.mark.parametrize("n", [0, 1, 20, 21, 210])
def test_permute_has_every_row(spark, tmp_path, n):
    from moraine.plans.queries import QUERIES

    rows = spark.range(n).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: (k + F.col("id")).cast("float")).alias("embedding"), F.lit(0).alias("label"))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["permute"](spark, str(tmp_path)).collect()
    assert sorted(r["index"] for r in got) == list(range(n)) and len({r["x"] for r in got}) == n
    assert all(r["index"] == n - int(r["x"]) for r in got)
