"""Registered queries against their SQL, on small tables with particles beyond the box."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from moraine.functions.box import Box
from moraine.operators import neighbours
from moraine.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def beyond(tmp_path_factory):
    """60 vectors near the border of the unit box, a third of their components beyond it."""
    folder, g = tmp_path_factory.mktemp("beyond"), np.random.default_rng(3)
    rows = [(i, i % 10, [float(np.float32(v)) for v in [*(g.choice([-1, 1], 3) * g.uniform(0.45, 0.53, 3)), *g.normal(0, 0.1, 3), 0.0, 0.0]]) for i in range(60)]
    con = duckdb.connect()
    con.execute("CREATE TABLE e (vec_id BIGINT, label INT, embedding FLOAT[])")
    con.executemany("INSERT INTO e VALUES (?, ?, ?)", rows)
    con.execute(f"COPY e TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return str(folder)


def agrees(spark, folder: str, name: str) -> int:
    """The number of rows; each must be in both results."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{folder}/embeddings.parquet'")
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    want, got = sorted(found.fetchall()), sorted(tuple(r) for r in QUERIES[name](spark, folder).select(*names).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-8)
    return len(want)


@pytest.mark.parametrize("name", ["harmonic_plus_pairs", "planar_walls"])
def test_fields_beyond_the_box(spark, beyond, name):
    """Fields that aren't periodic act at positions as they are."""
    assert agrees(spark, beyond, name) == 60


def test_restored_positions_beyond_the_box(spark, beyond):
    """Every position is wrapped, restored or not."""
    assert agrees(spark, beyond, "store_restore") == 60


def test_step_from_beyond_the_box(spark, beyond):
    assert agrees(spark, beyond, "verlet_step") == 60


def test_a_dense_cell_is_not_dealt_too_finely(spark):
    """5,000 rows of one cell: each goes once to each of half of the cells around, and none is copied on the other side."""
    p = spark.range(5_000).selectExpr("id", "0.05 + id * 1e-7 AS x", "0.05 + id * 1e-7 AS y", "0.05 + id * 1e-7 AS z")
    left, right, _ = neighbours.dealt(p, p, Box((1.0, 1.0, 1.0)), 0.1, [], True)
    assert (left.count(), right.count()) == (14 * 5_000, 5_000)


def test_rows_are_dealt_where_they_are_near(spark):
    """A row goes to those cells alone that it can reach; of more rows in dense cells a block has more, so a row's copies stay as many."""
    p = spark.range(3_000).selectExpr("id", "0.01 + id * 1e-7 AS x", "0.05 AS y", "0.05 AS z")
    left, right, _ = neighbours.dealt(p, p.selectExpr("id", "x - 0.5 AS x", "y", "z"), Box((1.0, 1.0, 1.0)), 0.06, [], False)  # cells of 1 / 16
    assert (left.count(), right.count()) == (20 * 3_000, 3_000)
    for rows in (400_000, 800_000):
        p = spark.range(rows).selectExpr("id", "0.05 + id * 1e-9 AS x", "0.02 AS y", "0.05 AS z")
        left, right, _ = neighbours.dealt(p, p, Box((1.0, 1.0, 1.0)), 0.1, [], True)
        copies = (left.count() + right.count()) / rows
        assert 30 < copies < 80


@pytest.mark.parametrize("name", ["neighbour_pairs", "neighbours_between", "skin_reuse", "neighbour_series"])
def test_pairs_beyond_the_box(spark, beyond, name):
    assert agrees(spark, beyond, name) > 0


@pytest.mark.parametrize("name", ["neighbour_pairs", "skin_reuse"])
def test_pairs_are_joined_by_nothing(spark, beyond, name):
    """Pairs come from groups of near rows and are not shuffled or joined again."""
    plan = QUERIES[name](spark, beyond)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("FlatMapGroupsInArrow")]


NEAR_FORCES = [n for n in QUERIES if n.startswith("forces_") and n != "forces_full_custom"] + ["pressure", "harmonic_plus_pairs"]


@pytest.mark.parametrize("name", NEAR_FORCES)
def test_forces_make_no_rows_of_pairs(spark, beyond, name):
    assert "id_j" not in QUERIES[name](spark, beyond)._jdf.queryExecution().optimizedPlan().toString()


def test_springs_beyond_the_box(spark, beyond):
    """Agrees with its SQL, and no row is a pair."""
    assert agrees(spark, beyond, "forces_full_custom") == 60
    assert "id_j" not in QUERIES["forces_full_custom"](spark, beyond)._jdf.queryExecution().optimizedPlan().toString()
