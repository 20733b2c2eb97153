"""Stores, streams and the entry point."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from moraine.functions.box import Box
from moraine.operators.correlation import BlockingScheme, mean_square_displacement
from moraine.operators.thermodynamics import write_series
from moraine.sources.store import Reader, StoreError, Writer, check, static_species
from moraine.streaming import online

DATA = "/root/testdata/sf0.001"


def rows(spark, steps, n=3):
    return spark.createDataFrame([(s, s * 0.5, i, float(i + s), i % 2) for s in steps for i in range(n)], "step long, time double, id long, x double, species int")


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert not check(spark, path)
    w = Writer(spark, path, author="someone")
    w.append("particles/all", rows(spark, [0, 2, 4]))
    for steps in ([4], [3, 6]):
        with pytest.raises(StoreError):
            w.append("particles/all", rows(spark, steps))
    w.append("particles/all", rows(spark, [6]))
    with pytest.raises(StoreError):
        Writer(spark, path, overwrite=True).append("x", rows(spark, [0, 5]).withColumn("time", -F.col("time")))
    w = Writer(spark, path, overwrite=True)
    w.append("particles/all", rows(spark, [0, 2, 4]))
    w.append("particles/all", rows(spark, [6]))
    w.box(Box((2.0, 3.0)))
    w.replace("static", rows(spark, [0]).select("id"))
    w.replace("static", rows(spark, [0]).select("id", "x"))
    w.append_averaged("observables/u", spark.createDataFrame([(0, 0.0, 1.0, 0.1, 5)], "step long, time double, value double, error double, count long"))
    r = Reader(spark, path)
    assert check(spark, path) and r.box() == Box((2.0, 3.0)) and r.element("static").columns == ["id", "x"]
    assert {x["step"] for x in r.read_at_step("particles/all", -1).collect()} == {6}
    assert r.read_at_step("particles/all", -3).first()["step"] == 4 and r.read_at_step("particles/all", 2).count() == 3
    assert r.read_at_time("particles/all", -0.0).first()["step"] == 6 and r.read_at_time("particles/all", 0.0).first()["step"] == 0
    assert r.read_at_time("particles/all", -1.0).first()["step"] == 4
    for bad in (3, 99):
        with pytest.raises(StoreError):
            r.read_at_step("particles/all", bad)
    with pytest.raises(StoreError):
        r.element("nothing")
    assert r.particles("all", ["x"]).columns == ["step", "time", "id", "x"]
    w.particles("ends", rows(spark, [0, 1, 2]), ["x"])
    assert {x["step"] for x in r.particles("ends").collect()} == {0, 2}
    p = rows(spark, [0]).drop("step", "time")
    assert {x["x"] for x in r.restore(p, "all", ["x"]).collect()} == {6.0, 7.0, 8.0}
    assert static_species(r.element("particles/all")).count() == 3
    with pytest.raises(StoreError):
        Reader(spark, str(tmp_path / "none"))


def test_store_is_pruned(spark, tmp_path):
    path = str(tmp_path / "store")
    Writer(spark, path).append("particles/all", rows(spark, range(3)))
    plan = Reader(spark, path).particles("all", ["x"]).where("step = 2")._jdf.queryExecution().executedPlan().toString()
    assert "species" not in plan and "EqualTo(step,2)" in plan


def test_streamed_correlation_equals_batch(spark, tmp_path):
    scheme = BlockingScheme(1.0, 12.0, size=4)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    table = spark.createDataFrame([(i, t, float((i * 31 + t * t) % 17)) for i in range(3) for t in range(40)], "id long, step long, x double")
    for k in range(2):  # two files, two micro-batches
        table.where((F.col("step") >= 20 * k) & (F.col("step") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
    parts = online.correlate_stream(stream, scheme, ["x"], lambda a, b: (b[0] - a[0]) ** 2)
    q = parts.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["level"], r["lag_idx"]): r for r in online.finished(spark.read.parquet(out), scheme).collect()}
    for r in mean_square_displacement(table, scheme, ["x"]).collect():
        own = got.pop((r["level"], r["lag_idx"]))
        assert own["count"] == r["count"] and own["value"] == pytest.approx(r["value"]) and own["error"] == pytest.approx(r["error"], abs=1e-9)
    assert not got


def test_overwrite_empties_the_store(spark, tmp_path):
    path = str(tmp_path / "store")
    w = Writer(spark, path)
    w.append("old", rows(spark, [0, 1]))
    w.replace("fixed", rows(spark, [0]).select("id"))
    with pytest.raises(Exception):
        Writer(spark, path)
    Writer(spark, path, overwrite=True).append("new", rows(spark, [0]))
    r = Reader(spark, path)
    assert r.element("new").count() == 3
    for name in ("old", "fixed"):
        with pytest.raises(StoreError):
            r.element(name)


def test_failed_appends_are_never_read(spark, tmp_path):
    w = Writer(spark, str(tmp_path / "store"))
    w.append("a", rows(spark, [0, 5]))
    for bad in (rows(spark, [5, 6]), rows(spark, [7]).withColumn("step", F.lit(None).cast("long")), rows(spark, [8, 9]).withColumn("time", F.col("id").cast("double"))):
        with pytest.raises(StoreError):
            w.append("a", bad)
    w.append("a", rows(spark, [5]).limit(0))
    r = Reader(spark, str(tmp_path / "store"))
    assert {x["step"] for x in r.element("a").collect()} == {0, 5} and r.steps("a").count() == 2
    again = Writer.resume(spark, str(tmp_path / "store"))
    again.append("a", rows(spark, [6]))  # a writer that comes back finds the last step
    assert Reader(spark, str(tmp_path / "store")).read_at_step("a", -1).count() == 3


def test_of_two_writers_one_gets_an_error(spark, tmp_path):
    path = str(tmp_path / "store")
    Writer(spark, path).append("a", rows(spark, [0]))
    one, two = Writer.resume(spark, path), Writer.resume(spark, path)
    assert one._previous("a") == two._previous("a")  # both have seen the same state
    one.append("a", rows(spark, [1]))
    with pytest.raises(StoreError, match="another writer"):
        two.append("a", rows(spark, [1]))
    assert sorted(x["step"] for x in Reader(spark, path).steps("a").collect()) == [0, 1] and Reader(spark, path).read_at_step("a", 1).count() == 3
    with pytest.raises(StoreError, match="does not follow"):
        two.append("a", rows(spark, [1]))  # now it has seen the other's step
    two.append("a", rows(spark, [2]))
    assert Reader(spark, path).read_at_step("a", -1).count() == 3
    with pytest.raises(StoreError):
        Writer.resume(spark, str(tmp_path / "none"))


def test_only_batches_of_the_steps_are_opened(spark, tmp_path):
    w = Writer(spark, str(tmp_path / "store"))
    for first in (0, 10, 20, 30):
        w.append("a", rows(spark, [*range(first, first + 10)]))
    r = Reader(spark, str(tmp_path / "store"))
    some = r.read_steps("a", 12, 24, 4)
    assert sorted({x["step"] for x in some.collect()}) == [12, 16, 20, 24] and some.count() == 12
    assert {f.split("batch-")[1][:32] for f in some.inputFiles()} == {x["batch"] for x in r.steps("a").where("step in (12, 20)").collect()}
    assert r.read_steps("a", 100, 200).count() == 0 and r.read_steps("a", 100, 200).columns == r.element("a").columns


def test_a_growing_store_is_followed(spark, tmp_path):
    path, seen = str(tmp_path / "store"), []
    w = Writer(spark, path)
    w.append("a", rows(spark, [0, 1]))
    w.append("a", rows(spark, [2]))

    def start():
        return Reader(spark, path).follow("a", lambda b, n: seen.append((n, sorted({x["step"] for x in b.collect()}))), str(tmp_path / "state"))

    q = start()
    q.processAllAvailable()
    assert seen == [(0, [0, 1]), (1, [2])]
    with pytest.raises(StoreError):
        w.append("a", rows(spark, [1]))  # what fails is never streamed
    w.append("a", rows(spark, [5]))
    q.processAllAvailable()
    q.stop()
    w.append("a", rows(spark, [6, 7]))
    q = start()  # goes on where it was
    q.processAllAvailable()
    q.stop()
    assert seen[2:] == [(2, [5]), (3, [6, 7])]


def test_a_step_is_read_from_its_row_groups(spark, tmp_path):
    w = Writer(spark, str(tmp_path / "store"))
    for first in (0, 100):
        w.append("a", spark.range(3000).selectExpr(f"{first} + id % 50 as step", f"({first} + id % 50) * 0.5 as time", "id", "id * 1.0 as x"))
    found = Reader(spark, str(tmp_path / "store")).read_at_step("a", -1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(step,149)" in plan and found.count() == 60 and len(found.inputFiles()) < len(Reader(spark, str(tmp_path / "store")).element("a").inputFiles())


def test_series_of_state_variables(spark, tmp_path):
    line = Box((10.0,))
    p = spark.range(60).selectExpr("id div 6 as step", "(id div 6) * 0.1D as time", "id % 6 as id", "1D as mass", "(id % 7) - 3D as vx", "0D as x", "0 as ix")
    write_series(Writer(spark, str(tmp_path / "s")), p, line, ["temperature", "particle_number"], 3)
    r = Reader(spark, str(tmp_path / "s"))
    assert r.element("observables/particle_number").collect() == [(6,)] and r.element("observables/volume").first()[0] == 10 and r.element("observables/density").first()[0] == 0.6
    assert [x["step"] for x in r.element("observables/temperature").sort("step").collect()] == [0, 3, 6, 9]


def test_late_steps_are_errors():
    c = online.OnlineCorrelator(BlockingScheme(1.0, 5.0, size=3))
    add = lambda *steps: list(c.add(np.array(steps), [np.zeros(len(steps))], lambda a, b: b[0] - a[0]))
    add(2, 3)
    for late in ((3,), (5, 4)):
        with pytest.raises(ValueError):
            add(*late)


def test_streamed_correlation_in_small_batches_and_after_a_restart(spark, tmp_path):
    """Three series in eleven micro-batches, a stop in between, and the batch operator's result."""
    from moraine.operators import correlation as tcf

    scheme, g = BlockingScheme(0.5, 12.0, size=4), np.random.default_rng(3)
    data = [(i, s, float(x)) for i in range(3) for s, x in enumerate(np.cumsum(g.normal(size=66)))]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    add = lambda k: spark.createDataFrame([r for r in data if 6 * k <= r[1] < 6 * k + 6], "id long, step long, x double").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("id long, step long, x double").option("maxFilesPerTrigger", 1).parquet(source)
        parts = online.correlate_stream(stream, scheme, ["x"], lambda a, b: (b[0] - a[0]) ** 2)
        q = parts.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").start()
        q.processAllAvailable()
        q.stop()

    for k in range(4):
        add(k)
    run()
    for k in range(4, 11):
        add(k)
    run()
    got = online.finished(spark.read.schema(f"id long, {online._OUT}").parquet(out), scheme)
    want = tcf.mean_square_displacement(spark.createDataFrame(data, "id long, step long, x double"), scheme, ("x",))
    got, want = ({(r["level"], r["lag_idx"]): r for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and len(want) > 8
    for k, w in want.items():
        assert got[k]["count"] == w["count"] and got[k]["value"] == pytest.approx(w["value"], rel=1e-9)
    add(0)  # late steps
    with pytest.raises(Exception, match="do not grow"):
        run()


def test_open_origins_survive_as_rows():
    scheme, x = BlockingScheme(1.0, 9.0, size=3), np.arange(40.0)
    square = lambda a, b: (b[0] - a[0]) ** 2 + 0 * b[1]
    whole, parts = online.OnlineCorrelator(scheme), []
    want = [(k, lag, len(v), v.sum()) for k, lag, v in whole.add(np.arange(40), [x, x], square)]
    now = online.OnlineCorrelator(scheme)
    for a in range(0, 40, 7):
        steps = np.arange(a, min(a + 7, 40))
        parts += list(now.add(steps, [x[steps], x[steps]], square))
        rows, last = list(now.opened()), now.last
        assert len(rows) <= len(scheme.levels()) * 3
        now = online.OnlineCorrelator(scheme)
        now.resume(last, rows)
    got = {}
    for k, lag, v in parts:
        n, total = got.get((k, lag), (0, 0.0))
        got[k, lag] = n + len(v), total + v.sum()
    assert got == {(k, lag): (n, s) for k, lag, n, s in want}


def test_idle_series_are_closed(spark, tmp_path):
    import time

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    add = lambda i, steps: spark.createDataFrame([(i, s, 1.0) for s in steps], "id long, step long, x double").coalesce(1).write.mode("append").parquet(source)
    add(1, range(4))
    stream = spark.readStream.schema("id long, step long, x double").parquet(source)
    parts = online.correlate_stream(stream, BlockingScheme(1.0, 5.0, size=3), ["x"], lambda a, b: a[0] * b[0], idle_ms=200)
    q = parts.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").start()
    done = lambda n: spark.read.schema(f"id long, {online._OUT}").parquet(out).where(f"id = {n}").count() > 0

    def wait(until):
        for _ in range(240):  # timers keep the query busy, so it never has all available
            if until():
                return
            time.sleep(0.25)
        raise AssertionError("the stream took too long")

    try:
        wait(lambda: os.path.isdir(out) and done(1))
        time.sleep(0.5)
        add(2, range(4))  # another series makes time pass, so that the first one is closed
        wait(lambda: done(2))
        time.sleep(1.0)
        add(1, range(4, 6))
        wait(lambda: q.exception() is not None)
        assert "was closed" in str(q.exception())
    finally:
        q.stop()


def test_streamed_variance_of_large_means(spark):
    scheme = BlockingScheme(1.0, 5.0, size=3)
    c, parts = online.OnlineCorrelator(scheme), []
    seen = [t for t in range(100) if t % (scheme.levels()[0][0] * scheme.levels()[0][1]) == 0]
    for steps in (np.arange(0, 50), np.arange(50, 100)):
        parts += [(k, lag, len(v), float(v.mean()), float(v.var())) for k, lag, v in c.add(steps, [1e9 + steps % 2 * 1.0], lambda a, b: b[0]) if lag == 0 and k == 0]
        expected = sum(p[2] for p in parts)
    got = online.finished(spark.createDataFrame(parts, online._OUT), scheme).first()
    assert got["count"] == expected and got["error"] == pytest.approx(float(np.std(1e9 + np.array(seen) % 2)) / (expected - 1) ** 0.5, rel=1e-6)


def test_windows_are_written_by_the_executors(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(2):
        spark.range(30 * k, 30 * k + 30).selectExpr("id as step", "cast(id as double) as value").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("step long, value double").option("maxFilesPerTrigger", 1).parquet(source)
    q = online.write_windows(online.windowed_stream(stream, "value", 20), str(tmp_path / "out"), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    got = online.latest_windows(spark, str(tmp_path / "out"), "window long, count long, sum double").sort("window").collect()
    assert [tuple(r) for r in got] == [(0, 20, 190.0), (20, 20, 590.0), (40, 20, 990.0)]


def test_windows_are_compacted(spark, tmp_path):
    source, out, state, schema = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "window long, count long, sum double"
    states = lambda: [tuple(r) for r in online.latest_windows(spark, out, schema).sort("window").collect()]
    assert states() == []

    def run(first, last):
        for k in range(first, last):
            spark.range(10 * k, 10 * k + 10).selectExpr("id as step", "cast(id as double) as value").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("step long, value double").option("maxFilesPerTrigger", 1).parquet(source)
        q = online.write_windows(online.windowed_stream(stream, "value", 25), out, state)
        q.processAllAvailable()
        q.stop()
        return states()

    want = lambda n: [(w, min(25, n - w), float(sum(range(w, min(w + 25, n))))) for w in range(0, n, 25)]
    assert run(0, 4) == want(40)
    online.compact_windows(spark, out, schema)
    assert states() == want(40) and sorted(n for n in os.listdir(out) if n[0] in "bu") == ["batch=3", "upto=2"]
    assert run(4, 6) == want(60)
    online.compact_windows(spark, out, schema)
    online.compact_windows(spark, out, schema)  # nothing is left to do
    assert states() == want(60) and sorted(n for n in os.listdir(out) if n[0] in "bu") == ["batch=5", "upto=4"]


def test_hooks_and_estimates(spark):
    seen = []
    online.with_hooks(lambda b, n: seen.append((b.count(), n)), lambda b, n: seen.append("second"))(spark.range(3), 7)
    assert seen == [(3, 7), "second"]
    assert online.runtime_left(10, 110, 36.0) == "6.0 min" and online.runtime_left(1, 2, 5.0) == "5 s"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
