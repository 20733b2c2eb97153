"""State variables of particle groups: one aggregation per group of keys.

Means are per particle; ``total_force`` and the stress tensor are sums. Empty
groups give null. Potential terms need en_pot and the stress columns of
:mod:`moraine.operators.forces`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.functions.box import Box, square, total
from moraine.functions.vectors import stress_outer
from moraine.operators.forces import stress_names
from moraine.operators.groups import sampled_steps
from moraine.sources.scratch import written


def variables(box: Box, volume: float | Callable[[], float] | None = None) -> dict[str, Column]:
    """All aggregates by name; vectors have one column per component."""
    d, axes = box.dimension, box.axes
    n, m = F.count("*").cast("double"), F.col("mass")
    size = F.lit(float(box.volume if volume is None else volume() if callable(volume) else volume))
    v = [F.col("v" + a) for a in axes]

    def mean(c: Column) -> Column:
        return F.try_divide(F.sum(c), n)

    kinetic = mean(0.5 * m * total([square(x) for x in v]))
    virial = mean(total([F.col("s" + a + a) for a in axes]))
    density, temperature = n / size, 2 * kinetic / d
    out = {
        "particle_number": F.count("*"),
        "volume": F.max(size),
        "density": density,
        "kinetic_energy": kinetic,
        "potential_energy": mean(F.col("en_pot")),
        "internal_energy": kinetic + mean(F.col("en_pot")),
        "temperature": temperature,
        "virial": virial,
        "pressure": density * (temperature + virial / d),
        "mean_mass": mean(m),
    }
    out |= {f"total_force_{a}": F.sum("f" + a) for a in axes}
    out |= {f"center_of_mass_velocity_{a}": F.try_divide(F.sum(m * x), F.sum(m)) for a, x in zip(axes, v)}
    out |= {f"center_of_mass_{a}": F.try_divide(F.sum(m * (F.col(a) + F.col("i" + a) * length)), F.sum(m)) for a, length in zip(axes, box.lengths)}
    out |= {"stress_" + s[1:]: F.sum(F.col(s) + m * p) for s, p in zip(stress_names(axes), stress_outer(v))}
    return out


_COMPONENTS = ("x", "y", "z", "xx", "yy", "zz", "xy", "xz", "yz")
DEFAULT = ("potential_energy", "pressure", "temperature", "center_of_mass_velocity")


def thermodynamics(particles: DataFrame, box: Box, names: Sequence[str] | dict[str, str] = DEFAULT, by: Sequence[str] = (),
                   volume: float | Callable[[], float] | None = None) -> DataFrame:
    """The named state variables, per step (if there is one) and ``by``. A dict
    maps new names to variables; a vector's name stands for its components."""
    known = variables(box, volume)
    keys = [*(["step"] if "step" in particles.columns and "step" not in by else []), *by]
    if "time" in particles.columns and "step" in keys:
        keys.insert(keys.index("step") + 1, "time")
    chosen = []
    for alias, name in (names.items() if isinstance(names, dict) else [(n, n) for n in names]):
        own = [k for k in known if k == name or k.startswith(name + "_") and k[len(name) + 1 :] in _COMPONENTS]
        if not own:
            raise ValueError(f"unknown state variable {name!r}")
        chosen += [known[k].alias(alias + k[len(name) :]) for k in own]
    return particles.groupBy(*keys).agg(*chosen) if keys else particles.agg(*chosen)


def write_series(writer, particles: DataFrame, box: Box, names: Sequence[str] | dict[str, str] = DEFAULT, every: int = 1, location: str = "observables",
                 fluctuating: bool = False, volume: float | None = None) -> None:
    """Store state variables of every ``every``-th step in a trajectory store:
    one series ``location/name`` (step, time and its components) for each name.
    The volume, and unless the group is ``fluctuating`` the number of particles and
    the density, don't change: they are written once, as static elements."""
    constants = ["volume"] + ([] if fluctuating else ["particle_number", "density"])
    chosen = {n: n for n in names} if not isinstance(names, dict) else dict(names)
    chosen = {k: v for k, v in chosen.items() if v not in constants} | ({n: n for n in ("particle_number", "density")} if fluctuating else {})
    rows = sampled_steps(particles, 0, every)
    first = rows.where(F.col("step") == (rows.agg(F.min("step")).first()[0] or 0))
    once = thermodynamics(first.drop("step", "time"), box, constants, volume=volume)
    for n in constants:
        writer.replace(f"{location}/{n}", once.select(F.col(n).alias("value")).coalesce(1))
    series = written(thermodynamics(rows, box, chosen, volume=volume))  # one row a step
    for n in chosen:
        own = [c for c in series.columns if c == n or c.startswith(n + "_") and c[len(n) + 1 :] in _COMPONENTS]
        writer.append(f"{location}/{n}", series.select("step", "time", *[F.col(c).alias("value" + c[len(n) :]) for c in own]))


def rescaling_factor(particles: DataFrame, box: Box, temperature: float | None = None, internal_energy: float | None = None) -> DataFrame:
    """One row: the drift velocity and the factor that, after removing the drift,
    brings the group to a temperature or to a total energy per particle."""
    drift = [F.try_divide(F.sum(F.col("mass") * F.col("v" + a)), F.sum("mass")) for a in box.axes]
    moved = total([F.sum(F.col("mass") * square(F.col("v" + a))) - F.sum("mass") * square(d) for a, d in zip(box.axes, drift)])
    kinetic = F.try_divide(moved / 2, F.count("*").cast("double"))
    if (temperature is None) == (internal_energy is None):
        raise ValueError("give either a temperature or an internal energy")
    wanted = F.lit(temperature * box.dimension / 2) if temperature is not None else internal_energy - F.avg("en_pot")
    return particles.agg(*[d.alias("drift_" + a) for d, a in zip(drift, box.axes)], F.sqrt(F.try_divide(wanted, kinetic)).alias("factor"))
