"""Pair and external potentials as column expressions.

A pair potential maps the squared distance and parameter columns to
``(fval, energy)`` with ``fval = -U'(r)/r``. Parameters are read from columns of
a small table of species pairs (a, b) that is joined to the pairs; lengths are
absolute. ``cutoff`` wraps a potential by one of four truncations, whose
constants are worked out once per species pair (:func:`prepare`).

A potential that takes a second argument gets its parameters from it by name, columns or numbers, and so has values for
arrays of squared distances too (:func:`on_arrays`): pairs need not be rows. One that reads ``F.col`` has columns only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from inspect import signature
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.functions.vectors import integer_power

Pair = tuple[Column, Column]
Parameter = Callable[[str], Any]
Potential = Callable[..., Pair]

REGISTRY: dict[str, Potential] = {}


def register(name: str) -> Callable[[Potential], Potential]:
    """Make a potential known by name; users register their own like this."""

    def add(f: Potential) -> Potential:
        REGISTRY[name] = f
        return f

    return add


def valued(potential: Potential, rr: Any, p: Parameter = F.col) -> Pair:
    return potential(rr, p) if len(signature(potential).parameters) > 1 else potential(rr)


def on_arrays(potential: Potential) -> bool:
    """Whether a potential has values for arrays."""
    try:
        with np.errstate(all="ignore"):
            found = potential(np.ones(1), lambda _: 1.0)
        return all(isinstance(x, (np.ndarray, float)) for x in found)
    except Exception:  # one that is made of columns
        return False


def _sqrt(x: Any) -> Any:
    return F.sqrt(x) if isinstance(x, Column) else np.sqrt(x)


def _exp(x: Any) -> Any:
    return F.exp(x) if isinstance(x, Column) else np.exp(x)


@register("lennard_jones")
def lennard_jones(rr: Column, p: Parameter = F.col) -> Pair:
    s2 = p("sigma") * p("sigma")
    s = s2 / rr
    s3 = s * s * s
    return 48 * s * p("epsilon") * s3 * (s3 - 0.5) / s2, 4 * p("epsilon") * s3 * (s3 - 1)


@register("lennard_jones_simple")
def lennard_jones_simple(rr: Column, p: Parameter = F.col) -> Pair:
    s = 1 / rr
    s3 = s * s * s
    return 48 * s * s3 * (s3 - 0.5), 4 * s3 * (s3 - 1)


def mie(m: int, n: int) -> Potential:
    """Even exponents m > n."""
    if m % 2 or n % 2 or m <= n:
        raise ValueError("exponents must be even and m > n")
    c = m / (m - n) * (m / n) ** (n / (m - n))

    def f(rr: Column, p: Parameter = F.col) -> Pair:
        s2 = p("sigma") * p("sigma")
        s = s2 / rr
        rest, own = integer_power(s, (m - n) // 2), c * p("epsilon") * integer_power(s, n // 2)
        return 2 * s * own * (m // 2 * rest - n // 2) / s2, own * (rest - 1)

    return f


@register("morse")
def morse(rr: Column, p: Parameter = F.col) -> Pair:
    """Needs r_min and distortion besides epsilon and sigma.

    With x = (r_min - r) / w, w = sigma * distortion and a = 2 distortion^2 - 1 the energy
    is epsilon / a * (e^((a + 1) x) - (a + 1) e^x); its derivative by r, over -r, is the force value."""
    w, a = p("sigma") * p("distortion"), 2 * p("distortion") * p("distortion") - 1
    r = _sqrt(rr)
    x = (p("r_min") - r) / w
    wide, steep, scale = _exp(x), _exp((a + 1) * x), p("epsilon") / a
    return scale * (a + 1) * (steep - wide) / (w * r), scale * (steep - (a + 1) * wide)


def power_law(n: int) -> Potential:
    def f(rr: Column, p: Parameter = F.col) -> Pair:
        s = p("sigma") * p("sigma") / rr
        u = p("epsilon") * (integer_power(s, n // 2) if n % 2 == 0 else integer_power(_sqrt(s), n))
        return n * u / rr, u

    return f


def power_law_hard_core(n: int) -> Potential:
    """Singular at r_core (absolute)."""

    def f(rr: Column, p: Parameter = F.col) -> Pair:
        r = _sqrt(rr)
        d = p("sigma") / (r - p("r_core"))
        u = p("epsilon") * integer_power(d, n)
        return n * u / ((r - p("r_core")) * r), u

    return f


def hard_core(potential: Potential) -> Potential:
    """Any potential at the distance from the core's surface."""

    def f(rr: Column, p: Parameter = F.col) -> Pair:
        r = _sqrt(rr)
        s = r - p("r_core")
        fval, u = valued(potential, s * s, p)
        return fval * s / r, u

    return f


REGISTRY["mie_48_24"] = mie(48, 24)
REGISTRY["modified_lennard_jones"] = REGISTRY["mie_48_24"]
REGISTRY["power_law_12"] = power_law(12)
REGISTRY["power_law_hard_core_12"] = power_law_hard_core(12)


@dataclass(frozen=True)
class Spring:
    """k/2 r^2 with the same k for all pairs: linear in the squared distance."""

    stiffness: float

    def __call__(self, rr: Column) -> Pair:
        return F.lit(-float(self.stiffness)), 0.5 * self.stiffness * rr


TRUNCATIONS = ("sharp", "shifted", "force_shifted", "smooth_r4")


@dataclass(frozen=True)
class Truncated:
    """A potential that ends at the column r_cut."""

    potential: Potential
    kind: str = "shifted"
    smoothing: float = 0.005

    def __post_init__(self):
        if self.kind not in TRUNCATIONS:
            raise ValueError(f"unknown truncation {self.kind!r}")

    def prepare(self, params: DataFrame) -> DataFrame:
        """Add the energy and force at the cutoff to the species-pair table."""
        fval, u = valued(self.potential, F.col("r_cut") * F.col("r_cut"))
        return params.withColumns({"u_cut": u, "f_cut": fval * F.col("r_cut")})

    def __call__(self, rr: Column, p: Parameter = F.col) -> Pair:
        """Values for ``rr < r_cut**2``; pairs beyond are the caller's to drop."""
        fval, u = valued(self.potential, rr, p)
        if self.kind == "sharp":
            return fval, u
        if self.kind == "shifted":
            return fval, u - p("u_cut")
        r = _sqrt(rr)
        if self.kind == "force_shifted":
            return fval - p("f_cut") / r, u - p("u_cut") + (r - p("r_cut")) * p("f_cut")
        x = (r - p("r_cut")) / self.smoothing
        x4 = x * x * x * x
        g, slope = x4 / (1 + x4), 4 * x * x * x / ((1 + x4) * (1 + x4)) / self.smoothing
        u = u - p("u_cut")
        return g * fval - slope * u / r, g * u


def species_pairs(spark, rows: Sequence[dict]) -> DataFrame:
    """The parameter table from dicts with a, b and parameters; given for a <= b
    or both ways."""
    both = {(r["a"], r["b"]): r for r in rows}
    both |= {(b, a): r | {"a": b, "b": a} for (a, b), r in both.items() if (b, a) not in both}
    names = [n for n in rows[0] if n not in ("a", "b")]
    return spark.createDataFrame([(a, b, *(float(r[n]) for n in names)) for (a, b), r in sorted(both.items())], "a int, b int, " + ", ".join(f"{n} double" for n in names))


def harmonic(position: Sequence[Column], centre: Sequence[float], stiffness: float) -> tuple[list[Column], Column]:
    """Force components and energy of K/2 (r - r0)^2."""
    d = [r - c for r, c in zip(position, centre)]
    energy = d[0] * d[0]
    for x in d[1:]:
        energy = energy + x * x
    return [-stiffness * x for x in d], 0.5 * stiffness * energy


@dataclass(frozen=True)
class Wall:
    """A 9-3 wall: plane ``r . normal = offset``."""

    normal: tuple[float, ...]
    offset: float
    epsilon: float
    sigma: float
    wetting: float
    cutoff: float


def planar_walls(position: Sequence[Column], walls: Sequence[Wall], smoothing: float) -> tuple[list[Column], Column]:
    """Force components and energy, summed over walls; smooth at the cutoff. The
    force is the derivative of the energy on both sides of a wall."""
    force, energy = [F.lit(0.0) for _ in position], F.lit(0.0)
    for w in walls:
        size = sum(c * c for c in w.normal) ** 0.5
        normal = [c / size for c in w.normal]
        d = position[0] * normal[0]
        for r, c in zip(position[1:], normal[1:]):
            d = d + r * c
        d = d - w.offset
        near, side = F.abs(d), F.signum(d)
        s = w.sigma / near
        s3 = s * s * s
        cut3 = (w.sigma / w.cutoff) ** 3
        u = w.epsilon * s3 * (2 / 15 * s3 * s3 - w.wetting) - w.epsilon * cut3 * (2 / 15 * cut3 * cut3 - w.wetting)
        f = 3 * w.epsilon * s3 * (3 * (2 / 15) * s3 * s3 - w.wetting) / near
        x = (near - w.cutoff) / smoothing
        x4 = x * x * x * x
        g, slope = x4 / (1 + x4), 4 * x * x * x / ((1 + x4) * (1 + x4)) / smoothing
        inside = (near < w.cutoff) & (near > 0)
        f = F.when(inside, (g * f - slope * u) * side).otherwise(0.0)
        force = [a + f * c for a, c in zip(force, normal)]
        energy = energy + F.when(inside, g * u).otherwise(0.0)
    return force, energy
