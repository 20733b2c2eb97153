"""The two projections of which integration steps consist.

Simulations themselves are no work for Spark: a step would be several jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.functions.box import Box, reduce_periodic


def drift(particles: DataFrame, box: Box, dt: float) -> DataFrame:
    """r += v dt, wrapped."""
    return reduce_periodic(particles.withColumns({a: F.col(a) + dt * F.col("v" + a) for a in box.axes}), box)


def kick(particles: DataFrame, box: Box, dt: float) -> DataFrame:
    """v += f dt / m."""
    return particles.withColumns({"v" + a: F.col("v" + a) + dt * F.col("f" + a) / F.col("mass") for a in box.axes})
