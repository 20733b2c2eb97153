"""Centroid clustering by Yinyang grouping, in exact integer arithmetic.

A vector's components become integers ``floor(scale * x)``. The first centroids
are the vectors whose hashed ids are smallest; each round assigns every vector
to its nearest centroid (squared Euclidean distance, ties: the smaller number) and
moves every non-empty centroid to the componentwise ``floor(sum / count)``.

Yinyang: the centroids are put into about ``k / 10`` groups once, by where they
start. A vector keeps an upper bound of the distance to its own centroid and
one lower bound per group, of the distance to all other centroids of that group.
When centroids have moved, bounds follow by their drifts; then

1. global filter: a vector whose least lower bound is above its upper bound
   (as it is, then with the distance to its own centroid made exact) stays;
2. group filter: only groups whose lower bound doesn't exceed the distance are looked at;
3. of these, only centroids that the group's old bound less their own drift lets
   survive are measured, exactly, in integers.

Bounds are doubles with an outward slack of ``_SLACK``, compared so that a tie is always
measured; so no filter changes a result. Which centroids move is told by those
vectors alone that changed their cluster: tasks add them up, Spark adds the tasks
up, and ``k`` times ``dims`` numbers reach the driver, whatever the input. Each
round's vectors with their bounds are written to the shared folder, and those of the round
before are deleted; a round of centroids that all stay ends the work, as nothing can change.

Edge cases: vectors that are null, have another number of components or hold a null or
non-finite one are left out; with fewer kept vectors than ``k`` each is a
first centroid; equal first centroids stay, the larger number without vectors of its own;
repeated rows and repeated ids are vectors of their own; first centroids of equal hash
go by their components; null ids have no hash and come last; an empty table gives no rows;
other columns are ignored. Components whose integer reaches 2**27 in size raise an error,
for their squared distances would not fit into 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import Tables, cut, table

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, "2:"
PER_GROUP = 10
MOST = 1 << 27  # integers stay below this in size
_SLACK = 1e-12
_STATE = pa.schema([("vec_id", pa.int64()), ("codes", pa.binary()), ("cluster", pa.int32()), ("before", pa.int32()), ("upper", pa.float64()), ("lower", pa.binary())])
_STATE_DDL = "vec_id long, codes binary, cluster int, before int, upper double, lower binary"


def integer_codes(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and codes, the little-endian 32-bit integers of each vector that is kept."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(F.coalesce((F.size(v) == dims) & finite, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.floor(scale * b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims))
            if np.abs(x).max() >= MOST:
                raise ValueError(f"a component times {scale} reaches {MOST}: squared distances would not fit into 64 bits")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())], ["vec_id", "codes"])

    return rows.mapInArrow(run, "vec_id long, codes binary")


def matrix(codes: pa.Array | list[bytes], dims: int) -> np.ndarray:
    raw = b"".join(codes.to_pylist() if isinstance(codes, pa.Array) else codes)
    return np.frombuffer(raw, "<i4").reshape(-1, dims).astype(np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` from all rows of ``c``."""
    small = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) ** 2 * x.shape[1] < 1 << 50
    kind = np.float64 if small else np.int64  # sums of these doubles are exact
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)


def centroid_groups(c: np.ndarray, per_group: int = PER_GROUP) -> np.ndarray:
    """The group of each centroid: a few rounds of means over the centroids
    themselves, begun with ones far from each other; groups are numbered from 0 without gaps."""
    want = max(1, len(c) // per_group)
    seeds = [0]
    while len(seeds) < want:
        seeds.append(int(squares(c, c[seeds]).min(1).argmax()))
    means = c[seeds].astype(float)
    for _ in range(5):
        group = ((c[:, None, :] - means[None]) ** 2).sum(2).argmin(1)
        means = np.stack([c[group == g].mean(0) if (group == g).any() else means[g] for g in range(want)])
    return np.unique(group, return_inverse=True)[1]


def first_bounds(x: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) of every row by measuring all distances."""
    d = squares(x, c)
    cluster = d.argmin(1)  # the first of equal ones
    root = np.sqrt(d.astype(float))
    upper = root[np.arange(len(x)), cluster]
    root[np.arange(len(x)), cluster] = np.inf
    lower = np.stack([root[:, group == g].min(1) for g in range(group.max() + 1)], 1)
    return cluster, upper * (1 + _SLACK), lower * (1 - _SLACK)


def next_bounds(x: np.ndarray, c: np.ndarray, drift: np.ndarray, group: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """(cluster, upper, lower, measured) after the centroids moved to ``c``, each by
    ``drift``; ``measured`` counts the distances that had to be computed."""
    groups = group.max() + 1
    far = np.array([drift[group == g].max() for g in range(groups)])
    old, cluster = lower, cluster.copy()
    upper = (upper + drift[cluster]) * (1 + _SLACK)
    lower = old - far - _SLACK * (1 + np.where(np.isinf(old), 0, np.abs(old)) + far)
    rows = np.flatnonzero(lower.min(1) <= upper)  # global filter
    measured = len(rows)
    if len(rows):
        own = ((x[rows] - c[cluster[rows]]) ** 2).sum(1)
        upper[rows] = np.sqrt(own.astype(float)) * (1 + _SLACK)
        still = lower[rows].min(1) <= upper[rows]
        rows, best = rows[still], own[still]
    if not len(rows):
        return cluster, upper, lower, measured
    was, at, limit = cluster[rows], cluster[rows].copy(), upper[rows]
    bound = np.full((len(rows), len(c)), np.inf)  # of each centroid that was looked at, from below
    seen = lower[rows] <= limit[:, None]  # group filter
    bound[np.arange(len(rows)), was] = np.sqrt(best.astype(float)) * (1 - _SLACK)
    for j in range(len(c)):
        there = np.flatnonzero(seen[:, group[j]] & (was != j))
        least = old[rows[there], group[j]] - drift[j] - _SLACK * (1 + limit[there] + drift[j])
        bound[there, j] = least
        there = there[least <= limit[there]]  # the centroid survives
        d = ((x[rows[there]] - c[j]) ** 2).sum(1)
        measured += len(there)
        bound[there, j] = np.sqrt(d.astype(float)) * (1 - _SLACK)
        nearer = (d < best[there]) | ((d == best[there]) & (j < at[there]))
        at[there[nearer]], best[there[nearer]] = j, d[nearer]
    cluster[rows] = at
    upper[rows] = np.sqrt(best.astype(float)) * (1 + _SLACK)
    bound[np.arange(len(rows)), at] = np.inf
    fresh = np.stack([bound[:, group == g].min(1) for g in range(groups)], 1)
    # a group that was not looked at keeps its bound, now also below the centroid that was left
    lower[rows] = np.where(seen, fresh, np.minimum(lower[rows], fresh))
    return cluster, upper, lower, measured


def _state(b: pa.RecordBatch, cluster, before, upper, lower) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(before, pa.int32()), pa.array(upper), pa.array([r.tobytes() for r in lower], pa.binary())], schema=_STATE)


def first_state(codes: DataFrame, c: np.ndarray, group: np.ndarray) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                cluster, upper, lower = first_bounds(matrix(b.column(1), c.shape[1]), c, group)
                yield _state(b, cluster, np.full(len(cluster), -1), upper, lower)

    return codes.mapInArrow(run, _STATE_DDL)


def next_state(state: DataFrame, c: np.ndarray, drift: np.ndarray, group: np.ndarray) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                before = b.column(2).to_numpy()
                lower = np.frombuffer(b"".join(b.column(5).to_pylist()), np.float64).reshape(b.num_rows, -1)
                cluster, upper, lower, _ = next_bounds(matrix(b.column(1), c.shape[1]), c, drift, group, before, b.column(4).to_numpy(), lower)
                yield _state(b, cluster, before, upper, lower)

    return state.mapInArrow(run, _STATE_DDL)


def changes(state: DataFrame, k: int, dims: int) -> np.ndarray:
    """What each cluster's sums (and, last, its count) gain by the vectors that changed."""

    def run(batches):
        total = np.zeros((k, dims + 1), np.int64)
        for b in batches:
            x = np.c_[matrix(b.column(2), dims), np.ones(b.num_rows, np.int64)]
            before, cluster = b.column(0).to_numpy(), b.column(1).to_numpy()
            np.add.at(total, cluster, x)
            left = before >= 0
            np.subtract.at(total, before[left], x[left])
        own, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(place, pa.int32()), pa.array(total[own, place])], ["cluster", "place", "part"])

    moved = state.where("cluster != before").select("before", "cluster", "codes").mapInArrow(run, "cluster int, place int, part long")
    out = np.zeros((k, dims + 1), np.int64)
    for r in moved.groupBy("cluster", "place").agg(F.sum("part").alias("part")).collect():  # k * (dims + 1) numbers at most
        out[r["cluster"], r["place"]] = r["part"]
    return out


def yinyang_clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """One row per kept vector (vec_id, embedding): vec_id, cluster, distance
    (squared), cluster_inertia, inertia, centroid_sha256 and centroid, the final
    integers of its cluster."""
    if k < 1 or rounds < 0:
        raise ValueError("k must be at least 1 and rounds at least 0")
    spark = vectors.sparkSession
    out = "vec_id long, cluster int, distance long"
    with Tables() as t:
        codes = t.cut(integer_codes(vectors, dims, scale))
        hashed = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
        first = codes.orderBy(hashed.asc_nulls_last(), "codes").limit(k).select("codes").collect()
        if not first:
            return spark.createDataFrame([], out + ", cluster_inertia long, inertia long, centroid_sha256 string, centroid array<int>")
        c = matrix([bytes(r[0]) for r in first], dims)
        k, group = len(c), centroid_groups(c)
        state, total = t.cut(first_state(codes, c, group)), np.zeros((k, dims + 1), np.int64)
        t.drop(codes)
        for _ in range(rounds):
            total += changes(state, k, dims)
            n = total[:, -1:]
            moved = np.where(n > 0, total[:, :-1] // np.maximum(n, 1), c)
            drift = np.sqrt(((moved - c) ** 2).sum(1).astype(float)) * (1 + _SLACK)
            if not drift.any():
                break
            c, before = moved, state
            state = t.cut(next_state(before, c, drift, group))
            t.drop(before)

        def finish(batches):
            for b in batches:
                cluster = b.column(1).to_numpy()
                d = ((matrix(b.column(2), dims) - c[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d)], ["vec_id", "cluster", "distance"])

        told = cut(state.select("vec_id", "cluster", "codes").mapInArrow(finish, out))
    inertia = {r["cluster"]: r["n"] for r in told.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # k rows
    rows = [(j, n, sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest(), c[j].tolist()) for j, n in inertia.items()]
    per = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<int>")
    return told.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def op11_yinyang_grouping(spark, sf_dir: str) -> DataFrame:
    return yinyang_clusters(table(spark, sf_dir, "embeddings")).drop("centroid")


def _sql() -> str:
    """The same rounds by measuring every distance: integers in doubles are exact."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {DIMS})""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}' || vec_id), x) - 1)::INT AS j, x FROM v
  WHERE vec_id IS NOT NULL QUALIFY row_number() OVER (ORDER BY sha256('{SEED}' || vec_id), x) <= {K})""",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x), j := c.j)) AS s
  FROM v CROSS JOIN c{i} c GROUP BY r)""")
        if i < ROUNDS:
            parts.append(f"""m{i} AS (SELECT j, list(mean ORDER BY p) AS x FROM (SELECT j, p, floor(sum(e::HUGEINT) / count(*)) AS mean
  FROM (SELECT a.s.j AS j, unnest(v.x)::BIGINT AS e, unnest(range({DIMS})) AS p FROM a{i} a JOIN v USING (r)) GROUP BY j, p) GROUP BY j)""")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (j))")
    return f"""WITH {", ".join(parts)}
SELECT v.vec_id, c.j AS cluster, a.s.d::BIGINT AS distance, sum(a.s.d) OVER (PARTITION BY c.j)::BIGINT AS cluster_inertia, sum(a.s.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c.x, lambda e: e::BIGINT), ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN c{ROUNDS} c ON c.j = a.s.j"""


SQL = _sql()
