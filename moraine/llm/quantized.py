"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Vectors are compared within their label by cosine in double precision:

1. Each vector is quantised once: unit vector to int8 codes with a scale of its
   own, the norm of what the codes stand for and the exact norm of the error.
   Equal vectors of a label (equal 128-bit digests of their doubles) become one;
   they link with each other, cosine 1.
2. A label's vectors are dealt by hash into blocks of about ``block`` vectors;
   each pair of blocks is one tile, which is one task's work and gets codes only, an
   eighth of the doubles. The product of the codes is exact; by Cauchy-Schwarz the
   true cosine differs from the scaled product by at most
   ``|x^| |e_y| + |e_x| |y|``. Pairs that this bound puts surely below the
   threshold are done. A tile names the vectors that have any other pair in it,
   never the pairs.
3. Only these vectors are fetched in full for their tiles, where the pairs
   that may reach the threshold are recomputed in double precision.
   A tile returns sums: for each vector its number of links and
   a spanning forest of the links. Forests are joined to components.

Comparing all vectors of a label is quadratic in its size by nature; blocks
spread a hot label over many tasks and the products are 64 multiplications in
a matrix kernel. A tile's memory is set by ``block`` alone.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without a label, link with nothing; vectors of different
lengths do not link; repeated rows are vectors of their own; null ids are no
component ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import Tables, cut, join_hot, small, table
from moraine.llm.components import components

COSINE, BLOCK = 0.98, 2048
_SLACK = 1e-6  # above the rounding of float32 products of exact int8 sums


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of unit rows, their scales, the norms of what the codes stand for
    and the norms of the errors."""
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    stands = codes * scale[:, None]
    return codes, scale, np.sqrt((stands * stands).sum(1)), np.sqrt(((x - stands) ** 2).sum(1))


def possible(x: tuple, y: tuple, cosine: float = COSINE, step: int = 512):
    """Index pairs (i, j) of quantised rows (codes, scales, sizes, errors) whose
    cosine may be at least ``cosine``; yields arrays for ``step`` rows of ``x`` at a time."""
    (cx, sx, nx, ex), (cy, sy, ny, ey) = x, y
    # sums of int8 products stay exact in this type
    kind = np.float32 if cx.shape[1] * 127 * 127 < 1 << 24 else np.float64
    right = cy.T.astype(kind)
    for at in range(0, len(cx), step):
        part = slice(at, at + step)
        product = (cx[part].astype(kind) @ right).astype(np.float64)
        product *= sx[part, None]
        product *= sy
        product += nx[part, None] * ey + ex[part, None] + _SLACK
        i, j = np.nonzero(product >= cosine)
        yield i + at, j


def exact_links(x: np.ndarray, y: np.ndarray, qx: tuple, qy: tuple, cosine: float = COSINE):
    """The pairs of :func:`possible` whose cosine in double precision is at least ``cosine``."""
    for i, j in possible(qx, qy, cosine):
        keep = np.empty(len(i), bool)
        for b in range(0, len(i), 1 << 16):  # in bounded portions
            own = slice(b, b + (1 << 16))
            keep[own] = np.einsum("nd,nd->n", x[i[own]], y[j[own]]) >= cosine
        yield i[keep], j[keep]


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the ends of the links: whole arrays pull minima until few roots
    change, single steps do the rest."""
    for _ in range(8):
        a, b = parent[i], parent[j]
        differ = a != b
        if not differ.any():
            return
        np.minimum.at(parent, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
    for a, b in zip(i.tolist(), j.tolist()):
        a, b = _find(parent, a), _find(parent, b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    while True:
        up = parent[parent]
        if (up == parent).all():
            return
        parent[:] = up


_CODES = "vec_id long, label string, digest binary, d int, codes binary, scale double, size double, error double"


def codes(vectors: DataFrame, full: bool = False) -> DataFrame:
    """vec_id, label, digest and the quantised vector of each row; digest and
    the rest are null where a vector links with nothing. With ``full`` only vec_id,
    label, digest and v, the unit vector, of rows that may link."""
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists("v", lambda e: e != 0)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    usable = F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull()
    rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda e: e + F.lit(0.0))))  # -0 and 0 are equal
    ddl = "vec_id long, label string, digest binary, v binary" if full else _CODES

    def run(batches):
        import hashlib

        for b in batches:
            ids, labels, vectors = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            out = [[i, k, *[None] * 6] for i, k in zip(ids, labels)]
            by_size: dict[int, list[int]] = {}
            for n, v in enumerate(vectors):
                if v is not None:
                    by_size.setdefault(len(v), []).append(n)
            for d, own in by_size.items():
                x = np.array([vectors[n] for n in own])
                unit = unit_rows(x)
                told = unit if full else zip(*quantised(unit))
                for n, row, t in zip(own, x, told):
                    digest = hashlib.blake2b(row.tobytes(), digest_size=16).digest()
                    out[n][2:] = [digest, t.tobytes()] if full else [digest, d, t[0].tobytes(), *t[1:]]
            if full:
                out = [r for r in out if r[2] is not None]
            columns = list(zip(*out)) or [[]] * (4 if full else 8)
            types = [pa.int64(), pa.string(), pa.binary()] + ([pa.binary()] if full else [pa.int32(), pa.binary(), *[pa.float64()] * 3])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in ddl.split(", ")])

    return rows.mapInArrow(run, ddl)


def _stacked(pdf, d: int) -> tuple:
    return np.frombuffer(b"".join(pdf["codes"]), np.int8).reshape(-1, d), *(pdf[c].to_numpy() for c in ("scale", "size", "error"))


def _of(q: tuple, rows: np.ndarray) -> tuple:
    return tuple(c[rows] for c in q)


def vector_classes(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per vector (vec_id, embedding, label): vec_id, n_links,
    component_id and kept."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be in (0, 1]")
    tile = ["label", "d", "low", "high"]
    with Tables() as t:
        rows = t.cut(codes(vectors))
        own = rows.where("digest is not null")
        classes = own.groupBy("label", "digest").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first(F.struct("d", "codes", "scale", "size", "error")).alias("q"))
        classes = t.cut(classes.select(F.monotonically_increasing_id().alias("cid"), "label", "digest", "first_id", "copies", "q.*"))
        sizes = t.cut(classes.groupBy("label", "d").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
        dealt = classes.drop("digest", "first_id").join(small(sizes), ["label", "d"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        tiled = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "label", "d", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "cid", "copies", "codes", "scale", "size", "error")

        def sides(pdf):
            d, low, high, side = int(pdf["d"].iloc[0]), pdf["low"].iloc[0], pdf["high"].iloc[0], pdf["own"].to_numpy()
            return _stacked(pdf, d), np.flatnonzero(side == low), np.flatnonzero(side == high), low == high

        def screen(pdf):
            """Which vectors of the tile have a pair that may reach the threshold."""
            q, a, b, same = sides(pdf)
            named = np.zeros(len(pdf), bool)
            if len(a) and len(b):
                for i, j in possible(_of(q, a), _of(q, b), cosine):
                    if same:
                        i, j = i[i != j], j[i != j]
                    named[a[i]] = True
                    named[b[j]] = True
            return pdf.loc[named, [*tile, "own", "cid", "copies", "codes", "scale", "size", "error"]]

        named = t.cut(tiled.groupBy(*tile).applyInPandas(screen, "label string, d int, low int, high int, own int, cid long, copies long, codes binary, scale double, size double, error double"))
        # full vectors, one row of each class: only vectors of wanted ids are read in full and shuffled
        wanted = t.cut(named.select("cid").distinct().join(classes.select("cid", "label", "digest", F.col("first_id").alias("vec_id")), "cid"))
        ids = small(t.cut(wanted.select(F.col("vec_id").alias("_m_wanted")).distinct()))
        some = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding").join(ids, F.col("vec_id").eqNullSafe(F.col("_m_wanted")), "left_semi")
        whole = codes(some, full=True).groupBy("vec_id", "label", "digest").agg(F.first("v").alias("v"))  # repeated rows of an id
        same = [F.col(f"w.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("vec_id", "label", "digest")]
        found = t.cut(wanted.alias("w").join(whole.alias("f"), same[0] & same[1] & same[2]).select("w.cid", "f.v"))

        def decide(pdf):
            import pandas as pd

            pdf = pdf.sort_values("cid", ignore_index=True)
            q, a, b, same = sides(pdf)
            x = np.frombuffer(b"".join(pdf["v"]), np.float64).reshape(len(pdf), -1)
            copies = pdf["copies"].to_numpy()
            links, parent = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
            if len(a) and len(b):
                for i, j in exact_links(x[a], x[b], _of(q, a), _of(q, b), cosine):
                    i, j = a[i], b[j]
                    if same:
                        i, j = i[i != j], j[i != j]
                    links += np.bincount(i, copies[j], len(pdf)).astype(np.int64)
                    if not same:
                        links += np.bincount(j, copies[i], len(pdf)).astype(np.int64)
                    forest(parent, i, j)
            some = np.flatnonzero(links > 0)
            return pd.DataFrame({"cid": pdf["cid"].iloc[some], "links": links[some], "up": pdf["cid"].to_numpy()[parent[some]]})

        linked = t.cut(named.join(found, "cid").groupBy(*tile).applyInPandas(decide, "cid long, links long, up long"))
        links = linked.groupBy("cid").agg(F.sum("links").alias("links"))
        roots = components(linked.select(F.col("cid").alias("a"), F.col("up").alias("b")))
        told = classes.select("cid", "label", "digest", "first_id", "copies").join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        told = t.cut(told)
        least = t.cut(told.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("classes")))
        key = F.concat("digest", F.lit("/"), F.col("label").cast("binary")).alias("key")
        told = t.cut(join_hot(told, least, "root", "classes").select(key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", "copies"))
        slim = t.cut(own.select("vec_id", key))
        alone = rows.where("digest is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
        out = cut(join_hot(slim, told, "key", "copies").select("vec_id", "n_links", "component_id").unionByName(alone))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_quantized_tiles(spark, sf_dir: str) -> DataFrame:
    return vector_classes(table(spark, sf_dir, "embeddings"))
