"""Exact k-means over integer vectors that scans only vectors whose nearest centroid is in doubt.

Every vector carries an upper bound on the distance to its own centroid and a lower bound on
the distance to all others. After a move, the lower bound has to give way by as much as some
other centroid came nearer. That is at most the centroid's drift, and mostly less: all
vectors of a cluster lie in a sphere around its centroid, and in the plane through the
sphere's centre and the way of a moved centroid the sphere is seen from every point of the
way under an angle. Only the part of the drift along the nearest line of sight brings the
centroid nearer (``approach``). Vectors whose bounds still part are settled without any
distance; the rest are measured against their own centroid, and against all where that does
not do either. Distances are integers; bounds are rounded to the safe side, so results equal
a full scan, ties included.

Each round is one pass in tasks that writes the vectors with their bounds, and beside them
one row of sums per task and cluster. What comes to the driver is k centroids.

Defined cases: vectors that are null, of another length, or hold a null, NaN or infinite
component are left out; a null vec_id is clustered but is no start; repeated rows count each
and may start each (ties by components); with fewer vectors than k there are as many
clusters; components end at the bounds of 64 bits, and so do distances; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.shared import settle

# Parts of a centroid's way that are looked at one by one.
WAY_PARTS = 8

# Rounding of square roots, angles and sums stays far below these shares.
_OUT, _IN, _ANGLE = 1 + 1e-12, 1 - 1e-12, 1e-6

# The lower bound where there is no other centroid.
_FAR = 1e300

_LARGEST = 2**63 - 1
_SUMS = pa.list_(pa.decimal128(38, 0))


def integer_rows(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, weights): each component x as floor(scale * x); unfit vectors are left out."""
    x = F.col("embedding").cast("array<double>")
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where((F.size("embedding") == dims) & fit).select(
        "vec_id", F.transform(x, lambda v: F.floor(v * scale)).alias("weights")
    )


def _numbers(vectors: list[list[int]]) -> np.ndarray:
    """Vectors as 64-bit integers, or as exact ones where squares could leave 64 bits."""
    largest = max((abs(v) for row in vectors for v in row), default=0)
    return np.array(vectors, np.int64 if largest < 2**24 else object)


def squared_distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(rows x centroids), exact."""
    largest = 0
    for x in (rows, centroids):
        if x.size:
            largest = max(largest, -int(x.min()), int(x.max()))
    if 4 * largest * largest * max(1, rows.shape[1]) < 2**53:  # floats are exact so far
        x, c = rows.astype(float), centroids.astype(float)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    kind = np.int64 if 4 * largest * largest * max(1, rows.shape[1]) < 2**62 else object
    x, c = rows.astype(kind), centroids.astype(kind)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float))


def approach(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """(cluster x centroid): how much nearer a moved centroid can be to the cluster's vectors.

    A step of the way from y brings the centroid nearer to x by the step's length times the
    cosine between the way and x - y. Over the sphere that cosine is largest where the angle
    is that of the sphere's centre less the sphere's half aperture, and along the way this
    angle only grows; so the start of each part bounds the part. Where y is inside the
    sphere, nothing less than the full part is sure. The result may be negative.
    """
    way = new - old
    drift = np.sqrt((way * way).sum(1))
    found = np.zeros((len(old), len(old)))
    unit = way / np.where(drift > 0, drift, 1)[:, None]
    for part in range(WAY_PARTS):
        seen_from = old + way * (part / WAY_PARTS)
        gap = old[:, None, :] - seen_from[None, :, :]
        distance = np.sqrt((gap * gap).sum(2))
        outside = distance > radii[:, None]
        safe = np.where(distance > 0, distance, 1)
        angle = np.arccos(np.clip((gap * unit[None, :, :]).sum(2) / safe, -1, 1))
        half = np.arcsin(np.clip(radii[:, None] / safe, 0, 1))
        nearer = np.where(outside, np.cos(np.maximum(angle - half, 0)), 1.0)
        found += nearer * drift / WAY_PARTS
    return np.minimum(found + drift * _ANGLE, drift * _OUT)


class Bounds:
    """What a round knows about the moves of the centroids before it."""

    def __init__(self, old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> None:
        old, new = old.astype(float), new.astype(float)
        way = new - old
        self.drift = np.sqrt((way * way).sum(1)) * _OUT
        nearer = approach(old, new, radii)
        np.fill_diagonal(nearer, -np.inf)
        self.loosen = nearer.max(1) if len(old) > 1 else np.zeros(len(old))


def assign(
    rows: np.ndarray,
    centroids: np.ndarray,
    held: tuple[np.ndarray, np.ndarray, np.ndarray] | None,
    bounds: Bounds | None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, vectors scanned); ``held`` are the former three."""
    n = len(rows)
    if held is None:
        cluster, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n)
        doubt = np.arange(n)
    else:
        cluster, upper, lower = (x.copy() for x in held)
        upper = (upper + bounds.drift[cluster]) * _OUT
        lower = lower - bounds.loosen[cluster]
        lower -= np.abs(lower) * (1 - _IN)
        doubt = np.flatnonzero(upper >= lower)
        for own in np.unique(cluster[doubt]):
            mine = doubt[cluster[doubt] == own]
            upper[mine] = roots(squared_distances(rows[mine], centroids[own : own + 1])[:, 0]) * _OUT
        doubt = doubt[upper[doubt] >= lower[doubt]]
    if len(doubt):
        squares = squared_distances(rows[doubt], centroids)
        nearest = squares.argmin(1)  # the first of equals
        cluster[doubt] = nearest
        at = np.arange(len(doubt))
        upper[doubt] = roots(squares[at, nearest]) * _OUT
        if len(centroids) > 1:
            floats = squares.astype(float)
            floats[at, nearest] = np.inf
            lower[doubt] = np.sqrt(floats.min(1)) * _IN
        else:
            lower[doubt] = _FAR
    return cluster, upper, lower, len(doubt)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = pa.concat_arrays([batch.column("weights")])
    flat = lists.flatten().to_numpy().astype(np.int64)
    rows = flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)
    largest = max(-int(rows.min()), int(rows.max())) if rows.size else 0
    return rows if largest < 2**31 else rows.astype(object)


def _round(state: DataFrame, centroids: list[list[int]], bounds: Bounds | None) -> DataFrame:
    """One assignment: rows of vectors (``n`` null), and rows of sums by task and cluster."""
    first = bounds is None
    schema = T.StructType([state.schema["vec_id"]])
    schema = schema.add("weights", T.ArrayType(T.LongType())).add("cluster", T.IntegerType())
    schema = schema.add("upper", T.DoubleType()).add("lower", T.DoubleType())
    schema = schema.add("n", T.LongType()).add("scanned", T.LongType())
    schema = schema.add("sums", T.ArrayType(T.DecimalType(38, 0)))
    names = schema.names
    cents = _numbers(centroids)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = cents.shape
        sums = [[0] * width for _ in range(k)]
        counts, radii, scanned, kind = [0] * k, [0.0] * k, 0, None
        for batch in batches:
            kind = batch.column("vec_id").type
            if not batch.num_rows:
                continue
            rows = _matrix(batch)
            held = None if first else tuple(batch.column(c).to_numpy() for c in ("cluster", "upper", "lower"))
            cluster, upper, lower, n = assign(rows, cents, held, bounds)
            scanned += n
            for own in np.unique(cluster).tolist():
                mine = cluster == own
                for i, s in enumerate(rows[mine].sum(0).tolist()):
                    sums[own][i] += s
                counts[own] += int(mine.sum())
                radii[own] = max(radii[own], float(upper[mine].max()))
            empty = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("weights"),
                    pa.array(cluster, pa.int32()),
                    pa.array(upper),
                    pa.array(lower),
                    empty,
                    empty,
                    pa.nulls(batch.num_rows, _SUMS),
                ],
                names=names,
            )
        used = [i for i in range(k) if counts[i]]
        if used:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(used), kind),
                    pa.nulls(len(used), pa.list_(pa.int64())),
                    pa.array(used, pa.int32()),
                    pa.array([radii[i] for i in used]),
                    pa.nulls(len(used), pa.float64()),
                    pa.array([counts[i] for i in used], pa.int64()),
                    pa.array([scanned] + [0] * (len(used) - 1), pa.int64()),
                    pa.array([[Decimal(s) for s in sums[i]] for i in used], _SUMS),
                ],
                names=names,
            )

    return state.mapInArrow(scan, schema)


def _moved(done: DataFrame, centroids: list[list[int]]) -> tuple[list[list[int]], np.ndarray, int]:
    """The centroids after a round, the radii of their clusters, and how many were scanned."""
    sums = done.where("n IS NOT NULL")
    whole = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("upper").alias("radius"))
    whole = {r["cluster"]: r for r in whole.collect()}
    parts = sums.select("cluster", F.posexplode("sums").alias("i", "s"))
    parts = parts.groupBy("cluster", "i").agg(F.sum(F.col("s")).alias("s"))
    new = [list(c) for c in centroids]
    for r in parts.collect():
        new[r["cluster"]][r["i"]] = int(r["s"]) // whole[r["cluster"]]["n"]
    radii = np.array([whole[i]["radius"] if i in whole else 0.0 for i in range(len(new))])
    return new, radii, sums.agg(F.sum("scanned").alias("x")).first()["x"]


def fit(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1
) -> tuple[DataFrame, list[list[int]], list[int]]:
    """(vec_id, weights, cluster), the centroids, and the vectors scanned in each assignment."""
    rows = settle(integer_rows(vectors, dims, scale))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = rows.where("vec_id IS NOT NULL").select(name.alias("h"), "weights")
    centroids = [list(r["weights"]) for r in start.orderBy("h", "weights").limit(k).collect()]
    placed = "vec_id", "weights", "cluster", "upper", "lower"
    scanned: list[int] = []
    if not centroids:
        return rows.where("false").withColumn("cluster", F.lit(0)), centroids, scanned
    state, bounds = rows, None
    for number in range(rounds + 1):
        done = settle(_round(state, centroids, bounds))
        new, radii, n = _moved(done, centroids)
        scanned.append(n)
        state = done.where("n IS NULL").select(*placed)
        if number < rounds:
            bounds = Bounds(np.array(centroids), np.array(new), radii)
            centroids = new
    return state.select("vec_id", "weights", "cluster"), centroids, scanned


def clusters(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256); see the module text."""
    spark = vectors.sparkSession
    placed, centroids, _ = fit(vectors, k, rounds, dims, scale, seed)
    cents = _numbers(centroids) if centroids else np.zeros((0, dims), np.int64)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            rows = _matrix(batch)
            distance = np.zeros(len(rows), np.int64)
            for own in np.unique(cluster).tolist():
                mine = np.flatnonzero(cluster == own)
                squares = squared_distances(rows[mine], cents[own : own + 1])[:, 0]
                distance[mine] = np.minimum(squares, _LARGEST).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("cluster"), pa.array(distance)],
                names=["vec_id", "cluster", "distance"],
            )

    schema = T.StructType(
        [placed.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    )
    measured = settle(placed.mapInArrow(measure, schema))
    by_cluster = measured.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    # k rows at most come to the driver.
    sums = {r["cluster"]: int(r["s"]) for r in by_cluster.collect()}
    whole = min(sum(sums.values()), _LARGEST)
    named = spark.createDataFrame(
        [
            (i, min(s, _LARGEST), whole, hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest())
            for i, s in sums.items()
        ],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return measured.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
