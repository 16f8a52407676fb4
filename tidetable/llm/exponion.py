"""Exact k-means rounds by Exponion search.

Every vector carries an upper bound of its distance to its centroid and a lower bound of its distance to all others. After the
centroids have moved, the bounds follow; a vector whose upper bound is strictly below the lower one, or below half the way to
the nearest other centroid, stays where it is. The others scan only the centroids in a ball around their current one, of radius
2 * upper + the way to its nearest neighbour, read off sorted lists of distances between centroids. The radius is inclusive and
all comparisons leave room for rounding, so ties are always seen; distances that decide are exact integers.

Each round is one pass over the written vectors: it writes their new state and, per task, one row of sums for the next centroids.
The driver sees k centroids and their k sums, never a vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SCALE = 64
#: Relative room for the rounding of bounds, which are doubles.
ROOM = 1e-9
#: Components up to this magnitude have distances in 64 bits; larger ones are reckoned with Python's integers.
SMALL = 1 << 27


def integer_vectors(vectors: DataFrame, dims: int, *, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, place (a hash of the id, by which the first centroids are chosen) and data (floor(64 x) as little-endian doubles, which hold them exactly).

    Vectors of another length, null ones and those with a null or non-finite component aren't kept. Rows with a null id are, and
    are the last to be chosen. A component so large that 64 times it is no finite double ends in OverflowError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = [], []
            for i, v in enumerate(batch.column(1)):
                if not v.is_valid or len(v.values) != dims or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(SCALE * x)
                if not np.isfinite(x).all():
                    raise OverflowError("a component is too large")
                at.append(i)
                data.append(x.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(data, pa.binary())], ["vec_id", "data"])

    rows = vectors.select(F.col(id).cast("bigint").alias("vec_id"), F.col(vector).alias("v")).mapInArrow(run, "vec_id bigint, data binary")
    return rows.select("vec_id", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("place"), "data")


def _exact(x: np.ndarray) -> np.ndarray:
    """Whole doubles as integers: 64 bits where all distances fit in, else Python's."""
    if not x.size or np.abs(x).max() <= SMALL:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _squares(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    away = x - centroid
    return (away * away).sum(-1)


@dataclass(frozen=True)
class Centroids:
    """values: k x dims integers; order and away: for each centroid all of them by distance (itself first), and these distances;
    moved: how far each has come since the bounds were made."""

    values: np.ndarray
    order: np.ndarray
    away: np.ndarray
    moved: np.ndarray

    @staticmethod
    def of(values: np.ndarray, before: np.ndarray | None = None) -> Centroids:
        k = len(values)
        between = np.array([np.sqrt(_squares(values, v).astype(np.float64)) for v in values]).reshape(k, k)
        between[np.arange(k), np.arange(k)] = -1.0  # itself first, before others in the same place
        order = np.argsort(between, axis=1, kind="stable")
        away = np.maximum(np.take_along_axis(between, order, 1), 0)
        moved = np.zeros(k) if before is None else np.sqrt(_squares(values, before).astype(np.float64))
        return Centroids(values, order, away, moved)


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, to: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid (ties: the smaller number), the new bounds, and how many distances were computed.

    upper and lower hold for the centroids' places before `moved`.
    """
    k = len(to.values)
    cluster = cluster.copy()
    most = np.sort(to.moved)[::-1]
    others = np.where(to.moved == most[0], most[min(1, k - 1)], most[0]) if (to.moved == most[0]).sum() == 1 else np.full(k, most[0])
    upper = (upper + to.moved[cluster]) * (1 + ROOM)
    lower = np.maximum(lower - others[cluster] * (1 + ROOM), 0) * (1 - ROOM)
    near = to.away[:, 1] if k > 1 else np.full(k, np.inf)  # to the nearest other centroid

    def unsure(rows: np.ndarray) -> np.ndarray:
        return rows[upper[rows] * (1 + ROOM) >= np.maximum(lower[rows], near[cluster[rows]] / 2 * (1 - ROOM))]

    todo = unsure(np.arange(len(x)))
    upper[todo] = np.sqrt(_squares(x[todo], to.values[cluster[todo]]).astype(np.float64)) * (1 + ROOM)
    computed = len(todo)
    todo = unsure(todo)
    for a in np.unique(cluster[todo]).tolist():
        rows = todo[cluster[todo] == a]
        radius = (2 * upper[rows] + near[a]) * (1 + ROOM)
        rows = rows[np.argsort(-radius, kind="stable")]
        within = np.searchsorted(to.away[a], np.sort(radius)[::-1], "right")  # how many of the list are in each ball
        best, number = _squares(x[rows], to.values[a]), np.full(len(rows), a)
        second = np.full(len(rows), np.inf)
        computed += int(within.sum())
        for i in range(1, int(within.max(initial=0))):
            part = slice(0, int(np.searchsorted(-within, -i, "left")))  # those whose ball has more than i of the list
            c = int(to.order[a, i])
            square = _squares(x[rows[part]], to.values[c])
            closer = (square < best[part]) | (square == best[part]) & (c < number[part])
            second[part] = np.minimum(second[part], np.sqrt(np.where(closer, best[part], square).astype(np.float64)))
            best[part], number[part] = np.where(closer, square, best[part]), np.where(closer, c, number[part])
        cluster[rows], upper[rows], lower[rows] = number, np.sqrt(best.astype(np.float64)) * (1 + ROOM), second * (1 - ROOM)
    return cluster, upper, lower, computed


_STATE = "vec_id bigint, data binary, cluster int, upper double, lower double, sums array<decimal(38,0)>"


def _pass(state: DataFrame, to: Centroids, dims: int) -> DataFrame:
    """The state after one assignment, and one row a task with the count and the sums of each cluster (and nothing else)."""
    k = len(to.values)
    told = state.sparkSession.sparkContext.broadcast(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dims + 1), object)
        for batch in batches:
            data = batch.column("data").cast(pa.large_binary())
            x = _exact(np.frombuffer(b"".join(data.to_pylist()), "<f8").reshape(len(data), dims))
            cluster, upper, lower, _ = assign(x, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower")), told.value)
            for c in np.unique(cluster).tolist():
                mine = x[cluster == c]
                sums[c] += [len(mine), *mine.sum(0).tolist()]
            nothing = pa.nulls(len(batch), pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("data"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), nothing], names)
        total = pa.array([[int(v) for v in sums.reshape(-1)]], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.float64())), total], names)

    names = ["vec_id", "data", "cluster", "upper", "lower", "sums"]
    return state.select("vec_id", "data", "cluster", "upper", "lower").mapInArrow(run, _STATE)


def _next(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """The centroids after an assignment: floor(sum / count) of each component; an empty cluster's stays."""
    k, dims = now.shape
    rows = state.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "sum")).groupBy("at").agg(F.sum("sum").cast("string").alias("sum")).collect()  # k (dims + 1) numbers
    sums = {r["at"]: int(r["sum"]) for r in rows}
    out = now.astype(object)
    for c in range(k):
        count = sums.get(c * (dims + 1), 0)
        if count:
            out[c] = [sums[c * (dims + 1) + 1 + d] // count for d in range(dims)]
    return _exact(out.astype(np.float64)) if max(map(abs, out.reshape(-1).tolist()), default=0) <= SMALL else out


def cluster(vectors: DataFrame, *, k: int = 16, rounds: int = 3, dims: int = 64, id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance (squared) of each kept vector after `rounds` rounds and a last assignment; the k final centroids.

    The first centroids are the k kept vectors of least place (then data; null ids last), in this order; with fewer vectors there
    are fewer. Rows of one id or one vector are rows each. A distance beyond 64 bits ends in OverflowError. Without a
    kept vector the result is empty. Other columns aren't read, so their names don't matter.
    """
    rows = materialize(integer_vectors(vectors, dims, id=id, vector=vector), "vectors")
    first = rows.orderBy(F.col("place").asc_nulls_last(), "data").limit(k).select("data").collect()
    now = _exact(np.frombuffer(b"".join(bytes(r["data"]) for r in first), "<f8").reshape(len(first), dims))
    state = rows.select("vec_id", "data", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    if not len(first):
        return state.select("vec_id", "cluster", F.lit(0).cast("bigint").alias("distance")), now
    to = Centroids.of(now)
    for i in range(rounds):
        state = materialize(_pass(state, to, dims), f"state-{i}")
        to = Centroids.of(_next(state, to.values), to.values)
        state = state.where("sums IS NULL")
    told = state.sparkSession.sparkContext.broadcast(to)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("data").cast(pa.large_binary())
            x = _exact(np.frombuffer(b"".join(data.to_pylist()), "<f8").reshape(len(data), dims))
            number, *_ = assign(x, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower")), told.value)
            distance = pa.array([int(v) for v in _squares(x, told.value.values[number])], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number, pa.int32()), distance], ["vec_id", "cluster", "distance"])

    return state.mapInArrow(last, "vec_id bigint, cluster int, distance bigint"), to.values


def op13_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kept vector's cluster and distance, with the inertia of its cluster and of all, and a digest of its centroid (see cluster)."""
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    found = materialize(found, "clusters")
    by_cluster = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # 16 rows
    digest = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    known = spark.createDataFrame([(c, x, sum(by_cluster.values()), digest[c]) for c, x in by_cluster.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
