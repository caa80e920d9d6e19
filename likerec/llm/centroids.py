"""Centroids of integer vectors, with exact distances, and n-simplex bounds that spare most of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likerec.llm.common import stash, tidy, with_arrow_columns

# Components below this in magnitude have squared distances of 64 components that fit 64 bits.
MOST = 1 << 27
# Relative slack of bounds computed in double precision.
SLACK = 1e-9
# A pivot stands at least this high above the others, of the pivots' largest distance.
MIN_ALTITUDE = 0.01
# The share of exact comparisons above which the next round has new pivots.
NEW_PIVOTS = 0.5

OUTPUTS = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


class Simplex:
    """A base simplex of pivots, above which every point is an apex known by its distances to the pivots alone.

    The first pivot is the origin. Further ones are chosen among ``points`` by the greatest altitude above those already
    there, and end where no altitude is left to speak of, so that coordinates stay well conditioned.
    """

    def __init__(self, points: np.ndarray) -> None:
        self.pivots = points[:1]
        self._lower = np.zeros((0, 0))
        enough = MIN_ALTITUDE * np.sqrt(squared(points, points[:1]).max())
        while len(self.pivots) < len(points):
            heights = self.apexes(points)[:, -1]
            best = heights.argmax()
            if heights[best] <= enough:
                break
            self.pivots = np.concatenate([self.pivots, points[best:best + 1]])
            sides = squared(self.pivots, self.pivots).astype(np.float64)
            self._lower = np.linalg.cholesky((sides[:1, 1:] + sides[1:, :1] - sides[1:, 1:]) / 2)

    def apexes(self, points: np.ndarray) -> np.ndarray:
        """The coordinates of each point in the pivots' span, and its altitude above it, from its distances to them."""
        sides = squared(points, self.pivots).astype(np.float64)
        base = (sides[:, :1] + np.square(self._lower).sum(axis=1) - sides[:, 1:]) / 2
        inside = np.linalg.solve(self._lower, base.T).T if len(self._lower) else base
        return np.column_stack([inside, np.sqrt(np.maximum(0, sides[:, 0] - np.square(inside).sum(axis=1)))])


def squared(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of each point to each of a few others."""
    return np.stack([np.square(points - other).sum(axis=1) for other in others.astype(np.int64)], axis=1)


def possible(apexes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest to each point, by the apexes of both.

    Two apexes lie nearest where both are on one side of the pivots' span and farthest where they are on opposite sides:
    true distances are between. A centroid whose lower bound is over the least upper bound is none of the nearest.
    """
    sizes = np.square(apexes).sum(axis=1)[:, None] + np.square(centroids).sum(axis=1)
    lower = sizes - 2 * apexes @ centroids.T
    upper = lower + 4 * np.outer(apexes[:, -1], centroids[:, -1])
    return lower - SLACK * sizes <= (upper + SLACK * sizes).min(axis=1, keepdims=True)


def nearest(points: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of each point, the smaller number in a tie, and how many exact distances that took.

    Exact integer distances are computed for points that the bounds leave two or more centroids.
    """
    open_ = possible(apexes, tops)
    found = open_.argmax(axis=1)
    rows, numbers = np.nonzero(open_ & (open_.sum(axis=1) > 1)[:, None])
    exact = np.full(open_.shape, np.iinfo(np.int64).max)
    exact[rows, numbers] = np.square(points[rows] - centroids[numbers]).sum(axis=1)
    several = np.unique(rows)
    found[several] = exact[several].argmin(axis=1)
    return found, len(rows)


def _usable(vector: Column, size: int) -> Column:
    """Vectors of ``size`` components, none of them null, infinite or not a number."""
    doubles = vector.cast("array<double>")
    infinite = F.lit(float("inf"))
    return (vector.isNotNull() & (F.size(vector) == size) & (F.size(F.array_compact(vector)) == size)
            & (F.array_max(doubles) < infinite) & (F.array_min(doubles) > -infinite))


def _integers(rows: np.ndarray, scale: int) -> np.ndarray:
    whole = np.floor(rows * scale)
    if len(whole) and np.abs(whole).max() >= MOST:
        raise ValueError(f"a component of {np.abs(whole).max() / scale:g} gives distances beyond 64 bits")
    return whole.astype(np.int64)


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _rows_of(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in matrix], pa.binary())


def _pointed(vectors: DataFrame, scale: int) -> DataFrame:
    """``vectors`` with their integers, as bytes, in place of the embedding."""
    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        lists = batch.column("embedding")
        rows = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))
        return [_rows_of(_integers(rows, scale).astype(np.int32))]

    return with_arrow_columns(vectors, [T.StructField("_llm_point", T.BinaryType())], compute, "embedding")


def _projected(pointed: DataFrame, simplex: Simplex, size: int) -> DataFrame:
    """The points with their apexes above the pivots, stored."""
    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        return [_rows_of(simplex.apexes(_matrix(batch.column("_llm_point"), np.int32, size).astype(np.int64)))]

    return stash(with_arrow_columns(pointed, [T.StructField("_llm_apex", T.BinaryType())], compute), "centroid-points")


def _sums(stored: DataFrame, centroids: np.ndarray, simplex: Simplex) -> tuple[list[list[int]], int]:
    """Per centroid the number of its vectors and the sum of each component, and the exact distances computed.

    Each task adds up its own rows and sends one row per centroid; sums of sums are decimals.
    """
    size, count = centroids.shape[1], len(centroids)
    width, tops = len(simplex.pivots), simplex.apexes(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, compared = np.zeros((count, size + 1), np.int64), 0
        for batch in batches:
            points = _matrix(batch.column("_llm_point"), np.int32, size).astype(np.int64)
            found, exact = nearest(points, _matrix(batch.column("_llm_apex"), np.float64, width), centroids, tops)
            compared += exact
            for k in range(count):
                mine = points[found == k]
                totals[k, 0] += len(mine)
                totals[k, 1:] += mine.sum(axis=0)
        sums = [*totals.tolist(), [compared]]
        yield pa.RecordBatch.from_arrays([pa.array(range(count + 1), pa.int32()), pa.array(sums, pa.list_(pa.int64()))], names=["k", "sums"])

    parts = stored.select("_llm_point", "_llm_apex").mapInArrow(add, "k int, sums array<bigint>")
    added = parts.select("k", F.posexplode("sums").alias("i", "s")).groupBy("k", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    totals = [[0] * (size + 1) for _ in range(count + 1)]
    for row in added.collect():  # (centroids x components) numbers
        totals[row["k"]][row["i"]] = int(row["s"])
    return totals[:count], totals[count][0]


def cluster_vectors(
    vectors: DataFrame, clusters: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3"
) -> DataFrame:
    """Usable rows of ``vectors`` (vec_id, embedding) with the centroid that is theirs after some rounds, all in integers.

    Kept are vectors of ``size`` components, none null or non-finite; component x is floor(scale * x). Centroids start as the
    vectors of the smallest sha256 of ``seed:vec_id`` (a null id is the text ``null``; rows of one id by components), in that
    order; fewer vectors than ``clusters`` make fewer centroids. A round gives every vector to its nearest centroid, the
    smaller number in a tie, and moves a centroid to its vectors' floor(sum / count); one without vectors stays.

    The pivots are the centroids of some round. Distances to them are computed once and kept as apex coordinates, whose
    bounds leave most vectors few of the centroids that follow; these are compared exactly. Where centroids have moved
    so far that a round compared over half of all pairs, the next one has new pivots. Tasks send a row per centroid, and
    the driver holds the centroids.

    Gives the columns of ``vectors`` but the embedding, ``cluster``, ``distance`` (squared), ``cluster_inertia`` and ``inertia``
    (sums of distances; null beyond 64 bits) and ``centroid_sha256``. Rows of one id are vectors each; an empty table gives
    none. A component of 2^27 or more (as an integer), whose distances need not fit 64 bits, is an error.
    """
    vectors = tidy(vectors, ["vec_id", "embedding"], OUTPUTS).where(_usable(F.col("embedding"), size))
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    doubles = vectors.select(F.col("embedding").cast("array<double>").alias("v"), by_hash.alias("h"))
    first = [r["v"] for r in doubles.orderBy("h", "v").limit(clusters).collect()]
    if not first:
        return vectors.drop("embedding").select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in
                                                       zip(OUTPUTS, ["int", "long", "long", "long", "string"])])
    centroids = _integers(np.array(first, np.float64), scale)
    simplex, stored = Simplex(centroids), _pointed(vectors, scale)
    stored = _projected(stored, simplex, size)
    for _ in range(rounds):
        sums, compared = _sums(stored, centroids, simplex)
        centroids = np.array([[s // n for s in added] if n else old for (n, *added), old in zip(sums, centroids.tolist())], np.int64)
        if compared > NEW_PIVOTS * len(centroids) * sum(n for n, *_ in sums):
            simplex = Simplex(centroids)
            stored = _projected(stored.drop("_llm_apex"), simplex, size)
    return _assigned(stored, centroids, simplex)


def _assigned(stored: DataFrame, centroids: np.ndarray, simplex: Simplex) -> DataFrame:
    """The stored rows with their final centroid, exact distance, sums of distances and the centroid's digest."""
    size, width, tops = centroids.shape[1], len(simplex.pivots), simplex.apexes(centroids)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        points = _matrix(batch.column("_llm_point"), np.int32, size).astype(np.int64)
        found, _ = nearest(points, _matrix(batch.column("_llm_apex"), np.float64, width), centroids, tops)
        return [pa.array(found, pa.int32()), pa.array(np.square(points - centroids[found]).sum(axis=1), pa.int64())]

    fields = [T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    assigned = stash(with_arrow_columns(stored, fields, compute, "_llm_point", "_llm_apex"), "centroid-rows")
    sums = {r["cluster"]: int(r["d"]) for r in
            assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    rows = [(k, fits(sums.get(k, 0)), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
            for k, c in enumerate(centroids.tolist())]
    table = stored.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select(*assigned.columns, *OUTPUTS[2:])
