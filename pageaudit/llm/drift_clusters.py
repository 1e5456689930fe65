"""k-means on whole-number vectors, exact, with lower bounds loosened by planar geometry.

Each vector carries its cluster, its exact squared distance to the centroid it was compared with, and a lower bound on the
distance to every other centroid. When centroids move, the vectors of a cluster lie in a sphere around its old
centroid. Seen from the old place of another centroid j, that sphere fills a cone; in the plane through the sphere's centre and
j's path, no vector of the sphere comes nearer to j by more than the path's length times the cosine of the smallest angle
between the path and the cone. The bound of the whole cluster is loosened by the largest such value (which may be
negative), not by the full drift. Vectors whose own centroid is surely nearest keep it; all others are
compared with every centroid in whole numbers.

A round is one narrow pass (no shuffle) that writes the next state to the shared folder, and one aggregate with a row per cluster and task.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageaudit.session import written

SCALE, SIZE, CLUSTERS, ROUNDS, SEED = 256, 64, 40, 5, 2
#: Components up to this size have squared distances that fit a long (for up to 64 components); larger ones are an error.
LARGEST = 1 << 27
#: Up to this size all sums below are whole numbers that a double holds exactly.
EXACT_DOUBLE = 1 << 21
#: Slack for rounding in the bounds, as a share and as a distance; rows compared with all centroids at a time.
SHARE, SLACK, ROWS_AT_ONCE = 1e-9, 1e-3, 8192


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and point of the rows whose vector has ``size`` components, none null, NaN or infinite."""
    v = F.col(vector_col)
    usable = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    point = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return vectors.where(v.isNotNull() & F.coalesce(usable, F.lit(False))).select(F.col(id_col).alias("vec_id"), point.alias("point"))


def first_centroids(points: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The points with the ``k`` smallest hashes of seed and id, in that order; rows without an id come last, ties go by the point."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = points.select(digest.alias("h"), "point").orderBy(F.col("h").asc_nulls_last(), "point").limit(k).collect()
    return np.array([r["point"] for r in rows], np.int64)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row per point and a column per centroid."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT_DOUBLE and points.shape[1] <= SIZE:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], axis=1)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid (ties: the smaller number), its squared distance, and a lower bound on the distance to all others."""
    cluster, distance, lower = np.zeros(len(points), np.int32), np.zeros(len(points), np.int64), np.full(len(points), np.inf)
    for at in range(0, len(points), ROWS_AT_ONCE):
        d = squared(points[at : at + ROWS_AT_ONCE], centroids)
        best, rows = d.argmin(1), np.arange(len(d))
        cluster[at : at + len(d)], distance[at : at + len(d)] = best, d[rows, best]
        if len(centroids) > 1:
            d[rows, best] = np.iinfo(np.int64).max
            lower[at : at + len(d)] = np.sqrt(d.min(1).astype(np.float64)) * (1 - SHARE)
    return cluster, distance, lower


def approach(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster: by how much any other centroid can have come nearer to a vector of the cluster, at most.

    ``radius``: the largest distance of a vector of the cluster to its centroid in ``old``. For centroid j with path m and the sphere's
    centre at distance D and angle phi to the path, seen from j's old place, the cone's half angle is asin(radius / D); the
    value is m * cos(max(0, phi - asin(radius / D))), or m where j lies in the sphere. One cluster alone gives minus infinity.
    """
    k = len(old)
    path = (new - old).astype(np.float64)
    m = np.sqrt((path**2).sum(1))
    out = np.full(k, -np.inf)
    for i in range(k):
        to = old[i].astype(np.float64) - old  # from each centroid's old place to the centre of sphere i
        far = np.sqrt((to**2).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            phi = np.arccos(np.clip((to * path).sum(1) / (far * m), -1, 1))
            cone = np.arcsin(np.clip(radius[i] * (1 + SHARE) / far, 0, 1))
            nearer = np.where(far <= radius[i] * (1 + SHARE), m, m * np.cos(np.maximum(0, phi - cone - 1e-7)))
        nearer[m == 0] = 0
        nearer[i] = -np.inf
        out[i] = nearer.max()
    return out


def rows_of(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The batch's points as an array with a row each."""
    points = batch.column("point").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    if np.abs(points).max(initial=0) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST}: squared distances would not fit a long")
    return points


STATE = "vec_id {id}, point array<bigint>, cluster int, distance bigint, lower double, scanned boolean"


def assign_all(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The state of the first round: every vector is compared with every centroid."""
    size = centroids.shape[1]

    def run(batches):
        for batch in batches:
            found = nearest(rows_of(batch, size), centroids)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["point"], *map(pa.array, found), pa.array(np.ones(batch.num_rows, bool))], ["vec_id", "point", "cluster", "distance", "lower", "scanned"])

    return written(points.mapInArrow(run, STATE.format(id=points.schema["vec_id"].dataType.simpleString())), "kmeans-state")


def reassign(state: DataFrame, centroids: np.ndarray, loosen: np.ndarray) -> DataFrame:
    """The state after the centroids moved; ``loosen`` has a value for each cluster of ``state``."""
    size = centroids.shape[1]
    apart = np.sqrt(squared(centroids, centroids).astype(np.float64))
    np.fill_diagonal(apart, np.inf)
    half = apart.min(1) / 2  # nearer to its centroid than this, a vector is nearer to it than to any other

    def run(batches):
        for batch in batches:
            points, cluster = rows_of(batch, size), batch["cluster"].to_numpy().copy()
            lower = (batch["lower"].to_numpy() - loosen[cluster]) * (1 - SHARE) - SLACK
            distance = ((points - centroids[cluster]) ** 2).sum(1)
            own = np.sqrt(distance.astype(np.float64)) * (1 + SHARE) + SLACK
            open_ = np.flatnonzero(own >= np.maximum(lower, half[cluster] * (1 - SHARE)))
            cluster[open_], distance[open_], lower[open_] = nearest(points[open_], centroids)
            scanned = np.zeros(len(cluster), bool)
            scanned[open_] = True
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["point"], *map(pa.array, (cluster, distance, lower, scanned))], ["vec_id", "point", "cluster", "distance", "lower", "scanned"])

    return written(state.mapInArrow(run, state.schema), "kmeans-state")


def moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The new centroids (the exact floor of each mean; without vectors the old one) and the largest distance in each cluster.

    Each batch is summed where it is read; a row per cluster and component comes to the driver, whatever the input.
    Sums of components fit a long for 2^36 vectors.
    """
    k, size = centroids.shape

    def run(batches):
        for batch in (b for b in batches if b.num_rows):
            points, cluster, distance = rows_of(batch, size), batch["cluster"].to_numpy(), batch["distance"].to_numpy()
            order = np.argsort(cluster, kind="stable")
            own, start = np.unique(cluster[order], return_index=True)
            sums, far = np.add.reduceat(points[order], start, axis=0), np.maximum.reduceat(distance[order], start)
            n = np.diff(np.append(start, len(cluster)))
            at = np.repeat(own.astype(np.int64) * size, size) + np.tile(np.arange(size), len(own))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, sums.ravel(), np.repeat(n, size), np.repeat(far, size))], ["at", "sum", "n", "far"])

    new, radius = centroids.copy(), np.zeros(k)
    parts = state.select("point", "cluster", "distance").mapInArrow(run, "at bigint, sum bigint, n bigint, far bigint")
    for r in parts.groupBy("at").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"), F.max("far").alias("far")).collect():
        new[r["at"] // size, r["at"] % size] = r["sum"] // r["n"]
        radius[r["at"] // size] = np.sqrt(float(r["far"])) * (1 + SHARE)
    return new, radius


def cluster_vectors(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every usable vector.

    Rows with a null, short, long or non-finite vector have no result. Repeated ids and rows each get their own row; a null id is kept.
    With fewer usable rows than ``k`` there are as many clusters; an empty table gives an empty result. Other columns are not read.
    """
    points = whole_vectors(vectors, id_col, vector_col, size, scale)
    centroids = first_centroids(points, k, seed)
    if not len(centroids):
        return points.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    state = assign_all(points, centroids)
    for _ in range(rounds):
        new, radius = moved(state, centroids)
        state = reassign(state, new, approach(centroids, new, radius))
        centroids = new
    sums = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    facts = [(j, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids) if j in sums]
    # k rows at most
    of = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")
