"""Centroid clustering by sort-means: exact Lloyd rounds over whole numbers that look at few centroids.

Each round orders, for every centroid, the others by their distance from it. A vector scans them from its previous centroid
outwards and stops at the first one strictly beyond twice its distance from the previous: by the triangle inequality no
centroid from there on is as near, ties included. Only the centroids, k by ``dims`` numbers, pass the driver. Vectors and
assignments stand in the shared folder between rounds, so a lost executor costs a task; sums and counts are whole numbers,
so their order changes nothing.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .vectors import integer_vectors, matrix


def initial_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors (all, if fewer) of the smallest sha256 of ``seed:id``; equal or missing hashes go by the vector, ids of null last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    return np.array([r["_vector"] for r in vectors.orderBy(key.asc_nulls_last(), "_vector").limit(k).collect()], np.int64)


def nearest(x: np.ndarray, previous: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid (ties: the smaller number), and how many distances it took."""
    apart = ((centroids[:, None] - centroids[None]) ** 2).sum(2)
    own = ((x - centroids[previous]) ** 2).sum(1)
    number, distance, looked = previous.copy(), own.copy(), len(x)
    for a in np.unique(previous).tolist():
        at = np.flatnonzero(previous == a)
        at = at[np.argsort(-own[at], kind="stable")]  # farthest first: those that still scan are the first ones
        reach = -4 * own[at]
        for j in np.argsort(apart[a], kind="stable").tolist():
            if j == a:
                continue
            live = at[: np.searchsorted(reach, -apart[a, j], "right")]
            if not len(live):
                break
            looked += len(live)
            d = ((x[live] - centroids[j]) ** 2).sum(1)
            better = (d < distance[live]) | ((d == distance[live]) & (j < number[live]))
            number[live[better]], distance[live[better]] = j, d[better]
    return number, distance, looked


def _assign(rows: DataFrame, centroids: np.ndarray, with_vectors: bool) -> DataFrame:
    """The rows with their centroid and squared distance; ``cluster`` of the input is the previous centroid."""
    dims = centroids.shape[1]
    fields = [T.StructField("_id", rows.schema["_id"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    fields += [rows.schema["_vector"]] * with_vectors

    def scan(batches):
        for batch in batches:
            x = matrix(batch.column("_vector"), dims).astype(np.int64)
            number, distance, _ = nearest(x, batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), centroids)
            columns = [batch.column("_id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())] + [batch.column("_vector")] * with_vectors
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "cluster", "distance", "_vector"][: len(columns)])

    return rows.mapInArrow(scan, T.StructType(fields))


def _moved(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the exact floor of the mean of its vectors; one without vectors stays. Sums are partial before the shuffle."""
    dims = centroids.shape[1]
    sums = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("_vector", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dims)])
    out = centroids.copy()
    for r in sums.collect():  # at most k rows
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def cluster_vectors(rows: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector of exactly ``dims`` finite components.

    Components become floor(scale * x). Null vectors, those of another length, and those with a null, non-finite or
    huge component (a squared distance that might pass 62 bits) give no row. Repeated rows each count and each give a row; an id
    of null is clustered, but is the last to become a first centroid; with fewer vectors than k there are as many centroids;
    an empty table gives an empty result. Other columns are not read, so clashing names do no harm.
    """
    spark: SparkSession = rows.sparkSession
    common.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/clusters-{uuid.uuid4().hex}"
    vectors = integer_vectors(rows.filter(F.size(vector_col) == dims), id_col, vector_col, scale, (1 << 62) / (16 * dims))
    centroids = initial_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], T.StructType([T.StructField(id_col, rows.schema[id_col].dataType)])).selectExpr(
            f"`{id_col}`", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256"
        )
    current = vectors.withColumn("cluster", F.lit(0))
    for r in range(rounds):
        _assign(current, centroids, True).write.parquet(f"{folder}/{r}")
        current = spark.read.parquet(f"{folder}/{r}")
        centroids = _moved(current, centroids)
        if r:
            common.delete_folder(spark, f"{folder}/{r - 1}")
    assigned = common.checkpoint(_assign(current, centroids, False))
    common.delete_folder(spark, folder)
    inertia = {r["cluster"]: r["n"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # at most k rows
    total = sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = spark.createDataFrame([(c, n, total, digests[c]) for c, n in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of), "cluster").select(F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
