"""Centroid clustering with an incremental distance matrix over integer vectors.

Components are integers floor(scale * x), so every number below is exact. Each vector's row keeps its dot products with all
centroids. When a centroid moves, only its components that changed count: dot += sum(x[i] * change[i]) over them. The squared
distance is |x|^2 - 2 dot + |c|^2, and the nearest centroid is the first smallest. The first round is the move from the
zero vector. Rows are rewritten once a round to the shared folder and the rows of the round before are deleted; the driver
holds ``k`` centroids and gets ``k`` rows of sums a round.

A vector counts if it has exactly ``dims`` components, none null or non-finite; others are left out. Null ids: the vector
is kept, its id counts as empty text when the starting vectors are drawn. Repeated rows are vectors of their own. Fewer
vectors than ``k``: as many centroids. Empty table: no rows. Ties: the smaller centroid. Extra columns are ignored.
A component so large that distances leave 64 bits (2^27 after scaling, for 64 components) is an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weatherloom.llm.shared import delete, new_path

RESULT = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def quantised(vectors: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """``(id, x)`` of the vectors that count; ``x`` are integers."""
    most = math.isqrt(2**60 // dims)
    x = F.transform(vector, lambda v: v.cast("double"))
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.filter(F.size(vector) == dims).select(F.col(key).alias("id"), x.alias("x")).filter(whole)
    too_large = F.raise_error(F.lit(f"a component beyond {most} has no exact 64-bit distance")).cast("int")
    return kept.select("id", F.transform("x", lambda v: F.when(F.abs(v * scale) > most, too_large).otherwise(F.floor(v * scale).cast("int"))).alias("x"))


def starting(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``seed:id``, in that order; of equal ids by components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r["x"]) for r in rows.select(order.alias("o"), "x").orderBy("o", "x").limit(k).collect()]


def changes(old: np.ndarray, new: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(centroid, changed components, by how much)`` of the centroids that moved."""
    by = new - old
    return [(j, np.flatnonzero(d), d[d != 0]) for j, d in enumerate(by) if d.any()]


def updated(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """The rows with dot products, cluster and distance for the new centroids."""
    moves, squares = changes(old, new), (new * new).sum(1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = b.column("x").flatten().to_numpy().reshape(n, -1).astype(np.int64)
            dots = b.column("dots").flatten().to_numpy().reshape(n, -1).copy()
            for j, where, by in moves:
                dots[:, j] += x[:, where] @ by
            distances = (x * x).sum(1)[:, None] - 2 * dots + squares
            nearest = distances.argmin(1)
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * dots.shape[1])
            columns = [b.column("id"), b.column("x"), pa.ListArray.from_arrays(ends, pa.array(dots.ravel()))]
            columns += [pa.array(nearest.astype(np.int32)), pa.array(distances[np.arange(n), nearest])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "x", "dots", "cluster", "distance"])

    kind = dict(state.dtypes)["id"]
    return state.mapInArrow(rows, f"id {kind}, x array<int>, dots array<long>, cluster int, distance long")


def centroids_of(state: DataFrame, old: np.ndarray) -> np.ndarray:
    """The exact floor of each cluster's mean; an empty cluster keeps its centroid."""
    sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(old.shape[1])])
    new = old.copy()
    for r in sums.collect():
        new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(old.shape[1])]
    return new


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: int = 3
) -> DataFrame:
    """Columns ``key``, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 (of the components joined by commas)."""
    spark = vectors.sparkSession
    rows = quantised(vectors, key, vector, dims, scale)
    centroids = np.array(starting(rows, k, seed), np.int64).reshape(-1, dims)
    if not len(centroids):
        return rows.select(F.col("id").alias(key), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in RESULT.split(", ")])
    state = rows.withColumn("dots", F.array_repeat(F.lit(0).cast("long"), len(centroids)))
    known, path = np.zeros_like(centroids), None
    for nth in range(rounds + 1):
        before, path = path, new_path(spark, "clusters")
        updated(state, known, centroids).write.parquet(path)
        state = spark.read.parquet(path)
        if before:
            delete(spark, before)
        if nth == rounds:
            break
        known, centroids = centroids, centroids_of(state, centroids)
        if np.array_equal(known, centroids):
            break  # nothing moved, so no later round changes anything
    inertia = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    found = [(j, inertia[j], sum(inertia.values()), digests[j]) for j in inertia]
    about = spark.createDataFrame(found, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return state.join(F.broadcast(about), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same with one common table for every assignment and every centroid table."""
    exact = "CAST(floor(CAST(x AS DOUBLE) * {0}) AS BIGINT)".format(scale)
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: {exact}) AS v FROM embeddings "
        f"WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        "long AS MATERIALIZED (SELECT r, unnest(v) AS x, unnest(range(1, " f"{dims + 1})) AS i FROM kept)",
        f"first AS (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c FROM kept "
        f"QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) <= {k})",
        f"c0 AS MATERIALIZED (SELECT c, unnest(v) AS y, unnest(range(1, {dims + 1})) AS i FROM first)",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, sum((x - y) * (x - y)) AS d "
            f"FROM long JOIN c{n} USING (i) GROUP BY r, c) GROUP BY r)"
        )
        if n < rounds:
            parts.append(
                f"c{n + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(m.y, o.y) AS y FROM c{n} o LEFT JOIN (SELECT c, i, (s - ((s % n) + n) % n) // n AS y "
                f"FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN long USING (r) GROUP BY c, i)) m USING (c, i))"
            )
    parts.append(f"digest AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)")
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, "
        f"CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 "
        f"FROM a{rounds} JOIN kept USING (r) JOIN digest USING (c)"
    )
