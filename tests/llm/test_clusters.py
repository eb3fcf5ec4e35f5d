"""Clustering against plain Python integers, and its cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from weatherloom.llm import clusters


def brute(vectors, k, rounds, dims, scale, seed=3):
    """``{position: (cluster, distance)}`` and the final centroids, with unbounded integers and no shortcuts."""
    kept = {i: [math.floor(scale * x) for x in v] for i, (_, v) in enumerate(vectors) if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)}
    name = {i: "" if vectors[i][0] is None else str(vectors[i][0]) for i in kept}
    first = sorted(kept, key=lambda i: (hashlib.sha256(f"{seed}:{name[i]}".encode()).hexdigest(), kept[i]))[:k]
    centroids = [kept[i] for i in first]

    def assign():
        return {i: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for i, v in kept.items()}

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            own = [kept[i] for i in kept if found[i][1] == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    return assign(), centroids


def rows_of(spark, vectors):
    return spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], "x", 1) for i, v in vectors], "vec_id long, embedding array<float>, cluster string, inertia int")


@pytest.mark.parametrize("k", [3, 8])
def test_equals_plain_python(spark, k):
    rng = random.Random(k)
    vectors = [(i, [rng.choice([-1, 0, 1]) * rng.random() for _ in range(4)]) for i in range(120)]
    vectors += [(200, [0.5] * 4)] * 40 + [(None, [0.25] * 4)] * 3 + [(300, None), (301, [0.1] * 3), (302, [0.1, None, 0.2, 0.3]), (303, [0.1, float("nan"), 0, 0]), (304, [float("inf"), 0.0, 0.0, 0.0])]
    want, centroids = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors], k, 5, 4, 64)
    got = clusters.cluster(rows_of(spark, vectors).repartition(3), dims=4, scale=64, k=k, rounds=5).collect()
    total, per = sum(d for d, _ in want.values()), {}
    for d, j in want.values():
        per[j] = per.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    expected = sorted(((vectors[i][0], j, d, per[j], total, digest[j]) for i, (d, j) in want.items()), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == expected


def test_only_changed_components_are_added(spark):
    old, new = np.array([[1, 2, 3], [4, 5, 6]]), np.array([[1, 0, 3], [4, 5, 6]])
    (moved,) = clusters.changes(old, new)
    assert moved[0] == 0 and moved[1].tolist() == [1] and moved[2].tolist() == [-2]


def test_ties_go_to_the_smaller_number(spark):
    vectors = [(i, [float(i % 2)] * 2) for i in range(8)]
    got = {r.vec_id: r.cluster for r in clusters.cluster(rows_of(spark, vectors), dims=2, scale=1, k=8, rounds=2).collect()}
    want, _ = brute(vectors, 8, 2, 2, 1)
    assert got == {i: j for i, (_, j) in want.items()} and len(set(got.values())) == 2


def test_empty_and_useless_tables(spark):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    for vectors in ([], [(1, None)], [(1, [1.0])]):
        got = clusters.cluster(rows_of(spark, vectors), dims=2)
        assert got.columns == names and got.count() == 0


def test_a_component_without_exact_distance_is_an_error(spark):
    with pytest.raises(Exception, match="no exact 64-bit distance"):
        clusters.cluster(rows_of(spark, [(1, [3e38, 0.0]), (2, [0.0, 0.0])]), dims=2).count()
