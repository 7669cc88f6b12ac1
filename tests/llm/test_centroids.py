"""Clusters of quantised vectors against plain Python."""

import hashlib
import math

import numpy as np
import pytest

from strandloom.llm.centroids import cluster

BAD = [(900, None), (901, []), (902, [1.0, None, 0.0]), (903, [math.nan, 0.0, 0.0]), (904, [0.0, -math.inf, 0.0]), (905, [1.0, 2.0])]


def sample(n=150, seed=1):
    r = np.random.default_rng(seed)
    v = r.choice([-0.5, 0.1, 0.6], (n, 3)) + 0.05 * r.standard_normal((n, 3))
    v[n // 4 : n // 2] = v[n // 4]  # a quarter of all rows is one vector
    v[0] = 0
    return [(int(k), [float(np.float32(x)) for x in row]) for k, row in enumerate(v)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, n long, key string, cluster int")


def plain(rows, k=8, rounds=10, dim=3, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'null' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted((name(i), v) for i, v in kept)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        to = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            own = [v for (_, v), t in zip(kept, to, strict=True) if t == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    return [(i, j, d, sum(x[1] for x in last if x[2] == j), sum(x[1] for x in last), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in last]


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("rows", [sample() + BAD, sample(6), [*sample(40), (None, [0.5, 0.5, 0.5]), (5, [0.2, 0.1, 0.0]), (5, [0.2, 0.1, 0.0])]])
def test_against_plain_python(spark, rows):
    assert order(cluster(frame(spark, rows), dim=3).collect()) == order(plain(rows))


def test_empty_and_useless_tables(spark):
    assert cluster(frame(spark, [])).count() == 0
    assert cluster(frame(spark, BAD), dim=3).count() == 0


def test_partitions_do_not_matter(spark):
    df = frame(spark, sample())
    assert order(cluster(df.repartition(1), dim=3).collect()) == order(cluster(df.repartition(13), dim=3).collect())


def test_components_that_do_not_fit_raise(spark):
    with pytest.raises(ValueError):
        cluster(frame(spark, [(1, [1e30, 0.0, 0.0])]), dim=3)
