"""The inverted multi-index against brute force: exact where all cells are opened, and by recall."""

import math

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm.multiindex import Codebook, fit_half, nearest, opened

BAD = [(900, None), (901, []), (902, [0.0, -0.0] * 3), (903, [1.0, None, 0.0]), (904, [math.nan] * 6), (905, [math.inf] + [0.0] * 5), (906, [1.0] * 5), (907, [2.0] * 5), (908, [3.0]), (None, [1.0] * 6)]


def sample(n=300, dim=6, seed=4):
    r = np.random.default_rng(seed)
    v = r.standard_normal((n, dim))
    v[100:200] = v[100]  # a third of all rows is one vector
    return [(int(k), [float(np.float32(x)) for x in row]) for k, row in enumerate(v)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, row long, cell long, shard string")


def brute(rows, step, k=20):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (q, x) in enumerate(good):
        if q % step == 0:
            found = sorted((-float((y * x).sum()), i) for b, (i, y) in enumerate(good) if b != a and len(y) == len(x))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_all_cells_are_exact(spark):
    rows = sample() + BAD + [(20, sample()[7][1]), (20, sample()[8][1]), (1, sample()[100][1])]
    for shard, block in ((32, 7), (8192, 2048)):
        got = nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, first=10**6, shard=shard, block=block).collect()
        assert sorted(map(tuple, got)) == brute(rows, 20)


def test_recall_where_few_cells_are_opened(spark):
    r = np.random.default_rng(9)
    centre = r.standard_normal((60, 16))
    rows = [(k, (centre[k % 60] + 0.3 * r.standard_normal(16)).tolist()) for k in range(4000)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 40 == 0, first=64, sample=1024).collect()
    want = {(q, i) for q, _, i, _ in brute(rows, 40)}
    assert len(got) == 100 * 20 and len(want & {(x["query_id"], x["vec_id"]) for x in got}) >= 0.95 * len(want)


def test_empty_tables_and_few_candidates(spark):
    assert nearest(frame(spark, []), F.lit(True)).count() == 0
    assert nearest(frame(spark, BAD[:6]), F.lit(True)).count() == 0
    got = nearest(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0])]), F.lit(True)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2, 5.0), (2, 1, 1, 5.0)]
    assert nearest(frame(spark, sample()), F.lit(None).cast("boolean")).count() == 0


def test_very_large_components(spark):
    rows = [(k, [1e200 * (k + 1), 1.0, -1e180]) for k in range(30)] + [(30, [1.0, 1.0, 1.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert len(got) == 2 * 20


def test_cells_come_in_the_order_of_their_sums():
    r = np.random.default_rng(2)
    x = r.standard_normal((400, 6))
    one, var_one = fit_half(x[:, :3], 7)
    two, var_two = fit_half(x[:, 3:], 7)
    book = Codebook(6, 0, 7, 1.0, (one, var_one, two, var_two))
    cells = book.cells(x)
    assert all(np.linalg.norm(x[k, :3] - one[cells[k] // 7]) <= np.linalg.norm(x[k, :3] - one, axis=1).min() + 1e-9 for k in range(400))
    counts = np.bincount(cells, minlength=49)
    q = r.standard_normal(6)
    near = [(c, s) for c, s, _ in book.traverse(q, counts)]
    sums = (one @ q[:3])[:, None] + (two @ q[3:])[None]
    assert [c for c, _ in near] == sorted(np.flatnonzero(counts).tolist(), key=lambda c: -sums.ravel()[c])
    home = opened(book, q, counts, 50, None, 3)
    assert counts[home].sum() >= 50 > counts[home[:-1]].sum()
    more = opened(book, q, counts, 50, -math.inf, 3)
    assert sorted(home + more) == sorted(np.flatnonzero(counts).tolist())
    assert set(opened(book, q, counts, 50, 3.0, 2)) < set(more)
