"""Vector links and top-k against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm.vectors import KdTree, encode, near_duplicates, rotation, top_k

BAD = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [math.nan] * 8), (905, [math.inf] + [0.0] * 7), (906, [1.0] * 5), (907, [2.0] * 5), (908, [3.0])]


def sample(seed=1, n=160, dim=8):
    r = np.random.default_rng(seed)
    base = r.standard_normal((25, dim))
    v = base[r.integers(0, 25, n)] + r.choice([0, 0.02, 0.15], (n, 1)) * r.standard_normal((n, dim))
    v[10] = v[11] = v[12]
    v[13] = 3 * v[12]
    return [(int(k), [float(np.float32(x)) for x in row]) for k, row in enumerate(v)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, key string")


def links(rows, threshold=0.95):
    good = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))
    near = {k: [m for m in good if m != k and len(good[m]) == len(good[k]) and good[k] @ good[m] >= threshold] for k in good}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in near.get(todo.pop(), []):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        c = min(rows[m][0] for m in seen)
        out.append((i, len(near.get(k, [])), c, i == c))
    return sorted(out)


def test_links_against_all_pairs(spark):
    rows = sample() + BAD + [(5, sample()[5][1]), (2000, sample()[7][1])]
    for block in (32, 8192):
        assert sorted(map(tuple, near_duplicates(frame(spark, rows), block=block).collect())) == links(rows)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert near_duplicates(none).count() == 0
    assert top_k(none, F.col("vec_id") % 2 == 0).count() == 0
    assert near_duplicates(frame(spark, BAD)).count() == len(BAD)


def test_estimate_is_unbiased_and_bounded():
    r = np.random.default_rng(3)
    q = np.eye(64)[0]
    o = np.stack([0.9 * np.eye(64)[0] + math.sqrt(1 - 0.81) * (x / np.linalg.norm(x)) for x in np.concatenate([np.zeros((3000, 1)), r.standard_normal((3000, 63))], axis=1)])
    codes, f = encode(o)
    signs = (np.unpackbits(codes, axis=1).astype(float) * 2 - 1) / 8.0
    est = signs @ (rotation(64) @ q) / f
    assert abs(est.mean() - 0.9) < 0.005
    sd = np.sqrt((1 - f**2) / f**2 / 63) * math.sqrt(1 - 0.81)
    assert (np.abs(est - 0.9) < 5 * sd).all() and 0.8 < (est - 0.9).std() / sd.mean() < 1.2


def test_top_k_against_brute_force(spark):
    rows = sample(2) + BAD + [(3000 + k, sample(2)[4][1]) for k in range(12)]
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in good:
        if q % 5 == 0:
            found = sorted((-sum(a * b for a, b in zip(good[q], good[m], strict=True)), m) for m in good if m != q and len(good[m]) == len(good[q]))[:5]
            want += [(q, k + 1, m, -s) for k, (s, m) in enumerate(found)]
    for shard, block in ((20, 7), (8192, 2048)):
        got = top_k(frame(spark, rows), F.col("vec_id") % 5 == 0, shard=shard, block=block).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_large_components_stay_exact(spark):
    rows = [(k, [float(2.0 ** (19 + k % 3)), float(k), -float(k * k)]) for k in range(20)]
    good = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows}
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in top_k(frame(spark, rows), F.col("vec_id") < 3, shard=6).collect()}
    for q in range(3):
        found = sorted((-sum(a * b for a, b in zip(good[q], good[m], strict=True)), m) for m in good if m != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(m, -s) for s, m in found]


def test_tree_boxes_are_tight():
    r = np.random.default_rng(1)
    rows = np.floor(r.standard_normal((500, 6)) * 100)
    t = KdTree(np.arange(500), rows, leaf=16)
    q = r.standard_normal((20, 6))
    bounds = t.bounds(q)
    for n, (b, e, left, _) in enumerate(t.nodes):
        assert (bounds[:, n] >= (q @ t.rows[b:e].T).max(axis=1) - 1e-9).all()
        assert left >= 0 or e - b <= 16


def test_quantised_estimates_rule_out_no_link():
    from strandloom.llm.vectors import quantise, undecided

    r = np.random.default_rng(8)
    x = r.standard_normal((300, 64))
    x[200:] = x[:100] + 0.04 * r.standard_normal((100, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    whole, scale, off = quantise(x @ rotation(64).T)
    assert whole.dtype == np.int8 and (np.abs(x @ rotation(64).T - whole * scale[:, None]).sum(axis=1) <= off + 1e-5).all()
    xs, ys = undecided(whole, scale, off, *encode(x), 0.95, True)
    linked = {int(k) for pair in np.argwhere(np.triu(x @ x.T >= 0.95, 1)) for k in pair}
    assert linked <= set(xs.tolist()) == set(ys.tolist()) and len(linked) > 150 and len(xs) < 290


def test_many_lengths_and_repeated_ids(spark):
    rows = [(k, [1.0] * (k // 2 + 1)) for k in range(400)]
    got = near_duplicates(frame(spark, rows)).collect()
    assert sorted((x["vec_id"], x["n_links"], x["component_id"]) for x in got) == [(k, 1, k - k % 2) for k in range(400)]
    assert top_k(frame(spark, rows), F.col("vec_id") % 2 == 0).count() == 200


def test_query_rows_with_one_id_get_a_list_each(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [0.5, 0.25])]
    for shard in (2, 8192):
        got = sorted(map(tuple, top_k(frame(spark, rows), F.col("vec_id") == 50, k=3, shard=shard).collect()))
        one, two = 256 * 256, 256 * 512
        assert got == sorted([(50, 1, 1, 3 * one), (50, 2, 2, one), (50, 3, 2, one), (50, 1, 2, two), (50, 2, 2, two), (50, 3, 1, one)])


def test_only_the_own_row_is_left_out(spark):
    rows = [(50, [1.0, 0.0]), (50, [2.0, 0.0]), (7, [0.5, 0.0]), (8, [0.25, 1.0])]
    one = 256 * 256
    for shard in (1, 2, 8192):
        got = sorted(map(tuple, top_k(frame(spark, rows), F.col("vec_id") == 50, shard=shard).collect()))
        assert got == sorted([(50, 1, 50, 2 * one), (50, 2, 7, one // 2), (50, 3, 8, one // 4), (50, 1, 50, 2 * one), (50, 2, 7, one), (50, 3, 8, one // 2)])


def test_scores_that_do_not_fit_raise(spark):
    rows = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1e17, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        top_k(rows, F.col("vec_id") == 0)
