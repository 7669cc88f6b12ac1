"""Queries over tables of odd rows give what their SQL gives."""

import datetime

import duckdb
import numpy as np
import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandloom import queries
from strandloom.functions import kernels
from strandloom.operators import graph, similar
from strandloom.queries import graphs


def compared(spark, folder, name: str, **tables) -> str:
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    return oracle.compare(queries.queries()[name](spark, str(folder)), con, queries.oracle_sql()[name])


def documents(*texts) -> dict:
    n = len(texts)
    return {"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * n, "source": ["s"] * n, "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}


def test_fractions_of_nothing(spark, tmp_path):
    assert compared(spark, tmp_path, "q_gc_nfrac", documents=documents("abc", "", "---", None, "n" * 5 + "a" * 635, "c" * 41 + "a" * 599)) == ""  # 41 / 640 is a half in the seventh digit


def test_windows_without_gc(spark, tmp_path):
    assert compared(spark, tmp_path, "q_window_identity", documents=documents("a" * 300, "a" * 90, "", None, "---", "ac" * 150)) == ""


def test_spans_as_far_as_the_reach(spark, tmp_path):
    begin = datetime.datetime(2024, 1, 1)
    rows = [(1, 0, "view"), (1, 900 + 1500, "click"), (2, 0, "view"), (2, 900 + 1501, "click"), (3, 1500, "view"), (3, 0, "click"), (4, 1501, "view"), (4, 0, "click"), (5, 899, "click"), (5, 0, "view"), (6, 0, "click")]
    events = {"event_id": list(range(len(rows))), "user_id": [r[0] for r in rows], "ts": [begin + datetime.timedelta(seconds=r[1]) for r in rows], "event_type": [r[2] for r in rows], "value": [1.0] * len(rows)}
    assert compared(spark, tmp_path, "q_point_in_interval", events=events) == ""


def embeddings(rng, n: int, *others) -> dict:
    v = [*(rng.standard_normal((n, 8)) + rng.integers(0, 3, n)[:, None]).astype(np.float32).tolist(), *others]
    return {"vec_id": list(range(len(v))), "label": [k % 2 for k in range(len(v))], "embedding": pa.array(v, pa.list_(pa.float32()))}


@pytest.mark.parametrize("name", ["q_degree", "q_multi_threshold_degree"])
def test_identities_of_vectors_without_length(spark, tmp_path, name):
    assert compared(spark, tmp_path, name, embeddings=embeddings(np.random.default_rng(1), 60, [0.0] * 8, None, [0.0] * 8)) == ""


def test_panels_in_blocks_are_those_of_the_edges(spark, tmp_path):
    pq.write_table(pa.table(embeddings(np.random.default_rng(2), 90)), f"{tmp_path}/embeddings.parquet")
    e = graphs._edges(spark, str(tmp_path)).where("ani >= 15")
    lineage = lambda c: F.when(F.col(c) % 4 != 0, (F.col(c) % 4).cast("string"))
    want = graph.grow_cliques(e.select("a", "b", F.col("ani").alias("weight"), lineage("a").alias("lineage_a"), lineage("b").alias("lineage_b")), 4)
    v = graphs._vectors(spark, str(tmp_path)).withColumn("lineage", lineage("vec_id"))
    got = similar.clique_panels(v, 15, 4, block=16)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_medians_over_copies(spark, tmp_path):
    part = {"p_partkey": [1, 2, 3, 4, 5, 6, 6, 7, 8], "p_brand": ["x"] * 5 + ["y"] * 3 + [None], "p_name": ["a b", "a b", "a b", None, "c", "a", "b", "a", "a"], "p_type": ["t"] * 9}
    assert compared(spark, tmp_path, "q_median_pair_jaccard", part=part) == ""


def test_scores_over_copies(spark, tmp_path):
    part = {"p_partkey": [9, 2, 3, 4, 1, 6, 5], "p_brand": ["x"] * 5 + ["y"] * 2, "p_name": ["red bolt", "blue nut", "red bolt", "blue nut", "green", "red", "red"], "p_type": ["LARGE"] * 7}
    assert compared(spark, tmp_path, "q_kmer_jaccard", part=part) == ""


def test_counts_of_words(spark, tmp_path):
    texts = ["abcdefghijklmnopqrstuvwxyz" * 9, "", None, "---", "a" * 14, "a" * 15, "ad" * 40, "The quick brown fox jumps over the lazy dog. " * 4]
    assert compared(spark, tmp_path, "q_kmers", documents=documents(*texts)) == ""
    rng = np.random.default_rng(5)
    for letters in ("ACGT", "ACGTN", "acgT"):
        s = "".join(rng.choice(list(letters), 400))
        assert kernels.count_kmers(s, 4) == len({min(w, kernels.rc(w)) for w in (s[i : i + 4] for i in range(397)) if "N" not in w.upper()})


def test_pool_of_offsets_is_not_broadcast(spark):
    plan = queries.queries()["q_permutation"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan


def test_pair_scores_in_blocks_and_parts(spark):
    """Every pair of rows once, its score made and finished once for its sets, whatever the blocks and the parts of keys."""
    from strandloom.operators.sets import pair_scores

    rows = [(k, "g" if k % 7 else "h", ("a b c", "b c d e", "c", "", "a b c")[k % 5]) for k in range(60)] + [(None, "g", "a"), (99, None, "a"), (3, "g", "c")]
    df = spark.createDataFrame(rows, "id long, g string, s string")
    out = pair_scores(df, ["g"], "id", "s", lambda s: F.array_distinct(F.split(s, " ")), lambda c: F.round(c, 3), block=2, part=5)
    told = sorted(map(tuple, out.collect()))
    want = []
    for i, (a, g, s) in enumerate(rows):
        for b, h, t in rows[:i]:
            if None not in (a, b, g) and g == h and a != b:
                x, y = set(s.split(" ")), set(t.split(" "))
                want.append((min(a, b), max(a, b), round(len(x & y) / len(x | y), 3), round(len(x & y) / min(len(x), len(y)), 3)))
    assert told == sorted(want)
