"""Operators against brute force on random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import seq, udf
from strandloom.operators import graph, intervals, joins, ranking, stats
from strandloom.streaming import events as stream


def test_components_against_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1064)] + [(5000, 5000 + k) for k in range(1, 200)] + [(7, 7)]
    parent = {}
    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_orientation_marks_conflicts(spark):
    e = spark.createDataFrame([(1, 2, "-"), (2, 3, "-"), (10, 11, "-"), (11, 12, "+"), (10, 12, "+")], "a long, b long, strand string")
    got = {x["node"]: (x["orient"], x["conflict"]) for x in graph.orient_components(e, graph.connected_components(e)).collect()}
    assert got[1] == ("+", False) and got[2] == ("-", False) and got[3] == ("+", False) and got[10][1] and got[12][1]


def test_heavy_split_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "HEAVY_ROWS", 1)
    rows = spark.createDataFrame([(k % 5 if k % 3 else 99, k) for k in range(900)] + [(None, -1)], "k long, v long")
    unique = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    a = joins.heavy_split_join(rows, unique, "k", "n", 901, share=0.25)
    b = rows.join(unique, "k", "left")
    assert sorted(map(str, a.select("k", "v", "n", "m").collect())) == sorted(map(str, b.select("k", "v", "n", "m").collect()))


def test_components_of_hubs_are_split(spark, monkeypatch):
    monkeypatch.setattr(joins, "HEAVY_ROWS", 1)
    r = random.Random(6)
    edges = [(0, k) for k in range(1, 300)] + [(1000 + k, 1001 + k) for k in range(60)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)]
    low = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {x["node"]: x["component"] for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in low.items() if any(a != b and k in (a, b) for a, b in edges)}


def test_scratch_removes_what_is_not_kept(spark, monkeypatch):
    import os

    from strandloom import session

    paths = []
    new = session.new_path
    monkeypatch.setattr(session, "new_path", lambda s, t: paths.append(new(s, t)) or paths[-1])
    with session.scratch(spark):
        session.materialize(spark.range(3), "a")
        with session.scratch(spark):
            session.materialize(spark.range(3), "b")
            inner = session.materialize(spark.range(3), "c", keep=True)
        assert inner.count() == 3
        kept = session.materialize(spark.range(4), "d", keep=True)
    assert kept.count() == 4
    assert [os.path.exists(p.removeprefix("file:")) for p in paths] == [False, False, False, True]


def test_size_gate_and_votes(spark):
    from strandloom.operators import verdicts

    sizes = spark.createDataFrame([("p", x) for x in (90_000, 2_000_000, 3_000_000, 900_000, 4_000_000, 5_000_000)] + [("q", 50_000)], "panel string, size long")
    got = sorted((x["panel"], x["size"], x["median"], x["floor"], x["passes"]) for x in verdicts.size_gate(sizes, ["panel"], "size").collect())
    assert [x[4] for x in got] == [False, False, True, True, True, True, False] and {x[2:4] for x in got} == {(3_000_000, 1_500_000), (50_000, 100_000)}
    votes = [("1", "A"), ("1", "A"), ("2", "A"), ("2", "B"), ("2", "B"), ("3", "A"), ("3", "B"), ("4", "ambiguous_between_A_B"), ("4", "."), ("1", "")]
    df = spark.createDataFrame([(*x, "ok") for x in votes] + [("3", "A", "unresolved"), ("5", "A", "unresolved")], "k string, allele_assignment string, allele_match_status string")
    got = {x["k"]: tuple(x)[1:] for x in verdicts.supported_allele(df, ["k"]).collect()}
    assert got == {"1": ("A", 2, 2, "unanimous"), "2": ("B", 2, 3, "majority"), "3": ("A", 1, 2, "split"), "4": (".", 0, 0, "none"), "5": (".", 0, 0, "none")}


def test_dense_ids(spark):
    keys = [(f"k{k:04d}",) for k in random.Random(1).sample(range(5000), 700)]
    got = {x["k"]: x["no"] for x in ranking.dense_ids(spark.createDataFrame(keys, "k string"), ["k"]).collect()}
    assert got == {k: i + 1 for i, (k,) in enumerate(sorted(keys))}


def test_interval_joins_against_nested_loops(spark):
    r = random.Random(4)
    left = [("c", k, (s := r.randrange(2000)), s + r.randrange(1, 200)) for k in range(60)]
    right = [("c", k, (s := r.randrange(2000)), s + r.randrange(1, 200)) for k in range(60)]
    a = spark.createDataFrame(left, "c string, l_id long, l_start long, l_end long")
    b = spark.createDataFrame(right, "c string, r_id long, r_start long, r_end long")
    for pad in (0, 30):
        got = sorted((x["l_id"], x["r_id"]) for x in intervals.overlap_join(a, b, ["c"], 64, pad).collect())
        assert got == sorted((i, j) for _, i, s, e in left for _, j, t, f in right if s < f + pad and t < e + pad)
    got = sorted((x["l_id"], x["r_id"]) for x in intervals.band_join(a, b, ["c"], 25).collect())
    assert got == sorted((i, j) for _, i, s, e in left for _, j, t, f in right if abs(s - t) <= 25 and abs(e - f) <= 25)
    merged = intervals.merge_intervals(a, ["c"], "l_start", "l_end", slack=5).collect()
    again = intervals.merge_intervals(spark.createDataFrame([("c", m["start"], m["end"]) for m in merged], "c string, start long, end long"), ["c"], slack=5).collect()
    assert sorted((m["start"], m["end"]) for m in merged) == sorted((m["start"], m["end"]) for m in again)


def test_index_quantile_is_not_a_percentile(spark):
    df = spark.createDataFrame([(float(k),) for k in (1, 2, 3, 4)], "v double")
    assert df.agg(stats.index_quantile("v", 0.5)).first()[0] == 3.0
    assert stats.ranked_quantile(df.withColumn("g", F.lit(1)), ["g"], "v", 0.5).first()["q"] == 3.0


def test_sequence_expressions(spark):
    df = spark.createDataFrame([("ACGTN", "ACGAN"), ("", ""), ("AAAA", "TTTT")], "a string, b string")
    got = df.select(seq.common_prefix("a", "b"), seq.identity("a", "b"), seq.canon_key("a") == seq.canon_key(seq.revcomp("a")), seq.hamming("a", "b")).collect()
    assert [tuple(x) for x in got] == [(3, 0.8, True, 1), (0, 1.0, True, 0), (0, 0.0, True, 4)]
    assert df.select(seq.window("a", F.lit(-3), F.lit(2))).first()[0] == "AC"


def test_udfs_are_callable_from_sql(spark):
    udf.register(spark)
    row = spark.sql("select insert_key('ACGTACGT', 2, 3) as k, decompose('ACGT', 'ACCCGT').insert as i, inverted_repeat('ACGTACGTAAACGTACGT') as t, tsd(null, 'A', 'C').tsd_len as n").first()
    assert len(row["k"]) == 16 and row["i"] == "CC" and row["t"] == 8 and row["n"] is None


@pytest.mark.parametrize("what", ["sessions", "first", "loci"])
def test_streams_agree_with_batches(spark, tmp_path, what):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = stream.read_stream(spark, str(tmp_path / "in"), src.schema)
    out = {"sessions": lambda: stream.sessions(s, "user_id", late="40 days"), "first": lambda: stream.first_of_each(s, ["user_id", "event_type"], late="40 days"), "loci": lambda: stream.distinct_loci(s, "user_id")}[what]()
    q = out.writeStream.format("memory").queryName(f"out_{what}").outputMode("complete" if what == "sessions" else "append" if what == "first" else "update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = spark.table(f"out_{what}")
    if what == "sessions":
        assert got.agg(F.sum("n")).first()[0] == src.count()
    elif what == "first":
        assert got.count() == src.select("user_id", "event_type").distinct().count()
    else:
        batch = intervals.distinct_loci(src.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))), ["user_id"], "t", 3_600_000_000)
        assert {x["user_id"]: x["n"] for x in got.collect()} == {x["user_id"]: x["n_loci"] for x in batch.collect()}
