"""Table functions, the aggregate, sketches, and the stateful stream against its batch image."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from strandloom.functions import kernels as k
from strandloom.functions import udf
from strandloom.operators import sketch
from strandloom.streaming import dedup
from strandloom.streaming.events import read_stream


@pytest.fixture(scope="module")
def sql(spark):
    udf.register(spark)
    return spark.sql


def test_table_functions(sql):
    s = "ACGTNACGGT"
    got = sql(f"select * from kmers('{s}', 4)").collect()
    assert [(x["at"], x["word"], x["canonical"]) for x in got] == [(p, s[p : p + 4], min(s[p : p + 4], k.rc(s[p : p + 4]))) for p in (0, 5, 6)]
    assert sql("select * from kmers(null, 4)").count() == 0 == sql("select * from kmers('ACG', 4)").count() == sql("select * from kmers('ACG', 0)").count()
    got = sql("select * from fasta_records('junk\n>a one two\nAC GT\nTT\n>b\n\n>\nGG')").collect()
    assert [tuple(x) for x in got] == [("a", "one two", "ACGTTT"), ("b", "", ""), ("", "", "GG")]
    orf = "CC" + "ATG" + "GCT" * 35 + "TAA" + "C"
    got = sql(f"select * from orf_scan('{k.rc(orf)}', 30)").collect()
    assert [(x["strand"], x["aa"], x["protein"]) for x in got] == [("-", 36, "M" + "A" * 35)]


def test_interval_groups_by_partition(spark, sql):
    r = random.Random(3)
    rows = [(n, r.choice("ab"), s := r.randrange(200), s + r.randrange(20, 60)) for n in range(80)] + [(900, "a", None, 5)]
    t = spark.createDataFrame(rows, "id long, contig string, start long, end long")
    got = {x["id"]: x["group_no"] for x in sql("select * from interval_groups(table({t}) partition by (contig), 0.7)", t=t).collect()}
    want = {}
    for c in "ab":
        own = [(s, e, n) for n, x, s, e in rows if x == c and s is not None]
        want |= {n: g for (_, _, n), g in zip(own, k.interval_groups(own, 0.7), strict=True)}
    assert got == want


def test_aggregate(spark, sql):
    rows = [(n % 3, None if n % 7 == 0 else float(n)) for n in range(50)] + [(9, None)]
    got = {x["g"]: x["q"] for x in sql("select g, index_quantile(x, 0.5) as q from {t} group by g", t=spark.createDataFrame(rows, "g long, x double")).collect()}
    for g in range(3):
        own = sorted(x for n, x in rows if n == g and x is not None)
        assert got[g] == own[min(len(own) - 1, len(own) // 2)]
    assert got[9] != got[9] or got[9] is None


def test_sketch_identity_is_near_that_of_whole_sets(spark):
    r = random.Random(6)
    base = "".join(r.choices("ACGT", k=60_000))
    items = [(0, base), (5, None), (6, "ACGT"), (7, "".join(r.choices("ACGT", k=30_000)))]
    items += [(n, "".join(r.choice("ACGT") if r.random() < rate else x for x in base[: 60_000 - 5000 * n])) for n, rate in ((1, 0.01), (2, 0.03), (3, 0.0), (4, 0.05))]
    df = spark.createDataFrame(items, "item long, seq string")
    got = {(x["a"], x["b"]): x for x in sketch.sketch_identity(sketch.sketches(df, scale=20), least=0.05, block=16).collect()}
    sets = {n: {min(s[p : p + 21], k.rc(s[p : p + 21])) for p in range(len(s) - 20)} for n, s in items if s}
    for a, b in ((0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (2, 3)):
        exact = (len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b]))) ** (1 / 21)
        assert abs(got[a, b]["identity"] - exact) < 0.01
    assert not any(7 in p or 5 in p or 6 in p for p in got)
    assert got[0, 3]["containment"] == 1.0


def test_sketches_of_cells_are_all_pairs(spark):
    r = random.Random(2)
    rows = sorted({(r.randrange(40), h) for h in range(60) for _ in range(r.choice([1, 2, 30]))})
    got = {(x["a"], x["b"]): x["shared"] for x in sketch.sketch_identity(spark.createDataFrame(rows, "item long, hash long"), least=0.0, block=4).collect()}
    own = {n: {h for m, h in rows if m == n} for n, _ in rows}
    assert got == {(a, b): len(own[a] & own[b]) for a in own for b in own if a < b and own[a] & own[b]}


def seen(rows):
    """A sequential version: an event that isn't seen for an hour is a new one."""
    state, out = {}, []
    for key, context, source, at in sorted(rows, key=lambda r: (r[3], r[2])):
        last, sources = state.get((key, context), (None, set()))
        if last is not None and at - last > 3600:
            sources = set()
        if source not in sources:
            sources = sources | {source}
            out.append((key, context, source, at, len(sources)))
        state[key, context] = at, sources
    return sorted(out)


def test_stream_equals_batch_and_its_state_ends(spark):
    r = random.Random(9)
    rows = [(f"k{r.randrange(12)}", r.choice("xy"), f"s{r.randrange(5)}", t + r.randrange(60)) for t in range(0, 40_000, 90)]
    schema = "insert_key string, context_key string, source string, ts timestamp"
    frame = lambda part: spark.createDataFrame(part, "insert_key string, context_key string, source string, at long").select("insert_key", "context_key", "source", F.timestamp_seconds("at").alias("ts"))
    rows.sort(key=lambda x: x[3])
    plain = lambda df: sorted((x["insert_key"], x["context_key"], x["source"], int(x["at"]), x["n_sources"]) for x in df.withColumn("at", F.col("at").cast("long")).collect())
    assert plain(dedup.event_sightings_batch(frame(rows), keep="1 hour")) == seen(rows)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    dedup.use_state_store(spark)
    try:
        folder, checkpoint = tempfile.mkdtemp(prefix="stream-"), tempfile.mkdtemp(prefix="state-")
        source = read_stream(spark, folder, schema)
        out = dedup.event_sightings(source, late="0 seconds", keep="1 hour")
        query = out.writeStream.format("memory").queryName("sightings").option("checkpointLocation", checkpoint).outputMode("append").start()
        for n in range(0, len(rows), 150):
            frame(rows[n : n + 150]).coalesce(1).write.mode("append").parquet(folder)
            query.processAllAvailable()
        late = [("late", "x", "s1", 200_000)]
        frame(late).coalesce(1).write.mode("append").parquet(folder)
        query.processAllAvailable()
        totals = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert plain(spark.table("sightings")) == seen(rows + late)
    assert max(totals) > 20 and totals[-1] < 10, "state behind the watermark is gone"


def test_empty_streams_of_nulls(spark):
    none = spark.createDataFrame([(None, "x", "s", 1), ("k", "x", None, 2)], "insert_key string, context_key string, source string, at long").withColumn("ts", F.timestamp_seconds("at"))
    assert dedup.event_sightings_batch(none).count() == 0


def test_words_are_hashed_together_as_one_by_one(monkeypatch):
    """The hashes of a sequence's words are those of MD5, and no word of ordinary letters is hashed on its own."""
    r = random.Random(8)
    texts = ["".join(r.choices("ACGTN" if n % 2 else "ACGT", [9, 9, 9, 9, 1][: 5 if n % 2 else 4], k=n)) for n in (0, 1, 20, 21, 22, 90, 401, 20_011)]
    texts += ["ACGT" * 20, "N" * 40, "acgtRYK*-" * 9, "A" * 25, "ÄCGT" * 10, "acgt" * 30]
    for k_ in (1, 4, 15, 21, 32, 55, 60):
        for most in (16**sketch.DIGITS, 16**sketch.DIGITS // 5):
            want = [sorted({h for p in range(len(s) - k_ + 1) if "N" not in (w := s[p : p + k_]) and (h := sketch.word_hash(w)) < most}) for s in texts]
            found = sketch.own_hashes(texts, k_, most)
            assert [sorted(found["hash"][found["row"] == n].tolist()) for n in range(len(texts))] == want
    monkeypatch.setattr(sketch, "word_hash", lambda w: pytest.fail(f"{w} was hashed on its own"))
    assert len(sketch.own_hashes(texts[:10], 21, 16**sketch.DIGITS)) > 10_000
