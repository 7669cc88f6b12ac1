"""Readers and writers on small files."""

import pytest
from pyspark.sql import functions as F

from strandloom.operators.gates import GateError, assert_join_rate, assert_no_collision, evaluate_gates
from strandloom.sources import readers as r
from strandloom.sources import writers as w


def values(spark, *rows):
    return spark.createDataFrame([(x,) for x in rows], "value string")


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "g.fna").write_text(">c1 first contig\nACGT\nacgt\n>c2\nNNNN\n\n>c3 empty\n")
    f = {x["contig"]: x for x in r.fasta(spark, str(tmp_path / "g.fna")).collect()}
    assert f["c1"]["seq"] == "ACGTACGT" and f["c1"]["description"] == "first contig" and f["c2"]["len"] == 4 and f["c3"]["seq"] == ""
    df = spark.createDataFrame([("a", "A" * 170)], "contig string, seq string")
    w.write_fasta(df, str(tmp_path / "out"))
    back = r.fasta(spark, str(tmp_path / "out")).collect()
    assert [(x["contig"], x["seq"]) for x in back] == [("a", "A" * 170)]
    with pytest.raises(Exception, match="exists"):
        w.write_fasta(df, str(tmp_path / "out"))
    st = r.assembly_stats(r.fasta(spark, str(tmp_path / "g.fna"))).collect()[0]
    assert (st["n"], st["total"], st["n50"]) == (3, 12, 8)


def test_fetch_clamps(spark):
    df = spark.createDataFrame([("ACGTA",)], "s string")
    got = df.select(*(r.fetch(F.col("s"), F.lit(a), F.lit(b)).alias(f"x{i}") for i, (a, b) in enumerate([(1, 3), (-2, 2), (3, 99), (4, 2)]))).first()
    assert list(got) == ["CG", "AC", "TA", ""]


def test_paf(spark):
    line = "\t".join(["q", "100", "0", "90", "+", "t", "200", "5", "95", "88", "90", "60", "de:f:0.02", "cg:Z:90M", "NM:i:2"])
    p = r.paf(values(spark, line, "#c", "short\tline")).collect()
    assert len(p) == 1 and p[0]["tags"] == {"de": "0.02", "cg": "90M", "NM": "2"} and p[0]["mapq"] == 60


def test_call_records(spark):
    recs = values(spark, ">s3:1443:+:NC_003098.1:40181:41626", "*:0:+:c:1:1", "<s3:100:-:chr2:900:1002", "*", "")
    got = [x[0] for x in recs.select(r.call_record(F.col("value")).alias("c")).collect()]
    assert got[0]["allele_len"] == 1443 and got[0]["qe"] - got[0]["qs"] == 1445, "path length and span differ"
    assert got[1]["allele_len"] == 0 and got[2]["strand"] == "-" and got[3] is None and got[4] is None


def test_bubbles_last_duplicate_wins(spark):
    row = lambda n: "\t".join(["c", "1", "9", "3", "2", "0", str(n), "10", "-1", "-1", "-1", "x", "a", "c"])
    b = r.bubbles(spark.createDataFrame([(1, row(5)), (2, row(7)), (3, "bad")], "line long, value string")).collect()
    assert [x["len_shortest"] for x in b] == [7] and b[0]["seq_long"] == "C"


def test_vcf_gff_tblout_and_headers(spark):
    v = r.insertions(values(spark, "c\t5\t.\tN\tNACG\t.\tPASS\tSVTYPE=INS;SVLEN=400", "c\t5\t.\tN\tN\t.\tPASS\tSVTYPE=DEL;SVLEN=-400", "#h")).collect()
    assert [(x["svlen"], x["insert_seq"]) for x in v] == [(400, "ACG")]
    g = r.gff_cds(values(spark, "c\tx\tCDS\t11\t20\t.\t-\t0\tID=g1;Name=n")).first()
    assert (g["start"], g["end"], g["cds_id"]) == (10, 20, "g1")
    t = r.tblout(values(spark, "p1 - m2 PF2 1e-3 50 x", "p1 - m1 PF1 1e-9 90 x", "# c")).first()
    assert (t["query"], t["score"], t["evalue"]) == ("m1", 90.0, 1e-9)
    h = r.gene_headers(values(spark, "rec_1_2 # 3 # 99 # -1 # ID")).first()
    assert (h["record"], h["start"], h["strand"]) == ("rec_1", 3, -1)
    assert values(spark, "ID=a;Name=16S_rRNA;x=1").select(r.gff_name(F.col("value"))).first()[0] == "16S_rRNA"


def test_pangraph_dialects_and_coords(spark):
    a, b = '{"paths": {"p": {"name": "g", "nodes": ["1", "2"]}}}', '{"paths": [{"name": "h", "blocks": ["9"]}]}'
    got = sorted((x["name"], x["pos"], x["node"]) for x in r.pangraph_paths(values(spark, a, b)).collect())
    assert got == [("g", 0, "1"), ("g", 1, "2"), ("h", 0, "9")]
    c = r.coords(values(spark, "1 100 200 101 x")).first()
    assert tuple(c) == (0, 100, 100, 200, "-")


def test_jsonl_sites_keep_broken_lines(spark):
    s = r.jsonl_sites(values(spark, '{"site_id": "a", "noncoding_regions": ["AC"]}', "{broken", " ")).collect()
    assert len(s) == 2 and {x["bad"] for x in s} == {None, "{broken"}


def test_tables(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x,y,z\n1,2,3\n")
    assert r.sniffed(spark, str(tmp_path / "a.tsv")).first()["y"] == "2"
    (tmp_path / "e.txt").write_text("a\tb\t99.5\t80\na\tc\tbad\t1\n")
    assert sorted((e["a"], e["b"]) for e in r.edges(spark, str(tmp_path / "e.txt")).collect()) == [("a", "b"), ("b", "a")]
    empty = spark.createDataFrame([], "b string, a int")
    w.write_tsv(empty, str(tmp_path / "t"), ["a", "b"])
    assert r.tsv(spark, str(tmp_path / "t")).columns == ["a", "b"]
    one = spark.createDataFrame([(1, "<x>")], "k int, v string")
    assert [tuple(x) for x in w.params(one).collect()] == [("k", "1"), ("v", "<x>")]
    assert "&lt;x&gt;" in w.report(one, "t")
    w.write_fan_out(one, str(tmp_path / "fan"), ["k"], "v")
    assert (tmp_path / "fan" / "k=1").is_dir()
    assert values(spark, "/x/s1_events.tsv").select(r.key_from_path(F.col("value"))).first()[0] == "s1"


def test_manifest_and_gates(spark):
    assert r.manifest(["/a/x.fna", "/b/y.fna"]) == ["/a/x.fna", "/b/y.fna"]
    for bad in (["/a/x"], ["/a/x", "/a/x"], ["/a/x", "/b/x"], ["/a/x.gz", "/a/y"]):
        with pytest.raises(GateError):
            r.manifest(bad)
    left, right = spark.range(10).toDF("k"), spark.range(4).toDF("k")
    with pytest.raises(GateError):
        assert_join_rate(left, right, ["k"])
    assert assert_join_rate(right, left, ["k"]) == (4, 4)
    with pytest.raises(GateError):
        assert_join_rate(left.limit(0), right, ["k"])
    with pytest.raises(GateError):
        assert_no_collision(right.union(right), ["k"])
    g = evaluate_gates(spark.createDataFrame([("m", 1.0)], "metric string, value double"), spark.createDataFrame([("m", ">=", 1.0), ("none", ">", 0.0)], "metric string, op string, threshold double"))
    assert {x["metric"]: x["passed"] for x in g.collect()} == {"m": True, "none": False}
