"""Line formats built from table columns and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import udf
from strandloom.queries._tables import Book, load, long, r6
from strandloom.sources import readers

book = Book()
QUERIES, SQL = book.queries, book.sql


@book("select 'q' || l_orderkey as qname, cast(l_partkey as bigint) as tlen, cast(l_linenumber as bigint) as mapq, 'cg' as tag, l_returnflag || ':' || l_linestatus as value, round(100 * (1 - round(l_discount, 4)), 6) as identity from lineitem")
def q_paf_tags(spark, d):
    """SC4, PF3: typed tags as a map, identity by precedence."""
    num = lambda c: F.col(c).cast("long").cast("string")
    line = F.concat_ws("\t", F.concat(F.lit("q"), num("l_orderkey")), F.lit("100"), F.lit("0"), F.lit("90"), F.lit("+"), F.lit("t"), num("l_partkey"), F.lit("5"), F.lit("95"), F.lit("88"), F.lit("90"), num("l_linenumber"), F.concat(F.lit("cg:Z:"), F.col("l_returnflag"), F.lit(":"), F.col("l_linestatus")), F.concat(F.lit("de:f:"), F.round("l_discount", 4).cast("string")))
    p = readers.paf(load(spark, d, "lineitem").select(line.alias("value")))
    ident = 100 * F.coalesce(1 - F.try_element_at("tags", F.lit("de")).try_cast("double"), F.col("nmatch") / F.col("alen"))
    return p.select("qname", "tlen", "mapq", F.lit("cg").alias("tag"), F.element_at("tags", "cg").alias("value"), r6(ident).alias("identity"))


@book("select p_partkey, case when p_size % 5 = 0 then null else cast(p_size as bigint) end as allele_len, case when p_size % 5 = 0 then null else 'chr' || p_size % 3 end as contig, case when p_size % 5 = 0 then null else cast(p_partkey as bigint) end as qs, p_size % 5 <> 0 as called from part")
def q_call_bed(spark, d):
    """SC13: a missing call is null, not length 0."""
    s = F.col("p_size")
    rec = F.when(s % 5 == 0, "*").otherwise(F.concat(F.lit(">s3:"), s.cast("string"), F.lit(":+:chr"), (s % 3).cast("string"), F.lit(":"), F.col("p_partkey").cast("string"), F.lit(":999")))
    c = load(spark, d, "part").select("p_partkey", readers.call_record(rec).alias("c"))
    return c.select("p_partkey", "c.allele_len", "c.contig", "c.qs", F.col("c").isNotNull().alias("called"))


@book("select 'chr' || p_size as chrom, cast(p_partkey as bigint) as pos, cast(p_size * 20 as bigint) as svlen, upper(p_brand) as insert_seq from part where p_partkey % 3 <> 0 and p_size * 20 between 300 and 5000")
def q_vcf_info(spark, d):
    """SC14: insertions of a size, ALT without its first base."""
    kind = F.when(F.col("p_partkey") % 3 == 0, "DEL").otherwise("INS")
    info = F.concat(F.lit("SVTYPE="), kind, F.lit(";SVLEN=-"), (F.col("p_size") * 20).cast("string"))
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("p_size").cast("string")), F.col("p_partkey").cast("string"), F.lit("."), F.lit("N"), F.concat(F.lit("N"), F.upper("p_brand")), F.lit("."), F.lit("PASS"), info)
    return readers.insertions(load(spark, d, "part").select(line.alias("value"))).select("chrom", "pos", "svlen", "insert_seq")


@book("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, event_type from events")
def q_json_props(spark, d):
    """F-JSON: a field of a JSON text."""
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")


@book("select cast(event_id as varchar) as site_id, event_type as bag_id, cast(user_id as bigint) as flank_len, 2::bigint as n_regions, false as bad from events where event_id % 10 <> 0 union all select null, null, null, null, true from events where event_id % 10 = 0")
def q_jsonl_sites(spark, d):
    """SC19: nested JSON lines; broken ones stay as rows."""
    site = F.to_json(F.struct(F.col("event_id").cast("string").alias("site_id"), F.col("event_type").alias("bag_id"), F.col("user_id").cast("int").alias("flank_len"), F.array(F.lit("AC"), F.lit("GT")).alias("noncoding_regions")))
    text = F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(site)
    s = readers.jsonl_sites(load(spark, d, "events").select(text.alias("value")))
    n = F.when(F.col("site_id").isNotNull(), F.size("noncoding_regions"))
    return s.select("site_id", "bag_id", long("flank_len").alias("flank_len"), long(n).alias("n_regions"), F.col("bad").isNotNull().alias("bad"))


@book("select 'c' || p_size % 4 as contig, count(*) as n, cast(sum(p_partkey - 1) as bigint) as starts, cast(sum(p_partkey + p_size) as bigint) as ends from part where p_size % 2 = 0 group by 1")
def q_gff_cds(spark, d):
    """SC15: 1-based inclusive to 0-based half-open."""
    k, s = F.col("p_partkey"), F.col("p_size")
    line = F.concat_ws("\t", F.concat(F.lit("c"), (s % 4).cast("string")), F.lit("x"), F.when(s % 2 == 0, "CDS").otherwise("gene"), k.cast("string"), (k + s).cast("string"), F.lit("."), F.lit("+"), F.lit("0"), F.lit("ID=a;Name=b"))
    g = readers.gff_cds(load(spark, d, "part").select(line.alias("value")))
    return g.groupBy("contig").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


@book("select target, query, score from (select 'p' || l_partkey as target, l_shipyear as query, l_quantity as score, row_number() over (partition by l_partkey order by l_quantity desc, l_shipyear) as r from (select l_partkey, l_quantity, 'm' || year(l_shipdate) as l_shipyear from lineitem)) where r = 1")
def q_tblout_best(spark, d):
    """SC17: best score per protein."""
    line = F.concat_ws("  ", F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.lit("-"), F.concat(F.lit("m"), F.year("l_shipdate").cast("string")), F.lit("PF1"), F.lit("1e-9"), F.col("l_quantity").cast("string"))
    return readers.tblout(load(spark, d, "lineitem").select(line.alias("value"))).select("target", "query", "score")


@book("select p_partkey, cast(case when b <= 0 then null when b <= 10 then 100 + b when b <= 12 then null else 98 + b end as int) as projected from (select p_partkey, p_size % 21 as b from part) where b > 0")
def q_project_cigar(spark, d):
    """F16: boundaries through 10M2I8M; inside the insertion, and at its edges, there is no answer."""
    p = load(spark, d, "part").select("p_partkey", (F.col("p_size") % 21).alias("b")).where("b > 0")
    return p.select("p_partkey", udf.project_boundary(F.lit("10M2I8M"), F.lit(0), F.lit(100), F.col("b")).alias("projected"))


SQL["q_project_cigar"] = "select p_partkey, cast(case when b < 10 then 100 + b when b > 12 then 98 + b end as int) as projected from (select p_partkey, p_size % 21 as b from part) where b > 0"


@book()
def q_tolerant_decompose(spark, d):
    """A10: alignment of part names with an insert (Arrow UDF over the affine-gap kernel)."""
    name = F.upper(F.regexp_replace("p_name", "[^A-Za-z]", ""))
    p = load(spark, d, "part").select("p_partkey", name.alias("s"), F.upper(F.regexp_replace("p_type", "[^A-Za-z]", "")).alias("t"))
    long_ = F.concat(F.left("s", F.lit(10)), F.repeat("t", 3), F.substring("s", 11, 1000))
    return p.select("p_partkey", udf.tolerant_decompose("s", long_).alias("x")).select("p_partkey", "x.ok", "x.insert_len", "x.lcp", "x.insert_start", "x.coverage", "x.identity")


@book()
def q_local_identity(spark, d):
    """Local identity of neighbouring part types, the better of both strands (Arrow UDF)."""
    from strandloom.functions import seq

    p = load(spark, d, "part").select("p_partkey", seq.dna("p_type").alias("a"), seq.dna("p_name").alias("b"))
    return p.select("p_partkey", udf.best_orientation("a", "b").alias("x")).select("p_partkey", "x.identity", "x.coverage", "x.orientation")


@book()
def q_orfs(spark, d):
    """Open reading frames of every document's sequence, and the longest."""
    from strandloom.functions import seq

    s = load(spark, d, "documents").select("doc_id", udf.orf_scan(seq.dna("text")).alias("orfs"))
    top = F.array_max(F.transform("orfs", lambda o: F.struct(o["aa"].alias("aa"), (-o["start"]).alias("neg"), o["strand"].alias("strand"))))
    return s.select("doc_id", F.size("orfs").alias("n_orfs"), top["aa"].alias("longest_aa"), (-top["neg"]).alias("start"), top["strand"].alias("strand"))
