"""Sequence functions over ``dna(text)``: equal and nearly equal documents are equal and nearly equal sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import seq, udf
from strandloom.operators import sets
from strandloom.queries._tables import DNA, RC, Book, load, long, r6
from strandloom.session import spread

book = Book()
QUERIES, SQL = book.queries, book.sql

_D = f"(select doc_id, source, lang, {DNA.format('text')} as s from documents)"
_CANON = f"least(s, {RC.format('s')})"


def _dna(spark, d):
    return spread(load(spark, d, "documents").select("doc_id", "source", "lang", "text")).select("doc_id", "source", "lang", seq.dna("text").alias("s"))


@book(f"select doc_id, md5({RC.format('s')}) as rc_md5, {RC.format(RC.format('s'))} = s as involution from {_D}")
def q_rc(spark, d):
    """reverse complement, and that it is its own inverse."""
    return _dna(spark, d).select("doc_id", F.md5(seq.revcomp("s")).alias("rc_md5"), (seq.revcomp(seq.revcomp("s")) == F.col("s")).alias("involution"))


@book(f"select doc_id, case when length(s) = 0 then '' else substr(md5({_CANON}), 1, 16) end as canon_key, case when s <= {RC.format('s')} then 'fwd' else 'rc' end as orient, case when trim(s) = '' then 'EMPTY' else substr(md5(s), 1, 12) end as short_md5 from {_D}")
def q_canon_key(spark, d):
    """F3, F22, §1.3: keys that don't depend on the strand."""
    return _dna(spark, d).select("doc_id", seq.canon_key("s").alias("canon_key"), seq.orientation("s").alias("orient"), seq.short_md5("s").alias("short_md5"))


@book(f"select doc_id, round((length(s) - length(translate(s, 'GC', ''))) / length(s), 6) as gc, round((length(text) - length(replace(replace(text, 'N', ''), 'n', ''))) / length(text), 6) as n_frac from (select doc_id, text, {DNA.format('text')} as s from documents)")
def q_gc_nfrac(spark, d):
    """GC and N fractions."""
    t = load(spark, d, "documents").select("doc_id", "text", seq.dna("text").alias("s"))
    of = lambda share, x: F.when(F.length(x) > 0, r6(share(x))).when(F.length(x) == 0, F.lit(float("nan")))  # noqa: E731  # 0 of 0 letters
    return t.select("doc_id", of(seq.gc_fraction, "s").alias("gc"), of(seq.n_fraction, "text").alias("n_frac"))


@book("select p_partkey, split_part(split_part('GCA_' || lpad(cast(p_partkey as varchar), 9, '0') || '.' || p_size, '_', 2), '.', 1) as core, 'run1/' || p_brand || '|' || p_partkey as qualified from part")
def q_accession_core(spark, d):
    """parts of names and paths."""
    name = F.concat(F.lit("GCA_"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("."), F.col("p_size").cast("string"))
    path = F.concat(F.lit("/data/run1/"), F.col("p_brand"), F.lit("/"))
    return load(spark, d, "part").select("p_partkey", seq.accession_core(name).alias("core"), seq.qualified(path, F.col("p_partkey").cast("string")).alias("qualified"))


_K = f"(select doc_id, list_distinct(list_transform(range(1, length(s) - 13), lambda i: least(substr(s, i, 15), {RC.format('substr(s, i, 15)')}))) as k from {_D})"


@book(f"select doc_id, len(k) as n_kmers from {_K}")
def q_kmers(spark, d):
    """distinct canonical 15-mers of each whole sequence."""
    return _dna(spark, d).select("doc_id", udf.count_kmers("s", F.lit(15)).alias("n_kmers"))


@book(f"select a, b, round(len(list_intersect(ka, kb)) / (len(ka) + len(kb) - len(list_intersect(ka, kb))), 6) as jaccard, round(len(list_intersect(ka, kb)) / least(len(ka), len(kb)), 6) as containment from (select a.p_partkey as a, b.p_partkey as b, list_distinct(list_transform(range(1, length(a.s) - 2), lambda i: substr(a.s, i, 4))) as ka, list_distinct(list_transform(range(1, length(b.s) - 2), lambda i: substr(b.s, i, 4))) as kb from (select p_partkey, p_brand, p_type, {DNA.format('p_name || p_type')} as s from part) a join (select p_partkey, p_brand, p_type, {DNA.format('p_name || p_type')} as s from part) b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_partkey < b.p_partkey)")
def q_kmer_jaccard(spark, d):
    """Jaccard index and containment of k-mer sets, within a key."""
    p = load(spark, d, "part").select("p_partkey", "p_brand", "p_type", seq.dna(F.concat("p_name", "p_type")).alias("s"))
    return sets.pair_scores(p, ["p_brand", "p_type"], "p_partkey", "s", lambda s: F.array_sort(seq.kmers(s, 4, False)), r6)


@book("select p_brand, round(median(j), 6) as median_jaccard, count(*) as n_pairs from (select a.p_brand, len(list_intersect(a.k, b.k)) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) as j from (select p_partkey, p_brand, list_distinct(string_split(p_name || ' ' || p_type, ' ')) as k from part) a join (select p_partkey, p_brand, list_distinct(string_split(p_name || ' ' || p_type, ' ')) as k from part) b on a.p_brand = b.p_brand and a.p_partkey < b.p_partkey) group by 1")
def q_median_pair_jaccard(spark, d):
    """median similarity over the pairs of a group."""
    p = load(spark, d, "part").select("p_partkey", "p_brand", F.array_sort(F.array_distinct(F.split(F.concat("p_name", F.lit(" "), "p_type"), " "))).alias("k"))
    return sets.pair_medians(p, "p_brand", "p_partkey", "k").select("p_brand", r6("median").alias("median_jaccard"), "n_pairs")


_NEXT = f"(select doc_id, s, lead(s) over (partition by source order by length(s), doc_id) as l, lead(doc_id) over (partition by source order by length(s), doc_id) as other from {_D})"
_LCP = "coalesce((select min(i) from range(1, length(s) + 1) t(i) where substr(s, i, 1) <> substr(l, i, 1)) - 1, length(s))"


@book(f"select doc_id, other, lcp, lcs, cast(length(l) - lcp - lcs as bigint) as insert_len, cast(lcp + lcs - length(s) as bigint) as overlap, md5(substr(l, lcp + 1, length(l) - lcp - lcs)) as insert_md5 from (select *, coalesce((select min(i) from range(1, length(s) - lcp + 1) t(i) where substr(reverse(s), i, 1) <> substr(reverse(l), i, 1)) - 1, length(s) - lcp) as lcs from (select *, {_LCP} as lcp from {_NEXT} where l is not null and length(s) < length(l)))")
def q_lcp_lcs_decompose(spark, d):
    """common prefix and suffix of neighbouring alleles, and what lies between."""
    w = Window.partitionBy("source").orderBy(F.length("s"), "doc_id")
    p = _dna(spark, d).select("doc_id", "s", F.lead("s").over(w).alias("l"), F.lead("doc_id").over(w).alias("other"))
    p = p.where(F.col("l").isNotNull() & (F.length("s") < F.length("l"))).withColumn("lcp", seq.common_prefix("s", "l"))
    p = p.withColumn("lcs", seq.common_suffix("s", "l", F.length("s") - F.col("lcp")))
    n = F.length("l") - F.col("lcp") - F.col("lcs")
    return p.select("doc_id", "other", long("lcp").alias("lcp"), long("lcs").alias("lcs"), long(n).alias("insert_len"), long(F.col("lcp") + F.col("lcs") - F.length("s")).alias("overlap"), F.md5(F.substring("l", F.col("lcp") + 1, n)).alias("insert_md5"))


@book("select o_orderkey, round(list_sum(list_transform(range(1, 17), lambda i: case when substr(a, i, 1) = substr(b, i, 1) then 1 else 0 end)) / 16.0, 6) as identity, cast(list_sum(list_transform(range(1, 17), lambda i: case when substr(a, i, 1) <> substr(b, i, 1) then 1 else 0 end)) as bigint) as hamming from (select o_orderkey, substr(md5(cast(o_custkey as varchar)), 1, 16) as a, substr(md5(cast(o_orderkey as varchar)), 1, 16) as b from orders)")
def q_identity(spark, d):
    """identity without gaps, and Hamming distance."""
    key = lambda c: F.substring(F.md5(F.col(c).cast("string")), 1, 16)
    o = load(spark, d, "orders").select("o_orderkey", key("o_custkey").alias("a"), key("o_orderkey").alias("b"))
    return o.select("o_orderkey", r6(seq.identity("a", "b")).alias("identity"), long(seq.hamming("a", "b")).alias("hamming"))


@book(f"select doc_id, case when length(s) >= 120 then substr(md5(right(left(s, 120), 60) || '|' || left(right(s, 60), 60)), 1, 16) end as flank_key, case when length(s) >= 120 and regexp_matches(right(left(s, 120), 60) || left(right(s, 60), 60), '^[ACGT]{{120}}$') then sha256(right(left(s, 120), 60) || '|' || left(right(s, 60), 60)) end as exact_key from {_D}")
def q_flank_keys(spark, d):
    """keys over the flanks."""
    s = _dna(spark, d).withColumn("l", F.left("s", F.lit(120))).withColumn("r", F.right("s", F.lit(60)))
    long_enough = F.length("s") >= 120
    return s.select("doc_id", F.when(long_enough, seq.flank_key("l", "r")).alias("flank_key"), F.when(long_enough, seq.exact_flank_key("l", "r", F.lit(True))).alias("exact_key"))


@book("select event_id, cast(trunc(value) as bigint) as as_int, try_cast(event_type as double) is null as bad, case when lower(event_type) in ('true', 't', 'yes') then true else false end as truthy, coalesce(try_cast(event_type as bigint), -1) as fallback from events")
def q_safe_casts(spark, d):
    """casts that give a default."""
    v = F.col("value").cast("string")
    return load(spark, d, "events").select("event_id", seq.to_int(v).alias("as_int"), seq.to_double("event_type").isNull().alias("bad"), seq.truthy("event_type").alias("truthy"), seq.to_int("event_type", -1).alias("fallback"))


@book("select p_partkey, round(0.25 * greatest(0, least(1, (p_size * 2.0 - 85) / 14.5)) + 0.30 * (1 - greatest(0, least(1, (p_size / 100.0) / 0.6))) + 0.25 * greatest(0, least(1, (p_retailprice / 2000.0) / 0.7)) + 0.20 * greatest(0, least(1, (p_size % 10 - 2) / 6.0)), 6) as score from part")
def q_mobility_score(spark, d):
    """the weighted score."""
    size = F.col("p_size")
    s = seq.mobility_score(size * 2.0, size / 100.0, F.col("p_retailprice") / 2000.0, (size % 10).cast("double"))
    return load(spark, d, "part").select("p_partkey", r6(s).alias("score"))


@book(f"select doc_id, w, round((length(x) - length(translate(x, 'GC', ''))) / length(x), 6) as gc from (select doc_id, unnest(range(0, length(s) - 99, 50)) as w, s from {_D}), lateral (select substr(s, w + 1, 100) as x)")
def q_profile_windows(spark, d):
    """Sliding windows of 100 with a step of 50 over whole sequences."""
    s = _dna(spark, d).where(F.length("s") >= 100).select("doc_id", "s", F.explode(F.sequence(F.lit(0), F.length("s") - 100, F.lit(50))).alias("w"))
    return s.select("doc_id", long("w").alias("w"), r6(seq.gc_fraction(F.substring("s", F.col("w") + 1, F.lit(100)))).alias("gc"))


@book(f"select doc_id, count(*) as n_windows, round(avg(gc), 6) as mean, round(case when count(*) > 1 then stddev_pop(gc) / avg(gc) else 0 end, 6) as cv, round(avg(case when gc < 0.4 then 1.0 else 0.0 end), 6) as low_share from (select doc_id, (length(x) - length(translate(x, 'GC', ''))) / length(x) as gc from (select doc_id, substr(s, w + 1, 100) as x from (select doc_id, s, unnest(range(0, length(s), 100)) as w from {_D}))) group by 1")
def q_window_identity(spark, d):
    """Statistics over windows that don't overlap."""
    s = _dna(spark, d).where(F.length("s") > 0).select("doc_id", "s", F.explode(F.sequence(F.lit(0), F.length("s") - 1, F.lit(100))).alias("w"))
    g = s.select("doc_id", seq.gc_fraction(F.substring("s", F.col("w") + 1, F.lit(100))).alias("gc"))
    spread_of = F.when(F.avg("gc") > 0, F.stddev_pop("gc") / F.avg("gc")).otherwise(float("nan"))  # without G and C it is 0 / 0
    cv = F.when(F.count("*") > 1, spread_of).otherwise(0.0)
    return g.groupBy("doc_id").agg(F.count("*").alias("n_windows"), r6(F.avg("gc")).alias("mean"), r6(cv).alias("cv"), r6(F.avg((F.col("gc") < 0.4).cast("double"))).alias("low_share"))


@book()
def q_duplications(spark, d):
    """target-site duplications at the ends of benchmark passages within documents (Arrow UDF)."""
    from strandloom.operators.contain import containment_join

    docs = load(spark, d, "documents").select("doc_id", "text")
    items = load(spark, d, "benchmark").select("item_id", F.col("text").alias("item_text"))
    hits = containment_join(docs, items)
    left = seq.window("text", F.col("at") - 60, F.col("at"))
    right = seq.window("text", F.col("at") + F.length("item_text"), F.col("at") + F.length("item_text") + 60)
    found = hits.select("doc_id", "item_id", udf.tsd("item_text", left, right).alias("t"))
    return found.select("doc_id", "item_id", "t.tsd_len", "t.tsd_seq", "t.side", "t.confidence")


@book()
def q_insert_keys(spark, d):
    """Keys of inserts that don't depend on strand or placement (Arrow UDF)."""
    w = Window.partitionBy("source").orderBy(F.length("s"), "doc_id")
    p = _dna(spark, d).select("doc_id", "s", F.lead("s").over(w).alias("l")).where(F.col("l").isNotNull() & (F.length("s") < F.length("l")))
    p = p.withColumn("lcp", seq.common_prefix("s", "l")).withColumn("lcs", seq.common_suffix("s", "l", F.length("s") - F.col("lcp")))
    return p.select("doc_id", udf.insert_key("l", F.col("lcp"), F.length("l") - F.col("lcp") - F.col("lcs")).alias("insert_key"))
