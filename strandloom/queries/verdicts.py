"""Classifications over numeric columns of the catalogue tables, which stand in for measured features."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import gates
from strandloom.operators import verdicts as v
from strandloom.queries._tables import Book, load, r6

book = Book()
QUERIES, SQL = book.queries, book.sql


@book("select p_partkey, case when p_size / 100.0 >= 0.40 then 'SEGMENTAL_DUP' when (p_partkey % 100) / 100.0 < 0.15 and p_partkey % 7 >= 3 then 'REPEAT_NO_BOUNDARY' when p_retailprice / 2500.0 >= 0.70 and (p_partkey % 100) / 100.0 >= 0.30 and p_partkey % 7 >= 3 then 'STRONG' when p_retailprice / 2500.0 >= 0.50 then 'MOBILE' else 'WEAK' end as verdict from part")
def q_family_verdict(spark, d):
    """PF7."""
    k = F.col("p_partkey")
    return load(spark, d, "part").select("p_partkey", v.family_verdict(F.col("p_size") / 100.0, (k % 100) / 100.0, F.col("p_retailprice") / 2500.0, k % 7).alias("verdict"))


_EV = "(select l_orderkey, l_linenumber, l_linenumber as n, cast(l_quantity * 10 as int) as short, cast(l_quantity * 10 + l_extendedprice / 50 as int) as long, cast(l_discount * 2000 as int) as lcp, cast(l_tax * 2000 as int) as lcs, l_returnflag = 'R' as tol, cast(l_quantity as int) % 3 as lost from lineitem)"


@book(f"select l_orderkey, l_linenumber, case when n <= 1 then 'monomorphic' when long = short then 'substitution_only' when long - short < 500 then 'below_min_insert' when short = 0 then 'pure_insertion' when tol and lost > 0 then 'replacement' when tol then 'insertion_target_retained' when lcp + lcs >= short then 'insertion_target_retained' when short - lcp - lcs <= 50 then 'replacement' else 'length_polymorphism' end as event_class from {_EV}")
def q_event_class(spark, d):
    """PF8."""
    e = _events(spark, d)
    return e.select("l_orderkey", "l_linenumber", v.event_class(*(F.col(c) for c in ("n", "short", "long", "lcp", "lcs", "tol", "lost"))).alias("event_class"))


def _events(spark, d):
    # half up, as the cast of the SQL rounds
    whole = lambda c: F.floor(c + 0.5).cast("int")
    q = F.col("l_quantity")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("n"), whole(q * 10).alias("short"), whole(q * 10 + F.col("l_extendedprice") / 50).alias("long"), whole(F.col("l_discount") * 2000).alias("lcp"), whole(F.col("l_tax") * 2000).alias("lcs"), (F.col("l_returnflag") == "R").alias("tol"), (whole(q) % 3).alias("lost"))


@book(f"select l_orderkey, count(*) as n_eligible, count(*) filter (where lost = 0 and abs(lcp - lcs) <= 15 and n <> 7) as n_clean from {_EV} where not tol and n > 1 and long - short >= 500 and short > 0 and (lcp + lcs >= short or short - lcp - lcs <= 50) or tol and n > 1 and long - short >= 500 and short > 0 group by 1")
def q_eligible_clean(spark, d):
    """PF4, PF5: eligible events, and how many are clean: a column, not a filter."""
    e = _events(spark, d)
    e = e.withColumn("kind", v.event_class(*(F.col(c) for c in ("n", "short", "long", "lcp", "lcs", "tol", "lost"))))
    placement = F.when(F.col("n") == 7, "ambiguous").otherwise("unique")
    clean = v.structurally_clean(F.col("lost"), F.abs(F.col("lcp") - F.col("lcs")), placement)
    return e.where(v.eligible(F.col("kind"), F.col("long") - F.col("short"))).groupBy("l_orderkey").agg(F.count("*").alias("n_eligible"), F.count_if(clean).alias("n_clean"))


@book("select source, count(*) as n, case when bool_and(tier = 'high') then 'high' when bool_or(tier = 'unresolvable_contig_break') then 'unresolvable_contig_break' else 'medium' end as event_tier, count(*) filter (where tier = 'high') as n_high from (select source, case when n_chars >= 500 and n_chars - 200 >= 500 and doc_id % 97 / 1000.0 < 0.01 and doc_id % 89 / 1000.0 < 0.01 then 'high' when n_chars >= 100 and n_chars - 200 >= 100 then 'medium' else 'unresolvable_contig_break' end as tier from documents) group by 1")
def q_qc_tier(spark, d):
    """PF6 and its roll-up."""
    n, k = F.col("n_chars"), F.col("doc_id")
    t = load(spark, d, "documents").select("source", v.qc_tier(n, n - 200, k % 97 / 1000.0, k % 89 / 1000.0).alias("tier"))
    return t.groupBy("source").agg(F.count("*").alias("n"), v.event_tier(F.col("tier")).alias("event_tier"), F.count_if(F.col("tier") == "high").alias("n_high"))


_DOMAINS = ("DUF3", "rve,DUF1", "is3_like", "LacI,DUF3", "Tnp_DDE", None, "Rhs", "DUF1,DUF2", "phage_tail")
_DOMAIN = "case p_partkey % 9 " + " ".join(f"when {k} then '{x}'" for k, x in enumerate(_DOMAINS) if x) + " end"


@book(f"""
with d as (select *, {_DOMAIN} as dom from part)
select p_partkey, case when p_size % 11 = 0 and p_partkey % 10 / 10.0 < 0.4 then 'ribosomal' when p_size = 1 then 'IS_element' when coalesce(regexp_matches(dom, '(?i){v.IS_WORDS}'), false) then 'IS_like' when coalesce(regexp_matches(dom, '(?i){v.MGE_WORDS}'), false) then 'MGE' when p_size > 45 then 'segmental_duplication'
  when len(list_filter(string_split(coalesce(dom, 'DUF'), ','), lambda x: not starts_with(upper(x), 'DUF'))) > 0 then 'other_domain' when p_partkey % 10 / 10.0 >= 0.4 and p_retailprice > 1200 then 'coding_mobile' when p_retailprice > 1200 then 'noncoding_mobile' else 'unclassified' end as class_call from d""")
def q_annotation_class(spark, d):
    """PF9, F33."""
    s, k = F.col("p_size"), F.col("p_partkey")
    domain = F.expr(_DOMAIN)
    verdict = F.when(s > 45, "SEGMENTAL_DUP").otherwise("MOBILE")
    return load(spark, d, "part").select("p_partkey", v.annotation_class(s % 11 == 0, k % 10 / 10.0, s == 1, domain, verdict, F.col("p_retailprice") > 1200).alias("class_call"))


@book("select evidence, count(*) as n from (select case when l_discount >= 0.02 and l_tax >= 0.01 and least(l_quantity * 20, l_extendedprice / 20) >= 200 then 'supported' else 'unsupported' end as evidence from lineitem) group by 1")
def q_evidence(spark, d):
    """PF10."""
    li = load(spark, d, "lineitem").withColumn("evidence", F.when((F.col("l_discount") >= 0.02) & (F.col("l_tax") >= 0.01), v.evidence_class(F.lit(1.0), F.lit(1.0), F.col("l_quantity") * 20, F.col("l_extendedprice") / 20)).otherwise("unsupported"))
    return li.groupBy("evidence").agg(F.count("*").alias("n"))


@book("select miss, count(*) as n from (select case when n_chars < 300 then 'too_short' when n_chars > 5000 then 'too_long' when doc_id % 2000 < 500 then 'contig_edge' when lang = 'es' then 'absent' when doc_id % 10 / 10.0 < 0.5 then 'partial_extent' when doc_id % 9 < 3 then 'too_few_copies' when doc_id % 20 / 20.0 < 0.90 then 'low_identity' when doc_id % 2 = 1 then 'tandem' else 'downstream' end as miss from documents) group by 1")
def q_miss_taxonomy(spark, d):
    """PF11."""
    k = F.col("doc_id")
    m = v.miss_taxonomy(F.col("n_chars"), k % 2000, k % 10 / 10.0, F.col("lang") != "es", k % 9, k % 20 / 20.0, k % 2 == 1)
    return load(spark, d, "documents").groupBy(m.alias("miss")).agg(F.count("*").alias("n"))


@book("select doc_id, seed, case when seed <> 'seeded' then 'unseedable' when quality is null then 'unresolved' when toxic = 1 then 'ambiguous' else 'resolved' end as layer2_status from (select d.doc_id, l.quality, l.toxic, case when n_chars % 3000 - 100 < 0 then 'invalid_junction_frame' when n_chars % 3000 - 300 < 0 or n_chars % 3000 + 400 > n_chars then 'seed_padding_outside_contig' else 'seeded' end as seed from documents d left join labels l on l.doc_id = d.doc_id)")
def q_seed_status(spark, d):
    """PF19, PF20: no candidate vanishes."""
    docs = load(spark, d, "documents").select("doc_id", "n_chars").join(load(spark, d, "labels"), "doc_id", "left")
    at = F.col("n_chars") % 3000
    s = docs.withColumn("seed", v.seed_status(at - 100, at + 200, F.col("n_chars")))
    return s.select("doc_id", "seed", v.layer2_status(F.col("seed"), F.col("quality").isNotNull(), F.col("toxic") == 1).alias("layer2_status"))


@book("select status, count(*) as n from (select case when gap < 0 then 'overlapping' when gap = 0 then 'zero' when gap <= 50 and gap <= 0.2 * ins then 'short' when gap between 0.8 * ins and 1.2 * ins then 'similar' else 'other' end as status from (select p_size - 10 as gap, p_partkey % 60 as ins from part)) group by 1")
def q_gap_status(spark, d):
    """PF21."""
    s = v.gap_status(F.col("p_size") - 10, (F.col("p_partkey") % 60).cast("double"))
    return load(spark, d, "part").groupBy(s.alias("status")).agg(F.count("*").alias("n"))


@book("select p_partkey, case when s > 15 then 'repeat_array' when s >= 4 then 'derived_is_long' else 'not_callable' end as polarity, regexp_matches(p_brand, '^[A-Za-z0-9_-]+$') as safe, case when contains(lower(p_type), 'brass') then 'metal' when contains(lower(p_type), 'copper') then 'metal' when contains(lower(p_type), 'plated') then 'coated' else p_type end as kind from (select *, p_size % 20 as s from part)")
def q_mge_class(spark, d):
    """PF17, PF18, PF23: safe names, first keyword wins, polarity by TSD."""
    words = {"brass": "metal", "copper": "metal", "plated": "coated"}
    return load(spark, d, "part").select("p_partkey", v.tsd_polarity(F.col("p_size") % 20).alias("polarity"), v.safe_name(F.col("p_brand")).alias("safe"), v.keyword_class(F.col("p_type"), words).alias("kind"))


@book("select tier, count(*) as n from (select unnest(list_filter([case when b then 'hq' end, case when b and g then 'hq_clean' end, case when b and g and m >= 50000 then 'hq_n50_50k' end, case when b and g and m >= 100000 then 'hq_n50_100k' end, case when b and g and m >= 250000 then 'hq_n50_250k' end], lambda x: x is not null)) as tier from (select o_orderkey % 101 >= 90 and o_custkey % 10 <= 5 as b, o_orderstatus <> 'P' as g, o_totalprice as m from orders)) group by 1")
def q_quality_tiers(spark, d):
    """PF13: nested tiers, counted by explode."""
    t = v.quality_tiers(F.col("o_orderkey") % 101, F.col("o_custkey") % 10, F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return load(spark, d, "orders").select(F.explode(t).alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


@book("select label, count(*) as n from (select unnest(list_filter([case when a >= 5 then 'crosses' end, case when b > a then 'rich' end, case when a = 0 and b > 0 then 'only_b' end], lambda x: x is not null)) as label from (select count(*) filter (where o_orderpriority = '1-URGENT') as a, count(*) filter (where o_orderpriority = '5-LOW') as b from orders group by o_custkey)) group by 1")
def q_expansion_classes(spark, d):
    """PF14: classes that aren't exclusive."""
    n = load(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("a"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("b"))
    a, b = F.col("a"), F.col("b")
    labels = F.array_compact(F.array(F.when(a >= 5, "crosses"), F.when(b > a, "rich"), F.when((a == 0) & (b > 0), "only_b")))
    return n.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@book("select coalesce(case when n_chars < 200 then 'short' when lang is null then 'no_lang' when lang not in ('en', 'fr') then 'level' when source = 'src0' then 'excluded' end, 'kept') as reason, source, count(*) as n from documents group by 1, 2")
def q_drop_reasons(spark, d):
    """PF15: every drop has a counted reason."""
    r = v.first_reason((F.col("n_chars") < 200, "short"), (F.col("lang").isNull(), "no_lang"), (~F.col("lang").isin("en", "fr"), "level"), (F.col("source") == "src0", "excluded"))
    return load(spark, d, "documents").groupBy(F.coalesce(r, F.lit("kept")).alias("reason"), "source").agg(F.count("*").alias("n"))


@book("select case when grp is null then 'none' else grp end as polarity, count(*) as n from (select o_custkey, case when n = 0 then 'none' when n = 2 then 'all' else 'mixed' end as grp from (select o_custkey, len(list_intersect(list_distinct(list(o_orderstatus)), ['O', 'P'])) as n from orders group by 1)) group by 1")
def q_polarity(spark, d):
    """PF22."""
    c = load(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    return c.groupBy(v.polarity(F.col("s"), F.array(F.lit("O"), F.lit("P"))).alias("polarity")).agg(F.count("*").alias("n"))


@book("select l_orderkey, l_linenumber, round(100 * coalesce(1 - nullif(l_discount, 0), 1 - nullif(l_tax, 0), l_quantity / 50), 6) as identity, round(l_quantity / 50, 6) as block_cov, round((l_quantity - 1) / 50, 6) as span_cov, round(l_quantity / least(50, 40), 6) as shorter_cov, 100 * coalesce(1 - nullif(l_discount, 0), 1 - nullif(l_tax, 0), l_quantity / 50) >= 95 and l_quantity * 20 between 300 and 5000 and l_extendedprice / 10 between 300 and 5000 and (l_linenumber <> 1 or l_orderkey % 20000 >= 10000) as is_block from lineitem")
def q_block_filter(spark, d):
    """PF1, PF2, PF3: identity by precedence, three coverages, the block filter."""
    q = F.col("l_quantity")
    ident = v.identity_of(F.nullif("l_discount", F.lit(0.0)), F.nullif("l_tax", F.lit(0.0)), q, F.lit(50))
    cov = lambda kind: r6(v.hit_coverage(kind, q, F.lit(50), F.lit(40), F.lit(1), q)).alias(f"{kind}_cov")
    block = v.homology_block(ident, q * 20, F.col("l_extendedprice") / 10, F.col("l_linenumber") == 1, F.lit(0), F.col("l_orderkey") % 20000, 95.0)
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(ident).alias("identity"), cov("block"), cov("span"), cov("shorter"), block.alias("is_block"))


@book("select metric, op, threshold, value, case op when '==' then value = threshold when '>=' then value >= threshold when '<=' then value <= threshold end as passed from (values ('n_orders', '>=', 100.0), ('n_docs', '>=', 1e9), ('min_quantity', '==', 1.0), ('max_discount', '<=', 0.1)) g(metric, op, threshold) join (select 'n_orders' as metric, cast(count(*) as double) as value from orders union all select 'n_docs', count(*) from documents union all select 'min_quantity', min(l_quantity) from lineitem union all select 'max_discount', max(l_discount) from lineitem) using (metric)")
def q_gates(spark, d):
    """ST12: gates against metrics."""
    one = lambda t, c, name: load(spark, d, t).agg(c.cast("double").alias("value")).withColumn("metric", F.lit(name))
    metrics = one("orders", F.count("*"), "n_orders").unionByName(one("documents", F.count("*"), "n_docs")).unionByName(one("lineitem", F.min("l_quantity"), "min_quantity")).unionByName(one("lineitem", F.max("l_discount"), "max_discount"))
    table = spark.createDataFrame([("n_orders", ">=", 100.0), ("n_docs", ">=", 1e9), ("min_quantity", "==", 1.0), ("max_discount", "<=", 0.1)], "metric string, op string, threshold double")
    return gates.evaluate_gates(metrics, table).select("metric", "op", "threshold", "value", "passed")
