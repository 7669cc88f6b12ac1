"""Joins, set operations, aggregations and ordered operators over the catalogue tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators import gates, ranking, stats
from strandloom.queries._tables import Book, load, long, r6

book = Book()
QUERIES, SQL = book.queries, book.sql


@book("select c_custkey, c_mktsegment, count(o_orderkey) as n_orders, coalesce(round(sum(o_totalprice), 2), 0.0) as total from customer left join orders on o_custkey = c_custkey group by all")
def q_left_default(spark, d):
    """Every left row stays, with defaults."""
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    c = load(spark, d, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey", "left")
    return c.select("c_custkey", "c_mktsegment", F.coalesce("n_orders", F.lit(0)).cast("long").alias("n_orders"), F.coalesce("total", F.lit(0.0)).alias("total"))


@book("select s_suppkey, s_name, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def q_equi_inner(spark, d):
    """Dictionary look-ups as joins with fixed-size dimensions."""
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return load(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name", "r_name")


@book("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def q_semi(spark, d):
    """Members of a set."""
    urgent = load(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


@book("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_totalprice > 400000)")
def q_anti(spark, d):
    """Not members of a set."""
    o = load(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@book("select coalesce(a.k, b.k) as nation, coalesce(a.n, 0) as n_customers, coalesce(b.n, 0) as n_suppliers, case when a.k is null then 'supplier' when b.k is null then 'customer' else 'both' end as support from (select c_nationkey as k, count(*) as n from customer where c_acctbal < 0 group by 1) a full join (select s_nationkey as k, count(*) as n from supplier where s_acctbal < 0 group by 1) b on a.k = b.k")
def q_full_outer(spark, d):
    """The union of two key sets, with what supports each key."""
    a = load(spark, d, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("a"))
    b = load(spark, d, "supplier").where("s_acctbal < 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("b"))
    support = F.when(F.col("a").isNull(), "supplier").when(F.col("b").isNull(), "customer").otherwise("both")
    return a.join(b, "nation", "full_outer").select("nation", F.coalesce("a", F.lit(0)).cast("long").alias("n_customers"), F.coalesce("b", F.lit(0)).cast("long").alias("n_suppliers"), support.alias("support"))


@book("select a.s_suppkey as a, b.s_suppkey as b, a.s_nationkey as nation from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey")
def q_self_pairs(spark, d):
    """Unordered pairs within a key."""
    s = load(spark, d, "supplier")
    a, b = (s.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias(x)) for x in "ab")
    return a.join(b, "nation").where("a < b").select("a", "b", "nation")


@book("select l_orderkey, i, j, length_gap from (select a.l_orderkey, a.l_linenumber as i, b.l_linenumber as j, b.l_quantity - a.l_quantity as length_gap, row_number() over (partition by a.l_orderkey order by a.l_quantity, a.l_linenumber, b.l_quantity, b.l_linenumber) as r from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and (a.l_quantity, a.l_linenumber) < (b.l_quantity, b.l_linenumber)) where r <= 12")
def q_capped_pairs(spark, d):
    """SO3: at most twelve allele pairs of a locus, shortest first."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    a = li.select("l_orderkey", F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("qi"))
    b = li.select("l_orderkey", F.col("l_linenumber").alias("j"), F.col("l_quantity").alias("qj"))
    pairs = a.join(b, "l_orderkey").where(F.struct("qi", "i") < F.struct(F.col("qj").alias("qi"), F.col("j").alias("i")))
    order = Window.partitionBy("l_orderkey").orderBy("qi", "i", "qj", "j")
    return pairs.withColumn("r", F.row_number().over(order)).where("r <= 12").select("l_orderkey", "i", "j", (F.col("qj") - F.col("qi")).alias("length_gap"))


@book("select count(*) as only_left, 0::bigint as only_right from (select o_orderkey from orders except all select l_orderkey from lineitem where l_linenumber = 1)")
def q_multiset_equal(spark, d):
    """SO6: two multisets agree if both differences are empty."""
    a = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    b = load(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"))
    both = a.groupBy("k").agg(F.count("*").alias("n")).withColumn("m", F.lit(0)).unionByName(b.groupBy("k").agg(F.count("*").alias("m")).withColumn("n", F.lit(0)))
    both = both.groupBy("k").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    only = lambda x, y: long(F.coalesce(F.sum(F.greatest(F.col(x) - F.col(y), F.lit(0))), F.lit(0)))
    return both.agg(only("n", "m").alias("only_left"), only("m", "n").alias("only_right"))


SQL["q_multiset_equal"] = "select (select count(*) from (select o_orderkey from orders except all select l_orderkey from lineitem where l_linenumber = 1)) as only_left, (select count(*) from (select l_orderkey from lineitem where l_linenumber = 1 except all select o_orderkey from orders)) as only_right"


@book("select 'union' as op, count(*) as n from (select c_nationkey from customer union select s_nationkey from supplier) union all select 'intersect', count(*) from (select c_nationkey from customer intersect select s_nationkey from supplier) union all select 'except', count(*) from (select c_nationkey from customer except select s_nationkey from supplier) union all select 'union_all', count(*) from (select c_nationkey from customer union all select s_nationkey from supplier)")
def q_union_intersect_except(spark, d):
    """SO4, SO5: set operations."""
    a, b = load(spark, d, "customer").select(F.col("c_nationkey").alias("k")), load(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    found = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "union_all": a.union(b)}
    out = None
    for name, df in found.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@book("select count(*) filter (where l_orderkey is not null) as matched, count(*) as total, count(*) filter (where l_orderkey is not null) / count(*) as rate from orders left join (select distinct l_orderkey from lineitem where l_returnflag = 'R') on o_orderkey = l_orderkey")
def q_join_rate(spark, d):
    """Matched and total of a join."""
    right = load(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return gates.join_rate(load(spark, d, "orders").select("o_orderkey"), right, ["o_orderkey"])


@book("select text_key, n from (select md5(text) as text_key, count(*) as n from documents group by 1) where n > 1")
def q_collisions(spark, d):
    """Keys that occur more than once."""
    return load(spark, d, "documents").groupBy(F.md5("text").alias("text_key")).agg(F.count("*").alias("n")).where("n > 1")


@book("select c_mktsegment, n_name, count(*) as n, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey group by rollup (c_mktsegment, n_name)")
def q_rollup_total(spark, d):
    """AG25: groups, group totals and a grand total in one pass."""
    c = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@book("select c_nationkey, count(*) filter (where c_mktsegment = 'AUTOMOBILE') as automobile, count(*) filter (where c_mktsegment = 'BUILDING') as building, count(*) filter (where c_mktsegment = 'MACHINERY') as machinery, count(*) filter (where c_acctbal >= 0) as usable, count(*) as total, count(*) filter (where c_acctbal >= 0) / count(*) as usable_fraction from customer group by 1")
def q_pivot_census(spark, d):
    """AG3: a census by level with the usable fraction."""
    c = load(spark, d, "customer")
    level = lambda s: F.count_if(F.col("c_mktsegment") == s).alias(s.lower())
    out = c.groupBy("c_nationkey").agg(level("AUTOMOBILE"), level("BUILDING"), level("MACHINERY"), F.count_if(F.col("c_acctbal") >= 0).alias("usable"), F.count("*").alias("total"))
    return out.withColumn("usable_fraction", F.col("usable") / F.col("total"))


@book("with r as (select c_nationkey, o_totalprice, row_number() over (partition by c_nationkey order by o_totalprice) as rn, count(*) over (partition by c_nationkey) as n from orders join customer on o_custkey = c_custkey) select c_nationkey, max(case when rn = least(n - 1, cast(floor(n * 0.5) as bigint)) + 1 then o_totalprice end) as q50, max(case when rn = least(n - 1, cast(floor(n * 0.95) as bigint)) + 1 then o_totalprice end) as q95 from r group by 1")
def q_idx_quantile(spark, d):
    """AG5: quantiles by index."""
    o = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    a = stats.ranked_quantile(o, ["c_nationkey"], "o_totalprice", 0.5, "q50")
    return a.join(stats.ranked_quantile(o, ["c_nationkey"], "o_totalprice", 0.95, "q95"), "c_nationkey")


@book("select o_orderpriority, round(avg(case when o_totalprice < 150000 then 1.0 else 0.0 end), 6) as quantile_of from orders group by 1")
def q_quantile_of(spark, d):
    """AG6: the share of values below a given one."""
    return load(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg((F.col("o_totalprice") < 150000).cast("double")), 6).alias("quantile_of"))


@book("with m as (select p_brand, median(p_retailprice) as m from part group by 1) select p_brand, round(any_value(m), 6) as median, round(median(abs(p_retailprice - m)), 6) as mad from part join m using (p_brand) group by 1")
def q_median_mad(spark, d):
    """AG4: median and median absolute deviation."""
    out = stats.median_mad(load(spark, d, "part"), ["p_brand"], "p_retailprice")
    return out.select("p_brand", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@book("select p_brand, p_type as mode, n from (select p_brand, p_type, count(*) as n, row_number() over (partition by p_brand order by count(*) desc, p_type) as r from part group by 1, 2) where r = 1")
def q_mode(spark, d):
    """AG7: most common value, ties to the smaller."""
    return stats.mode(load(spark, d, "part"), ["p_brand"], "p_type")


@book("select source, n, cast(total as bigint) as total, cast(n50 as bigint) as n50 from (select source, count(*) as n, sum(n_chars) as total, max(case when run * 2 >= allc then n_chars end) as n50 from (select source, n_chars, sum(n_chars) over (partition by source order by n_chars desc rows unbounded preceding) as run, sum(n_chars) over (partition by source) as allc from documents) group by 1)")
def q_n50(spark, d):
    """AG12: N50 of each source."""
    return stats.n50(load(spark, d, "documents").select("source", "n_chars"), ["source"], "n_chars")


@book("select l_returnflag, round(avg(l_quantity), 6) as mean, round(stddev_pop(l_quantity), 6) as sd, round(stddev_pop(l_quantity) / avg(l_quantity), 6) as cv from lineitem group by 1")
def q_cv(spark, d):
    """AG8: mean, population deviation, coefficient of variation."""
    q = F.col("l_quantity")
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(F.avg(q)).alias("mean"), r6(F.stddev_pop(q)).alias("sd"), r6(F.stddev_pop(q) / F.avg(q)).alias("cv"))


@book("select case when c_acctbal < 0 then 'negative' when c_acctbal = 0 then '0' when c_acctbal < 1000 then '<1k' when c_acctbal < 5000 then '1k-5k' else '>5k' end as band, count(*) as n from customer group by 1")
def q_bands(spark, d):
    """AG11: a histogram in fixed bands."""
    b = F.col("c_acctbal")
    band = F.when(b < 0, "negative").when(b == 0, "0").when(b < 1000, "<1k").when(b < 5000, "1k-5k").otherwise(">5k")
    return load(spark, d, "customer").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@book("select cast(floor(n_chars / 1000) * 1000 as bigint) as bin, count(*) as n from documents group by 1")
def q_histogram(spark, d):
    """AG13: bins of equal width."""
    return load(spark, d, "documents").groupBy((F.floor(F.col("n_chars") / 1000) * 1000).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@book("select n_lines, n, round(sum(n) over (order by n_lines) / sum(n) over (), 6) as cum_share from (select n_lines, count(*) as n from (select count(*) as n_lines from lineitem group by l_orderkey) group by 1)")
def q_cumshare(spark, d):
    """Distribution of item counts with its cumulative share; only the few distinct counts meet in one task."""
    per = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines")).groupBy("n_lines").agg(F.count("*").alias("n"))
    return per.withColumn("cum_share", r6(F.sum("n").over(Window.orderBy("n_lines")) / F.sum("n").over(Window.partitionBy())))


@book("select c_mktsegment, count(distinct c_nationkey) as n_nations, count(distinct o_orderpriority) as n_priorities, count(*) as n from customer join orders on c_custkey = o_custkey group by 1")
def q_count_distinct(spark, d):
    """AG2: exact distinct counts."""
    c = load(spark, d, "customer").join(load(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return c.groupBy("c_mktsegment").agg(F.countDistinct("c_nationkey").alias("n_nations"), F.countDistinct("o_orderpriority").alias("n_priorities"), F.count("*").alias("n"))


@book("select l_shipyear, returned_pct, large_pct, both_pct, n from (select year(l_shipdate) as l_shipyear, round(100 * avg(case when l_returnflag = 'R' then 1.0 else 0.0 end), 6) as returned_pct, round(100 * avg(case when l_quantity >= 25 then 1.0 else 0.0 end), 6) as large_pct, round(100 * avg(case when l_returnflag = 'R' and l_quantity >= 25 then 1.0 else 0.0 end), 6) as both_pct, count(*) as n from lineitem group by 1)")
def q_conditional_rates(spark, d):
    """AG10: rates of flags by stratum."""
    r, q = F.col("l_returnflag") == "R", F.col("l_quantity") >= 25
    pct = lambda c: F.round(100 * F.avg(c.cast("double")), 6)
    return load(spark, d, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("l_shipyear")).agg(pct(r).alias("returned_pct"), pct(q).alias("large_pct"), pct(r & q).alias("both_pct"), F.count("*").alias("n"))


SQL["q_conditional_rates"] = SQL["q_conditional_rates"].replace("year(l_shipdate)", "cast(year(l_shipdate) as bigint)")


@book("select p_brand, p_partkey as representative, p_size from (select *, row_number() over (partition by p_brand order by p_size desc, p_retailprice desc, p_partkey) as r from part) where r = 1")
def q_representative(spark, d):
    """AG9: one representative per group: largest, of several the first."""
    best = F.min_by(F.struct("p_partkey", "p_size"), F.struct(-F.col("p_size"), -F.col("p_retailprice"), "p_partkey")).alias("b")
    return load(spark, d, "part").groupBy("p_brand").agg(best).select("p_brand", F.col("b.p_partkey").alias("representative"), "b.p_size")


@book("select o_custkey, max(o_totalprice) - min(o_totalprice) as spread, min(o_orderdate) as first_at, max(o_orderdate) as last_at from orders group by 1")
def q_spread(spark, d):
    """AG23: extremes and spread."""
    t = F.col("o_totalprice")
    return load(spark, d, "orders").groupBy("o_custkey").agg((F.max(t) - F.min(t)).alias("spread"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"))


@book("select l_partkey, count(distinct l_suppkey) as n_suppliers, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') as suppliers from lineitem group by 1")
def q_set_aggregate(spark, d):
    """AG22: the set of a group, sorted."""
    s = F.array_sort(F.collect_set("l_suppkey"))
    return load(spark, d, "lineitem").groupBy("l_partkey").agg(F.size(s).cast("long").alias("n_suppliers"), F.array_join(s.cast("array<string>"), ",").alias("suppliers"))


@book("select p_type, p_brand, n from (select p_type, p_brand, count(*) as n, row_number() over (partition by p_type order by count(*) desc, p_brand) as r from part group by 1, 2) where r <= 3")
def q_crosstab_top(spark, d):
    """AG24, SO2: the most frequent pairs of a cross table."""
    n = load(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    order = Window.partitionBy("p_type").orderBy(F.desc("n"), "p_brand")
    return n.withColumn("r", F.row_number().over(order)).where("r <= 3").drop("r")


@book("select gate, kept, prev - kept as dropped from (select gate, kept, coalesce(lag(kept) over (order by gate), kept) as prev from (select 1 as gate, count(*) as kept from lineitem union all select 2, count(*) from lineitem where l_quantity >= 10 union all select 3, count(*) from lineitem where l_quantity >= 10 and l_discount <= 0.06 union all select 4, count(*) from lineitem where l_quantity >= 10 and l_discount <= 0.06 and l_returnflag <> 'R'))")
def q_waterfall(spark, d):
    """AG21: survivors and losses of gates in sequence, counted in one pass."""
    tests = [F.lit(True), F.col("l_quantity") >= 10, F.col("l_discount") <= 0.06, F.col("l_returnflag") != "R"]
    ok, counts = F.lit(True), []
    for k, t in enumerate(tests):
        ok = ok & t
        counts.append(F.struct(F.lit(k + 1).alias("gate"), F.count_if(ok).alias("kept")))
    rows = load(spark, d, "lineitem").agg(F.array(*counts).alias("g")).select(F.inline("g"))
    before = F.coalesce(F.lag("kept").over(Window.orderBy("gate")), F.col("kept"))
    return rows.select("gate", "kept", (before - F.col("kept")).alias("dropped"))


@book("select tier, count(*) as n, round(avg(case when dq <= 1 then 1.0 else 0.0 end), 6) as within_1, round(avg(case when dq <= 5 then 1.0 else 0.0 end), 6) as within_5, median(dq) as median_dq from (select coalesce(l_linestatus, 'ALL') as tier, dq, g from (select l_linestatus, abs(l_quantity - 25) as dq, grouping(l_linestatus) as g from lineitem group by grouping sets ((l_linestatus, l_orderkey, l_linenumber, l_quantity), (l_orderkey, l_linenumber, l_quantity)))) group by tier")
def q_tier_stats(spark, d):
    """AG18: the same statistics for each tier and for all, in one grouping-sets pass."""
    li = load(spark, d, "lineitem").select("l_linestatus", F.abs(F.col("l_quantity") - 25).alias("dq"))
    rate = lambda k: r6(F.avg((F.col("dq") <= k).cast("double"))).alias(f"within_{k}")
    out = li.rollup("l_linestatus").agg(F.count("*").alias("n"), rate(1), rate(5), F.median("dq").alias("median_dq"))
    return out.withColumn("tier", F.coalesce("l_linestatus", F.lit("ALL"))).drop("l_linestatus")


SQL["q_tier_stats"] = "select coalesce(l_linestatus, 'ALL') as tier, count(*) as n, round(avg(case when abs(l_quantity - 25) <= 1 then 1.0 else 0.0 end), 6) as within_1, round(avg(case when abs(l_quantity - 25) <= 5 then 1.0 else 0.0 end), 6) as within_5, median(abs(l_quantity - 25)) as median_dq from lineitem group by rollup (l_linestatus)"


@book("select half, count(*) as n, round(avg(case when toxic = 1 then 1.0 else 0.0 end), 6) as positive, round(avg(case when quality = 1 then 1.0 else 0.0 end), 6) as covered from (select *, cast(('0x' || substr(md5(cast(doc_id as varchar)), 1, 8)) as bigint) % 2 as half from labels) group by 1")
def q_rule_precision(spark, d):
    """AG27: rates of a rule on the two halves of a split by hash."""
    lab = load(spark, d, "labels").withColumn("half", seq.cluster_half(F.col("doc_id").cast("string")))
    rate = lambda c: r6(F.avg((F.col(c) == 1).cast("double")))
    return lab.groupBy("half").agg(F.count("*").alias("n"), rate("toxic").alias("positive"), rate("quality").alias("covered"))


@book("select has_label, is_long, count(*) as n, count(distinct source) as n_sources from (select d.source, l.doc_id is not null as has_label, d.n_chars >= 2000 as is_long from documents d left join labels l on l.doc_id = d.doc_id) group by 1, 2")
def q_contingency(spark, d):
    """AG17: a two-by-two table with counts in two units."""
    lab = load(spark, d, "labels").select("doc_id", F.lit(True).alias("hit"))
    docs = load(spark, d, "documents").select("doc_id", "source", "n_chars").join(lab, "doc_id", "left")
    return docs.groupBy(F.coalesce("hit", F.lit(False)).alias("has_label"), (F.col("n_chars") >= 2000).alias("is_long")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"))


@book("select 'item' as grain, count(*) as total, count(*) filter (where a) as hit_a, count(*) filter (where b) as hit_b, count(*) filter (where a or b) as hit_any from (select l_orderkey, l_linenumber, l_quantity >= 30 as a, l_discount >= 0.05 as b from lineitem) union all select 'order', count(*), count(*) filter (where a), count(*) filter (where b), count(*) filter (where a or b) from (select l_orderkey, bool_or(l_quantity >= 30) as a, bool_or(l_discount >= 0.05) as b from lineitem group by 1)")
def q_union_recall(spark, d):
    """AG19: recall of two methods and of their union at two grains."""
    li = load(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") >= 30).alias("a"), (F.col("l_discount") >= 0.05).alias("b"))
    per = li.groupBy("l_orderkey").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    total = lambda df, name: df.agg(F.count("*").alias("total"), F.count_if("a").alias("hit_a"), F.count_if("b").alias("hit_b"), F.count_if(F.col("a") | F.col("b")).alias("hit_any")).withColumn("grain", F.lit(name))
    return total(li, "item").unionByName(total(per, "order"))


@book("select o_custkey, o_orderkey, rank_label, o_totalprice from (select o_custkey, o_orderkey, o_totalprice, case when r <= 26 then chr(cast(64 + r as int)) else 'A' || (r - 26) end as rank_label from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders))")
def q_rank_labels(spark, d):
    """Letters by rank."""
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    r = F.row_number().over(order)
    label = F.when(F.col("r") <= 26, F.chr(64 + F.col("r"))).otherwise(F.concat(F.lit("A"), (F.col("r") - 26).cast("string")))
    return load(spark, d, "orders").withColumn("r", r).select("o_custkey", "o_orderkey", label.alias("rank_label"), "o_totalprice")


@book("select o_custkey, best, second, case when second is null then 1.0 else round((best - second) / abs(best), 6) end as margin, case when second is null then 'unique' when (best - second) / abs(best) < 0.05 then 'ambiguous' else 'resolved' end as status from (select o_custkey, max(case when r = 1 then o_totalprice end) as best, max(case when r = 2 then o_totalprice end) as second from (select o_custkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) group by 1)")
def q_best_runner_margin(spark, d):
    """Best against runner-up."""
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = load(spark, d, "orders").withColumn("r", F.row_number().over(order)).where("r <= 2")
    top = top.groupBy("o_custkey").agg(F.max(F.when(F.col("r") == 1, F.col("o_totalprice"))).alias("best"), F.max(F.when(F.col("r") == 2, F.col("o_totalprice"))).alias("second"))
    m = (F.col("best") - F.col("second")) / F.abs("best")
    status = F.when(F.col("second").isNull(), "unique").when(m < 0.05, "ambiguous").otherwise("resolved")
    return top.select("o_custkey", "best", "second", F.coalesce(r6(m), F.lit(1.0)).alias("margin"), status.alias("status"))


@book("select o_orderkey as a, nxt as b, gap_days from (select o_orderkey, lead(o_orderkey) over w as nxt, date_diff('day', cast(o_orderdate as date), cast(lead(o_orderdate) over w as date)) as gap_days from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)) where nxt is not null")
def q_adjacent_pairs(spark, d):
    """Neighbours in order."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = load(spark, d, "orders").withColumn("b", F.lead("o_orderkey").over(w)).withColumn("d2", F.lead("o_orderdate").over(w)).where("b is not null")
    return o.select(F.col("o_orderkey").alias("a"), "b", F.datediff(F.to_date("d2"), F.to_date("o_orderdate")).cast("long").alias("gap_days"))


@book("select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as r from orders) where r = 1")
def q_first_per_group(spark, d):
    """The first row of each key, in a stated order, by a partial minimum."""
    first = F.min(F.struct("o_orderdate", "o_orderkey")).alias("f")
    return load(spark, d, "orders").groupBy("o_custkey").agg(first).select("o_custkey", "f.o_orderkey", "f.o_orderdate")


@book("select p_brand, p_type, dense_rank() over (order by p_brand, p_type) as event_no, 'E' || lpad(cast(dense_rank() over (order by p_brand, p_type) as varchar), 6, '0') as event_id, n from (select p_brand, p_type, count(*) as n from part group by 1, 2)")
def q_dense_ids(spark, d):
    """Ids by rank of sorted distinct keys."""
    n = load(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return ranking.dense_ids(n, ["p_brand", "p_type"], "event_no").withColumn("event_id", F.concat(F.lit("E"), F.lpad(F.col("event_no").cast("string"), 6, "0")))


@book("select p_brand, p_partkey, p_size from (select *, count(*) over (partition by p_brand, p_type) as n from part) where n >= 5")
def q_min_group_size(spark, d):
    """SO8: groups of at least a size."""
    n = F.count("*").over(Window.partitionBy("p_brand", "p_type"))
    return load(spark, d, "part").withColumn("n", n).where("n >= 5").select("p_brand", "p_partkey", "p_size")


@book("select o_orderpriority, cast(bucket * 10 as bigint) as at_month, n, round((n - lag(n) over (partition by o_orderpriority order by bucket)) / 10.0, 6) as rate from (select o_orderpriority, cast(floor(((year(o_orderdate) - 1990) * 12 + month(o_orderdate)) / 10) as bigint) as bucket, count(*) as n from orders group by 1, 2)")
def q_marginal_rate(spark, d):
    """Slope between neighbouring points of a curve."""
    month = (F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")
    n = load(spark, d, "orders").groupBy("o_orderpriority", F.floor(month / 10).alias("bucket")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("o_orderpriority").orderBy("bucket")
    return n.select("o_orderpriority", long(F.col("bucket") * 10).alias("at_month"), "n", r6((F.col("n") - F.lag("n").over(w)) / 10.0).alias("rate"))
