"""Audits, gates, votes, formats and located inserts over the catalogue tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import seq, udf
from strandloom.operators import verdicts as v
from strandloom.queries._tables import DNA, Book, load

book = Book()
QUERIES, SQL = book.queries, book.sql


@book("select l_orderkey, l_linenumber, case when i >= 0.95 and c >= 0.90 then 'ArmB_extent_imprecise' when n > 1 and m < 0.75 then 'different_long_alleles' when a > 5 or (rc >= 0 and rc <> len) then 'Layer2_repeat_ambiguous' when i < 0.80 or c < 0.50 then 'true_decomposition_error' else 'Layer2_repeat_ambiguous' end as why from (select l_orderkey, l_linenumber, l_suppkey % 101 / 100.0 as i, l_partkey % 53 / 52.0 as c, l_linenumber as n, l_quantity / 50 as m, l_orderkey % 9 as a, l_partkey % 3 - 1 as rc, l_suppkey % 2 as len from lineitem)")
def q_disagreement(spark, d):
    """PF12."""
    li = load(spark, d, "lineitem")
    why = v.disagreement(F.col("l_suppkey") % 101 / 100.0, F.col("l_partkey") % 53 / 52.0, F.col("l_linenumber"), F.col("l_quantity") / 50, F.col("l_orderkey") % 9, F.col("l_partkey") % 3 - 1, F.col("l_suppkey") % 2)
    return li.select("l_orderkey", "l_linenumber", why.alias("why"))


@book("select p_partkey, p_brand, size, median, greatest(100000, cast(floor(0.5 * median) as bigint)) as floor, size >= greatest(100000, cast(floor(0.5 * median) as bigint)) as passes from (select p_partkey, p_brand, p_size * p_size * 300 as size from part) join (select p_brand, list_extract(list_sort(list(p_size * p_size * 300)), cast(least(count(*) - 1, floor(count(*) * 0.5)) as bigint) + 1) as median from part group by 1) using (p_brand)")
def q_size_gate(spark, d):
    """PF16: members against half of their panel's upper median."""
    sizes = load(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_size") * F.col("p_size") * 300).alias("size"))
    return v.size_gate(sizes, ["p_brand"], "size").select("p_partkey", "p_brand", "size", "median", "floor", "passes")


_VOTES = "(select l_orderkey, case when l_partkey % 11 = 0 then '.' when l_partkey % 7 = 0 then 'ambiguous_between_A_B' else chr(cast(65 + l_suppkey % 3 as int)) end as a, case when l_linenumber = 5 then 'unresolved' else 'resolved' end as s from lineitem)"


@book(f"""
with v as (select * from {_VOTES}), c as (select l_orderkey, a, count(*) as n from v where s <> 'unresolved' and a not in ('.', '') and not starts_with(a, 'ambiguous_between') group by all),
b as (select l_orderkey, arg_min(a, (-n, a)) as allele, max(n) as n, cast(sum(n) as bigint) as votes from c group by 1)
select l_orderkey, coalesce(allele, '.') as allele, coalesce(n, 0) as n, coalesce(votes, 0) as votes, case when votes is null then 'none' when n = votes then 'unanimous' when 2 * n > votes then 'majority' else 'split' end as agreement from (select distinct l_orderkey from v) left join b using (l_orderkey)""")
def q_supported_allele(spark, d):
    """the allele that the confident votes of a locus support."""
    part = F.col("l_partkey")
    a = F.when(part % 11 == 0, ".").when(part % 7 == 0, "ambiguous_between_A_B").otherwise(F.char((65 + F.col("l_suppkey") % 3).cast("int")))
    votes = load(spark, d, "lineitem").select("l_orderkey", a.alias("allele_assignment"), F.when(F.col("l_linenumber") == 5, "unresolved").otherwise("resolved").alias("allele_match_status"))
    return v.supported_allele(votes, ["l_orderkey"])


@book("select p_partkey, case when p_size % 5 = 0 then 'NA' else printf('%.3f', p_retailprice / p_size) end as text from part")
def q_fixed(spark, d):
    """numbers with a fixed count of digits, NA for none."""
    x = F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice").cast("double") / F.col("p_size"))
    return load(spark, d, "part").select("p_partkey", udf.fixed(x, F.lit(3)).alias("text"))


_SIZE = 12
#: Where each insert is, what is stated of it, and its digest; some starts are wrong, some digests occur nowhere, some inserts are empty.
_LONG = f"""(select doc_id, s, case when doc_id % 11 = 10 then 0 else {_SIZE} end as len, case when doc_id % 5 = 0 then t when doc_id % 5 <> 4 then doc_id % 17 end as lcp, case when doc_id % 3 = 0 then t when doc_id % 3 = 1 then t + 5 end as st,
  case when doc_id % 7 = 6 then repeat('0', 32) else md5(substr(s, t + 1, {_SIZE})) end as h from (select doc_id, s, cast((doc_id * 37) % greatest(1, length(s) - {_SIZE} + 1) as bigint) as t from (select doc_id, {DNA.format('text')} as s from documents where text is not null)))"""


@book(f"""
with l as materialized (select *, coalesce(lcp, 0) as p, length(s) - len as last from {_LONG}),
k as (select doc_id, unnest(range(last + 1)) as k from l where len > 0 and last >= 0), m as (select doc_id, k, p, st from k join l using (doc_id) where md5(substr(s, k + 1, {_SIZE})) = h),
r as (select doc_id, bool_or(k = st) as at_start, bool_or(k = p) as at_prefix, arg_min(k, (abs(k - p), k)) as nearest from m group by 1)
select doc_id, case when at_start then 'coord' when at_prefix then 'lcp' when nearest is not null then 'repaired' else 'unresolved' end as status, cast(case when at_start then st when at_prefix then p else nearest end as integer) as start from l left join r using (doc_id)""")
def q_locate_insert(spark, d):
    """an insert of each whole text by its stated start, the common prefix, or the place with its digest nearest to that."""
    s = load(spark, d, "documents").where("text is not null").select("doc_id", seq.dna("text").alias("s"))
    k = F.col("doc_id")
    t = (k * 37) % F.greatest(F.lit(1), F.length("s") - _SIZE + 1)
    s = s.withColumn("t", t)
    digest = F.when(k % 7 == 6, F.repeat(F.lit("0"), 32)).otherwise(F.md5(F.substring("s", (F.col("t") + 1).cast("int"), F.lit(_SIZE))))
    start, lcp = F.when(k % 3 == 0, F.col("t")).when(k % 3 == 1, F.col("t") + 5), F.when(k % 5 == 0, F.col("t")).when(k % 5 != 4, k % 17)
    return s.select("doc_id", udf.locate_insert("s", F.when(k % 11 == 10, 0).otherwise(_SIZE), start, lcp, digest).alias("x")).select("doc_id", "x.status", "x.start")


@book()
def q_compare_alleles(spark, d):
    """A11, PF10: an insert in the middle of each whole text against the text without it, aligned within 300 letters of it."""
    s = load(spark, d, "documents").select("doc_id", seq.dna(F.coalesce("text", F.lit(""))).alias("s"))
    at, n = F.expr("length(s) div 3"), (40 + F.col("doc_id") % 20).cast("int")
    low = F.greatest(F.lit(0), at - 300)
    s = s.select("doc_id", seq.window("s", low.cast("int"), (at + n + 300).cast("int")).alias("s"), (at - low).cast("int").alias("start"), (at - low + n).cast("int").alias("end"))
    short = seq.excise("s", F.col("start"), F.col("end"))
    return s.select("doc_id", udf.compare_alleles("s", short, "start", "end").alias("x")).select("doc_id", "x.*")
