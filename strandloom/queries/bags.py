"""Carriers, sites, bags, alleles, events and the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.plans import bags, catalogue
from strandloom.queries._tables import DNA, RC, Book, load, long, r6

book = Book()
QUERIES, SQL = book.queries, book.sql

_HITS = "(select d.doc_id, d.source, d.lang, d.text, b.item_id, b.text as item_text, cast(strpos(d.text, b.text) - 1 as bigint) as pos, cast(length(b.text) as bigint) as size from documents d join benchmark b on contains(d.text, b.text))"
_SITES = f"(select *, least(pre, {RC.format('pre')}) as flank, case when pre <= {RC.format('pre')} then 'fwd' else 'rc' end as orient from (select *, {DNA.format('substr(e, cast(greatest(pos - 60, 0) + 1 as bigint), cast(least(pos + 60, length(e)) - greatest(pos - 60, 0) as bigint))')} as pre, pos >= 60 and length(e) >= pos + 60 as flank_complete from (select *, substr(text, 1, pos) || substr(text, pos + size + 1) as e from {_HITS})))"


def _hits(spark, d):
    return bags.carriers(load(spark, d, "documents"), load(spark, d, "benchmark"))


@book(f"select item_id, md5(flank) as flank_md5, min(doc_id) as first_doc, count(*) as n_carriers, count(distinct source) as n_species, count(distinct md5(text)) as n_alleles_at_site, bool_and(flank_complete) as flank_complete from {_SITES} group by item_id, flank")
def q_bag_flagship(spark, d):
    """Carriers of each passage, excised, with canonical flanks, one row per (bag, flank)."""
    b = bags.bags(bags.sites(_hits(spark, d)))
    return b.select("item_id", F.md5("flank").alias("flank_md5"), "first_doc", "n_carriers", "n_species", "n_alleles_at_site", "flank_complete")


@book(f"select doc_id, item_id, pos, size from {_HITS}")
def q_locate(spark, d):
    """Containment."""
    return _hits(spark, d).select("doc_id", "item_id", F.col("at").alias("pos"), "size")


@book(f"select doc_id, item_id, md5(e) as empty_md5, substr(e, 1, pos) || item_text || substr(e, pos + 1) = text as restored from (select *, substr(text, 1, pos) || substr(text, pos + size + 1) as e from {_HITS})")
def q_excise_restore(spark, d):
    """excision, and that inserting again restores the text."""
    h = _hits(spark, d).withColumn("e", seq.excise("text", F.col("at"), F.col("at") + F.col("size")))
    return h.select("doc_id", "item_id", F.md5("e").alias("empty_md5"), (seq.insert_at("e", F.col("at"), "item_text") == F.col("text")).alias("restored"))


@book(f"select item_id, count(*) as n_sites, count(distinct source) as n_species, count(distinct flank) as n_flanks, count(*) filter (where orient = 'rc') as n_rc from {_SITES} group by 1 having count(*) >= 2")
def q_bag_counts(spark, d):
    """AG2, AG20, SO8: bags of at least two sites."""
    s = bags.sites(_hits(spark, d)).groupBy("item_id").agg(F.count("*").alias("n_sites"), F.countDistinct("source").alias("n_species"), F.countDistinct("flank").alias("n_flanks"), F.count_if(F.col("orient") == "rc").alias("n_rc"))
    return s.where("n_sites >= 2")


@book(f"select l.item_id, n_loose, n_strict, n_loose - biggest as lost from (select item_id, count(*) as n_loose from {_HITS} group by 1) l join (select item_id, count(*) as n_strict, max(n) as biggest from (select item_id, lang, count(*) as n from {_HITS} group by 1, 2) group by 1) s on s.item_id = l.item_id")
def q_loose_vs_strict(spark, d):
    """AG26: one grouping against a finer one."""
    fine = _hits(spark, d).groupBy("item_id", "lang").agg(F.count("*").alias("n"))
    return fine.groupBy("item_id").agg(F.sum("n").alias("n_loose"), F.count("*").alias("n_strict"), F.max("n").alias("m")).select("item_id", "n_loose", "n_strict", (F.col("n_loose") - F.col("m")).alias("lost"))


@book(f"select b.item_id, coalesce(n, 0) as n_present, round(coalesce(n, 0) / (select count(*) from documents), 6) as frac_present, case when coalesce(n, 0) = 0 then '0' when n <= 1 then '1' else '2+' end as band from benchmark b left join (select item_id, count(distinct doc_id) as n from {_HITS} group by 1) h on h.item_id = b.item_id")
def q_presence(spark, d):
    """Presence of each element over all carriers, with absent ones as rows."""
    total = load(spark, d, "documents").count()
    n = _hits(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n"))
    out = load(spark, d, "benchmark").select("item_id").join(n, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_present"))
    band = F.when(F.col("n_present") == 0, "0").when(F.col("n_present") <= 1, "1").otherwise("2+")
    return out.select("item_id", "n_present", r6(F.col("n_present") / max(total, 1)).alias("frac_present"), band.alias("band"))


@book(f"select count(*) as t1_rows, count(distinct (item_id, doc_id)) as t2_sites, count(distinct (item_id, flank)) as t3_flanks, count(distinct (item_id, source)) as t4_species, round(count(distinct (item_id, flank)) / 8.3, 6) as per_core_hour from {_SITES}")
def q_four_tier(spark, d):
    """ST11, AG2: four grains of background counts, and one of them by cost."""
    s = bags.sites(_hits(spark, d))
    n = lambda *c: F.count_distinct(*map(F.col, c))
    return s.agg(F.count("*").alias("t1_rows"), n("item_id", "doc_id").alias("t2_sites"), n("item_id", "flank").alias("t3_flanks"), n("item_id", "source").alias("t4_species"), r6(n("item_id", "flank") / 8.3).alias("per_core_hour"))


@book("select source, md5, carriers, size, case when r <= 26 then chr(cast(64 + r as int)) else 'A' || (r - 26) end as allele from (select *, row_number() over (partition by source order by carriers desc, size, md5) as r from (select source, md5(text) as md5, count(*) as carriers, any_value(length(text)) as size from documents group by 1, 2))")
def q_allele_labels(spark, d):
    """Alleles by carriers."""
    return catalogue.alleles(load(spark, d, "documents"))


_LOCI = f"(select doc_id as locus, source as species, source || '/' || lang as panel, case when length(s) <= 100 then '' else substr(md5(least(substr(s, 101), {RC.format('substr(s, 101)')})), 1, 16) end as insert_key, case when length(s) >= 100 then substr(md5(least(left(s, 100), {RC.format('left(s, 100)')})), 1, 16) end as context_key, greatest(length(s) - 100, 0) as inserted_len from (select *, {DNA.format('text')} as s from documents))"
_EVENTS = f"(select insert_key, context_key, n_loci, n_panels, 'E' || lpad(cast(row_number() over (order by insert_key, context_key) as varchar), 6, '0') as event_id from (select insert_key, context_key, count(*) as n_loci, count(distinct panel) as n_panels from {_LOCI} where context_key is not null and insert_key <> '' group by 1, 2))"


@book(f"select * from {_EVENTS}")
def q_event_dedup(spark, d):
    """Events by (insert, context), with dense ids."""
    return catalogue.deduplicate(catalogue.loci(load(spark, d, "documents")))


@book(f"select event_id, n_events_with_key, n_events_with_key > 1 as m2_cross_event from {_EVENTS} join (select insert_key, count(*) as n_events_with_key from {_EVENTS} group by 1) using (insert_key)")
def q_m2_cross_event(spark, d):
    """M2: an insert at another event."""
    return catalogue.mobility(q_event_dedup(spark, d)).select("event_id", "n_events_with_key", "m2_cross_event")


@book(f"select event_id, f.locus, f.species, f.panel, f.inserted_len, n_loci, n_panels, n_species, m2 as m2_cross_event, f.inserted_len % 7 <> 0 as s1_clean, f.inserted_len % 7 <> 0 and m2 as usable from (select *, count(*) over (partition by insert_key) > 1 as m2 from {_EVENTS}) e join (select insert_key, context_key, arg_min(l, locus) as f, count(distinct species) as n_species from {_LOCI} l where context_key is not null group by 1, 2) r on r.insert_key = e.insert_key and r.context_key = e.context_key")
def q_catalogue(spark, d):
    """The catalogue: one row per event."""
    rows = catalogue.loci(load(spark, d, "documents"))
    return catalogue.catalogue(rows, catalogue.deduplicate(rows))


@book(f"select species, count(*) as n_rows, count(distinct insert_key) as n_inserts, sum(inserted_len) as total_bp from {_LOCI} where species not in ('src3') and insert_key <> '' group by rollup (species)")
def q_database(spark, d):
    """Rows of all species but an excluded one, with a total."""
    rows = catalogue.loci(load(spark, d, "documents")).where("insert_key <> ''")
    rows = rows.join(spark.createDataFrame([("src3",)], "species string"), "species", "left_anti")
    return rows.rollup("species").agg(F.count("*").alias("n_rows"), F.countDistinct("insert_key").alias("n_inserts"), F.sum("inserted_len").alias("total_bp"))


SQL["q_database"] = SQL["q_database"].replace("sum(inserted_len)", "cast(sum(inserted_len) as bigint)")


@book("select doc_id, n_runs, coalesce(longest, 0) as longest, round(case when n_chars > 0 then coalesce(covered, 0) / n_chars else 0 end, 6) as covered_frac from (select doc_id, length(text) as n_chars, len(regexp_extract_all(text, '[^.]{20,}')) as n_runs, list_max(list_transform(regexp_extract_all(text, '[^.]{20,}'), lambda x: length(x))) as longest, list_sum(list_transform(regexp_extract_all(text, '[^.]{20,}'), lambda x: length(x))) as covered from documents)")
def q_noncoding_runs(spark, d):
    """runs of at least twenty characters between marks, and the share they cover."""
    runs = F.regexp_extract_all("text", F.lit(r"[^.]{20,}"), F.lit(0))
    t = load(spark, d, "documents").select("doc_id", F.length("text").alias("n"), F.transform(runs, F.length).alias("r"))
    covered = F.aggregate("r", F.lit(0), lambda a, x: a + x)
    return t.select("doc_id", long(F.size("r")).alias("n_runs"), long(F.coalesce(F.array_max("r"), F.lit(0))).alias("longest"), r6(F.when(F.col("n") > 0, covered / F.col("n")).otherwise(0.0)).alias("covered_frac"))
