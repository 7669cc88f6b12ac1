"""Interval operators over event times: each user is a contig, each event an interval of ten minutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import intervals as iv
from strandloom.queries._tables import Book, load, long, seconds

book = Book()
QUERIES, SQL = book.queries, book.sql

_E = "(select event_id, user_id, event_type, cast(floor(epoch(ts)) as bigint) as s, cast(floor(epoch(ts)) as bigint) + 600 as e from events)"


def _events(spark, d):
    return load(spark, d, "events").select("event_id", "user_id", "event_type", long(seconds("ts")).alias("s")).withColumn("e", F.col("s") + 600)


def _sides(spark, d):
    """Clicks on the left, all other events on the right."""
    ev = _events(spark, d)
    left = ev.where("event_type = 'click'").select("user_id", F.col("event_id").alias("l_id"), F.col("s").alias("l_start"), F.col("e").alias("l_end"))
    right = ev.where("event_type <> 'click'").select("user_id", F.col("event_id").alias("r_id"), F.col("s").alias("r_start"), (F.col("s") + 900).alias("r_end"))
    return left, right


_PAIRS = f"(select l.user_id, l.event_id as l_id, l.s as l_start, l.e as l_end, r.event_id as r_id, r.s as r_start, r.s + 900 as r_end from {_E} l join {_E} r on l.user_id = r.user_id and l.event_type = 'click' and r.event_type <> 'click')"
_BP = "greatest(0, least(l_end, r_end) - greatest(l_start, r_start))"


@book(f"select user_id, min(s) as start, max(e) as \"end\", count(*) as n from (select *, sum(fresh) over (partition by user_id order by s, e rows unbounded preceding) as island from (select *, case when max(e) over w is null or s > max(e) over w + 300 then 1 else 0 end as fresh from {_E} window w as (partition by user_id order by s, e rows between unbounded preceding and 1 preceding))) group by user_id, island")
def q_merge_intervals(spark, d):
    """Islands with a slack of five minutes."""
    return iv.merge_intervals(_events(spark, d).withColumnRenamed("s", "start").withColumnRenamed("e", "end"), ["user_id"], slack=300)


@book(f"with recursive p as (select distinct user_id, s from {_E}), t as (select user_id, min(s) as s from p group by 1 union all select t.user_id, (select min(p.s) from p where p.user_id = t.user_id and p.s >= t.s + 3600) from t where t.s is not null) select user_id, count(s) as n_loci from t where s is not null group by 1")
def q_distinct_loci(spark, d):
    """Greedy thinning to one position an hour."""
    return iv.distinct_loci(_events(spark, d), ["user_id"], "s", 3600).select("user_id", long("n_loci").alias("n_loci"))


@book(f"select user_id, l_id, r_id, overlap_bp, round(share, 6) as share from (select *, row_number() over (partition by l_id order by share desc, overlap_bp desc, r_id) as r from (select user_id, l_id, r_id, {_BP} as overlap_bp, {_BP} / greatest(l_end - l_start, r_end - r_start) as share from {_PAIRS}) where share >= 0.3) where r = 1")
def q_overlap_best(spark, d):
    """Best reciprocal overlap."""
    return iv.best_overlap(*_sides(spark, d), ["user_id"], 3600, least=0.3).withColumn("share", F.round("share", 6))


@book(f"select user_id, l_id, r_id, overlap_bp, round(share, 6) as share from (select *, row_number() over (partition by l_id order by share desc, overlap_bp desc, r_id) as r from (select user_id, l_id, r_id, {_BP} as overlap_bp, {_BP} / least(l_end - l_start, r_end - r_start) as share from {_PAIRS}) where share >= 0.5) where r = 1")
def q_overlap_shorter(spark, d):
    """Overlap as a share of the shorter interval."""
    return iv.best_overlap(*_sides(spark, d), ["user_id"], 3600, least=0.5, shorter=True).withColumn("share", F.round("share", 6))


@book(f"select l_id, max({_BP}) as overlap_bp, count(*) as n from {_PAIRS} where {_BP} >= 0.5 * (l_end - l_start) group by 1")
def q_overlap_coverage(spark, d):
    """Overlaps that cover half of the left interval."""
    from strandloom.functions.seq import overlap

    bp = overlap(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))
    pairs = iv.overlap_join(*_sides(spark, d), ["user_id"], 3600).withColumn("bp", bp).where(F.col("bp") >= 0.5 * (F.col("l_end") - F.col("l_start")))
    return pairs.groupBy("l_id").agg(long(F.max("bp")).alias("overlap_bp"), F.count("*").alias("n"))


@book(f"select user_id, l_id, r_id from {_PAIRS} where abs(l_start - r_start) <= 400 and abs(l_end - r_end) <= 400")
def q_band_join(spark, d):
    """Both ends within a tolerance."""
    return iv.band_join(*_sides(spark, d), ["user_id"], 400).select("user_id", "l_id", "r_id")


@book(f"select user_id, l_id, r_id, distance from (select *, row_number() over (partition by l_id order by distance, r_id) as r from (select *, greatest(abs(l_start - r_start), abs(l_end - r_end)) as distance from {_PAIRS}) where distance <= 2000) where r = 1")
def q_nearest_within(spark, d):
    """The nearest within a window."""
    return iv.nearest_within(*_sides(spark, d), ["user_id"], 2000).select("user_id", "l_id", "r_id", "distance")


@book(f"select a.event_id as a, b.event_id as b, a.user_id from {_E} a join {_E} b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'purchase' and greatest(0, a.s - b.e, b.s - a.e) <= 200")
def q_proximity(spark, d):
    """Many-to-many pairs at a distance of at most 200."""
    ev = _events(spark, d)
    left = ev.where("event_type = 'click'").select("user_id", F.col("event_id").alias("a"), F.col("s").alias("l_start"), F.col("e").alias("l_end"))
    right = ev.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b"), F.col("s").alias("r_start"), F.col("e").alias("r_end"))
    return iv.overlap_join(left, right, ["user_id"], 3600, pad=201).select("a", "b", "user_id")


@book(f"select p_id, r_id, distance, inside, case when inside then 'inside' when distance is not null then 'near' else 'none' end as call from (select q.p_id, r.* exclude (p_id) from (select event_id as p_id from {_E} where event_type = 'click') q left join (select p_id, r_id, distance, inside from (select *, row_number() over (partition by p_id order by inside desc, case when inside then r_start - r_end end nulls first, distance, r_id) as r from (select *, case when inside then 0 else least(abs(pos - r_start), abs(pos - r_end)) end as distance from (select l.event_id as p_id, l.s as pos, r.event_id as r_id, r.s as r_start, r.s + 900 as r_end, r.s <= l.s and l.s < r.s + 900 as inside from {_E} l join {_E} r on l.user_id = r.user_id and l.event_type = 'click' and r.event_type <> 'click')) where distance <= 1500) where r = 1) r on r.p_id = q.p_id)")
def q_point_in_interval(spark, d):
    """The longest interval around a point, else the nearest edge."""
    points = _events(spark, d).where("event_type = 'click'").select("user_id", F.col("event_id").alias("p_id"), F.col("s").alias("at"))
    out = iv.point_in_interval(points, _sides(spark, d)[1], ["user_id"], 3600, 1500)
    call = F.when(F.col("inside"), "inside").when(F.col("distance").isNotNull(), "near").otherwise("none")
    return out.select("p_id", "r_id", "distance", "inside", call.alias("call"))


@book(f"select a.bin as bin, a.event_type as left_type, b.event_type as right_type, count(*) as n from (select user_id, event_type, cast(floor(s / 3600) as bigint) as bin from {_E}) a join (select user_id, event_type, cast(floor(s / 3600) as bigint) as bin from {_E}) b on a.user_id = b.user_id and a.bin = b.bin and a.event_type < b.event_type group by all")
def q_positional_bins(spark, d):
    """Rows that share a key and a position bin; counts before the join keep it from making pairs."""
    n = _events(spark, d).groupBy("user_id", F.floor(F.col("s") / 3600).alias("bin"), "event_type").agg(F.count("*").alias("n"))
    a = n.select("user_id", "bin", F.col("event_type").alias("left_type"), F.col("n").alias("x"))
    b = n.select("user_id", "bin", F.col("event_type").alias("right_type"), F.col("n").alias("y"))
    return a.join(b, ["user_id", "bin"]).where("left_type < right_type").groupBy("bin", "left_type", "right_type").agg(F.sum(F.col("x") * F.col("y")).alias("n"))


@book()
def q_complete_link_groups(spark, d):
    """GR5: complete-link groups of intervals of one user and type."""
    ev = _events(spark, d).select("user_id", "event_type", F.col("event_id").alias("id"), F.col("s").alias("start"), F.col("e").alias("end"))
    return iv.complete_link_groups(ev, ["user_id", "event_type"], least=0.5)


@book("select user_id, count(*) as n_events, min(s) as started, max(s) + 1800 as ended from (select *, sum(fresh) over (partition by user_id order by s rows unbounded preceding) as k from (select *, case when lag(s) over w is null or s > lag(s) over w + 1800 then 1 else 0 end as fresh from (select user_id, cast(floor(epoch(ts)) as bigint) as s from events) window w as (partition by user_id order by s))) group by user_id, k")
def q_session_window(spark, d):
    """[EXT] sessions with a gap of thirty minutes: the image of W1 on time."""
    ev = load(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("ts", F.date_trunc("second", "ts"))
    w = ev.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n_events"))
    return w.select("user_id", "n_events", F.unix_timestamp("w.start").alias("started"), F.unix_timestamp("w.end").alias("ended"))
