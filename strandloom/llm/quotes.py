"""Quotation linking: which message a quoted passage comes from, and conversations in reply order without quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import materialize, scratch

#: Turns (and threads) in a bucket of the ordered operators: no key, however hot, has more in one window.
BUCKET = 1024
#: Blanks and quote marks up to the last mark; one character class, so that no line is too long for the matcher's stack.
MARKS = r"^[ \t>]*>"
WROTE = r"(?i)\bwrote:\s*$"


def level_of(line: Column) -> Column:
    """Number of quote marks that a line begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[^>]", ""))


def lines_of(text: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")


def normalised(passage: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(passage, r"\s+", " ")))


def passages(lines: Column, level: Column) -> Column:
    """Distinct normalised passages of one quote level: runs of its lines between blank or other lines, and single lines."""
    own = F.transform(lines, lambda x: F.when(level_of(x) == level, F.regexp_replace(x, MARKS, "")).otherwise(""))
    runs = F.split(F.array_join(own, "\n"), r"\n\s*\n")
    units = F.array_distinct(F.transform(F.concat(runs, own), normalised))
    return F.filter(units, lambda u: u != "")


def without_quotes(lines: Column) -> Column:
    """The lines that aren't quoted, without a line ``... wrote:`` right above a quote."""

    def stays(line: Column, i: Column) -> Column:
        below = F.coalesce(level_of(F.get(lines, i + 1)), F.lit(0))
        return (level_of(line) == 0) & ~((below > 0) & F.regexp_like(line, F.lit(WROTE)))

    return F.regexp_replace(F.regexp_replace(F.array_join(F.filter(lines, stays), "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def latest_before(quoted: DataFrame, originals: DataFrame, keys: list[str], at: str = "turn") -> DataFrame:
    """``source``: the greatest ``at`` of ``originals`` with the same keys and below that of the row, for each row of ``quoted``.

    An as-of join in two levels: within buckets of ``at``, and from bucket to bucket; so no pairs are made and a hot key is
    spread over as many windows as it has buckets. Rows without such an original are left out.
    """
    bucket = F.floor(F.col(at) / BUCKET).alias("bucket")
    both = originals.select(*keys, at).distinct().select(*keys, at, bucket, F.lit(True).alias("own")).unionByName(
        quoted.select(*keys, at).distinct().select(*keys, at, bucket, F.lit(False).alias("own"))
    )
    both = materialize(both, "asof")
    inside = Window.partitionBy(*keys, "bucket").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max(F.when(F.col("own"), F.col(at))).over(inside)).where(~F.col("own"))
    tops = both.where("own").groupBy(*keys, "bucket").agg(F.max(at).alias("top"))
    asks = near.where("near is null").select(*keys, "bucket").distinct().withColumn("top", F.lit(None).cast("long"))
    across = Window.partitionBy(*keys).orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    steps = tops.unionByName(asks).groupBy(*keys, "bucket").agg(F.max("top").alias("top"))
    steps = steps.select(*keys, "bucket", F.max("top").over(across).alias("far"))
    found = near.join(steps, [*keys, "bucket"], "left").select(*keys, at, F.coalesce("near", "far").alias("source")).where("source is not null")
    return quoted.join(found, [*keys, at])


def thread_roots(replies: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(conv_id, turn, thread, depth) of each row of (conv_id, turn, reply_to): pointers are doubled until they all end."""
    step = materialize(replies.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "thread")
    for _ in range(max_rounds):
        above = step.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("up"), F.col("depth").alias("more"))
        step = materialize(step.join(above, ["conv_id", "thread"], "left"), "thread")
        if step.where("up is not null").isEmpty():
            break
        step = step.select("conv_id", "turn", F.coalesce("up", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
    return step.select("conv_id", "turn", "thread", "depth")


def positions(slots: DataFrame) -> DataFrame:
    """``position`` (from 1) of each (conv_id, turn, thread) within its conversation, by thread and then turn.

    Ranks are added up from three levels (turns of a bucket, buckets of a thread, buckets of threads), so that a
    conversation with a large part of all messages isn't sorted by one task.
    """
    s = slots.withColumn("tb", F.floor(F.col("thread") / BUCKET)).withColumn("ub", F.floor(F.col("turn") / BUCKET))
    inner = Window.partitionBy("conv_id", "thread", "ub").orderBy("turn")
    s = s.withColumn("r", F.row_number().over(inner))
    runs = s.groupBy("conv_id", "tb", "thread", "ub").agg(F.count("*").alias("n"))
    a = Window.partitionBy("conv_id", "tb").orderBy("thread", "ub").rowsBetween(Window.unboundedPreceding, -1)
    b = Window.partitionBy("conv_id").orderBy("tb").rowsBetween(Window.unboundedPreceding, -1)
    mid = runs.withColumn("a", F.coalesce(F.sum("n").over(a), F.lit(0)))
    top = runs.groupBy("conv_id", "tb").agg(F.sum("n").alias("n")).withColumn("b", F.coalesce(F.sum("n").over(b), F.lit(0))).drop("n")
    placed = s.join(mid.select("conv_id", "tb", "thread", "ub", "a"), ["conv_id", "tb", "thread", "ub"]).join(top, ["conv_id", "tb"])
    return placed.select("conv_id", "turn", "thread", (F.col("r") + F.col("a") + F.col("b")).cast("long").alias("position"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, body (its text without quotes), quote_level (the deepest), n_passages,
    n_linked, reply_to, thread, depth, position.

    A quoted passage comes from the latest earlier message of its conversation that has it outside quotes. A message
    replies to the source of its shallowest linked passages, of several to that with the most characters quoted, then the
    later one; without a linked passage it begins a thread (thread is its own turn, depth 0, reply_to null). ``position``
    orders a conversation by thread and turn. Messages with equal conv_id and turn have one place; a null conv_id or turn
    has none (null thread and position) and links with nothing; a passage of one character counts as any other; a null text
    is empty; an empty table gives an empty result; other columns are left out. DataFrame operations only.
    """
    with scratch(messages.sparkSession):
        return _linked(messages)


def _linked(messages: DataFrame) -> DataFrame:
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", lines_of(F.col("text")).alias("lines"))
    quoted = rows.where(F.exists("lines", lambda x: level_of(x) > 0) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    units = quoted.select("conv_id", "turn", "lines", F.explode(F.array_distinct(F.transform("lines", level_of))).alias("level")).where("level > 0")
    units = units.select("conv_id", "turn", "level", F.explode(passages(F.col("lines"), F.col("level"))).alias("unit"))
    units = units.select("conv_id", "turn", "level", F.md5("unit").alias("hash"), F.length("unit").alias("size")).distinct()
    units = materialize(units, "quotes")
    body = rows.select("conv_id", "turn", "role", without_quotes(F.col("lines")).alias("body"), F.array_max(F.transform("lines", level_of)).cast("long").alias("quote_level"))
    slots = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    if units.isEmpty():
        slots = slots.select("conv_id", "turn", F.col("turn").alias("thread"))
        facts = positions(slots).withColumns({"depth": F.lit(0).cast("long"), "reply_to": F.lit(None).cast("long"), "n_passages": F.lit(0).cast("long"), "n_linked": F.lit(0).cast("long")})
    else:
        asked = units.select("conv_id").distinct()
        own = rows.where("turn is not null").join(asked, "conv_id", "left_semi")
        own = own.select("conv_id", "turn", F.explode(passages(F.col("lines"), F.lit(0))).alias("unit")).select("conv_id", "turn", F.md5("unit").alias("hash"))
        linked = materialize(latest_before(units, own, ["conv_id", "hash"]), "quote-links")
        votes = linked.groupBy("conv_id", "turn", "level", "source").agg(F.sum("size").alias("weight"))
        best = F.max(F.struct(-F.col("level"), F.col("weight"), F.col("source"))).alias("best")
        replies = votes.groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", F.col("best.source").alias("reply_to"))
        replies = materialize(replies, "quote-replies")
        counts = units.groupBy("conv_id", "turn").agg(F.count("*").alias("n_passages"))
        hits = linked.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"))
        roots = thread_roots(replies)
        known = slots.join(replies, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
        known = known.join(counts, ["conv_id", "turn"], "left").join(hits, ["conv_id", "turn"], "left")
        known = known.select("conv_id", "turn", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("n_passages", F.lit(0)).alias("n_passages"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
        known = materialize(known, "quote-slots", keep=True)
        facts = known.join(positions(known.select("conv_id", "turn", "thread")).drop("thread"), ["conv_id", "turn"])
    out = body.join(facts, ["conv_id", "turn"], "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_passages", "n_linked", "depth")}
    return out.withColumns(zero).select("conv_id", "turn", "role", "body", "quote_level", "n_passages", "n_linked", "reply_to", "thread", "depth", "position")


#: The same rows by DuckDB (one window per conversation, and a recursive query for the threads).
SQL = r"""
with recursive m as (
  select conv_id, turn, role, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) as lines from conversations
), g as (
  select *, list_transform(lines, lambda x: length(regexp_replace(regexp_extract(x, '^[ \t>]*>'), '[^>]', '', 'g'))) as levels from m
), u as (
  select conv_id, turn, level, unnest(list_distinct(list_transform(list_concat(regexp_split_to_array(array_to_string(own, chr(10)), '\n\s*\n'), own),
    lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))))) as unit
  from (select conv_id, turn, level, list_transform(list_zip(lines, levels), lambda x: case when x[2] = level then regexp_replace(x[1], '^[ \t>]*>', '') else '' end) as own
    from (select conv_id, turn, lines, levels, unnest(list_distinct(levels)) as level from g))
), p as (select distinct conv_id, turn, level, md5(unit) as hash, length(unit) as size from u where unit <> ''
), linked as (
  select q.conv_id, q.turn, q.level, q.hash, q.size, max(o.turn) as source
  from p q join p o on q.conv_id = o.conv_id and q.hash = o.hash and o.level = 0 and q.level > 0 and o.turn < q.turn group by all
), replies as (
  select conv_id, turn, arg_max(source, (-level, weight, source)) as reply_to
  from (select conv_id, turn, level, source, sum(size) as weight from linked group by all) group by all
), slots as (select distinct conv_id, turn from m where conv_id is not null and turn is not null
), climb as (
  select conv_id, turn, turn as thread, 0 as depth from slots
  union all
  select c.conv_id, c.turn, r.reply_to, c.depth + 1 from climb c join replies r on r.conv_id = c.conv_id and r.turn = c.thread
), roots as (select conv_id, turn, arg_max(thread, depth) as thread, max(depth) as depth from climb group by all
), facts as (
  select r.*, p.reply_to, row_number() over (partition by r.conv_id order by r.thread, r.turn) as position,
    (select count(*) from p where p.conv_id = r.conv_id and p.turn = r.turn and level > 0) as n_passages,
    (select count(*) from linked l where l.conv_id = r.conv_id and l.turn = r.turn) as n_linked
  from roots r left join replies p using (conv_id, turn)
)
select g.conv_id, g.turn, g.role,
  regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(list_zip(lines, levels, list_concat(levels[2:], [0]), range(len(lines))),
    lambda x: x[2] = 0 and not (coalesce(x[3], 0) > 0 and regexp_matches(x[1], '(?i)\bwrote:\s*$'))), lambda x: x[1]), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as body,
  cast(list_max(levels) as bigint) as quote_level, cast(coalesce(n_passages, 0) as bigint) as n_passages, cast(coalesce(n_linked, 0) as bigint) as n_linked,
  cast(reply_to as bigint) as reply_to, cast(thread as bigint) as thread, cast(coalesce(depth, 0) as bigint) as depth, cast(position as bigint) as position
from g left join facts f on f.conv_id = g.conv_id and f.turn = g.turn
"""
