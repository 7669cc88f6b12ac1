"""N-gram Jaccard join: a grouped prefix join over word shingles.

Shingles are ordered by how frequent their bucket is, rare ones first; two documents that are similar enough share one of
the first shingles of both (their prefixes). Documents with identical prefixes and size are one group, so a prefix shingle
lists groups; pairs of groups are filtered by size and position, and only then expand to members, whose whole sets are
compared. Documents with identical sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import bounded_batches, count_table, cut
from strandloom.operators.graph import connected_components
from strandloom.operators.joins import heavy_split_join
from strandloom.session import materialize, scratch

WORDS, PERCENT = 5, 80
#: Buckets of shingle frequencies (a fixed table; it sets the order of shingles, which affects speed, never the result),
#: and bits of the buckets of doc_id that tell which documents may have a candidate.
BUCKET_BITS, CANDIDATE_BITS = 22, 18
#: Steps of a frequency's rank per doubling: a 16-bit rank holds counts up to 2**64.
RANK_STEPS = 1000
#: Bits of a set's parity bitmap; two sets differ in at least as many shingles as their bitmaps in bits.
BITMAP = 1024
#: Lists of at most so many groups give all their pairs at once; longer ones are settled along their order first.
SHORT = 8
#: A list is dealt over blocks of about ``max(BLOCK, all shingles / 2**16)`` entries, an open one over cells of ``CELL`` members.
BLOCK, CELL = 256, 1024
#: Bytes of text that are hashed together (a longer text is hashed alone).
GROUP_BYTES = 1 << 18
#: Groups whose prefix a task remembers to have given (another time costs a duplicate, which is dropped).
SEEN = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
#: A random number for each byte, the same for a-z and A-Z.
_BYTE = np.random.default_rng(20240131).integers(0, 1 << 64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]


def _scatter(x: np.ndarray) -> np.ndarray:
    """Each number's pseudo-random image (a bijection); ``x`` is used up."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _chain(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the runs of ``words`` words."""
    s = h[: len(h) - words + 1] + np.uint64(words)
    for i in range(1, words):
        s = (s ^ (s >> np.uint64(29))) * _MIX + h[i : len(h) - words + 1 + i]
    return _scatter(s)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's runs of ``words`` words; of a shorter text, the whole sequence as one.

    A word's hash is the sum of one pseudo-random number for each (byte, place in the word), so no structure of the words
    makes two of them meet. Two sets of a million shingles share a hash by chance in 1 of 10**7 pairs.
    """
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(data):
        to, size = at, 0
        while to < len(data) and (to == at or size + len(data[to]) < GROUP_BYTES):
            size += len(data[to]) + 1
            to += 1
        yield from _group_sets(data[at:to], words)
        at = to


def _group_sets(data: list[bytes], words: int) -> Iterator[np.ndarray]:
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    white = _WHITE[raw]
    edge = np.flatnonzero(np.diff(white, prepend=True))
    begin, size = edge[::2], edge[1::2] - edge[::2]
    h = np.zeros(0, np.uint64)
    if len(begin):
        starts = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(starts, size)
        h = np.add.reduceat(_scatter(_BYTE[raw[~white]] + place.astype(np.uint64) * _MIX), starts)
        h = _scatter(h + size.astype(np.uint64) * _MIX)
    runs = _chain(h, words) if len(h) >= words else h
    first = np.searchsorted(begin, np.cumsum([0, *(len(d) + 1 for d in data)])).tolist()
    for a, b in zip(first, first[1:], strict=False):
        yield np.unique(runs[a : b - words + 1] if b - a >= words else _chain(h[a:b], b - a)) if b > a else np.zeros(0, np.uint64)


def prefix_size(n: int, percent: int) -> int:
    """Shingles that have to be looked at: a set of n with a similarity of ``percent`` to another shares one of them."""
    return n - -(-percent * n // 100) + 1


def _hash(data: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(data)


def _column(rows: list, kind=None) -> pa.Array:
    return pa.array(rows, kind or pa.int64())


def ranks(counts: np.ndarray) -> np.ndarray:
    """A 16-bit rank of each count, finer than a thousandth of its size, for counts up to 2**64."""
    return np.round(np.log2(counts + 1.0) * RANK_STEPS).astype(np.uint16)


def _summaries(docs: DataFrame, rank: np.ndarray, limit: int, words: int, percent: int) -> DataFrame:
    """(doc_id, n, sig, grp, bits, prefix, parts) by document; a task gives each group's prefix once.

    ``sig`` and ``grp`` are 128-bit hashes of the set and of size and prefix; ``parts`` are the blocks of each shingle's list.
    """
    sent = docs.sparkSession.sparkContext.broadcast(rank)
    shift = np.uint64(64 - BUCKET_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rank = set(), sent.value
        for b in cut(batches):
            n, sig, grp, bits, prefix, parts = [], [], [], [], [], []
            for s in shingle_sets(b.column(1).to_pylist(), words):
                n.append(len(s))
                if not len(s):
                    for c in (sig, grp, bits, prefix, parts):
                        c.append(None)
                    continue
                of = rank[s >> shift]
                first = np.argsort(of, kind="stable")[: prefix_size(len(s), percent)]
                size, head = len(s).to_bytes(8, "little"), s[first]
                g = _hash(size + head.tobytes())
                sig.append(_hash(size + s.tobytes())), grp.append(g)
                odd = np.bincount((s >> np.uint64(32)).astype(np.int64) % BITMAP, minlength=BITMAP) & 1
                bits.append(np.packbits(odd.astype(bool)).view(np.int64))
                new = g not in seen
                prefix.append(head.view(np.int64) if new else None)
                parts.append(np.ceil(np.exp2(of[first] / RANK_STEPS) / limit).astype(np.int64) if new else None)
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(g)
            longs, raw = pa.list_(pa.int64()), pa.binary()
            cols = [b.column(0), *(_column(c, k) for c, k in ((n, None), (sig, raw), (grp, raw), (bits, longs), (prefix, longs), (parts, longs)))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "sig", "grp", "bits", "prefix", "parts"])

    return docs.mapInArrow(run, "doc_id long, n long, sig binary, grp binary, bits array<long>, prefix array<long>, parts array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, data): the sets of the nodes (node, sig, doc), from the texts of their first documents.

    A broadcast table of at most ``1 << CANDIDATE_BITS`` marked buckets of doc_id keeps other texts from being cut or moved.
    """
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(1 << CANDIDATE_BITS)).cast("int")
    wanted = wanted.select("node", "sig", F.col("doc").alias("doc_id"))
    marked = wanted.select(place.alias("at")).distinct()
    rows = docs.withColumn("at", place).join(F.broadcast(marked), "at", "left_semi").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            ids, sig, data = [], [], []
            for doc_id, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist(), words), strict=True):
                if len(s):
                    ids.append(doc_id)
                    data.append(s.tobytes())
                    sig.append(_hash(len(s).to_bytes(8, "little") + data[-1]))
            yield pa.RecordBatch.from_arrays([_column(ids), _column(sig, pa.binary()), _column(data, pa.binary())], names=["doc_id", "sig", "data"])

    found = rows.mapInArrow(run, "doc_id long, sig binary, data binary").withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))
    wanted = wanted.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))
    return found.join(wanted, ["sig", "doc_id"]).select("node", "data").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(c), F.col("data").alias(d)) for c, d in (("a", "da"), ("b", "db")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "da", "db").mapInArrow(run, "a long, b long")


def _possible(shared, percent: int):
    """Whether groups of sizes n and n2 can be similar enough if they share at most ``shared`` prefix shingles.

    With sizes in proportion. All common shingles up to the end of the shorter-reaching prefix are in both prefixes; that
    group has ``n - prefix`` more shingles, so the overlap is at most ``shared`` plus the larger of those rests.
    """
    n, m = F.col("n"), F.col("n2")
    rest = F.ceil(F.greatest(n, m) * percent / 100) - 1
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * (shared + rest) >= percent * (n + m))


def _near(percent: int):
    """Whether groups can be similar enough if the shingle at pos and pos2 of their prefixes is the first that they share."""
    lo, hi, room = F.least("n", "n2"), F.greatest("n", "n2"), F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    return (100 * lo >= percent * hi) & ((100 + percent) * room >= percent * (F.col("n") + F.col("n2")))


def _alike(percent: int):
    """Whether sets of sizes n and n2 with the parity bitmaps bits and bits2 can be similar enough."""
    differ = F.aggregate(F.zip_with("bits", "bits2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, v: t + v)
    size = F.col("n") + F.col("n2")
    return (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & ((100 + percent) * (size - differ) >= 2 * percent * size)


def similar_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct runs of ``words`` words. Copies of
    a set are one node. Pairs of groups come from short lists at once; in long lists each group is first compared with the
    next, and each member with its group's first, which settles a group of near copies in as many comparisons as it has
    members. What is left, every pair that can be similar enough and whose components still differ, is then compared
    without exception, so no link between components is lost. Lists are dealt over blocks and cells, so that a shingle of
    all documents isn't one task's work.
    A null text, or one without words, has an empty set and links with nothing; a null doc_id is smaller than none; rows
    with equal doc_id are documents of their own; an empty table gives an empty result; other columns are left out.
    """
    bounded_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        return _joined(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), words, percent)


def _joined(docs: DataFrame, words: int, percent: int) -> DataFrame:

    def counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total, shift = np.zeros(1 << BUCKET_BITS, np.int64), np.uint64(64 - BUCKET_BITS)
        for b in cut(batches):
            found = [s >> shift for s in shingle_sets(b.column(0).to_pylist(), words)]
            at, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), 0)
            total[at] += n
        return total

    frequency = count_table(docs.select("text"), counts, 1 << BUCKET_BITS)
    limit = max(BLOCK, int(frequency.sum()) >> 16)
    rank = ranks(frequency)
    del frequency
    rows = materialize(_summaries(docs, rank, limit, words, percent), "shingle-docs", keep=True)
    sets = rows.where("sig is not null").groupBy("sig", "grp", "n").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("bits").alias("bits"))
    sets = materialize(sets.withColumn("node", F.monotonically_increasing_id()), "shingle-sets")  # node ids hold once they are written
    members = sets.groupBy("grp").agg(F.count("*").alias("members"))
    groups = rows.where("prefix is not null").select("grp", "n", "prefix", "parts").dropDuplicates(["grp"]).join(members, "grp")
    groups = materialize(groups.withColumn("g", F.monotonically_increasing_id()), "shingle-groups")
    nodes = heavy_split_join(sets, groups.select("grp", "g", "members"), "grp", "members", sets.count())
    nodes = materialize(nodes.select("node", "g", "n", "sig", "doc", "copies", "bits", "members"), "shingle-nodes")

    # Lists: shingle -> groups that have it in their prefix, of at least two groups (k of them), in blocks.
    in_block, by_shingle = Window.partitionBy("shingle", "block"), Window.partitionBy("shingle")
    lists = groups.select("g", "n", F.posexplode(F.arrays_zip("prefix", "parts")).alias("pos", "x"))
    lists = lists.select("g", "n", "pos", F.col("x.prefix").alias("shingle"), F.col("x.parts").alias("parts"))
    lists = lists.withColumn("block", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("g"), F.col("parts"))).otherwise(0))
    lists = lists.withColumn("k", F.count("*").over(in_block)).where("parts > 1 or k > 1")
    lists = materialize(lists.select("shingle", "block", "parts", "g", "n", "pos", "k"), "shingle-blocks")
    dealt = lists.where("parts > 1").drop("k")
    lengths = dealt.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1")
    dealt = heavy_split_join(dealt, lengths, "shingle", "k", dealt.count()).where("k is not null")
    lists = materialize(lists.where("parts = 1").unionByName(dealt).drop("parts"), "shingle-lists")
    long_lists = lists.where(F.col("k") > SHORT).drop("k")
    long_of = long_lists.groupBy("g").agg(F.count("*").alias("c"))

    # All pairs of groups in short lists; what they may share in long lists counts in their favour.
    short = lists.where(F.col("k") <= SHORT).groupBy("shingle").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("l"))
    short = short.select(F.posexplode("l").alias("i", "x"), "l").select("x", F.explode(F.slice("l", F.col("i") + 2, F.lit(SHORT))).alias("y"))
    short = short.select("x.g", "x.n", F.col("y.g").alias("g2"), F.col("y.n").alias("n2")).where(100 * F.col("n") >= percent * F.col("n2"))
    short = short.groupBy("g", "n", "g2", "n2").agg(F.count("*").alias("shared"))
    short = short.join(long_of, "g", "left").join(long_of.select(F.col("g").alias("g2"), F.col("c").alias("c2")), "g2", "left")
    in_long = F.least(F.coalesce("c", F.lit(0)), F.coalesce("c2", F.lit(0)))
    short = materialize(short.where(_possible(F.col("shared") + in_long, percent)).select("g", "g2"), "shingle-short")

    known: list[DataFrame] = []

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among the pairs (a < b) of nodes; sets that no earlier round needed are fetched."""
        pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "shingle-pairs")
        if pairs.isEmpty():
            return pairs
        asked = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "shingle-asked")
        need = asked
        for s in known:
            need = need.join(s.select("node"), "node", "left_anti")
        need = materialize(nodes.join(need, "node").select("node", "sig", "doc"), "shingle-need")
        if not need.isEmpty():
            known.append(materialize(_sets(docs, need, words), "shingle-data"))
        return _verified(pairs, reduce(DataFrame.union, known).join(asked, "node", "left_semi"), percent) if known else pairs

    def state(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Component of every node, and the first node and least and greatest component of every group's members."""
        named = nodes.join(parts, "node", "left").select("g", "node", "n", F.coalesce("component", "node").alias("part"))
        named = materialize(named, "shingle-parts")
        spans = named.groupBy("g").agg(F.min("node").alias("head"), F.min("part").alias("low"), F.max("part").alias("high"))
        return named, materialize(spans, "shingle-spans")

    def open_lists(spans: DataFrame) -> DataFrame:
        """Long lists whose groups aren't in one component yet."""
        both = materialize(long_lists.join(spans, "g"), "shingle-spans")
        ends = both.groupBy("shingle").agg(F.min("low").alias("l"), F.max("high").alias("h"), F.count("*").alias("k")).where("l <> h")
        return heavy_split_join(both, ends, "shingle", "k", both.count()).where("k is not null").drop("l", "h", "k")

    def along(entries: DataFrame, order: list[str], *cols: str) -> DataFrame:
        """Each group with the one before it in its block, and each block's first with that of the block before it."""

        def before(rows: DataFrame, window) -> DataFrame:
            pairs = rows.select(*cols, *(F.lag(c).over(window).alias(f"{c}2") for c in cols)).where(F.col(f"{cols[0]}2").isNotNull())
            return pairs.where(100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))

        firsts = entries.groupBy("shingle", "block").agg(F.min(F.struct(*dict.fromkeys([*order, *cols]))).alias("f"))
        firsts = firsts.select("shingle", "block", *(F.col(f"f.{c}").alias(c) for c in cols))
        return before(entries, in_block.orderBy(*order)).unionByName(before(firsts, by_shingle.orderBy("n", "block")))

    def facing(ends: DataFrame, pairs: DataFrame, *keys: str) -> DataFrame:
        """``pairs`` (of two keys) with what ``ends`` has of each end, the second's columns marked by a 2."""
        other = ends.select(*(F.col(c).alias(f"{c}2") for c in ends.columns))
        return pairs.join(ends, keys[0]).join(other, keys[1])

    # Round 1, by first members: pairs of short lists, neighbours in long ones; and each group's members with its first.
    firsts = nodes.groupBy("g", "n").agg(F.min(F.struct("node", "bits")).alias("f"))
    firsts = materialize(firsts.select("g", "n", F.col("f.node").alias("head"), F.col("f.bits").alias("bits")), "shingle-firsts")
    pairs = short.unionByName(along(long_lists, ["n", "g"], "g", "n").select("g", "g2").distinct())
    pairs = facing(firsts, pairs, "g", "g2").where(_alike(percent)).select(F.col("head").alias("a"), F.col("head2").alias("b"))
    many = nodes.where("members > 1").select("g", "node", "members")
    inside = heavy_split_join(many, firsts.select("g", "head").join(many.select("g", "members").distinct(), "g").withColumnRenamed("members", "_m"), "g", "_m", many.count())
    inside = inside.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    links = materialize(verified(pairs.unionByName(inside)), "shingle-links")

    # Round 2: neighbours of different components in the long lists, if there are any, that are still open.
    parts = connected_components(links)
    named, spans = state(parts)
    apart = ~((F.col("low") == F.col("high2")) & (F.col("high") == F.col("low2")))
    if not long_lists.isEmpty():
        pairs = along(open_lists(spans), ["low", "n", "g"], "head", "n", "low", "high").where(apart).select("head", "head2").distinct()
        pairs = facing(firsts.select("head", "n", "bits"), pairs, "head", "head2").where(_alike(percent))
        more = materialize(verified(pairs.select(F.col("head").alias("a"), F.col("head2").alias("b"))), "shingle-links")
        if not more.isEmpty():
            links = links.unionByName(more)
            parts = connected_components(links)
            named, spans = state(parts)

    # What is left, by members: every pair of different components that can be similar enough by its place in a long list
    # (or in a group, which counts as a list at place 0) and by its bitmaps; and the same for pairs of short lists.
    opened = open_lists(spans).select("shingle", F.lit(0).alias("kind"), "g", "pos")
    opened = opened.unionByName(spans.where("low <> high").select(F.col("g").alias("shingle"), F.lit(1).alias("kind"), "g", F.lit(0).alias("pos")))
    opened = opened.join(named, "g").select(F.struct("kind", "shingle").alias("list"), "pos", "n", "node", "part")
    opened = materialize(opened, "shingle-open")
    rest = facing(spans, short, "g", "g2").where(apart).select("g", "g2")
    rest = facing(named, rest, "g", "g2").where(F.col("part") != F.col("part2")).select("node", "node2")
    rest = facing(nodes.select("node", "n", "bits"), rest, "node", "node2").where(_alike(percent))
    pairs = rest.select(F.col("node").alias("a"), F.col("node2").alias("b"))
    if not opened.isEmpty():
        cells = opened.groupBy("list").agg(F.count("*").alias("k"), F.min("part").alias("l"), F.max("part").alias("h")).where("l <> h").drop("l", "h")
        opened = heavy_split_join(opened, cells, "list", "k", opened.count()).where("k is not null")
        opened = opened.withColumn("cells", F.ceil(F.col("k") / CELL)).withColumn("own", F.pmod(F.xxhash64("node"), F.col("cells")))
        opened = materialize(opened.drop("k").join(nodes.select("node", "bits"), "node"), "shingle-cells")
        one = opened.withColumns({"x": F.col("own"), "y": F.explode(F.sequence("own", F.col("cells") - 1))}).drop("cells", "own")
        two = opened.withColumns({"x": F.explode(F.sequence(F.lit(0).cast("long"), "own")), "y": F.col("own")})
        two = two.select("list", "x", "y", *(F.col(c).alias(f"{c}2") for c in ("pos", "n", "bits", "node", "part")))
        can = ((F.col("x") < F.col("y")) | (F.col("node") < F.col("node2"))) & (F.col("part") != F.col("part2")) & _near(percent) & _alike(percent)
        met = one.join(two, ["list", "x", "y"]).where(can).select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()
        pairs = pairs.unionByName(met)
    more = materialize(verified(pairs), "shingle-links")

    if not more.isEmpty():
        parts = connected_components(links.unionByName(more))
    told = materialize(nodes.join(parts, "node", "left").select("sig", "doc", "copies", F.coalesce("component", "node").alias("part")), "shingle-told")
    least = told.groupBy("part").agg(F.min("doc").alias("component_id"), F.count("*").alias("nodes"))
    told = heavy_split_join(told, least, "part", "nodes", told.count()).select("sig", "copies", "component_id")
    told = materialize(told, "shingle-told", keep=True)
    total = told.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    out = heavy_split_join(rows.select("doc_id", "n", "sig"), told, "sig", "copies", total)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
