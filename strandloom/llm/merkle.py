"""A Merkle manifest of a table: digests of rows, a tree for each group of rows, a root, and a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.joins import heavy_split_join
from strandloom.operators.ranking import dense_ids
from strandloom.session import materialize, scratch

#: Children of a node, and levels that one bucket collapses: a bucket has ``FANOUT ** LEVELS`` nodes.
FANOUT, LEVELS = 16, 3


def digest(text: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of a text in UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def record_digest(*values: Column) -> Column:
    """Digest of a row: each value as ``<bytes in UTF-8>:<value>``, a null as ``-``, one after the other."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def proof_digest(before: Column, after: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return digest(F.array_join(F.zip_with(before, after, lambda b, a: F.concat(b, a)), ""))


def fold(leaf: Column, before: Column, after: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(F.arrays_zip(before.alias("before"), after.alias("after")), leaf, lambda d, p: digest(F.concat(p["before"], d, p["after"])))


# -- one superblock of levels -----------------------------------------------------------------------------------------


def climb(digests: Sequence[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of a bucket on each level, from its own up to its root."""
    out = [list(digests)]
    for _ in range(levels):
        low = out[-1]
        out.append([hashlib.sha256("".join(low[k : k + fanout]).encode()).hexdigest() for k in range(0, len(low), fanout)])
    return out


def paths(levels: list[list[str]], fanout: int) -> list[tuple[list[str], list[str]]]:
    """For each node of the lowest level, what stands before and after it (or after its ancestor) in its run, on every level."""
    pairs = []
    for nodes in levels[:-1]:
        runs = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
        pairs.append([("".join(r[:p]), "".join(r[p + 1 :])) for r in runs for p in range(len(r))])
    out = []
    for at in range(len(levels[0])):
        steps = []
        for p in pairs:
            steps.append(p[at])
            at //= fanout
        out.append(([b for b, _ in steps], [a for _, a in steps]))
    return out


def _bucketed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` (tree, at, size, node) with their bucket, the levels it collapses, and the group ``u1, u2`` that computes it.

    Trees of more than one bucket have a group for each bucket; smaller ones share groups of about a bucket's size.
    """
    span = fanout**levels
    units = F.lit(max(1, -(-nodes.count() // span)))
    large = F.col("size") > span
    up = sum((F.col("size") > fanout**k).cast("int") for k in range(levels))
    return nodes.select(
        *nodes.columns, F.expr(f"at div {span}").alias("bucket"), up.alias("up"),
        F.when(large, F.col("tree")).otherwise(F.pmod(F.xxhash64("tree"), units)).alias("u1"), F.when(large, F.expr(f"at div {span}")).otherwise(F.lit(-1)).cast("long").alias("u2"),
    )


def _reduce(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """``nodes`` and the roots of their buckets, of the buckets of these, and so on until each tree is one node.

    The collapse of a bucket is one call; each round has ``fanout ** levels`` times fewer rows and is written.
    """
    span, out = fanout**levels, []

    def collapse(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for (tree, bucket), part in pdf.groupby(["tree", "bucket"]):
            part = part.sort_values("at")
            rows.append((tree, bucket, -(-int(part["size"].iloc[0]) // span), climb(part["node"].tolist(), int(part["up"].iloc[0]), fanout)[-1][0], *key))
        return pd.DataFrame(rows, columns=["tree", "at", "size", "node", "d1", "d2"])

    while True:
        nodes = _bucketed(nodes, fanout, levels)
        out.append(nodes)
        roots = nodes.select("tree", "at", "size", "node", "bucket", "up", "u1", "u2").groupBy("u1", "u2").applyInPandas(collapse, "tree long, at long, size long, node string, d1 long, d2 long")
        nodes = materialize(roots, "merkle-roots")
        if (nodes.agg(F.max("size")).first()[0] or 1) <= 1:
            return [*out, nodes]


def _joiner(carried: list[str], last: list[str], fanout: int):
    """The function that puts the proofs of a group of buckets before those of their roots; it keeps some columns of either side."""

    def join(low: pa.Table, high: pa.Table) -> pa.Table:
        if not low.num_rows:
            return pa.table({c: low.column(c) for c in carried} | {c: high.column(c).slice(0, 0) for c in last} | {c: pa.array([], pa.list_(pa.string())) for c in ("before", "after")})
        low = low.sort_by([("tree", "ascending"), ("at", "ascending")])
        found = {(t, a): k for k, (t, a) in enumerate(zip(high.column("tree").to_pylist(), high.column("at").to_pylist(), strict=True))}
        tree, bucket, up, node = (low.column(c).to_pylist() for c in ("tree", "bucket", "up", "node"))
        ups = list(zip(high.column("before").to_pylist(), high.column("after").to_pylist(), strict=True))
        before, after, of, begin = [], [], [], 0
        while begin < len(tree):
            end = begin
            while end < len(tree) and (tree[end], bucket[end]) == (tree[begin], bucket[begin]):
                end += 1
            k = found[tree[begin], bucket[begin]]
            for b, a in paths(climb(node[begin:end], up[begin], fanout), fanout):
                before.append(b + ups[k][0])
                after.append(a + ups[k][1])
            of += [k] * (end - begin)
            begin = end
        whole = high.take(pa.array(of, pa.int64()))
        out = {c: low.column(c) for c in carried} | {c: whole.column(c) for c in last}
        return pa.table(out | {"before": pa.array(before, pa.list_(pa.string())), "after": pa.array(after, pa.list_(pa.string()))})

    return join


def _descend(below: list[DataFrame], top: DataFrame, fanout: int, keep: bool = False) -> DataFrame:
    """Proofs of the lowest nodes: that of a node in its bucket, followed by that of the bucket's root.

    ``top`` has (tree, at, before, after, more) and the group (d1, d2) of the nodes below each of its rows. Lower and upper proofs meet in
    the group that computes the bucket, so only one upper proof a bucket is ever moved. ``keep`` is for a lazy result that
    outlives the scratch around it.
    """
    upper = top
    for k, nodes in reversed(list(enumerate(below))):
        carried = ["tree", "at", "d1", "d2"] if k else [c for c in nodes.columns if c not in ("bucket", "up", "u1", "u2", "size", "d1", "d2")]
        last = [f for f in upper.schema.fields if f.name not in ("tree", "at", "before", "after", "d1", "d2")]
        types = [f"`{f.name}` {f.dataType.simpleString()}" for f in (*(nodes.schema[c] for c in carried), *last)]
        upper = nodes.groupBy("u1", "u2").cogroup(upper.groupBy("d1", "d2")).applyInArrow(_joiner(carried, [f.name for f in last], fanout), ", ".join(types) + ", before array<string>, after array<string>")
        if k:
            upper = materialize(upper, "merkle-proofs", keep=keep and k == 1)
    return upper


# -- the manifest -----------------------------------------------------------------------------------------------------


def manifest(rows: DataFrame, leaf: Column, tree_col: str = "source", id_col: str = "doc_id", keep: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(id, tree, leaf, subroot, root, before, after) of every row, and the columns ``keep``.

    Rows with one value of ``tree_col`` are a tree, its leaves in the order of ``id_col``: every ``fanout`` consecutive
    nodes (fewer in the last run) become their digest while there are several. The subroots, by value (null first, then by
    bytes), are the leaves of the root's tree in the same way. ``before`` and ``after`` are the proof: for each level up to
    the root the digests on either side in the run. ``fold(leaf, before, after)`` is the root.

    Leaves are dealt by range and numbered by partition sizes, whatever tree they are in, so a tree with any part of all
    rows is spread; a group collapses ``levels`` levels of ``fanout ** levels`` leaves, and the roots of these buckets are
    reduced in the same way. Proofs are put together on the way down, one bucket at a time.

    A null id comes first in its tree; rows with equal ids stand in the order of their leaves; equal rows are leaves of their
    own. One row alone is its own root with an empty proof; an empty table gives an empty result; other columns are left out.
    """
    with scratch(rows.sparkSession):
        return _manifest(rows.select(F.col(id_col).alias("id"), F.col(tree_col).cast("string").alias("name"), leaf.alias("leaf"), *(c.alias(f"keep_{n}") for n, c in (keep or {}).items())), tree_col, id_col, tuple(keep or ()), fanout, levels)


def _manifest(rows: DataFrame, tree_col: str, id_col: str, keep: tuple[str, ...], fanout: int, levels: int) -> DataFrame:
    leaves = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    order = ["name", "id", "leaf", "row"]
    dealt = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("no", F.monotonically_increasing_id())
    dealt = materialize(dealt.drop("row").withColumn("part", F.shiftright("no", 33)), "merkle-dealt")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # one row for each partition
    ends, total = [], 0
    for r in sizes:
        ends.append((r["part"], total))
        total += r["n"]
    offsets = rows.sparkSession.createDataFrame(ends, "part long, offset long")
    key = F.coalesce(F.concat(F.lit("="), F.col("name")), F.lit("-"))
    dealt = dealt.join(F.broadcast(offsets), "part").select("id", "name", "leaf", *(f"keep_{c}" for c in keep), key.alias("key"), (F.col("no").bitwiseAND((1 << 33) - 1) + F.col("offset")).alias("no"))
    trees = materialize(dealt.groupBy("key").agg(F.min("no").alias("start"), F.count("*").alias("size")), "merkle-trees")
    trees = materialize(dense_ids(trees, ["start"], "tree"), "merkle-order")
    nodes = heavy_split_join(dealt, trees, "key", "size", total)
    nodes = nodes.select("tree", (F.col("no") - F.col("start")).alias("at"), "size", F.col("leaf").alias("node"), "id", "name", *(f"keep_{c}" for c in keep))
    *below, tops = _reduce(materialize(nodes, "merkle-nodes", keep=True), fanout, levels)
    subroots = materialize(tops.select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("at"), "node", "d1", "d2", F.lit(trees.count()).cast("long").alias("size")), "merkle-subroots")
    *above, top = _reduce(subroots, fanout, levels)
    nothing = F.array().cast("array<string>")
    top = top.select("tree", "at", F.col("node").alias("root"), "d1", "d2", nothing.alias("before"), nothing.alias("after"))
    above[0] = above[0].select("tree", "at", "bucket", "up", "u1", "u2", "size", "node", F.col("d1").alias("l1"), F.col("d2").alias("l2"))
    upper = _descend(above, top, fanout).select((F.col("at") + 1).alias("tree"), F.lit(0).cast("long").alias("at"), F.col("node").alias("subroot"), "root", F.col("l1").alias("d1"), F.col("l2").alias("d2"), "before", "after")
    out = _descend(below, materialize(upper, "merkle-upper", keep=True), fanout, keep=True)
    return out.select(F.col("id").alias(id_col), F.col("name").alias(tree_col), F.col("node").alias("leaf"), "subroot", "root", "before", "after", *(F.col(f"keep_{c}").alias(c) for c in keep))
