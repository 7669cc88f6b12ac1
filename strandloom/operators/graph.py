"""Graph operators on edge tables: connected components by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.joins import heavy_from, heavy_split_join
from strandloom.session import materialize, scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """``(node, component)`` for every node of an edge, ``component`` being the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour, follows the pointer once more, and contracts the edges to the
    hooked nodes; a component is done when it has no edge left. Hooking is a ``min`` with map-side combine, and every look-up
    goes through ``heavy_split_join``, so neither a hub with any number of edges nor a giant component is gathered in a task.
    Every round is written to the shared folder, which keeps the lineage short and lets a lost executor be replaced. Self
    loops and null ends are ignored; an empty edge table gives an empty result.
    """
    with scratch(edges.sparkSession):
        return _components(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v"), max_rounds)


def _components(edges: DataFrame, max_rounds: int) -> DataFrame:
    e = materialize(edges.distinct(), "cc-edges")
    maps: list[DataFrame] = []
    for _ in range(max_rounds):
        left = e.count()
        if not left:
            break
        ends = e.select(F.col("u").alias("node"), F.col("v").alias("near"), F.lit(1).alias("low")).unionByName(
            e.select(F.col("v").alias("node"), F.col("u").alias("near"), F.lit(0).alias("low"))
        )
        hook = ends.groupBy("node").agg(F.min("near").alias("near"), F.sum("low").alias("n_u"), F.sum(1 - F.col("low")).alias("n_v"))
        hook = materialize(hook.select("node", F.least("node", "near").alias("up"), "n_u", "n_v"), "cc-hook")
        above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hook = materialize(_look_up(hook, above, "up").select("node", F.coalesce("top", "up").alias("up"), "n_u", "n_v"), "cc-up")
        pu = hook.where("n_u > 0").select(F.col("node").alias("u"), F.col("up").alias("pu"), "n_u")
        pv = hook.where("n_v > 0").select(F.col("node").alias("v"), F.col("up").alias("pv"), "n_v")
        e = heavy_split_join(e, pu, "u", "n_u", left).select("v", "pu")
        e = heavy_split_join(e, pv, "v", "n_v", left).where("pu <> pv")
        e = materialize(e.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "cc-edges")
        maps.append(hook.select("node", "up"))
    else:
        if not e.isEmpty():
            raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    if not maps:
        return materialize(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "cc-out", keep=True)
    out = maps[0].select("node", F.col("up").alias("component"))
    for k, m in enumerate(maps[1:], 2):
        step = m.select(F.col("node").alias("component"), F.col("up").alias("next"))
        out = _look_up(out, step, "component").select("node", F.coalesce("next", "component").alias("component"))
        out = materialize(out, "cc-out", keep=k == len(maps))
    return out if len(maps) > 1 else materialize(out, "cc-out", keep=True)


def _look_up(rows: DataFrame, unique: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` (a written table) with ``unique`` by ``key``; heavy keys, of which there are few, are counted first."""
    total = rows.count()
    heavy = rows.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") >= heavy_from(total))
    if total < heavy_from(total) or heavy.isEmpty():
        return rows.join(unique, key, "left")
    return heavy_split_join(rows, unique.join(F.broadcast(heavy), key, "left").fillna(0, "_rows"), key, "_rows", total)


def orient_components(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(component, node, orient, conflict): strand of each node relative to the smallest of its component.

    ``edges`` has (a, b, strand); ``-`` flips. A component whose edges contradict each other is marked and keeps the strands
    of the breadth-first walk.
    """
    import pandas as pd

    own = edges.join(parts.select(F.col("node").alias("a"), "component"), "a")

    def walk(key, pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b, s in zip(pdf["a"], pdf["b"], pdf["strand"], strict=True):
            flip = -1 if s == "-" else 1
            near.setdefault(a, []).append((b, flip))
            near.setdefault(b, []).append((a, flip))
        first = min(near)
        sign, queue, conflict = {first: 1}, [first], False
        for x in queue:
            for y, flip in sorted(near[x]):
                if y not in sign:
                    sign[y] = sign[x] * flip
                    queue.append(y)
                conflict |= sign[y] != sign[x] * flip
        return pd.DataFrame({"component": [key[0]] * len(sign), "node": list(sign), "orient": ["+" if v > 0 else "-" for v in sign.values()], "conflict": [conflict] * len(sign)})

    return own.groupBy("component").applyInPandas(walk, "component long, node long, orient string, conflict boolean")


def grow_cliques(edges: DataFrame, size: int, duplicate: float = 99.95) -> DataFrame:
    """(seed, pos, member): around every node that has ``size - 1`` neighbours, a clique grown greedily.

    ``edges`` has (a, b, weight) once per pair, and ``lineage_a``, ``lineage_b`` (nullable). A candidate is adjacent to all
    members; one of a lineage not seen yet comes first, then an unlabelled one that duplicates nobody, then any other;
    of those the one with the largest minimal weight, then the smallest id. A seed's neighbourhood is one group.
    """
    import pandas as pd

    both = edges.select("a", "b", "weight", F.col("lineage_b").alias("lineage")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight", F.col("lineage_a").alias("lineage")))
    star = both.select(F.col("a").alias("seed"), F.col("b").alias("x"), F.col("weight").alias("to_seed"), "lineage")
    inner = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("weight").alias("w"))
    pairs = star.select("seed", "x").join(inner, "x").join(star.select("seed", F.col("x").alias("y")), ["seed", "y"])
    pairs = pairs.select("seed", "x", "y", "w").toDF("seed", "x", "y", "w")
    star = star.toDF(*star.columns)
    schema = "seed long, pos int, member long"

    def grow(key, near: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        seed = int(key[0])
        if len(near) < size - 1:
            return pd.DataFrame({"seed": [], "pos": [], "member": []})
        to_seed, lineage = dict(zip(near["x"], near["to_seed"], strict=True)), dict(zip(near["x"], near["lineage"], strict=True))
        weight = {}
        for x, y, w in zip(links["x"], links["y"], links["w"], strict=True):
            weight[x, y] = weight[y, x] = w
        members, seen, pool = [seed], set(), set(to_seed)
        while len(members) < size and pool:
            def rank(c):
                ws = [to_seed[c], *(weight[c, m] for m in members[1:])]
                known = lineage[c] is not None and lineage[c] == lineage[c]
                tier = 0 if known and lineage[c] not in seen else 1 if not known and max(ws) < duplicate else 2
                return tier, -min(ws), c

            best = min(pool, key=rank)
            members.append(best)
            seen.add(lineage[best])
            pool = {c for c in pool if c != best and (c, best) in weight}
        return pd.DataFrame({"seed": [seed] * len(members), "pos": range(len(members)), "member": members})

    return star.groupBy("seed").cogroup(pairs.groupBy("seed")).applyInPandas(grow, schema)
