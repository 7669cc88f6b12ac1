"""Trees as tables of nodes: parsimony by folds of bit sets up the levels, the ancestor of a set of leaves, and why it isn't one
lineage; and the choice of a clade by its distance to what lies outside."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import verdicts
from strandloom.session import materialize

_TOKEN = re.compile(r"\s*([(),;]|'(?:[^']|'')*'|[^\s(),:;]+|:\s*[^\s(),;]+)")


def newick_nodes(text: str) -> list[dict]:
    """The nodes of a tree in parentheses: (node, parent, depth, last, name, is_leaf, support), numbered from the root in the
    order of a walk, so the nodes below one are those from its number to ``last``.

    The support of an inner node is its label, or what stands behind the last slash of it. Branch lengths are left out.
    """
    nodes: list[dict] = []
    path: list[int] = []

    def new() -> int:
        nodes.append({"node": len(nodes), "parent": path[-1] if path else None, "depth": len(path), "last": len(nodes), "name": None, "is_leaf": True, "support": None})
        return len(nodes) - 1

    at = new()
    for token in _TOKEN.findall(text or ""):
        if token == "(":
            nodes[at]["is_leaf"] = False
            path.append(at)
            at = new()
        elif token == ",":
            at = new()
        elif token == ")":
            at = path.pop()
            nodes[at]["last"] = len(nodes) - 1
        elif token == ";":
            break
        elif not token.startswith(":"):
            name = token[1:-1].replace("''", "'") if token.startswith("'") else token
            nodes[at]["name"] = name
            if not nodes[at]["is_leaf"]:
                try:
                    nodes[at]["support"] = float(name.rsplit("/", 1)[-1])
                except ValueError:
                    pass
    return nodes if (text or "").strip() else []


def tree_nodes(trees: DataFrame, tree: str = "tree", text: str = "newick") -> DataFrame:
    """(tree, node, parent, depth, last, name, is_leaf, support) of every tree; a null or empty text has no node."""
    kind = trees.schema[tree].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for name, s in zip(d["tree"], d["text"], strict=True):
                rows = pd.DataFrame(newick_nodes(s), columns=["node", "parent", "depth", "last", "name", "is_leaf", "support"])
                yield rows.astype({"parent": "Int64", "support": "Float64"}).assign(tree=name)

    shape = f"node long, parent long, depth long, last long, name string, is_leaf boolean, support double, tree {kind}"
    return trees.select(F.col(tree).alias("tree"), F.col(text).alias("text")).mapInPandas(run, shape)


def fitch_up(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """``nodes`` with (states, n_focal, n_leaves): the set of states of each node by parsimony on a rooted tree.

    ``states`` has (tree, name, state, focal). A leaf has its state, or if it is unknown every state of its tree; a node has
    the states that all its children share, or if there are none, those of any. States of a tree are bits of a number (62
    at most, else it fails), and each level of all trees is one aggregate. ``n_focal`` counts the focal leaves below.
    """
    known = states.where("state is not null").select("tree", "state").distinct()
    alphabet = known.groupBy("tree").agg(F.array_sort(F.collect_list("state")).alias("alphabet"))
    if alphabet.where(F.size("alphabet") > 62).count():
        raise ValueError("a tree has more than 62 states")
    leaves = nodes.where("is_leaf").join(states.select("tree", "name", "state", "focal"), ["tree", "name"], "left").join(alphabet, "tree", "left")
    every = F.call_function("shiftleft", F.lit(1).cast("long"), F.coalesce(F.array_size("alphabet"), F.lit(0))) - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.array_position("alphabet", F.col("state")) - 1).cast("int"))
    done = leaves.select("tree", "node", "parent", "depth", F.coalesce(F.when(F.col("state").isNotNull(), bit), every).alias("bits"), F.coalesce("focal", F.lit(False)).cast("long").alias("n_focal"), F.lit(1).cast("long").alias("n_leaves"))
    done = materialize(done, "fitch-leaves")
    inner = materialize(nodes.where("not is_leaf").select("tree", "node", "parent", "depth"), "fitch-inner")
    top = inner.agg(F.max("depth")).first()[0]
    parts, below = [done], done
    for depth in range(-1 if top is None else top, -1, -1):
        kids = below.where(F.col("depth") == depth + 1).groupBy("tree", F.col("parent").alias("node"))
        both = kids.agg(F.bit_and("bits").alias("shared"), F.bit_or("bits").alias("any"), F.sum("n_focal").alias("n_focal"), F.sum("n_leaves").alias("n_leaves"))
        level = inner.where(F.col("depth") == depth).join(both, ["tree", "node"])
        level = materialize(level.select("tree", "node", "parent", "depth", F.when(F.col("shared") != 0, F.col("shared")).otherwise(F.col("any")).alias("bits"), "n_focal", "n_leaves"), "fitch-level")
        parts.append(level)
        below = level.unionByName(done.where(F.col("depth") == depth))
    told = parts[0]
    for p in parts[1:]:
        told = told.unionByName(p)
    out = nodes.join(told.select("tree", "node", "bits", "n_focal", "n_leaves"), ["tree", "node"]).join(alphabet, "tree", "left")
    picked = F.filter(F.coalesce("alphabet", F.array().cast("array<string>")), lambda s, i: F.call_function("shiftright", F.col("bits"), i.cast("int")).bitwiseAND(1) == 1)
    return out.withColumn("states", picked).drop("bits", "alphabet")


def focal_ancestor(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """GR10: (tree, states, mono, strict_mono, intruders, outgroup_intruders, support) at the last common ancestor of each
    tree's focal leaves.

    ``states`` has (tree, name, state, focal, outgroup). Intruders are leaves below the ancestor that aren't focal; the clade is one
    lineage (``mono``) unless one of them is an outgroup, and strictly so without any. A tree with fewer than two focal
    leaves has no ancestor: null states, not one lineage.
    """
    told = materialize(fitch_up(nodes, states), "fitch")
    total = told.where("node = 0").select("tree", F.col("n_focal").alias("n_present"))
    whole = told.join(total, "tree").where("n_present >= 2 and n_focal = n_present")
    mrca = whole.groupBy("tree").agg(F.max_by(F.struct("node", "last", "states", "support"), "depth").alias("m")).select("tree", "m.*")
    leaves = told.where("is_leaf").select("tree", F.col("node").alias("leaf"), "name").join(states.select("tree", "name", "focal", "outgroup"), ["tree", "name"], "left")
    under = mrca.join(leaves, "tree").where((F.col("leaf") >= F.col("node")) & (F.col("leaf") <= F.col("last")) & ~F.coalesce("focal", F.lit(False)))
    odd = under.groupBy("tree").agg(F.array_sort(F.collect_set("name")).alias("intruders"), F.array_sort(F.collect_set(F.when(F.col("outgroup"), F.col("name")))).alias("outgroup_intruders"))
    out = total.join(mrca.drop("node", "last"), "tree", "left").join(odd, "tree", "left")
    nothing = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, nothing) for c in ("intruders", "outgroup_intruders")})
    found = F.col("states").isNotNull()
    return out.select("tree", "states", (found & (F.size("outgroup_intruders") == 0)).alias("mono"), (found & (F.size("intruders") == 0)).alias("strict_mono"), "intruders", "outgroup_intruders", "support")


def monophyly_class(left: DataFrame, right: DataFrame, whole: DataFrame, locus: str = "locus", min_support: float = 70.0) -> DataFrame:
    """(locus, class): why the focal clade of a locus isn't one lineage, from the ancestors of its left, right and joint trees.

    none; concat_only (either side has it, the joint tree hasn't); low_support (no support reaches ``min_support``); left_only and
    right_only (that side alone lacks it); bilateral, with the same intruder on both sides or not; other. The tables have (locus, mono, intruders,
    support).
    """
    sides = [t.select(locus, F.col("mono").alias(f"m{n}"), F.col("support").alias(f"s{n}"), F.col("intruders").alias(f"i{n}")) for n, t in enumerate((left, right, whole))]
    t = sides[0].join(sides[1], locus).join(sides[2], locus)
    best = F.array_max(F.array("s0", "s1", "s2"))
    kind = verdicts.cascade(
        (F.col("m0") & F.col("m1") & F.col("m2"), "none"), (F.col("m0") & F.col("m1"), "concat_only"), (F.coalesce(best < min_support, F.lit(False)), "low_support"),
        (~F.col("m0") & F.col("m1"), "left_only"), (F.col("m0") & ~F.col("m1"), "right_only"),
        (F.arrays_overlap("i0", "i1"), "bilateral_same_lineage"), default="bilateral_different_lineages",
    )
    return t.select(locus, kind.alias("class"))


# -- a clade by its gap ---------------------------------------------------------------------------------------------------


def best_gap_clade(pairs: DataFrame, members: DataFrame, by: str = "cluster", floor: float = 99.5, least_floor: float = 99.0, relax: float = 0.25, gap: float = 0.3, least: int = 3, most_members: int = 20) -> DataFrame:
    """GR4: (by, focal, excluded, floor, closest, gap, met): the subset of each cluster that stands out most from the rest.

    ``pairs`` has (by, a, b, ani) within a cluster, ``members`` (by, member, closest), the nearest one outside (null: none). Of all subsets of at least ``least`` members
    whose pairs all reach the floor, that with the largest gap between its lowest pair and its nearest outside is chosen, then the largest, then
    the first by names; if it misses ``gap``, the floor is lowered by ``relax`` down to ``least_floor``. Where none ever reaches it, the
    best of the first floor that had any is given, with ``met`` false; a cluster without any has an empty one. Pairs without a value don't count.

    A subset's lowest pair is that of the subset without its last member, or one of that member's: one NumPy pass over all
    subsets. They are enumerated, as the definition asks, so a cluster of more than ``most_members`` fails.
    """
    kind, name = members.schema[by].dataType.simpleString(), members.schema["member"].dataType.simpleString()
    shape = f"`{by}` {kind}, focal array<{name}>, excluded array<{name}>, floor double, closest double, gap double, met boolean"

    def run(key, own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("member")
        names, n = own["member"].tolist(), len(own)
        if n > most_members:
            raise ValueError(f"a cluster of {n} members has too many subsets")
        at = {m: k for k, m in enumerate(names)}
        ani = np.full((n, n), np.inf)
        for a, b, v in zip(near["a"], near["b"], near["ani"], strict=True):
            if a in at and b in at and a != b and v == v and v is not None:
                ani[at[a], at[b]] = ani[at[b], at[a]] = v
        outside = own["closest"].astype(float).fillna(0.0).to_numpy()
        low, far, size = np.full(1 << n, np.inf), np.zeros(1 << n), np.zeros(1 << n, np.int64)
        for k in range(n):  # subsets whose last member is k
            bit = 1 << k
            mine = np.full(bit, np.inf)
            for j in range(k):
                mine[1 << j : 2 << j] = np.minimum(mine[: 1 << j], ani[k, j])
            low[bit : 2 * bit] = np.minimum(low[:bit], mine)
            far[bit : 2 * bit] = np.maximum(far[:bit], outside[k])
            size[bit : 2 * bit] = size[:bit] + 1
        picked, met, at_floor = None, False, floor
        fine = np.flatnonzero((size >= least) & np.isfinite(low))
        first = np.array([sum(1 << (n - 1 - k) for k in range(n) if s >> k & 1) for s in fine.tolist()], np.int64)  # larger: earlier by names
        order = fine[np.lexsort((-first, -size[fine], -(low[fine] - far[fine])))]
        while at_floor >= least_floor and not met:
            good = order[low[order] >= at_floor]
            if len(good):
                met = bool(low[good[0]] - far[good[0]] >= gap)
                picked = good[0] if met or picked is None else picked
            at_floor -= relax
        if picked is None:
            return pd.DataFrame({by: [key[0]], "focal": [[]], "excluded": [names], "floor": [None], "closest": [None], "gap": [None], "met": [False]})
        focal = [m for k, m in enumerate(names) if int(picked) >> k & 1]
        return pd.DataFrame({by: [key[0]], "focal": [focal], "excluded": [[m for m in names if m not in focal]], "floor": [low[picked]], "closest": [far[picked]], "gap": [low[picked] - far[picked]], "met": [met]})

    return members.groupBy(by).cogroup(pairs.groupBy(by)).applyInPandas(run, shape)
