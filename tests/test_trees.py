"""Parsimony, common ancestors and clades against plain recursions over random trees and subsets."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from strandloom.operators import trees as t


def random_tree(r, names):
    """Nested lists, each with a support."""
    if len(names) == 1:
        return names[0]
    cuts = sorted(r.sample(range(1, len(names)), min(len(names) - 1, r.choice([1, 1, 2]))))
    parts = [names[a:b] for a, b in zip([0, *cuts], [*cuts, len(names)])]
    return [random_tree(r, p) for p in parts], r.choice([None, 55.0, 90.0])


def text(tree):
    if isinstance(tree, str):
        return f"'{tree}':0.1" if " " in tree else f"{tree}:0.2"
    kids, support = tree
    return "(" + ",".join(map(text, kids)) + ")" + ("" if support is None else f"80/{support}:0.3")


def leaves(tree):
    return [tree] if isinstance(tree, str) else [x for k in tree[0] for x in leaves(k)]


def fold(tree, states, alphabet):
    if isinstance(tree, str):
        return {states[tree]} if states.get(tree) else set(alphabet)
    sets = [fold(k, states, alphabet) for k in tree[0]]
    return set.intersection(*sets) or set.union(*sets)


def ancestor(tree, focal):
    if not isinstance(tree, str):
        for k in tree[0]:
            if focal <= set(leaves(k)):
                return ancestor(k, focal)
    return tree


def test_ancestors_of_random_trees(spark):
    r = random.Random(3)
    texts, rows, want = [], [], {}
    for n in range(60):
        names = [f"g {k}" if k % 4 == 0 else f"g{k}" for k in range(r.randrange(2, 14))]
        tree = random_tree(r, names)
        states = {x: r.choice(["a", "b", "c", None]) for x in names}
        focal = set(r.sample(names, r.randrange(0, len(names) + 1)))
        out = {x for x in names if x not in focal and r.random() < 0.4}
        texts.append((n, text(tree) + ";"))
        rows += [(n, x, states[x], x in focal, x in out) for x in names if states[x] or x in focal or x in out]
        rows.append((n, "not in the tree", None, True, False))
        alphabet = {s for s in states.values() if s}
        if len(focal) < 2:
            want[n] = (None, False, False, [], [], None)
        else:
            m = ancestor(tree, focal)
            intr = sorted(set(leaves(m)) - focal)
            want[n] = (sorted(fold(m, states, alphabet)), not set(intr) & out, not intr, intr, sorted(set(intr) & out), None if isinstance(m, str) else m[1])
    nodes = t.tree_nodes(spark.createDataFrame(texts, "tree long, newick string"))
    states = spark.createDataFrame(rows, "tree long, name string, state string, focal boolean, outgroup boolean")
    got = {x["tree"]: tuple(x)[1:] for x in t.focal_ancestor(nodes, states).collect()}
    assert {k: (v[0] if v[0] is None else sorted(v[0]), *v[1:]) for k, v in got.items()} == want


def test_nodes_of_odd_texts(spark):
    assert t.newick_nodes("") == t.newick_nodes(None) == []
    one = t.newick_nodes("only;")
    assert len(one) == 1 and one[0]["is_leaf"] and one[0]["name"] == "only"
    nodes = t.newick_nodes("((a:1,'b c''d':2)95:0.1,c)root;")
    assert [(x["name"], x["parent"], x["last"], x["support"]) for x in nodes] == [("root", None, 4, None), ("95", 0, 3, 95.0), ("a", 1, 2, None), ("b c'd", 1, 3, None), ("c", 0, 4, None)]
    assert t.tree_nodes(spark.createDataFrame([(1, None), (2, "")], "tree long, newick string")).count() == 0


CASES = [
    ((True, True, True), ([], []), (90, 90, 90), "none"), ((True, True, False), ([], []), (10, 10, 10), "concat_only"), ((False, True, False), (["x"], []), (10, 20, None), "low_support"),
    ((False, True, True), (["x"], []), (90, 20, None), "left_only"), ((True, False, True), ([], ["x"]), (None, None, None), "right_only"),
    ((False, False, True), (["x", "y"], ["y"]), (90, 90, 90), "bilateral_same_lineage"), ((False, False, False), (["x"], ["y"]), (None, None, 90), "bilateral_different_lineages"),
]


def test_monophyly_classes(spark):
    tables = []
    for side in range(3):
        rows = [(n, mono[side], intr[side] if side < 2 else [], float(sup[side]) if sup[side] is not None else None) for n, (mono, intr, sup, _) in enumerate(CASES)]
        tables.append(spark.createDataFrame(rows, "locus long, mono boolean, intruders array<string>, support double"))
    assert {x["locus"]: x["class"] for x in t.monophyly_class(*tables).collect()} == {n: c[3] for n, c in enumerate(CASES)}


def brute_clade(members, ani, closest, floor=99.5, least_floor=99.0, relax=0.25, gap=0.3, least=3):
    best = None
    while floor >= least_floor:
        found = []
        for k in range(len(members), least - 1, -1):
            for sub in combinations(members, k):
                known = [ani[p] for p in combinations(sub, 2) if p in ani]
                if known and min(known) >= floor:
                    far = max(closest[m] or 0.0 for m in sub)
                    found.append((min(known) - far, k, sub, min(known), far))
        found.sort(key=lambda c: (-c[0], -c[1]))
        if found and found[0][0] >= gap:
            return (*found[0][2:], True)
        best = best or (found[0] if found else None)
        floor -= relax
    return (*best[2:], False) if best else ((), None, None, False)


def test_best_gap_clades_against_all_subsets(spark):
    r = random.Random(5)
    pairs, members, want = [], [], {}
    for c in range(25):
        names = [f"m{k}" for k in range(r.randrange(2, 9))]
        level = r.choice([98.0, 99.2, 99.6])
        ani = {p: round(level + r.random() * 0.6, 2) for p in combinations(names, 2) if r.random() < 0.9}
        closest = {m: r.choice([None, 98.0, 99.0, 99.4]) for m in names}
        pairs += [(c, *(p if r.random() < 0.5 else p[::-1]), v) for p, v in ani.items()]
        members += [(c, m, closest[m]) for m in names]
        want[c] = brute_clade(names, ani, closest)
    got = t.best_gap_clade(spark.createDataFrame(pairs, "cluster long, a string, b string, ani double"), spark.createDataFrame(members, "cluster long, member string, closest double"))
    rows = {x["cluster"]: x for x in got.collect()}
    assert {c: (tuple(x["focal"]), x["floor"], x["closest"], x["met"]) for c, x in rows.items()} == want
    assert {w[3] for w in want.values()} == {True, False} and any(not w[0] for w in want.values())
    assert all(sorted(x["focal"] + x["excluded"]) == sorted(m for k, m, _ in members if k == c) for c, x in rows.items())


def test_a_cluster_too_large_fails(spark):
    members = spark.createDataFrame([(1, f"m{k}", None) for k in range(9)], "cluster long, member string, closest double")
    with pytest.raises(Exception, match="too many subsets"):
        t.best_gap_clade(members.select("cluster", F.col("member").alias("a"), F.col("member").alias("b"), F.lit(1.0).alias("ani")), members, most_members=8).collect()


def test_empty_trees(spark):
    nodes = t.tree_nodes(spark.createDataFrame([], "tree long, newick string"))
    assert t.focal_ancestor(nodes, spark.createDataFrame([], "tree long, name string, state string, focal boolean, outgroup boolean")).count() == 0
