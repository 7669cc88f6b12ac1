"""The manifest against a plain tree, and its proofs against tampering."""

import hashlib

import pytest
from pyspark.sql import functions as F

from strandloom.llm.merkle import fold, manifest, proof_digest, record_digest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves, fanout):
    """The root, and for each leaf its siblings level by level."""
    nodes, proofs, at = list(leaves), [""] * len(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p // fanout * fanout : p // fanout * fanout + fanout]
            proofs[k] += "".join(run[: p % fanout] + run[p % fanout + 1 :])
            at[k] = p // fanout
        nodes = [h("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def plain(rows, fanout):
    groups = {}
    for i, s, t in rows:
        groups.setdefault(s, []).append((i, plain_leaf(i, s, t)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    told = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        told[s] = tree([leaf for _, leaf in groups[s]], fanout)
    root, upper = tree([told[s][0] for s in names], fanout) if names else ("", [])
    return sorted((repr(i), leaf, told[s][0], root, h(told[s][1][k] + upper[n])) for n, s in enumerate(names) for k, (i, leaf) in enumerate(groups[s]))


def frame(spark, rows):
    return spark.createDataFrame([(i, s, t, 1, "x", 2) for i, s, t in rows], "doc_id long, source string, text string, at long, node string, tree long")


def made(n):
    rows = [(k * 7 % n, "hot" if k % 3 else f"s{k % 11}", f"Text {k}" * (k % 4)) for k in range(n)]
    return rows + [(None, "hot", "no id"), (3, None, None), (3, "hot", "twice"), (3, "hot", "twice"), (5, "é", "ü"), (6, "", ""), ((1 << 62) + 1, "big", "long id")]


@pytest.mark.parametrize(("rows", "fanout", "levels"), [(made(300), 4, 2), (made(100), 16, 3), (made(60), 2, 3), ([(1, "a", "one")], 16, 3), ([(1, "a", "x"), (2, "b", "y")], 16, 3), ([(k, "a", "x") for k in range(65)], 4, 3)])
def test_against_a_plain_tree(spark, rows, fanout, levels):
    cols = [F.col(c) for c in ("doc_id", "source", "text")]
    got = manifest(frame(spark, rows), record_digest(*cols), fanout=fanout, levels=levels, keep={"text": F.col("text")})
    got = got.withColumns({"proof": proof_digest(F.col("before"), F.col("after")), "folded": fold(F.col("leaf"), F.col("before"), F.col("after")), "other": fold(record_digest(F.lit("other")), F.col("before"), F.col("after"))}).collect()
    assert sorted((repr(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got) == plain(rows, fanout)
    assert all(r["folded"] == r["root"] != r["other"] for r in got)
    assert sorted((repr(r["doc_id"]), repr(r["source"]), repr(r["text"])) for r in got) == sorted((repr(i), repr(s), repr(t)) for i, s, t in rows)


def test_empty_table(spark):
    assert manifest(frame(spark, []), record_digest(F.col("text"))).count() == 0


def test_a_very_long_text(spark):
    rows = [(1, "a", "x" * 3_000_000), (2, "a", None)]
    got = {r["doc_id"]: r["leaf"] for r in manifest(frame(spark, rows), record_digest(F.col("text"))).collect()}
    assert got == {1: h("3000000:" + "x" * 3_000_000), 2: h("-")}
