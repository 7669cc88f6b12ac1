"""Bubbles of a panel with planted insertions on both strands, and the events that they give."""

import random

import numpy as np
import pytest

from strandloom.functions.kernels import rc
from strandloom.operators.bubbles import native_bubbles, rising_chain, shared_anchors
from strandloom.plans import arm_b


def letters(r, n):
    return "".join(r.choices("ACGT", k=n))


def test_longest_chain():
    r = np.random.default_rng(1)
    for _ in range(50):
        v = r.integers(0, 30, r.integers(0, 25))
        k = rising_chain(v)
        best = np.zeros(len(v), int)
        for i in range(len(v)):
            best[i] = 1 + max([0, *(best[j] for j in range(i) if v[j] < v[i])])
        assert len(k) == (best.max() if len(v) else 0) and (np.diff(v[k]) > 0).all() and (np.diff(k) > 0).all()


PLACES = {"a": 3000, "b": 9000, "c": 15_000}


@pytest.fixture(scope="module")
def panel(spark):
    r = random.Random(31)
    base, e, big = letters(r, 20_000), letters(r, 800), letters(r, 6000)
    repeat = letters(r, 60)
    base = repeat + base[60:12_000] + repeat + base[12_060:]  # a word with two places is no anchor
    rows = [("g0", "c", base)]
    for n in range(1, 5):
        s = base
        if n in (1, 2):
            s = s[: PLACES["a"]] + e + s[PLACES["a"] :]
        if n == 3:
            s = s[: PLACES["b"]] + big + s[PLACES["b"] :]
        if n == 4:
            s = s[: PLACES["c"]] + s[PLACES["c"] + 700 :]
        s = "".join(r.choice("ACGT") if r.random() < 0.002 else x for x in s)
        rows.append((f"g{n}", "c", rc(s) if n % 2 == 0 else s))
    rows[1:2] = [("g1", "x", rows[1][2][:8000]), ("g1", "y", rc(rows[1][2][8000:]))]
    rows.append(("g9", "other", letters(r, 3000)))
    contigs = spark.createDataFrame(rows, "genome string, contig string, seq string")
    return {(g, c): s for g, c, s in rows}, native_bubbles(contigs, "g0")


def test_planted_insertions_are_found(panel):
    whole, (bubbles, calls) = panel
    found = sorted(bubbles.collect(), key=lambda b: b["start"])
    assert len(found) == 3 and all(b["start"] <= p <= b["end"] <= b["start"] + 1000 for b, p in zip(found, PLACES.values(), strict=True))
    by = {}
    for x in calls.collect():
        by.setdefault(x["start"], {})[x["genome"]] = x
    a, b, c = (by[x["start"]] for x in found)
    assert all(set(x) == {"g0", "g1", "g2", "g3", "g4", "g9"} for x in (a, b, c)) and all(x["g9"]["allele_len"] is None for x in (a, b, c))
    n = lambda x, g: x[g]["allele_len"] - x["g0"]["allele_len"]
    assert [n(a, g) for g in ("g1", "g2", "g3", "g4")] == [800, 800, 0, 0]
    assert [n(b, g) for g in ("g1", "g2", "g3", "g4")] == [0, 0, 6000, 0]
    assert [n(c, g) for g in ("g1", "g2", "g3", "g4")] == [0, 0, 0, -700]
    assert {g: x["strand"] for g, x in a.items()} == {"g0": "+", "g1": "+", "g2": "-", "g3": "+", "g4": "-", "g9": None}
    for x in (a, b, c):
        for g, call in x.items():
            if call["allele_len"] is not None:
                assert call["qe"] - call["qs"] == call["allele_len"] <= call["contig_len"] == len(whole[g, call["contig"]])
    short, long = found[0]["seq_short"], found[0]["seq_long"]
    assert len(long) - len(short) == 800


def test_they_feed_the_events(panel):
    _, (bubbles, calls) = panel
    got = sorted(arm_b.events(bubbles, calls).collect(), key=lambda e: e["start"])
    assert [(e["insert_size"], e["kind"], e["n_empty"], e["n_filled"], e["n_missing"]) for e in got] == [(800, "event", 3, 2, 1), (6000, "large", 4, 1, 1), (700, "event", 1, 4, 1)]
    assert abs(got[0]["junction_l"] - PLACES["a"]) <= 40 or got[0]["empty_ref_genome"] != "g0"


def test_repeats_are_no_anchors(spark):
    r = random.Random(2)
    unit = letters(r, 200)
    rows = [("g0", "1", letters(r, 500) + unit + letters(r, 500)), ("g1", "2", unit * 5)]
    df = spark.createDataFrame(rows, "genome string, no string, seq string")
    assert all(x["pos"] < 200 or x["pos"] >= 780 for x in shared_anchors(df, "g0").collect())


def test_empty_panels(spark):
    none = spark.createDataFrame([], "genome string, contig string, seq string")
    bubbles, calls = native_bubbles(none, "g0")
    assert bubbles.count() == 0 == calls.count()
