"""The shingle join against all pairs."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from strandloom.llm import shinglejoin
from strandloom.llm.shinglejoin import shingle_sets, similar_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [exact(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        ids = [x for x in (least.get(find(k)), i) if x is not None]
        least[find(k)] = min(ids) if ids else None
    return sorted(((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, grp string, n int")
    return sorted(map(tuple, similar_components(df, **kw).collect()), key=str)


def corpus(seed, n=70):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(r.choices(words, k=55))
    base = [r.choices(words, k=r.choice([6, 30, 60, 120])) for _ in range(12)]
    rows = []
    for k in range(n):
        b = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 8])):
            b[r.randrange(len(b))] = r.choice(words)
        if r.random() < 0.2:
            b += [passage]
        rows.append((k, " ".join(b)))
    return rows


def test_word_rule():
    texts = ["", None, "a", "A b", "a  b", "  a\tb c d  ", "a b c d e", "a b c d e f", "É b\xa0c d e f g", "a b c d e a b c d e", "x\x1cy z"]
    for t, s in zip(texts, shingle_sets(texts), strict=True):
        assert len(s) == len(exact(t)), t
    a, b, c, d = (next(shingle_sets([t])) for t in ("A b", "a\x0bB", "É", "é"))
    assert list(a) == list(b) and list(c) != list(d), "only A-Z are lower-cased"


@pytest.mark.parametrize("short", [1, 8])
def test_against_all_pairs(spark, monkeypatch, short):
    monkeypatch.setattr(shinglejoin, "SHORT", short)
    rows = corpus(short) + [(500, ""), (501, None), (502, " \n"), (503, "two words"), (504, "Two  WORDS"), (None, "two words"), (None, "alone here"), (3, "two words"), (505, "z " * 60000)]
    assert run(spark, rows) == brute(rows)


def test_hot_group_of_near_copies(spark):
    r = random.Random(9)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(120):
        b = list(base)
        for _ in range(r.randrange(3)):
            b[r.randrange(60)] = f"v{r.randrange(10**6)}"
        rows.append((k, " ".join(b)))
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_threshold_is_exact_at_the_edge(spark):
    words = [f"e{k}" for k in range(40)]
    a, b, c = " ".join(words), " ".join(words[:36]), " ".join(words[4:])
    rows = [(1, a), (2, b), (3, c)]
    assert run(spark, rows) == brute(rows)
    df = spark.createDataFrame(rows, "k long, body string")
    assert {x[0] for x in similar_components(df, id_col="k", text_col="body", percent=95).select(F.col("component_id") - F.col("doc_id")).collect()} == {0}


def test_words_that_only_differ_in_structure(spark):
    morse = "a"
    for _ in range(10):
        morse += morse.translate(str.maketrans("ab", "ba"))
    other = morse.translate(str.maketrans("ab", "ba"))
    assert len(morse) == 1024 and sorted(morse) == sorted(other)
    a, b, c = shingle_sets([morse, other, morse.upper()])
    assert list(a) != list(b) and list(a) == list(c)
    got = run(spark, [(1, morse), (2, other), (3, morse)])
    assert [x[2] for x in got] == [1, 2, 1]


def test_low_bits_of_hashes_may_meet():
    """Sets whose hashes agree in their upper 40 bits only are disjoint."""
    import numpy as np

    x = np.arange(1000, dtype=np.uint64) << np.uint64(24)
    assert len(np.intersect1d(x, x + np.uint64(1), assume_unique=True)) == 0
    a, b = shingle_sets([" ".join(f"a{k}" for k in range(300_000)), " ".join(f"b{k}" for k in range(300_000))])
    assert len(a) == len(b) == 299_996 and len(np.intersect1d(a, b)) == 0


def test_ranks_tell_large_counts_apart():
    import numpy as np

    n = np.array([0, 1, 65_535, 65_600, 10**9, 10**9 + 10**7, 10**18], np.int64)
    assert (np.diff(shinglejoin.ranks(n).astype(int)) > 0).all()


def test_lists_in_blocks_and_cells(spark, monkeypatch):
    """A shingle that half of all prefixes share, in many blocks and cells, loses no link."""
    monkeypatch.setattr(shinglejoin, "SHORT", 2)
    monkeypatch.setattr(shinglejoin, "BLOCK", 1)
    monkeypatch.setattr(shinglejoin, "CELL", 3)
    r = random.Random(3)
    rows = []
    for k in range(90):
        b = [f"c{x}" for x in range(8)] + [f"u{r.randrange(12)}" for _ in range(r.choice([2, 3]))]
        rows.append((k, " ".join(b)))
    rows += [(200 + k, " ".join(f"c{x}" for x in range(8 + k % 3))) for k in range(20)]
    assert run(spark, rows) == brute(rows)
