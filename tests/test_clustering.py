"""Families of sequences and proteins, the set cover and the nearest alleles, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import kernels as k
from strandloom.operators import clustering as c
from strandloom.operators.joins import salted_join


def letters(r, n, of="ACGT"):
    return "".join(r.choices(of, k=n))


def mutate(s, rate, r, of="ACGT"):
    return "".join(r.choice(of) if r.random() < rate else x for x in s)


def linked(n, near):
    """The smallest number that each can reach."""
    low = list(range(n))
    while True:
        new = [min([low[x], *(low[y] for y in near[x])]) for x in range(n)]
        if new == low:
            return low
        low = new


def dna_items(seed=1):
    """Families with a common repeat in all, chains of partial overlap, both strands, equal ones, short and empty ones."""
    r, repeat = random.Random(seed), letters(random.Random(99), 40)
    out = []
    for f in range(8):
        base = letters(r, 400) + repeat + letters(r, 300)
        for _ in range(r.randrange(1, 6)):
            s = mutate(base, 0.02, r)
            out.append(k.rc(s) if r.random() < 0.4 else s)
    chain = letters(r, 1500)
    out += [chain[p : p + 700] for p in range(0, 801, 100)]
    out += [out[0], k.rc(out[0]), "ACGTACGT", "ACGTACGT", "", None, letters(r, 60)]
    return list(enumerate(out))


@pytest.mark.parametrize("block", [2])
def test_sequence_families_against_all_pairs(spark, block):
    items = dna_items()
    text = [min(s or "", k.rc(s or "")) for _, s in items]
    near = [[y for y in range(len(items)) if x != y and (text[x] == text[y] or c.alike(text[x], text[y], 0.9, 0.8))] for x in range(len(items))]
    df = spark.createDataFrame([(i, s, "x", 7) for i, s in items], "item long, seq string, node string, n long")
    got = {x["item"]: x["family"] for x in c.sequence_families(df, block=block).collect()}
    assert got == dict(enumerate(linked(len(items), near)))
    assert len(set(got.values())) < len(items) - 10


def test_a_seed_that_all_share_is_spread(spark):
    """What every node has finds no pair, and a list of any length meets in cells of bounded size."""
    rows = [(n, s, 100) for n in range(300) for s in (0, 1, 1000 + n // 2)] + [(n, 7, 100) for n in range(100)]
    seeds = spark.createDataFrame(rows, "node long, seed long, size long")
    kept = c.rare_seeds(seeds, 3)
    lists = {x["seed"]: x["n"] for x in kept.select("seed", "n").distinct().collect()}
    assert 0 not in lists and 1 not in lists or set(lists.values()) <= {2, 100}
    pairs = c.cell_pairs(kept.drop("top"), 8).collect()
    shared = lambda a, b: len({s for n, s, _ in rows if n == a} & {s for n, s, _ in rows if n == b})
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if shared(a, b) >= 3}
    assert want <= {(p["a"], p["b"]) for p in pairs}


def test_salted_join_against_a_plain_one(spark):
    r = random.Random(3)
    rows = [(n, 0 if n % 3 else r.randrange(50)) for n in range(3000)] + [(3001, None), (3002, 77)]
    left = spark.createDataFrame(rows, "x long, key long")
    right = spark.createDataFrame([(n, "v" * n) for n in range(50)], "key long, wide string").join(left.groupBy("key").agg(F.count("*").alias("n")), "key", "left")
    got = salted_join(left, right, "key", "n", 3000, block=100)
    assert sorted(got.select("x", "wide").collect()) == sorted(left.join(right, "key").select("x", "wide").collect())


def sequential_cover(sizes, links):
    free, rep = set(sizes), {}
    near = {x: {x} for x in sizes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    while free:
        best = min(free, key=lambda x: (-len(near[x] & free), -sizes[x], x))
        for x in near[best] & free:
            rep[x] = best
        free -= near[best]
    return rep


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 60, 90), (2, 80, 400), (4, 70, 69)])
def test_set_cover_is_the_sequential_one(spark, seed, n, m):
    r = random.Random(seed)
    sizes = {x: r.randrange(1, 5) for x in range(n)}
    links = {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)} if seed != 4 else {(0, x) if x < 60 else (x - 1, x) for x in range(1, n)}
    got = c.set_cover(spark.createDataFrame(sorted(links), "a long, b long"), spark.createDataFrame(sorted(sizes.items()), "node long, size long"))
    assert {x["node"]: x["rep"] for x in got.collect()} == sequential_cover(sizes, links)


AA = "ACDEFGHIKLMNPQRSTVWY"


def test_protein_families_against_all_pairs(spark):
    r = random.Random(8)
    items = []
    for f in range(6):
        base = letters(r, r.randrange(80, 200), AA)
        for _ in range(r.randrange(1, 6)):
            s = mutate(base, 0.15, r, AA)
            items.append(s if r.random() < 0.7 else s[: int(0.6 * len(s))])
    items += [items[0], items[0], "", None, "MK", "*" * 20]
    text = [s or "" for s in items]
    for both in (True,):
        kinds = sorted(set(text), key=text.index)
        links = {(x, y) for x in range(len(kinds)) for y in range(x + 1, len(kinds)) if c.protein_alike(kinds[x], kinds[y], 0.5, 0.8, both)}
        df = spark.createDataFrame(list(enumerate(items)), "item long, protein string")
        got = {x["item"]: (x["representative"], x["family_size"]) for x in c.protein_families(df, both=both, block=4).collect()}
        assert len(links) >= 5 and set(got) == set(range(len(items)))
        families = {x: got[x][0] for x in got}
        assert all(len({y for y in families if families[y] == families[x]}) == got[x][1] for x in got)
        for x, rep in families.items():  # every member is linked with its representative
            a, b = sorted((kinds.index(text[x]), kinds.index(text[rep])))
            assert a == b or (a, b) in links
        sizes = {n: len(s) for n, s in enumerate(kinds)}
        assert len(set(families.values())) == len(set(sequential_cover(sizes, links).values()))


def test_protein_alignment():
    x = "MKVLAAGIVALLAACSSNNPEDTWYRHKKQRSTLLPPGGACDEFHIKLMN"
    assert c.protein_alignment(x, x) == {"score": 5 * len(x), "identity": 1.0, "x_cover": 1.0, "y_cover": 1.0}
    assert c.protein_alignment(x, "") is None
    gap = c.protein_alignment(x, x[:20] + x[25:])
    assert gap["score"] == 5 * (len(x) - 5) - 15 and gap["identity"] == pytest.approx(45 / 50) and gap["x_cover"] == 1.0
    assert c.reduced("LIVM") == "LLLL" and c.reduced("st*x") == "SS*X"


def brute_alleles(query, alleles, size, top=2, ratio=0.34):
    words = lambda s: {s[i : i + size] for i in range(len(s) - size + 1)}
    inside = lambda a, b: len(a & b) / min(len(a), len(b)) if a and b else 0.0
    out, ranked = [], []
    for name, s in sorted(alleles):
        if s in (query, k.rc(query)):
            out.append((1.0, 1.0, name))
        elif not max(len(s), len(query)) or min(len(s), len(query)) >= ratio * max(len(s), len(query)):
            known = words(s) and words(query)
            ranked.append((max(inside(words(query), words(s)), inside(words(k.rc(query)), words(s))) if known else 1.0, name, s))
    ranked.sort(key=lambda x: (-x[0], x[1]))
    out += [(*k.better_strand(query, s), name) for _, name, s in ranked[:top]]
    return sorted(out, key=lambda x: (-x[0], -x[1], x[2]))


def test_match_alleles_against_all_alignments(spark):
    r = random.Random(5)
    queries, alleles = [], []
    for locus in range(3):
        bases = [letters(r, r.choice([12, 60, 90, 150])) for _ in range(5)]
        for n, b in enumerate(bases):
            alleles.append((locus, n, b))
        alleles += [(locus, 50, bases[0]), (locus, 60, ""), (locus, 61, letters(r, 8))]
        for n in range(12):
            s = mutate(r.choice(bases), r.choice([0, 0.03, 0.2]), r)
            queries.append((locus, n, k.rc(s) if n % 3 == 0 else s))
        queries += [(locus, 90, ""), (locus, 91, "ACGT"), (locus, 92, letters(r, 5000)), (locus, 93, letters(r, 80))]
    queries.append((9, 1, "ACGTACGTACGTACGTACGT"))  # a locus without alleles
    got = c.match_alleles(spark.createDataFrame(queries, "locus long, query long, seq string"), spark.createDataFrame(alleles, "locus long, allele long, seq string")).collect()
    found = {}
    for x in sorted(got, key=lambda x: x["rank"]):
        found.setdefault((x["locus"], x["query"]), []).append((x["identity"], x["coverage"], x["allele"]))
    for locus, n, s in queries:
        assert found.get((locus, n), []) == brute_alleles(s, [(a, t) for l, a, t in alleles if l == locus], 15), (locus, n)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item long, seq string, protein string")
    assert c.sequence_families(none).count() == 0 == c.protein_families(none).count()
    alone = spark.createDataFrame([(5, None, None), (3, "", "")], "item long, seq string, protein string")
    assert sorted(map(tuple, c.sequence_families(alone).collect())) == [(3, 3), (5, 3)]
    empty = spark.createDataFrame([], "locus long, query long, allele long, seq string")
    assert c.match_alleles(empty, empty).count() == 0


def test_translation():
    assert k.translate("ATGGCCTAA") == "MA*" and k.translate("ATGNNNTTTA") == "MXF"
    orf = "ATG" + "GCT" * 40 + "TAA"
    assert k.dominant_protein("CC" + orf + "C") == "M" + "A" * 40 == k.dominant_protein(k.rc("CC" + orf + "C"))
    assert k.dominant_protein("ACGT" * 5) is None


def test_ends_are_known_without_alignment():
    """What the tester passes is what the alignment passes, whether a pair is near, half alike or far."""
    r = random.Random(12)
    base = letters(r, 120, AA)
    proteins = [mutate(base, rate, r, AA) for rate in (0.05, 0.2, 0.4, 0.6)] + [base[:70], base[30:] + letters(r, 40, AA), base[:40] + letters(r, 60, AA) + base[60:], letters(r, 90, AA), base * 2, "", "MK"]
    for both in (True, False):
        test = c._protein_tester(0.5, 0.8, both, 5)()
        for a, x in enumerate(proteins):
            for b, y in enumerate(proteins):
                assert test(a, x, b, y) == c.protein_alike(x, y, 0.5, 0.8, both)


@pytest.mark.parametrize("block", [3, 1000])
def test_links_of_cells_are_those_of_all_pairs(spark, block):
    """Each pair that shares a seed is tested once, in one cell, however many seeds it shares."""
    r = random.Random(13)
    nodes = [(10 * n, letters(r, r.randrange(5, 40))) for n in range(30)]
    lists = [(n, seed) for n, _ in nodes for seed in r.sample(range(12), 4)]

    def tester():
        seen = set()

        def test(a, x, b, y):
            assert frozenset((x, y)) not in seen
            seen.add(frozenset((x, y)))
            return (len(x) + len(y)) % 2 == 0

        return test

    got = c.cell_links(spark.createDataFrame(lists, "node long, seed long"), spark.createDataFrame(nodes, "node long, seq string"), tester, 0.5, block).collect()
    of = {n: {s for m, s in lists if m == n} for n, _ in nodes}
    want = {(a, b) for a, x in nodes for b, y in nodes if a < b and of[a] & of[b] and 2 * min(len(x), len(y)) >= max(len(x), len(y)) and (len(x) + len(y)) % 2 == 0}
    assert sorted(map(tuple, got)) == sorted(want)
