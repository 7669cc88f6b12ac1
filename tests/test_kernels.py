"""Kernels against their definitions: laws by hypothesis, fixtures by hand."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.functions import kernels as k

DNA = st.text("ACGT", max_size=60)


@given(DNA)
def test_reverse_complement_is_its_own_inverse(s):
    assert k.rc(k.rc(s)) == s
    assert k.canon_key(s) == k.canon_key(k.rc(s))


@given(DNA, st.text("ACGT", min_size=1, max_size=20), DNA)
def test_insert_key_is_free_of_placement_and_strand(left, insert, right):
    long = left + insert + right
    a, n = len(left), len(insert)
    key = k.canonical_insert_key(long, a, n)
    lo, hi = k.slide(long, a, a + n)
    for start in range(a - lo, a + hi + 1):
        assert long[:start] + long[start + n :] == left + right
        assert k.canonical_insert_key(long, start, n) == key
    assert k.canonical_insert_key(k.rc(long), len(right), n) == key


@given(DNA, st.text("ACGT", min_size=1, max_size=20), DNA)
def test_decompose_restores(left, insert, right):
    d = k.decompose(left + right, left + insert + right)
    assert d["overlap"] <= 0 and d["lcp"] + d["lcs"] == len(left + right)
    assert (left + right)[: d["lcp"]] + d["insert"] + (left + right)[d["lcp"] :] == left + insert + right


@pytest.mark.parametrize(
    ("cigar", "boundary", "expected"),
    [
        ("100M", 0, 0), ("100M", 40, 40), ("100M", 100, 100), ("100M", 101, None),
        ("216M125D241M11I767M", 300, 425), ("216M125D241M11I767M", 460, None), ("216M125D241M11I767M", 600, 714),
        ("20M5I80M", 22, None), ("20M5I80M", 20, None), ("20M5D80M", 20, None), ("20=5X75=", 22, 22),
        ("10S90M", 5, None), ("99M", 100, None), ("0M100M", 5, None), ("", 0, None),
    ],
)
def test_boundary_projection(cigar, boundary, expected):
    assert k.project_boundary(cigar, 0, 0, boundary) == expected
    assert k.project_boundary(cigar, 0, 0, boundary, reverse=True) is None


def test_duplication():
    assert k.duplication("ACGTACGG" + "T" * 30, "CC", "ACGTACGGAA")["tsd_len"] == 8
    assert k.duplication("AAAAAAAA", "AAAA", "AAAA") is None, "low complexity"
    assert k.duplication("GATTT", "CCC", "GATCC") == {"tsd_len": 3, "tsd_seq": "GAT", "side": "right", "confidence": "low"}
    assert k.duplication("", "", "") is None


def score(a, b, blocks, match=2, mismatch=-1, gap_open=-12, gap_extend=-0.4):
    total, i, j = 0.0, 0, 0
    for x, y, n in [*blocks, (len(a), len(b), 0)]:
        for gap in (x - i, y - j):
            total += gap_open + gap_extend * (gap - 1) if gap else 0
        total += sum(match if p == q else mismatch for p, q in zip(a[x : x + n], b[y : y + n], strict=True))
        i, j = x + n, y + n
    return total


def best_score(a, b, match=2, mismatch=-1, gap_open=-12, gap_extend=-0.4):
    inf = float("-inf")
    h, d, r = ({} for _ in range(3))
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            d[i, j] = max(h.get((i - 1, j), inf) + gap_open, d.get((i - 1, j), inf) + gap_extend)
            r[i, j] = max(h.get((i, j - 1), inf) + gap_open, r.get((i, j - 1), inf) + gap_extend)
            diag = h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch) if i and j else inf
            h[i, j] = 0.0 if not i and not j else max(diag, d[i, j], r[i, j])
    return h[len(a), len(b)]


@settings(max_examples=60, deadline=None)
@given(st.text("AC", max_size=14), st.text("AC", max_size=14))
def test_global_alignment_is_optimal(a, b):
    blocks = k.global_alignment(a, b)
    assert abs(score(a, b, blocks) - best_score(a, b)) < 1e-6


def test_tolerant_decompose_finds_the_insert():
    r = random.Random(5)
    left, right, insert = ("".join(r.choices("ACGT", k=n)) for n in (400, 400, 600))
    long = left + insert + right
    short = list(left + right)
    short[50] = "A" if short[50] != "A" else "C"
    d = k.tolerant_decompose("".join(short), long)
    assert d["ok"] and d["insert_len"] == 600 and d["lost"] == 0
    start = d["insert_start"]
    assert long[:start] + long[start + 600 :] == left + right


def test_local_alignment_of_both_strands():
    r = random.Random(2)
    a = "".join(r.choices("ACGT", k=120))
    hit = k.best_orientation(a, "TTTT" + k.rc(a) + "GGGG")
    assert hit["orientation"] == "rc" and hit["identity"] == 1.0 and hit["coverage"] == 1.0
    assert k.local_alignment("", "ACGT")["coverage"] == 0.0


def test_locate_insert_never_gives_an_unconfirmed_place():
    import hashlib

    long = "ACGTTTGACCAGT"
    md5 = hashlib.md5(b"GACC").hexdigest()[:12]
    assert k.locate_insert(long, 4, 6, None, md5) == (6, "coord")
    assert k.locate_insert(long, 4, 1, 6, md5) == (6, "lcp")
    assert k.locate_insert(long, 4, 1, 2, md5) == (6, "repaired")
    assert k.locate_insert(long, 4, None, None, "0" * 12) == (None, "unresolved")


def test_interval_groups_are_stable_under_shuffles():
    rows = [(100, 1100, "a"), (110, 1110, "b"), (180, 1180, "c"), (260, 1260, "d"), (300, 600, "e"), (5000, 6000, "f")]
    def sets(rows):
        groups = {}
        for row, g in zip(rows, k.interval_groups(rows), strict=True):
            groups.setdefault(g, set()).add(row[2])
        return sorted(map(sorted, groups.values()))
    want = sets(rows)
    assert ["a", "b", "c"] in want and ["e"] in want, "a chain isn't merged, a nested interval stays alone"
    for seed in range(20):
        mixed = rows[:]
        random.Random(seed).shuffle(mixed)
        assert sets(mixed) == want


def test_open_reading_frames():
    gene = "ATG" + "GCA" * 40 + "TAA"
    assert {"start": 2, "end": 2 + len(gene), "strand": "+", "aa": 41} in k.open_reading_frames("CC" + gene + "CC")
    assert any(o["strand"] == "-" and o["aa"] == 41 for o in k.open_reading_frames(k.rc("CC" + gene + "CC")))


def test_compare_alleles_finds_a_planted_insert():
    r = random.Random(12)
    short = "".join(r.choice("ACGT") for _ in range(500))
    insert = "".join(r.choice("ACGT") for _ in range(120))
    long = short[:240] + insert + short[240:]
    got = k.compare_alleles(long, short, 240, 360)
    assert got["status"] == "supported_long_short" and got["gap"] == 120 and got["coverage"] > 0.95 and abs(got["start_shift"]) <= 5
    assert k.compare_alleles(long, short, 20, 140)["status"] == "no_dominant_long_short_support"
    other = "".join(r.choice("ACGT") for _ in range(620))
    assert k.compare_alleles(other, short, 240, 360)["status"] == "no_dominant_long_short_support"
    same = k.compare_alleles(short, short, 100, 200)
    assert (same["gap"], same["start_shift"], same["identity"], same["left"], same["right"]) == (0, None, 1.0, 100, 300)


def test_an_excised_piece_is_compared_without_the_matrix(monkeypatch):
    """Every placement of the gap is the one that the whole matrix gives, and no matrix is made."""
    r = random.Random(5)
    cases = []
    for _ in range(400):
        long = "".join(r.choices(r.choice(["AC", "ACGT", "AAAC"]), k=r.randrange(2, 90)))
        start = r.randrange(len(long) - 1)
        end = r.randrange(start, len(long)) + 1
        cases.append((long, long[:start] + long[end:], start, end))
    whole = k.global_alignment
    one_gap = k._one_gap
    monkeypatch.setattr(k, "_one_gap", lambda *a: None)
    want = [k.compare_alleles(*c) for c in cases]
    monkeypatch.setattr(k, "_one_gap", one_gap)
    made = []
    monkeypatch.setattr(k, "global_alignment", lambda *a: made.append(a) or whole(*a))
    assert [k.compare_alleles(*c) for c in cases] == want and not made


def test_fixed_numbers():
    assert [k.fixed(x, 2) for x in (2.675, 0.125, 1.0, None, float("nan"), -0.005)] == ["2.67", "0.12", "1.00", "NA", "NA", "-0.01"]
