"""Sequence kernels in plain Python and NumPy: the order-dependent and dynamic-programming parts that expressions can't hold."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable

import numpy as np

_COMPLEMENT = str.maketrans("ACGTacgtNn", "TGCAtgcaNn")


def rc(s: str) -> str:
    return s.translate(_COMPLEMENT)[::-1]


_LETTERS = np.full(256, 4, np.int64)
_LETTERS[[ord(c) for c in "ACGT"]] = range(4)


def count_kmers(s: str, k: int) -> int:
    """Distinct canonical words of ``k`` letters without an N: as whole numbers where all letters are A, C, G or T."""
    if len(s) < k:
        return 0
    codes = _LETTERS[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]
    if k > 31 or codes.max(initial=0) > 3:
        return len({min(w, rc(w)) for w in (s[p : p + k] for p in range(len(s) - k + 1)) if "N" not in w.upper()})
    words, turned = np.zeros((2, len(s) - k + 1), np.int64)
    for i in range(k):
        own = codes[i : i + len(words)]
        words = 4 * words + own
        turned += (3 - own) << (2 * i)
    words = np.sort(np.minimum(words, turned))
    return 1 + int(np.count_nonzero(words[1:] != words[:-1]))


def canon_key(s: str) -> str:
    return hashlib.md5(min(s, rc(s)).encode()).hexdigest()[:16] if s else ""


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """Equal positions from the start of two arrays."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def slide(long: str, start: int, end: int) -> tuple[int, int]:
    """How far ``[start, end)`` can move left and right with the rest of the string unchanged."""
    s = np.frombuffer(long.encode("utf-32-le"), np.uint32)
    left = _run(s[:start][::-1], s[:end][::-1])
    return min(left, start), _run(s[start:], s[end:]) if end < len(s) else 0


def decompose(short: str, long: str) -> dict | None:
    """Common prefix and suffix of two alleles and what the longer one has between; None if ``short`` isn't shorter.

    ``overlap`` is prefix + suffix - len(short): 0 where the whole short allele is kept, below it where bases are lost.
    """
    if len(short) >= len(long):
        return None
    a, b = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (short, long))
    p = _run(a, b)
    q = _run(a[p:][::-1], b[p:][::-1])
    return {"lcp": p, "lcs": q, "insert": long[p : len(long) - q], "overlap": p + q - len(short)}


def canonical_insert_key(long: str, start: int, length: int) -> str:
    """The smallest canonical key over every placement of the insert that gives the same long allele."""
    left, right = slide(long, start, start + length)
    return min((canon_key(long[k : k + length]) for k in range(start - left, start + right + 1)), default="")


def locate_insert(long: str, length: int, start: int | None, lcp: int | None, md5: str | None) -> tuple[int | None, str]:
    """Where an insert lies in the long allele, and how that is known.

    The stated start counts if the digest of the letters there agrees (``coord``), then the common prefix (``lcp``; a
    missing one is 0), then of all other places with that digest the one nearest to the common prefix, on ties the earlier
    (``repaired``). Without a digest any place within the allele agrees, and there is no repair. An insert without letters,
    or one that isn't found, is ``unresolved`` and has no place.
    """
    last = len(long) - length
    if length <= 0 or last < 0:
        return None, "unresolved"
    size, prefix = len(md5 or ""), lcp or 0

    def agrees(k: int) -> bool:
        return 0 <= k <= last and hashlib.md5(long[k : k + length].encode()).hexdigest()[:size] == (md5 or "")

    if start is not None and agrees(start):
        return start, "coord"
    if agrees(prefix):
        return prefix, "lcp"
    if not size:
        return None, "unresolved"
    nearest = sorted(range(last + 1), key=lambda k: (abs(k - prefix), k))
    found = next((k for k in nearest if agrees(k)), None)
    return found, "unresolved" if found is None else "repaired"


def duplication(insert: str, left: str, right: str, least: int = 3, most: int = 30) -> dict | None:
    """Target-site duplication: the longest end of the insert that repeats the flank on the other side.

    Looked for on the right before the left; low-complexity repeats (fewer than three letters, or one over 75 %) don't count.
    """
    for n in range(min(most, len(insert)), least - 1, -1):
        for seq, side, same in ((insert[:n], "right", right[:n]), (insert[-n:], "left", left[-n:])):
            if len(same) == n and seq.upper() == same.upper():
                counts = Counter(seq.upper())
                if len(counts) >= 3 and max(counts.values()) / n <= 0.75:
                    return {"tsd_len": n, "tsd_seq": seq, "side": side, "confidence": "high" if n >= 6 else "medium" if n >= 4 else "low"}
    return None


def outward_repeat(seq: str, a: int, b: int, cap: int = 40) -> int:
    """Length of the repeat that ends at ``a`` and at ``b``, walking to the left."""
    n = 0
    while n < cap and a - 1 - n >= 0 and b - 1 - n >= a and seq[a - 1 - n] == seq[b - 1 - n]:
        n += 1
    return n


def inverted_repeat(seq: str, least: int = 8, most: int = 50) -> int:
    """Longest k such that the first k letters are the reverse complement of the last k."""
    return next((k for k in range(min(most, len(seq) // 2), least - 1, -1) if seq[:k].upper() == rc(seq[-k:]).upper()), 0)


_CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")


def project_boundary(cigar: str, q_start: int, t_start: int, boundary: int, reverse: bool = False) -> int | None:
    """The target position of a query boundary through a CIGAR of M, =, X, I and D.

    None where it lies outside, in an insertion (its target place is ambiguous), at a malformed CIGAR or on the reverse strand.
    """
    ops = _CIGAR.findall(cigar)
    if reverse or not ops or "".join(n + o for n, o in ops) != cigar or any(o not in "M=XID" or n == "0" for n, o in ops):
        return None
    q, t = q_start, t_start
    if boundary == q:
        return t if ops[0][1] in "M=X" else None
    for i, (n, o) in enumerate(ops):
        n = int(n)
        if o in "M=X":
            if q < boundary < q + n or boundary == q + n and (i + 1 == len(ops) or ops[i + 1][1] in "M=X"):
                return t + boundary - q
            if boundary == q + n:
                return None
            q, t = q + n, t + n
        elif o == "I":
            if q <= boundary <= q + n:
                return None
            q += n
        else:
            t += n
    return None


def global_alignment(a: str, b: str, match: float = 2, mismatch: float = -1, gap_open: float = -12, gap_extend: float = -0.4) -> list[tuple[int, int, int]]:
    """Aligned blocks (start in a, start in b, length) of a best global alignment with affine gaps.

    ``gap_open`` is the score of a gap's first letter. Rows are computed with NumPy; the gap along a row is a running
    maximum, so each row costs a few vector operations.
    """
    x, y = (np.frombuffer(s.upper().encode("utf-32-le"), np.uint32) for s in (a, b))
    n, m = len(x), len(y)
    steps = np.arange(m + 1)
    h = np.concatenate([[0.0], gap_open + gap_extend * np.arange(m)])
    down = np.full(m + 1, -np.inf)
    trace = np.zeros((n + 1, m + 1), np.uint8)  # 0 diagonal, 1 gap in b (up), 2 gap in a (left)
    up_open, left_open = np.ones((n + 1, m + 1), bool), np.ones((n + 1, m + 1), bool)
    trace[0, 1:] = 2
    left_open[0, 2:] = False
    for i in range(1, n + 1):
        opened, extended = h + gap_open, down + gap_extend
        up_open[i] = opened >= extended
        down = np.maximum(opened, extended)
        diagonal = np.concatenate([[-np.inf], h[:-1] + np.where(y == x[i - 1], match, mismatch)])
        best = np.maximum(diagonal, down)
        lead = np.maximum.accumulate(best - gap_extend * steps)  # best earlier column for a gap along this row
        across = np.concatenate([[-np.inf], lead[:-1] + gap_open - gap_extend + gap_extend * steps[1:]])
        h_new = np.maximum(best, across)
        left_open[i, 1:] = h_new[:-1] + gap_open >= across[1:] - 1e-9
        trace[i] = np.where(across > best, 2, np.where(down > diagonal, 1, 0))
        h = h_new
    blocks: list[list[int]] = []
    i, j, state = n, m, int(trace[n, m])
    while i or j:
        if state == 0:
            if blocks and blocks[-1][0] == i and blocks[-1][1] == j:
                blocks[-1] = [i - 1, j - 1, blocks[-1][2] + 1]
            else:
                blocks.append([i - 1, j - 1, 1])
            i, j = i - 1, j - 1
            state = int(trace[i, j])
        elif state == 1:
            fresh = up_open[i, j]
            i -= 1
            state = int(trace[i, j]) if fresh else 1
        else:
            fresh = left_open[i, j]
            j -= 1
            state = int(trace[i, j]) if fresh else 2
    return [tuple(x) for x in reversed(blocks)]


def tolerant_decompose(short: str, long: str, min_cov: float = 0.85, min_ident: float = 0.95, min_insert: int = 500, dominance: float = 3.0) -> dict:
    """The dominant insertion of ``long`` over ``short`` by global alignment, tolerant of substitutions and small indels.

    Only gaps between aligned blocks count; one in both sequences is an insertion and a deletion. ``ok`` asks for coverage,
    identity, size, and that the largest insertion outweighs any other indel ``dominance`` times.
    """
    blocks = global_alignment(short, long)
    columns = sum(n for _, _, n in blocks)
    same = sum(sum(p == q for p, q in zip(short[i : i + n].upper(), long[j : j + n].upper(), strict=True)) for i, j, n in blocks)
    inserts, deletions = [], []
    for (i, j, n), (i2, j2, _) in zip(blocks, blocks[1:], strict=False):
        if j2 > j + n:
            inserts.append((j2 - j - n, i + n, j + n, j2))
        if i2 > i + n:
            deletions.append(i2 - i - n)
    coverage, ident = columns / len(short) if short else 0.0, same / columns if columns else 0.0
    big = max(inserts, key=lambda x: x[0], default=(0, 0, 0, 0))
    rest = list(inserts)
    if inserts:
        rest.remove(big)
    second = max([*(x[0] for x in rest), *deletions], default=0)
    ok = coverage >= min_cov and ident >= min_ident and big[0] >= min_insert and (second == 0 or big[0] / max(1, second) >= dominance)
    left, right = slide(long, big[2], big[3]) if big[0] else (0, 0)
    others = [x[0] for x in rest] + deletions
    quality = coverage * ident * (min(1.0, big[0] / second / dominance) if second else 1.0)
    counts = {"n_snp": columns - same, "n_small_indel": len(others), "edit_distance": columns - same + big[0] + sum(others), "quality": quality}
    return {"ok": ok, "coverage": coverage, "identity": ident, "insert_len": big[0], "lcp": big[1], "insert_start": big[2], "second": second, "lost": sum(deletions), "ambiguity": left + right} | counts


def explain_allele(short: str, long: str, min_cov: float = 0.85, min_ident: float = 0.95, min_insert: int = 500, dominance: float = 3.0, tolerant: bool = True) -> dict:
    """How ``long`` comes of ``short``: by common prefix and suffix, or where these don't cover ``short``, by alignment.

    (method, lcp, lcs, insert, insert_start, ambiguity, lost, and the alignment's figures, null where none was needed or none
    has an insert). The alignment replaces the exact reading only if it passes its gates. ``ambiguity`` is how far the insert
    can slide; ``lost`` are letters of ``short`` that neither side keeps.
    """
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (short, long))
    p = _run(x, y)
    q = _run(x[p:][::-1], y[p:][::-1])
    out = {"method": "exact", "lcp": p, "lcs": q, "insert": long[p : len(long) - q], "insert_start": p, "ambiguity": sum(slide(long, p, len(long) - q)), "lost": len(short) - p - q}
    figures = dict.fromkeys(("identity", "coverage", "quality", "insert_len", "second", "n_snp", "n_small_indel", "edit_distance"))
    if tolerant and p + q < len(short) < len(long) and short:
        told = tolerant_decompose(short, long, min_cov, min_ident, min_insert, dominance)
        if told["insert_len"]:
            figures = {k: told[k] for k in figures}
            if told["ok"]:
                a, n = told["insert_start"], told["insert_len"]
                out |= {"method": "tolerant_alignment", "lcp": told["lcp"], "lcs": len(short) - told["lcp"], "insert": long[a : a + n], "insert_start": a, "ambiguity": told["ambiguity"], "lost": told["lost"]}
    return out | {"aligned_insert_len" if k == "insert_len" else k: v for k, v in figures.items()}


#: Fixed values of the comparison of alleles: scores of the alignment, and what a supported call needs.
COMPARE_SCORES = (2, -3, -12, -0.1)
COMPARE_COVERAGE, COMPARE_IDENTITY, COMPARE_SIDE = 0.90, 0.95, 200


def _one_gap(x: np.ndarray, y: np.ndarray, match: float, mismatch: float, gap_open: float, gap_extend: float) -> list[tuple[int, int, int]] | None:
    """The blocks of ``global_alignment`` where ``y`` is ``x`` without one piece; None if it isn't.

    All letters of ``y`` match and there is one gap, as there must be, so no alignment scores more, and any that scores as
    much has that form. Of its placements, the trace takes the last whose score comes out above that of going on along the
    diagonal, which only rounding can bring about, or else the first; the scores are added up here as they are there.
    """
    n, m = len(x), len(y)
    first, last = m - _run(x[::-1], y[::-1]), _run(x, y)
    if n < m or last < first:
        return None
    at = first
    if n > m and last > first:
        down = match * np.arange(first, last + 1, dtype=float) + gap_open
        for _ in range(n - m - 1):
            down += gap_extend
        best = down[0]
        for k, score in enumerate(down[1:].tolist(), first + 1):
            best += match
            if score > best:
                best, at = score, k
    return [(i, j, c) for i, j, c in ((0, 0, at), (at + n - m, at, m - at)) if c]


def compare_alleles(long: str, short: str, start: int, end: int) -> dict:
    """Evidence for a called insert ``[start, end)`` of ``long`` over ``short``, by global alignment.

    Where ``short`` is ``long`` without one piece the best alignment is known without the matrix, in linear time.
    Every letter of ``long`` is aligned or in a gap. The gap that shares most letters with the call (on ties the longest,
    then the last) is measured against it; identity is over all aligned letters; those on either side of the call are counted.
    A call outside the sequence, an empty one, or an empty short allele has the status ``invalid_call`` and nothing else.
    """
    if not 0 <= start < end <= len(long) or not short:
        return {"status": "invalid_call"}
    x, y = (np.frombuffer(s.upper().encode("utf-32-le"), np.uint32) for s in (long, short))
    partner = np.full(len(x), -1)
    for i, j, n in _one_gap(x, y, *COMPARE_SCORES) or global_alignment(long, short, *COMPARE_SCORES):
        partner[i : i + n] = np.arange(j, j + n)
    aligned = partner >= 0
    identity = float((x[aligned] == y[partner[aligned]]).mean()) if aligned.any() else 0.0
    left, right = int(aligned[:start].sum()), int(aligned[end:].sum())
    steps = np.diff(np.concatenate([[1], aligned.astype(np.int8), [1]]))
    begins, ends = np.flatnonzero(steps < 0), np.flatnonzero(steps > 0)
    out = {"gap": 0, "coverage": 0.0, "identity": round(identity, 6), "left": left, "right": right, "start_shift": None, "end_shift": None}
    share = 0.0
    if len(begins):
        inside = np.clip(np.minimum(ends, end) - np.maximum(begins, start), 0, None)
        at = np.lexsort((begins, ends - begins, inside))[-1]
        share = float(inside[at]) / (end - start)
        out |= {"gap": int(ends[at] - begins[at]), "coverage": round(share, 6), "start_shift": int(begins[at]) - start, "end_shift": int(ends[at]) - end}
    holds = share >= COMPARE_COVERAGE and identity >= COMPARE_IDENTITY and min(left, right) >= COMPARE_SIDE
    return {"status": "supported_long_short" if holds else "no_dominant_long_short_support"} | out


def fixed(x: float | None, digits: int) -> str:
    """``x`` with so many digits after the point (exact ties to even), ``NA`` for null or NaN."""
    return "NA" if x is None or x != x else f"{x:.{digits}f}"


def local_alignment(a: str, b: str, match: float = 2, mismatch: float = -1, gap_open: float = -12, gap_extend: float = -0.4) -> dict:
    """Identity and coverage (of the shorter sequence) of a best local alignment with affine gaps."""
    x, y = (np.frombuffer(s.upper().encode("utf-32-le"), np.uint32) for s in (a, b))
    n, m = len(x), len(y)
    if not n or not m:
        return {"identity": 0.0, "coverage": 0.0, "score": 0.0}
    steps = np.arange(m + 1)
    h, down = np.zeros(m + 1), np.full(m + 1, -np.inf)
    rows = [h]
    trace = np.full((n + 1, m + 1), 3, np.uint8)  # 3: the alignment begins here
    up_open, left_open = np.ones((n + 1, m + 1), bool), np.ones((n + 1, m + 1), bool)
    for i in range(1, n + 1):
        opened, extended = h + gap_open, down + gap_extend
        up_open[i] = opened >= extended
        down = np.maximum(opened, extended)
        diagonal = np.concatenate([[-np.inf], h[:-1] + np.where(y == x[i - 1], match, mismatch)])
        best = np.maximum(np.maximum(diagonal, down), 0)
        lead = np.maximum.accumulate(best - gap_extend * steps)
        across = np.concatenate([[-np.inf], lead[:-1] + gap_open - gap_extend + gap_extend * steps[1:]])
        h = np.maximum(best, across)
        left_open[i, 1:] = h[:-1] + gap_open >= across[1:] - 1e-9
        trace[i] = np.where(h <= 0, 3, np.where(across > best, 2, np.where(down > diagonal, 1, 0)))
        rows.append(h)
    table = np.array(rows)
    i, j = np.unravel_index(int(table.argmax()), table.shape)
    score, columns, same, state = float(table[i, j]), 0, 0, int(trace[i, j])
    while state != 3:
        if state == 0:
            columns, same = columns + 1, same + bool(x[i - 1] == y[j - 1])
            i, j = i - 1, j - 1
            state = int(trace[i, j])
        elif state == 1:
            fresh = up_open[i, j]
            i -= 1
            state = int(trace[i, j]) if fresh else 1
        else:
            fresh = left_open[i, j]
            j -= 1
            state = int(trace[i, j]) if fresh else 2
    return {"identity": same / columns if columns else 0.0, "coverage": columns / min(n, m), "score": score}


def best_orientation(a: str, b: str) -> dict:
    """The better of the local alignments with ``b`` and with its reverse complement."""
    forward, backward = local_alignment(a, b), local_alignment(a, rc(b))
    rank = lambda r: (r["identity"] * r["coverage"], r["identity"])
    return forward | {"orientation": "fwd"} if rank(forward) >= rank(backward) else backward | {"orientation": "rc"}


def better_strand(a: str, b: str) -> tuple[float, float]:
    """(identity, coverage) of the local alignment with ``b`` or its reverse complement, whichever has the higher identity."""
    if not a or not b:
        return (1.0, 1.0) if a == b else (0.0, 0.0)
    forward, backward = local_alignment(a, b), local_alignment(a, rc(b))
    best = forward if forward["identity"] >= backward["identity"] else backward
    return best["identity"], best["coverage"]


STOPS = {"TAA", "TAG", "TGA"}
#: The standard genetic code, codons in the order T, C, A, G of their letters.
GENETIC_CODE = dict(zip((a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"), "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", strict=True))


def translate(seq: str) -> str:
    """The protein of a coding sequence up to its end; unknown codons are X, letters left over are ignored."""
    s = seq.upper()
    return "".join(GENETIC_CODE.get(s[k : k + 3], "X") for k in range(0, len(s) - 2, 3))


def dominant_protein(seq: str, least_aa: int = 30) -> str | None:
    """The protein of the longest reading frame, without its stop (ties: the leftmost, then the plus strand)."""
    frames = open_reading_frames(seq, least_aa)
    if not frames:
        return None
    top = min(frames, key=lambda r: (-r["aa"], r["start"], r["strand"]))
    s = seq[top["start"] : top["end"]]
    return translate(rc(s) if top["strand"] == "-" else s)[:-1]


def open_reading_frames(seq: str, least_aa: int = 30) -> list[dict]:
    """ATG to stop in all six frames (an approximation of a gene caller: no scoring of start sites or of codons)."""
    out = []
    for strand, s in (("+", seq.upper()), ("-", rc(seq.upper()))):
        for frame in range(3):
            begin = None
            for k in range(frame, len(s) - 2, 3):
                codon = s[k : k + 3]
                if begin is None and codon == "ATG":
                    begin = k
                elif begin is not None and codon in STOPS:
                    if (k - begin) // 3 >= least_aa:
                        lo, hi = (begin, k + 3) if strand == "+" else (len(s) - k - 3, len(s) - begin)
                        out.append({"start": lo, "end": hi, "strand": strand, "aa": (k - begin) // 3})
                    begin = None
    return sorted(out, key=lambda r: (r["start"], r["end"], r["strand"]))


def interval_groups(rows: list[tuple[int, int, str]], least: float = 0.9) -> list[int]:
    """Group number of each (start, end, tie) of one contig: complete linkage by reciprocal overlap.

    Rows are taken in the order (start, end, tie); a row joins the first open group whose every member it overlaps by
    ``least`` of both, else it opens one; a group is closed when all its members end at or before the row's start.
    """
    order = sorted(range(len(rows)), key=lambda k: rows[k])
    groups: list[list[int]] = []
    active: list[int] = []
    out = [0] * len(rows)
    for k in order:
        s, e, _ = rows[k]
        active = [g for g in active if max(rows[m][1] for m in groups[g]) > s]

        def fits(g: int, s: int = s, e: int = e) -> bool:
            return all(min(e, rows[m][1]) - max(s, rows[m][0]) >= least * max(e - s, rows[m][1] - rows[m][0]) for m in groups[g])

        at = next((g for g in active if fits(g)), None)
        if at is None:
            at = len(groups)
            groups.append([])
            active.append(at)
        groups[at].append(k)
        out[k] = at
    return out


def _rising(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = []
    for k, v in enumerate(values):
        at = bisect_left(ends, v)
        before.append(tails[at - 1] if at else -1)
        tails[at : at + 1] = [k]
        ends[at : at + 1] = [v]
    out, k = [], tails[-1] if tails else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _reach(x: np.ndarray, y: np.ndarray, mismatch: int = 3, drop: int = 24) -> int:
    """How far two arrays go on alike from their starts: the best prefix where a mismatch weighs ``mismatch`` matches,
    looked for until the score has fallen ``drop`` below its best."""
    n = min(len(x), len(y))
    if not n:
        return 0
    score = np.cumsum(np.where(x[:n] == y[:n], 1, -mismatch))
    fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > drop)
    score = score[: fallen[0]] if len(fallen) else score
    return int(score.argmax()) + 1 if len(score) and score.max() > 0 else 0


def single_words(s: str, k: int) -> dict[str, int]:
    """The words of ``k`` letters that occur once, and where."""
    at: dict[str, int] = {}
    for p in range(len(s) - k + 1):
        w = s[p : p + k]
        at[w] = -1 if w in at else p
    return {w: p for w, p in at.items() if p >= 0}


def collinear_runs(in_a: dict[str, int], in_b: dict[str, int], k: int, gap: int) -> list[list[tuple[int, int, int]]]:
    """Runs of blocks (start in a, start in b, length) of words that occur once in either and rise together, with gaps up to ``gap``."""
    shared = in_a.keys() & in_b.keys()
    if len(shared) < 2:
        return [[(in_a[w], in_b[w], k)] for w in shared]
    hits = sorted((in_b[w], in_a[w]) for w in shared)
    hits = [hits[n] for n in _rising([p for _, p in hits])]
    runs: list[list[tuple[int, int, int]]] = []
    for q, p in hits:
        if runs:
            i, j, n = runs[-1][-1]
            if p - i - n <= gap and q - j - n <= gap and abs((p - i) - (q - j)) <= gap:
                skip = max(0, i + n - p, j + n - q)
                if p - i == q - j:
                    if p <= i + n:
                        runs[-1][-1] = (i, j, p + k - i)
                    else:
                        runs[-1].append((p, q, k))
                elif skip < k:
                    runs[-1].append((p + skip, q + skip, k - skip))
                continue
        runs.append([(p, q, k)])
    return runs


def collinear_blocks(a: str, b: str, k: int, gap: int) -> list[list[tuple[int, int, int]]]:
    """Collinear alignments of two sequences as blocks (start in a, start in b, length), by words that occur once in each."""
    runs = collinear_runs(single_words(a, k), single_words(b, k), k, gap)
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    out = []
    for run in runs:
        whole = [run[0]]
        for p, q, n in run[1:]:
            i, j, m = whole[-1]
            i, j = i + m, j + m
            if p - i == q - j and 2 * int((x[i:p] == y[j:q]).sum()) >= p - i:
                whole[-1] = (i - m, j - m, p + n - (i - m))
                continue
            if p > i and q > j:
                whole += [(i + u, j + v, c) for u, v, c in global_alignment(a[i:p], b[j:q])]
            whole.append((p, q, n))
        i, j, n = whole[0]
        left = _reach(x[:i][::-1], y[:j][::-1])
        whole[0] = (i - left, j - left, n + left)
        i, j, n = whole[-1]
        whole[-1] = (i, j, n + _reach(x[i + n :], y[j + n :]))
        joined = [whole[0]]
        for i, j, n in whole[1:]:  # blocks that touch in both sequences are one
            p, q, m = joined[-1]
            joined[-1:] = [(p, q, m + n)] if (p + m, q + m) == (i, j) else [joined[-1], (i, j, n)]
        out.append(joined)
    return out


def spans_reach(x: np.ndarray, y: np.ndarray, runs: list[list[tuple[int, int, int]]], enough: Callable[[int, int], bool]) -> bool:
    """Whether ``enough`` holds for the lengths in ``x`` and ``y`` of any of the alignments that ``collinear_blocks`` makes of ``runs``.

    Where an alignment begins and ends is known without what lies between its blocks. ``enough`` must not turn false as lengths grow.
    """
    for run in runs:
        (i, j, _), (p, q, n) = run[0], run[-1]
        ends = p + n - i, q + n - j
        left, right = min(i, j), min(len(x) - p - n, len(y) - q - n)
        if not enough(ends[0] + left + right, ends[1] + left + right):
            continue
        left = _reach(x[i - left : i][::-1], y[j - left : j][::-1])
        if not enough(ends[0] + left + right, ends[1] + left + right):
            continue
        right = _reach(x[p + n :], y[q + n :])
        if enough(ends[0] + left + right, ends[1] + left + right):
            return True
    return False


def anchored_alignments(a: str, b: str, k: int = 15, gap: int = 600) -> list[dict]:
    """Local alignments of ``b`` to ``a`` on both strands: (strand, a_start, a_end, same, columns, blocks).

    Words of ``k`` letters that occur once in either sequence are chained where they rise together with gaps of up to
    ``gap``; what lies between is aligned globally, and the ends go on without gaps as long as that pays. Blocks are (start
    in a, start in b or its reverse complement, length). Two sequences that share such a word have an alignment, whatever
    lies around, so an alignment ends where the likeness does.
    """
    a, out = a.upper(), []
    for strand, s in (("+", b.upper()), ("-", rc(b.upper()))):
        for blocks in collinear_blocks(a, s, k, gap):
            same = sum(sum(p == q for p, q in zip(a[i : i + n], s[j : j + n], strict=True)) for i, j, n in blocks)
            out.append({"strand": strand, "a_start": blocks[0][0], "a_end": blocks[-1][0] + blocks[-1][2], "same": same, "columns": sum(n for _, _, n in blocks), "blocks": blocks})
    return out
