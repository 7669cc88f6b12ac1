"""Sequence, key and interval functions as Column expressions: JVM-side, inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES, COMPLEMENT = "ACGTacgtNn", "TGCAtgcaNn"
IUPAC, IUPAC_COMPLEMENT = "ACGTRYMKSWBDHVNacgtrymkswbdhvn", "TGCAYRKMSWVHDBNtgcayrkmswvhdbn"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
FLANK = 60


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dna(text: Column | str) -> Column:
    """The letters A-Z of a text as a nucleotide string: equal and nearly equal texts give equal and nearly equal ones."""
    return F.translate(F.lower(F.regexp_replace(col(text), "[^A-Za-z]", "")), LETTERS, ("ACGT" * 7)[:26])


def revcomp(s: Column | str, iupac: bool = False) -> Column:
    return F.reverse(F.translate(col(s), *((IUPAC, IUPAC_COMPLEMENT) if iupac else (BASES, COMPLEMENT))))


def canonical(s: Column | str) -> Column:
    """The smaller of a sequence and its reverse complement, so that strand doesn't matter."""
    return F.least(col(s), revcomp(s))


def canon_key(s: Column | str, size: int = 16) -> Column:
    """The first hex digits of the MD5 of the canonical sequence; empty for an empty one."""
    return F.when(F.length(col(s)) == 0, "").otherwise(F.substring(F.md5(canonical(s)), 1, size))


def short_md5(s: Column | str) -> Column:
    """12 hex digits, ``EMPTY`` for blank."""
    return F.when(F.trim(F.coalesce(col(s), F.lit(""))) == "", "EMPTY").otherwise(F.substring(F.md5(col(s)), 1, 12))


def orientation(s: Column | str) -> Column:
    """``fwd`` if the sequence is its own canonical form (ties included), else ``rc``."""
    return F.when(col(s) <= revcomp(s), "fwd").otherwise("rc")


def window(s: Column | str, start: Column, end: Column) -> Column:
    """``s[start:end)``, 0-based, both ends clamped to the sequence."""
    lo = F.greatest(start, F.lit(0))
    return F.substring(col(s), lo + 1, F.greatest(F.least(end, F.length(col(s))) - lo, F.lit(0)))


def count_of(s: Column | str, letters: str) -> Column:
    return F.length(col(s)) - F.length(F.translate(col(s), letters, ""))


def gc_fraction(s: Column | str) -> Column:
    return F.when(F.length(col(s)) > 0, count_of(s, "GC") / F.length(col(s))).otherwise(0.0)


def n_fraction(s: Column | str) -> Column:
    return F.when(F.length(col(s)) > 0, count_of(s, "Nn") / F.length(col(s))).otherwise(0.0)


def kmers(s: Column | str, k: int, strands: bool = True) -> Column:
    """Distinct k-mers without an N; with ``strands`` each as the smaller of itself and its reverse complement."""
    n = F.length(col(s)) - k + 1
    words = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(col(s), i, F.lit(k)))
    words = F.filter(words, lambda w: ~F.contains(F.upper(w), F.lit("N")))
    if strands:
        words = F.transform(words, canonical)
    return F.when(n > 0, F.array_distinct(words)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays of distinct items; 0 if either is empty."""
    both = F.size(F.array_intersect(col(a), col(b)))
    return F.when((F.size(col(a)) > 0) & (F.size(col(b)) > 0), both / (F.size(col(a)) + F.size(col(b)) - both)).otherwise(0.0)


def containment(a: Column | str, b: Column | str) -> Column:
    """Shared items over the smaller set; 0 if either is empty."""
    least = F.least(F.size(col(a)), F.size(col(b)))
    return F.when(least > 0, F.size(F.array_intersect(col(a), col(b))) / least).otherwise(0.0)


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common prefix, by halving: log steps, no array of characters."""
    a, b = col(a), col(b)
    return _grown(F.least(F.length(a), F.length(b)), lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))


def common_suffix(a: Column | str, b: Column | str, most: Column) -> Column:
    """Length of the longest common suffix, not over ``most``."""
    a, b = F.reverse(col(a)), F.reverse(col(b))
    return _grown(most, lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))


def _grown(most: Column, holds) -> Column:
    """The largest n <= ``most`` for which ``holds(n)`` (true up to some n, then false): bits from the top."""
    bits = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    return F.aggregate(bits, F.lit(0), lambda got, bit: F.when((got + bit <= most) & holds(got + bit), got + bit).otherwise(got))


def identity(a: Column | str, b: Column | str) -> Column:
    """Matching positions over the longer length, without gaps."""
    n = F.greatest(F.length(col(a)), F.length(col(b)))
    same = F.size(F.filter(F.zip_with(F.split(col(a), ""), F.split(col(b), ""), lambda x, y: x == y), lambda x: x))
    return F.when(n > 0, same / n).otherwise(1.0)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing positions of two strings of one length, else null."""
    differs = F.size(F.filter(F.zip_with(F.split(col(a), ""), F.split(col(b), ""), lambda x, y: x != y), lambda x: x))
    return F.when(F.length(col(a)) == F.length(col(b)), differs)


def flank_key(left: Column | str, right: Column | str, size: int = FLANK) -> Column:
    """16 hex digits over the ``size`` letters on both sides; null where either is shorter."""
    l, r = F.right(col(left), F.lit(size)), F.left(col(right), F.lit(size))
    return F.when((F.length(l) == size) & (F.length(r) == size), F.substring(F.md5(F.concat(l, F.lit("|"), r)), 1, 16))


def exact_flank_key(left: Column | str, right: Column | str, complete: Column, size: int = FLANK) -> Column:
    """SHA-256 over both flanks; null unless complete and made of A, C, G and T."""
    l, r = F.right(col(left), F.lit(size)), F.left(col(right), F.lit(size))
    pure = F.regexp_like(F.concat(l, r), F.lit(f"^[ACGT]{{{2 * size}}}$"))
    return F.when(complete & pure, F.sha2(F.concat(l, F.lit("|"), r), 256))


def excise(s: Column | str, start: Column, end: Column) -> Column:
    return F.concat(window(s, F.lit(0), start), window(s, end, F.length(col(s))))


def insert_at(s: Column | str, at: Column, what: Column | str) -> Column:
    return F.concat(window(s, F.lit(0), at), col(what), window(s, at, F.length(col(s))))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def gap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Distance between two intervals, 0 where they touch or overlap."""
    return F.greatest(F.lit(0), s1 - e2, s2 - e1)


def reciprocal_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.least(overlap(s1, e1, s2, e2) / (e1 - s1), overlap(s1, e1, s2, e2) / (e2 - s2))


def accession_core(name: Column | str) -> Column:
    """The part between ``_`` and ``.``: one for both archives' names of an assembly."""
    return F.split_part(F.split_part(col(name), F.lit("_"), F.lit(2)), F.lit("."), F.lit(1))


#: Folders that stand between a panel and its run, or below a panel. Fixed values.
RESULT_FOLDERS = ("recon", "l2", "allele_recon")


def panel_label(path: Column | str) -> Column:
    """``<run>/<panel>`` from a path: a folder of results at the end, or between run and panel, is passed over; a panel
    without a run is alone."""
    parts = F.filter(F.split(col(path), "/"), lambda p: p != "")
    at = lambda p, k: F.coalesce(F.try_element_at(p, F.lit(-k)), F.lit(""))
    own = F.when(at(parts, 1).isin(*RESULT_FOLDERS), 2).otherwise(1)
    panel = F.when(own == 2, at(parts, 2)).otherwise(at(parts, 1))
    above = F.when(own == 2, at(parts, 3)).otherwise(at(parts, 2))
    higher = F.when(own == 2, at(parts, 4)).otherwise(at(parts, 3))
    run = F.when(above.isin(*RESULT_FOLDERS), higher).otherwise(above)
    return F.when(run != "", F.concat(run, F.lit("/"), panel)).otherwise(panel)


def qualified(path: Column | str, item: Column | str) -> Column:
    """``<run>/<panel>|<item>`` from a panel's path."""
    return F.concat(panel_label(path), F.lit("|"), col(item))


def to_int(x: Column | str, default=None) -> Column:
    """An integer from text, by way of a double; ``default`` where that fails."""
    return F.coalesce(col(x).try_cast("double").try_cast("long"), F.lit(default).cast("long"))


def to_double(x: Column | str, default=None) -> Column:
    return F.coalesce(col(x).try_cast("double"), F.lit(default).cast("double"))


def truthy(x: Column | str) -> Column:
    s = F.lower(F.trim(col(x)))
    return F.coalesce(s.isin("true", "t", "yes"), F.lit(False)) | F.coalesce(s.try_cast("double") == 1.0, F.lit(False))


def clamp01(x: Column, low: float, high: float) -> Column:
    """``x`` on the scale from ``low`` to ``high``; 0 for null and NaN."""
    y = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(y)


def mobility_score(internal: Column, flank: Column, sharpness: Column, copies: Column) -> Column:
    """Weighted score of a multi-copy family: alike inside, unlike outside, with sharp edges, in many copies."""
    return 0.25 * clamp01(internal, 85, 99.5) + 0.30 * (1 - clamp01(flank, 0, 0.6)) + 0.25 * clamp01(sharpness, 0, 0.7) + 0.20 * clamp01(copies, 2, 8)


def cluster_half(key: Column | str) -> Column:
    """0 or 1 by the hash of a key: a split that never changes."""
    return F.conv(F.substring(F.md5(col(key)), 1, 8), 16, 10).cast("long") % 2
