"""Ordered classifications as Column expressions. Thresholds are parameters; the order of the cases is part of the meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(*cases: tuple[Column, str], default: str) -> Column:
    """The first case that holds."""
    out = None
    for when, name in cases:
        out = F.when(when, name) if out is None else out.when(when, name)
    return out.otherwise(default)


def homology_block(identity: Column, q_len: Column, t_len: Column, same_contig: Column, overlap: Column, offset: Column, min_identity: float = 90.0, low: int = 300, high: int = 5000, separation: int = 10_000) -> Column:
    """PF1: identical enough, both spans of the right size, and on one contig apart from each other."""
    return (identity >= min_identity) & q_len.between(low, high) & t_len.between(low, high) & (~same_contig | ((overlap <= 0) & (F.abs(offset) >= separation)))


def hit_coverage(kind: str, block: Column, q_len: Column, t_len: Column, q_start: Column, q_end: Column) -> Column:
    """PF2: three formulas of coverage, kept apart by name."""
    return {"block": block / q_len, "span": (q_end - q_start) / q_len, "shorter": block / F.least(q_len, t_len)}[kind]


def identity_of(de: Column, dv: Column, matches: Column, columns: Column) -> Column:
    """PF3: percent identity from the divergence tags, else from the counts."""
    return 100 * F.coalesce(1 - de, 1 - dv, matches / columns)


def qc_tier(left: Column, right: Column, n_left: Column, n_right: Column, far: int = 500, near: int = 100, most_n: float = 0.01) -> Column:
    """PF6: distance to the contig ends and N in the flanks."""
    return cascade(
        ((left >= far) & (right >= far) & (n_left < most_n) & (n_right < most_n), "high"),
        ((left >= near) & (right >= near), "medium"),
        default="unresolvable_contig_break",
    )


def event_tier(tiers: Column) -> Column:
    """PF6: of a group's tiers (an aggregate): all high, any unresolvable, else medium."""
    return F.when(F.bool_and(tiers == "high"), "high").when(F.bool_or(tiers == "unresolvable_contig_break"), "unresolvable_contig_break").otherwise("medium")


def family_verdict(flank_homology: Column, sharpness: Column, score: Column, loci: Column) -> Column:
    """PF7: what kind of repeat a family is."""
    return cascade(
        (flank_homology >= 0.40, "SEGMENTAL_DUP"),
        ((sharpness < 0.15) & (loci >= 3), "REPEAT_NO_BOUNDARY"),
        ((score >= 0.70) & (sharpness >= 0.30) & (loci >= 3), "STRONG"),
        (score >= 0.50, "MOBILE"),
        default="WEAK",
    )


def event_class(n_alleles: Column, short: Column, long: Column, lcp: Column, lcs: Column, tolerant: Column, lost: Column, min_insert: int = 500, most_target: int = 50) -> Column:
    """PF8: how two alleles differ; ``tolerant`` tells that the decomposition came from an alignment."""
    return cascade(
        (n_alleles <= 1, "monomorphic"),
        (long == short, "substitution_only"),
        (long - short < min_insert, "below_min_insert"),
        (short == 0, "pure_insertion"),
        (tolerant & (lost > 0), "replacement"),
        (tolerant, "insertion_target_retained"),
        (lcp + lcs >= short, "insertion_target_retained"),
        (short - lcp - lcs <= most_target, "replacement"),
        default="length_polymorphism",
    )


def eligible(kind: Column, inserted: Column) -> Column:
    """PF4: events that go on to the catalogue."""
    return kind.isin("insertion_target_retained", "replacement") & (inserted > 0)


def structurally_clean(lost: Column, overlap: Column, placement: Column, most: int = 15) -> Column:
    """PF5: a column, never a filter."""
    return (lost == 0) & (overlap <= most) & (placement != "ambiguous")


#: Words of protein domains, looked for in any case; a list of domains is searched as one text.
MGE_WORDS = (
    r"integrase|recombinase|resolvase|transposase|phage|capsid|terminase|portal|tail|relaxase|mob[A-Z]?|conjug|excision|invertase|"
    r"tyrosine_recomb|serine_recomb|rve|zinc_ribbon|rusa|ning|holliday|antirepressor|gp5_trimer|tape_meas|nu1"
)
IS_WORDS = r"transposase|tnp|^is\d|dde|dedd"


def informative(domains: Column) -> Column:
    """Whether a list of domains (joined by commas) names any that isn't one of unknown function."""
    return F.exists(F.split(domains, ","), lambda d: ~F.startswith(F.upper(d), F.lit("DUF")))


def annotation_class(rrna: Column, orf: Column, is_hit: Column, domain: Column, verdict: Column, strong: Column) -> Column:
    """PF9: nine classes from rRNA, ORF, model hits and structure; a null ``domain`` is no hit."""
    word = lambda pattern: F.coalesce(F.regexp_like(domain, F.lit(f"(?i){pattern}")), F.lit(False))
    return cascade(
        (rrna & (orf < 0.4), "ribosomal"),
        (is_hit, "IS_element"),
        (word(IS_WORDS), "IS_like"),
        (word(MGE_WORDS), "MGE"),
        (verdict == "SEGMENTAL_DUP", "segmental_duplication"),
        (F.coalesce(informative(domain), F.lit(False)), "other_domain"),
        ((orf >= 0.4) & strong, "coding_mobile"),
        (strong, "noncoding_mobile"),
        default="unclassified",
    )


def evidence_class(coverage: Column, identity: Column, left: Column, right: Column) -> Column:
    """PF10: whether an allele comparison supports a call."""
    return F.when((coverage >= 0.90) & (identity >= 0.95) & (F.least(left, right) >= 200), "supported").otherwise("unsupported")


def miss_taxonomy(length: Column, edge: Column, extent: Column, found: Column, copies: Column, identity: Column, tandem: Column) -> Column:
    """PF11: why a known element was missed, in the order in which a pipeline loses it."""
    return cascade(
        (length < 300, "too_short"),
        (length > 5000, "too_long"),
        (edge < 500, "contig_edge"),
        (~found, "absent"),
        (extent < 0.5, "partial_extent"),
        (copies < 3, "too_few_copies"),
        (identity < 0.90, "low_identity"),
        (tandem, "tandem"),
        default="downstream",
    )


def seed_status(left: Column, right: Column, contig_len: Column, pad: int = 200) -> Column:
    """PF19: whether a padded seed ``[left - pad, right + pad)`` can be cut."""
    return cascade(((left < 0) | (right < left), "invalid_junction_frame"), ((left - pad < 0) | (right + pad > contig_len), "seed_padding_outside_contig"), default="seeded")


def layer2_status(seed: Column, resolved: Column, ambiguous: Column) -> Column:
    """PF20: unseedable, unresolved and ambiguous candidates stay as rows."""
    return cascade((seed != "seeded", "unseedable"), (~F.coalesce(resolved, F.lit(False)), "unresolved"), (F.coalesce(ambiguous, F.lit(False)), "ambiguous"), default="resolved")


def gap_status(gap: Column, insert: Column) -> Column:
    """PF21: a gap between anchors against the insert's length."""
    return cascade((gap < 0, "overlapping"), (gap == 0, "zero"), ((gap <= 50) & (gap <= 0.2 * insert), "short"), (gap.between(0.8 * insert, 1.2 * insert), "similar"), default="other")


def polarity(short_carriers: Column, outgroup: Column) -> Column:
    """PF22: outgroup members among the carriers of the short allele (arrays)."""
    n = F.size(F.array_intersect(short_carriers, outgroup))
    return F.when(n == 0, "none").when(n == F.size(outgroup), "all").otherwise("mixed")


def tsd_polarity(tsd: Column, least: int = 4, most: int = 15) -> Column:
    """PF23: direction of an event from its target-site duplication."""
    return F.when(tsd > most, "repeat_array").when(tsd >= least, "derived_is_long").otherwise("not_callable")


def quality_tiers(completeness: Column, contamination: Column, chimera_free: Column, n50: Column) -> Column:
    """PF13: every nested tier that an assembly reaches, as an array."""
    base = (completeness >= 90) & (contamination <= 5)
    named = [("hq", base), ("hq_clean", base & chimera_free), *((f"hq_n50_{k}k", base & chimera_free & (n50 >= k * 1000)) for k in (50, 100, 250))]
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in named)))


def first_reason(*tests: tuple[Column, str]) -> Column:
    """PF15: the first failing test's name; null if all pass."""
    out = F.lit(None).cast("string")
    for bad, name in reversed(tests):
        out = F.when(bad, name).otherwise(out)
    return out


def keyword_class(name: Column, words: dict[str, str]) -> Column:
    """PF18: the class of the first keyword that the name holds, else the name itself."""
    out = None
    for word, kind in words.items():
        hit = F.contains(F.lower(name), F.lit(word))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(name)


def safe_name(name: Column) -> Column:
    """PF17: letters, digits, underscore and hyphen only."""
    return F.regexp_like(name, F.lit(r"^[A-Za-z0-9_-]+$"))


def allele_assignment(best: Column, other: Column, a: Column, b: Column, near: float = 0.95, margin: float = 0.005) -> Column:
    """the better allele, or the sorted pair where two are too close to tell."""
    pair = F.array_sort(F.array(a, b))
    return F.when(best < near, "none").when(best - other < margin, F.concat(F.lit("ambiguous_between_"), F.array_join(pair, "_"))).otherwise(a)


def disagreement(identity: Column, coverage: Column, n_alternatives: Column, mode_fraction: Column, ambiguity: Column, rc_length: Column, length: Column, min_identity: float = 0.95, min_coverage: float = 0.90) -> Column:
    """PF12: why two lengths of an insert differ; ``rc_length`` is that of the reverse complement, negative if it has none."""
    ambiguous = "Layer2_repeat_ambiguous"
    return cascade(
        ((identity >= min_identity) & (coverage >= min_coverage), "ArmB_extent_imprecise"),
        ((n_alternatives > 1) & (mode_fraction < 0.75), "different_long_alleles"),
        ((ambiguity > 5) | ((rc_length >= 0) & (rc_length != length)), ambiguous),
        ((identity < 0.80) | (coverage < 0.50), "true_decomposition_error"),
        default=ambiguous,
    )


def size_gate(sizes: DataFrame, by: list[str], size: str, least: int = 100_000, share: float = 0.5) -> DataFrame:
    """PF16: ``sizes`` with (median, floor, passes): at least ``share`` of the panel's upper median, and ``least``."""
    from strandloom.operators.stats import ranked_quantile

    mid = ranked_quantile(sizes, by, size, 0.5, "median")
    floor = F.greatest(F.lit(least), F.floor(share * F.col("median"))).cast("long")
    return sizes.join(mid, by).withColumn("floor", floor).withColumn("passes", F.col(size) >= F.col("floor"))


def supported_allele(votes: DataFrame, by: list[str], allele: str = "allele_assignment", status: str = "allele_match_status") -> DataFrame:
    """(by, allele, n, votes, agreement) of the confident votes; ties go to the smaller allele.

    Unresolved, empty and ambiguous votes don't count; a group without any other has ``.`` and ``none``.
    """
    counts = (F.col(status) != "unresolved") & ~F.col(allele).isin(".", "") & ~F.startswith(F.col(allele), F.lit("ambiguous_between"))
    told = votes.where(counts).groupBy(*by, allele).agg(F.count("*").alias("n"))
    best = told.groupBy(*by).agg(F.min_by(F.struct(F.col(allele).alias("a"), "n"), F.struct(-F.col("n"), F.col(allele))).alias("b"), F.sum("n").alias("votes"))
    out = votes.select(*by).distinct().join(best, by, "left")
    n, all_ = F.coalesce("b.n", F.lit(0)), F.coalesce("votes", F.lit(0))
    agreement = F.when(all_ == 0, "none").when(n == all_, "unanimous").when(2 * n > all_, "majority").otherwise("split")
    return out.select(*by, F.coalesce("b.a", F.lit(".")).alias("allele"), n.cast("long").alias("n"), all_.cast("long").alias("votes"), agreement.alias("agreement"))
