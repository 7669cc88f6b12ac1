"""Structural alleles of a panel from graph bubbles and per-genome calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def events(bubbles: DataFrame, calls: DataFrame, min_insert: int = 500, max_insert: int = 5000, tolerance: int = 50, clean_span: int = 20) -> DataFrame:
    """One row per bubble with a size polymorphism, small and large ones told apart by ``kind``.

    ``calls`` has (chrom, start, end, genome, allele_len, contig, strand, qs, qe, contig_len), null allele_len for no call.
    Genomes within ``tolerance`` of the shortest allele are empty, those at least ``min_insert`` above it filled; the insert
    is the whole part of the difference of their medians. The junction frame comes from the empty genome with the longest
    contig (ties: the smaller name); without a called interval it is -1 on both sides. Inversions and bubbles with fewer
    than two calls give no row.
    """
    key = ["chrom", "start", "end"]
    called = calls.where("allele_len is not null")
    low = called.groupBy(*key).agg(F.min("allele_len").alias("shortest"), F.count("*").alias("n_called"))
    c = called.join(low, key)
    empty, filled = F.col("allele_len") <= F.col("shortest") + tolerance, F.col("allele_len") >= F.col("shortest") + min_insert
    c = c.withColumns({"empty": empty, "filled": filled})
    frame = F.min_by(F.struct("genome", "contig", "strand", "qs", "qe"), F.struct(-F.col("contig_len"), F.col("genome")))
    g = c.groupBy(*key).agg(
        F.count_if("empty").alias("n_empty"),
        F.count_if("filled").alias("n_filled"),
        F.median(F.when(F.col("empty"), F.col("allele_len"))).alias("len_empty"),
        F.median(F.when(F.col("filled"), F.col("allele_len"))).alias("len_filled"),
        F.array_sort(F.collect_set(F.when(F.col("empty"), F.col("genome")))).alias("empty_genomes"),
        F.array_sort(F.collect_set(F.when(F.col("filled"), F.col("genome")))).alias("filled_genomes"),
        F.first("n_called").alias("n_called"),
    )
    eref = c.where("empty").groupBy(*key).agg(frame.alias("e"))
    total = calls.groupBy(*key).agg(F.count("*").alias("n_genomes"))
    out = bubbles.where("not is_inversion").join(g, key).join(eref, key).join(total, key).where("n_called >= 2 and n_empty > 0 and n_filled > 0")
    out = out.withColumn("insert_size", (F.col("len_filled") - F.col("len_empty")).cast("int")).where(F.col("insert_size") >= min_insert)
    upper = lambda c: F.upper(F.coalesce(c, F.lit("")))
    from strandloom.functions.seq import common_prefix, common_suffix

    out = out.withColumns({"s": upper(F.col("seq_short")), "l": upper(F.col("seq_long"))}).withColumn("lcp", common_prefix("s", "l"))
    out = out.withColumn("lcs", common_suffix("s", "l", F.least(F.length("s"), F.length("l")) - F.col("lcp")))
    n = F.length("l") - F.col("lcp") - F.col("lcs")
    plus, known = F.col("e.strand") == "+", F.col("e.qs").isNotNull()
    left = F.when(known, F.col("e.qs") + F.when(plus, F.col("lcp")).otherwise(F.col("lcs"))).otherwise(-1)
    right = F.when(known, F.col("e.qe") - F.when(plus, F.col("lcs")).otherwise(F.col("lcp"))).otherwise(-1)
    out = out.withColumns({"insert_len_direct": n, "insert_md5": F.substring(F.md5(F.substring("l", F.col("lcp") + 1, n)), 1, 12), "junction_l": left, "junction_r": right})
    span = F.col("junction_r") - F.col("junction_l")
    shape = F.when(~known, "no_empty_frame").when(F.abs(span) <= clean_span, "clean_or_graph_slack").otherwise("asymmetric_candidate")
    kind = F.when(F.col("insert_size") > max_insert, "large").otherwise("event")
    return out.select(*key, "insert_size", "len_empty", "len_filled", "n_empty", "n_filled", (F.col("n_genomes") - F.col("n_called")).alias("n_missing"), "insert_len_direct", "insert_md5", F.col("e.genome").alias("empty_ref_genome"), "junction_l", "junction_r", span.alias("junction_span"), shape.alias("architecture"), kind.alias("kind"), F.slice("empty_genomes", 1, 20).alias("empty_genomes"), F.slice("filled_genomes", 1, 20).alias("filled_genomes"))
