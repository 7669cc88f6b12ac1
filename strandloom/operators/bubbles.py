"""Bubbles of a panel without a graph builder: unique anchors that genomes share with a backbone, their longest chains, and the
places where neighbouring anchors lie at different distances."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators.align import seeds
from strandloom.operators.intervals import merge_intervals, overlap_join
from strandloom.operators.ranges import chunked, read_ranges
from strandloom.session import materialize


def rising_chain(values: np.ndarray) -> np.ndarray:
    """Positions of a longest strictly increasing subsequence."""
    ends: list[int] = []
    last: list[int] = []
    before = np.full(len(values), -1)
    for k, v in enumerate(values.tolist()):
        at = bisect_left(ends, v)
        before[k] = last[at - 1] if at else -1
        ends[at : at + 1], last[at : at + 1] = [v], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(k)
        k = int(before[k])
    return np.array(out[::-1], np.int64)


def shared_anchors(contigs: DataFrame, backbone: str, size: int = 21, window: int = 10) -> DataFrame:
    """(genome, no, b_no, strand, pos, b_pos): words that occur once in a genome and once in the backbone.

    ``contigs`` has (genome, no, seq). Counts of words are added up before they are shuffled, so a repeat of any number of
    copies is one row of each partition, and it is no anchor.
    """
    words = seeds(contigs, "no", "seq", size, window).join(contigs.select(F.col("no").alias("name"), "genome"), "name")
    once = words.groupBy("genome", "hash").agg(F.count("*").alias("n"), F.first(F.struct("name", "pos", "fwd")).alias("w"))
    once = materialize(once.where("n = 1").select("genome", "hash", "w.*"), "anchors")
    base = once.where(F.col("genome") == backbone).select("hash", F.col("name").alias("b_no"), F.col("pos").alias("b_pos"), F.col("fwd").alias("b_fwd"))
    own = once.where(F.col("genome") != backbone).join(base, "hash")
    strand = F.when(F.col("fwd") == F.col("b_fwd"), "+").otherwise("-")
    return own.select("genome", F.col("name").alias("no"), "b_no", strand.alias("strand"), "pos", "b_pos")


def chain_segments(anchors: DataFrame, size: int = 21, least: int = 3) -> DataFrame:
    """(genome, no, b_no, strand, b_start, b_end, q_start, q_end) between neighbouring anchors of the longest chain of each
    contig with each backbone contig on each strand; chains of fewer than ``least`` anchors are left out.

    A segment goes from an anchor's first letter to the next one's, in the direction of the backbone; on the other strand the
    contig's interval has the same letters reversed. A group is one pair of contigs.
    """
    shape = "genome string, no string, b_no string, strand string, b_start long, b_end long, q_start long, q_end long"

    def chain(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["b_pos", "pos"])
        b, q = pdf["b_pos"].to_numpy(), pdf["pos"].to_numpy()
        k = rising_chain(q if key[3] == "+" else -q)
        b, q = b[k], q[k]
        if len(k) < least:
            b, q = b[:0], q[:0]
        low, high = (q[:-1], q[1:]) if key[3] == "+" else (q[1:] + size, q[:-1] + size)
        return pd.DataFrame({"genome": key[0], "no": key[1], "b_no": key[2], "strand": key[3], "b_start": b[:-1], "b_end": b[1:], "q_start": low, "q_end": high})

    return anchors.groupBy("genome", "no", "b_no", "strand").applyInPandas(chain, shape)


def native_bubbles(contigs: DataFrame, backbone: str, size: int = 21, window: int = 10, min_indel: int = 50) -> tuple[DataFrame, DataFrame]:
    """A4: (bubbles, calls) of a panel, as ``plans.arm_b.events`` takes them.

    ``contigs`` has (genome, contig, seq). Where a genome's distance between neighbouring anchors differs from the backbone's by
    ``min_indel`` or more, there is a bubble; those that overlap on the backbone are one. Every genome's allele of a bubble
    is what lies between the anchors around it, cut back to the bubble by the letters that they share with the backbone; a
    genome without such anchors has no call. bubbles: (chrom, start, end, is_inversion, n_alleles, seq_short, seq_long); calls: (chrom, start, end,
    genome, allele_len, contig, strand, qs, qe, contig_len). The number of genomes of a panel is taken as small: their names
    are listed once on the driver, for the calls that are missing.
    """
    rows = materialize(contigs.select("genome", "contig", F.upper("seq").alias("seq")).withColumn("no", F.monotonically_increasing_id().cast("string")), "panel")
    chunks = materialize(chunked(rows, "no"), "panel-chunks")
    about = materialize(chunks.where("chunk = 0").select(F.col("contig").alias("no"), "length").join(rows.select("no", "genome", "contig"), "no"), "panel-contigs")
    parts = materialize(chain_segments(shared_anchors(rows, backbone, size, window), size), "segments")
    differs = F.abs((F.col("q_end") - F.col("q_start")) - (F.col("b_end") - F.col("b_start"))) >= min_indel
    found = parts.where(differs).select("b_no", F.col("b_start").alias("start"), F.col("b_end").alias("end"))
    merged = materialize(merge_intervals(found, ["b_no"]).drop("n"), "bubbles")
    ends = merged.select("b_no", "start", "end", F.inline(F.array(F.struct(F.lit("l").alias("side"), F.col("start").alias("l_start"), (F.col("start") + 1).alias("l_end")), F.struct(F.lit("r").alias("side"), (F.col("end") - 1).alias("l_start"), F.col("end").alias("l_end")))))
    at = overlap_join(ends, parts.withColumnsRenamed({"b_start": "r_start", "b_end": "r_end"}), ["b_no"], 1000)
    place = F.struct("r_start", "r_end", "q_start", "q_end")
    key = ["b_no", "start", "end", "genome", "no", "strand"]
    spans = at.groupBy(*key).agg(F.min_by(place, F.struct("r_start")).alias("x"), F.max_by(place, F.struct("r_end")).alias("y"), F.count_distinct("side").alias("sides")).where("sides = 2")
    plus = F.col("strand") == "+"
    before, behind = F.col("start") - F.col("x.r_start"), F.col("y.r_end") - F.col("end")
    low = F.when(plus, F.col("x.q_start") + before).otherwise(F.col("y.q_start") + behind)
    high = F.when(plus, F.col("y.q_end") - behind).otherwise(F.col("x.q_end") - before)
    calls = spans.select(*key, low.alias("qs"), high.alias("qe")).where("qe >= qs")
    best = Window.partitionBy("b_no", "start", "end", "genome").orderBy(F.desc(F.col("qe") - F.col("qs")), "no", "strand")
    calls = calls.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    own = merged.select("b_no", "start", "end", F.lit(backbone).alias("genome"), F.col("b_no").alias("no"), F.lit("+").alias("strand"), F.col("start").alias("qs"), F.col("end").alias("qe"))
    calls = materialize(calls.unionByName(own).withColumn("key", F.monotonically_increasing_id()), "calls")
    letters = read_ranges(chunks, calls, "key", "no", "qs", "qe", "allele")
    letters = letters.withColumn("allele", F.when(plus, F.col("allele")).otherwise(seq.revcomp("allele")))
    letters = materialize(letters.drop("key").join(about.select("no", "contig", "length"), "no"), "alleles")
    name = about.select(F.col("no").alias("b_no"), F.col("contig").alias("chrom"))
    told = letters.groupBy("b_no", "start", "end").agg(F.min_by("allele", F.struct(F.length("allele"), F.col("genome"))).alias("seq_short"), F.min_by("allele", F.struct(-F.length("allele"), F.col("genome"))).alias("seq_long"), F.count_distinct(F.md5("allele")).alias("n_alleles"))
    bubbles = told.join(name, "b_no").select("chrom", "start", "end", F.lit(False).alias("is_inversion"), "n_alleles", "seq_short", "seq_long")
    genomes = sorted(r["genome"] for r in about.select("genome").distinct().collect())
    every = merged.withColumn("genome", F.explode(F.array(*map(F.lit, genomes))) if genomes else F.lit(""))
    got = letters.select("b_no", "start", "end", "genome", F.length("allele").cast("long").alias("allele_len"), "contig", "strand", "qs", "qe", F.col("length").alias("contig_len"))
    out = every.join(got, ["b_no", "start", "end", "genome"], "left").join(name, "b_no")
    return bubbles, out.select("chrom", "start", "end", "genome", "allele_len", "contig", "strand", "qs", "qe", "contig_len")
