"""Carriers of elements, empty sites by excision, canonical flanks, and bags of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators.contain import containment_join

HALF = 60


def carriers(texts: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, source, lang, item_id, at, size, text, item_text): the first place of each element in each carrier."""
    items = elements.select("item_id", F.col("text").alias("item_text"))
    hits = containment_join(texts.select("doc_id", "source", "lang", "text"), items)
    return hits.withColumn("size", F.length("item_text").cast("long"))


def sites(hits: DataFrame, half: int = HALF) -> DataFrame:
    """The empty site of each carrier: the element excised, ``half`` letters on both sides joined, as a canonical sequence.

    A flank is never padded; where it is cut off by the end of the text, ``flank_complete`` is false.
    """
    empty = seq.excise("text", F.col("at"), F.col("at") + F.col("size"))
    joined = seq.window(F.col("empty"), F.col("at") - half, F.col("at") + half)
    out = hits.withColumn("empty", empty).withColumn("pre", seq.dna(joined))
    complete = (F.col("at") >= half) & (F.length("empty") >= F.col("at") + half)
    return out.withColumn("flank", seq.canonical("pre")).withColumn("orient", seq.orientation("pre")).withColumn("flank_complete", complete)


def bags(site_rows: DataFrame) -> DataFrame:
    """One row per (bag, flank): the first carrier, and how many carriers, species and alleles the site has."""
    return site_rows.groupBy("item_id", "flank").agg(
        F.min("doc_id").alias("first_doc"),
        F.count("*").alias("n_carriers"),
        F.countDistinct("source").alias("n_species"),
        F.countDistinct(F.md5("text")).alias("n_alleles_at_site"),
        F.bool_and("flank_complete").alias("flank_complete"),
    )
