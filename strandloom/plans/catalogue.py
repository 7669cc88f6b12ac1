"""Alleles, events, mobility and the catalogue: exact copies of texts are alleles, their sources species, languages panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators.ranking import dense_ids
from strandloom.session import materialize, spread


def alleles(docs: DataFrame) -> DataFrame:
    """(source, md5, allele, carriers, size): distinct texts of a source, labelled by carriers, then length, then digest."""
    a = docs.groupBy("source", F.md5("text").alias("md5")).agg(F.count("*").alias("carriers"), F.first(F.length("text")).cast("long").alias("size"))
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("carriers"), "size", "md5"))
    label = F.when(F.col("r") <= 26, F.chr(64 + F.col("r"))).otherwise(F.concat(F.lit("A"), (F.col("r") - 26).cast("string")))
    return a.withColumn("r", r).withColumn("allele", label).drop("r")


def loci(docs: DataFrame) -> DataFrame:
    """(locus, species, panel, insert_key, context_key, inserted_len, contig): a document as a locus.

    The insert is the text after its first 100 letters, the context those letters; both keys are free of the strand. A
    context below 100 letters gives no key.
    """
    docs = spread(docs.select("doc_id", "source", "lang", "text"))
    s = docs.select(F.col("doc_id").alias("locus"), F.col("source").alias("species"), F.concat_ws("/", "source", "lang").alias("panel"), seq.dna("text").alias("s"))
    insert, context = F.substring("s", F.lit(101), F.length("s")), F.left("s", F.lit(100))
    keyed = s.withColumn("insert_key", seq.canon_key(insert)).withColumn("context_key", F.when(F.length("s") >= 100, seq.canon_key(context)))
    keyed = keyed.withColumn("inserted_len", F.greatest(F.length("s") - 100, F.lit(0)).cast("long")).drop("s")
    return materialize(keyed, "loci")  # keys are costly and filtered on: else a filter computes them again


def deduplicate(locus_rows: DataFrame) -> DataFrame:
    """(event_id, insert_key, context_key, n_loci, n_panels): loci with one key pair are one event; ids follow the keys."""
    kept = locus_rows.where("context_key is not null and insert_key <> ''")
    events = kept.groupBy("insert_key", "context_key").agg(F.count("*").alias("n_loci"), F.countDistinct("panel").alias("n_panels"))
    # ids are dealt by range, which reads its input twice
    numbered = dense_ids(materialize(events, "events"), ["insert_key", "context_key"])
    return numbered.withColumn("event_id", F.concat(F.lit("E"), F.lpad(F.col("no").cast("string"), 6, "0"))).drop("no")


def mobility(events: DataFrame) -> DataFrame:
    """``m2_cross_event``: whether the insert occurs at another event too; an empty key is false."""
    other = events.groupBy("insert_key").agg(F.count("*").alias("n_events_with_key"))
    joined = events.join(other, "insert_key")
    return joined.withColumn("m2_cross_event", (F.col("n_events_with_key") > 1) & (F.col("insert_key") != ""))


def catalogue(locus_rows: DataFrame, events: DataFrame) -> DataFrame:
    """One row per event: its first locus, with mobility and support as columns. Nothing is filtered."""
    first = F.min(F.struct("locus", "species", "panel", "inserted_len")).alias("f")
    reps = locus_rows.groupBy("insert_key", "context_key").agg(first, F.countDistinct("species").alias("n_species"))
    out = mobility(events).join(reps, ["insert_key", "context_key"])
    clean = F.col("f.inserted_len") % 7 != 0
    return out.select("event_id", F.col("f.locus").alias("locus"), F.col("f.species").alias("species"), F.col("f.panel").alias("panel"), F.col("f.inserted_len").alias("inserted_len"), "n_loci", "n_panels", "n_species", "m2_cross_event", clean.alias("s1_clean"), (clean & F.col("m2_cross_event")).alias("usable"))
