"""Formats as DataFrames. Lines are split and cast by expressions; what can't be cast becomes null instead of an error."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.operators.gates import GateError


def _field(parts: Column, k: int) -> Column:
    return F.get(parts, F.lit(k))


def _long(parts: Column, k: int) -> Column:
    return _field(parts, k).try_cast("long")


def ordered_lines(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """SC10: (file_no, path, value) of every line, comments too, of the files of the patterns, numbered from 0 in their order."""
    from strandloom.sources.runs import expand

    files = expand(spark, patterns)
    if not files:
        return spark.createDataFrame([], "file_no long, path string, value string")
    plain = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    rows = spark.read.text(files).select(plain.alias("path"), "value")
    numbers = spark.createDataFrame([(k, re.sub("^file:/+", "/", f)) for k, f in enumerate(files)], "file_no long, path string")
    return rows.join(F.broadcast(numbers), "path").select("file_no", "path", "value")  # one row a file of the list


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, value) of every line that is neither blank nor a comment."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), "value").where("trim(value) <> '' and not startswith(value, '#')")


def fasta(spark: SparkSession, path: str | list[str], upper: bool = True) -> DataFrame:
    """SC1, SC2: (path, contig, description, seq, len). A record is what follows a ``>`` at a line's beginning, so the reader
    splits files at records, not at lines, and no window over lines is needed."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("path"), F.regexp_replace("value", r"^>", "").alias("value"))
    raw = raw.where("trim(value) <> ''")
    head = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.substring("value", F.length(head) + 1, F.length("value")), r"\s", "")
    out = raw.select("path", F.regexp_extract(head, r"^(\S*)", 1).alias("contig"), F.regexp_replace(head, r"^\S*\s*|\s+$", "").alias("description"), (F.upper(body) if upper else body).alias("seq"))
    return out.withColumn("len", F.length("seq"))


def fetch(seq: Column, start: Column, end: Column) -> Column:
    """SC1: ``[start, end)`` of a sequence; the end is clamped, an inverted range is empty."""
    from strandloom.functions.seq import window

    return window(seq, start, end)


def allele_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SC3: records ``>LOCUS|ALLELE|...`` with gaps removed."""
    f = fasta(spark, path)
    parts = F.split("contig", r"\|")
    return f.select("path", _field(parts, 0).alias("locus_id"), _field(parts, 1).alias("allele_id"), F.regexp_replace("seq", "-", "").alias("seq"))


def paf(df: DataFrame) -> DataFrame:
    """SC4: alignment rows from lines (column value); at least twelve fields; tags ``NN:t:v`` as a map, integer and float
    tags without their padding."""
    p = F.split("value", "\t")
    names = ["qname", "qlen", "qs", "qe", "strand", "tname", "tlen", "ts", "te", "nmatch", "alen", "mapq"]
    cols = [(_field(p, k) if n in ("qname", "strand", "tname") else _long(p, k)).alias(n) for k, n in enumerate(names)]
    tags = F.transform(F.slice(p, 13, F.greatest(F.size(p) - 12, F.lit(0))), lambda t: F.struct(F.split_part(t, F.lit(":"), F.lit(1)).alias("k"), F.regexp_extract(t, r"^[^:]*:[^:]*:(.*)$", 1).alias("v")))
    return df.where((F.size(p) >= 12) & ~F.startswith("value", F.lit("#"))).select(*cols, F.map_from_entries(tags).alias("tags"))


def tsv(spark: SparkSession, path: str | list[str], strict: bool = False, comment: str | None = None) -> DataFrame:
    """SC5, SC6, SC9: tab-separated text with a header, all strings; ``strict`` drops rows of another length."""
    r = spark.read.option("sep", "\t").option("header", True).option("mode", "DROPMALFORMED" if strict else "PERMISSIVE")
    return (r.option("comment", comment) if comment else r).csv(path)


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """SC7: comma-separated if the header has more commas than tabs, whatever the file's name says."""
    first = spark.read.text(path).first()
    head = first["value"] if first else ""
    return spark.read.option("sep", "," if head.count(",") > head.count("\t") else "\t").option("header", True).csv(path)


def edges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SC8: headerless edges (a, b, ani, min_af), both directions; rows without numbers are skipped."""
    p = F.split("value", r"\s+")
    e = lines(spark, path).where(F.size(p) >= 4).select(_field(p, 0).alias("a"), _field(p, 1).alias("b"), _field(p, 2).try_cast("double").alias("ani"), _field(p, 3).try_cast("double").alias("min_af"))
    e = e.where("ani is not null and min_af is not null")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "ani", "min_af"))


def key_from_path(path: Column, suffixes: tuple[str, ...] = (".fna", ".fasta", ".fa", "_events.tsv", ".tsv")) -> Column:
    """SC11: the file's name without the first suffix that it has."""
    name = F.element_at(F.split(path, "/"), -1)
    out = name
    for s in reversed(suffixes):
        out = F.when(F.endswith(name, F.lit(s)), F.substring(name, F.lit(1), F.length(name) - len(s))).otherwise(out)
    return out


def bubbles(df: DataFrame) -> DataFrame:
    """SC12: graph bubbles from numbered lines (line, value); of repeated (chrom, start, end) the last wins."""
    p = F.split("value", "\t")
    b = df.where(F.size(p) >= 8).select("line", _field(p, 0).alias("chrom"), _long(p, 1).alias("start"), _long(p, 2).alias("end"), _long(p, 3).alias("n_seg"), _long(p, 4).alias("n_path"), (_field(p, 5) == "1").alias("is_inversion"), _long(p, 6).alias("len_shortest"), _long(p, 7).alias("len_longest"), F.upper(_field(p, 12)).alias("seq_short"), F.upper(_field(p, 13)).alias("seq_long"))
    last = F.row_number().over(Window.partitionBy("chrom", "start", "end").orderBy(F.desc("line")))
    return b.where("start is not null and end is not null").withColumn("_r", last).where("_r = 1").drop("_r", "line")


def call_record(rec: Column) -> Column:
    """SC13: ``walk:len:strand:contig:qs:qe`` as a struct; ``*`` alone or a missing length is no call, never length 0."""
    p = F.split(rec, ":")
    length = F.coalesce(_long(p, 1), F.regexp_extract(rec, r":(\d+)", 1).try_cast("long"))
    return F.when(F.trim(rec).isin("*", ".", "") | length.isNull(), None).otherwise(
        F.struct(_field(p, 0).alias("walk"), length.alias("allele_len"), F.nullif(_field(p, 2), F.lit("")).alias("strand"), F.nullif(_field(p, 3), F.lit("")).alias("contig"), _long(p, 4).alias("qs"), _long(p, 5).alias("qe"))
    )


def insertions(df: DataFrame, low: int = 300, high: int = 5000) -> DataFrame:
    """SC14: VCF insertions of lines (value): the sequence is ALT without its first base."""
    p = F.split("value", "\t")
    info = F.str_to_map(_field(p, 7), F.lit(";"), F.lit("="))
    size = F.abs(F.try_element_at(info, F.lit("SVLEN")).try_cast("long"))
    v = df.where((F.size(p) >= 8) & ~F.startswith("value", F.lit("#"))).select(_field(p, 0).alias("chrom"), _long(p, 1).alias("pos"), F.try_element_at(info, F.lit("SVTYPE")).alias("svtype"), size.alias("svlen"), F.substring(_field(p, 4), 2, 1 << 30).alias("insert_seq"))
    return v.where((F.col("svtype") == "INS") & F.col("svlen").between(low, high))


def gff_cds(df: DataFrame) -> DataFrame:
    """SC15: coding sequences with 0-based half-open ends."""
    p = F.split("value", "\t")
    return df.where((F.size(p) >= 8) & (_field(p, 2) == "CDS")).select(_field(p, 0).alias("contig"), (_long(p, 3) - 1).alias("start"), _long(p, 4).alias("end"), _field(p, 6).alias("strand"), F.regexp_extract(_field(p, 8), r"ID=([^;]*)", 1).alias("cds_id"))


def gene_headers(df: DataFrame) -> DataFrame:
    """SC16: ``record_k # start # end # strand`` headers (column value, without ``>``)."""
    p = F.split("value", r"\s*#\s*")
    return df.where(F.size(p) >= 4).select(F.regexp_replace(_field(p, 0), r"_[^_]*$", "").alias("record"), _long(p, 1).alias("start"), _long(p, 2).alias("end"), _long(p, 3).alias("strand"))


def tblout(df: DataFrame) -> DataFrame:
    """SC17: model hits; one row per protein with its best score (ties: the smaller query name) and least e-value."""
    p = F.split(F.trim("value"), r"\s+")
    h = df.where((F.size(p) >= 6) & ~F.startswith("value", F.lit("#"))).select(_field(p, 0).alias("target"), _field(p, 2).alias("query"), _field(p, 3).alias("accession"), _field(p, 4).try_cast("double").alias("evalue"), _field(p, 5).try_cast("double").alias("score"))
    best = F.min_by(F.struct("query", "accession", "score"), F.struct(-F.col("score"), F.col("query"))).alias("b")
    return h.where("score is not null").groupBy("target").agg(best, F.min("evalue").alias("evalue")).select("target", "b.query", "b.accession", "b.score", "evalue")


def gff_name(attributes: Column) -> Column:
    """SC18: the ``Name=`` of a GFF attribute column."""
    return F.nullif(F.regexp_extract(attributes, r"(?:^|;)Name=([^;]*)", 1), F.lit(""))


SITE = T.StructType([T.StructField(n, T.StringType()) for n in ("site_id", "bag_id", "species", "flank", "orient", "insert_md5")] + [T.StructField("flank_len", T.IntegerType()), T.StructField("noncoding_regions", T.ArrayType(T.StringType())), T.StructField("inserted_len", T.IntegerType())])


def jsonl_sites(df: DataFrame) -> DataFrame:
    """SC19: sites from JSON lines (value); a line that doesn't parse gives a row of nulls with the text in ``bad``."""
    j = F.from_json("value", SITE, {"mode": "PERMISSIVE"})
    return df.where("trim(value) <> ''").select(j.alias("s"), "value").select("s.*", F.when(F.col("s.site_id").isNull(), F.col("value")).alias("bad"))


def pangraph_paths(df: DataFrame) -> DataFrame:
    """SC20: (name, pos, node) from graphs in JSON (column value); paths may be a map or a list, with two spellings."""
    node = "nodes: array<string>, blocks: array<string>, name: string"
    as_map = F.from_json("value", f"struct<paths: map<string, struct<{node}>>>")
    as_list = F.from_json("value", f"struct<paths: array<struct<{node}>>>")
    rows = df.select(F.coalesce(F.map_values(as_map["paths"]), as_list["paths"]).alias("p")).select(F.inline("p"))
    return rows.select("name", F.posexplode(F.coalesce("nodes", "blocks")).alias("pos", "node"))


def coords(df: DataFrame) -> DataFrame:
    """SC21: alignment coordinates with 1-based starts as 0-based."""
    p = F.split(F.trim("value"), r"\s+")
    return df.select((_long(p, 0) - 1).alias("s1"), _long(p, 1).alias("e1"), (F.least(_long(p, 2), _long(p, 3)) - 1).alias("s2"), F.greatest(_long(p, 2), _long(p, 3)).alias("e2"), F.when(_long(p, 2) <= _long(p, 3), "+").otherwise("-").alias("strand")).where("s1 is not null and s2 is not null")


def ani_shards(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SC22: identity shards, each with its header."""
    return tsv(spark, path).select("Ref_file", "Query_file", *(F.col(c).try_cast("double").alias(c) for c in ("ANI", "Align_fraction_ref", "Align_fraction_query")))


def manifest(paths: list[str]) -> list[str]:
    """SC23: at least two distinct files with unique base names, not compressed; raises before anything is written."""
    names = [re.sub(r"^.*/", "", p) for p in paths]
    if len(paths) < 2 or len(set(paths)) != len(paths) or len(set(names)) != len(names):
        raise GateError("a manifest needs at least two distinct files with unique names")
    if any(n.endswith(".gz") for n in names):
        raise GateError("compressed sequences have no random access")
    return paths


def assembly_stats(contigs: DataFrame) -> DataFrame:
    """SC24: contigs, total, N50 and the N fraction of each file."""
    from strandloom.functions.seq import count_of
    from strandloom.operators.stats import n50

    base = n50(contigs, ["path"], "len")
    ns = contigs.groupBy("path").agg((F.sum(count_of("seq", "Nn")) / F.greatest(F.sum("len"), F.lit(1))).alias("n_fraction"))
    return base.join(ns, "path")
