"""The corpus pipeline: language, toxicity, near duplicates, packing, each stage one operator of ``strandloom.llm``.

Every stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and is written as Parquet in the
shared folder before the next one reads it. All but the last return the columns of ``documents``. Each decides by row: rows
with equal or null doc_id are documents of their own, no row is returned twice, an empty table gives an empty result, and
columns beyond those of ``documents`` are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import language, packing, shinglejoin, toxicity
from strandloom.llm.common import held_out
from strandloom.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned go on.

    A null text or one without a letter (``und``) goes, and so does one that has too few n-grams of any learned language (the
    model's ``floor``, half of what the least familiar hundredth of its training sample has): other scripts and other
    languages, whatever language is nearest. Where there is nothing to learn from, a letter is enough.
    """
    docs = docs.select(*COLUMNS)
    model = language.fit(docs.withColumn("held_out", held_out()).where("not held_out").select("doc_id", "text", "lang"))
    if not model.languages:
        return docs.where(language.has_letters(F.col("text")))
    told = language.predict(docs, model, COLUMNS)
    return told.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("familiar") >= model.floor)).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain holds for toxic go; a null or empty text stays, and without labels every text does."""
    docs = docs.select(*COLUMNS)
    chain = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, chain, COLUMNS).where(F.col("p_toxic") < chain.threshold).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents one row stays: that with the smallest doc_id (null is smaller than any).

    Rows are numbered in a written copy of the table, and the components are those of the numbers, so that rows with equal
    doc_id are told apart. Texts without words are like nothing and stay.
    """
    rows = materialize(docs.select(*COLUMNS).withColumn("row_", F.monotonically_increasing_id()), "numbered")
    parts = shinglejoin.similar_components(rows, id_col="row_").select(F.col("doc_id").alias("row_"), "component_id")
    parts = rows.select("row_", "doc_id").join(parts, "row_")
    kept = parts.groupBy("component_id").agg(F.min(F.struct("doc_id", "row_")).alias("first")).select("first.row_")
    return rows.join(kept, "row_", "left_semi").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences; a null text is its end id alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", keep_known_language), ("toxicity", drop_toxic), ("near_duplicates", keep_one_of_each), ("packing", pack)]

#: SQL expresses neither the trained models nor the packing; run() is tested against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the pieces of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
