"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.common import table


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.quotes import link_quotes

    return link_quotes(table(spark, sf_dir, "conversations"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.warc import deduplicate_pages

    return deduplicate_pages(table(spark, sf_dir, "pages"))


def op3_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.vectors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.toxicity import rate_toxicity

    return rate_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op6_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandloom.llm.pieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.urlrules import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from strandloom.llm.vectors import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_shingle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.shinglejoin import similar_components

    return similar_components(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from strandloom.llm.multiindex import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents where 5 divides the checksum of the id, the text is tampered with before the proof is folded."""
    from pyspark.sql import functions as F

    from strandloom.llm.merkle import fold, manifest, proof_digest, record_digest

    docs = table(spark, sf_dir, "documents")
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, record_digest(*others, lower))
    rows = manifest(docs, record_digest(*others, F.col("text")), keep={"seen": tampered})
    rows = rows.withColumn("folded_root", fold(F.coalesce("seen", "leaf"), F.col("before"), F.col("after")))
    proof = proof_digest(F.col("before"), F.col("after"))
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quotes, op2_warc_revisits, op3_vector_links, op4_toxicity_chain, op5_language, op6_pack_best_fit, op7_pieces, op8_url_rules, op9_top_k, op10_shingle_components, op11_centroids, op12_multi_index, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    from strandloom.llm import quotes, sql

    return {"op1_quotes": quotes.SQL, "op2_warc_revisits": sql.WARC_REVISITS, "op3_vector_links": sql.VECTOR_LINKS, "op8_url_rules": sql.URL_RULES, "op9_top_k": sql.TOP_K, "op10_shingle_components": sql.SHINGLES, "op11_centroids": sql.CENTROIDS, "op13_merkle_manifest": sql.MERKLE}
