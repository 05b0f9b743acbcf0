"""The registered queries of this subpackage: one opN_<name> per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import alignment, embedding_join, exact_dedup, filter_audit, html_extract, jaccard_join, language_model, mixing, pii, sentencepiece_viterbi, token_ids, toxicity, warc
from leadloom.llm.common import documents, new_path

#: The public tokenizers' files.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(documents(spark, sf_dir), exact_dedup.fresh_index(spark))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ids")
    token_ids.write(documents(spark, sf_dir), path, WORD_BPE)
    return token_ids.read(spark, path)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(documents(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.digests(documents(spark, sf_dir), PIECE_BPE)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages, looks up every url in the index and reads the records found."""
    pages, path = spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc")
    warc.write(pages, path)
    found = warc.lookup(spark, path, pages.select(warc.url_key(pages["url"]).alias("key")))
    return warc.records(found, path, payload=False).drop("url")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), BYTE_BPE, PIECE_BPE)


QUERIES = {f.__name__: f for f in (op1_language_model, op2_html_extraction, op3_embedding_join, op4_exact_dedup, op5_source_mixing, op6_token_ids, op7_pii, op8_sentencepiece, op9_toxicity, op10_jaccard_join, op11_warc, op12_filter_audit, op13_tokenizer_alignment)}

ORACLE_SQL = {"op3_embedding_join": embedding_join.ORACLE_SQL, "op4_exact_dedup": exact_dedup.ORACLE_SQL, "op5_source_mixing": mixing.ORACLE_SQL, "op11_warc": warc.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL}
