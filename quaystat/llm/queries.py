"""The queries opN_<name> over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystat.llm import bpe, decontaminate, hard_negatives, html_text, lattice_lm, line_dedup, near_dup, quality, secrets, simhash, substring_dedup, token_codes, whitening
from quaystat.llm.common import table


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_codes.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), lattice_lm.vocabulary())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), *bpe.vocabulary())


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0)


QUERIES = {
    f.__name__: f
    for f in (op1_token_codes, op2_html_text, op3_lattice_lm, op4_line_dedup, op5_secrets, op6_substring_dedup, op7_quality_rules, op8_near_dup, op9_byte_bpe, op10_decontaminate, op11_simhash, op12_whitening, op13_hard_negatives)
}
ORACLES: dict[str, str] = {
    "op5_secrets": secrets.oracle_sql(),
    "op6_substring_dedup": substring_dedup.oracle_sql(),
    "op7_quality_rules": quality.oracle_sql(),
    "op8_near_dup": near_dup.oracle_sql(),
    "op10_decontaminate": decontaminate.oracle_sql(),
    "op13_hard_negatives": hard_negatives.oracle_sql(),
}
