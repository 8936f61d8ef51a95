"""From raw documents to token digests: quality rules, line dedup, near-dedup, decontamination, byte-level BPE.

Every stage takes all that its predecessor kept; all but the last return the columns of documents.

Rows that share an id are rows of their own in every stage: each stays or goes by its own text. A null or empty text, or one
without words, goes with the quality rules. A row with a null id links nothing, loses no lines and stays. Of repeated
rows all stay or all go. Columns of any names are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystat.llm import bpe, decontaminate, line_dedup, near_dup, quality
from quaystat.llm.common import table, written

#: Least similarity, in percent, of two documents of which one goes.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one has; n_chars follows the text."""
    out = line_dedup.deduplicated(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest id."""
    return near_dup.drop_copies(docs, percent=NEAR_PERCENT)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage to speak of."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its number of tokens and digests of ids and of the decoded bytes."""
    return bpe.encode_digests(docs, *bpe.vocabulary())


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontaminate", drop_benchmark), ("byte_bpe", byte_bpe)]

#: Links of documents and lines are transitive: plain SQL can't express the stages (see tests/llm).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
