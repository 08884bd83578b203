"""Problems 7, 8 and 9 on the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.encoding import encode_texts
from cairn.llm.mixing import mix, short_sources
from cairn.llm.reading import document_levels
from cairn.runtime import read_table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids of every document."""
    return encode_texts(read_table(spark, sf_dir, "documents"), "text", ["doc_id"])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources that the plan to fill the token total leaves short."""
    return short_sources(mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"), fill=True)[1])


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the mixture: one row per source of mix_targets."""
    return mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[1]


def p8_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, rate, repeats of every document."""
    return mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[0]


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, words, language, difficulty, top_share, is_top of every document."""
    return document_levels(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "reading_passages"))


def p9_found(spark: SparkSession, sf_dir: str, least_words: int = 50) -> DataFrame:
    return p9_levels(spark, sf_dir).filter((F.col("words") >= least_words) & F.col("is_top")).select("doc_id")


QUERIES = {"p7_ids": p7_ids, "p8_found": p8_found, "p8_shares": p8_shares, "p8_plan": p8_plan, "p9_found": p9_found, "p9_levels": p9_levels}
SQL: dict[str, str] = {}
