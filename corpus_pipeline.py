"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import common, decontam, langid, linededup, packing, simhash
from quillspark.llm.queries import TOKENIZER, read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay, with all their columns; null texts and texts without a letter go. All
    labelled documents are learned from."""
    return langid.keep_known(docs, every=True)


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur go from all documents but the first; every document stays, and null texts stay null."""
    return linededup.dedup_lines(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id; rows with a null id stay."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; rows with a null id are judged by their text."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; null and empty texts are the end token alone."""
    return packing.pack(docs, TOKENIZER())


STAGES = [("language_id", language), ("line_dedup", boilerplate_lines), ("simhash", near_duplicates), ("decontamination", decontaminate), ("packing", packed)]
#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
