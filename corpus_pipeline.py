"""From documents to token ids in five stages, each an operator of the llm subpackage on what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordoc.llm.bpe import round_trip
from arbordoc.llm.common import load, scratch, stash
from arbordoc.llm.line_dedup import line_dedup
from arbordoc.llm.mixing import mixed_rows
from arbordoc.llm.simhash import simhash_dedup
from arbordoc.llm.toxicity import drop_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Null and empty texts score what the model's bias gives; rows with null ids and repeated rows are judged each; an empty table stays empty."""
    return drop_toxic(docs.select(*COLUMNS), load(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that three or more documents share (but for the last of these documents); n_chars follows the text.

    Null texts stay null; rows with a null id keep all lines; rows that repeat an id are one document; an empty table stays empty."""
    out = line_dedup(docs.select(*COLUMNS))
    shorter = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", shorter).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the smallest id (null last), one row of those that repeat it. Null texts and texts without words are copies of each other; an empty table stays empty."""
    return simhash_dedup(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or up to three times. Null texts have size 0 and null sources are one source; repeated rows count each; an empty table stays empty."""
    return mixed_rows(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row (little-endian unsigned 32-bit integers), with a digest of the text that they decode to. A null text has no ids; rows stay as they are; an empty table stays empty."""
    return round_trip(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", repeated_lines),
    ("simhash", near_duplicates),
    ("mixing", mixing),
    ("bpe", tokens),
]

#: SQL can express neither the trained classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage keeps is written as Parquet into the shared folder and read again, and the tables that it needed are deleted."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stash(stage(spark, docs, sf_dir), f"pipeline-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
