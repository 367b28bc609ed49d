"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, bitmap, load, stash, with_hit


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, filter_bits: int = 24, digest_all: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without the characters of [\\x20\\x09-\\x0D]. Of equal texts the row with the most
    code points in its original text stays, then the one with the smallest id (a null id last), then any one of identical rows.

    1. One scan writes (length, prefix hash) of every row: 16 bytes a row.
    2. Lengths that occur once are out; of the rest, (length, prefix hash) pairs that occur once are out. The survivors of
       both steps go on as filters of a fixed size (2**filter_bits bits, at most 2**(filter_bits - 6) rows), broadcast.
    3. A second scan hashes the full content of rows that pass the filter only, and groups by (length, full hash). A false positive of
       the filter costs one hash and becomes a group of one. The shuffles carry hashes, never texts.

    digest_all also fills text_sha256 for rows that are unique by length or prefix (else null).
    Hot groups: counting combines on the map side; the join that hands keep_id to the rows has a narrow row side, which AQE can split.
    Nulls: a null text counts as empty; null ids are allowed. An empty table gives an empty result. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("_n", F.translate("_t", WS, ""))
    pre = F.xxhash64(F.substring("_n", 1, prefix_chars))
    narrow = stash(base.select(F.char_length("_n").alias("_len"), pre.alias("_pre")), "exact-keys")
    lens = narrow.groupBy("_len").count().where("count > 1")
    crowded = with_hit(narrow, bitmap(lens, filter_bits, "_len"), filter_bits, "_hit", "_len").where("_hit")
    pairs = crowded.groupBy("_len", "_pre").count().where("count > 1")
    rows = base.select("_id", F.char_length("_t").alias("_cp"), F.char_length("_n").alias("_len"), pre.alias("_pre"), "_n")
    rows = with_hit(rows, bitmap(pairs, filter_bits, "_len", "_pre"), filter_bits, "_hit", "_len", "_pre")
    sha = F.sha2(F.col("_n").cast("binary"), 256)
    rows = rows.select("_id", "_cp", "_len", (sha if digest_all else F.when(F.col("_hit"), sha)).alias("_sha"), "_hit", F.monotonically_increasing_id().alias("_row"))
    rows = stash(rows, "exact-rows")
    best = F.min(F.struct((-F.col("_cp")).alias("a"), F.col("_id").isNull().alias("b"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    # written first, so that the join has an exchange of its own on both sides, and AQE can split the rows of a hot group
    groups = stash(rows.where("_hit").groupBy("_len", "_sha").agg(F.count(F.lit(1)).alias("_size"), best.alias("_best")).where("_size > 1"), "exact-groups")
    out = rows.join(groups, ["_len", "_sha"], "left")
    lone = F.col("_size").isNull()
    return out.select(
        F.col("_id").alias(id_col),
        F.when(lone, F.col("_id")).otherwise(F.col("_best.id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        (lone | (F.col("_best.row") == F.col("_row"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, dropped rows too; every row is hashed, since the result names its hash. Null texts are empty. See exact_dedup."""
    return exact_dedup(load(spark, sf_dir, "documents"), digest_all=True)


OP1_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h
  from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by h) as group_size,
       first_value(doc_id) over w = doc_id as kept, h as text_sha256
from d window w as (partition by h order by cp desc, doc_id)
"""
