"""Table-level lookups: prefix scans, ranks in key order, references, pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

#: A dictionary side is broadcast only when it is known to be at most this large.
BROADCAST_BYTES = 64 << 20


def prefix_scan(df: DataFrame, key_col: str, prefix: str, limit: int | None = None) -> DataFrame:
    """Rows whose key begins with prefix ('' matches all but NULL). The filter reaches the Parquet scan as StringStartsWith. limit: stop early."""
    out = df.where(F.col(key_col).isNotNull() & F.startswith(F.col(key_col), F.lit(prefix)))
    return out if limit is None else out.limit(limit)


def prefix_bounds(df: DataFrame, key_col: str, prefix: str) -> DataFrame:
    """The same rows by a range of keys in byte order, which row groups sorted by key are skipped by."""
    out = df.where(F.col(key_col) >= prefix)
    raw = prefix.encode()
    while raw and raw[-1] >= 0x7F:  # only an ASCII byte can be raised and stay text
        raw = raw[:-1]
    if raw:
        out = out.where(F.col(key_col) < (raw[:-1] + bytes([raw[-1] + 1])).decode())
    return out.where(F.startswith(F.col(key_col), F.lit(prefix)))


def sorted_rank(df: DataFrame, key_col: str, *ties: str, rank: str = "rank") -> DataFrame:
    """df with each row's position, from 0, in byte order of the key.

    Not one window over all rows: rows are range-partitioned and sorted, each partition counts its own, and a sum over the partitions (a few rows)
    gives where each begins. The sorted rows are written once, since both read them and a row's number must be the same in each.
    """
    order = [F.col(key_col), *[F.col(t) for t in ties]]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    line = cut(line).withColumn("_p", F.shiftright("_at", 33))
    per = line.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: as many as shuffle partitions
    start = per.withColumn("_start", F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).select("_p", "_start")
    out = line.join(F.broadcast(start), "_p")
    return out.withColumn(rank, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_at", "_start")


def resolve_refs(df: DataFrame, ref_col: str, dictionary: DataFrame, name_col: str, value_col: str, out: str = "value", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with the dictionary's value of each name; unknown names give NULL. The dictionary is broadcast if its size, as planned, is at most max_bytes; else both sides shuffle."""
    d = dictionary.select(F.col(name_col).alias("_name"), F.col(value_col).alias(out))
    size = int(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.join(F.broadcast(d) if size <= max_bytes else d, F.col(ref_col) == F.col("_name"), "left").drop("_name")


def follow_pointers(nodes: DataFrame, id_col: str, target_col: str, hops: int = 100) -> DataFrame:
    """(id, final): where each node leads when pointers are followed, at most `hops` times; NULL for a circle.

    By doubling: each round joins the table with itself, so chains of length n take log n rounds. Each round is written, so a plan holds one join,
    and rounds end when no pointer moves any more.
    """
    cur = nodes.select(F.col(id_col).alias("id"), F.coalesce(F.col(target_col), F.col(id_col)).alias("to"))
    done = 1
    while done < hops:
        nxt = cur.select(F.col("id").alias("_i"), F.col("to").alias("_t"))
        cur = cut(cur.join(nxt, F.col("to") == F.col("_i"), "left").select("id", F.coalesce("_t", "to").alias("to"), (F.col("_t") != F.col("to")).alias("moved")))
        done *= 2
        if cur.where("moved").isEmpty():
            break
        cur = cur.drop("moved")
    ends = nodes.where(F.col(target_col).isNull()).select(F.col(id_col).alias("_e"))
    return cur.join(ends, F.col("to") == F.col("_e"), "left").select(F.col("id").alias(id_col), F.col("_e").alias("final"))
