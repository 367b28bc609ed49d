"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, load, numbered, scratch, stash


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, n) -> source, n, target: shares of the total by weight, each at most cap times the source's own size.

    Sources by code point (null last) weigh weights[0], weights[1], ... in turn. What a capped source can't take is shared again by weight among
    the others until none is above its cap. That ends where target = min(cap * n, level * weight); the capped sources are those with the
    smallest cap * n / weight, so one running sum over the sources finds the level. One row per source; sources are few beside documents.
    """
    k = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1, F.lit(k)) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("c", (F.col("n") * cap).cast("double"))
    order = W.orderBy(F.col("c") / F.col("w"), F.col("source").isNull(), "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    all_ = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = (
        s.withColumn("total", F.sum("n").over(all_).cast("double"))
        .withColumn("left_c", F.col("total") - F.coalesce(F.sum("c").over(before), F.lit(0.0)))
        .withColumn("left_w", F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("open", F.col("c") * F.col("left_w") > F.col("left_c") * F.col("w"))
    )
    first = F.min(F.when(F.col("open"), F.struct(F.col("c") / F.col("w"), F.col("source").isNull(), "source", "left_c", "left_w"))).over(all_)
    s = s.withColumn("f", first)
    share = F.col("f.left_c") * F.col("w") / F.col("f.left_w")
    return s.select("source", "n", F.when(F.col("f").isNull(), F.col("c")).otherwise(F.least("c", share)).alias("target"))


def _line(rows: DataFrame, weights: tuple[float, ...], cap: int, seed: str) -> DataFrame:
    """rows (_id, _s source, _z size, _row) with _sn, the source's size, its _target and each row's _copies. See mix."""
    spark = rows.sparkSession
    with scratch(spark) as keep:
        rows = stash(rows, "mix-sizes")
        targets = keep(stash(source_targets(rows.groupBy(F.col("_s").alias("source")).agg(F.sum("_z").alias("n")), weights, cap), "mix-targets"))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        line = rows.repartitionByRange(n, "_s", "_z", "_id", "_row").sortWithinPartitions("_s", "_z", "_id", "_row")
        line = keep(stash(line.withColumn("_at", F.monotonically_increasing_id()), "mix-line")).withColumn("_p", F.shiftright("_at", 33))
    starts = line.groupBy("_s", "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    starts = starts.withColumn("_before", F.sum("_n").over(W.partitionBy("_s").orderBy("_p")) - F.col("_n"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("source", F.lit("\0null"))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    t = targets.select(F.col("source").alias("_ts"), F.col("n").alias("_sn"), F.col("target").alias("_target"), offset.alias("_u"))
    starts = starts.join(t, F.col("_s").eqNullSafe(F.col("_ts")), "left").select(F.coalesce("_s", F.lit("")).alias("_sk"), F.col("_s").isNull().alias("_sn0"), "_p", "_from", "_before", "_sn", "_target", "_u")
    j = line.withColumn("_sk", F.coalesce("_s", F.lit(""))).withColumn("_sn0", F.col("_s").isNull()).join(starts, ["_sk", "_sn0", "_p"])
    k = (F.col("_before") + F.col("_at") - F.col("_from")).cast("double")
    r = F.when(F.col("_sn") > 0, F.col("_target") / F.col("_sn")).otherwise(F.lit(0.0))
    copies = (F.floor((k + 1) * r + F.col("_u")) - F.floor(k * r + F.col("_u"))).cast("long")
    return j.select("_id", "_row", "_z", "_sn", "_target", copies.alias("_copies"))


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("_z")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """One row per input row: id, size, source_size, target, copies, taken (= copies * size). Other columns are ignored.

    Every document of a source has the same expected number of copies, target / source_size (at most cap). Within a source, documents lie by size,
    then id; the prefix sum of expected copies plus one random offset of the source gives floor(after) - floor(before) copies. As sizes
    rise along the line, the words taken differ from the target by less than the source's longest document.

    The line is not built in one task: narrow rows (source, size, id) are range-partitioned and sorted, numbered inside their partition, and each (partition, source)
    gets the number of rows before it. Reruns agree, since a row's number doesn't depend on how the partitions were cut.
    Nulls: a null text has size 0; null sources form one source; null ids come first. Repeated rows count each.
    An empty table gives an empty result; a source of size 0 gets target 0 and no copies.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_s"), _size(F.col(text_col)), F.monotonically_increasing_id().alias("_row"))
    m = _line(rows, weights, cap, seed)
    return m.select(F.col("_id").alias(id_col), F.col("_z").alias("size"), F.col("_sn").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_z")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: every input column, each row as often as the mix takes it (0 to cap times). For nulls, ties and empty tables see mix.

    Only narrow rows go through the sort; the numbers of copies meet the whole rows in one join by the place of the row, since ids need not be unique.
    """
    d = numbered(docs, "mix-docs")
    of = dict(zip(docs.columns, d.columns))
    rows = d.select(F.col(of[id_col]).alias("_id"), F.col(of[source_col]).cast("string").alias("_s"), _size(F.col(of[text_col])), F.col("row").alias("_row"))
    taken = _line(rows, weights, cap, seed).where("_copies > 0").select(F.col("_row").alias("row"), F.col("_copies").cast("int").alias("_copies"))
    out = d.join(taken, "row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select(*of.values()).toDF(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, one row each, with the words that the mix takes. Null texts have size 0, null sources come last. See mix."""
    return mix(load(spark, sf_dir, "documents"))


OP4_SQL = r"""
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
per as (
  select source, sum(size)::double as n, (((row_number() over (order by source nulls last) - 1) % 3) + 1)::double as w
  from d group by source),
rounds(k, source, n, w, target, capped) as (
  select 0, source, n, w, (sum(n) over ()) * w / (sum(w) over ()), false from per
  union all
  select k + 1, source, n, w,
         case when capped or target > 3 * n then 3 * n
              else ((sum(n) over ()) - (sum(case when capped or target > 3 * n then 3 * n else 0 end) over ())) * w
                   / (sum(case when capped or target > 3 * n then 0 else w end) over ()) end,
         capped or target > 3 * n
  from rounds where k <= (select count(*) from per)),
goal as (
  select source, n, target,
         ('0x' || substr(md5('mix' || coalesce(source, chr(0) || 'null')), 1, 8))::bigint / 4294967296.0::double as u
  from rounds where k = (select max(k) from rounds)),
line as (
  select d.doc_id, d.size, g.n, g.target, g.u, case when g.n > 0 then g.target / g.n else 0.0::double end as r,
         (row_number() over (partition by d.source order by d.size, d.doc_id) - 1)::double as i
  from d join goal g on d.source is not distinct from g.source)
select doc_id, size, n::bigint as source_size, target,
       (floor((i + 1) * r + u) - floor(i * r + u))::bigint as copies,
       (floor((i + 1) * r + u) - floor(i * r + u))::bigint * size as taken
from line
"""
