"""What several operators share: white space, written intermediate tables, fixed-size filters."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: The six characters of [\x20\x09-\x0D].
WS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a local master (tests) gets a temporary folder of its own; any other master is an error, since executors would not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(shared_root, "own", None)
        if root is None:
            root = shared_root.own = "file://" + tempfile.mkdtemp(prefix="arbordoc-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _on_store(spark: SparkSession, path: str, what: str, *args) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    getattr(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), what)(p, *args)


#: Paths of the written tables, in the order in which they were made.
_made: list[str] = []


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder, deleted when a surrounding `scratch` ends, else when the driver's JVM ends."""
    path = f"{shared_root(spark)}/arbordoc/{tag}-{uuid.uuid4().hex}"
    _on_store(spark, path, "deleteOnExit")
    _made.append(path)
    return path


def stash(df: DataFrame, tag: str) -> DataFrame:
    """df, written as a Parquet table into the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that were written inside, but for those that the function it gives was called with (a stash each).

    What is kept must not be computed from another of them any more, which a stash isn't. So the disk holds one step's tables at a time.
    """
    before, kept = len(_made), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.stashed_at)
        return table

    try:
        yield keep
    finally:
        own, _made[before:] = _made[before:], []
        for path in own:
            if path in kept:
                _made.append(path)
            else:
                _on_store(spark, path, "delete", True)


def numbered(docs: DataFrame, tag: str) -> DataFrame:
    """docs with its columns named c0, c1, ... and a column `row` that tells rows apart and stays the same at each reading.

    For a plain scan of files that is the place of the row in its file, and nothing is written; other tables are written with a number.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    if _is_scan(docs._jdf.queryExecution().analyzed()):
        meta = docs.metadataColumn("_metadata")
        place = F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("at"))
        try:
            return docs.select(*[docs[f"`{c.replace('`', '``')}`"].alias(n) for c, n in zip(docs.columns, names)], place.alias("row"))
        except AnalysisException:  # files without places for their rows
            pass
    return stash(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), tag)


def _is_scan(plan) -> bool:
    """Does the plan only choose columns and rows of the files under one path? Then no row comes out twice."""
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        if not plan.deterministic():
            return False
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().location().rootPaths().size() == 1 and plan.relation().fileFormat().toString() == "Parquet"


def slot_of(bits: int, *cols: Column | str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << bits))


def bitmap(keys: DataFrame, bits: int, *cols: Column | str) -> DataFrame:
    """The set of key hashes as at most 2**(bits - 6) rows (word, mask): a filter of fixed size, whatever the number of keys.

    It has false positives, never false negatives, so it may only skip work, not decide.
    """
    slot = keys.select(slot_of(bits, *cols).alias("s"))
    return slot.groupBy(F.shiftright("s", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("_mask"))


def with_hit(df: DataFrame, filt: DataFrame, bits: int, out: str, *cols: Column | str) -> DataFrame:
    """df with a boolean column: may the row's key be in the filter? The broadcast side has at most 2**(bits - 6) rows."""
    d = df.withColumn("_slot", slot_of(bits, *cols)).withColumn("_word", F.shiftright("_slot", 6))
    d = d.join(F.broadcast(filt), "_word", "left")
    hit = F.expr("coalesce((shiftright(_mask, cast(_slot & 63 as int)) & 1) = 1, false)")
    return d.withColumn(out, hit).drop("_word", "_slot", "_mask")


def lean(run):
    """run (batches to batches, for mapInArrow), giving free memory back to the system when its task ends: Spark keeps Python workers for later
    tasks, and what the allocators keep in each of them would add up in an executor."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return wrapped


def id_type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()
