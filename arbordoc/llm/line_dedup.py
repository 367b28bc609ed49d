"""Reversible line dedup: exact reference-count tables, with sharded cuckoo filters in front of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_type, lean, load, stash
from .cuckoo import CuckooFilter, Full

SHARD_KEYS = 1 << 16
BLOCK_REFS = 1 << 16


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(k1, k2, doc): the 128-bit hash of each different key of each document that is long enough to count."""

    def run(batches):
        for b in batches:
            ids, hashes = [], []
            for i, text in zip(range(b.num_rows), b.column(1)):
                keys = {k for line in (text.as_py() or b"").split(b"\n") if _long_enough(k := line.strip().lower(), min_chars)}
                hashes += [xxhash.xxh3_128_digest(k) for k in keys]
                ids += [i] * len(keys)
            k = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), b.column(0).take(pa.array(ids, pa.int64()))], names=["k1", "k2", "doc"])

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("t")).where("doc is not null").mapInArrow(lean(run), f"k1 long, k2 long, doc {id_type(docs, id_col)}")


class LineIndex:
    """Which lines occur in which documents, and which of them are repeated.

    refs: (k1, k2, doc), the exact reference table, one row per key and document.
    counts: (k1, k2, n, top), the exact reference count of each key and the largest document that holds it.
    filters: (shard, blob), cuckoo filters of the keys with n >= min_docs, about shard_keys keys to a shard (shard = k1 mod shards).
    All three are tables in the shared folder. insert() and delete() give a new index and leave the old one valid, so both can be undone:
    deleting what was inserted restores every count, and so every decision. Filters decide nothing: they spare most rows the join with
    the counts, which then decides.
    """

    def __init__(self, spark, refs, counts, filters, shards, min_docs, min_chars, shard_keys):
        self.spark, self.refs, self.counts, self.filters, self.shards, self.min_docs, self.min_chars, self.shard_keys = spark, refs, counts, filters, shards, min_docs, min_chars, shard_keys

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20, shard_keys: int = SHARD_KEYS) -> "LineIndex":
        refs = stash(line_keys(docs, id_col, text_col, min_chars).dropDuplicates(), "line-refs")
        counts = stash(refs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("top")), "line-counts")
        new = cls(refs.sparkSession, refs, counts, None, 0, min_docs, min_chars, shard_keys)
        new._build_filters()
        return new

    def _build_filters(self) -> None:
        hot = self.counts.where(F.col("n") >= self.min_docs)
        self.shards, least = max(1, -(-hot.count() // self.shard_keys)), self.shard_keys // 2
        self.filters = stash(_grouped(hot.select("k1", self._shard().alias("shard")), lambda t: _built(t, least)), "line-filters")

    def _shard(self):
        return F.pmod("k1", F.lit(self.shards))

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> "LineIndex":
        """Adds documents. Inserting what is there already changes nothing."""
        new = line_keys(docs, id_col, text_col, self.min_chars).dropDuplicates().join(self.refs, ["k1", "k2", "doc"], "left_anti")
        new = stash(new, "line-new")
        add = new.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("dn"), F.max("doc").alias("dtop"))
        c = self.counts.join(add, ["k1", "k2"], "full").withColumn("n0", F.coalesce("n", F.lit(0)))
        c = c.select("k1", "k2", (F.col("n0") + F.coalesce("dn", F.lit(0))).alias("n"), F.greatest("top", "dtop").alias("top"), "n0")
        return self._moved(stash(self.refs.unionByName(new), "line-refs"), c)

    def delete(self, ids: DataFrame) -> "LineIndex":
        """Removes documents by id (the first column of ids). Ids that aren't there change nothing."""
        gone = ids.select(F.col(ids.columns[0]).alias("doc")).dropDuplicates()
        left = stash(self.refs.join(gone, "doc", "left_anti").select("k1", "k2", "doc"), "line-refs")
        now = left.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("dn"), F.max("doc").alias("dtop"))
        c = self.counts.join(now, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("dn", F.lit(0)).alias("n"), F.col("dtop").alias("top"), F.col("n").alias("n0"))
        return self._moved(left, c)

    def _moved(self, refs: DataFrame, c: DataFrame) -> "LineIndex":
        """The index after a change; c: the new counts with the old count n0. Filters get or lose the keys that crossed min_docs."""
        c = stash(c, "line-changed")
        counts = c.where("n > 0").select("k1", "k2", "n", "top")
        new = LineIndex(self.spark, refs, counts, None, self.shards, self.min_docs, self.min_chars, self.shard_keys)
        m = self.min_docs
        moved = c.where((F.col("n") >= m) != (F.col("n0") >= m)).select("k1", (F.col("n") >= m).alias("up"), self._shard().alias("shard"))
        both = moved.withColumn("blob", F.lit(None).cast("binary")).unionByName(self.filters.select(F.lit(None).cast("long").alias("k1"), F.lit(None).cast("boolean").alias("up"), "shard", "blob"))
        most = self.shard_keys
        new.filters = stash(_grouped(both, lambda t: _changed(t, most)), "line-filters")
        if not new.filters.where("blob is null").isEmpty():
            new._build_filters()  # a shard has outgrown its filter: build all anew, with more shards
        return new

    def hits(self, block: int = BLOCK_REFS) -> DataFrame:
        """The references whose key is in its shard's filter: those of all repeated keys, and few others.

        References meet filters by shard, at any number of shards, and no filter passes through the driver. A shard's references come in blocks of about
        `block`, dealt by document, so neither a hot line nor a large shard lands in one task.
        """
        refs = self.refs.withColumn("shard", self._shard())
        sized = self.filters.join(refs.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")), "shard")
        sized = stash(sized, "line-sized")
        dealt = refs.join(sized.select("shard", "blocks"), "shard").withColumn("b", F.pmod(F.xxhash64("doc", "k2"), F.col("blocks")))
        dealt = dealt.groupBy("shard", "b").agg(F.collect_list(F.struct("k1", "k2", "doc")).alias("refs"))

        def probe(batches):
            for b in batches:
                for refs, blob in zip(b.column(0), b.column(1)):
                    rows = pa.RecordBatch.from_struct_array(refs.values)
                    yield rows.filter(pa.array(CuckooFilter.loads(blob.as_py()).contains(rows.column(0).to_numpy())))

        return dealt.join(sized.select("shard", "blob"), "shard").select("refs", "blob").mapInArrow(lean(probe), self.refs.schema)

    def drops(self) -> DataFrame:
        """(doc, keys): per document, the 16-byte keys whose lines go. Keys in at least min_docs documents stay in the largest one only."""
        refs = self.hits()
        hot = self.counts.where(F.col("n") >= self.min_docs).select("k1", "k2", "top")
        gone = refs.join(hot, ["k1", "k2"]).where("doc < top")
        key = F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("k1", "k2")])
        return gone.groupBy("doc").agg(F.collect_list(key).alias("keys"))

    def rewrite(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """docs (all inserted before), with the text that stays in text_col, and n_lines, n_dropped added under names that docs doesn't have."""
        names = dict(zip(docs.columns, [f"c{i}" for i in range(len(docs.columns))]))
        d = docs.select([F.col(c).alias(names[c]) for c in docs.columns])
        d = d.join(self.drops().withColumnRenamed("doc", "_doc"), F.col(names[id_col]) == F.col("_doc"), "left").drop("_doc")
        d = d.withColumn(names[text_col], F.col(names[text_col]).cast("binary"))
        text_at, keys_at, min_chars = list(names).index(text_col), len(names), self.min_chars

        def run(batches):
            for b in batches:
                texts, n_lines, n_dropped = [], [], []
                for t, keys in zip(b.column(text_at), b.column(keys_at)):
                    t, gone = t.as_py(), keys.as_py()
                    n = (t or b"").count(b"\n") + 1
                    if gone:
                        gone = set(gone)
                        kept = [x for x in t.split(b"\n") if not (_long_enough(k := x.strip().lower(), min_chars) and _stored(k) in gone)]
                        texts.append(b"\n".join(kept))
                        n_dropped.append(n - len(kept))
                    else:
                        texts.append(t)
                        n_dropped.append(0)
                    n_lines.append(n)
                cols = [c for i, c in enumerate(b.columns) if i != keys_at]
                cols[text_at] = pa.array(texts, pa.binary()).cast(pa.string(), safe=False)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=schema.names)

        schema = T.StructType([T.StructField(names[c], T.StringType() if c == text_col else docs.schema[c].dataType) for c in docs.columns] + [T.StructField("n0", T.LongType()), T.StructField("n1", T.LongType())])
        out = d.mapInArrow(lean(run), schema)
        new = []
        for c in ("n_lines", "n_dropped"):
            while c in docs.columns or c in new:
                c += "_"
            new.append(c)
        return out.toDF(*docs.columns, *new)


def _stored(key: bytes) -> bytes:
    d = xxhash.xxh3_128_digest(key)
    return d[7::-1] + d[:7:-1]


def _grouped(df: DataFrame, f) -> DataFrame:
    return df.groupBy("shard").applyInArrow(f, "shard long, blob binary")


def _out(shard, filt: CuckooFilter | None) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int64()), "blob": pa.array([filt and filt.dumps()], pa.binary())})


def _built(t: pa.Table, least: int) -> pa.Table:
    keys = t.column("k1").to_numpy()
    n = max(len(keys), least)
    while True:
        f = CuckooFilter.sized(n)
        try:
            f.insert(keys)
            return _out(t.column("shard")[0].as_py(), f)
        except Full:
            n *= 2


def _changed(t: pa.Table, most: int) -> pa.Table:
    blobs = t.column("blob").drop_null()
    f = CuckooFilter.loads(blobs[0].as_py()) if len(blobs) else CuckooFilter.sized(most)
    up = t.column("up")
    try:
        for way, do in ((False, f.delete), (True, f.insert)):
            k = t.column("k1").filter(pc.fill_null(pc.equal(up, way), False)).to_numpy()
            if len(k):
                do(k)
    except Full:
        return _out(t.column("shard")[0].as_py(), None)
    return _out(t.column("shard")[0].as_py(), f)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """docs without repeated lines: index all of docs, then rewrite it. Adds n_lines and n_dropped (see LineIndex.rewrite).

    A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. Keys of at least min_chars code points found in at least
    min_docs different documents lose all their lines except in the largest id that holds them. A null text stays null and counts as one empty line;
    rows with a null id keep all lines and count for no key; rows that repeat an id are one document. An empty table gives an empty result.

    Hot lines: counting combines on the map side; the join of references with counts has a narrow, splittable reference side.
    """
    return LineIndex.build(docs, id_col, text_col, min_docs, min_chars).rewrite(docs, id_col, text_col)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents; a null text counts as one empty line. See line_dedup."""
    out = line_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
r as (select key, max(doc_id) as top from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
f as (select k.doc_id, k.pos, k.line, r.top is not null and k.doc_id <> r.top as gone from k left join r using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from f group by doc_id
"""
