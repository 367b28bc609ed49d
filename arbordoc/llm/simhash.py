"""SimHash near-dedup with deletion-variant signatures."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, id_type, lean, load, numbered, scratch, stash, with_hit
from .graph import components

BITS = 64


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[shingle - 1 :]
    starts = np.concatenate([[0], ends[: len(stops) - 1] + 1])
    ones = np.zeros(BITS, np.int64)
    n = len(stops)
    starts, stops = starts.tolist(), stops.tolist()
    for k in range(0, n, 100_000):
        hashes = np.array([h(line[a:b], 42) for a, b in zip(starts[k : k + 100_000], stops[k : k + 100_000])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, row: Column) -> DataFrame:
    """(id, row, fp): the fingerprint of every whole text as a signed 64-bit integer. row: what tells rows apart."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or b"", shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["id", "row", "fp"])

    narrow = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.col(text_col).cast("binary").alias("t"))
    return narrow.mapInArrow(lean(run), f"id {id_type(docs, id_col)}, row {id_type(narrow, 'row')}, fp long")


def scheme(distinct: int, radius: int) -> list[tuple[int, ...]]:
    """Which segments' bits make a signature: lists of bit positions, of which one list at least differs in at most one bit.

    Cut into s segments, two fingerprints within `radius` bits have a segment with at most radius // s differences; s = radius // 2 + 1 is the smallest with
    one bit at most. For more fingerprints a signature has to be longer, or chance pairs would grow with their square: of k + radius - 1 segments (k > 1), some
    k together hold at most one difference, so all choices of k segments are indexed. k grows with the number of fingerprints; every choice is exact.
    """
    k = 1
    while True:
        s = radius // 2 + 1 if k == 1 else k + max(radius, 1) - 1
        cuts = [BITS * i // s for i in range(s + 1)]
        parts = [tuple(b for i in c for b in range(cuts[i], cuts[i + 1])) for c in combinations(range(s), k)]
        if distinct <= 1 << min(len(p) for p in parts) or s >= 12:
            return parts
        k += 1


def variants(fps: DataFrame, parts: list[tuple[int, ...]]) -> DataFrame:
    """(key, fp): for every part and every bit of it, the part with that bit as a wildcard (masked out), hashed with the number of the variant."""
    masks = []
    for p in parts:
        whole = sum(1 << b for b in p)
        masks += [whole & ~(1 << b) for b in p]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    arr = F.array(*[F.lit(m) for m in signed])
    return fps.select("fp", F.posexplode(arr).alias("v", "m")).select(F.xxhash64("v", F.col("fp").bitwiseAND(F.col("m"))).alias("key"), "fp")


def _links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is connected among fps: from each fingerprint reached, to those not reached before. Near copies are reached
    at once, so a dense group costs little more than its size, and no pair within a group is listed twice."""
    out_a, out_b = [], []
    rest = fps
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count((rest ^ x).view(np.uint64)) <= radius  # of signed numbers numpy counts the absolute value's bits
            if near.any():
                found = rest[near]
                out_a.append(np.full(len(found), x))
                out_b.append(found)
                todo += list(found)
                rest = rest[~near]
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64),) * 2


def near_links(fps: DataFrame, radius: int = 4, block: int = 4096, filter_bits: int = 24) -> DataFrame:
    """(a, b): links between different fingerprints at most radius bits apart, enough to connect all that are connected by such links.

    fps: distinct fingerprints (column fp). Every two within radius share a signature key (see scheme). Keys are counted with map-side combining; keys of
    one fingerprint vanish there, keys of two already name their pair. For the rest, a filter of fixed size keeps what doesn't belong to such keys from the
    shuffle; their fingerprints, at most `block`, are gathered by key. Keys with more are told by a filter of their own and counted exactly: they get several
    blocks of about `block`, and each pair of blocks is one row of work.
    Every pair of fingerprints under a key is compared or already known to be connected: no cap, no sampling.
    """
    n = fps.count()
    v = variants(fps, scheme(n, radius))
    keys = stash(v.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "simhash-keys")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius
    two = keys.where(F.col("n") == 2).where(near("a", "b")).select("a", "b")
    many = keys.where("n > 2").select("key", "n")
    hot = many.where(F.col("n") > block)
    mine = with_hit(v, bitmap(many, filter_bits, "key"), filter_bits, "_many", "key").where("_many").select("key", "fp")
    mine = with_hit(mine, bitmap(hot, filter_bits, "key"), filter_bits, "_hot", "key")
    cool = mine.where("not _hot").groupBy("key").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 2").select("fps")
    mine = mine.where("_hot").select("key", "fp").join(many, "key")
    mine = mine.withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("s", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")))
    blocks = mine.groupBy("key", "s").agg(F.first("blocks").alias("blocks"), F.collect_list("fp").alias("fps"))
    big = stash(blocks, "simhash-blocks")
    one = cool.unionByName(big.where("blocks = 1").select("fps")).withColumn("others", F.lit(None).cast("array<long>"))
    l, r = (big.where("blocks > 1").alias(x) for x in "lr")
    pairs = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.s") < F.col("r.s"))).select(F.col("l.fps").alias("fps"), F.col("r.fps").alias("others"))

    def run(batches):
        for b in batches:
            a, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x, y in zip(b.column(0), b.column(1)):
                own = x.values.to_numpy()
                if y.is_valid:
                    own = np.concatenate([own, y.values.to_numpy()])
                p, q = _links(np.unique(own), radius)
                a.append(p)
                c.append(q)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(c))], names=["a", "b"])

    return two.unionByName(one.unionByName(pairs).mapInArrow(lean(run), "a long, b long")).distinct()


def _classes(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id, head): the class of every fingerprint; head is the number of the row that stays. rows: (id, row, fp), written."""
    # of a class, the smallest id (null last) gives component_id, and the first of its rows is the one to keep
    with scratch(rows.sparkSession) as keep:
        nodes = stash(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("low")), "simhash-nodes")
        roots = stash(components(near_links(nodes.select("fp"), radius), "simhash-cc"), "simhash-roots").withColumnRenamed("node", "fp")
        rooted = stash(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-rooted")
        low = rooted.groupBy("root").agg(F.min("low").alias("low"))
        return keep(stash(rooted.select("fp", "root").join(low, "root").select("fp", F.col("low.id").alias("component_id"), F.col("low.row").alias("head")), "simhash-classes"))


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id, keep (one row of each component).

    Texts: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, shingles of `shingle` words (fewer words: the whole sequence), XXH64 with seed 42; a bit is 1 if it is set
    in over half of the shingles' hashes, repeats included. Documents whose fingerprints differ in at most `radius` bits are linked; component_id is the smallest
    id reachable. Documents of equal fingerprint are one node of the graph, so copies cost one row each, not pairs.

    No words (null, empty or white space): fingerprint zero, linked like any other. A component whose ids are all null has component_id null. Repeated rows get the same
    class; keep is true for one of them. An empty table gives an empty result. Other columns are ignored.
    """
    rows = stash(fingerprints(docs, id_col, text_col, shingle, F.monotonically_increasing_id()), "simhash-rows")
    out = rows.join(_classes(rows, radius), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("row") == F.col("head")).alias("keep"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """docs with one row of each class: the one with the smallest id, or one of them if rows repeat an id. All columns stay as they are; for nulls see simhash_classes."""
    d = numbered(docs, "simhash-docs")
    of = dict(zip(docs.columns, d.columns))
    with scratch(docs.sparkSession) as keep:
        rows = stash(fingerprints(d, of[id_col], of[text_col], shingle, F.col("row")), "simhash-rows")
        heads = keep(stash(_classes(rows, radius).select(F.col("head").alias("row")), "simhash-heads"))
    return d.join(heads, "row", "left_semi").select(*of.values()).toDF(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents with fingerprints and components. Null texts have fingerprint zero. See simhash_classes."""
    return simhash_classes(load(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
