"""Token-ID files: Simple-8b words, a table of documents and block offsets, written in id order and read back."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import bpe_of, default_vocabulary, portions
from .common import id_type, lean, load, shared_path, stash
from .simple8b import BLOCK, pack, unpack

MAGIC = b"TOKS8B01"
TAIL = struct.Struct("<6Q8s")  # tokens, words, blocks, documents, bytes of the document table, bytes of the block table


class Writer:
    """Writes one file: header, words, words per block (uint32), Arrow table of (id, n), tail. Readers see it only when it is whole."""

    def __init__(self, root: str, name: str, id_arrow_type: pa.DataType):
        self.fs, base = fs.FileSystem.from_uri(root)
        self.fs.create_dir(base)
        self.path, self.temp = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.rest = np.zeros(0, np.uint32)
        self.per: list[np.ndarray] = []
        self.ids: list[pa.Array] = []
        self.n: list[np.ndarray] = []
        self.type = id_arrow_type
        self.tokens = self.words = 0

    def add(self, ids: pa.Array, n: np.ndarray, tokens: np.ndarray) -> None:
        """Documents, and all their token ids one after the other."""
        self.ids.append(ids)
        self.n.append(n)
        self.tokens += len(tokens)
        tokens = np.concatenate([self.rest, tokens])
        whole = len(tokens) // BLOCK * BLOCK
        self._put(tokens[:whole])
        self.rest = tokens[whole:].copy()

    def _put(self, tokens: np.ndarray) -> None:
        words, per = pack(tokens)
        self.out.write(words.astype("<u8").tobytes())
        self.words += len(words)
        self.per.append(per.astype("<u4"))

    def close(self) -> tuple[int, int, int]:
        self._put(self.rest)
        table = pa.table({"id": pa.chunked_array(self.ids, self.type), "n": pa.array(np.concatenate([*self.n, np.zeros(0, np.int64)]), pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        docs, per = sink.getvalue().to_pybytes(), np.concatenate(self.per)
        self.out.write(per.tobytes() + docs + TAIL.pack(self.tokens, self.words, len(per), len(table), len(docs), per.nbytes, MAGIC))
        self.out.close()
        if self.fs.get_file_info(self.path).type != fs.FileType.NotFound:  # an attempt before wrote the same bytes; not every store moves onto a file
            self.fs.delete_file(self.path)
        self.fs.move(self.temp, self.path)
        return len(table), self.tokens, len(MAGIC) + 8 * self.words + per.nbytes + len(docs) + TAIL.size


def read_file(uri: str, blocks: int = 512):
    """Yields (ids of documents, their numbers of tokens, their tokens one after the other), about `blocks` blocks of words at a time.

    A document longer than that comes in pieces; only the first piece's row has its full number of tokens, and `more` continues it:
    each item is (ids, n, tokens) where sum(n) may exceed len(tokens), the rest following in items without ids.
    """
    f, path = fs.FileSystem.from_uri(uri)
    with f.open_input_file(path) as x:
        x.seek(x.size() - TAIL.size)
        tokens, words, n_blocks, n_docs, doc_bytes, per_bytes, magic = TAIL.unpack(x.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        x.seek(len(MAGIC) + 8 * words)
        per = np.frombuffer(x.read(per_bytes), "<u4").astype(np.int64)
        table = pa.ipc.open_stream(x.read(doc_bytes)).read_all()
        n = table.column("n").to_numpy()
        ends = np.cumsum(n)
        offsets = np.concatenate([[0], np.cumsum(per)])
        done = doc = 0
        for b in range(0, n_blocks, blocks):
            e = min(b + blocks, n_blocks)
            x.seek(len(MAGIC) + 8 * int(offsets[b]))
            got = np.frombuffer(x.read(8 * int(offsets[e] - offsets[b])), "<u8")
            take = min(tokens, e * BLOCK) - done
            ids = unpack(got, per[b:e], take)
            last = int(np.searchsorted(ends, done + take, "left")) + 1 if e < n_blocks else n_docs
            last = min(max(last, doc), n_docs)
            yield table.column("id").slice(doc, last - doc), n[doc:last], ids
            done, doc = done + take, last


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, root: str | None = None) -> DataFrame:
    """Encodes every whole text, appends end_id, and writes the ids in ascending id order. Returns file, uri, n_docs, n_tokens, n_bytes per file.

    Rows are range-partitioned by id (null first) and sorted by id, then text, so that every attempt of a task has them in one order; each task writes one file, batch by batch, and file numbers follow the ids. root: a folder that
    all executors share (default: one under spark.checkpoint.dir). A lost executor's task runs again and replaces its file by an equal one.
    A null or empty text is just end_id. Rows that repeat an id stay apart, in the order of their texts. An empty table gives no file with documents. Other columns are ignored.
    """
    spark = docs.sparkSession
    path, root = vocabulary or default_vocabulary(), root or shared_path(spark, "tokens")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).repartitionByRange(n, "i").sortWithinPartitions("i", "t")

    def run(batches):
        bpe, part = bpe_of(path), TaskContext.get().partitionId()
        name, w = f"tokens-{part:06d}.s8b", None
        for b in batches:
            for p in portions(b, 1):
                ids, k = bpe.encode(p.column(1))
                full = np.full(len(ids) + len(k), end_id, np.uint32)
                ends = np.cumsum(k + 1) - 1
                inner = np.ones(len(full), bool)
                inner[ends] = False
                full[inner] = ids
                w = w or Writer(root, name, p.column(0).type)
                w.add(p.column(0), k + 1, full)
        if w:
            a, t, size = w.close()
            yield pa.RecordBatch.from_pydict({"file": [part], "uri": [f"{root}/{name}"], "n_docs": [a], "n_tokens": [t], "n_bytes": [size]})

    return stash(rows.mapInArrow(lean(run), "file long, uri string, n_docs long, n_tokens long, n_bytes long"), "token-manifest")


def read_tokens(manifest: DataFrame, id_col: str = "doc_id", id_type_name: str = "long") -> DataFrame:
    """From the files: id_col, start (ids of all documents before it), n_tokens (with the end id), ids_crc32. One task reads one file, some blocks at a time.

    Null and repeated ids come back as they were written; a manifest without files gives an empty result."""

    def run(batches):
        for b in batches:
            for file, uri in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                start = open_left = crc = 0
                held = None
                for ids, n, tokens in read_file(uri):
                    raw = tokens.astype("<u4").tobytes()
                    at = min(open_left, len(tokens))
                    if open_left:
                        crc = zlib.crc32(raw[: 4 * at], crc)
                        open_left -= at
                        if not open_left:
                            yield pa.RecordBatch.from_arrays([held[0], *[pa.array([v], pa.int64()) for v in (file, held[1], held[2], crc)]], names=names)
                    if not len(n):
                        continue
                    ends = at + np.cumsum(n)
                    whole = int(np.searchsorted(ends, len(tokens), "right"))
                    sums = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends[:whole].tolist(), n[:whole].tolist())]
                    starts = start + np.cumsum(n) - n
                    if whole:
                        yield pa.RecordBatch.from_arrays([_one(ids.slice(0, whole)), pa.array(np.full(whole, file)), pa.array(starts[:whole]), pa.array(n[:whole]), pa.array(sums, pa.int64())], names=names)
                    if whole < len(n):
                        begin = int(ends[whole] - n[whole])
                        held = (_one(ids.slice(whole, 1)), int(starts[whole]), int(n[whole]))
                        crc, open_left = zlib.crc32(raw[4 * begin :]), int(n[whole]) - (len(tokens) - begin)
                    start += int(n.sum())

    names = ["i", "file", "at", "n_tokens", "ids_crc32"]
    files = max(1, manifest.count())
    rows = manifest.select("file", "uri").repartitionByRange(files, "file").mapInArrow(lean(run), f"i {id_type_name}, file long, at long, n_tokens long, ids_crc32 long")
    # one row per file: as many as write_tokens had partitions
    before = manifest.select("file", (F.sum("n_tokens").over(W.orderBy("file")) - F.col("n_tokens")).alias("before"))
    out = rows.join(F.broadcast(before), "file")
    return out.select(F.col("i").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _one(a: pa.ChunkedArray) -> pa.Array:
    return a.combine_chunks() if a.num_chunks != 1 else a.chunk(0)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, written as token files and read back. Null texts are empty; see write_tokens."""
    docs = load(spark, sf_dir, "documents")
    return read_tokens(write_tokens(docs), "doc_id", id_type(docs, "doc_id"))
