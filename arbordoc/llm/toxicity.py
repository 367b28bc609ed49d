"""Toxicity: averaged bags of subword embeddings under a linear softmax, trained in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_type, lean, load

BUCKETS = 1 << 17  # the hashes' top 17 bits
DIM = 8
EDGE = "".join(chr(i) for i in range(33, 128) if not chr(i).isalnum())


GRAMS = (3, 4, 5)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every subword: each word itself, and its character n-grams of 3 to 5, with marks at both ends. A misspelling keeps most of them.

    Hashes are rolled over all words at once, as one array of code points.
    """
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    marked = [f"<{w.strip(EDGE) or w}>" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    c = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    start = np.cumsum(size) - size
    own = np.repeat(np.arange(len(words), dtype=np.int32), size)
    left = np.repeat(start + size, size) - np.arange(len(c))  # characters from here to the word's end
    power = np.cumprod(np.full(int(size.max()), _STEP))
    h = [np.add.reduceat(c * power[np.arange(len(c)) - np.repeat(start, size)], start)]
    at = [np.arange(len(words), dtype=np.int32)]
    rolled = c
    for n in range(2, GRAMS[-1] + 1):
        rolled = rolled[:-1] * _STEP + c[n - 1 :]
        if n in GRAMS:
            ok = left[: len(rolled)] >= n
            h.append(rolled[ok] + np.uint64(n))
            at.append(own[: len(rolled)][ok])
    x = np.concatenate(h)
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return np.concatenate(at), (x >> np.uint64(64 - 17)).astype(np.int32)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


@dataclass
class Model:
    """The mean over words of the mean over subwords of u, plus bias, is the log-odds of the label; u = scaled embedding . (softmax row 1 - row 0)."""

    u: np.ndarray
    bias: float

    def score_words(self, words: list[str]) -> np.ndarray:
        at, bucket = subwords(words)
        return np.bincount(at, self.u[bucket], len(words)) / np.maximum(1, np.bincount(at, minlength=len(words)))


class _Sparse:
    """Rows of (column, weight); sums along rows and along columns by reduceat."""

    def __init__(self, row, col, weight, n_rows, n_cols):
        self.fwd = self._order(row, col, weight, n_rows)
        self.bwd = self._order(col, row, weight, n_cols)

    @staticmethod
    def _order(row, col, weight, n):
        o = np.argsort(row, kind="stable")
        row = row[o]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        return row[first], first, col[o].astype(np.int32), weight[o].astype(np.float32), n

    @staticmethod
    def _sum(order, x, step=1 << 18):
        rows, first, col, weight, n = order
        out = np.zeros((n, x.shape[1]), np.float32)
        k = 0
        while k < len(rows):  # in pieces of whole rows, so that the gathered entries stay small
            e = max(k + 1, int(np.searchsorted(first, first[k] + step, "left")))
            stop = first[e] if e < len(rows) else len(col)
            part = x[col[first[k] : stop]] * weight[first[k] : stop, None]
            out[rows[k:e]] = np.add.reduceat(part, first[k:e] - first[k], axis=0)
            k = e
        return out

    def dot(self, x):
        return self._sum(self.fwd, x)

    def t_dot(self, x):
        return self._sum(self.bwd, x)


def train(rows: Iterable[tuple[int, list[str], list[int]]], epochs: int = 6, rate: float = 0.1, batch: int = 128, shrink: float = 7e-4, min_docs: int = 3, seed: int = 1) -> Model:
    """Fits embeddings and softmax together, by Adagrad over batches of documents. rows: (label, different words, their counts).

    After each step a subword's vector is shortened by `shrink` (a group lasso): subwords of chance rareness go to zero, those that carry the label stay.
    A fifth of the rows is kept from the steps and then sets the scale and bias of the log-odds, so that a score of 0.7 means what it says.
    Without rows of both classes the score is the share of label 1 (0.5 without any).
    """
    index: dict[str, int] = {}
    labels, word, weight = [], [], []
    for label, words, counts in rows:
        labels.append(label)
        word.append(np.array([index.setdefault(w, len(index)) for w in words], np.int32))
        weight.append(np.array(counts, np.float32) / max(1, sum(counts)))
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    vocabulary, flat, size = list(index), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    index.clear()
    for k in range(0, len(vocabulary), 20_000):
        part = vocabulary[k : k + 20_000]
        at, bucket = subwords(part)
        flat.append(bucket[np.argsort(at, kind="stable")])
        size.append(np.bincount(at, minlength=len(part)))
    del vocabulary
    flat, size = np.concatenate(flat), np.concatenate(size)
    start = np.cumsum(size) - size

    def grams_of(ws):
        n = size[ws]
        upto = np.cumsum(n)
        return flat[np.repeat(start[ws] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)], n

    df = np.zeros(BUCKETS, np.int64)
    for w in word:
        df[np.unique(grams_of(w)[0])] += 1
    live = (df >= min_docs)[:, None]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    fit_rows, check = order[len(y) // 5 :], order[: len(y) // 5]
    parts = []
    for k in range(0, len(fit_rows), batch):
        own = fit_rows[k : k + batch]
        uw, col = np.unique(np.concatenate([word[i] for i in own]), return_inverse=True)
        if not len(uw):
            continue
        x = _Sparse(np.repeat(np.arange(len(own)), [len(word[i]) for i in own]), col, np.concatenate([weight[i] for i in own]), len(own), len(uw))
        g, n = grams_of(uw)
        ub, col = np.unique(g, return_inverse=True)
        parts.append((own, x, _Means(col, n, len(ub)), ub))
    gain = np.float32(300)  # a few toxic words among hundreds move the mean but little
    e = np.where(live, rng.uniform(-0.1, 0.1, (BUCKETS, DIM)) / DIM, 0).astype(np.float32)
    sign = rng.choice([-0.3, 0.3], DIM)
    v, bias = np.stack([-sign, sign], 1).astype(np.float32), np.zeros(2, np.float32)
    he, hv, hb = (np.full_like(a, 1e-6) for a in (e, v, bias))
    one_hot = np.eye(2, dtype=np.float32)[y]
    for epoch in range(epochs):
        r = rate * (1 - epoch / epochs)
        for own, x, g, ub in parts:
            d = gain * x.dot(g.dot(e[ub]))
            z = d @ v + bias
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            dz = (q - one_hot[own]) / len(own)
            ge, gv, gb = np.where(live[ub], g.t_dot(x.t_dot(gain * dz @ v.T)), 0), d.T @ dz, dz.sum(0)
            he[ub] += ge**2
            hv += gv**2
            hb += gb**2
            h = np.sqrt(he[ub])
            new = e[ub] - r * ge / h
            length = np.sqrt((new**2).sum(1, keepdims=True)) + 1e-12
            e[ub] = new * np.maximum(0, 1 - r * shrink / h.mean(1, keepdims=True) / length)
            v -= 0.1 * r * gv / np.sqrt(hv)
            bias -= r * gb / np.sqrt(hb)
    u = gain * e @ (v[:, 1] - v[:, 0])
    per_word = np.add.reduceat(u[flat], start) / size if len(size) else np.zeros(0)  # every word has a subword at least
    means = np.array([float(per_word[word[i]] @ weight[i]) for i in check])
    scale, shift = _logistic(means, y[check], 1.0, float(bias[1] - bias[0]))
    return Model((scale * u).astype(np.float32), shift)


class _Means:
    """Rows that are means of other rows: those that col names, n[i] of them for row i, one row's after another. Half the memory of a _Sparse."""

    def __init__(self, col, n, n_cols):
        self.col, self.n, self.n_cols = col.astype(np.int32), n, n_cols
        self.first = np.cumsum(n) - n
        o = np.argsort(col, kind="stable")
        self.row = np.repeat(np.arange(len(n), dtype=np.int32), n)[o]
        self.cols, self.cut = np.unique(col[o], return_index=True)

    def dot(self, x):
        return np.add.reduceat(x[self.col], self.first, axis=0) / self.n[:, None].astype(np.float32)

    def t_dot(self, x):
        out = np.zeros((self.n_cols, x.shape[1]), np.float32)
        out[self.cols] = np.add.reduceat((x / self.n[:, None].astype(np.float32))[self.row], self.cut, axis=0)
        return out


def _logistic(x: np.ndarray, y: np.ndarray, scale: float, shift: float) -> tuple[float, float]:
    """Scale and shift of x as log-odds of y, by Newton steps with a weak pull to what is given; that is kept if y has one class only."""
    if not len(y) or y.min() == y.max():
        return scale, shift
    spread = max(float(x.std()), 1e-6)
    a = np.stack([x / spread, np.ones(len(x))], 1)
    prior = np.array([scale * spread, shift])
    w, pull = prior.copy(), 0.02
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + pull * (w - prior)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pull * np.eye(2), grad)
        w = w - step * min(1.0, 2 / (np.abs(step).max() + 1e-9))
    return float(max(w[0], 0) / spread), float(w[1])


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, seen) -> DataFrame:
    """(i, y, w, n): at most per_class rows of each label, chosen by a hash of the id, as bags of words of their whole texts."""
    one = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).where("i is not null and y is not null").where(seen("i"))
    one = one.groupBy("i").agg(F.max("y").cast("int").alias("y"))
    key = [F.xxhash64("i"), "i"]
    chosen = one.where("y = 1").orderBy(*key).limit(per_class).unionByName(one.where("y = 0").orderBy(*key).limit(per_class))

    def bags(batches):
        for b in batches:
            counts = [Counter(words_of(t.as_py())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], names=["i", "y", "w", "n"])

    # at most 2 * per_class rows of an id and a label: a proven bound
    some = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "i").select("i", "y", "t")
    some = some.groupBy("i").agg(F.first("y").alias("y"), F.min("t").alias("t"))
    return some.mapInArrow(lean(bags), f"i {id_type(docs, id_col)}, y int, w array<string>, n array<int>")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, score, predicted, and the columns named in keep. Row-wise: no shuffle. The model, of fixed size, is broadcast."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = told.value
        cache: dict[str, float] = {}
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                words = words_of(t)
                s = list(map(cache.get, words))
                if None in s:
                    if len(cache) > 200_000:
                        cache.clear()
                    new = list(set(words).difference(cache))
                    cache.update(zip(new, m.score_words(new).tolist()))
                    s = list(map(cache.__getitem__, words))
                out.append(sum(s) / max(1, len(s)) + m.bias)
            p = 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -60, 60)))
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=names)

    names = ["i", *[f"k{n}" for n in range(len(keep))], "score", "predicted"]
    types = [id_type(docs, id_col), *[id_type(docs, c) for c in keep], "double", "int"]
    d = docs.select(F.col(id_col), F.col(text_col), *[F.col(c) for c in keep])
    return d.mapInArrow(lean(run), ", ".join(f"{n} {t}" for n, t in zip(names, types))).toDF(id_col, *keep, "score", "predicted")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 3000, seen=lambda c: ~held_out(c)) -> Model:
    """The model of labelled documents.

    It is fitted in one task of an executor, on at most per_class rows of each label (whole texts): a sample, bounded as documented; scores then cover all documents.
    Only the model, half a megabyte, comes to the driver; a lost executor's fit runs again on the same rows in the same order. Held-out rows
    (seen is false) are never read for training. Labels of one id are joined by their maximum; of rows that repeat an id, one text counts. Nulls are skipped.
    """
    rows = training_rows(docs, labels, id_col, text_col, label_col, per_class, seen).repartition(1).sortWithinPartitions("i")

    def run(batches):
        slices = (b.slice(k, 100) for b in batches for k in range(0, b.num_rows, 100))  # few rows as Python objects at a time
        m = train((y, w, n) for p in slices for y, w, n in zip(*(p.column(k).to_pylist() for k in (1, 2, 3))))
        yield pa.RecordBatch.from_pydict({"u": [m.u.astype(np.float32).tobytes()], "bias": [m.bias]})

    got = rows.mapInArrow(lean(run), "u binary, bias double").first()
    return Model(np.frombuffer(got["u"], np.float32), got["bias"]) if got else train([])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **kw) -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted (1 from threshold on).

    Only the text goes into a score. A null or empty text scores what the model's bias gives. Null ids pass through (held_out null). Repeated rows count each; an
    empty table gives an empty result; other columns are ignored.
    """
    s = score(docs, fit(docs, labels, id_col, text_col, **kw), id_col, text_col, threshold)
    return s.select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **kw) -> DataFrame:
    """docs without the rows whose score reaches the threshold. Row-wise but for the fit; all columns stay as they are; for nulls see toxicity."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names))
    s = score(docs.toDF(*names), fit(docs, labels, id_col, text_col, **kw), of[id_col], of[text_col], threshold, tuple(names))
    return s.toDF("i", *names, "score", "predicted").where("predicted = 0").select(*names).toDF(*docs.columns)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents with their scores; the classifier learns from labels that are not held out. Empty and null texts score too. See toxicity."""
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
