"""Copies among images: multiscale corners, binary tests along the corner's orientation, Hamming tables, geometric consensus."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, id_type, lean, load, scratch, stash, with_hit
from .graph import components

#: Images are shrunk by these factors, a third of an octave apart, so any two scales are within an eighth of each other at some pair of levels.
LEVELS = (1.0, 1.26, 1.587, 2.0, 2.52)
PER_LEVEL = (24, 18, 14, 9, 6)
REACH = 13  # radius of the patch that the tests read, in pixels of the level
MARGIN = REACH + 3
TURNS = 72
BITS = 256
SPOT = 6  # pixels
BANDS = 8
#: Bytes of tests in a key, at any number of images: whether two images are linked must not depend on how many others there are.
KEY_BYTES = 5
SALTS = 32
#: Images with a longer side are shrunk by a whole factor first, so that memory stays bounded.
LONGEST = 4096
ONE = np.zeros(0, np.float32)
#: The order of the tests, which decides whose tests make a key; distances don't depend on it. Tests of one key should tell different things, or unlike corners share it often. So pairs of
#: tests were swapped while that raised the sum, over the keys, of log det of their tests' correlations in a picture whose grey values correlate by exp(-r^2 / 32) at r pixels. No data was used.
#: It is written down, for a search might end elsewhere on another machine.
ORDER = bytes.fromhex(
    "001444080417067525a59ed5e2a1eee49403be36d85d8d842c90e13a024cf91259b2ebef4026b33b8238bf355c1c2a5f8f5841dbfefae89baecea66b7d24d4ab"
    "d0a4f10a8892435a32543caa2fc746f2ddf0ff4dc2bc9a01edcc7a984a1e09dc60a86f7827a920d6ecea3ec96d0cf6e023ca8a560d57b6bd07f8dac810199f8e"
    "bb747fb7a064b8f376a252798c6539b433f58162a3b173e54e930ed9cdfcfd7ef48b4734512995215b119d6e314f89962d1fde2eac55e6635e7bb0d3051b0f50"
    "68c05372c47c1a6945a7add2912bfbc52870e73dd7df2230154bf7cbc1e91dc6614886e3717713186cb9498785afc3b59716d1ba80996637cf676a0b42839c3f"
)


def _pattern() -> np.ndarray:
    """(TURNS, 2 * BITS, 2): the tests' points (dy, dx), first and second points one after the other, turned in steps of 360 / TURNS degrees.

    The angle points to where the patch is brighter, so a test along it nearly always comes out alike, and its word would be a key that most images
    share. The two points of a test therefore lie across: equally far along the angle, but for two pixels; and they are near each other, so that tests at different
    places tell different things.
    """
    rng = np.random.default_rng(7)
    far = REACH / 1.42
    along, across = rng.uniform(-far, far, (2, BITS))
    step = rng.uniform(3, 6, BITS) * np.where(across > 0, -1, 1)
    one = np.stack([across, along], 1)
    two = np.stack([across + step, np.clip(along + rng.uniform(-2, 2, BITS), -far, far)], 1)
    p = np.concatenate([v[list(ORDER)] for v in (one, two)])
    a = 2 * np.pi * np.arange(TURNS) / TURNS
    turn = np.stack([np.stack([np.cos(a), np.sin(a)], 1), np.stack([-np.sin(a), np.cos(a)], 1)], 1)
    return np.rint(np.einsum("tij,pj->tpi", turn, p)).astype(np.int32)


PATTERN = _pattern()
_Y, _X = (v.ravel() for v in np.mgrid[-7:8, -7:8])
_DISC = _Y**2 + _X**2 <= 49
DISC = np.stack([_Y[_DISC], _X[_DISC]], 1)


def blur(x: np.ndarray) -> np.ndarray:
    """Binomial of five taps along both axes of a stack of images."""
    for axis in (1, 2):
        p = np.pad(x, [(0, 0), (2, 2) if axis == 1 else (0, 0), (2, 2) if axis == 2 else (0, 0)], mode="edge")
        n = x.shape[axis]
        c = [p[:, i : i + n] if axis == 1 else p[:, :, i : i + n] for i in range(5)]
        x = (c[0] + c[4] + 4 * (c[1] + c[3]) + 6 * c[2]) / np.float32(16)
    return x


def shrink(x: np.ndarray, by: float) -> np.ndarray:
    """A stack of images, smaller by a factor, bilinear."""
    h, w = int(x.shape[1] / by), int(x.shape[2] / by)
    y, c = np.minimum(np.arange(h) * by, x.shape[1] - 1), np.minimum(np.arange(w) * by, x.shape[2] - 1)
    y0, c0 = y.astype(int), c.astype(int)
    y1, c1 = np.minimum(y0 + 1, x.shape[1] - 1), np.minimum(c0 + 1, x.shape[2] - 1)
    fy, fc = (y - y0).astype(np.float32)[:, None], (c - c0).astype(np.float32)
    top = x[:, y0][:, :, c0] * (1 - fc) + x[:, y0][:, :, c1] * fc
    low = x[:, y1][:, :, c0] * (1 - fc) + x[:, y1][:, :, c1] * fc
    return top * (1 - fy) + low * fy


def describe(images: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For a stack of grey images of one size: per image (corners as y, x, scale, angle in the image's own pixels; their tests as BITS / 32 words).

    Per level the strongest local maxima of the corner response, up to PER_LEVEL, equal responses in reading order. A corner must reach a hundredth of its image's
    strongest, so neither brightness nor contrast matters. The angle points to the patch's centre of intensity; the tests are turned by it.
    """
    n = len(images)
    geo, bits = [[] for _ in range(n)], [[] for _ in range(n)]
    base = images.astype(np.float32)
    for level, most in zip(LEVELS, PER_LEVEL):
        x = base if level == 1 else shrink(blur(base), level)
        h, w = x.shape[1:]
        if h <= 2 * MARGIN or w <= 2 * MARGIN:
            continue
        x = blur(x)
        gy, gx = np.zeros_like(x), np.zeros_like(x)
        gy[:, 1:-1], gx[:, :, 1:-1] = x[:, 2:] - x[:, :-2], x[:, :, 2:] - x[:, :, :-2]
        a, b, c = blur(gy * gy), blur(gx * gx), blur(gy * gx)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        inner = r[:, MARGIN:-MARGIN, MARGIN:-MARGIN]
        peak = inner > np.maximum(0.01 * inner.max((1, 2), keepdims=True), 1.0)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    near = r[:, MARGIN + dy : h - MARGIN + dy, MARGIN + dx : w - MARGIN + dx]
                    peak &= (inner > near) if (dy, dx) < (0, 0) else (inner >= near)
        k, y, z = np.nonzero(peak)
        if not len(k):
            continue
        order = np.lexsort((z, y, -inner[k, y, z], k))
        k, y, z = k[order], y[order] + MARGIN, z[order] + MARGIN
        rank = np.arange(len(k)) - np.searchsorted(k, k)
        k, y, z = (v[rank < most] for v in (k, y, z))
        patch = x[k[:, None], y[:, None] + DISC[:, 0], z[:, None] + DISC[:, 1]]
        angle = np.arctan2(patch @ DISC[:, 0].astype(np.float32), patch @ DISC[:, 1].astype(np.float32))
        t = np.rint(angle / (2 * np.pi / TURNS)).astype(int) % TURNS
        p = PATTERN[t]
        s = blur(blur(x))
        v = s[k[:, None], y[:, None] + p[:, :, 0], z[:, None] + p[:, :, 1]]
        d = np.packbits(v[:, :BITS] < v[:, BITS:], axis=1).view("<u4")
        g = np.stack([y * level, z * level, np.full(len(k), level), angle], 1).astype(np.float32)
        cut = np.searchsorted(k, np.arange(n + 1))
        for i in range(n):
            if cut[i + 1] > cut[i]:
                geo[i].append(g[cut[i] : cut[i + 1]])
                bits[i].append(d[cut[i] : cut[i + 1]])
    return [(np.concatenate(g), np.concatenate(d)) if g else (np.zeros((0, 4), np.float32), np.zeros((0, BANDS), np.uint32)) for g, d in zip(geo, bits)]


def consensus(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], most_bits: int) -> int:
    """At how many spots of two images matching corners agree on one shift, turn and scale. Matches: each other's nearest, at most most_bits of the tests differing."""
    (ga, da), (gb, db) = a, b
    if not len(ga) or not len(gb):
        return 0
    far = np.bitwise_count(da.view("<u8")[:, None] ^ db.view("<u8")[None]).sum(2, dtype=np.int64)
    to, back = far.argmin(1), far.argmin(0)
    i = np.flatnonzero((back[to] == np.arange(len(ga))) & (far[np.arange(len(ga)), to] <= most_bits))
    if not len(i):
        return 0
    p, q = ga[i], gb[to[i]]
    scale, turn = q[:, 2] / p[:, 2], q[:, 3] - p[:, 3]
    c, s = scale * np.cos(turn), scale * np.sin(turn)
    dy, dx = p[None, :, 0] - p[:, None, 0], p[None, :, 1] - p[:, None, 1]
    ey = q[:, None, 0] + c[:, None] * dy + s[:, None] * dx - q[None, :, 0]
    ex = q[:, None, 1] - s[:, None] * dy + c[:, None] * dx - q[None, :, 1]
    # the angle's error turns a far corner by more, so the room grows with distance
    room = 4 + 0.12 * np.hypot(dy, dx) * scale[:, None]
    wrap = np.abs((turn[None] - turn[:, None] + np.pi) % (2 * np.pi) - np.pi)
    fit = (np.hypot(ey, ex) <= room) & (wrap < 0.4) & (np.abs(np.log(scale[None] / scale[:, None])) < 0.5)
    best = p[fit[fit.sum(1).argmax()], :2]
    # one spot of the image may have corners at several levels: they count once
    return len(np.unique(np.floor(best / SPOT), axis=0))


def pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def pooled(image: np.ndarray) -> tuple[np.ndarray, int]:
    """The image, shrunk by means of square blocks until its sides are at most LONGEST, and the blocks' side. What is left at the edges goes."""
    by = -(-max(image.shape) // LONGEST)
    if by == 1:
        return image, 1
    h, w = (n // by for n in image.shape)
    rows = [image[by * i : by * (i + 1), : by * w].reshape(by, w, by).mean((0, 2), dtype=np.float32) for i in range(h)]
    return np.stack(rows) if rows and w else np.zeros((1, 1), np.float32), by


def read_pgm(blob: bytes | None) -> np.ndarray | None:
    """A grey image from a binary PGM (P5, 8 bits, no comments); None for anything else."""
    parts = (blob or b"").split(maxsplit=4) if (blob or b"")[:2] == b"P5" else []
    head = (blob or b"")[:64].split(b"\n", 3)
    if len(parts) < 4 or len(head) < 4:
        return None
    try:
        w, h = map(int, head[1].split())
        data = blob[sum(len(x) + 1 for x in head[:3]) :]
        return np.frombuffer(data, np.uint8).reshape(h, w) if head[2] == b"255" and w > 0 and h > 0 else None
    except ValueError:
        return None


def features(media: DataFrame, id_col: str, image_col: str) -> DataFrame:
    """(id, geo, bits, n): the corners of every image as two binary columns. Row-wise; images of one size are worked on together.

    Of an image without corners, bits is the SHA-256 of its bytes; null images have neither."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                images, by = [], []
                for x in part.column(1):
                    image = read_pgm(x.as_py())
                    image, k = (None, 1) if image is None else pooled(image)
                    images.append(image)
                    by.append(k)
                out: list = [(ONE.reshape(0, 4), np.zeros((0, BANDS), np.uint32))] * len(images)
                by_shape: dict = {}
                for i, x in enumerate(images):
                    if x is not None:
                        by_shape.setdefault(x.shape, []).append(i)
                for own in by_shape.values():
                    step = max(1, (1 << 22) // images[own[0]].size)
                    for k in range(0, len(own), step):
                        for i, d in zip(own[k : k + step], describe(np.stack([images[j] for j in own[k : k + step]]))):
                            out[i] = (d[0] * np.array([by[i], by[i], by[i], 1], np.float32), d[1])
                bits = [d.tobytes() if len(g) or not x.is_valid else hashlib.sha256(x.as_py()).digest() for (g, d), x in zip(out, part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g.astype("<f4").tobytes() for g, _ in out], pa.binary()), pa.array(bits, pa.binary()), pa.array([len(g) for g, _ in out], pa.int32())], names=["id", "geo", "bits", "n"])

    return media.select(F.col(id_col), F.col(image_col)).mapInArrow(lean(run), f"id {id_type(media, id_col)}, geo binary, bits binary, n int")


def _table_keys(sets: DataFrame) -> DataFrame:
    """(key, node, tests), once for each corner that has the key: the Hamming tables. The key of table j is KEY_BYTES bytes of a corner's tests, from the j-th of BANDS words on, around the end."""
    corner, table = F.floor(F.col("at") / BANDS), F.col("at") % BANDS
    at = sets.select("node", "bits", F.explode(F.sequence(F.lit(0), F.col("n") * BANDS - 1)).alias("at"))
    byte = lambda k: F.substring(F.col("bits"), (corner * 4 * BANDS + (table * 4 + k) % (4 * BANDS) + 1).cast("int"), F.lit(1))
    return at.select(F.xxhash64(table, F.concat(*[byte(k) for k in range(KEY_BYTES)])).alias("key"), "node", F.substring(F.col("bits"), (corner * 4 * BANDS + 1).cast("int"), F.lit(4 * BANDS)).alias("tests"))


def _tidy(spark: SparkSession) -> None:
    """Spark deletes a finished query's shuffle files once the driver has collected its plan, which a small plan may wait for long."""
    spark.sparkContext._jvm.System.gc()


def _words(tests: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(tests.to_pylist()), "<u8").reshape(-1, BITS // 64)


def _near_pairs(pairs: DataFrame, near: int) -> DataFrame:
    """Of the rows (a, b, ta, tb) whose tests differ in at most `near`, the nearest a of each b, as (a, b)."""

    def run(batches):
        for b in batches:
            far = np.bitwise_count(_words(b.column(2)) ^ _words(b.column(3))).sum(1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(far)], names=["a", "b", "far"]).filter(pa.array(far <= near))

    best = pairs.mapInArrow(lean(run), "a long, b long, far int").groupBy("b").agg(F.min(F.struct("far", "a")).alias("best"))
    return best.select(F.col("best.a").alias("a"), "b")


def _verified(pairs: DataFrame, sets: DataFrame, most_bits: int, least: int) -> DataFrame:
    """Those pairs (a, b) whose corners have a consensus of at least `least`. The joins' pair side is narrow, and AQE can split a hot image."""

    def run(batches):
        shape = lambda g, d: (np.frombuffer(g, "<f4").reshape(-1, 4), np.frombuffer(d, "<u4").reshape(-1, BANDS))
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            ok = [consensus(shape(ga, da), shape(gb, db), most_bits) >= least for ga, da, gb, db in zip(*cols[2:])]
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # only images that have a pair go into the shuffles with their corners
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    some = with_hit(sets, bitmap(ends, 22, "node"), 22, "_hit", "node").where("_hit").select("node", "geo", "bits")
    one, two = (some.toDF(x, f"g{x}", f"d{x}") for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ga", "da", "gb", "db").mapInArrow(lean(run), "a long, b long")


def _cross_pairs(table: DataFrame, near: int) -> DataFrame:
    """(a, b), once for each key they share by corners that differ in at most `near` tests: pairs of nodes of different classes. A key's corners come in `of` blocks, and each pair of blocks is one
    row of work: all their corners are compared, but only near ones become rows. A key of one block needs no join."""
    lists = [F.collect_list(c).alias(n) for c, n in (("node", "ns"), ("root", "rs"), ("tests", "ts"))]
    blocks = table.withColumn("s", F.pmod(F.xxhash64("node"), F.col("of"))).groupBy("key", "s").agg(F.first("of").alias("of"), F.min("root").alias("r0"), F.max("root").alias("r1"), *lists)
    blocks = stash(blocks.where("of > 1 or r0 < r1").drop("r0", "r1"), "media-blocks")
    l, r = (blocks.where("of > 1").alias(x) for x in "lr")
    two = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.s") <= F.col("r.s")))
    sides = lambda l, r: [F.col(f"{x}{c}").alias(y + c) for x, y in ((l, "l"), (r, "r")) for c in ("ns", "rs", "ts")]
    both = blocks.where("of = 1").select(*sides("", ""), F.lit(True).alias("same")).unionByName(two.select(*sides("l.", "r."), (F.col("l.s") == F.col("r.s")).alias("same")))

    def run(batches):
        for batch in batches:
            (an, ar, at), (bn, br, bt) = ([c.flatten() for c in batch.columns[k : k + 3]] for k in (0, 3))
            an, ar, bn, br, at, bt = *(x.to_numpy() for x in (an, ar, bn, br)), _words(at), _words(bt)
            la, lb = (batch.column(k).value_lengths().to_numpy() for k in (0, 3))
            # one entry for each corner on the left: how many it meets on the right, and where those begin
            meets, begin = np.repeat(lb, la), np.repeat(np.cumsum(lb) - lb, la)
            same = np.repeat(batch.column(6).to_numpy(zero_copy_only=False), la)
            ends, lo = np.cumsum(meets), 0
            while lo < len(an):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + 250_000)))
                m = meets[lo:hi]
                i = np.repeat(np.arange(lo, hi), m)
                j = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + begin[i]
                ok = (ar[i] != br[j]) & (~same[i] | (an[i] < bn[j]))
                i, j = i[ok], j[ok]
                ok = np.bitwise_count(at[i] ^ bt[j]).sum(1, dtype=np.int64) <= near
                a, b = an[i[ok]], bn[j[ok]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
                lo = hi

    return both.mapInArrow(lean(run), "a long, b long")


def media_copies(media: DataFrame, id_col: str, image_col: str, most_bits: int = 48, least: int = 5, near: int = 28, block: int = 2048, filter_bits: int = 24, rounds: int = 4) -> DataFrame:
    """One row per input row: id, n_corners, class_id, the smallest id among the images that are linked to it, directly or through others.

    Two images are linked if two of their corners share a key of the Hamming tables (8 keys for each corner, of 40 tests at any number of images) and differ in at most `near` of all 256 tests, and matching corners (at most most_bits
    of 256 tests differ) at `least` spots or more agree on one shift, turn and scale: cropped, shifted, turned, resized, brighter or partly covered copies. Keys find most pairs that the corners
    would confirm, not all: test_media_recall measures the share for turns and scales. At most 71 corners of an image count, so a crop of a small part of it may keep too few.

    1. Corners and tests are computed row by row. Images with the same corners and tests are one node, so exact copies never meet in a table.
    2. The tables are one equality grouping. Keys of one node go, by a filter of fixed size and an exact count.
    3. In each round every key whose nodes are not yet one class pairs its smallest remaining node with the others that aren't in its class, and then leaves it out:
       at most as many pairs as the table has rows. Each node's nearest pair is verified; those confirmed are links; classes are the components of all links. A hot group of copies becomes one class in a round or two.
    4. When rounds join little, are used up or few pairs are left, the whole table is gone through again, in blocks: all pairs that share a key by near corners and not yet a
       class are verified. So no link between classes is missed: no cap, no sampling.

    Images that can't be read, are flat or too small have no corners; those of the same bytes share a class. Null images are classes of their own, null ids included (class_id null). Repeated rows share a class.
    An empty table gives an empty result. Other columns are ignored. image_col: binary PGM of 8 bits.
    """
    spark = media.sparkSession
    low = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row")).alias("low")
    with scratch(spark) as keep_all:
        with scratch(spark) as keep:
            found = stash(features(media, id_col, image_col).withColumn("row", F.monotonically_increasing_id()), "media-features")
            found = found.withColumn("set", F.when(F.length("bits") > 0, F.sha2(F.concat("geo", "bits"), 256)))
            rows = keep_all(keep(stash(found.select("id", "n", "row", "set"), "media-rows")))
            named = found.where("n > 0").groupBy("set").agg(low, F.first("geo").alias("geo"), F.first("bits").alias("bits"), F.first("n").alias("n"))
            sets = keep(stash(named.withColumn("node", F.col("low.row")), "media-sets"))
        _tidy(spark)
        # a key is shared if it has two different nodes; the keys are made twice from the corners, which is cheaper than to write them all
        keys = _table_keys(sets)
        with scratch(spark) as keep:
            shared = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.ceil(F.count(F.lit(1)) / block).alias("of"))
            shared = stash(shared.where("a < b").select("key", "of"), "media-shared")
            whole = with_hit(keys, bitmap(shared, filter_bits, "key"), filter_bits, "_hit", "key").where("_hit").select("key", "node", "tests")
            whole = keep(stash(whole.join(shared, "key"), "media-table"))
        _tidy(spark)
        roots = _roots(whole, sets, most_bits, least, near, rounds)
        where = sets.select("set", "node", "low")
        alone = where.withColumn("root", F.lit(None).cast("long")) if roots is None else where.join(roots, "node", "left")
        where = stash(alone.withColumn("salt", F.pmod(F.xxhash64("set"), F.lit(SALTS))), "media-where")
        # a class may hold a third of all images: its rows are dealt over SALTS tasks, and its smallest id goes to each; images without links need no join
        least_of = where.where("root is not null").groupBy("root").agg(F.min("low").alias("low")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        linked = where.where("root is not null").select("set", "root", "salt").join(least_of, ["root", "salt"]).select("set", F.col("low.id").alias("class_id"))
        named_class = keep_all(stash(linked.unionByName(where.where("root is null").select("set", F.col("low.id").alias("class_id"))), "media-classes"))
    plain = rows.where("n = 0 and set is not null")
    named_class = named_class.unionByName(plain.groupBy("set").agg(low).select("set", F.col("low.id").alias("class_id")))
    out = rows.select("id", "n", "set").join(named_class, "set", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_corners"), F.when(F.col("set").isNotNull(), F.col("class_id")).otherwise(F.col("id")).alias("class_id"))


def _roots(whole: DataFrame, sets: DataFrame, most_bits: int, least: int, near: int, rounds: int) -> DataFrame | None:
    """(node, root): the classes of nodes that have links, by the rounds that media_copies describes. whole: the table of keys (key, node, tests, of), `of` the key's blocks. Each round deletes its tables."""
    spark = sets.sparkSession
    links = sets.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    left, roots, known = whole.drop("of"), None, 0
    rooted = lambda t: t.withColumn("root", F.col("node")) if roots is None else t.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    for _ in range(rounds):
        with scratch(spark) as keep:
            table = rooted(left)
            mixed = table.groupBy("key").agg(F.min(F.struct("node", "root", "tests")).alias("first"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("k"))
            mixed = stash(mixed.where("r0 < r1").select("key", F.col("first.node").alias("rep"), F.col("first.root").alias("rep_root"), F.col("first.tests").alias("rep_tests"), "k"), "media-mixed")
            n, most = mixed.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum(F.col("k") * (F.col("k") - 1)), F.lit(0))).first()
            if not n:
                break
            active = keep(stash(table.join(mixed, "key"), "media-active"))
            pairs = active.where("root <> rep_root").select(F.col("rep").alias("a"), F.col("node").alias("b"), F.col("rep_tests").alias("ta"), F.col("tests").alias("tb"))
            pairs = stash(_near_pairs(pairs, near), "media-pairs")
            _tidy(spark)
            links = keep(stash(links.unionByName(_verified(pairs, sets, most_bits, least)), "media-links"))
            roots = keep(stash(components(links, "media-cc"), "media-roots"))
        _tidy(spark)
        left = active.where("node <> rep").select("key", "node", "tests")
        before, known = known, links.count()
        # few pairs left, or what shares keys now are mostly different images, so that further rounds would join little
        if most <= 8 * n or 20 * (known - before) < n:
            break
    with scratch(spark) as keep:
        pairs = stash(_cross_pairs(rooted(whole), near).distinct(), "media-pairs")
        if pairs.isEmpty():
            return roots
        _tidy(spark)
        links = stash(links.unionByName(_verified(pairs, sets, most_bits, least)), "media-links")
        roots = keep(stash(components(links, "media-cc"), "media-roots"))
    _tidy(spark)
    return roots


SIDE, TILE = 96, 4


def _scenes() -> np.ndarray:
    """(tiles, 64): how a vector's components make the grey value of each tile."""
    return np.random.default_rng(11).normal(0, 1, ((SIDE // TILE) ** 2, 64)).astype(np.float32)


SCENES = _scenes()


def draw(vec: np.ndarray, vec_id: int) -> np.ndarray:
    """A scene of tiles whose grey follows the vector, so like vectors give like scenes; by the id, one of three is cropped and one has other contrast and a covered patch."""
    v = np.resize(np.asarray(vec, np.float32), 64)
    grey = np.tanh(SCENES @ v / (np.sqrt(v @ v) + 1e-9) / 1.2).reshape(SIDE // TILE, -1)
    img = 128 + 100 * np.kron(grey, np.ones((TILE, TILE), np.float32))
    rng = np.random.default_rng(vec_id & 0x7FFFFFFFFFFF)
    y, x = rng.integers(0, 17, 2)
    if vec_id % 3 == 1:
        img = img[y : y + 80, x : x + 80]
    elif vec_id % 3 == 2:
        img = 25 + 0.8 * img
        img[y + 30 : y + 50, x + 30 : x + 50] = rng.integers(0, 256, (20, 20))
    return np.clip(img, 0, 255).astype(np.uint8)


def drawn(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, image): no table of the test data holds images, so each vector is drawn as one. A null vector has no image."""

    def run(batches):
        for b in batches:
            made = [pgm(draw(np.array(v, np.float64), i or 0)) if v else None for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["id", "image"])

    return vectors.select(F.col(id_col), F.col(vec_col)).mapInArrow(lean(run), f"id {id_type(vectors, id_col)}, image binary").withColumnRenamed("id", id_col)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of copies among images that are drawn from embeddings, one for each row. See media_copies."""
    return media_copies(drawn(load(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vec_id", "image")
