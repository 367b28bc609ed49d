"""Every operator against SQL or brute force, and on rows that are null, empty, long, repeated or tied."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from arbordoc.llm import bpe, chat_format, common, cuckoo, exact_dedup, hashing, licenses, line_dedup, media, mixing, queries, simhash, simple8b, token_files, toxicity
from conftest import SF

LONG = "word " * 50_000
NOTICE = "Released under the MIT License."
EDGE = [
    (1, "Same  text here", "a"), (2, "Same text\there", "a"), (2, "Same text\there", "a"), (None, "Same text here", None), (3, None, None), (4, "", "b"), (5, " \n ", "b"),
    (6, LONG, "c"), (7, LONG + "x", "c"), (8, f"a line that is long enough to count\n{NOTICE}\nx", "a"), (9, f"A line that is LONG enough to count \nown {NOTICE}", "a"),
    (10, "a line that is long enough to count\nz", None), (11, "it's <|endoftext|> é‍\U0001f3f4 1234", "b"),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, s, "x", -1, "n") for i, t, s in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _id string, row int, n string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(same_as_sql, name):
    same_as_sql(queries.QUERIES[name], queries.ORACLES[name])


def strip(t):
    return (t or "").translate({i: None for i in (*range(9, 14), 32)})


def test_exact_dedup_edge(edge, empty):
    got = exact_dedup.exact_dedup(edge, digest_all=True).collect()
    groups = defaultdict(list)
    for i, t, _ in EDGE:
        groups[hashlib.sha256(strip(t).encode()).hexdigest()].append((-len(t or ""), i is None, i))
    assert len(got) == len(EDGE)
    for r in got:
        g = groups[r.text_sha256]
        assert r.group_size == len(g) and r.keep_id == min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0


def fingerprint(t):
    words = (t or "").encode().lower().split()
    sh = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots_of(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


def test_simhash_against_brute_force(spark, edge, empty):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fp = {r.doc_id: fingerprint(r.text) for r in rows}
    ids = sorted(fp)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 4]
    root = roots_of(ids, linked)
    got = queries.QUERIES["op3_simhash"](spark, SF).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (fp[i], root[i]) for i in ids}
    e = simhash.simhash_classes(edge).collect()
    assert len(e) == len(EDGE) and {r.component_id for r in e if r.doc_id in (3, 4, 5)} == {3}
    kept = simhash.simhash_dedup(edge)
    assert kept.columns == edge.columns and kept.count() == len({r.component_id for r in e})
    assert simhash.simhash_classes(empty).count() == 0


@pytest.mark.parametrize("n,block", [(300, 4096), (2000, 50)])
def test_near_links_lose_nothing(spark, n, block):
    rng = random.Random(n)
    seeds = [rng.getrandbits(64) for _ in range(n // 20)]
    fps = set()
    while len(fps) < n:
        x = rng.choice(seeds)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    a = np.array(fps)
    near = np.bitwise_count((a[:, None] ^ a[None]).view(np.uint64)) <= 4
    want = roots_of(fps, [(fps[i], fps[j]) for i, j in zip(*np.nonzero(np.triu(near, 1)))])
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), block=block)
    got = roots_of(fps, [(r.a, r.b) for r in links.collect()])
    assert got == want


def test_scheme_covers_every_difference():
    rng = random.Random(1)
    for distinct in (1000, 1 << 24, 1 << 30):
        parts = [sum(1 << b for b in p) for p in simhash.scheme(distinct, 4)]
        for _ in range(300):
            d = sum(1 << b for b in rng.sample(range(64), 4))
            assert any((d & p).bit_count() <= 1 for p in parts)


def test_mixing_edge(edge, empty):
    m = mixing.mix(edge).collect()
    assert len(m) == len(EDGE) and all(r.taken <= 3 * r["size"] for r in m)
    by = defaultdict(list)
    for r in m:
        by[r.target, r.source_size].append(r)
    for (target, _), rows in by.items():
        assert abs(sum(r.taken for r in rows) - target) <= 3 * max(r["size"] for r in rows)
    again = mixing.mix(edge.repartition(1)).collect()
    assert sorted(map(str, m)) == sorted(map(str, again))
    out = mixing.mixed_rows(edge)
    assert out.columns == edge.columns and out.count() == sum(r.copies for r in m)
    assert mixing.mix(empty).count() == 0


def test_licenses_in_long_blocks():
    s, rng = licenses.Scanner(), random.Random(5)
    short = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."]
    near = "Licensed under the terms of the Apache License, Version 2.0."
    vocabulary = [f"w{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 676)}" for i in range(5000)]
    prose = [w for _ in range(2500) for w in (*rng.choice(["of the", "to the", "with the", "that the", "of this"]).split(), rng.choice(vocabulary))]
    for name, text in [*licenses.TEMPLATES, ("Apache-2.0", near)]:
        got = s.scan(" ".join([*prose[:4000], text, *prose[4000:]]))
        assert [(x[2], x[3]) for x in got] == [(name, text != near)]
    packages = "".join(f"package {rng.choice(vocabulary)} of the project: {short[k % 3]} It comes with the sources, to the letter. " for k in range(200))
    assert [(x[2], x[3]) for x in s.scan(packages)] == [(("MIT", "Apache-2.0", "GPL-3.0")[k % 3], True) for k in range(200)]
    # another version that fits longer does not hide the notice that follows
    assert [(x[2], x[3]) for x in s.scan("Licensed under the Apache License, Version 1.1. " + "of the " * 9 + near)] == [("Apache-2.0", False)]


def test_licenses_take_time_in_proportion():
    s = licenses.Scanner()
    for n in (200, 800, 3200):
        got = s.scan("\n".join(f"{NOTICE} item{i}" for i in range(n)))
        assert [x[2:4] for x in got] == [("MIT", True)] * n


def test_size_reductions_choose_the_license(monkeypatch):
    # both are confirmed, two of eight words apart; the one that saves more wins, wherever it is in the list
    words = "copies of that work stay free for everybody"
    for own in ((("Y", words.replace("stay", "were")), ("X", words)), (("X", words), ("Y", words.replace("stay", "were")))):
        assert [x[2:4] for x in licenses.Scanner(own).scan(f"All {words} here.")] == [("X", True)]
        with monkeypatch.context() as m:
            m.setattr(licenses.Scanner, "reduction", lambda self, words, i: 0)
            assert [x[2] for x in licenses.Scanner(own).scan(f"All {words} here.")] == [own[0][0]]


def test_licenses_against_every_window():
    own = (*((n, t) for n, t in licenses.TEMPLATES if len(t.split()) < 14), ("Own", "nobody may sell these words to anyone"))
    s, rng = licenses.Scanner(own), random.Random(9)

    def least(t, span):  # fewest missing and extra words; those that tell licences apart can be neither
        cost = [[0] * (len(span) + 1) for _ in range(len(t) + 1)]
        price = lambda w: 1000 if s.telling(w) else 1
        for j in range(len(t) + 1):
            for k in range(len(span) + 1):
                ways = [0] if j == k == 0 else []
                ways += [cost[j - 1][k] + price(t[j - 1])] if j else []
                ways += [cost[j][k - 1] + price(span[k - 1])] if k else []
                ways += [cost[j - 1][k - 1]] if j and k and t[j - 1] == span[k - 1] else []
                cost[j][k] = min(ways)
        return cost[-1][-1]

    seen = 0
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 4)):
            t = rng.choice(s.words)[:]
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(t))
                t[k : k + rng.randint(0, 1)] = rng.choice([[], ["the"], ["under", "free"], ["work"]])
            words += t + rng.choices(["the", "under", "license", "of", "wa", "wb"], k=rng.randint(0, 6))
        got = [(a, b, i, missing, extra) for ws, at in [(words, 0)] for a, b, i, _, missing, extra in s.scan_block(ws)]
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        for a, b, i, missing, extra in got:
            assert len(missing) + len(extra) == least(s.words[i], words[a:b]) <= s.most[i]
        for i, t in enumerate(s.words):
            for a in range(len(words)):
                for b in range(a + max(1, len(t) - s.most[i]), min(len(words), a + len(t) + s.most[i]) + 1):
                    if {x for x in words[a:b] if s.telling(x)} == s.fixed[i] and least(t, words[a:b]) <= s.most[i]:
                        seen += 1
                        assert any(x[0] < b and a < x[1] for x in got), (s.names[i], words[a:b])
    assert seen > 100


def test_licenses_without_stems():
    s = licenses.Scanner()
    for text, want in (("Available under CC-BY-SA-4.0.", "CC-BY-SA-4.0"), ("This is free and unencumbered software put into the public\ndomain.", "Unlicense")):
        assert [(x[2], x[3]) for x in s.scan("lorem ipsum " * 50 + text)] == [(want, False)]
    own = (("X", "Dieses Werk darf frei kopiert werden"), ("Y", "Gemeinfrei"))
    assert [(x[2], x[3]) for x in licenses.Scanner(own).scan("Hinweis: dieses Werk darf frei kopiert werden. Text. Gemeinfrei!")] == [("X", True), ("Y", True)]


def test_licenses(spark, edge, empty):
    got = {(r.doc_id, r.license, r.exact): (r.start, r.end) for r in licenses.license_scan(edge).collect()}
    assert set(got) == {(8, "MIT", True), (9, "MIT", True)}
    assert EDGE[9][1][slice(*got[8, "MIT", True])] == NOTICE[:-1]
    assert licenses.license_scan(empty).count() == 0
    s = licenses.Scanner()
    for name, text in licenses.TEMPLATES:  # brute force: every notice, alone and in the middle of long text, is found as itself
        for t in (text, "lorem ipsum " * 300 + text + " dolor sit" * 300):
            assert [(x[2], x[3]) for x in s.scan(t)] == [(name, True)]
    assert s.scan("the license of the tribe") == [] and s.scan(None) == []
    assert [x[2:4] for x in s.scan("Released under the MIT Licence.")] == [("MIT", False)]
    assert s.scan("licensed under the GNU General Public License, version 9") == []
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {(r.doc_id, name) for r in rows for name, text in licenses.TEMPLATES if text in (r.text or "")}
    assert want <= {(r.doc_id, r.license) for r in queries.QUERIES["op5_license_scan"](spark, SF).collect()}


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe_equals_the_library(spark, edge, empty):
    t = tokenizer()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    want = []
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.round_trip(docs, keep_ids=False).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    back = bpe.decode(bpe.encode(docs), "ids", "again").collect()
    assert sorted(r.again for r in back) == sorted(t.decode(t.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in docs.collect())
    assert bpe.encode(empty).count() == 0


def test_bpe_on_random_text():
    t, b, rng = tokenizer(), bpe.Bpe(bpe.default_vocabulary()), random.Random(5)
    alphabet = list("abcDE '.,\n\t 12é½ß漢字　 \U0001f600-_") + ["'s", "'ll", " the", "<|endoftext|>", "ing", "\r\n"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    ids, n = b.encode(texts)
    ends = np.cumsum(n)
    for x, e, k in zip(t.encode_batch(texts, add_special_tokens=False), ends, n):
        assert x.ids == ids[e - k : e].tolist()


def test_simple8b():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        for top in (1, 2, 50_257, 1 << 31, (1 << 64) - 1):
            v = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
            assert (simple8b.unpack(*simple8b.pack(v), n) == v).all()


def test_token_files(spark, edge, empty):
    t = tokenizer()
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want, start = [], 0
    for r in docs:
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = queries.QUERIES["op7_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want
    e = sorted((r.start, r.n_tokens) for r in token_files.read_tokens(token_files.write_tokens(edge)).collect())
    assert len(e) == len(EDGE) and all(a + n == b for (a, n), (b, _) in zip(e, e[1:]))
    assert token_files.read_tokens(token_files.write_tokens(empty)).count() == 0


def test_chat_edge(spark):
    rows = [(1, 0, "user", None, "x"), (1, 1, "assistant", "</s>[INST] ok [/INST]", "x"), (1, 1, "assistant", r"<\/s>", "x"), (None, 0, None, "<s>", "x"), (2, 5, "assistant", "", "x"), (2, 6, "user", LONG, "x")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segs string")
    ex = chat_format.chat_examples(conv)
    back = {r.conv_id: r for r in chat_format.read_back(ex).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", ""), *sorted([("assistant", "</s>[INST] ok [/INST]"), ("assistant", r"<\/s>")])]
    assert back[1].loss_text == "".join(t.text for t in back[1].turns[1:])
    assert [tuple(t) for t in back[None].turns] == [("", "<s>")] and back[None].loss_text == ""
    assert back[2].turns[1].text == LONG and back[2].loss_text == ""
    assert chat_format.chat_examples(conv.where("false")).count() == 0
    plan = queries.QUERIES["op8_chat_format"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_toxicity_held_out(spark, edge, empty):
    sf = SF.replace("sf0.001", "sf0.1")
    got = queries.QUERIES["op9_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out and toxic is not null").toPandas()
    rank, pos = got.score.rank(), got.toxic == 1
    n = pos.sum()
    auc = (rank[pos].sum() - n * (n + 1) / 2) / (n * (~pos).sum())
    assert auc > 0.9 and got.predicted[~pos].mean() < 0.03
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(edge, labels).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    assert toxicity.toxicity(empty, labels).count() == 0
    kept = toxicity.drop_toxic(edge, labels)
    assert kept.columns == edge.columns


def test_misspellings_share_vectors():
    rng = random.Random(0)
    plain = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    rows = []
    for k in range(600):
        words = rng.choices(plain, k=30) + (["scoundrelly"] if k % 3 == 0 else [])
        rows.append((int(k % 3 == 0), words, [1] * len(words)))
    m = toxicity.train(rows)
    assert m.score_words(["scoundrely"])[0] > max(0, np.quantile(m.score_words(plain), 0.95))
    assert toxicity.train([]).bias == 0


def lines_by_hand(rows):
    ws = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(ws).translate({c: c + 32 for c in range(65, 91)})
    docs = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 20:
                docs[key(x)].add(i)
    return {i: "\n".join(x for x in (t or "").split("\n") if not (len(docs[key(x)]) >= 3 and max(docs[key(x)]) != i)) for i, t in rows if i is not None}


def test_line_dedup_edge(edge, empty):
    want = lines_by_hand([(i, t) for i, t, _ in EDGE])
    got = line_dedup.line_dedup(edge)
    assert got.columns == [*edge.columns, "n_lines", "n_dropped"] and got.count() == len(EDGE)
    assert {r.doc_id: r.text or "" for r in got.collect() if r.doc_id is not None} == want
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_index_is_reversible(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    a, b = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    one, both = line_dedup.LineIndex.build(a), line_dedup.LineIndex.build(docs)
    grown = one.insert(b)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(grown.counts) == rows(both.counts)
    assert rows(grown.rewrite(docs)) == rows(both.rewrite(docs))
    back = grown.delete(b.select("doc_id"))
    assert rows(back.counts) == rows(one.counts) and rows(back.rewrite(a)) == rows(one.rewrite(a))


def test_line_index_of_many_shards(spark):
    rng = random.Random(4)
    lines = [f"a shared line of its own, number {k}" for k in range(400)]
    rows = [(i, "\n".join([*rng.sample(lines, 12), "one line that nearly all of the documents hold" if i % 8 else "short"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    index = line_dedup.LineIndex.build(docs, shard_keys=40)
    assert index.shards >= 5 and text(index.rewrite(docs)) == lines_by_hand(rows)
    counted = {(r.k1, r.k2): r.n for r in index.counts.collect()}
    for block in (7, 1 << 16):  # a hot line's references lie in many blocks
        got = [(r.k1, r.k2, r.doc) for r in index.hits(block).collect()]
        want = [(r.k1, r.k2, r.doc) for r in index.refs.collect() if counted[r.k1, r.k2] >= 3]
        assert len(got) == len(set(got)) and set(want) <= set(got) and len(got) <= 1.02 * len(want) + 2
    # a few documents build small filters, which the others outgrow
    few = line_dedup.LineIndex.build(docs.where("doc_id < 8"), shard_keys=40)
    grown = few.insert(docs.where("doc_id >= 8"))
    assert grown.shards > few.shards and text(grown.rewrite(docs)) == lines_by_hand(rows)
    back = grown.delete(docs.where("doc_id >= 8").select("doc_id"))
    assert text(back.rewrite(docs.where("doc_id < 8"))) == lines_by_hand(rows[:8])


def test_cuckoo():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(-(2**62), 2**62, 20_000))
    f = cuckoo.CuckooFilter.sized(len(keys))
    f.insert(keys)
    assert f.contains(keys).all() and f.contains(rng.integers(-(2**62), 2**62, 50_000)).mean() < 0.002
    f.delete(keys[:10_000])
    assert f.contains(keys[10_000:]).all() and f.contains(keys[:10_000]).mean() < 0.002
    assert (cuckoo.CuckooFilter.loads(f.dumps()).table == f.table).all()


def test_media_classes(spark):
    rng = np.random.default_rng(4)
    vec = rng.normal(size=(12, 64))
    images = []
    for k, v in enumerate(vec):
        base = media.draw(v, 0)
        images += [(10 * k, base), (10 * k + 1, base[9:89, 5:85]), (10 * k + 2, np.clip(base * 0.7 + 30, 0, 255)), (10 * k + 3, np.rot90(base)), (10 * k + 4, base)]
    rows = [(i, bytearray(media.pgm(x)), "x") for i, x in images] + [(900, None, "x"), (901, bytearray(b"no image"), "x"), (902, bytearray(media.pgm(np.zeros((96, 96)))), "x"), (None, bytearray(media.pgm(images[0][1])), "x"), (903, bytearray(media.pgm(np.ones((5, 5)))), "x")]
    df = spark.createDataFrame(rows, "doc_id long, img binary, set string")
    for block in (2048, 3):
        got = {r.doc_id: r.class_id for r in media.media_copies(df, "doc_id", "img", block=block).collect()}
        assert {i: got[i] for i, _ in images} == {i: i // 10 * 10 for i, _ in images}
        assert got[None] == 0 and [got[i] for i in (900, 901, 902, 903)] == [900, 901, 902, 903]
    assert media.media_copies(df.where("false"), "doc_id", "img").count() == 0


def test_media_links_do_not_depend_on_size(spark, monkeypatch):
    # two images whose five corners have just the first 40 tests alike, and one test of each later byte differing, among more than 2**14 others
    rng = np.random.default_rng(6)
    one = rng.integers(0, 256, (5, 32), dtype=np.uint8)
    two = one.copy()
    two[:, 5:] ^= 1
    geo = np.array([[20, 20, 1, 0], [20, 70, 1, 0], [70, 20, 1, 0], [70, 70, 1, 0], [45, 45, 1, 0]], np.float32).tobytes()
    others = rng.integers(0, 256, (16_500, 32), dtype=np.uint8)
    rows = [(0, bytearray(geo), bytearray(one.tobytes()), 5), (1, bytearray(geo), bytearray(two.tobytes()), 5)]
    rows += [(i, bytearray(geo[:16]), bytearray(b.tobytes()), 1) for i, b in enumerate(others, 2)]
    monkeypatch.setattr(media, "features", lambda m, i, c: m)
    got = {r.id: r.class_id for r in media.media_copies(spark.createDataFrame(rows, "id long, geo binary, bits binary, n int"), "id", "geo").collect()}
    assert got == {i: i if i > 1 else 0 for i in range(len(rows))}


def test_media_shared_keys_of_unlike_images_make_no_pairs(spark, monkeypatch):
    # 300 images whose five corners all have the same first 72 tests, so every two images share keys; the other tests differ, but for images 0 and 200, 1 and 201, ...
    rng = np.random.default_rng(9)
    bits = rng.integers(0, 256, (300, 5, 32), dtype=np.uint8)
    bits[:, :, :9] = bits[0, :, :9]
    bits[200:, :, 9:] = bits[:100, :, 9:] ^ (rng.random((100, 5, 23)) < 0.5)  # half of the bytes by one test each
    geo = np.array([[20, 20, 1, 0], [20, 70, 1, 0], [70, 20, 1, 0], [70, 70, 1, 0], [45, 45, 1, 0]], np.float32).tobytes()
    seen, verified = [], media._verified
    monkeypatch.setattr(media, "features", lambda m, i, c: m)
    monkeypatch.setattr(media, "_verified", lambda pairs, *rest: seen.append(pairs.count()) or verified(pairs, *rest))
    rows = [(i, bytearray(geo), bytearray(b.tobytes()), 5) for i, b in enumerate(bits)]
    df = spark.createDataFrame(rows, "id long, geo binary, bits binary, n int").repartition(4)
    for block in (2048, 50):
        got = {r.id: r.class_id for r in media.media_copies(df, "id", "geo", block=block).collect()}
        assert got == {i: i % 200 for i in range(300)}
    assert sum(seen) <= 2 * 300  # all pairs would be 44850 a run


def test_media_order_holds_every_test_once():
    assert sorted(media.ORDER) == list(range(media.BITS))


def turned(img, degrees, scale):
    """img turned about its centre and resized, bilinear; what comes from outside is grey."""
    a, (h, w) = np.deg2rad(degrees), img.shape
    y, x = np.mgrid[: int(h * scale), : int(w * scale)].astype(np.float32)
    y, x = (y - (int(h * scale) - 1) / 2) / scale, (x - (int(w * scale) - 1) / 2) / scale
    yy, xx = np.cos(a) * y - np.sin(a) * x + (h - 1) / 2, np.sin(a) * y + np.cos(a) * x + (w - 1) / 2
    src = media.blur(img[None].astype(np.float32))[0] if scale < 1 else img.astype(np.float32)
    y0, x0 = np.clip(np.floor(yy).astype(int), 0, h - 2), np.clip(np.floor(xx).astype(int), 0, w - 2)
    fy, fx = np.clip(yy - y0, 0, 1), np.clip(xx - x0, 0, 1)
    out = src[y0, x0] * (1 - fy) * (1 - fx) + src[y0 + 1, x0] * fy * (1 - fx) + src[y0, x0 + 1] * (1 - fy) * fx + src[y0 + 1, x0 + 1] * fy * fx
    return np.where((yy < 0) | (yy > h - 1) | (xx < 0) | (xx > w - 1), 128, np.rint(out))


EDITS = [(5, 1), (10, 1), (20, 1), (30, 1), (45, 1), (0, 0.5), (0, 0.67), (0, 0.8), (0, 1.25), (0, 1.5), (0, 2), (15, 0.8)]


@pytest.mark.parametrize("n", [40, 160])
def test_media_recall(spark, n):
    # every image against all edited ones: which pairs does the consensus confirm, and which of them share a class?
    vec = np.random.default_rng(8).normal(size=(n, 64))
    base = [media.draw(v, 0) for v in vec]
    rows = [(k, bytearray(media.pgm(x))) for k, x in enumerate(base)]
    rows += [(n + k, bytearray(media.pgm(np.clip(turned(x, *EDITS[k % len(EDITS)]), 0, 255)))) for k, x in enumerate(base)]
    got = {r.id: r.class_id for r in media.media_copies(spark.createDataFrame(rows, "id long, img binary").repartition(4), "id", "img").collect()}
    corners = [media.describe(media.read_pgm(bytes(b))[None])[0] for _, b in rows]
    told = [(a, n + b) for a in range(n) for b in range(n) if media.consensus(corners[a], corners[n + b], 48) >= 5]
    assert len(told) > 0.9 * n and {b - a for a, b in told} == {n}  # no unlike pair is confirmed
    assert np.mean([got[a] == got[b] for a, b in told]) > 0.8
    assert all(c == i % n for i, c in got.items() if c != i)


def test_media_of_any_size(spark):
    rng = np.random.default_rng(2)
    small = np.kron(rng.integers(0, 256, (40, 30)), np.ones((4, 4))).astype(np.uint8)
    large = np.kron(small, np.ones((60, 60), np.uint8))  # 9600 x 7200
    shrunk, by = media.pooled(large)
    assert by == 3 and shrunk.shape == (3200, 2400) and media.pooled(small)[1] == 1
    df = spark.createDataFrame([(1, bytearray(media.pgm(large[:, ::-1]))), (2, bytearray(media.pgm(large[100:, 50:-40])))], "id long, img binary")
    assert df.select("id").count() == 2 and all(r.n > 0 for r in media.features(df, "id", "img").select("n").collect())


def test_media_copies_without_corners(spark):
    blank, icon = media.pgm(np.zeros((96, 96))), media.pgm(np.arange(256).reshape(16, 16))
    rows = [(5, blank), (4, blank), (None, blank), (9, icon), (8, icon), (6, b"no image"), (7, b"no image"), (3, media.pgm(np.ones((96, 96)))), (1, None), (2, None)]
    df = spark.createDataFrame([(i, x and bytearray(x)) for i, x in rows], "id long, img binary")
    got = {r.id: (r.n_corners, r.class_id) for r in media.media_copies(df, "id", "img").collect()}
    assert got == {i: (0, c) for i, c in ((5, 4), (4, 4), (None, 4), (9, 8), (8, 8), (6, 6), (7, 6), (3, 3), (1, 1), (2, 2))}


def test_components(spark):
    from arbordoc.llm.graph import components

    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)] + [(7, 7), (None, 3)]
    want = roots_of({x for e in edges if None not in e and e[0] != e[1] for x in e}, [e for e in edges if None not in e and e[0] != e[1]])
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(0, 1000, 3)
    hit = common.with_hit(spark.range(1000), common.bitmap(keys, 16, "id"), 16, "hit", "id")
    assert hit.where("id % 3 = 0 and not hit").count() == 0 and hit.where("id % 3 <> 0 and hit").count() < 50


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in p.STAGES:
        before = docs
        docs = common.stash(stage(spark, docs, SF), f"test-{name}")
        n, m = before.count(), docs.count()
        if name == "toxicity":
            assert 0.8 * n <= m <= n and docs.exceptAll(before).isEmpty()
        elif name == "line_dedup":
            assert {r.doc_id: r.text or "" for r in docs.collect()} == lines_by_hand([(r.doc_id, r.text) for r in before.collect()])
            assert docs.where("n_chars <> char_length(text)").isEmpty() or not before.where("n_chars <> char_length(text)").isEmpty()
        elif name == "simhash":
            fp = {r.doc_id: fingerprint(r.text) for r in before.collect()}
            ids = sorted(fp)
            root = roots_of(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 4])
            assert {r.doc_id for r in docs.collect()} == set(root.values())
        elif name == "mixing":
            want = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
            assert {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()} == want
        else:
            t = tokenizer()
            want = sorted((r.doc_id, np.array(t.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()) for r in before.collect())
            assert sorted((r.doc_id, bytes(r.ids)) for r in docs.collect()) == want
        if name != "bpe":
            assert docs.columns == before.columns


def test_bpe_on_hash_collisions_and_long_words(monkeypatch):
    t = tokenizer()
    rng = random.Random(8)
    texts = ["x" * 3000, "漢字" * 40 + " " + "ab'c" * 400, "z" * 70, "", " ".join("".join(rng.choices("abcdef", k=rng.randint(1, 5))) for _ in range(400))]
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]

    def check(b):
        ids, n = b.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want

    check(bpe.Bpe(bpe.default_vocabulary()))
    b = bpe.Bpe(bpe.default_vocabulary(), max_words=50)  # forgets its words before each call
    check(b)
    check(b)
    # every word has one of two hashes: all but two words of a call are found out by comparing them
    monkeypatch.setattr(bpe, "_powers", lambda n: (np.zeros(n, np.uint64), np.zeros(n, np.uint64)))
    b = bpe.Bpe(bpe.default_vocabulary())
    check(b)
    check(b)


def test_hash_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 1 << 63, 20_000, dtype=np.uint64))
    t = hashing.Table(4)
    for part in np.array_split(np.arange(len(keys)), 7):
        t.add(keys[part], part.astype(np.int32))
    assert (t.get(keys) == np.arange(len(keys))).all() and (t.get(keys + np.uint64(1)) == -1).mean() > 0.99


def test_pipeline_on_edge_rows_and_no_rows(spark, edge):
    import corpus_pipeline as p

    docs = edge.select("doc_id", "text", F.lit("xx").alias("lang"), "source", F.char_length("text").cast("long").alias("n_chars"))
    for table in (docs, docs.where("false")):
        out = table
        for k, (_, stage) in enumerate(p.STAGES):
            before, out = out.count(), common.stash(stage(spark, out, SF), "test-edge")
            assert out.count() <= (3 if k == 3 else 1) * before
            assert k == len(p.STAGES) - 1 or out.columns == docs.columns
        assert (out.count() == 0) == table.isEmpty()
