"""Each operator against a brute-force version, a round trip or held-out accuracy, and on odd rows."""

import hashlib
import math
import random
import re
import statistics
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, common, exact_dedup, langid, mixing, ngram_join, quality, queries, secrets, sharding, suffix_dedup, topk
from weftline.llm.components import components

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (None, "a text without an id", "en", None, 1), (None, "a text without an id", "en", None, 1),
    (3, "same words here and there again", "en", "a", 5), (3, "same words here and there again", "en", "a", 5), (4, "Same  WORDS here\nand there again", "fr", "b", 5),
    (5, " \t\r\n", "en", "b", 4), (6, "密码 password=abcdef123456 😀", None, "c", 9), (7, "long " * 20_000, "en", "a", 100_000), (8, "0123456789" * 60, "de", "a", 600),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids; an extra column whose name clashes."""
    return spark.createDataFrame(ODD, DOCS).withColumn("score", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("ids", F.lit(0))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1


def brute_topk(rows, k):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 3 == 0:
            scored = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [(2048, 1 << 16), (3, 7)])
def test_topk(spark, blocks):
    r = random.Random(1)
    rows = [(i, [r.choice([0.0, 0.5, -0.5, r.random()]) for _ in range(r.choice([4, 5]))]) for i in range(60)]
    rows += [(100, None), (None, [1.0]), (102, [1.0, None]), (103, [float("nan")]), (105, [float("inf")]), (108, []), (111, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("id", F.lit(0))
    got = topk.exact_topk(df, F.col("vec_id") % 3 == 0, 5, query_block=blocks[0], row_block=blocks[1])
    assert tuples(got) == brute_topk(rows, 5)


def test_topk_of_nothing(spark):
    assert topk.exact_topk(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 3 == 0).count() == 0


# 2

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def listed(found):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in found)


def brute_random(text, base, model, least=16):
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % least, text or ""):
        if not any(a < m.end() and m.start() < b for a, _, b in base):
            r = sum(model[128 * ord(x) + ord(y)] for x, y in zip(m[0], m[0][1:], strict=False))
            if r >= max(12.0, 0.4 * len(m[0])):
                out.append((m.start(), 3, m.end()))
    return out


def test_secrets(spark, odd):
    texts = [
        "password=token:abcdefgh", "Password: 'abc' token = \"abcdef\" 😀 api_key=ABCDEF apikey:xyz-._=/+9", "AKIA" + "A" * 15, "AKIA" + "AKIA" * 4 + "x", "aKIA" + "Z" * 30, "é" * 3 + "0123456789abcdef01234567" + "g" + "f" * 23,
        "an ordinaryidentifierofsomelength and qZ8x2LpW0v9TgR4kY7nB", None, "", "secret == abcdefg", "x" * 50_000 + " token=abcdefg " * 300, "anidentifierofsomelength " * 60_000, "token=abcdefg " * 256,
    ]
    rows = list(enumerate(texts)) + [(r[0], r[1]) for r in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit(1)).withColumn("base", F.lit("x"))
    model = secrets.train(secrets.labelled_samples(spark.read.parquet(f"{SMALL}/documents.parquet")))
    got = tuples(secrets.secret_report(secrets.find_secrets(df, model)))
    want = []
    for i, t in rows:
        base = brute_secrets(t)
        kinds = Counter(k for _, k, _ in base)
        want.append((i, kinds[0], kinds[1], kinds[2], hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + brute_random(t, base, model)))))
    assert got == sorted(want, key=repr)
    assert any("random" in r[5] for r in got)


def test_random_strings_are_told_from_words(spark):
    """Held-out strings, and words that the model has not seen."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = secrets.train(secrets.labelled_samples(docs.where("doc_id % 2 = 0")))
    r = random.Random(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    strings = ["".join(r.choices(alphabet, k=24)) for _ in range(200)]
    words = [w for row in docs.where("doc_id % 2 = 1").select("text").collect() for w in re.findall(r"[A-Za-z]{16,}", row[0] or "")]
    rows = [(i, t) for i, t in enumerate(strings + words)]
    found = {x["doc_id"] for x in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), model).where(F.size("random") > 0).collect()}
    assert sum(i in found for i in range(200)) >= 190
    assert sum(i in found for i in range(200, len(rows))) <= 0.02 * len(words)


def test_no_samples_mean_no_finds(spark, empty):
    model = secrets.train(spark.createDataFrame([], "word string, is_random boolean"))
    assert not any(model)
    assert secrets.find_secrets(empty, model).count() == 0


# 3


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        out.append((i, len(sets[a]), min(ids, default=None) if sets[a] else i))
    return sorted(out, key=repr)


def families(seed, count, vocabulary):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    rows = []
    for _ in range(count):
        base = r.choices(words, k=r.choice([3, 5, 6, 9, 12, 20, 30, 60]))
        for _ in range(r.randrange(1, 10)):
            text = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("few,block", [(64, 1024), (2, 3)])
def test_ngram_join(spark, few, block):
    rows = families(3, 14, 40) + [(1000 + (r[0] or 0) if r[0] else None, r[1]) for r in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("n", F.lit(1)).withColumn("label", F.lit("x"))
    assert tuples(ngram_join.jaccard_components(df, few=few, block=block)) == brute_components(rows)


def test_ngram_join_of_nothing(empty):
    assert ngram_join.jaccard_components(empty).count() == 0


def test_signatures_miss_no_link():
    """Sets that differ just as much as a link allows share a signature, at many sizes."""
    r = np.random.default_rng(4)
    for n in [2, 4, 5, 6, 9, 10, 15, 24, 40, 100, 333, 1000]:
        for _ in range(20):
            x = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
            out = int(r.integers(0, n // 5 + 1))  # of the smaller set's items; the other may have more
            kept = x[out:]
            more = max(0, int(len(kept) * 5 / 4) - n)
            y = np.unique(np.concatenate([kept, r.integers(0, 1 << 62, int(r.integers(0, more + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if not len(y) or 100 * both < 80 * (len(x) + len(y) - both) or np.array_equal(x, y):
                continue
            row, value = ngram_join.signatures([x, y])
            assert np.isin(value[row == 0], value[row == 1]).any(), (n, out)
            far = ngram_join.folded([ngram_join.sketch(x), ngram_join.sketch(y)])
            assert ngram_join.possible(far[0], np.array(len(x)), far[1], np.array(len(y)))


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few):
    r = random.Random(5)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)]
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(links, "a long, b long"), few).collect()}
    parent = {x: x for e in links for x in e}
    for _ in parent:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: p for x, p in parent.items() if any(x in e and e[0] != e[1] for e in links)}


# 4


def test_language_accuracy(spark):
    got = queries.op4_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert statistics.mean(r["lang_pred"] == r["lang"] for r in got) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got} <= {i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_language_of_odd_rows(spark, odd, empty):
    model = langid.fit_languages(odd)
    got = {(r["doc_id"], r["text"]): r for r in langid.predict_languages(odd, model).collect()}
    assert len(got) == len(set((r[0], r[1]) for r in ODD))
    assert all(got[i, t]["lang_pred"] == "und" and got[i, t]["score"] == 0 for i, t in ((1, None), (2, ""), (5, " \t\r\n"), (8, "0123456789" * 60)))
    assert got[7, "long " * 20_000]["lang_pred"] in {"en", "fr", "de"}
    none = langid.fit_languages(empty)
    assert {r["lang_pred"] for r in langid.predict_languages(odd, none).collect()} == {"und"}
    assert langid.predict_languages(empty, model).count() == 0


def test_whole_text_scores_equal_document_vectors():
    texts = ["Der Hund läuft", "the dog runs", "x", "", "ab " * 1000]
    model = langid.train([("der hund und die katze", "de"), ("the dog and the cat", "en")] * 10)
    for t, z in zip(texts, model.logits(texts), strict=True):
        ids, tf = langid.document_counts(t, model.bits)
        assert np.allclose(z, (tf * model.idf[ids]) @ model.weights[ids] + model.bias, atol=1e-4)


# 5


@pytest.mark.parametrize("n,parts", [(0, 3), (5, 4), (1000, 7)])
def test_sharding(spark, n, parts):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.crc32(F.lit("same").cast("binary")).alias("text_crc32"), F.lit(9).alias("slot"))
    got = sharding.shuffle_into_shards(df, 16, 3, parts=parts).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(n))
    per = Counter(r["shard"] for r in got)
    assert all(per[s] == n // 16 + (s < n % 16) for s in range(16))
    for s in per:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(per[s]))
    again = sharding.shuffle_into_shards(df.repartition(5), 16, 3, parts=parts).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_sharding_of_odd_rows(spark, odd):
    got = sharding.shuffle_into_shards(odd, 4, key_cols=("doc_id", "text"), parts=3).collect()
    assert sorted(repr((r["doc_id"], r["text"])) for r in got) == sorted(repr((r[0], r[1])) for r in ODD)


def test_matrix_is_hypergeometric():
    draws = np.stack([sharding.communication_matrix([6, 4, 2], 3, s) for s in range(4000)])
    assert (draws.sum(axis=1) == 4).all() and (draws.sum(axis=2) == [6, 4, 2]).all()
    assert np.allclose(draws.mean(axis=0), np.outer([6, 4, 2], [4, 4, 4]) / 12, atol=0.06)
    assert abs(draws[:, 0, 0].var() - 6 * (1 / 3) * (2 / 3) * 6 / 11) < 0.06


# 6


def test_quality_on_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.op6_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    good = [r for r in got if r["quality"] == 1]
    bad = [r for r in got if r["quality"] == 0]
    assert statistics.mean(r["predicted"] for r in good) > 0.9
    better = [(a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for a in good for b in bad]
    assert statistics.mean(better) > 0.85


def test_quality_of_odd_rows(spark, odd, empty):
    net = quality.train([(b"good words here", 1), (b"$$$ ### $$$", 0)] * 8, epochs=3)
    got = quality.score_quality(odd, net).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if not r["text"]}) == 1
    assert quality.score_quality(empty, net).count() == 0
    assert quality.train([]).scores([b"x"])[0] == 0.5
    assert quality.train([(b"x", 1)]).scores([b"y"])[0] > 0.5


def test_gradients_against_differences():
    net = quality.ByteNet.fresh(1)
    net.bias += 0.1
    x = quality.Layout.of([b"some bytes of a document", b"ab", bytes(range(200)) * 6])
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        p = net.scores([b"some bytes of a document", b"ab", bytes(range(200)) * 6])
        return float(np.mean(-w * (y * np.log(p) + (1 - y) * np.log(1 - p))))

    grads = net.train_step(x, y, w)
    r = np.random.default_rng(2)
    for p, g in zip(net.parameters(), grads, strict=True):
        for at in [tuple(r.integers(0, s) for s in p.shape) for _ in range(6)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            old = p[at]
            p[at] = old + 1e-3
            up = loss()
            p[at] = old - 1e-3
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-3 - g[at]) < 0.02 * max(0.05, abs(g[at]))


# 7


def brute_copies(rate, seed, i):
    pieces = max(1, math.ceil(rate / 16))
    total = 0
    for j in range(1, pieces + 1):
        u = int(hashlib.md5(f"{seed}:{'null' if i is None else i}:{j}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate / pieces)
        for k in range(1, 102):
            if c > u:
                break
            total += 1
            p *= rate / pieces / k
            c += p
    return total


def test_mixing(spark):
    rows = [(i, "ab"[i % 10 == 0], i % 7 + 1) for i in range(600)] + [(900, None, 3), (None, "a", 2), (901, "unwanted", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("copy", F.lit(5))
    weights = {"a": 1.0, "b": 3.0}
    out = mixing.mix_sources(df, weights, 5.0, 11, size=F.col("size"))
    got = Counter(r["doc_id"] for r in out.collect())
    has = Counter()
    for _, s, n in rows:
        has[s] += n
    rate = {s: weights.get(s, 0) * sum(has.values()) * 5.0 / (sum(weights.values()) * has[s]) for s in has}
    want = {i: n for i, s, _ in rows if (n := brute_copies(rate[s], 11, i))}
    assert got == want
    shares = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    assert set(shares) == {"a", "b"} and abs(shares["b"] / sum(shares.values()) - 0.75) < 0.05
    keys = [r["shuffle_key"] for r in out.collect()]
    assert keys == sorted(keys)


def test_mixing_of_odd_rows(spark, odd, empty):
    assert mixing.mix_sources(empty).count() == 0
    out = mixing.mix_sources(odd, epochs=3.0)
    assert {r["doc_id"] for r in out.collect()} <= {r[0] for r in ODD}
    assert mixing.mix_sources(odd, {}).count() == 0


# 8


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        t = t or ""
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t), []).append((-len(t), i is None, i or 0, i))
    return sorted(((i, min(g := groups[k])[3], len(g), i == min(g)[3], hashlib.sha256(k.encode()).hexdigest()) for i, t in rows for k in [re.sub("[\x20\x09-\x0d]", "", t or "")]), key=repr)


@pytest.mark.parametrize("budget", [48 << 20, 300])
def test_exact_dedup(spark, odd, empty, budget):
    got = exact_dedup.exact_dedup(odd.repartition(3), budget, parts=2)
    assert tuples(got) == brute_exact([(r[0], r[1]) for r in ODD])
    assert exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("budget", [0, 500, 5000, 1 << 20])
def test_grace(budget):
    r = random.Random(8)
    rows = [(bytes(r.choices(b"ab", k=r.randrange(12))), 1, (r.randrange(3), r.choice([None, *range(9)]))) for _ in range(3000)]
    for hashed in (exact_dedup.hash_of, lambda c, level: exact_dedup.hash_of(c, level) % (5 if level < 3 else 1 << 60)):
        got = {c: (n, best) for c, n, best in exact_dedup.grace(iter(rows), budget, hashed=hashed)}
        want = {}
        for c, n, best in rows:
            have = want.get(c)
            want[c] = (n, best) if have is None else (have[0] + n, min(have[1], best, key=lambda x: (-x[0], x[1] is None, x[1] or 0)))
        assert got == want


# 9


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.TOKENIZER)


def test_bpe_against_library(library):
    r = random.Random(9)
    own = bpe.WordBpe(open(queries.TOKENIZER).read(), most_words=500)
    words = "the of password= don't we'll İstanbul ΣΑΣ naïve \x85 \xa0 日本語 12345 <|endoftext|> <|startoftext|> 😀!! a\x1cb \0 ²³ ½ ﬁ Ⅷ ñandú I'M'd ĸŉ é".split(" ")
    texts = [" ".join(r.choices(words, k=9)) for _ in range(60)] + ["".join(r.choices(words, k=5)) for _ in range(60)] + ["".join(r.choices("abcdeth in", k=70)) for _ in range(200)] + ["", "a" * 5000, "ab" * 700]
    texts += ["".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(0x250, 0xD7FF), r.randrange(0x10000, 0x11000)])) for _ in range(40)) for _ in range(60)]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want, t
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_shared_prefixes_equal_textbook_merges():
    own = bpe.WordBpe(open(queries.TOKENIZER).read())
    r = random.Random(10)
    words = {"".join(r.choices("abehinrst", k=r.randrange(1, 14))) for _ in range(400)}
    own.learn(words)
    for w in words:
        assert own.encoding(w) == own.merged([own.vocab[c] for c in w[:-1]] + [own.vocab[w[-1] + bpe.END]])


def test_bpe_of_odd_rows(odd, empty, library):
    out = bpe.encode_documents(odd, queries.TOKENIZER)
    assert "kept" in out.columns and len(out.columns) == len(set(out.columns))
    got = out.select("doc_id", *bpe.token_digest(out))
    want = []
    for i, t, *_ in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert tuples(got) == sorted(want, key=repr)
    assert bpe.encode_documents(empty, queries.TOKENIZER).count() == 0


# 10


def brute_spans(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length,gram,segment,crowd", [(40, 10, 1 << 22, 1000), (30, 30, 64, 4), (25, 7, 50, 0)])
def test_suffix_dedup(spark, length, gram, segment, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    r = random.Random(6)
    base = "".join(r.choices("abé ", k=300))
    rows = []
    for k in range(50):
        t = base
        for _ in range(r.randrange(4)):
            p = r.randrange(len(t))
            t = t[:p] + r.choice(["x", "yy", ""]) + t[p + r.randrange(3) :]
        a = r.randrange(200)
        rows.append((k, r.choice([t, t[a:], t[:a], "aaaa" * r.randrange(60), None, "", t + t[:a]])))
    rows += [(None, base), (None, base), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("kept", F.lit(1)).withColumn("key", F.lit("x"))
    got = suffix_dedup.repeated_spans(df, length, gram, crowd=crowd)
    assert tuples(got.select("doc_id", *suffix_dedup.removal_digest())) == brute_spans(rows, length)


def brute_passages(rows, words):
    """Runs of bytes that windows of words cover which start anywhere else too."""
    found = [[(m[0], *m.span()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for _, t in rows]
    window = lambda w, p: tuple(x[0] for x in w[p : p + words])
    count = Counter(window(w, p) for w in found for p in range(len(w) - words + 1))
    out = []
    for (i, _), w in zip(rows, found, strict=True):
        runs: list[list[int]] = []
        for p in range(len(w) - words + 1):
            if count[window(w, p)] > 1:
                if runs and w[p][1] <= runs[-1][1]:
                    runs[-1][1] = w[p + words - 1][2]
                else:
                    runs.append([w[p][1], w[p + words - 1][2]])
        out.append((i, [tuple(x) for x in runs]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("words,segment", [(9, 1 << 22), (16, 40), (1, 50)])
def test_passages(spark, words, segment, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    r = random.Random(8)
    base = r.choices(["a", "bé", "word", "x" * 70, "Word"], k=120)
    rows = []
    for k in range(60):
        t = list(base)
        for _ in range(r.randrange(6)):
            t[r.randrange(len(t))] = f"w{r.randrange(10**6)}"
        a = r.randrange(120)
        t = r.choice([t, t[a:], t[:a], ["again"] * r.randrange(40), [], t + t[:a]])
        rows.append((k, r.choice(["", " ", "\n"]) + r.choice([" ", "\n", " \t"]).join(t)))
    rows += [(None, " ".join(base)), (None, " ".join(base)), (5, rows[5][1]), (61, None), (62, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.repeated_spans(df, 40, 10, words=words)
    assert sorted(((x["doc_id"], [tuple(s) for s in x["passages"]]) for x in got.collect()), key=repr) == brute_passages(rows, words)
    assert tuples(got.select("doc_id", *suffix_dedup.removal_digest())) == brute_spans(rows, 40)


def test_passages_of_over_50_words_are_found_and_short_ones_stay(spark, tmp_path):
    """A passage of 51 words in under 400 bytes is reported; the contract removes none of it, and n_bytes is the input's length."""
    r = random.Random(9)
    some = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))
    planted, short, long = some(51), some(50), some(90)
    rows = [(i, f"{some(40)} {(planted, short, long, some(60))[i % 4]} {some(30)}") for i in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.op10_suffix_dedup(spark, str(tmp_path)).collect()}
    for i, t in rows:
        at = t.index((planted, "", long, "")[i % 4])
        assert got[i]["n_passages"] == (1, 0, 1, 0)[i % 4]
        assert got[i]["passages"] == ("" if i % 2 else f"{at}:{at + len((planted, '', long, '')[i % 4])}")
        assert got[i]["n_bytes"] == len(t)
        assert got[i]["n_removed"] > 0 if i % 4 == 2 else got[i]["text"] == t
    assert sorted((tuple(got[i][c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in got), key=repr) == brute_spans(rows, 400)


def test_suffix_dedup_of_odd_rows(odd, empty):
    got = suffix_dedup.repeated_spans(odd)
    rows = [(r[0], r[1]) for r in ODD if r[0] != 7]
    assert tuples(got.where("doc_id is null or doc_id <> 7").select("doc_id", *suffix_dedup.removal_digest())) == brute_spans(rows, 400)
    assert got.where("doc_id = 7").first()["kept"] == b""
    assert suffix_dedup.repeated_spans(empty).count() == 0


def test_levels(monkeypatch):
    """Order and marks of suffixes that come in many batches equal those of a plain sort."""
    monkeypatch.setattr(suffix_dedup, "SORTED", 50)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 16)
    r = random.Random(3)
    levels, bodies = suffix_dedup.SuffixLevels(), []
    for _ in range(30):
        some = [bytes(r.choices(b"ab\0", k=r.randrange(8, 40))) for _ in range(r.randrange(1, 4))]
        for batch in suffix_dedup.suffixes_of(some, len(bodies), 8):
            levels.add(batch)
            sizes = [len(x) for x in levels.levels]
            assert all(x > 2 * y for x, y in zip(sizes, sizes[1:], strict=False))
        bodies += some
    array = levels.finish()
    found = [bodies[t >> 24][t & 0xFFFFFF :][:8] for t in array.tag.tolist()]
    want = Counter(b[p : p + 8] for b in bodies for p in range(len(b) - 7))
    assert found == sorted(want.elements())
    assert array.again.tolist() == [want[x] > 1 for x in found]


def thue_morse(n, a="a", b="b"):
    t = [a]
    while len(t) < n:
        t += [b if x == a else a for x in t]
    return "".join(t[:n])


def test_structured_strings_have_hashes_of_their_own(spark):
    """Two complementary Thue-Morse strings, on which polynomials modulo 2^64 collide: as words, and within regions."""
    x, y = thue_morse(2048), thue_morse(2048, "b", "a")
    for n in (8, 64, 65, 256, 2048):
        data = np.frombuffer((x[:n] + y[:n]).encode(), np.uint8)
        h = common.range_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
        w = common.window_hashes(data, n)
        assert h[0] != h[1] and w[0] != w[n]
    got = ngram_join.jaccard_components(spark.createDataFrame([(1, f"start {x[:256]}"), (2, f"start {y[:256]}")], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(1, 1), (2, 2)]
    r = random.Random(4)
    noise = lambda: "".join(r.choices("cdefgh", k=170))
    p, q = noise(), noise()
    rows = [(k, (p if k % 2 else noise()) + (x if r.random() < 0.5 else y)[:256] + (q if k % 3 else noise())) for k in range(60)]
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert tuples(got.select("doc_id", *suffix_dedup.removal_digest())) == brute_spans(rows, 400)


@pytest.mark.parametrize("width", [1, 7, 96, 100])
def test_window_hashes(width):
    """Equal windows have equal hashes wherever they are; others do not."""
    r = random.Random(width)
    t = bytes(r.choices(b"ab", k=300)) * 2
    h = common.window_hashes(np.frombuffer(t, np.uint8), width)
    assert len(h) == len(t) - width + 1
    assert len(set(h.tolist())) == len({t[i : i + width] for i in range(len(h))})
    assert len({(t[i : i + width], v) for i, v in enumerate(h.tolist())}) == len(set(h.tolist()))


@pytest.mark.parametrize("master,set_", [("local[2]", True), ("local", True), ("spark://host:7077", False), ("local-cluster[2,1,512]", False), ("yarn", False)])
def test_shared_folder_must_be_named_on_a_cluster(master, set_):
    conf = {}
    spark = SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))
    if set_:
        assert common.shared_dir(spark) == conf["spark.checkpoint.dir"]
    else:
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_dir(spark)


# Columns whose names the operators use themselves

NAMES = (
    "_text _source _rate _pieces _steps _copy _of _size _part _ends _nth _mixed _cell _at _row _points source_ rate pieces steps of part ends nth mixed cell at row own copy n_copies shuffle_key size has weight "
    "score lang_pred predicted held_out text_sha256 keep_id group_size kept ids decoded shard slot label cid n second sketch digest _digest key doc blob kind id sha best one words terms asks qb rb spans n_bytes least none first"
).split()


@pytest.fixture(scope="module")
def clashing(spark, odd):
    df = spark.createDataFrame(ODD, DOCS)
    return df.select("*", *(F.lit(f"mine-{x}").alias(x.upper() if k % 3 == 0 else x) for k, x in enumerate(NAMES)))


def untouched(df, but=()):
    """Whether each row still has the extra columns as they were."""
    mine = [c for c in df.columns if c.lower() in NAMES and c.lower() not in but]
    assert len(mine) >= len(NAMES) - len(but) and len({c.lower() for c in df.columns}) == len(df.columns)
    for r in df.collect():
        assert all(r[c] == f"mine-{c.lower()}" for c in mine)


def test_clashing_columns_of_operators(spark, clashing):
    languages = langid.train([("der hund und die katze", "de"), ("the dog and the cat", "en")] * 10)
    untouched(langid.predict_languages(clashing, languages), {"lang_pred", "score"})
    untouched(quality.score_quality(clashing, quality.train([])), {"score", "predicted"})
    untouched(bpe.encode_documents(clashing, queries.TOKENIZER), {"ids", "decoded"})
    untouched(mixing.mix_sources(clashing), {"copy", "n_copies", "shuffle_key"})
    untouched(sharding.shuffle_into_shards(clashing, 4, key_cols=("doc_id", "text"), parts=3), {"shard", "slot"})
    plain = spark.createDataFrame(ODD, DOCS)
    for f in (exact_dedup.exact_dedup, ngram_join.jaccard_components, suffix_dedup.repeated_spans, lambda d: secrets.find_secrets(d, secrets.train(spark.createDataFrame([], "word string, is_random boolean")))):
        assert tuples(f(clashing)) == tuples(f(plain))
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)], "vec_id long, embedding array<float>")
    more = vectors.select("*", *(F.lit("x").alias(x) for x in NAMES))
    assert tuples(topk.exact_topk(more, F.col("vec_id") == 0)) == tuples(topk.exact_topk(vectors, F.col("vec_id") == 0))


# Sizes and rates beyond those of any table here


def test_matrix_beyond_a_billion_rows():
    got = sharding.communication_matrix([10**8] * 12 + [10**12], 16, 1)
    assert (got.sum(axis=1) == [10**8] * 12 + [10**12]).all() and np.ptp(got.sum(axis=0)) <= 1
    part = got[0] / 10**8 - 1 / 16  # standard deviation about 2.4e-5
    assert np.abs(part).max() < 2e-4 and part.any()


def test_large_draws_follow_the_distribution(monkeypatch):
    """The rejection sampler, used for small populations too, against exact chances."""
    monkeypatch.setattr(sharding, "MOST", 0)
    draw = np.random.default_rng(8)
    for good, bad, n in ((7, 5, 6), (3, 40, 20), (300, 200, 100), (1, 1, 1), (50, 2, 51)):
        got = Counter(sharding.hypergeometric(draw, good, bad, n) for _ in range(6000))
        want = {k: math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(max(0, n - bad), min(n, good) + 1)}
        assert set(got) <= set(want)
        off = sum((got[k] - 6000 * p) ** 2 / (6000 * p) for k, p in want.items() if 6000 * p > 5)
        assert off < 3 * sum(6000 * p > 5 for p in want.values()) + 15


def test_a_tiny_source(spark):
    """One row of a byte beside rows of 20,000: thousands of copies, as the distribution says; beyond the limit an error."""
    rows = [(0, "tiny", 1)] + [(i, "large", 20_000) for i in range(1, 10)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = Counter(r["doc_id"] for r in mixing.mix_sources(df, size=F.col("size")).collect())
    rate = 180_001 / 2
    assert got[0] == brute_copies(rate, 7, 0) and abs(got[0] - rate) < 6 * rate**0.5
    copies = mixing.mix_sources(df, size=F.col("size")).where("doc_id = 0").agg(F.countDistinct("copy"), F.min("copy"), F.max("copy"), F.min("n_copies")).first()
    assert tuple(copies) == (got[0], 0, got[0] - 1, got[0])
    with pytest.raises(ValueError, match="most_rate"):
        mixing.mix_sources(df, size=F.col("size"), most_rate=1000.0)
    huge = spark.createDataFrame([(0, "tiny", 1)] + [(i, "large", 10**13) for i in range(49)], "doc_id long, source string, size long")
    with pytest.raises(ValueError, match="most_rate"):
        mixing.mix_sources(huge, size=F.col("size"))


def test_topk_deals_rows_to_all_cores(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "LEAST_ROWS", 20)
    monkeypatch.setattr(topk, "MOST_PARTS", 5)
    got = topk.exact_topk(df, F.col("vec_id") % 3 == 0, 5)
    assert tuples(got) == brute_topk(rows, 5)


def test_numerals_are_no_letters():
    model = langid.train([("der hund und die katze", "de"), ("the dog and the cat", "en")] * 10)
    labels, scores = model.predict(["½ ²", "Ⅷ", "12 _ !", "a½", "日", "ª"])
    assert [x == "und" for x in labels] == [True, True, True, False, False, False]
    assert scores[:3] == [0.0] * 3


def test_class_ids_that_clash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ID_BITS", np.uint64(3))
    rows = families(3, 14, 40)
    assert tuples(ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))) == brute_components(rows)


@pytest.mark.parametrize("length", [16, 24, 32, 64])
def test_random_strings_of_many_lengths(spark, length):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = secrets.train(secrets.labelled_samples(docs))
    r = random.Random(length)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [(i, "".join(r.choices(base64, k=length))) for i in range(150)] + [(150 + i, "".join(r.choices("0123456789abcdef", k=length))) for i in range(150)]
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), model).where((F.size("random") > 0) | (F.size("base") > 0))
    ids = {x["doc_id"] for x in found.collect()}
    assert sum(i < 150 for i in ids) >= 0.9 * 150  # about the threshold at 16
    assert sum(i >= 150 for i in ids) >= (0.9 if length >= 24 else 0.5) * 150
