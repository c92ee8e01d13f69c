"""Near-dedup, components, language id, PPM and the permutation index against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import ann, langid, minhash, ppm
from quillon.llm._common import text_bytes
from quillon.llm.components import components

DATA = "/root/testdata"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# components


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, i) for i in range(101, 140)] + [(200 + i, 201 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    used = {n for a, b in edges if a != b for n in (a, b)}
    assert got == plain_components(used, [(a, b) for a, b in edges if a != b])


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# MinHash


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "A", "b", "é", "ccc", " ", "\n", "\x0b", " ", "Z."]), max_size=25), min_size=1, max_size=6))
def test_shingle_sets_agree_with_words(parts):
    texts = ["".join(p) for p in parts]
    sets = minhash.shingle_sets(*text_bytes(pa.array(texts)))
    plain = [plain_set(t) for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for a, p in zip(sets, plain):
        for b, q in zip(sets, plain):
            assert len(np.intersect1d(a, b)) == len(p & q)


def test_signature_is_circulant():
    rng = np.random.default_rng(0)
    shingles = rng.integers(0, 2**63, 50).astype(np.uint64)
    scatter, ranks = minhash._permutations(192)
    places = [int(scatter[int(s) % minhash.UNIVERSE]) for s in shingles]
    flat = ranks[:, 0]
    want = [min(int(flat[(p + k) % minhash.UNIVERSE]) for p in places) for k in range(192)]
    assert minhash.signature(shingles, 192).tolist() == want


def near_texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 60, 200, 400]))]
        for _ in range(rng.choice([1, 2, 6, 12, 25])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(copy) // 30) + 1)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    shared = " ".join(rng.choice(vocabulary) for _ in range(120))
    texts += [shared + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))) for _ in range(15)]
    return [*texts, None, "", "  ", "one two", "One  TWO", "one two three"]


@pytest.mark.parametrize("seed,percent", [(0, 85), (1, 80), (2, 85), (3, 80)])
def test_near_duplicates_equal_all_pairs(spark, seed, percent):
    texts = near_texts(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bands string")
    sets = [plain_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = plain_components(range(len(texts)), links)
    got = minhash.near_duplicates(docs, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in want}
    kept = minhash.deduplicate(docs, percent=percent)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in want if want[i] == i)


def test_near_duplicates_odd_rows(spark):
    schema = "doc_id long, text string, node long"
    docs = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 1), (1, "other words in this text here", 2), (2, "other words in this text here", 2), (None, "a b c d e f", 3), (None, None, 3), (5, None, None)], schema)
    got = sorted(((r["doc_id"] or 0), r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, None, True), (0, None, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (5, 5, True)]
    assert minhash.near_duplicates(docs.where("false")).count() == 0
    assert minhash.deduplicate(docs).where("doc_id is null").count() == 2


# language id


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    net = langid.new_network(["a", "b", "c"], units=3, embedding=4)
    windows = rng.integers(0, 6, (5, 7)).astype(np.uint8)
    sizes, labels = np.array([7, 7, 3, 1, 5]), np.array([0, 1, 2, 0, 1])

    def loss():
        p = langid.position_probabilities(net, windows, sizes)
        mask = np.arange(7) < sizes[:, None]
        return -(np.log(p[np.arange(5), :, labels]) * mask).sum() / mask.sum()

    _, g = langid.gradients(net, windows, sizes, labels)
    for w, d in [(net.embedding, g["embedding"]), (net.out, g["out"]), (net.out_bias, g["out_bias"]), *[(getattr(net, k)[i], g[k][i]) for k in ("inner", "bias", "recurrent") for i in (0, 1)]]:
        flat, slope = w.reshape(-1), d.reshape(-1)
        for at in np.argsort(-np.abs(slope))[:3]:
            kept = flat[at]
            flat[at] = kept + 5e-3
            up = loss()
            flat[at] = kept - 5e-3
            down = loss()
            flat[at] = kept
            assert (up - down) / 1e-2 == pytest.approx(slope[at], rel=0.02, abs=2e-4)


def test_probabilities_equal_a_plain_forward_pass():
    """The network by its definition, one byte after the other."""
    rng = np.random.default_rng(2)
    net = langid.new_network(["a", "b", "c"], units=3, embedding=4)
    net.bias = [rng.normal(size=9) for _ in range(2)]
    net.out_bias = rng.normal(size=3)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def states(data, d):
        h, out = np.zeros(3), []
        for byte in data:
            x = net.embedding[byte] @ net.inner[d] + net.bias[d]
            z, r = sigmoid(x[:3] + h @ net.recurrent[d][:, :3]), sigmoid(x[3:6] + h @ net.recurrent[d][:, 3:6])
            h = z * h + (1 - z) * np.tanh(x[6:] + (r * h) @ net.recurrent[d][:, 6:])
            out.append(h)
        return out

    texts = ["Hello", "ünï\0", "", "x" * 64, "some longer text, " * 9]
    got = langid.document_probabilities(net, *text_bytes(pa.array(texts)))
    for text, p in zip(texts, got):
        data, total = text.encode(), np.zeros(3)
        for at in range(0, len(data), langid.WINDOW):
            part = data[at : at + langid.WINDOW]
            for ahead, back in zip(states(part, 0), states(part[::-1], 1)[::-1]):
                e = np.exp(ahead @ net.out[:3] + back @ net.out[3:] + net.out_bias)
                total += e / e.sum()
        assert p == pytest.approx(total / max(len(data), 1), abs=1e-5)


def test_the_sample_is_bounded_and_covers_whole_texts(spark):
    """Rows that repeat very often leave room for the others; windows lie anywhere in a long text."""
    long = "".join(f"{i:07d}x" for i in range(4000))
    rows = [(1, "the same text", "en")] * 3000 + [(i, f"text number {i}", "en") for i in range(2, 600)] + [(i, long + str(i), "fr") for i in range(600, 603)] + [(None, "no id", "de"), (7, None, "en"), (8, "123", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    sample = langid.sample_rows(docs, rows=100)
    got = [tuple(r) for r in sample.select("lang", "text").collect()]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    assert len(set(got)) == len(got)
    assert sum(lang == "en" for lang, _ in got) == 100
    assert sum(lang == "fr" for lang, _ in got) == sum(not fold(i) for i in range(600, 603))
    labels, windows, sizes, which = langid.sample_windows(sample, most=50)
    assert labels == sorted({lang for lang, _ in got}) and max(np.bincount(which)) == 50
    fr = [w.tobytes()[:n] for w, n, k in zip(windows, sizes, which) if labels[k] == "fr"]
    places = [int(re.search(rb"\d{7}", w)[0]) for w in fr]
    assert min(places) < 1000 and max(places) > 3000
    again = langid.sample_windows(langid.sample_rows(docs.repartition(2), rows=100), most=50)
    assert (again[1] == windows).all()


def test_windows_hold_every_byte_once():
    texts = ["", "a" * 64, "b" * 65, "cd", "é" * 200]
    raw, offsets = text_bytes(pa.array(texts))
    windows, sizes, owner = langid.cut_windows(raw, offsets)
    for i, t in enumerate(texts):
        assert b"".join(w[:n].tobytes() for w, n, o in zip(windows, sizes, owner) if o == i) == t.encode()


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(10**7, None, "en"), (10**7 + 1, "123 !?", "en"), (None, "thing of the other and", None), (10**7 + 2, "", None)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(odd).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.identify(both).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(truth) + 4
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (10**7, 10**7 + 1, 10**7 + 2)] == [("und", 0.0)] * 3
    kept = langid.keep_known(both)
    assert kept.columns == both.columns and kept.count() == len(truth) + 1
    assert langid.identify(docs.where("false")).count() == 0
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none.select("lang_pred").distinct().collect()[0][0] == "und"


# PPM


def plain_ppm(train, text, depth, spread):
    """Straight from the definition, byte by byte."""
    counts = [Counter() for _ in range(depth + 1)]
    pad = b"\0" * depth
    for t in train:
        b = pad + t.encode().replace(b"\0", b"\xff") + b"\0"
        for i in range(depth, len(b)):
            for k in range(depth + 1):
                counts[k][(b[i - k : i], b[i])] += 1
    total = sum(counts[0].values())

    def known(context):
        k = len(context)
        return k < 3 or context[-1] != 0 and counts[k - 1][(context[:-1], context[-1])] * spread > total and known(context[:-1]) and known(context[1:])

    out, b = 0.0, pad + text.encode().replace(b"\0", b"\xff") + b"\0"
    for i in range(depth, len(b)):
        p, gone = 1.0, set()
        for k in range(depth, -1, -1):
            context = b[i - k : i]
            if not known(context):
                continue
            n = {s: c for (x, s), c in counts[k].items() if x == context and s not in gone}
            if not n:
                continue
            size = sum(n.values()) + (len(n) if len(gone) + len(n) < 256 else 0)
            if b[i] in n:
                out += math.log10(p * n[b[i]] / size)
                break
            p *= len(n) / size
            gone |= set(n)
        else:
            out += math.log10(p / (256 - len(gone)))
    return out


def test_ppm_and_word_scores(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["the", "The", "of", "and", "été", "rare", "x" * 70, "日本", "a.b"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12))) for _ in range(40)] + [None, "", " \n", "unseen words only", "the of\x0band the"]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    fold = [zlib.crc32(str(i).encode()) % 5 for i in range(len(texts))]
    train = [t or "" for t, f in zip(texts, fold) if f != 1]
    n = Counter(w for t in train for w in words(t))
    n["<end>"] = len(train)
    total, kinds = sum(n.values()), len(n)
    for spread, depth, contexts in ((3, 2, 16_384), (500_000, 5, 60), (500_000, 4, 16_384)):
        got = {r["doc_id"]: r for r in ppm.score(docs, spread=spread, depth=depth, contexts=contexts).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            tokens = [*words(t), "<end>"]
            r = got[i]
            assert r["held_out"] == (fold[i] == 1) and r["n_tokens"] == len(tokens) and r["train_tokens"] == total
            assert r["n_known"] == sum(n[w] > 0 for w in tokens)
            assert r["base_score"] == pytest.approx(sum(math.log10((n[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens))
            assert r["score"] == pytest.approx(plain_ppm(train, t or "", depth, contexts), rel=1e-5)
    assert ppm.score(docs.where("false")).count() == 0


def test_ppm_knows_rare_contexts(spark):
    """Words of three and four bytes a letter, each in two of very many texts, are predicted from all five bytes."""
    rng = random.Random(9)
    common = [" ".join(rng.choice(["the", "of", "and", "to"]) for _ in range(400)) for _ in range(30)]
    rare = ["日本語の文", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "zyxwv qqjkk", "𐌰𐌱𐌲"]
    texts = common + rare * 3 + ["", None, "日本", "nothing alike: ΩΨ", "a\0b\0c", "\0", "a\0b\0c\0", "a\0b", "a\0b\0", "long ΩΨ text " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [t or "" for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    assert len({t for t in train if t in rare}) >= 3
    for depth, options in ((5, {}), (5, {"common": 1}), (5, {"common": 300}), (4, {}), (2, {"common": 40})):
        got = {r["doc_id"]: r["score"] for r in ppm.score(docs, depth=depth, **options).collect()}
        for i, t in enumerate(texts):
            if i >= 25:
                assert got[i] == pytest.approx(plain_ppm(train, t or "", depth, 10**12), rel=1e-9), (depth, options, t)
    cut = {r["doc_id"]: r["score"] for r in ppm.score(docs, contexts=1000).collect()}
    whole = {r["doc_id"]: r["score"] for r in ppm.score(docs).collect()}
    assert sum(whole[i] for i in range(30, 42)) > sum(cut[i] for i in range(30, 42))


def test_ppm_distributions_sum_to_one():
    raw, offsets = text_bytes(pa.array(["abcabd", "xyz" * 5, bytes(range(1, 128)).decode()]))
    raw, offsets = ppm._with_ends(raw, offsets)
    codes, n = np.unique((ppm.pairs(raw, offsets).astype(np.int64) << 8) | raw, return_counts=True)
    growing = ppm.Growing(codes, n, 1000)
    assert growing.extend()
    _, node = ppm.descend(growing.nodes, growing.children, raw, offsets)
    here = node < len(growing.names[-1])
    growing.count(*np.unique((node[here].astype(np.int64) << 8) | raw[here], return_counts=True))
    assert np.allclose((10.0 ** growing.finished().table).sum(1), 1, atol=1e-5)


# permutation index


def exact_nearest(ids, x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        out[q] = [(int(ids[i]), d[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return out


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall(spark, size):
    table = spark.read.parquet(f"{DATA}/{size}/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    queries = [i for i in ids.tolist() if i % 100 == 0]
    want = exact_nearest(ids, x, queries, 10)
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in queries:
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        true = dict(want[q])
        hits += sum(v in true for _, v, _ in found)
        assert all(s == pytest.approx(true[v], rel=1e-12) for _, v, s in found if v in true)
    assert hits / (10 * len(queries)) >= 0.95


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 7)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    same = [1.0, 0.0]
    rows = [(i, same, 1) for i in range(0, 60)] + [(60, [0.0, 0.0], 1), (61, None, 1), (62, [float("nan"), 1.0], 1), (63, [None, 1.0], 1), (64, [float("inf"), 1.0], 1), (None, same, 1), (100, [0.0, 2.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40, 100}
    assert got[0] == [(i, 0.0) for i in range(1, 11)] and got[40] == [(i, 0.0) for i in range(10)]
    assert [v for v, _ in got[100]] == list(range(10))
    few = table.where("vec_id in (1, 2, 20)")
    assert sorted((r["vec_id"], r["rank"]) for r in ann.nearest(few, F.col("vec_id") == 20).collect()) == [(1, 1), (2, 2)]
    assert ann.nearest(table.where("false"), F.col("vec_id") == 1).count() == 0


def test_lengths_apart_and_repeated_ids(spark):
    """Vectors meet only their own length; an id asks once, and never meets its other rows."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4 if i % 2 else 6).tolist()) for i in range(40)] + [(0, [1e9] * 6), (1, None), (3, [0.5] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {}
    for r in ann.nearest(table, F.col("vec_id") < 4, k=50).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in range(4):
        mine = min(v for i, v in rows if i == q and v)
        want = sorted((math.dist(v, mine), i) for i, v in rows if v and len(v) == len(mine) and i != q)
        assert [i for i, _ in got[q]] == [i for _, i in want]
        assert [s for _, s in got[q]] == pytest.approx([s for s, _ in want], rel=1e-12)


def test_a_query_reads_part_of_the_index(spark):
    table = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    n = table.count()
    read = [r[0] for r in ann.nearest(table, F.col("vec_id") % 100 == 0).where("rank = 1").select("n_read").collect()]
    assert np.mean(read) < 0.5 * n


def test_footrule_equals_its_definition():
    rng = np.random.default_rng(1)
    orders = np.array([rng.permutation(20)[:7] for _ in range(30)], np.uint16)
    for mine in orders:
        places = np.full(20, 7, np.int16)
        places[mine] = np.arange(7)
        at = lambda o, p: list(o).index(p) if p in o else 7
        assert ann.footrule(orders, places).tolist() == [sum(abs(at(o, p) - at(mine, p)) for p in range(20)) for o in orders]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\x0bé.", max_size=60), min_size=1, max_size=5), st.integers(1, 40))
def test_pieces_do_not_change_word_hashes(texts, piece):
    raw, offsets = text_bytes(pa.array(texts))
    kept, whole = minhash.PIECE, minhash.word_hashes(raw, offsets)
    minhash.PIECE = piece
    try:
        parts = minhash.word_hashes(raw, offsets)
    finally:
        minhash.PIECE = kept
    assert parts[0].tolist() == whole[0].tolist() and parts[1].tolist() == whole[1].tolist()
    assert whole[1].tolist() == [len(words(t)) for t in texts]


def test_a_large_family_among_others(spark):
    """A family of near copies shares most of its words with texts that aren't near; one bucket holds several components."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(100)]
    family = [" ".join([*common, *(f"f{j}" for j in range(80)), f"x{i}"]) for i in range(150)]
    others = [" ".join([*common, *(f"o{i}_{j}" for j in range(rng.randrange(10, 60)))]) for i in range(60)]
    chain = [" ".join(f"k{j}" for j in range(i, i + 120)) for i in range(0, 24, 4)]
    texts = family + others + chain + ["long " * 300_000, "long " * 300_000 + "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [plain_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = plain_components(range(len(texts)), links)
    for bands in (None, (60, 2)):  # the second gives crowded buckets
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, bands=bands).collect()}
        assert got == want
