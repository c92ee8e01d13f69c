"""The pipeline: what each stage keeps, on planted rows and on the driver's small table."""

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import minhash, packing, secrets
from quillon.llm._common import bit_filter, split_by_filter


@pytest.fixture(scope="module")
def rows(spark):
    base = [f"word{i} the and of" for i in range(60)]
    near = [*base[:-1], "changed ending of text"]
    texts = {1: " ".join(base), 2: "  ".join(base) + "\n", 3: " ".join(near), 4: None, 5: "12345 !", 6: "clean and short text", 7: "here token = abcdef123456 ends the line", 8: ""}
    data = [(i, t, "en" if i % 2 else "fr", "s", len(t or ""), f"extra{i}", 1) for i, t in texts.items()]
    data += [(i, f"le texte {i} est un autre et la suite {i * 7} ne {i * 13}", "fr", "s", 10, "x", 1) for i in range(100, 130)]
    return spark.createDataFrame([*data, data[5]], "doc_id long, text string, lang string, source string, n_chars long, place string, digest int")


def test_stages(spark, rows):
    docs = rows
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), stage(spark, docs, "").schema)
        out[name] = docs
        if name != "packing":
            assert docs.columns == rows.columns
    ids = lambda name: sorted(r["doc_id"] for r in out[name].collect())
    rest = list(range(100, 130))
    assert ids("language id") == [1, 2, 3, 6, 6, 7, *rest]
    assert ids("exact dedup") == [2, 3, 6, 7, *rest]
    assert ids("minhash near-dedup") == [2, 6, 7, *rest]
    red = {r["doc_id"]: r for r in out["secret scan"].collect()}
    assert red[7]["text"] == "here <secret> ends the line" and red[7]["n_chars"] == len(red[7]["text"])
    assert red[6]["text"] == "clean and short text" and red[6]["place"] == "extra6"
    tok = packing.word_tokenizer()
    pieces = {}
    for r in out["packing"].collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert sorted(pieces) == sorted(red)
    for i, mine in pieces.items():
        ids_ = np.frombuffer(b"".join(bytes(r["ids"]) for r in sorted(mine, key=lambda r: r["start"])), "<u4").tolist()
        assert ids_ == [*tok.model.encode(red[i]["text"], add_special_tokens=False).ids, 2]


def test_empty_and_whole(spark, rows):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows.where("false"), "").count() == 0
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 100
    full = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sums = {}
    for r in got.select("doc_id", "length", "doc_tokens").collect():
        sums.setdefault(r["doc_id"], [0, r["doc_tokens"]])[0] += r["length"]
    assert set(sums) <= set(full) and all(a == b for a, b in sums.values())
    assert not any(secrets.find_text(secrets.blank(full[i])) for i in sums)


def test_language_stage_rejects_by_the_network(spark):
    """Foreign and noise texts go; labelled texts, and texts in two languages, stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    clean = {r["lang"]: r["text"] for r in docs.where("length(text) > 1500 AND NOT text LIKE '%@%'").orderBy("doc_id").collect()}
    two = clean["en"][:600] + " " + clean["de"][:600]
    rng = np.random.default_rng(5)
    gone = {
        -1: "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. " * 5,
        -2: "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。" * 10,
        -3: rng.bytes(2000).hex(),
        -4: base64.b64encode(rng.bytes(2000)).decode(),
    }
    stay = {-10: two, -11: "A.", **{-20 - i: t for i, t in enumerate(clean.values())}}
    planted = spark.createDataFrame([(i, t, None) for i, t in (gone | stay).items()], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs.unionByName(planted), "").select("doc_id").collect()}
    assert not kept & set(gone) and kept >= set(stay)
    labelled = docs.where("text rlike '\\\\p{L}'").count()
    assert len(kept & {r["doc_id"] for r in docs.collect()}) >= 0.998 * labelled


def test_language_stage_without_labels(spark, rows):
    """Nothing is learned, so every text with a letter stays."""
    bare = rows.withColumn("lang", F.lit(None).cast("string"))
    kept = sorted(r["doc_id"] for r in corpus_pipeline.known_language(spark, bare, "").collect())
    assert kept == [1, 2, 3, 6, 6, 7, *range(100, 130)]


def test_near_stage_links_rows(spark):
    """Of repeated ids, only the near copies go, and not all texts of the id."""
    text = lambda name, n=0: " ".join(f"{name}{i}" for i in range(60)) + f" end{n}"
    data = [(1, text("a")), (2, text("a", 1)), (2, text("b")), (3, text("c")), (3, text("c", 1)), (None, text("d")), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, place string")
    kept = corpus_pipeline.near(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or 0, (r["text"] or "")[:1]) for r in kept.collect())
    assert got == [(0, "d"), (1, "a"), (2, "b"), (3, "c"), (4, ""), (4, "")]


def test_bit_filter(spark):
    keys = spark.range(0, 3000, 3).toDF("k")
    rows = spark.range(3000).toDF("k").unionByName(spark.createDataFrame([(None,)], "k long"))
    maybe, no = split_by_filter(rows, "k", bit_filter(keys, "k"))
    assert maybe.count() + no.count() == 3001
    assert maybe.join(keys, "k", "left_semi").count() == 1000
    assert maybe.count() < 1100 and no.where("k is null").count() == 1
    assert minhash.BANDS[85][0] > 1
