"""Language identification with a bidirectional gated recurrent network over bytes.

The network labels every byte of a text: a forward and a backward GRU read windows of the text's
bytes, and a softmax over both states gives each position's language. Windows follow one another without
overlap and start with empty states, so a position is judged within its ``WINDOW`` bytes. A document's
probabilities are the mean over all its positions, each of them in exactly one window, so whole texts count.

Training is backpropagation through time in numpy on the driver, from a bounded sample: of each language
``SAMPLE`` labelled rows, those with the smallest hash of id and text among different ones, and of the windows
of their whole texts ``TRAINED``, those with the smallest hash. What finds the sample is read in parallel and
reduced before it moves. Inference is numpy over thousands of windows at a time.

For ``keep_known`` the network has one more class, no language: it also learns windows of random letters of
many scripts, of encodings, and of sampled texts with their letters in random order. A text goes where its
positions in the languages, all of them together, have a mean probability under ``LEAST``, or under what nearly
all sampled rows reach if that is less; each text counts as if it began with ``PRIOR`` positions in a language,
so a text too short to tell stays. So does a text in two languages. Where a text falls short, its words without
digits and addresses are judged once more by themselves.

Defined cases: null text, and text without a letter, is ``und`` with score 0; with no labelled row
everything is ``und``, but ``keep_known`` then keeps every text that has a letter; of equal probabilities the
language first in order of names counts; a very long text is read whole, some windows at a time; a null lang is
not learned from; a null id counts as the empty text when rows are split into folds; repeated rows are labelled
each and learned from once; an empty table gives an empty table; other columns are ignored by ``predict`` and
pass through ``keep_known`` untouched.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import crc_mod, id_text, slices, small_batches, staged, text_bytes

#: Labelled rows of each language that the network is fitted on, and windows of their whole texts that it learns.
SAMPLE = 400
TRAINED = 1600
#: Bytes of a window, units of a direction, numbers of an embedded byte.
WINDOW = 64
UNITS = 8
EMBEDDING = 8
#: Windows that run side by side.
_BATCH = 4096
#: The least share of a text in the learned languages, and the share of sampled rows that may fall short of it.
LEAST = 0.5
STRAY = 0.001
#: Positions in a language that every text is given beside its own.
PRIOR = 64
#: What says nothing about a language, though it has letters.
_CODES = r"\S*[0-9@]\S*"


@dataclass
class Network:
    """The weights. Gates are stacked as update, reset, candidate."""

    labels: list[str]
    embedding: np.ndarray  # 256 x E
    inner: list[np.ndarray]  # by direction: E x 3H
    bias: list[np.ndarray]  # by direction: 3H
    recurrent: list[np.ndarray]  # by direction: H x 3H
    out: np.ndarray  # 2H x K
    out_bias: np.ndarray  # K
    least: float | None = None  # with one: the last label is no language, and a text's share in the others is this or more

    def tables(self) -> list[np.ndarray]:
        """By direction: what each byte adds to the gates."""
        return [(self.embedding @ w + b).astype(np.float32) for w, b in zip(self.inner, self.bias, strict=True)]


def new_network(labels: list[str], units: int = UNITS, embedding: int = EMBEDDING, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    return Network(labels, rng.normal(0, 1, (256, embedding)), [draw(embedding, 3 * units) for _ in range(2)], [np.zeros(3 * units) for _ in range(2)], [draw(units, 3 * units) for _ in range(2)], draw(2 * units, len(labels)), np.zeros(len(labels)))


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(net: Network, steps: np.ndarray, direction: int, inside: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
    """States of a direction after each step, in the order of ``steps`` (T x B bytes); empty where not ``inside``."""
    table, u = net.tables()[direction], net.recurrent[direction].astype(np.float32)
    h_size = u.shape[0]
    h = np.zeros((steps.shape[1], h_size), np.float32)
    states = np.empty((*steps.shape, h_size), np.float32)
    for t in range(len(steps)):
        x = table[steps[t]]
        zr = _sigmoid(x[:, : 2 * h_size] + h @ u[:, : 2 * h_size])
        z, r = zr[:, :h_size], zr[:, h_size:]
        n = np.tanh(x[:, 2 * h_size :] + (r * h) @ u[:, 2 * h_size :])
        if keep is not None:
            keep.append((h, z, r, n))
        h = n + z * (h - n)
        if inside is not None:
            h *= inside[t][:, None]
        states[t] = h
    return states


def _inside(sizes: np.ndarray, width: int) -> np.ndarray:
    """T x B: whether a place of a window holds a byte of the text, backwards."""
    return np.arange(width)[::-1, None] < sizes[None]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def position_probabilities(net: Network, windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """B x T x K: the languages of every byte of B windows (B x T, zeros after ``sizes``)."""
    steps = windows.T
    ahead = _forward(net, steps, 0)
    back = _forward(net, steps[::-1], 1, _inside(sizes, len(steps)))[::-1]
    h = ahead.shape[2]
    scores = ahead @ net.out[:h].astype(np.float32) + back @ net.out[h:].astype(np.float32) + net.out_bias.astype(np.float32)
    return _softmax(scores).transpose(1, 0, 2)


def gradients(net: Network, windows: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
    """Mean loss over all positions and its gradients, by backpropagation through time."""
    steps = windows.T
    t_max, batch = steps.shape
    mask = (np.arange(t_max)[:, None] < sizes[None]).astype(float)
    kept: list[list] = [[], []]
    inside = _inside(sizes, t_max)
    states = [_forward(net, steps, 0, None, kept[0]), _forward(net, steps[::-1], 1, inside, kept[1])[::-1]]
    both = np.concatenate(states, axis=2)
    p = _softmax(both @ net.out + net.out_bias)
    rows = np.arange(batch)
    count = mask.sum()
    loss = -(np.log(p[:, rows, labels] + 1e-12) * mask).sum() / count
    d = p.copy()
    d[:, rows, labels] -= 1
    d *= (mask / count)[:, :, None]
    g = {"out": np.einsum("tbh,tbk->hk", both, d), "out_bias": d.sum((0, 1)), "embedding": np.zeros_like(net.embedding), "inner": [], "bias": [], "recurrent": []}
    d_states = d @ net.out.T
    for direction in range(2):
        h = net.recurrent[direction].shape[0]
        u = net.recurrent[direction]
        order = steps if direction == 0 else steps[::-1]
        flow = d_states[:, :, direction * h : (direction + 1) * h]
        flow = flow if direction == 0 else flow[::-1]
        d_table, d_u, d_h = np.zeros((256, 3 * h)), np.zeros_like(u), np.zeros((batch, h))
        for t in range(t_max - 1, -1, -1):
            before, z, r, n = kept[direction][t]
            d_h = d_h + flow[t] if direction == 0 else (d_h + flow[t]) * inside[t][:, None]
            d_n = d_h * (1 - z) * (1 - n * n)
            d_z = d_h * (before - n) * z * (1 - z)
            d_rh = d_n @ u[:, 2 * h :].T
            d_r = d_rh * before * r * (1 - r)
            gates = np.concatenate([d_z, d_r, d_n], axis=1)
            np.add.at(d_table, order[t], gates)
            d_u[:, : 2 * h] += before.T @ gates[:, : 2 * h]
            d_u[:, 2 * h :] += (r * before).T @ d_n
            d_h = d_h * z + d_rh * r + gates[:, : 2 * h] @ u[:, : 2 * h].T
        g["inner"].append(net.embedding.T @ d_table)
        g["bias"].append(d_table.sum(0))
        g["recurrent"].append(d_u)
        g["embedding"] += d_table @ net.inner[direction].T
    return float(loss), g


def fit(net: Network, windows: np.ndarray, sizes: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam over shuffled batches; the network's weights change in place."""
    rng = np.random.default_rng(seed)
    flat = lambda n, g: [(n.embedding, g["embedding"]), (n.out, g["out"]), (n.out_bias, g["out_bias"]), *((getattr(n, k)[i], g[k][i]) for k in ("inner", "bias", "recurrent") for i in range(2))]
    moments: dict[int, list] = {}
    step, total = 0, max(1, epochs * -(-len(windows) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), batch):
            some = order[start : start + batch]
            _, g = gradients(net, windows[some], sizes[some], labels[some])
            norm = np.sqrt(sum((x**2).sum() for _, x in flat(net, g)))
            step += 1
            pace = rate * (1 - (step - 1) / total)
            for i, (w, x) in enumerate(flat(net, g)):
                x = x / max(1.0, norm)
                m = moments.setdefault(i, [np.zeros_like(w), np.zeros_like(w)])
                m[0] += 0.1 * (x - m[0])
                m[1] += 0.001 * (x * x - m[1])
                w -= pace * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return net


def window_places(offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the windows of all texts begin, their sizes, the text of each, and its number in the text."""
    lengths = np.diff(offsets)
    counts = -(-lengths // width)
    owner = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[:-1][owner] + nth * width
    return begin, np.minimum(width, offsets[1:][owner] - begin), owner, nth


def take_windows(raw: np.ndarray, begin: np.ndarray, sizes: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """n x width bytes, zeros after a window's size."""
    if not len(raw):
        return np.zeros((0, width), np.uint8)
    at = begin[:, None] + np.arange(width)
    windows = raw.take(np.minimum(at, len(raw) - 1))
    windows[np.arange(width) >= sizes[:, None]] = 0
    return windows


def cut_windows(raw: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of all texts in windows: (n x width bytes, sizes, the text of each window)."""
    begin, sizes, owner, _ = window_places(offsets, width)
    return take_windows(raw, begin, sizes, width), sizes, owner


def sample_rows(docs: DataFrame, rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, h, text): at most ``rows`` labelled rows of each language outside the held-out fold.

    Only rows whose hash is under a bound that follows from the number of different rows of their language are
    grouped, a few times ``rows`` of them, whatever the size of the table and however often a row repeats.
    """
    learn = docs.select(docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"), docs[id_col].alias("doc_id")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (crc_mod(F.col("doc_id"), 5) != 0))
    learn = learn.select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    different = learn.groupBy("lang").agg(F.approx_count_distinct("h", 0.05).alias("n")).collect()
    span = float(2**64)
    # the count may be off by several times five percent, and the number of hashes under a bound varies too
    bounds = [(r["lang"], min(2**63 - 1, int(4 * rows / max(r["n"], 1) * span) - 2**63)) for r in different]
    under = docs.sparkSession.createDataFrame(bounds, "lang string, bound long")
    some = learn.join(F.broadcast(under), "lang").where("h <= bound").groupBy("lang", "h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return staged(some.withColumn("place", place).where(F.col("place") <= rows).select("lang", "h", "text"), "langid-sample")


def _spread(h: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """A hash of 62 bits for each window of a row."""
    x = h.astype(np.int64).view(np.uint64) + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(2)).view(np.int64)


def sample_windows(rows: DataFrame, most: int = TRAINED) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(languages, n x WINDOW bytes, sizes, language numbers): of each language at most ``most`` windows of the rows' whole texts."""
    total = {r["lang"]: int(r["n"]) for r in rows.groupBy("lang").agg(F.sum(F.ceil(F.octet_length("text") / WINDOW)).alias("n")).collect()}
    bound = {lang: int(2**62 * min(1.0, 2 * most / n)) for lang, n in total.items()}

    def run(batches):
        for part in slices(batches):
            raw, offsets = text_bytes(part.column("text"))
            begin, sizes, owner, nth = window_places(offsets)
            limit = np.array([bound[x] for x in part.column("lang").to_pylist()], np.int64)
            order = _spread(part.column("h").to_numpy(zero_copy_only=False)[owner], nth)
            few = np.flatnonzero(order <= limit[owner])
            windows = take_windows(raw, begin[few], sizes[few])
            yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(owner[few])), pa.array(order[few]), pa.array([w.tobytes() for w in windows], pa.binary()), pa.array(sizes[few].astype(np.int32))], ["lang", "h", "bytes", "size"])

    found = rows.mapInArrow(run, "lang string, h long, bytes binary, size int").toPandas().sort_values(["lang", "h", "bytes"], kind="stable")
    found = found.groupby("lang", sort=True).head(most)
    labels = sorted(total)
    windows = np.frombuffer(b"".join(found["bytes"]), np.uint8).reshape(-1, WINDOW)
    return labels, windows, found["size"].to_numpy(np.int64), found["lang"].map({x: i for i, x in enumerate(labels)}).to_numpy(np.int64)


def train(docs: DataFrame, rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", none: bool = False, **options) -> Network | None:
    """The network fitted on a bounded sample of ``docs``; None where nothing is labelled. With ``none`` the last class is no language."""
    small_batches(docs.sparkSession)
    sample = sample_rows(docs, rows, id_col, text_col, lang_col)
    labels, windows, sizes, which = sample_windows(sample)
    if not labels:
        return None
    # every language counts alike
    rng = np.random.default_rng(3)
    most = np.bincount(which).max()
    picked = np.concatenate([rng.permutation(np.resize(rng.permutation(np.flatnonzero(which == k)), most)) for k in range(len(labels))])
    if not none:
        return fit(new_network(labels), windows[picked], sizes[picked], which[picked], **options)
    texts = [w[:n].tobytes().decode(errors="ignore") for w, n in zip(windows, sizes, strict=True)]
    odd, odd_sizes, _ = cut_windows(*text_bytes(pa.array(noise(texts, max(1, most // 4)), pa.string())))
    some = rng.permutation(np.resize(rng.permutation(len(odd)), most))
    every = [np.concatenate(x) for x in ((windows[picked], odd[some]), (sizes[picked], odd_sizes[some]), (which[picked], np.full(most, len(labels))))]
    net = fit(new_network([*labels, "und"]), *every, **options)

    def shares(batches):
        for part in slices(batches):
            raw, offsets = text_bytes(part.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(_share(document_probabilities(net, raw, offsets), offsets))], ["share"])

    share = sample.select("text").mapInArrow(shares, "share double").toPandas()["share"]
    net.least = min(LEAST, float(np.quantile(share, STRAY)))
    return net


def noise(texts: list[str], count: int, seed: int = 11) -> list[str]:
    """Texts in no language: random letters of a script, random letters of an encoding, letters of some texts in random order."""
    rng = np.random.default_rng(seed)
    span, low = 8 * WINDOW, string.ascii_lowercase
    encodings = ["0123456789abcdef", low.upper() + low + string.digits + "+/", low, low.upper()]
    out = []
    for i in range(count):
        if i % 3 == 0:
            start = rng.integers(0x370, 0xD700 if rng.random() < 0.5 else 0x1200)
            code = start + rng.integers(0, rng.choice([48, 96, 512]), span)
            t = [chr(c) for c in code[code < 0xD800]]
        elif i % 3 == 1:
            t = list(rng.choice(list(encodings[rng.integers(len(encodings))]), span))
        else:
            t = list(rng.permutation(list("".join(texts[j] for j in rng.integers(len(texts), size=8)))))
        if i % 3 < 2 and rng.random() < 0.5:
            gaps = rng.integers(rng.integers(3, 9), size=len(t))
            t = [c if g else " " for c, g in zip(t, gaps, strict=True)]
        out.append("".join(t))
    return out


def _share(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The share of each text in the languages, ``PRIOR`` more positions included."""
    n = np.diff(offsets)
    return (p[:, :-1].sum(1) * n + PRIOR) / (n + PRIOR)


def foreign(net: Network, texts: pa.Array, p: np.ndarray) -> np.ndarray:
    """Whether texts with these probabilities are in none of the network's languages."""
    out = _share(p, text_bytes(texts)[1]) < net.least
    if out.any():
        words = pc.replace_substring_regex(texts.filter(pa.array(out)), _CODES, " ")
        raw, offsets = text_bytes(words)
        again = _share(document_probabilities(net, raw, offsets), offsets) < net.least
        has = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False)
        out[out] = again | ~has
    return out


def document_probabilities(net: Network, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n x K: the mean over all positions of each text; zeros for a text without bytes."""
    begin, sizes, owner, _ = window_places(offsets)
    total = np.zeros((len(offsets) - 1, len(net.labels)))
    for start in range(0, len(begin), _BATCH):
        part = slice(start, start + _BATCH)
        windows = take_windows(raw, begin[part], sizes[part])
        p = position_probabilities(net, windows, sizes[part])
        p *= (np.arange(windows.shape[1]) < sizes[part][:, None])[:, :, None]
        np.add.at(total, owner[part], p.sum(1))
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    picked = id_text(docs, id_col, text_col)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def run(batches):
        for part in slices(batches):
            text = part.column("text")
            known = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if net is None:
                known = np.zeros(part.num_rows, bool)
            names, scores = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
            if known.any():
                p = document_probabilities(net, *text_bytes(text.filter(pa.array(known))))
                names[known] = np.array(net.labels, object)[p.argmax(1)]
                scores[known] = np.minimum(p.max(1), 1.0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names.tolist(), pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return picked.mapInArrow(run, T.StructType([picked.schema["doc_id"], *fields]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): trains on the rows that are not held out, labels all."""
    net = train(docs, rows, id_col, text_col, lang_col)
    return predict(docs, net, id_col, text_col).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.0, rows: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` in one or more of the learned languages, with a score of ``least`` or more.

    Where nothing is learned, the rows whose text has a letter.
    """
    small_batches(docs.sparkSession)
    net = train(docs, rows, id_col, text_col, lang_col, none=True)
    if net is None:
        return docs.where(docs[text_col].rlike(r"\p{L}"))
    keep = language_of(net)(docs[text_col])
    return docs.where((keep["lang_pred"] != "und") & (keep["score"] >= least))


def language_of(net: Network | None):
    """A column function: text -> struct<lang_pred, score>; ``und`` for what is foreign to the network."""

    @F.pandas_udf("lang_pred string, score double")
    def label(texts):
        import pandas as pd

        names, scores = [], []
        batch = pa.RecordBatch.from_arrays([pa.array(texts.tolist(), pa.string())], ["text"])
        for part in slices(iter([batch])):
            text = part.column("text")
            known = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False) & (net is not None)
            n, s = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
            if known.any():
                some = text.filter(pa.array(known))
                p = document_probabilities(net, *text_bytes(some))
                if net.least is not None:
                    known[known] = stay = ~foreign(net, some, p)
                    p = p[stay, :-1]
                n[known], s[known] = np.array(net.labels, object)[p.argmax(1)], np.minimum(p.max(1), 1.0)
            names += n.tolist()
            scores += s.tolist()
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return label
