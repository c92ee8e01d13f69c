"""MinHash near-deduplication with circulant permutations.

Two permutations make all signature coordinates: the first scatters shingles over a universe of 2^20
places, the second gives places their ranks, and coordinate k is the smallest rank after the second
has been shifted circularly by k. A shingle's ranks under all shifts are neighbours in memory, so a
whole signature is a few reads. Bands of the signature propose candidates; a link counts only after
the exact Jaccard index of the full shingle sets.

1. Documents with equal sets are one class, represented by its smallest id.
2. In each bucket with several classes a star proposes pairs: its most central class against the others,
   so a bucket of n costs n pairs. Confirmed links join classes into components.
3. Pairs inside one component need no check. Classes of buckets that still hold several components are
   compared through their rarest shingles, which finds every similar pair between two components,
   whatever a bucket's size, without trying all pairs of a bucket.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case; a set holds the distinct shingles
of five words, or the whole sequence where there are fewer. Shingles are compared by 64-bit hashes.

Defined cases: a very long text is hashed piece by piece, but its whole set is held at once; null text and text without words have an empty set, which links with nothing; a row
with a null id links with nothing and stays (its component is null); rows that repeat an id are one
node, linked by any of their texts; an empty table gives an empty result; other columns are ignored
by ``near_duplicates`` and pass through ``deduplicate`` untouched.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bit_filter, id_text, int64, ragged, slices, split_by_filter, staged, text_bytes
from .components import components

SHINGLE = 5
UNIVERSE = 1 << 20
#: (bands, rows) by the least similarity in hundredths: a pair at the threshold shares no band with
#: a probability under one in a million.
BANDS = {85: (32, 6), 80: (36, 5)}

_U = np.uint64
_MULTIPLIER = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _permutations(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and a view whose row p holds the ranks of place p under all shifts."""
    rng = np.random.default_rng(20_011)
    scatter = rng.permutation(UNIVERSE).astype(np.uint32)
    rank = rng.permutation(UNIVERSE).astype(np.uint32)
    return scatter, np.lib.stride_tricks.sliding_window_view(np.concatenate([rank, rank[: width - 1]]), width)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, _U(b))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


#: Bytes of text that are hashed at once (more only within one word).
PIECE = 1 << 20


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the number of words of each text."""
    hashes, counts, start = [np.zeros(0, _U)], np.zeros(len(offsets) - 1, np.int64), 0
    while start < len(raw):
        end = start + PIECE
        while end < len(raw):  # up to white space, where no word goes on
            some = raw[end : end + PIECE]
            white = np.flatnonzero((some == 32) | ((some >= 9) & (some <= 13)))
            end += int(white[0]) if len(white) else PIECE
            if len(white):
                break
        end = min(end, len(raw))
        h, n = _word_hashes(raw[start:end], np.clip(offsets, start, end) - start)
        hashes.append(h)
        counts += n
        start = end
    return np.concatenate(hashes), counts


def _word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(raw):
        return np.zeros(0, _U), np.zeros(len(offsets) - 1, np.int64)
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    power, inverse = _powers(1 << max(16, int(len(raw)).bit_length()))
    total = np.concatenate([np.zeros(1, _U), np.cumsum((low.astype(_U) + _U(1)) * power[: len(raw)], dtype=_U)])
    hashes = _mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U) * _MULTIPLIER)
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(raw, offsets)
    factors = _mix(np.arange(1, size + 1, dtype=_U) * _MULTIPLIER) | _U(1)
    sets, at = [], 0
    for n in counts.tolist():
        w = words[at : at + n]
        at += n
        if n >= size:
            h = w[: n - size + 1] * factors[0]
            for j in range(1, size):
                h = h + w[j : n - size + 1 + j] * factors[j]
            sets.append(np.unique(_mix(h)))
        elif n:
            sets.append(_mix((w * factors[:n] + np.full(n, n, _U) * _MULTIPLIER).sum(dtype=_U, keepdims=True)))
        else:
            sets.append(np.zeros(0, _U))
    return sets


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    """The smallest rank under each of ``width`` circular shifts."""
    scatter, ranks = _permutations(width)
    places = scatter[(shingles & _U(UNIVERSE - 1)).astype(np.int64)]
    best = np.full(width, UNIVERSE, np.uint32)
    for start in range(0, len(places), 2048):
        np.minimum(best, ranks[places[start : start + 2048]].min(axis=0), out=best)
    return best


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket key for each band; bands have different keys for equal rows."""
    h = np.arange(1, bands + 1, dtype=_U) * _MULTIPLIER
    for column in sig.reshape(bands, rows).T.astype(_U):
        h = _mix(h ^ column) * _MULTIPLIER
    return h


def _identity(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a = int(_mix(shingles).sum(dtype=_U))
    b = int(np.bitwise_xor.reduce(_mix(shingles * _MULTIPLIER + _U(1)))) if len(shingles) else 0
    return a, b


def sketch(docs: DataFrame, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands): set size, set name and bucket keys of every row."""

    def run(batches):
        for part in slices(batches, 1 << 20):
            sets = shingle_sets(*text_bytes(part.column("text")), size)
            names = np.array([_identity(s) for s in sets], _U).reshape(-1, 2)
            keys = [band_keys(signature(s, bands * rows), bands, rows) if len(s) else np.zeros(0, _U) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), int64(np.array([len(s) for s in sets], np.int64)), int64(names[:, 0]), int64(names[:, 1]), ragged(int64(np.concatenate(keys)), [len(k) for k in keys])], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    picked = id_text(docs, id_col, text_col)
    fields = [T.StructField(c, T.LongType()) for c in ("n_shingles", "set_a", "set_b")] + [T.StructField("bands", T.ArrayType(T.LongType()))]
    return picked.mapInArrow(run, T.StructType([picked.schema["doc_id"], *fields]))


def full_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(node, shingles) of rows (node, text), in full."""

    def run(batches):
        for part in slices(batches, 1 << 20):
            sets = shingle_sets(*text_bytes(part.column("text")), size)
            yield pa.RecordBatch.from_arrays([part.column("node"), ragged(int64(np.concatenate(sets)), [len(s) for s in sets])], ["node", "shingles"])

    return docs.mapInArrow(run, T.StructType([docs.schema["node"], T.StructField("shingles", T.ArrayType(T.LongType()))]))


def _possible(na, nb, percent: int):
    """Whether sets of these sizes can reach the similarity at all."""
    return (100 * F.least(na, nb)) >= (percent * F.greatest(na, nb))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (u, v) whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u")
    both = left.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v")
    shared = F.size(F.array_intersect("su", "sv"))
    return both.where(100 * shared >= percent * (F.size("su") + F.size("sv") - shared)).select("u", "v")


def _pair(a, b):
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = SHINGLE, bands: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Documents are linked where 100 * intersection >= percent * union; component_id is the smallest
    id reachable over links.
    """
    n_bands, n_rows = bands or BANDS[percent]
    thin = staged(sketch(docs, n_bands, n_rows, id_col, text_col, size), "minhash-sketch")
    linkable = thin.where("doc_id IS NOT NULL AND n_shingles > 0")
    # equal sets have equal sizes and bands
    classes = linkable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("members"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = staged(classes, "minhash-classes")
    buckets = classes.select("node", "n", F.explode("bands").alias("bucket"))
    # most buckets hold one class: a filter of fixed size drops them where they are made
    several = buckets.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("bucket", "size")
    several = staged(several, "minhash-buckets")
    maybe, _ = split_by_filter(buckets, "bucket", bit_filter(several, "bucket"))
    members = staged(maybe.join(several, "bucket").select("bucket", "node", "n", "size"), "minhash-members")

    # texts that one id repeated with other texts holds together
    repeated = staged(thin.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id"), "minhash-repeated")
    found = _link(members, docs, id_col, text_col, percent, size, repeated.isEmpty())
    same = linkable.join(repeated, "doc_id").join(classes, ["set_a", "set_b"]).select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    groups = components(found.unionByName(same))
    named = classes.where("members > 1").select("set_a", "set_b", "node").unionByName(classes.where("members = 1").join(groups.select("node"), "node", "left_semi").select("set_a", "set_b", "node"))
    named = named.join(groups, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component"))
    placed = linkable.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    alone = thin.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _link(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int, size: int, unique: bool) -> DataFrame:
    """Confirmed links (u, v) that join every two classes which any chain of similar pairs joins."""
    nodes = members.select("node").distinct()
    texts = id_text(docs, id_col, text_col).withColumnRenamed("doc_id", "node")
    # most documents have no candidate: a filter of fixed size keeps their texts out of the shuffle
    texts, _ = split_by_filter(texts, "node", bit_filter(nodes, "node"))
    texts = texts.join(nodes, "node", "left_semi")
    # an id that several rows share has a set for each of its texts
    sets = full_sets(texts if unique else texts.dropDuplicates(["node", "text"]), size)
    sets = staged(sets.withColumn("set_id", F.monotonically_increasing_id()), "minhash-sets")

    central = members.groupBy("node").agg(F.sum("size").alias("weight"))
    pivots = members.join(central, "node").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("n")).alias("less"), "node", "n")).alias("pivot"))
    stars = members.join(pivots, "bucket").where("node <> pivot.node").where(_possible(F.col("n"), F.col("pivot.n"), percent))
    stars = staged(stars.select(*_pair(F.col("pivot.node"), F.col("node"))).distinct(), "minhash-pairs")
    links = staged(_confirm(stars, sets, percent), "minhash-links")

    # buckets that hold several components
    groups = components(links)
    found = members.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = found.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    left = staged(found.join(mixed, "bucket", "left_semi").groupBy("node").agg(F.first("component").alias("component")), "minhash-open")
    pairs = staged(_by_prefix(left, sets, percent).join(stars, ["u", "v"], "left_anti"), "minhash-pairs")
    return links.unionByName(_confirm(pairs, sets, percent))


def _by_prefix(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of nodes of different components, among them all that are similar enough.

    Two sets that similar have a common shingle among the rarest of each: the smaller one's first
    n - ceil(2t / (1 + t) * n) + 1 and the larger one's first n - ceil(t * n) + 1, in any one order of all
    shingles, and from the first common one on there are enough left. In order of frequency, what a
    group of documents shares stands last, so large groups of merely related texts propose few pairs.
    """
    rows = sets.join(left, "node").select("node", "set_id", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy("set_id").orderBy("often", "shingle"))
    n = F.col("n")
    short = n - F.floor((2 * percent * n + 99 + percent) / (100 + percent)) + 1
    long = n - F.floor((percent * n + 99) / 100) + 1
    rows = rows.join(often, "shingle").withColumn("place", place).withColumn("short", short).withColumn("long", long)
    rows = rows.where((F.col("place") <= F.col("long")) & (F.col("often") > 1)).select("shingle", "node", "component", "n", "place", "short")
    rows = staged(rows, "minhash-prefix")
    # a large component that shares a shingle must not meet itself: one side of a pair is outside the largest one
    largest = rows.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("shingle").agg(F.max(F.struct("c", "component")).alias("most"), F.count(F.lit(1)).alias("parts"))
    rows = rows.join(largest.where("parts > 1").select("shingle", F.col("most.component").alias("main")), "shingle")
    rows = staged(rows.withColumn("outside", F.col("component") != F.col("main")).drop("main"), "minhash-prefix")
    a = rows.where(F.col("place") <= F.col("short")).select("shingle", *[F.col(c).alias(f"a_{c}") for c in ("node", "component", "n", "place", "outside")])
    b = rows.select("shingle", *[F.col(c).alias(f"b_{c}") for c in ("node", "component", "n", "place", "outside")])
    smaller = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_node") != F.col("b_node")))
    rest = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")) + 1
    enough = (100 + percent) * rest >= percent * (F.col("a_n") + F.col("b_n"))
    fit = smaller & (F.col("a_component") != F.col("b_component")) & _possible(F.col("a_n"), F.col("b_n"), percent) & enough
    met = a.where("a_outside").join(b, "shingle").where(fit).unionByName(a.where("NOT a_outside").join(b.where("b_outside"), "shingle").where(fit))
    return met.select(*_pair(F.col("a_node"), F.col("b_node"))).distinct()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component, the one with the smallest id.

    Rows are linked, not ids: where ids repeat, every row is numbered in the order of ids, and of each component
    the row with the smallest number stays. Rows with a null id all stay.
    """
    odd = docs.select(F.col(id_col).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("id IS NOT NULL AND c > 1")
    if odd.isEmpty():
        return _without_near(docs, id_col, text_col, percent)
    rows = docs.orderBy(id_col).withColumn("_quillon_row", F.when(F.col(id_col).isNotNull(), F.monotonically_increasing_id()))
    return _without_near(staged(rows, "minhash-rows"), "_quillon_row", text_col, percent).select(*docs.columns)


def _without_near(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """``docs`` by ids that don't repeat."""
    found = near_duplicates(docs, id_col, text_col, percent)
    gone = staged(found.where(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct(), "minhash-gone")
    maybe, stay = split_by_filter(docs, id_col, bit_filter(gone, id_col))
    return maybe.join(gone, id_col, "left_anti").select(*docs.columns).unionByName(stay)
