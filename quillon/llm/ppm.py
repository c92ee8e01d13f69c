"""Language-model scoring by prediction by partial matching over byte contexts.

The model is a byte-context trie with counts from all training texts. A byte is coded in the longest
known context that has seen anything; a byte new to that context costs an escape (method C: distinct
symbols over symbols plus distinct symbols) and is coded in the next shorter context, from which the
symbols of the longer one are excluded; below the empty context all bytes left are alike. Each text ends
with an end symbol (byte 0).

Every context of up to ``DEPTH`` bytes that occurs in a training text is known. All sequences of a context
and its byte are counted in one distributed table, which grows with the corpus. A sequence's probability
needs only the counts of its own context and of the ends of that context, so the table is divided by the
last three bytes of the contexts, and each part works out its own probabilities; the counts after two bytes,
one and none are broadcast (at most 2^24). Sequences above one in ``COMMON`` of all symbols (fewer than
``COMMON``) are looked up in a broadcast table, all others by a join on the sequence.

With ``contexts`` given, the model is bounded instead: all contexts of two bytes, and of three to ``depth``
bytes only those that precede more than one in ``contexts`` of all symbols; one pass over the training texts
for each length, and everything is broadcast.

Beside it stands a smoothed word model. Its vocabulary grows with the corpus, so only words with more
than one in ``SPREAD`` of all tokens (fewer than ``SPREAD`` words, each of at most ``WORD_BYTES``
bytes) are broadcast; the others are looked up by a join on the word.

Defined cases: null text is the empty text (only the end token and end symbol); U+0000 is a symbol of its own,
no end; a very long text is scored whole; a null id counts as
the empty text when rows are split into folds; rows that repeat an id are scored each; an empty table
gives an empty table, and without training rows every word has count 0; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import crc_mod, int64, ragged, slices, small_batches, staged, text_bytes

#: Words above one in this many tokens are broadcast.
SPREAD = 500_000
WORD_BYTES = 64
#: The longest contexts; sequences of a context and a byte above one in this many of all symbols are broadcast.
DEPTH = 5
COMMON = 1 << 22
_END = np.uint8(0)


def held_out(id_col: Column) -> Column:
    return crc_mod(id_col, 5) == 1


def _with_ends(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text followed by the end symbol, end to end, and the new offsets; U+0000 in a text is byte 255."""
    if len(raw) and not raw.all():
        raw = np.where(raw == _END, np.uint8(255), raw)  # UTF-8 has no such byte
    return np.insert(raw, offsets[1:], _END), offsets + np.arange(len(offsets))


def backward(raw: np.ndarray, offsets: np.ndarray, distance: int) -> np.ndarray:
    """For texts with ends: the byte ``distance`` places before each byte; zero before a text's first."""
    out = np.zeros(len(raw), np.int32)
    out[distance:] = raw[: len(raw) - distance] if distance < len(raw) else 0
    for k in range(distance):
        at = offsets[:-1] + k
        out[at[at < offsets[1:]]] = 0
    return out


def pairs(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The two bytes before each byte as one number."""
    return (backward(raw, offsets, 2) << 8) | backward(raw, offsets, 1)


@dataclass
class Trie:
    """Contexts as nodes by length, and for each what codes every byte.

    ``nodes`` leads from two bytes to their context. ``children[k]`` leads from a context of k + 2 bytes and
    the byte before it to the context of k + 3 bytes. At each length the number after the last context stands
    for an unknown one, which leads to unknown ones. ``table`` holds log10 probabilities, with the code lengths
    of all escapes in them: rows for one byte, then for the contexts of each length from ``bases`` on.
    """

    nodes: np.ndarray
    children: list[np.ndarray]
    bases: list[int]
    table: np.ndarray


def descend(nodes: np.ndarray, children: list[np.ndarray], raw: np.ndarray, offsets: np.ndarray):
    """For each length from 2: the context of that length before each byte."""
    node = nodes.take(pairs(raw, offsets))
    yield node
    for k, child in enumerate(children):
        node = child.take((node << 8) | backward(raw, offsets, k + 3))
        yield node


class Growing:
    """The trie while its levels are counted, one after the other, on the driver.

    All contexts of two bytes are kept. Of longer ones those are kept that precede more than one in
    ``spread`` of all symbols: fewer than ``spread`` of each length, whatever the corpus.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, spread: int):
        self.spread, self.total = spread, float(counts.sum())
        seen = np.unique(codes >> 8)
        self.nodes = np.full(65_536, len(seen), np.int32)
        self.nodes[seen] = np.arange(len(seen), dtype=np.int32)
        self.names = [[bytes(divmod(c, 256)) for c in seen.tolist()]]
        self.suffix = [np.array([c & 255 for c in seen.tolist()], np.int64)]
        self.counts = [np.zeros((len(seen), 256))]
        np.add.at(self.counts[0], (self.nodes[codes >> 8], codes & 255), counts)
        self.one = np.zeros((256, 256))
        np.add.at(self.one, ((codes >> 8) & 255, codes & 255), counts)
        self.children: list[np.ndarray] = []

    def extend(self) -> bool:
        """Finds the contexts of the next length; their counts are still to come."""
        names, counts = self.names[-1], self.counts[-1]
        known = {name: i for i, name in enumerate(names)}
        child = np.full((len(names) + 1, 256), -1, np.int32)
        found, suffix = [], []
        for u, byte in zip(*np.nonzero(counts * self.spread > self.total), strict=True):
            name = names[u] + bytes([byte])
            v = known.get(name[1:])
            if byte != _END and v is not None:  # nothing follows an end
                child[v, name[0]] = len(found)
                found.append(name)
                suffix.append(v)
        if not found:
            return False
        self.names.append(found)
        self.suffix.append(np.array(suffix, np.int64))
        child[child < 0] = len(found)
        self.children.append(child.ravel())
        return True

    def count(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """The counts of (node << 8 | byte) for the newest contexts."""
        n = np.zeros((len(self.names[-1]), 256))
        np.add.at(n, (codes >> 8, codes & 255), counts)
        self.counts.append(n)

    def finished(self) -> Trie:
        none = self.one.sum(0)
        first = np.log10(_mix_down([self.one, np.broadcast_to(none, (256, 256))])).astype(np.float32)
        rows, bases = [first], []
        for level in range(len(self.counts)):
            bases.append(sum(map(len, rows)))
            for start in range(0, len(self.names[level]), 1024):
                at = np.arange(start, min(start + 1024, len(self.names[level])))
                chain = []
                for below in range(level, -1, -1):
                    chain.append(self.counts[below][at])
                    at = self.suffix[below][at]
                rows.append(np.log10(_mix_down([*chain, self.one[at], np.broadcast_to(none, (len(at), 256))])).astype(np.float32))
        return Trie(self.nodes, self.children, bases, np.concatenate(rows))


def _mix_down(levels: list[np.ndarray]) -> np.ndarray:
    """Probabilities (m x 256) in m contexts, falling from each level of counts to the next with exclusion."""
    p = np.zeros(levels[0].shape)
    excluded = np.zeros(p.shape, bool)
    carried = np.ones((len(p), 1))
    for level in levels:
        n = np.where(excluded, 0.0, level)
        total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
        here = kinds > 0
        left = 256 - excluded.sum(1, keepdims=True) - kinds  # symbols that an escape can lead to
        base = np.where(left > 0, total + kinds, total)
        p += np.where((n > 0) & here, carried * n / np.maximum(base, 1), 0)
        carried = np.where(here, np.where(left > 0, carried * kinds / np.maximum(base, 1), 0), carried)
        excluded |= n > 0
    left = (~excluded).sum(1, keepdims=True)
    return np.where(excluded, p, carried / np.maximum(left, 1))


#: Bytes that are scored at once: what belongs to them stays in the processor's cache.
_PART = 1 << 18


def score_bytes(trie: Trie, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 probability of each whole text, its end included."""
    out, start = [np.zeros(0)], 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + _PART, side="right")) - 1)
        out.append(_score_part(trie, *_with_ends(raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])))
        start = end
    return np.concatenate(out)


def _score_part(trie: Trie, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    row = None
    sizes = [*(b - a for a, b in zip(trie.bases, trie.bases[1:], strict=False)), len(trie.table) - trie.bases[-1]]
    for base, size, node in zip(trie.bases, sizes, descend(trie.nodes, trie.children, raw, offsets), strict=True):
        shorter = backward(raw, offsets, 1) if row is None else row
        row = np.where(node < size, node + np.int32(base), shorter)
    each = trie.table.ravel().take((row << 8) | raw)
    return np.add.reduceat(each.astype(float), offsets[:-1])


def _words(text: pa.Array):
    """The tokens of each text: a list array of lower-cased words."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    flat = split.flatten()
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # white space at an end splits off an empty word
    if not full.all():
        flat, owner = flat.filter(pa.array(full)), owner[full]
    return flat.dictionary_encode(), owner


def sequences(raw: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For texts with ends: each byte under the five before it as one number, the nearest one highest.

    So the contexts of one sequence are the beginnings of its number. Bytes further off than ``depth`` are zero.
    """
    code = raw.astype(np.int64)
    for k in range(1, min(depth, 5) + 1):
        code |= backward(raw, offsets, k).astype(np.int64) << (48 - 8 * k)
    return code


def _sum_up(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers, each once with the sum of its counts."""
    order = np.argsort(code)
    code, n = code[order], n[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(n, first) if len(first) else n


def gather(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, word, code, n) of rows (text, learn): words (kind 0) and byte sequences (kind 1), and how often they are learned.

    Sequences of the other rows are listed as well, words are not.
    """

    def run(batches):
        words: dict[str, int] = {}
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        names = ["kind", "word", "code", "n"]

        def spilled():
            out = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(words), np.int32)), pa.array(list(words), pa.string()), int64(np.zeros(len(words), np.int64)), pa.array(list(words.values()), pa.int64())], names)
            words.clear()
            return out

        def merged():
            code, n = _sum_up(*map(np.concatenate, zip(*waiting, strict=True)))
            waiting[:] = [(code, n)]
            return len(code)

        def flushed():
            code, n = waiting.pop()
            for start in range(0, len(code), 1 << 18):
                c, k = code[start : start + (1 << 18)], n[start : start + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(c), np.int32)), pa.nulls(len(c), pa.string()), int64(c), int64(k)], names)

        for part in slices(batches):
            learn = part.column("learn").to_numpy(zero_copy_only=False).astype(bool)
            raw, offsets = _with_ends(*text_bytes(part.column("text")))
            mark = np.repeat(learn.astype(np.int64), np.diff(offsets))
            found, n = np.unique((sequences(raw, offsets, depth) << 1) | mark, return_counts=True)
            waiting.append((found >> 1, n * (found & 1)))
            if sum(len(c) for c, _ in waiting) > 4_000_000 and merged() > 2_000_000:
                yield from flushed()
            coded, _ = _words(part.column("text").filter(pa.array(learn)))
            for word, k in zip(coded.dictionary.to_pylist(), np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary)).tolist(), strict=True):
                words[word] = words.get(word, 0) + k
            if len(words) > 300_000:
                yield spilled()
        yield spilled()
        if waiting:
            merged()
            yield from flushed()

    counted = texts.mapInArrow(run, "kind int, word string, code long, n long")
    return counted.groupBy("kind", "word", "code").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """What follows all contexts of one length: sorted (context << 8 | byte) with counts, and of each context the
    sum of counts, the number of bytes, and the sum of the counts that these bytes have in the next shorter context."""

    keys: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    below: np.ndarray


def _level(code: np.ndarray, n: np.ndarray, below: Level | None) -> Level:
    """From numbers (context << 8 | byte) with counts, repeated ones added up."""
    keys, n = _sum_up(code, n)
    contexts, at = np.unique(keys >> 8, return_inverse=True)
    sums = lambda x: np.bincount(at, x, len(contexts))
    shorter = below.counts[np.searchsorted(below.keys, _shorter(keys))] if below else np.zeros(len(keys))
    return Level(keys, n, contexts, sums(n), np.bincount(at, minlength=len(contexts)), sums(shorter))


def _shorter(keys: np.ndarray) -> np.ndarray:
    """(context << 8 | byte) without the furthest byte of the context."""
    return ((keys >> 16) << 8) | (keys & 255)


def short_levels(code: np.ndarray, n: np.ndarray) -> list[Level]:
    """The levels of no byte, one and two, from the counts after two bytes."""
    one = _shorter(code)
    levels = [_level(_shorter(one), n, None)]
    levels.append(_level(one, n, levels[0]))
    levels.append(_level(code, n, levels[1]))
    return levels


def _place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of numbers among sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def chances(code: np.ndarray, n: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probabilities of sequences, given all that end in the same three bytes before the last one.

    The bytes seen in a context are seen in every shorter one too, so what a longer context excludes is what it has seen.
    """
    byte, learned = code & 255, n > 0
    levels = list(levels)
    for length in (3, 4, 5):
        levels.append(_level((((code >> (48 - 8 * length)) << 8) | byte)[learned], n[learned], levels[-1]))
    p, carried, done = np.zeros(len(code)), np.ones(len(code)), np.zeros(len(code), bool)
    gone, gone_kinds = np.zeros(len(code)), np.zeros(len(code), np.int64)
    for length in range(5, -1, -1):
        level, context = levels[length], code >> (48 - 8 * length)
        at, seen = _place(level.contexts, context)
        if not seen.any():
            continue
        take = lambda x: np.where(seen, x[at], 0)  # noqa: B023, E731
        size, kinds, left = take(level.total) - gone, take(level.kinds) - gone_kinds, 256 - take(level.kinds)
        here = seen & (kinds > 0) & ~done
        base = np.maximum(np.where(left > 0, size + kinds, size), 1)
        where, found = _place(level.keys, (context << 8) | byte)
        hit = here & found
        p[hit] = carried[hit] * level.counts[where[hit]] / base[hit]
        carried = np.where(here, np.where(left > 0, carried * kinds / base, 0), carried)
        done |= hit
        gone, gone_kinds = take(level.below), take(level.kinds)
    return np.log10(np.where(done, p, carried / np.maximum(256 - gone_kinds, 1)))


def all_chances(counted: DataFrame, shared) -> DataFrame:
    """(code, n, p): the log10 probability of every sequence of rows (code, n); ``shared`` broadcasts the short levels."""

    def run(batches):
        levels, waiting, size = shared.value, [], 0

        def out(code, n):
            return pa.RecordBatch.from_arrays([int64(code), int64(n), pa.array(chances(code, n, levels))], ["code", "n", "p"])

        for batch in batches:
            waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size >= 1 << 20:
                code, n = map(np.concatenate, zip(*waiting, strict=True))
                cut = int(np.searchsorted(code, (code[-1] >> 24) << 24))  # the last group may go on
                if cut:
                    yield out(code[:cut], n[:cut])
                waiting, size = [[code[cut:], n[cut:]]], 0
        if waiting:
            yield out(*map(np.concatenate, zip(*waiting, strict=True)))

    parted = counted.select("code", "n").repartition(F.shiftright("code", 24)).sortWithinPartitions("code")
    return parted.mapInArrow(run, "code long, n long, p double")


class Lookup:
    """Numbers with values in tables without chains: what collides in one table goes to the next."""

    _ODD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, code: np.ndarray, value: np.ndarray):
        """What comes first is found fastest."""
        self.tables = []
        while len(code):
            bits = max(int(2 * len(code) - 1).bit_length(), 4)
            slot = self._slots(code, bits)
            slots, first = np.unique(slot, return_index=True)
            keys, values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
            keys[slots], values[slots] = code[first], value[first]
            self.tables.append((bits, keys, values))
            rest = np.ones(len(code), bool)
            rest[first] = False
            code, value = code[rest], value[rest]

    def _slots(self, code: np.ndarray, bits: int) -> np.ndarray:
        mixed = code.view(np.uint64) * (self._ODD + np.uint64(2 * bits))
        return (mixed >> np.uint64(64 - bits)).view(np.int64)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, zero where there is none, and the places of the numbers that aren't here."""
        out, rest = np.zeros(len(code)), None
        for bits, keys, values in self.tables:
            some = code if rest is None else code[rest]
            slot = self._slots(some, bits)
            hit = keys.take(slot) == some
            if rest is None:
                out = np.where(hit, values.take(slot), 0.0)
                rest = np.flatnonzero(~hit)
            else:
                out[rest[hit]] = values.take(slot[hit])
                rest = rest[~hit]
        return out, np.arange(len(code)) if rest is None else rest


def gather_level(texts: DataFrame, shared, size: int) -> DataFrame:
    """(code, n): counts of (node << 8 | byte) over all texts for the deepest contexts of a trie.

    ``shared`` broadcasts its nodes and children, ``size`` is the number of the deepest contexts.
    """

    def run(batches):
        nodes, children = shared.value
        total = np.zeros((size + 1) << 8, np.int64)
        for part in slices(batches, _PART):
            raw, offsets = _with_ends(*text_bytes(part.column("text")))
            *_, node = descend(nodes, children, raw, offsets)
            found, n = np.unique((node << 8) | raw, return_counts=True)
            total[found] += n
        total = total[: size << 8]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["code", "n"])

    return texts.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def train(texts: DataFrame, grams, depth: int, spread: int) -> Trie:
    """The trie of all texts, given their counts of (pair of bytes, byte); one pass for each further length."""
    context = texts.sparkSession.sparkContext
    growing = Growing(grams["code"], grams["n"], spread)
    for _ in range(depth - 2):
        if not growing.extend():
            break
        shared = context.broadcast((growing.nodes, growing.children))
        level = gather_level(texts, shared, len(growing.names[-1])).toPandas()
        shared.unpersist()
        growing.count(level["code"].to_numpy(np.int64), level["n"].to_numpy(np.int64))
    return growing.finished()


def _few(flat: pa.Array, index: np.ndarray, owner: np.ndarray, rows: int, names: list[str]) -> pa.ListArray:
    """What each row looks up by a join, each value once with its number."""
    pair, times = np.unique((owner.astype(np.int64) << 32) | index, return_counts=True)
    one = pa.StructArray.from_arrays([pc.take(flat, pa.array(pair & 0xFFFFFFFF)), pa.array(times.astype(np.int32))], names)
    return ragged(one, np.bincount(pair >> 32, minlength=rows))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD, depth: int = DEPTH, contexts: int | None = None, common: int = COMMON) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    if not 2 <= depth <= 5 and contexts is None:
        raise ValueError(f"depth must be 2 to 5, got {depth}")
    spark = docs.sparkSession
    context = spark.sparkContext
    small_batches(spark)
    picked = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    learn = picked.where(~held_out(F.col("doc_id")))
    counted = staged(gather(picked.select("text", (~held_out(F.col("doc_id"))).alias("learn")), depth if contexts is None else 2), "ppm-counts")
    ends = learn.count()
    words = counted.where("kind = 0").select("word", F.col("n").alias("c"))
    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, kinds = size["n"] + ends, size["v"] + (ends > 0)
    # fewer than ``spread`` words pass, since their counts add up to no more than the total
    often = words.where((F.col("c") * spread > total) & (F.octet_length("word") <= WORD_BYTES)).toPandas()
    seen = counted.where("kind = 1").select("code", "n")
    after_two = (F.shiftleft(F.shiftright("code", 32), 8) + F.col("code").bitwiseAND(255)).cast("int")
    grams = seen.where("n > 0").groupBy(after_two.alias("code")).agg(F.sum("n").alias("n")).toPandas()
    code, n = grams["code"].to_numpy(np.int64), grams["n"].to_numpy(np.int64)
    if contexts is None:
        found = staged(all_chances(seen, context.broadcast(short_levels(code, n))), "ppm-chances")
        # fewer than ``common`` of them, for the same reason
        most = found.where(F.col("n") * common > int(n.sum())).toPandas().sort_values("n", ascending=False)
        bytewise = Lookup(most["code"].to_numpy(np.int64), most["p"].to_numpy(float))
    else:
        found = seen.select("code", F.lit(0.0).alias("p"))
        turned = ((code >> 8 & 255) << 16) | ((code >> 16) << 8) | (code & 255)
        bytewise = train(learn.select("text"), {"code": turned, "n": n}, depth, contexts)
    model = context.broadcast((bytewise, dict(zip(often["word"], often["c"], strict=True))))
    del grams, bytewise
    floor = float(total + 0.5 * (kinds + 1))
    end_score = float(np.log10((ends + 0.5) / floor))

    def by_bytes(known, raw, offsets):
        """The log10 probability of each text as far as it is broadcast, and the sequences that are not."""
        if isinstance(known, Trie):
            return score_bytes(known, raw, offsets), _few(pa.array([], pa.int64()), np.zeros(0, np.int64), np.zeros(0, np.int64), len(offsets) - 1, ["code", "times"])
        raw, offsets = _with_ends(raw, offsets)
        code = sequences(raw, offsets, depth)
        each, rest = known.find(code)
        owner = np.searchsorted(offsets, rest, side="right") - 1
        flat, index = np.unique(code[rest], return_inverse=True)
        return np.add.reduceat(each, offsets[:-1]), _few(int64(flat), index, owner, len(offsets) - 1, ["code", "times"])

    def run(batches):
        known_bytes, common_words = model.value
        for part in slices(batches, 1 << 20):
            rows = part.num_rows
            coded, owner = _words(part.column("text"))
            names = coded.dictionary.to_pylist()
            index = coded.indices.to_numpy(zero_copy_only=False)
            c = np.fromiter((common_words.get(w, -1) for w in names), np.int64, len(names))
            here = c[index] >= 0 if len(index) else np.zeros(0, bool)
            value = np.log10((np.maximum(c, 0) + 0.5) / floor)
            base = np.bincount(owner[here], value[index[here]], rows) + end_score
            known = np.bincount(owner[here], minlength=rows)
            tokens = np.bincount(owner, minlength=rows) + 1
            rare = _few(coded.dictionary, index[~here], owner[~here], rows, ["word", "times"])
            scores, parts = by_bytes(known_bytes, *text_bytes(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), int64(tokens.astype(np.int64)), int64(known.astype(np.int64)), pa.array(base), pa.array(scores), rare, parts], ["doc_id", "n_tokens", "known", "base", "score", "rare", "parts"])

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType())]
    fields += [T.StructField(name, T.ArrayType(T.StructType([T.StructField(key, kind), T.StructField("times", T.IntegerType())]))) for name, key, kind in (("rare", "word", T.StringType()), ("parts", "code", T.LongType()))]
    scored = picked.mapInArrow(run, T.StructType([picked.schema["doc_id"], *fields])).withColumn("row", F.monotonically_increasing_id())
    scored = staged(scored, "ppm-scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times").join(words, "word", "left")
    rare = rare.select("row", "times", F.coalesce("c", F.lit(0)).alias("c"))
    sums = rare.select("row", (F.col("times") * F.log10((F.col("c") + 0.5) / floor)).alias("more"), F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("also"), F.lit(0.0).alias("rest"))
    parts = scored.select("row", F.explode("parts").alias("r")).select("row", "r.code", "r.times").join(found.select("code", "p"), "code")
    sums = sums.unionByName(parts.select("row", F.lit(0.0).alias("more"), F.lit(0).alias("also"), (F.col("times") * F.col("p")).alias("rest")))
    sums = sums.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("more", "also", "rest")])
    return scored.drop("rare", "parts").join(sums, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0)) + F.lit(1 if ends else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
