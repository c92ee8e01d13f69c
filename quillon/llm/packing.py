"""Vector bin packing of examples into training sequences.

An example asks for three things at once: tokens, one segment, and loss-bearing tokens. A sequence
limits all three. Sequences are filled one by one from a bounded pool of waiting examples: the next
example is the one whose demand vector has the largest dot product with what the sequence has left
(each dimension as a share of its limit), among those that fit. When none fits, an example may be cut
(``cut=True``) to fill the rest of the tokens; its remainder goes back to the pool.

Each partition packs its own examples, so no rows move. What is left at its end is laid out in
sequences whose lengths are powers of two, which need no padding, and a sequence that runs out of segments
or loss-bearing tokens first is shortened to such a length.

Defined cases: of equal products the example that waits in front is taken; a very long text is encoded whole
and its ids are held until they are placed; null text is the empty text (only the end id); an empty table gives an empty table;
rows are independent, so repeated rows are packed each; an example with more loss-bearing tokens or
tokens than the limit is cut, or refused with an error where cutting is off; other columns are
ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import TOKENIZER_DIR_FILES, id_text, slices, tokenizer_path

#: Waiting examples that a sequence chooses from.
POOL = 128
#: A last character after a letter that is a word of its own.
_STOPS = (".", ",")


@dataclass
class Piece:
    """Part of an example: ``length`` ids from ``start``; ``loss`` marks the loss-bearing ids, or None for all."""

    example: int
    start: int
    length: int
    loss: np.ndarray | None = None

    @property
    def loss_tokens(self) -> int:
        return self.length if self.loss is None else int(self.loss[self.start : self.start + self.length].sum())

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.example, self.start, n, self.loss), Piece(self.example, self.start + n, self.length - n, self.loss)

    def longest(self, tokens: int, loss: int) -> int:
        """The most leading ids within both limits."""
        n = min(self.length, tokens)
        if self.loss is None:
            return min(n, loss)
        return min(n, int(np.searchsorted(np.cumsum(self.loss[self.start : self.start + n]), loss, side="right")))


def pack(examples: Iterable[Piece], tokens: int = 4096, segments: int = 256, loss: int | None = None, pool: int = POOL, cut: bool = True) -> Iterator[list[Piece]]:
    """Sequences, each a list of pieces in order, from a stream of examples."""
    limit = np.array([tokens, segments, loss or tokens], float)
    source, back = iter(examples), deque()
    waiting: list[Piece] = []
    need = np.zeros((pool, 3))

    def fill() -> bool:
        while len(waiting) < pool:
            piece = back.popleft() if back else next(source, None)
            if piece is None:
                return False
            need[len(waiting)] = piece.length, 1, piece.loss_tokens
            waiting.append(piece)
        return True

    def take(i: int) -> Piece:
        piece, last = waiting[i], len(waiting) - 1
        waiting[i], need[i] = waiting[last], need[last]
        waiting.pop()
        return piece

    while True:
        more = fill()
        n = len(waiting)
        if not n:
            return
        if cut and not more and need[:n, 0].sum() < tokens:
            yield from _tail([take(0) for _ in range(n)], tokens, segments, int(limit[2]))
            return
        left, sequence = limit.copy(), []
        while left[0] > 0 and left[1] > 0:
            n = len(waiting)
            fits = (need[:n] <= left).all(1)
            if fits.any():
                score = np.where(fits, (need[:n] / limit) @ (left / limit), -1)
                piece = take(int(score.argmax()))
            elif n and cut:
                i = int(need[:n, 0].argmin()) if left[0] > tokens // 2 else int(need[:n, 0].argmax())
                most = waiting[i].longest(int(left[0]), int(left[2]))
                if not most:
                    break
                piece, rest = take(i).cut(most)
                back.appendleft(rest)
            else:
                if not sequence and n:
                    raise ValueError("an example exceeds a limit and cutting is off")
                break
            sequence.append(piece)
            left -= piece.length, 1, piece.loss_tokens
            fill()
        if cut and left[0] > 0:  # segments or loss-bearing tokens have run out first
            back.extendleft(_round_down(sequence))
        yield sequence


def _round_down(sequence: list[Piece]) -> list[Piece]:
    """Shortens a sequence to a power of two, which needs no padding; gives what it takes off, last piece first."""
    size = sum(p.length for p in sequence)
    more, off = size - (1 << (size.bit_length() - 1)), []
    while more:
        piece = sequence.pop()
        if piece.length > more:
            first, piece = piece.cut(piece.length - more)
            sequence.append(first)
        more -= piece.length
        off.append(piece)
    return off


def _tail(pieces: list[Piece], tokens: int, segments: int, loss: int) -> Iterator[list[Piece]]:
    """The last pieces, under one sequence's tokens in all, in sequences of powers of two."""
    queue = deque(pieces)
    while queue:
        total = sum(p.length for p in queue)
        size = min(1 << (total.bit_length() - 1), tokens)
        sequence, has, bears = [], 0, 0
        while queue and has < size and len(sequence) < segments:
            piece = queue.popleft()
            n = piece.longest(size - has, loss - bears)
            if not n:
                queue.appendleft(piece)
                break
            if n < piece.length:
                piece, rest = piece.cut(n)
                queue.appendleft(rest)
            sequence.append(piece)
            has, bears = has + piece.length, bears + piece.loss_tokens
        yield sequence


class WordTokenizer:
    """Whole-text ids of a BPE vocabulary that drops white space.

    Such a vocabulary encodes what stands between two spaces by itself. So a block of texts is reduced
    to its distinct words, in Arrow, and only words that no recent block had are encoded. Known words and
    their ids are plain arrays: a bounded number of them takes little memory.
    """

    def __init__(self, path: str, cache: int = 400_000):
        from tokenizers import Tokenizer

        self.model, self.cache = Tokenizer.from_file(path), cache
        self.words = pa.array([], pa.string())
        self.ids, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.seen, self.block = np.zeros(0, np.int64), 0  # the block that had each word last
        names = self.model.get_vocab()
        self.closes = np.zeros(max(names.values()) + 1, bool)
        self.closes[[i for w, i in names.items() if w.endswith("</w>")]] = True
        self.stops = {c: self._apart([c])[0] for c in _STOPS}

    def _alphabetic(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of words of letters alone, in one call: each ends with the one id that closes a word."""
        ids = np.array(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):  # a letter whose lower case is no letter
            return self._apart(words)
        return ids, np.diff(ends, prepend=0)

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def _learn(self, words: pa.Array) -> None:
        alphabetic = pc.utf8_is_alpha(words)
        known, ids, sizes = [self.words], [self.ids], [self.size]
        for part, learn in ((words.filter(alphabetic), self._alphabetic), (words.filter(pc.invert(alphabetic)), self._apart)):
            for start in range(0, len(part), 20_000):
                some = part.slice(start, 20_000)
                new = learn(some.to_pylist())
                known.append(some)
                ids.append(new[0])
                sizes.append(new[1])
        self.words, self.ids, self.size = pa.concat_arrays(known), np.concatenate(ids), np.concatenate(sizes)
        self.begin = np.cumsum(self.size) - self.size
        self.seen = np.concatenate([self.seen, np.zeros(len(self.words) - len(self.seen), np.int64)])

    def _forget(self) -> None:
        """Keeps the words of the latest blocks, about half of the cache; long words are never kept."""
        if len(self.words) <= self.cache:
            return
        oldest = np.partition(self.seen, len(self.seen) - self.cache // 2)[len(self.seen) - self.cache // 2]
        keep = (self.seen >= oldest) & (pc.binary_length(self.words).to_numpy(zero_copy_only=False) <= 64)
        self.ids = self.ids[np.repeat(keep, self.size)]
        self.words, self.size, self.seen = self.words.filter(pa.array(keep)), self.size[keep], self.seen[keep]
        self.begin = np.cumsum(self.size) - self.size

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the number of ids of each; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are told apart by case
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(texts)
        if isinstance(split, pa.ChunkedArray):
            split = split.combine_chunks()
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        # a stop after a letter is a word of its own, so fewer words differ; normal form and lower case turn some
        # letters of other classes into marks, which the stop would join
        cores = pc.replace_substring_regex(words, r"(\p{Ll})[.,]$", r"\1")
        cut = pc.not_equal(pc.binary_length(cores), pc.binary_length(words)).to_numpy(zero_copy_only=False)
        place = pc.index_in(cores, self.words)
        if place.null_count:
            self._learn(pc.unique(cores.filter(pc.is_null(place))))
            place = pc.index_in(cores, self.words)
        place = place.to_numpy(zero_copy_only=False).astype(np.int64)
        self.block += 1
        self.seen[place] = self.block
        # ids of the distinct words, each core with its stop
        core = self.size[place]
        sizes = core + cut
        ends = np.cumsum(sizes)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        flat[_runs(ends - sizes, core)] = self.ids[_runs(self.begin[place], core)]
        dots = pc.ends_with(words, ".").to_numpy(zero_copy_only=False)
        flat[ends[cut] - 1] = np.where(dots[cut], self.stops["."][0], self.stops[","][0])
        # ids of the texts
        index = coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[index]
        out = flat[_runs((ends - sizes)[index], each)]
        bounds = np.concatenate([[0], np.cumsum(each)])[split.offsets.to_numpy() - split.offsets[0].as_py()] if len(split) else np.zeros(1, np.int64)
        self._forget()
        return out, np.diff(bounds)


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] numbers, then the same from begin[1], and so on."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


@lru_cache(maxsize=2)
def word_tokenizer(path: str | None = None) -> WordTokenizer:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the executor has its own parallel tasks
    return WordTokenizer(path or tokenizer_path(TOKENIZER_DIR_FILES["word"]))


def _pieces(examples: Iterable[tuple], id_type: pa.DataType, masked: bool, tokens: int, segments: int, loss: int | None, pool: int) -> Iterator[pa.RecordBatch]:
    """Packs examples (row id, ids as bytes, loss mask or None) and gives their pieces in batches."""
    first = TaskContext.get().partitionId() << 32
    texts: dict[int, list] = {}  # examples that still have ids to place: row id, ids, mask, ids left
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", *(["loss"] if masked else [])]
    binary = {"ids", "loss"}

    def waiting():
        for count, (row, ids, mask) in enumerate(examples):
            if ids:
                texts[count] = [row, ids, mask, len(ids) // 4]
                yield Piece(count, 0, len(ids) // 4, mask)

    def flush(rows):
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, id_type if n == "doc_id" else pa.binary() if n in binary else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    rows, size = [], 0
    for k, sequence in enumerate(pack(waiting(), tokens, segments, loss, pool)):
        at = 0
        for p in sequence:
            doc, end = texts[p.example], p.start + p.length
            row = (doc[0], p.start, p.length, doc[1][4 * p.start : 4 * end], len(doc[1]) // 4, first + k, at)
            rows.append((*row, doc[2][p.start : end].astype(np.uint8).tobytes()) if masked else row)
            at, size = at + p.length, size + p.length
            doc[3] -= p.length
            if not doc[3]:
                del texts[p.example]
        if size > 1 << 19:
            yield flush(rows)
            rows, size = [], 0
    if rows:
        yield flush(rows)


def _piece_type(source: DataFrame, masked: bool) -> T.StructType:
    names = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset", *(["loss"] if masked else [])]
    return T.StructType([source.schema["doc_id"], *(T.StructField(c, T.BinaryType() if c in ("ids", "loss") else T.LongType()) for c in names)])


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, tokens: int = 4096, segments: int = 256, loss: int | None = None, pool: int = POOL, encoder: Callable | None = None) -> DataFrame:
    """(doc_id, start, length, ids binary, doc_tokens, sequence_id, offset): one row a piece.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers; every id of a document,
    its end id included, lies in exactly one piece; all ids bear loss. ``encoder`` (a string
    array -> flat ids, ids of each text) may replace the word vocabulary.
    """
    source = id_text(docs, id_col, text_col)
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(source.schema["doc_id"].dataType)

    def run(batches):
        encode = encoder or word_tokenizer(path).encode_block
        end = np.array([end_id], "<u4").tobytes()

        def examples():
            for part in slices(batches, 4 << 20):
                flat, sizes = encode(part.column("text"))
                for row, size, stop in zip(part.column("doc_id"), sizes.tolist(), np.cumsum(sizes).tolist(), strict=True):
                    yield row.as_py(), flat[stop - size : stop].tobytes() + end, None

        yield from _pieces(examples(), id_type, False, tokens, segments, loss, pool)

    return source.mapInArrow(run, _piece_type(source, False))


def pack_examples(rows: DataFrame, id_col: str = "doc_id", parts_col: str = "parts", path: str | None = None, end_id: int = 2, tokens: int = 4096, segments: int = 256, loss: int | None = None, pool: int = POOL, encoder: Callable | None = None) -> DataFrame:
    """The pieces of instruction examples, as of ``pack_documents``, with the column loss: a byte for each id, 1 where it bears loss.

    ``parts_col`` is an array of (text, bears): the ids of an example are those of its parts one after the other
    and the end id, and bear loss where their part does; the end id does as the last part. ``loss`` limits a
    sequence's loss-bearing ids. Null parts, texts and flags count as no parts, empty texts and false.
    """
    part = F.transform(F.coalesce(rows[parts_col], F.array().cast(rows.schema[parts_col].dataType)), lambda p: F.struct(F.coalesce(p["text"], F.lit("")).alias("text"), F.coalesce(p["bears"], F.lit(False)).alias("bears")))
    source = rows.select(rows[id_col].alias("doc_id"), part.alias("parts"))
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(source.schema["doc_id"].dataType)

    def run(batches):
        encode = encoder or word_tokenizer(path).encode_block
        end = np.array([end_id], "<u4")

        def examples():
            for batch in batches:
                for i in range(batch.num_rows):
                    parts = batch.column("parts").slice(i, 1).flatten()
                    flat, sizes = encode(parts.field("text"))
                    bears = parts.field("bears").to_numpy(zero_copy_only=False).astype(bool)
                    mask = np.append(np.repeat(bears, sizes), bears[-1:].any())
                    yield batch.column("doc_id")[i].as_py(), np.append(flat.astype("<u4"), end).tobytes(), mask

        yield from _pieces(examples(), id_type, True, tokens, segments, loss, pool)

    return source.mapInArrow(run, _piece_type(source, True))
