"""Byte-level BPE encoding and decoding by a local rank file.

The tiktoken library encodes; each match of the split pattern is encoded separately. Long texts are
first cut at safe boundaries: places where no match of the pattern can reach across, so the cut text
gives the same ids. Decoding joins raw bytes and never goes through text, so ids that split a
character decode exactly.

Defined cases: null text is the empty text (no ids); an empty table gives an empty table; rows are
independent, so repeated rows and ids repeat in the result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import TOKENIZER_DIR_FILES, id_text, int64, ragged, slices, tokenizer_path

#: Texts over this many characters are cut.
LONG = 1 << 16
#: A white-space character after another character: no match starts before and ends after it.
_SAFE = regex.compile(r"(?<=\S)(?=\s)")
#: Runs of one class over this length go through the regex library, match by match.
_RUN = 1 << 14
_LONG_RUN = regex.compile(r"\s{%d,}|[^\s]{%d,}" % (_RUN, _RUN))


class ByteBPE:
    """Encoder and decoder for one rank file and one split pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.names = [str(i) for i in range(max(ranks.values()) + 1)]

    def pieces(self, text: str) -> Iterator[str]:
        """The text cut at safe boundaries into pieces of about LONG characters."""
        start, n = 0, len(text)
        while n - start > LONG:
            found = _SAFE.search(text, start + LONG)
            end = found.start() if found else n
            yield text[start:end]
            start = end
        if start < n or not n:
            yield text[start:]

    def _matches(self, text: str) -> list[int]:
        """Ids match by match, for texts whose runs are too long for the library's own splitter."""
        ids: list[int] = []
        for m in self.pattern.finditer(text):
            ids += self.encoding._encode_single_piece(m[0])
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) < _RUN:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for piece in self.pieces(text):
            ids += self._matches(piece) if _LONG_RUN.search(piece) else self.encoding.encode_ordinary(piece)
        return ids

    def decode(self, ids) -> bytes:
        return self.encoding.decode_bytes(list(ids))


@lru_cache(maxsize=4)
def byte_bpe(path: str | None = None, pattern: str | None = None) -> ByteBPE:
    """The encoder, loaded once in each Python worker."""
    import public_tokenizers

    return ByteBPE(path or tokenizer_path(TOKENIZER_DIR_FILES["byte"]), pattern or public_tokenizers.PATTERN)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""

    def run(batches):
        bpe = byte_bpe(path, pattern)
        for part in slices(batches):
            ids = [bpe.encode(t) for t in part.column("text").to_pylist()]
            flat = np.fromiter((i for x in ids for i in x), np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ragged(pa.array(flat), [len(x) for x in ids])], ["doc_id", "ids"])

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, bytes binary): the raw bytes of each row's ids; null ids decode to no bytes."""

    def run(batches):
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            out = [bpe.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    picked = rows.select(rows[id_col].alias("doc_id"), rows[ids_col].alias("ids"))
    return picked.mapInArrow(run, T.StructType([picked.schema["doc_id"], T.StructField("bytes", T.BinaryType())]))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, then decodes the ids, in one pass.

    Ids stay in the worker, so a corpus is digested without moving them.
    """

    def run(batches):
        bpe = byte_bpe(path, pattern)
        names = bpe.names
        for part in slices(batches):
            counts, ids_sha, bytes_sha = [], [], []
            for text in part.column("text").to_pylist():
                ids = bpe.encode(text)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                bytes_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), int64(np.array(counts, np.int64)), pa.array(ids_sha), pa.array(bytes_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = id_text(docs, id_col, text_col)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *fields]))


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every whole text."""

    def run(batches):
        bpe = byte_bpe(path, pattern)
        for part in slices(batches):
            counts = np.array([len(bpe.encode(t)) for t in part.column("text").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), int64(counts)], ["doc_id", "n_tokens"])

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.LongType())]))
