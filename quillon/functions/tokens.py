"""Token counts by a pluggable tokenizer.

The default is a public byte-level vocabulary where one is installed, and a regular expression that
splits words, numbers and marks elsewhere. ``use`` puts another encoder in their place.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PIECES = re.compile(r"\s*(?:[^\W\d_]+|\d{1,3}|[^\w\s]+|_)|\s+")
_chosen: list[Callable[[str], list[str]]] = []


@lru_cache(maxsize=1)
def _installed() -> Callable[[str], list[str]]:
    try:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        encoding = tiktoken.Encoding("default", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (ImportError, OSError):
        return _PIECES.findall
    return lambda text: [b.decode("latin-1") for b in encoding.decode_tokens_bytes(encoding.encode_ordinary(text))]


def use(encoder: Callable[[str], list[str]] | None) -> None:
    """An encoder that cuts a text into pieces; None goes back to the default."""
    _chosen[:] = [encoder] if encoder else []


def pieces(text: str) -> list[str]:
    return (_chosen[0] if _chosen else _installed())(text)


def count(text: str | None) -> int:
    return len(pieces(text)) if text else 0


@F.pandas_udf(T.IntegerType())
def _count(texts: pd.Series) -> pd.Series:
    return texts.map(count)


def count_tokens(text: Column) -> Column:
    return _count(text)


def marker(omitted: int) -> str:
    return f"\n\n⋯ truncated ({omitted} tokens omitted)"


def truncate(text: str, most: int) -> tuple[str, int]:
    """The first ``most`` tokens, and how many are left out."""
    found = pieces(text)
    if len(found) <= most:
        return text, 0
    kept = "".join(found[:most])
    if not _chosen and _installed() is not _PIECES.findall:
        kept = kept.encode("latin-1").decode(errors="replace")
    return kept, len(found) - most


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("omitted", T.IntegerType())]))
def _clip(texts: pd.Series, most: pd.Series) -> pd.DataFrame:
    rows = [truncate(t or "", int(m)) for t, m in zip(texts, most, strict=True)]
    return pd.DataFrame({"text": [t + marker(n) if n else t for t, n in rows], "omitted": [n for _, n in rows]})


def clip(text: Column, most: int) -> Column:
    """struct<text, omitted>: cut texts end with a marker."""
    return _clip(text, F.lit(most))
