"""Secret scans.

An Aho-Corasick automaton over the lower-cased bytes of a text finds keywords; regular expressions
anchored at the hits then decide, and formats with an embedded checksum or structure are validated.
Runs of hex digits have no keyword; they are found by a plain scan for 24 of them in a row.

Kinds, in the order that breaks ties between equal starts:

* assign, access, hex: the base kinds, leftmost and non-overlapping within each kind;
* github, npm: prefix, 30 characters and a 6-digit base-62 CRC-32 of them, which must agree;
* slack, pem, jwt, google, stripe: by form (a jwt's header must decode to JSON with ``alg``).

Defined cases: null text has no spans; very long texts are scanned whole, in time in proportion to their
length; a header of a jwt that nests too deeply to be read is none; of spans with equal starts the kinds above decide the order; an empty table gives an empty table; rows are independent, so
repeated rows repeat; other columns are ignored by ``scan`` and pass through ``redact`` untouched.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import id_text, int64, slices

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(body: bytes) -> str:
    """CRC-32 in base 62, six digits."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out


def _crc_token(m: re.Match) -> bool:
    return crc_base62(m[1]).encode() == m[2]


def _jwt(m: re.Match) -> bool:
    head = m[1]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (ValueError, RecursionError):  # deeply nested headers are none
        return False
    return isinstance(found, dict) and "alg" in found


_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
#: kind, keywords (lower case), pattern anchored at the keyword's start, test of a match
RULES = [
    ("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), _ASSIGN, lambda m: len(m[1]) >= 6),
    ("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"), _crc_token),
    ("npm", ("npm_",), re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"), _crc_token),
    ("slack", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), re.compile(rb"xox[abprs]-[0-9A-Za-z-]{10,}"), None),
    ("pem", ("-----begin ",), re.compile(rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"), None),
    ("jwt", ("eyj",), re.compile(rb"(eyJ[A-Za-z0-9_-]++)\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+"), _jwt),
    ("google", ("aiza",), re.compile(rb"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), None),
    ("stripe", ("sk_live_", "rk_live_"), re.compile(rb"[sr]k_live_[0-9A-Za-z]{16,}"), None),
]
_HEX = re.compile(rb"[0-9a-f]{24,}")
#: Where a rule's pattern fails because of what follows a run, the run.
_RUNS = {"jwt": re.compile(rb"eyJ[A-Za-z0-9_-]++")}
BASE = ("assign", "access", "hex")
KINDS = [*BASE, *(kind for kind, *_ in RULES if kind not in BASE)]
_RANK = {kind: i for i, kind in enumerate(KINDS)}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for i, (_, words, _, _) in enumerate(RULES):
        for word in words:
            machine.add_word(word, (i, len(word)))
    machine.make_automaton()
    return machine


def find(raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start, then kind."""
    spans = [(m.start(), m.end(), "hex") for m in _HEX.finditer(raw)]
    done = [0] * len(RULES)
    # each byte as one character, so places in the automaton's text are places in the bytes; no keyword of a rule
    # holds another one, so a rule's hits come in the order of their starts
    for last, (i, n) in _automaton().iter(raw.lower().decode("latin-1")):
        start = last + 1 - n
        if start < done[i]:
            continue
        kind, _, pattern, test = RULES[i]
        if m := pattern.match(raw, start):
            done[i] = m.end()
            if test is None or test(m):
                spans.append((start, m.end(), kind))
        elif kind in _RUNS and (m := _RUNS[kind].match(raw, start)):
            done[i] = m.end()  # a later start in the run fails for the same reason
    spans.sort(key=lambda s: (s[0], _RANK[s[2]], s[1]))
    return spans


def find_text(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points."""
    if not text:
        return []
    raw = text.encode()
    spans = find(raw)
    if not spans or len(raw) == len(text):
        return spans
    starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [(int(np.searchsorted(starts, a)), int(np.searchsorted(starts, b)), kind) for a, b, kind in spans]


def _said(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<start, end, kind>>) of every whole text."""
    kind = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])

    def run(batches):
        for part in slices(batches):
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in find_text(t)] for t in part.column("text").to_pylist()]
            of = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, of)], ["doc_id", "spans"])

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("spans", T.ArrayType(kind))]))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every whole text; spans as text."""

    def run(batches):
        for part in slices(batches):
            counts, shas, said = [], [], []
            for text in part.column("text").to_pylist():
                spans = find_text(text)
                base = [s for s in spans if s[2] in BASE]
                counts.append([sum(s[2] == kind for s in base) for kind in BASE])
                shas.append(hashlib.sha256(_said(base).encode()).hexdigest())
                said.append(_said(spans))
            n = np.array(counts, np.int64).reshape(-1, len(BASE))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(int64(n[:, i]) for i in range(len(BASE))), pa.array(shas), pa.array(said)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = id_text(docs, id_col, text_col)
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *fields]))


def blank(text: str | None) -> str | None:
    """The text with every span (overlapping ones merged) replaced by ``<secret>``."""
    spans = find_text(text)
    if not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b, _ in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], "<secret>"]
        at = b
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def _blank(texts):
    return texts.map(blank, na_action="ignore")


def redact(text: Column) -> Column:
    """The text column with all secrets replaced; null stays null."""
    return _blank(text)
