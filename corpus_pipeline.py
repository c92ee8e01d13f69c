"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Null texts have no language and go in the first stage; every later stage states its own
cases in its operator.
"""

from __future__ import annotations

import atexit
import contextlib
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import exact_dedup, langid, minhash, packing, secrets
from quillon.llm._common import clear_staging, delete_path, shared_dir


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no text, no letter in it, or none of the languages that the labels teach.

    Texts in several of those languages stay, and so do texts too short to tell.
    """
    return langid.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    return minhash.deduplicate(docs, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; no document goes. n_chars follows a changed text."""
    clean = secrets.redact(docs["text"])
    length = F.when(~clean.eqNullSafe(docs["text"]), F.char_length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])
    return docs.select(*[{"text": clean, "n_chars": length}.get(c, docs[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens; ids as little-endian bytes."""
    return packing.pack_documents(docs)


STAGES = [
    ("language id", known_language),
    ("exact dedup", exact),
    ("minhash near-dedup", near),
    ("secret scan", redact_secrets),
    ("packing", pack),
]

#: The network of the first stage and the vocabulary of the last have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and reread by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    atexit.register(_forget, spark, root)
    for i, (_, stage) in enumerate(STAGES):
        path = f"{root}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        clear_staging(spark)
        if i:
            delete_path(spark, f"{root}/{i - 1}")
        docs = spark.read.parquet(path)
    return docs


def _forget(spark: SparkSession, root: str) -> None:
    """Deletes the last result when the driver ends."""
    with contextlib.suppress(Exception):  # the session may be gone by then
        delete_path(spark, root)
