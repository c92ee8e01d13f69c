"""Shared plumbing: staging tables, column picking, byte views of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import shared_dir, sweep_at_exit

TOKENIZER_DIR_FILES = {
    "byte": "byte_bpe_multi_50k.tiktoken",
    "word": "word_bpe_49k.json",
}


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; every node has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _staging_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quillon-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage, so a lost executor costs no more than a re-read, and gives the
    following joins real file sizes to plan with.
    """
    spark = df.sparkSession
    sweep_at_exit(spark, clear_staging)
    path = f"{_staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any store that Spark reaches; nothing happens where there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear_staging(spark: SparkSession) -> None:
    """Deletes what ``staged`` has written for this application."""
    delete_path(spark, _staging_root(spark))


def small_batches(spark: SparkSession) -> None:
    """Batches of at most 1000 rows between JVM and Python, unless the session has its own setting.

    Documents are long, and a batch of Spark's default 10,000 of them is held several times over.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


#: Slots of a bit filter: 2^24, packed into at most 262,144 words of 64.
FILTER_BITS = 24


def _slot(key: Column) -> tuple[Column, Column]:
    """The word of a key's slot, and the slot's bit in it."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS))
    return F.floor(place / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))


def bit_filter(keys: DataFrame, key: str) -> DataFrame:
    """(_quillon_word, _quillon_bits): a set of keys as bits, 4 MB at most whatever the number of keys."""
    word, bit = _slot(F.col(key))
    return keys.select(word.alias("_quillon_word"), bit.alias("bit")).groupBy("_quillon_word").agg(F.bit_or("bit").alias("_quillon_bits"))


def split_by_filter(rows: DataFrame, key: str, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be in the set, and rows whose key is not; the filter is broadcast, no row moves.

    A null key is in no set.
    """
    word, bit = _slot(F.col(key))
    columns = [F.col(c) for c in rows.columns]
    marked = rows.withColumn("_quillon_word", F.when(F.col(key).isNotNull(), word)).join(F.broadcast(bits), "_quillon_word", "left")
    maybe = F.coalesce(F.col("_quillon_bits").bitwiseAND(bit) != 0, F.lit(False))
    return marked.where(maybe).select(*columns), marked.where(~maybe).select(*columns)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; other columns can't clash."""
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))


def crc_mod(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the offsets (n + 1); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that each holds about ``max_bytes`` of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
    _give_back()


def _give_back() -> None:
    """Hands memory that is free again to the system: a worker outlives its tasks, and other stages need the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def int64(values) -> pa.Array:
    """numpy uint64 or int64 as Arrow int64 with the same bits."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def ragged(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    """A list column out of flat values and the number of values of each row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
