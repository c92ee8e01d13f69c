"""Exact deduplication with a heavy-hitter split.

1. Each row is reduced to a digest: SHA-256 of its text without white space.
2. Misra-Gries counters, one bounded table a partition, name the digests that may be frequent.
3. Those candidates are counted exactly and their winners found; at most ``heavy`` are kept.
4. The winners are broadcast: rows of a frequent digest are settled on the map side, without a
   shuffle, so the largest group of copies costs no more than any other rows.
5. The remaining digests use an ordinary shuffle: they are counted with partial sums, and only those that
   occur again are grouped and joined.

Of equal texts the row with the most code points stays, then the smallest id.

Defined cases: a very long text is digested whole; null text counts as empty text, and all empty texts are equal; a null id sorts after
every other id; rows repeating an id and a text are one group, of which ``deduplicate`` keeps one
row; an empty table gives an empty result; other columns pass through ``deduplicate`` untouched,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bit_filter, split_by_filter, staged

#: Most digests that are broadcast, and counters of each partition's Misra-Gries table.
HEAVY = 1024
#: Misra-Gries tables take rows in blocks of this many.
_BLOCK = 1 << 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def misra_gries(counters: dict[bytes, int], keys: list[bytes], counts: list[int], k: int) -> dict[bytes, int]:
    """Merges a block of counted keys into at most ``k`` counters.

    The usual merge: add, then take the (k + 1)-th largest count off every counter. A key with more
    than total / (k + 1) occurrences keeps a counter.
    """
    for key, n in zip(keys, counts, strict=True):
        counters[key] = counters.get(key, 0) + n
    if len(counters) <= k:
        return counters
    cut = int(np.partition(np.fromiter(counters.values(), np.int64), len(counters) - k - 1)[len(counters) - k - 1])
    return {key: n - cut for key, n in counters.items() if n > cut}


def frequent(digests: DataFrame, k: int = HEAVY) -> DataFrame:
    """(digest, seen): candidates of all partitions' Misra-Gries tables, at most ``k``.

    ``digests`` has one binary column, digest. Digests counted once in a partition are left out, as
    they gain nothing from a broadcast.
    """

    def run(batches):
        counters: dict[bytes, int] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, _BLOCK):
                found = batch.column("digest").slice(start, _BLOCK).value_counts()
                counters = misra_gries(counters, found.field("values").to_pylist(), found.field("counts").to_pylist(), k)
        rows = [(d, n) for d, n in counters.items() if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], ["digest", "seen"])

    merged = digests.mapInArrow(run, "digest binary, seen long").groupBy("digest").agg(F.sum("seen").alias("seen"))
    return merged.orderBy(F.desc("seen"), "digest").limit(k)


def _best() -> Column:
    """The row that stays: most code points, then the smallest id."""
    return F.min(F.struct((-F.col("len")).alias("neg"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"))).alias("best")


def _repeated(thin: DataFrame) -> DataFrame:
    """A bit filter of the digests that occur more than once; counting combines on the map side."""
    return bit_filter(thin.groupBy("digest").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "digest")


def _winners(thin: DataFrame, heavy: int) -> DataFrame:
    """(digest, keep_id, keep_len, group_size) of the frequent digests, exact; at most ``heavy`` rows."""
    candidates = F.broadcast(frequent(thin.select("digest"), heavy).select("digest"))
    found = thin.join(candidates, "digest", "left_semi").groupBy("digest").agg(_best(), F.count(F.lit(1)).alias("group_size"))
    return found.select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.neg")).alias("keep_len"), "group_size")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    text = docs[text_col]
    thin = staged(docs.select(docs[id_col].alias("id"), F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("len"), digest(text).alias("digest")), "exact-digests")
    winners = staged(_winners(thin, heavy), "exact-winners")
    settled = thin.join(F.broadcast(winners.drop("keep_len")), "digest")
    rest = thin.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    # most texts occur once and are settled without moving
    maybe, single = split_by_filter(rest, "digest", staged(_repeated(rest), "exact-repeated"))
    best = maybe.groupBy("digest").agg(_best(), F.count(F.lit(1)).alias("group_size"))
    found = maybe.join(best, "digest").withColumn("keep_id", F.col("best.id"))
    single = single.withColumn("keep_id", F.col("id")).withColumn("group_size", F.lit(1))
    columns = [F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    return settled.select(*columns).unionByName(found.select(*columns)).unionByName(single.select(*columns))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    text = docs[text_col]
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("len"), digest(text).alias("digest"))
    thin = staged(keyed.select("id", "len", "digest"), "exact-digests")
    winners = staged(_winners(thin, heavy), "exact-winners")
    # frequent texts lose all but their winner here, before the shuffle
    left = keyed.join(F.broadcast(winners), "digest", "left").where(F.col("group_size").isNull() | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("keep_len"))))
    # only texts that occur again are shuffled; a filter of fixed size lets the others pass
    repeated = staged(_repeated(thin), "exact-repeated")
    maybe, single = split_by_filter(left, "digest", repeated)
    again, _ = split_by_filter(thin, "digest", repeated)
    kept = maybe.join(again.groupBy("digest").agg(_best()), "digest").where((F.col("len") == -F.col("best.neg")) & F.col("id").eqNullSafe(F.col("best.id")))
    # rows that repeat an id and a text
    kept = kept.select("digest", "row").dropDuplicates(["digest"])
    return kept.select("row.*").unionByName(single.select("row.*"))
