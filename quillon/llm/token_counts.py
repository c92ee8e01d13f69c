"""Exact token counts from a length histogram.

Documents are aggregated by encoded length; prefix and suffix sums over the histogram then answer
totals, quantiles and truncated totals for every context limit without touching documents again.
The sums run in two levels (blocks of lengths, then within a block), so no task holds the whole
histogram however many lengths there are.

Defined cases: null text has length 0; an empty table gives an empty result; repeated rows count
each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from ._common import staged

#: Lengths in a block of the two-level sums.
BLOCK = 1024


def histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(length, docs): the number of documents of each encoded length."""
    return lengths.groupBy(F.col(length_col).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("docs"))


def limits(hist: DataFrame) -> DataFrame:
    """One row for each length in the histogram, taken as a context limit.

    (context_limit, docs_at, docs_within, docs_over, tokens_within, tokens_over, total_docs,
    total_tokens, truncated_tokens, quantile): ``truncated_tokens`` is the sum of min(length, limit)
    over all documents, ``quantile`` the share of documents of at most the limit.
    Between two lengths L < x < M of the histogram, docs_over(x) = docs_over(L) and
    truncated(x) = truncated(L) + (x - L) * docs_over(L), so these rows answer every limit.
    """
    rows = hist.withColumn("tokens", F.col("length") * F.col("docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    block = rows.groupBy("block").agg(F.sum("docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    group = F.floor(F.col("block") / BLOCK)
    # blocks in groups of BLOCK, and one small row for each group above them
    top = block.groupBy(group.alias("g")).agg(F.sum("b_docs").alias("g_docs"), F.sum("b_tokens").alias("g_tokens"))
    above = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = top.select("g", F.coalesce(F.sum("g_docs").over(above), F.lit(0)).alias("g_docs"), F.coalesce(F.sum("g_tokens").over(above), F.lit(0)).alias("g_tokens"), F.sum("g_docs").over(every).alias("total_docs"), F.sum("g_tokens").over(every).alias("total_tokens"))
    before = Window.partitionBy("g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    block = block.withColumn("g", group).select("g", "block", F.coalesce(F.sum("b_docs").over(before), F.lit(0)).alias("b_docs"), F.coalesce(F.sum("b_tokens").over(before), F.lit(0)).alias("b_tokens"))
    base = block.join(top, "g").select("block", (F.col("b_docs") + F.col("g_docs")).alias("b_docs"), (F.col("b_tokens") + F.col("g_tokens")).alias("b_tokens"), "total_docs", "total_tokens")
    upto = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("c_docs", F.sum("docs").over(upto)).withColumn("c_tokens", F.sum("tokens").over(upto)).join(base, "block")
    within, tokens = F.col("c_docs") + F.col("b_docs"), F.col("c_tokens") + F.col("b_tokens")
    return rows.select(
        F.col("length").alias("context_limit"),
        F.col("docs").alias("docs_at"),
        within.alias("docs_within"),
        (F.col("total_docs") - within).alias("docs_over"),
        tokens.alias("tokens_within"),
        (F.col("total_tokens") - tokens).alias("tokens_over"),
        "total_docs",
        "total_tokens",
        (tokens + F.col("length") * (F.col("total_docs") - within)).alias("truncated_tokens"),
        (within / F.col("total_docs")).alias("quantile"),
    )


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **encoder) -> DataFrame:
    """``limits`` over all whole documents, which are encoded once."""
    return limits(staged(histogram(bpe.lengths(docs, id_col, text_col, **encoder)), "lengths"))
