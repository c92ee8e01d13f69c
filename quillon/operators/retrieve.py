"""Documents with their surroundings, within limits of number and tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from ..plans.ranking import ranked, running
from ..plans.staging import staged
from . import graph


def expand(corpus, seeds: DataFrame, includes: int = 0, included_by: int = 0, references: int = 0, referenced_by: int = 0) -> DataFrame:
    """(key, seed, phase, depth): each document once, where it first occurs.

    ``seeds`` has key and ord. Each seed gives itself, then what it includes, what includes it (and, with
    both, what includes its direct children), what it refers to and what refers to it, each to its depth and
    in the order of depth, then key. A depth of 0 leaves a direction out; ``ir.UNBOUNDED`` has no end.
    """
    seeds = staged(seeds.select("key", "ord"), "seeds")
    down = corpus.inclusion_edges.select("src", "dst")
    up = down.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    out = corpus.reference_edges.select("src", "dst")
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    starts = seeds.select("ord", "key")
    parts = [seeds.select("ord", "key", F.lit(0).alias("phase"), F.lit("").alias("child"), F.lit(0).alias("depth"))]

    def add(phase: int, edges: DataFrame, depth: int) -> None:
        parts.append(graph.walk(edges, starts, depth, ("ord",)).select("ord", "key", F.lit(phase).alias("phase"), F.lit("").alias("child"), "depth"))

    if includes:
        add(1, down, includes)
    if included_by:
        add(2, up, included_by)
        if includes:
            children = graph.walk(down, starts, 1, ("ord",)).select("ord", "key", F.col("key").alias("child"))
            parts.append(graph.walk(up, children, included_by, ("ord", "child")).select("ord", "key", F.lit(3).alias("phase"), "child", "depth"))
    if references:
        add(4, out, references)
    if referenced_by:
        add(5, back, referenced_by)
    rows = reduce(DataFrame.unionByName, parts)
    first = rows.groupBy("key").agg(F.min(F.struct("ord", "phase", "child", "depth")).alias("first"))
    return first.select("key", "first.ord", "first.phase", "first.child", "first.depth")


ORDER = ("ord", "phase", "child", "depth", "key")


def retrieve(corpus, seeds: DataFrame, limit: int = 0, max_documents: int = 0, exclude: list[str] | None = None, max_tokens: int = 0, max_document_tokens: int = 0, backlinks: bool = False, **directions) -> DataFrame:
    """(place, key, title, content, ...): seeds and their expansion in order.

    ``limit`` caps seeds before the expansion, ``max_documents`` documents after it; ``max_document_tokens``
    cuts each content, ``max_tokens`` ends the list before the document that would exceed the budget.
    """
    if "ord" not in seeds.columns:
        seeds = ranked(seeds.select("key"), ["key"], "ord")
    if limit:
        seeds = seeds.orderBy("ord").limit(limit)
    found = expand(corpus, seeds, **directions)
    if exclude:
        found = found.where(~F.col("key").isin(*exclude))
    if max_documents:
        found = found.orderBy(*ORDER).limit(max_documents)
    rows = found.join(corpus.documents.select("key", "title", F.col("body").alias("content")), "key", "left")
    rows = rows.withColumn("title", F.coalesce("title", "key")).withColumn("content", F.coalesce("content", F.lit("")))
    if backlinks:
        lists = graph.backlinks(corpus, found.select("key")).groupBy("key").agg(F.sort_array(F.collect_list("source")).alias("backlinks"))
        rows = rows.join(lists, "key", "left").withColumn("backlinks", F.coalesce("backlinks", F.array().cast("array<string>")))
    if max_tokens or max_document_tokens:
        rows = budget(rows, list(ORDER), max_tokens, max_document_tokens)
    return rows


def budget(rows: DataFrame, order: list, max_tokens: int = 0, max_document_tokens: int = 0, content: str = "content") -> DataFrame:
    """Rows within a token budget, with columns tokens and clipped.

    The first row always stays; the list ends before the first row that would exceed the budget.
    """
    rows = rows.withColumn("clipped", F.lit(False))
    if max_document_tokens:
        rows = rows.withColumn("_clip", tokens.clip(F.col(content), max_document_tokens)).withColumn("clipped", F.col("_clip.omitted") > 0).withColumn(content, F.col("_clip.text")).drop("_clip")
    rows = rows.withColumn("tokens", tokens.count_tokens(F.col(content)))
    if max_tokens:
        rows = within(rows, order, max_tokens)
    return rows


def within(rows: DataFrame, order: list, most: int, size: str = "tokens") -> DataFrame:
    """The longest start of the rows whose sizes fit, one row that has any size at least."""
    sums = running(rows, order, size, "_sum")
    over = (F.col("_sum") > F.col(size)) & (F.col("_sum") > most)
    stop = sums.where(over).agg(F.min("rank").alias("stop")).first()["stop"]
    return (sums if stop is None else sums.where(F.col("rank") < stop)).drop("rank", "_sum")
