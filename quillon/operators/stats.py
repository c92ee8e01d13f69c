"""Statistics of documents and of the corpus, and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import line_count, word_count
from . import graph

FIELDS = ("sections", "paragraphs", "lines", "words", "included_by_count", "referenced_by_count", "incoming_edges_count", "includes_count", "references_count", "total_edges_count", "bullet_lists", "ordered_lists", "code_blocks", "tables", "quotes")


def _per(edges: DataFrame, column: str, name: str) -> DataFrame:
    """Source blocks by key: an edge counts once for each block that holds it."""
    return edges.select(F.col(column).alias("key"), "src", "dst", "block_pos").distinct().groupBy("key").agg(F.count(F.lit(1)).alias(name))


def document_stats(corpus) -> DataFrame:
    """(key, title, sections, ..., quotes): one row a document.

    Blocks are counted inside each document's own array, so only edge counts move rows.
    """
    kinds = lambda test: F.coalesce(F.size(F.filter("blocks", test)), F.lit(0)).cast("long")
    count = lambda test: F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(kinds(test)).cast("long")
    listed = lambda ordered: count(lambda b: (b["kind"] == "list") & (F.coalesce(b["ordered"], F.lit(False)) == ordered))
    docs = corpus.documents.select(
        "key",
        F.coalesce("title", "key").alias("title"),
        count(lambda b: b["kind"] == "header").alias("sections"),
        count(lambda b: b["kind"] == "paragraph").alias("paragraphs"),
        line_count(F.coalesce("content", F.lit(""))).cast("long").alias("lines"),
        word_count(F.coalesce("content", F.lit(""))).cast("long").alias("words"),
        listed(False).alias("bullet_lists"),
        listed(True).alias("ordered_lists"),
        count(lambda b: b["kind"] == "code").alias("code_blocks"),
        count(lambda b: b["kind"] == "table").alias("tables"),
        count(lambda b: b["kind"] == "quote").alias("quotes"),
    )
    inc, ref = corpus.inclusion_edges, corpus.reference_edges
    outgoing = ref.groupBy(F.col("src").alias("key")).agg(F.sum("occurrences").alias("references_count"))
    for edges in (_per(inc, "dst", "included_by_count"), _per(ref, "dst", "referenced_by_count"), _per(inc, "src", "includes_count"), outgoing):
        docs = docs.join(edges, "key", "left")
    docs = docs.na.fill(0, ["included_by_count", "referenced_by_count", "includes_count", "references_count"])
    incoming = F.col("included_by_count") + F.col("referenced_by_count")
    docs = docs.withColumn("incoming_edges_count", incoming).withColumn("total_edges_count", incoming + F.col("includes_count") + F.col("references_count"))
    return docs.select("key", "title", *FIELDS)


def corpus_stats(corpus, per_document: DataFrame | None = None) -> DataFrame:
    """One row: totals, averages and shares."""
    docs = document_stats(corpus) if per_document is None else per_document
    n = F.count(F.lit(1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    mean = lambda c: F.when(n > 0, total(c) / n).otherwise(F.lit(0.0))
    share = lambda test: F.when(n > 0, 100.0 * total(test.cast("long")) / n).otherwise(F.lit(0.0))
    orphan = (F.col("incoming_edges_count") == 0) & ~F.col("key").rlike("(^|/)index$")
    leaf = F.col("includes_count") == 0
    edges = F.col("included_by_count") + F.col("referenced_by_count")
    return docs.agg(
        n.alias("total_documents"),
        *[total(c).alias(f"total_{c}") for c in ("sections", "paragraphs", "lines", "words")],
        *[mean(c).alias(f"avg_{c}_per_doc") for c in ("sections", "paragraphs", "lines", "words")],
        total("included_by_count").alias("inclusion_edges"),
        total("referenced_by_count").alias("reference_edges"),
        total(edges).alias("total_references"),
        mean(edges).alias("avg_refs_per_doc"),
        total(orphan.cast("long")).alias("orphaned_documents"),
        share(orphan).alias("orphaned_percentage"),
        total(leaf.cast("long")).alias("leaf_documents"),
        share(leaf).alias("leaf_percentage"),
        *[total(c).alias(c) for c in ("bullet_lists", "ordered_lists", "code_blocks", "tables", "quotes")],
    )


TOPS = {"sections": "sections", "lines": "lines", "words": "words", "referenced": "incoming_edges_count", "connected": "total_edges_count"}


def top_documents(corpus, by: str, n: int = 10, per_document: DataFrame | None = None) -> DataFrame:
    """The first ``n`` documents by one of ``TOPS``; ties by key. Documents without edges aren't in the edge lists."""
    docs = document_stats(corpus) if per_document is None else per_document
    column = TOPS[by]
    if by in ("referenced", "connected"):
        docs = docs.where(F.col(column) > 0)
    return docs.orderBy(F.desc(column), "key").limit(n)


def path_stats(corpus) -> DataFrame:
    """One row: number of chains from the roots, chains of one section, longest and mean length."""
    lengths = graph.node_paths(corpus).select(F.size("path").alias("n"))
    return lengths.agg(F.count(F.lit(1)).alias("total_paths"), F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0)).alias("root_sections"), F.coalesce(F.max("n"), F.lit(0)).alias("max_path_depth"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_path_depth"))


def facet_counts(corpus) -> DataFrame:
    """(key, included_by_count, referenced_by_count)."""
    docs = corpus.documents.select("key")
    for column, edges in (("included_by_count", corpus.inclusion_edges), ("referenced_by_count", corpus.reference_edges)):
        docs = docs.join(_per(edges, "dst", column), "key", "left")
    return docs.na.fill(0)


def findings(corpus, touched: DataFrame | None = None) -> DataFrame:
    """(rule, key, other, message): orphans and dangling links, and documents like those touched."""
    none = F.lit(None).cast("string")
    lone = graph.orphans(corpus).select(F.lit("orphan").alias("rule"), "key", none.alias("other"), F.lit("no page links here").alias("message"))
    broken = graph.dangling(corpus).select(F.lit("dangling-link").alias("rule"), F.col("source_key").alias("key"), F.col("target_key").alias("other"), F.format_string("links to missing '%s'", "target_key").alias("message"))
    found = lone.unionByName(broken)
    if touched is not None:
        from . import search

        near = search.most_similar(corpus, touched)
        found = found.unionByName(near.select(F.lit("similar-page").alias("rule"), "key", "other", F.format_string("closely matches '%s' (%.2f)", "other", "score").alias("message")))
    return found


def write_csv(corpus, path: str) -> None:
    document_stats(corpus).write.csv(path, header=True)


def report(corpus) -> str:
    """The corpus statistics as a Markdown table."""
    row = corpus_stats(corpus).first().asDict()
    said = lambda v: f"{v:.2f}" if isinstance(v, float) else str(v)
    return "\n".join(["# Statistics", "", "| Measure | Value |", "| --- | --- |", *(f"| {k.replace('_', ' ')} | {said(v)} |" for k, v in row.items())]) + "\n"
