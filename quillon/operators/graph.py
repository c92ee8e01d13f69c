"""Walks over the two edge sets: breadth-first search, relations, roots, paths and trees.

Depth 1 is a plain join. A walk bounded by a few hops is unrolled into one plan. A deeper or unbounded
walk is a loop over frontiers whose state is written to the shared folder each round, so neither the
plan nor what a lost executor must redo grows with the depth; it stops when a frontier is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import ir
from ..plans.staging import kept, staged

#: Hops that are unrolled into one plan.
UNROLL = 3


def walk(edges: DataFrame, starts: DataFrame, high: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``..., key, depth): every key within ``high`` hops of the starts, at its shortest distance.

    ``edges`` has src and dst; ``starts`` has key (and the columns ``by``, which keep walks apart).
    Starts themselves are not in the result of their own walk.
    """
    ids = [*by, "key"]
    hops = edges.select("src", "dst")  # repeated edges make repeated rows, which each hop removes
    if high == 1:
        found = starts.join(hops, starts["key"] == hops["src"]).select(*by, F.col("dst").alias("key"), F.lit(1).alias("depth"))
        return found.distinct().join(starts.select(*ids), ids, "left_anti")
    parts = [starts.select(*ids).distinct().withColumn("depth", F.lit(0))]
    front, depth = parts[0].drop("depth"), 0
    looped = high > UNROLL
    if looped:
        parts = [staged(parts[0], "seen")]
        front = parts[0].drop("depth")
    while depth < high:
        steps = []  # some hops in one plan
        for _ in range(min(UNROLL, high - depth)):
            depth += 1
            reached = front.join(hops, front["key"] == hops["src"]).select(*by, F.col("dst").alias("key")).distinct()
            fresh = reached.join(reduce(DataFrame.unionByName, parts + steps).select(*ids), ids, "left_anti").withColumn("depth", F.lit(depth))
            steps.append(fresh)
            front = fresh.drop("depth")
        if not looped:
            parts += steps
            continue
        found = staged(reduce(DataFrame.unionByName, steps), "front")
        parts.append(found)
        front = found.where(F.col("depth") == depth).drop("depth")
        if front.isEmpty():
            break
        if len(parts) > 8:
            parts = [staged(reduce(DataFrame.unionByName, parts), "seen")]
    return reduce(DataFrame.unionByName, parts).where("depth > 0")


def _directed(corpus, kind: str, to_docs: bool) -> DataFrame:
    """Edges in walking direction: from anchors to documents, or from a document to what it relates to."""
    edges = corpus.inclusion_edges if kind in ("includes", "includedBy") else corpus.reference_edges
    forward = kind in ("includedBy", "referencedBy") if to_docs else kind in ("includes", "references")
    return edges.select("src", "dst") if forward else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _hops(corpus, relation: ir.Relation) -> DataFrame:
    """Edges from anchors to documents; for walks of many hops written once for all queries over a corpus."""
    edges = _directed(corpus, relation.kind, True)
    if relation.high <= UNROLL:
        return edges
    return kept(corpus, f"hops-{relation.kind}", lambda: edges.distinct().repartition("src"))


def related(corpus, relation: ir.Relation, anchors: DataFrame) -> DataFrame:
    """(key): documents that stand in the relation to at least one anchor, anchors excluded.

    Distances are shortest distances from each anchor, so a lower bound above 1 keeps anchors apart.
    Keys of missing documents are walked and returned.
    """
    edges = _hops(corpus, relation)
    anchors = anchors.select("key")
    if relation.low == 1:  # one walk from all anchors, which leaves them out
        return walk(edges, anchors, relation.high).select("key")
    found = walk(edges, anchors.withColumn("anchor", F.col("key")), relation.high, ("anchor",)).where(F.col("depth") >= relation.low)
    return found.select("key").distinct().join(anchors, "key", "left_anti")


def neighbours(corpus, relation: ir.Relation, keys: list[str]) -> DataFrame:
    """(key): what is one hop from given keys, the keys themselves excluded; a filter over the edges."""
    edges = _directed(corpus, relation.kind, True)
    return edges.where(F.col("src").isin(*keys) & ~F.col("dst").isin(*keys)).select(F.col("dst").alias("key")).distinct()


def _related_pairs(corpus, relation: ir.Relation, documents: DataFrame, matching: DataFrame | None) -> DataFrame:
    """(origin, key): each document with every other matching one that it is related to; one hop may repeat pairs.

    One hop is read off the edges, of all documents; longer walks start at ``documents``. ``matching`` (key) may
    be None for all documents.
    """
    edges = _directed(corpus, relation.kind, False)
    if relation.high == 1:
        found = edges.where("src <> dst").select(F.col("src").alias("origin"), F.col("dst").alias("key"))
    else:
        origins = documents.select("key").withColumn("origin", F.col("key"))
        found = walk(edges, origins, relation.high, ("origin",)).where(F.col("depth") >= relation.low).where("origin <> key").select("origin", "key")
    if matching is None and relation.kind in ("includes", "references"):  # a link's source is a document, its target may be none
        matching = corpus.documents
    return found if matching is None else found.join(matching.select("key"), "key", "left_semi")


def related_counts(corpus, relation: ir.Relation, documents: DataFrame, matching: DataFrame | None) -> DataFrame:
    """(key, n) of every document: how many other matching documents it is related to."""
    found = _related_pairs(corpus, relation, documents, matching).distinct()
    counts = found.groupBy(F.col("origin").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return documents.select("key").join(counts, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def with_count(corpus, relation: ir.Relation, documents: DataFrame, matching: DataFrame | None, test) -> DataFrame:
    """The rows of ``documents`` whose count, as of ``related_counts``, passes ``test`` (column -> column).

    Only documents with a relation are counted; those without one are told by a join.
    """
    found = _related_pairs(corpus, relation, documents, matching).withColumnRenamed("key", "other").withColumnRenamed("origin", "key")
    if relation.size.comparisons == (("eq", 0),):
        return documents.join(found.select("key"), "key", "left_anti")
    counts = found.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    if relation.size.holds(0):
        return documents.join(counts.where(~test(F.col("n"))).select("key"), "key", "left_anti")
    return documents.join(counts.where(test(F.col("n"))).select("key"), "key", "left_semi")


def roots(corpus) -> DataFrame:
    """(key): documents that nothing includes and that have a top-level section."""
    headed = corpus.blocks.where("kind = 'header' AND depth = 0").select("key").distinct()
    return corpus.documents.select("key").join(corpus.inclusion_edges.select(F.col("dst").alias("key")), "key", "left_anti").join(headed, "key", "left_semi")


def orphans(corpus) -> DataFrame:
    """(key): documents without an inbound edge of either kind; ``index`` pages are exempt."""
    docs = corpus.documents.select("key").where(~F.col("key").rlike("(^|/)index$"))
    for edges in (corpus.inclusion_edges, corpus.reference_edges):
        docs = docs.join(edges.select(F.col("dst").alias("key")), "key", "left_anti")
    return docs


def dangling(corpus) -> DataFrame:
    """(source_key, target_key): links to missing documents, each pair once; external references don't count."""
    external = F.col("dst").rlike("^(https?://|mailto:)")
    links = corpus.inclusion_edges.select("src", "dst").unionByName(corpus.reference_edges.where(~external).select("src", "dst"))
    missing = links.join(corpus.documents.select(F.col("key").alias("dst")), "dst", "left_anti")
    return missing.select(F.col("src").alias("source_key"), F.col("dst").alias("target_key")).distinct()


def backlinks(corpus, keys: DataFrame) -> DataFrame:
    """(key, source): documents that point at each key by an edge of either kind, itself excluded."""
    both = corpus.inclusion_edges.select("src", "dst").unionByName(corpus.reference_edges.select("src", "dst"))
    return both.where("src <> dst").join(keys.select(F.col("key").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("key"), F.col("src").alias("source")).distinct()


def popularity(corpus) -> DataFrame:
    """(key, popularity): inbound source blocks of both kinds; documents without any are left out."""
    inbound = corpus.inclusion_edges.select(F.col("dst").alias("key"), "src", "block_pos").distinct().select("key").unionByName(corpus.reference_edges.select(F.col("dst").alias("key"), "src", "block_pos").distinct().select("key"))
    return inbound.groupBy("key").agg(F.count(F.lit(1)).alias("popularity"))


def paths(corpus) -> DataFrame:
    """(keys): chains of documents over inclusion edges from each root; no key twice in a chain."""
    edges = staged(corpus.inclusion_edges.select("src", "dst").distinct(), "edges")
    front = staged(roots(corpus).select(F.array("key").alias("keys")), "paths")
    parts = [front]
    while True:  # ends, since no chain has a document twice
        last = F.element_at("keys", -1)
        front = staged(front.join(edges, last == edges["src"]).where(~F.array_contains("keys", F.col("dst"))).select(F.concat("keys", F.array("dst")).alias("keys")), "paths")
        if front.isEmpty():
            break
        parts.append(front)
    return reduce(DataFrame.unionByName, parts)


def node_paths(corpus) -> DataFrame:
    """(key, path): titles from a root section down to each section, crossing inclusion edges.

    Lists have no sections of their own; a chain never visits a document twice.
    """
    sections = corpus.blocks.where("kind = 'header'").select("key", "pos", "depth", "plain_text", "path")
    tops = sections.where("depth = 0").groupBy("key").agg(F.min_by("plain_text", "pos").alias("top"))
    chains = paths(corpus).withColumn("key", F.element_at("keys", -1))
    titles = corpus.documents.select("key", F.coalesce("title", "key").alias("title")).join(tops, "key", "left").select("key", F.coalesce("top", "title").alias("name"))
    named = chains.withColumn("at", F.monotonically_increasing_id()).select("at", "key", F.posexplode("keys").alias("n", "k")).join(titles.withColumnRenamed("key", "k"), "k")
    prefix = named.groupBy("at", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias("prefix"))
    return prefix.join(sections, "key").select("key", F.when(F.col("depth") == 0, F.col("prefix")).otherwise(F.concat("prefix", "path", F.array("plain_text"))).alias("path"))


def tree(corpus, starts: DataFrame | None = None, depth: int = 4) -> DataFrame:
    """(root, key, level, trail): children by inclusion under each start, down to ``depth`` levels.

    Siblings are sorted by key. A document met again under one start is listed but not expanded
    again; the first visit in depth-first order is the one that expands. ``trail`` orders the rows of a
    root as a depth-first listing.
    """
    starts = starts if starts is not None else roots(corpus)
    edges = staged(corpus.inclusion_edges.select("src", "dst").distinct(), "edges")
    level = staged(starts.select(F.col("key").alias("root"), "key", F.lit(0).alias("level"), F.array("key").alias("trail")), "tree")
    parts = [level]
    for n in range(1, depth):
        nxt = level.where(F.size(F.array_distinct("trail")) == F.size("trail")).join(edges, level["key"] == edges["src"]).select("root", F.col("dst").alias("key"), F.lit(n).alias("level"), F.concat("trail", F.array("dst")).alias("trail"))
        level = staged(nxt, "tree")
        if level.isEmpty():
            break
        parts.append(level)
    rows = reduce(DataFrame.unionByName, parts)
    # the first visit of a key under a root expands; descendants of any later visit go
    rows = staged(rows, "tree")
    for _ in range(depth):
        first = rows.groupBy("root", "key").agg(F.min("trail").alias("first"))
        rows = rows.join(first, ["root", "key"])
        later = rows.where(F.col("trail") != F.col("first")).select("root", F.col("trail").alias("cut"))
        kept = rows.drop("first").join(later, (rows["root"] == later["root"]) & (F.size(rows["trail"]) > F.size("cut")) & (F.slice(rows["trail"], F.lit(1), F.size("cut")) == F.col("cut")), "left_anti")
        kept = staged(kept, "tree")
        if kept.count() == rows.count():
            break
        rows = kept
    return kept


def subgraph(corpus, starts: DataFrame, depth: int) -> DataFrame:
    """(key): the starts, all within ``depth`` inclusion hops, and every direct includer of those."""
    reached = starts.select("key").distinct()
    if depth:
        reached = reached.unionByName(walk(corpus.inclusion_edges, starts, depth).select("key")).distinct()
    parents = corpus.inclusion_edges.join(reached.select(F.col("key").alias("dst")), "dst", "left_semi").select(F.col("src").alias("key"))
    return reached.unionByName(parents).distinct()


def edge_rows(corpus, kind: str) -> DataFrame:
    """(key, other, block_pos, section_path): edges of a projection source, seen from ``key``."""
    edges = corpus.inclusion_edges if kind in ("$includes", "$includedBy") else corpus.reference_edges
    mine, other = ("src", "dst") if kind in ("$includes", "$references") else ("dst", "src")
    path = F.array().cast("array<string>") if kind == "$references" else F.coalesce("section_path", F.array().cast("array<string>"))
    return edges.select(F.col(mine).alias("key"), F.col(other).alias("other"), "block_pos", path.alias("section_path"))


def edge_lists(corpus, keys: DataFrame, kind: str) -> DataFrame:
    """(key, edges array<struct<key, title, sectionPath>>): one entry per other document, sorted by key.

    Of several edges between two documents the one with the lowest block position gives the path.
    """
    rows = edge_rows(corpus, kind).join(keys.select("key"), "key", "left_semi")
    first = rows.groupBy("key", "other").agg(F.min_by("section_path", "block_pos").alias("path"))
    titled = first.join(corpus.documents.select(F.col("key").alias("other"), "title"), "other", "left")
    entry = F.struct(F.col("other").alias("key"), F.coalesce("title", "other").alias("title"), F.col("path").alias("sectionPath"))
    return titled.groupBy("key").agg(F.sort_array(F.collect_list(entry)).alias("edges"))


def first_per(rows: DataFrame, by: str, *order) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_n = 1").drop("_n")
